"""Wrapped titles and the page map, against plain loops."""

from __future__ import annotations

import random
import re

from indemna.operators import pages

HEAD = re.compile(r"^\s*제\s?(\d+)\s?조(?:의\s?(\d+))?\s*(?=[(\[])")


def head(line: str):
    """(number, title) and whether the title's bracket closes."""
    m = HEAD.match(line)
    if not m:
        return None
    opener, depth = line[m.end()], 0
    for i in range(m.end(), len(line)):
        depth += (line[i] == opener) - (line[i] == {"(": ")", "[": "]"}[opener])
        if depth == 0:
            return m[1] + (f"의{m[2]}" if m[2] else ""), line[m.end() + 1 : i].strip(), True
    return None, None, False


def rejoined(lines):
    out = []
    for n, line, page, table in lines:
        line = "│" + line if table else line
        if out and (h := head(out[-1][1])) and not h[2]:
            out[-1][1] += " " + line
        else:
            out.append([n, line, page])
    return out


def page_map(articles, lines):
    found, cursor = [], 0
    for k, number, title in articles:
        for i in range(cursor, len(lines)):
            if head(lines[i][1]) == (number, title, True):
                if lines[i][2] is not None:
                    found.append((number, title, k, lines[i][0], lines[i][2]))
                cursor = i + 1
                break
    return found


def test_against_loops(spark):
    rng = random.Random(7)
    parts = ["제 1조(가)", "제1조(가)", "제2조의 3 [나(다", "제 2조(나 ", "라) 끝", "마]", "(바", "바)) 사", "text", "", "제3조 (아(자)", "제 3조(아[자)]", "[카]", "제3조 없음"]
    rows = [(d, i, rng.choice(parts), rng.choice([1, 2, 3, None]), rng.random() < 0.1) for d in range(60) for i in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "d int, i int, line string, page int, boxed boolean").repartition(3)
    got = pages.rejoined_lines(df, "d", "i", "line", "page", "boxed").collect()
    want = {d: rejoined([r[1:] for r in rows if r[0] == d]) for d in range(60)}
    assert sorted(map(repr, ((r.d, r.i, r.line, r.page) for r in got))) == sorted(repr((d, *x)) for d in want for x in want[d])

    wanted = [(d, k, rng.choice("123") + rng.choice(["", "의3"]), rng.choice(["가", "나(다 마", "아[자", "나 라", "아(자) 바"])) for d in range(60) for k in range(12)]
    wanted += [(d, 100 + k, *head(x[1])[:2]) for d in want for k, x in enumerate(want[d]) if (head(x[1]) or [None])[0]]
    lines = pages.rejoined_lines(df, "d", "i", "line", "page", "boxed")
    got = pages.article_pages(spark.createDataFrame(wanted, "d int, k int, number string, title string"), lines, "d", "k", "i", "page").collect()
    assert sorted((r.d, r.number, r.title, r.k, r.i, r.page) for r in got) == sorted((d, *x) for d in want for x in page_map([w[1:] for w in wanted if w[0] == d], want[d]))


def test_nothing_and_long(spark):
    df = spark.createDataFrame([(1, i, "제 1조(가" if i == 0 else "나", 1, False) for i in range(3000)] + [(1, 3000, "다) 라", 9, False)], "d int, i int, line string, page int, boxed boolean")
    got = pages.rejoined_lines(df, "d", "i", "line", "page", "boxed").collect()
    assert len(got) == 1 and got[0].line.startswith("제 1조(가 나 나") and got[0].line.endswith("나 다) 라") and got[0].page == 1
    assert pages.rejoined_lines(df.limit(0), "d", "i", "line", "page", "boxed").count() == 0
    assert pages.rejoined_lines(df.where("i = 0"), "d", "i", "line", "page", "boxed").count() == 1
