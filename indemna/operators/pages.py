"""Printed lines back into the lines of the terms, and the page on which each article begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indemna.operators.terms import ARTICLE, article_head

#: Fixed value: the mark that keeps a line of a table from being read as structure.
TABLE_MARK = "│"


def _walk(line: Column, opener: str, closer: str) -> Column:
    """struct(net, low): how many brackets of a kind a text leaves open, and the least count on the way."""
    start = F.struct(F.lit(0).alias("net"), F.lit(0).alias("low"))

    def step(a: Column, c: Column) -> Column:
        net = a["net"] + F.when(c == opener, 1).when(c == closer, -1).otherwise(0)
        return F.struct(net.alias("net"), F.least(a["low"], net).alias("low"))

    def walked(marks: Column) -> Column:
        n = F.length(marks)
        some = lambda net, low: F.struct(net.alias("net"), low.alias("low"))
        # Brackets of one side only need no steps.
        return F.when(~F.contains(marks, F.lit(closer)), some(n, F.lit(0))).when(~F.contains(marks, F.lit(opener)), some(-n, -n)).otherwise(F.aggregate(F.split(marks, ""), start, step))

    return F.get(F.transform(F.array(F.regexp_replace(line, f"[^\\{opener}\\{closer}]+", "")), walked), F.lit(0))


def rejoined_lines(lines: DataFrame, uid: str, order: str, line: str, page: str, in_table: str) -> DataFrame:
    """(uid, order, line, page): the ``lines`` with wrapped titles of articles in one, on the page of their first line.

    A heading whose bracket isn't closed on its line takes the lines that follow, up to the one that closes it, or all that
    are left. Only brackets of its own kind count; headings inside are part of the title. Lines of tables carry a mark and head nothing.

    What a line does to the depth of brackets is told from the line alone. One fold over each document then carries the depth from line
    to line and keeps only where titles begin and end, so what is carried grows with the wrapped titles, not with the text.
    """
    text = F.when(F.col(in_table), F.concat(F.lit(TABLE_MARK), F.col(line))).otherwise(F.col(line))
    rows = lines.select(uid, order, F.col(page).alias("page"), text.alias("line"))
    head = F.regexp_extract("line", ARTICLE + "(.*)$", 3)
    kind = F.when(F.rlike("line", F.lit(ARTICLE)), F.substring(head, 1, 1))
    own = F.when(kind == "(", _walk(head, "(", ")")["net"]).when(kind == "[", _walk(head, "[", "]")["net"])
    # A heading's own bracket closes where article_head finds its end.
    opens = kind.isNotNull() & article_head(F.col("line")).isNull()
    opened = F.when(opens, F.struct(kind.alias("kind"), own.alias("depth")))
    marks = rows.where(F.rlike("line", F.lit("[()\\[\\]]"))).select(uid, F.col(order).alias("at"), opened.alias("h"), _walk(F.col("line"), "(", ")").alias("round"), _walk(F.col("line"), "[", "]").alias("square"))
    marks = marks.select(uid, F.struct("at", F.col("h.kind").alias("opens"), "h.depth", "round", "square").alias("m"))
    # Lines that change no depth are left out where marks are gathered: a filter would be pushed down and walk each line again.
    counts = F.expr("m.opens is not null or m.round.low < 0 or m.square.low < 0 or m.round.net > 0 or m.square.net > 0")
    at = marks.schema["m"].dataType["at"].dataType
    none = F.array().cast(f"array<struct<start:{at.simpleString()},end:{at.simpleString()}>>")
    start = F.struct(F.lit(None).cast(at).alias("start"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("depth"), none.alias("spans"))

    def step(a: Column, m: Column) -> Column:
        walk = F.when(a["kind"] == "(", m["round"]).otherwise(m["square"])
        closed = F.struct(F.lit(None).cast(at).alias("start"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("depth"), F.array_append(a["spans"], F.struct(a["start"].alias("start"), m["at"].alias("end"))).alias("spans"))
        inside = F.when(a["depth"] + walk["low"] <= 0, closed).otherwise(F.struct(a["start"], a["kind"], (a["depth"] + walk["net"]).alias("depth"), a["spans"]))
        begun = F.struct(m["at"].alias("start"), m["opens"].alias("kind"), m["depth"].alias("depth"), a["spans"])
        return F.when(a["kind"].isNotNull(), inside).when(m["opens"].isNotNull(), begun).otherwise(a)

    def finish(a: Column) -> Column:
        rest = F.struct(a["start"].alias("start"), F.lit(None).cast(at).alias("end"))
        return F.when(a["kind"].isNotNull(), F.array_append(a["spans"], rest)).otherwise(a["spans"])

    spans = marks.groupBy(uid).agg(F.array_sort(F.collect_list(F.when(counts, F.col("m")))).alias("m")).select(F.col(uid).alias("of"), F.aggregate("m", start, step, finish).alias("spans"))
    told = rows.join(spans.where(F.size("spans") > 0), F.col(uid).eqNullSafe(F.col("of")), "left")
    inside = F.filter("spans", lambda s: (s["start"] <= F.col(order)) & (s["end"].isNull() | (F.col(order) <= s["end"])))
    told = told.withColumn("first", F.coalesce(F.get(inside, F.lit(0))["start"], F.col(order)))
    whole = told.groupBy(uid, "first").agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("l"), F.min(F.struct(order, "page"))["page"].alias("page"))
    return whole.select(uid, F.col("first").alias(order), F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("line"), "page")


def article_pages(articles: DataFrame, lines: DataFrame, uid: str, nth: str, order: str, page: str) -> DataFrame:
    """(uid, number, title, nth, order, page): the line and page of each of ``articles`` (uid, nth, number, title) in ``lines`` (uid, order, line, page).

    Articles are looked for in their order, each from the line behind the last one that was found: the first heading with its number
    and title. What isn't found moves nothing; what is found on a line without a page moves on but is left out.

    Headings are met by (uid, number, title) and numbered in each document; a fold over the articles of a document carries the line.
    """
    heads = lines.where(F.rlike("line", F.lit(ARTICLE))).select(F.col(uid).alias("of"), F.col(order).alias("at"), F.col(page).alias("page"), article_head(F.col("line")).alias("h"))
    heads = heads.where("h is not null").groupBy("of", "h.number", "h.title").agg(F.array_sort(F.collect_list(F.struct("at", "page"))).alias("heads"))
    met = articles.join(heads.withColumnsRenamed({"number": "n", "title": "t"}), F.col(uid).eqNullSafe(F.col("of")) & (F.col("number") == F.col("n")) & (F.col("title") == F.col("t")))
    # Equal headings share one entry of the document, however many articles have them.
    places = met.groupBy(uid, "number", "title").agg(F.first("heads").alias("heads"), F.collect_list(nth).alias("nths"))
    places = places.groupBy(uid).agg(F.collect_list(F.struct("number", "title", "heads", "nths")).alias("all"))
    wanted = F.flatten(F.transform("all", lambda x, i: F.transform(x["nths"], lambda o: F.struct(o.alias("nth"), i.alias("entry")))))
    places = places.withColumn("wanted", F.array_sort(wanted))
    types = [articles.schema[nth].dataType, heads.schema["heads"].dataType.elementType["at"].dataType]
    none = F.array().cast(f"array<struct<nth:{types[0].simpleString()},entry:int,at:{types[1].simpleString()}>>")
    start = F.struct(F.lit(None).cast(types[1]).alias("last"), none.alias("found"))

    def step(a: Column, w: Column) -> Column:
        ahead = F.filter(F.get(F.col("all"), w["entry"])["heads"], lambda h: a["last"].isNull() | (h["at"] > a["last"]))
        at = F.get(ahead, F.lit(0))["at"]
        hit = F.struct(at.alias("last"), F.array_append(a["found"], F.struct(w["nth"].alias("nth"), w["entry"].alias("entry"), at.alias("at"))).alias("found"))
        return F.when(F.size(ahead) > 0, hit).otherwise(a)

    found = places.select(uid, "all", F.explode(F.aggregate("wanted", start, step)["found"]).alias("f")).withColumn("e", F.get("all", F.col("f.entry")))
    on = F.get(F.filter(F.col("e.heads"), lambda h: h["at"] == F.col("f.at")), F.lit(0))["page"]
    return found.select(uid, "e.number", "e.title", F.col("f.nth").alias(nth), F.col("f.at").alias(order), on.alias("page")).where("page is not null")
