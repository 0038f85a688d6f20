"""Documents into structure: lines with context, chunks, dictionary matches, comparisons of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from indemna.functions.text import unboxed
from indemna.operators.dictionary import contained


def line_sections(docs: DataFrame, uid: str, text: str, section: str, chapter: str) -> DataFrame:
    """(uid, pos, section, chapter, line): every line with the last section and chapter above it. The patterns tell
    what heads one; a section resets the chapter. Table lines head nothing."""
    lines = docs.select(uid, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    plain = ~F.rlike("line", F.lit("[│┃|┏┗]"))
    rows = lines.withColumn("is_section", plain & F.rlike("line", F.lit(section))).withColumn("is_chapter", plain & ~F.rlike("line", F.lit(section)) & F.rlike("line", F.lit(chapter)))
    above = Window.partitionBy(uid).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n_section", F.sum(F.col("is_section").cast("int")).over(above)).withColumn("section", F.last(F.when(F.col("is_section"), F.col("line")), ignorenulls=True).over(above))
    inside = Window.partitionBy(uid, "n_section").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("chapter", F.last(F.when(F.col("is_chapter"), F.col("line")), ignorenulls=True).over(inside)).select(uid, "pos", "section", "chapter", "line")


def sections(docs: DataFrame, uid: str, text: str, marker: str) -> DataFrame:
    """(uid, sections): a map from the name after each marker to the text up to the next one; texts of a name that
    repeats are joined in order. ``marker`` has one group, the name."""
    parts = docs.select(uid, F.posexplode(F.split(F.regexp_replace(text, marker, "\x1e$1\x1f"), "\x1e")).alias("pos", "part")).where("pos > 0")
    parts = parts.select(uid, "pos", F.substring_index("part", "\x1f", 1).alias("name"), F.trim(F.regexp_extract("part", "(?s)\x1f(.*)$", 1)).alias("body"))
    named = parts.groupBy(uid, "name").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("bodies"))
    named = named.select(uid, F.struct("name", F.array_join(F.transform("bodies", lambda b: b["body"]), "\n")).alias("e"))
    return named.groupBy(uid).agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("sections"))


def split_lines(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Whole lines gathered into chunks of about ``size`` characters; each chunk begins with the last lines of the one
    before, ``overlap`` characters at least. One pass over the array of lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), unboxed), lambda x: x != "")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("held"), F.lit(0).alias("n"))

    def tail(held: Column) -> Column:
        first = F.struct(none.alias("kept"), F.lit(0).alias("n"))
        back = F.aggregate(F.reverse(held), first, lambda a, x: F.when(a["n"] >= overlap, a).otherwise(F.struct(F.concat(F.array(x), a["kept"]).alias("kept"), (a["n"] + F.length(x)).alias("n"))))
        return back

    def step(a: Column, line: Column) -> Column:
        full = (a["n"] + F.length(line) > size) & (F.size(a["held"]) > 0)
        back = tail(a["held"])
        done = F.when(full, F.array_append(a["done"], F.array_join(a["held"], "\n"))).otherwise(a["done"])
        held = F.array_append(F.when(full, back["kept"]).otherwise(a["held"]), line)
        n = F.when(full, back["n"]).otherwise(a["n"]) + F.length(line)
        return F.struct(done.alias("done"), held.alias("held"), n.alias("n"))

    def finish(a: Column) -> Column:
        return F.when(F.size(a["held"]) > 0, F.array_append(a["done"], F.array_join(a["held"], "\n"))).otherwise(a["done"])

    return F.aggregate(lines, start, step, finish)


def chunk_rows(articles: DataFrame, items: DataFrame) -> DataFrame:
    """(node_uid, node_kind, content): articles under their title, and their items."""
    a = articles.select(F.col("article_uid").alias("node_uid"), F.lit("article").alias("node_kind"), F.concat("title", F.lit("\n"), "text").alias("content"))
    i = items.select(F.col("item_uid").alias("node_uid"), F.lit("item").alias("node_kind"), "content")
    return a.unionByName(i)


def term_keys(names: DataFrame, code: str, name: str, most: int = 10, tail_most: int = 3) -> DataFrame:
    """(key, kind, categories): dictionary keys: whole names of ``most`` categories at most, and last words of
    ``tail_most`` at most that are no whole name."""
    rows = names.select(F.substring(code, 1, 3).alias("category"), F.lower(F.col(name)).alias("full"))
    rows = rows.withColumn("tail", F.element_at(F.split("full", " "), -1))
    fold = lambda key, kind, n: rows.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_set("category")).alias("categories")).where(F.size("categories") <= n).withColumn("kind", F.lit(kind))
    full = fold("full", "full", most)
    tail = fold("tail", "tail", tail_most).join(rows.select(F.col("full").alias("key")).distinct(), "key", "left_anti")
    return full.unionByName(tail).select("key", "kind", "categories")


def compare_sources(left: DataFrame, right: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """(key, status, differs): left_only, right_only or both, and the fields that differ; the first row of a key wins."""
    first = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("n = 1").drop("n")
    a = first(left).select(key, F.lit(True).alias("l"), *[F.col(f).alias(f"l_{f}") for f in fields])
    b = first(right).select(key, F.lit(True).alias("r"), *[F.col(f).alias(f"r_{f}") for f in fields])
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("both")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), f) for f in fields]))
    return both.select(key, status.alias("status"), F.when(F.col("l") & F.col("r"), differs).alias("differs"))


def divergence(a: Column, b: Column) -> Column:
    """Where two texts first differ, from 1, or 0: the longest common prefix is found by halving, not by characters."""
    n = F.least(F.length(a), F.length(b))
    bounds = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.expr("0").cast("int") + F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(F.greatest(s["lo"], mid - 1)).alias("hi"))

    prefix = F.aggregate(F.sequence(F.lit(1), F.lit(24)), bounds, halve)["lo"]
    return F.when(a == b, 0).otherwise(prefix + 1)


def divergence_class(a: Column, b: Column) -> Column:
    """What kind of character two texts first differ in."""
    at = divergence(a, b)
    x, y = F.substring(a, at, F.lit(1)), F.substring(b, at, F.lit(1))
    blank = F.rlike(x, F.lit("^\\s$")) | F.rlike(y, F.lit("^\\s$"))
    return F.when(at == 0, "equal").when((x == "") | (y == ""), "cut").when(blank, "space").when(F.lower(x) == F.lower(y), "case").when(F.rlike(x, F.lit("[0-9]")) | F.rlike(y, F.lit("[0-9]")), "digit").otherwise("character")


def character_error(truth: Column, read: Column) -> tuple[Column, Column]:
    """(errors, length): the edit distance without white space, and the length of the truth."""
    t, r = F.regexp_replace(truth, "\\s", ""), F.regexp_replace(read, "\\s", "")
    return F.levenshtein(t, r), F.length(t)


def html_text(html: Column) -> Column:
    """Text of HTML: block ends become newlines, tags go, the five entities are resolved, blanks are squeezed."""
    out = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, "(?i)<br[^>]*>|</(p|div|li|h[1-6]|tr)>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), " ?\n ?", "\n")
    return F.trim(F.regexp_replace(out, "\n+", "\n"), F.lit(" \n"))


def links(pages: DataFrame, uid: str, html: str) -> DataFrame:
    """(uid, pos, href, label) of every link."""
    pattern = '<a href="([^"]*)"[^>]*>([^<]*)</a>'
    parts = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("label"))
    return pages.select(uid, F.posexplode(parts).alias("pos", "a")).select(uid, "pos", "a.href", "a.label")


def resolve_name(asked: DataFrame, known: DataFrame, name: str = "asked", other: str = "product") -> DataFrame:
    """(asked, resolved, tier, candidates): exact, equal but for blanks and case, the only prefix, the only container.

    The first tier with a match decides; several matches of a prefix or container leave it unresolved. Every tier
    is a name inside another, so only such pairs are made; a blank name matches nothing."""
    norm = lambda c: F.lower(F.regexp_replace(c, "\\s+", ""))
    a = asked.select(name).distinct().withColumn("part", norm(name))
    b = known.select(other).distinct().withColumn("whole", norm(other))
    met = contained(a, "part", b, "whole").select("part", "whole").join(a, "part").join(b, "whole")
    tier = F.when(F.col(name) == F.col(other), 0).when(F.col("part") == F.col("whole"), 1).when(F.startswith("whole", "part"), 2).otherwise(3)
    best = met.groupBy(name, tier.alias("tier")).agg(F.sort_array(F.collect_set(other)).alias("candidates"))
    best = best.groupBy(name).agg(F.min_by(F.struct("tier", "candidates"), "tier").alias("b"))
    found = F.when(F.size("b.candidates") == 1, F.col("b.candidates")[0])
    return asked.select(name).distinct().join(best, name, "left").select(name, found.alias("resolved"), F.col("b.tier").alias("tier"), F.coalesce(F.size("b.candidates"), F.lit(0)).alias("candidates"))


def _bare(name: Column, noise: str) -> Column:
    return F.regexp_replace(F.lower(name), f"{noise}|\\s+", "")


def same_product(a: Column, b: Column, noise: str) -> Column:
    """True if, without noise words and blanks, one name contains the other."""
    x, y = _bare(a, noise), _bare(b, noise)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def same_products(names: DataFrame, name: str, noise: str) -> DataFrame:
    """(a, b): the pairs a < b of distinct names that ``same_product`` holds for, found by containment."""
    rows = names.select(name).distinct().withColumn("bare", _bare(F.col(name), noise))
    met = contained(rows, "bare", rows, "bare").select("part", "whole")
    left, right = rows.select(F.col(name).alias("x"), F.col("bare").alias("part")), rows.select(F.col(name).alias("y"), F.col("bare").alias("whole"))
    pairs = met.join(left, "part").join(right, "whole").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
