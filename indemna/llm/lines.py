"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from indemna.llm.common import among, join_in_parts, settle

#: White space between words of a line, besides the blank.
_WHITE = ("\t", "\r", "\f", "\x0b")


def _lines(text: str) -> Column:
    """The lines of a text, lower-cased, with blanks for other white space."""
    return F.split(_plain(F.lower(text)), "\n")


def _plain(text: Column) -> Column:
    """The text with blanks for white space other than newlines."""
    odd = F.contains(text, F.lit(_WHITE[0]))
    for white in _WHITE[1:]:
        odd = odd | F.contains(text, F.lit(white))
    return F.when(odd, F.translate(text, "".join(_WHITE), " " * len(_WHITE))).otherwise(text)


def _words(line: Column) -> Column:
    """Lines are compared as lower-cased words."""
    words = F.split(line, " ")
    uneven = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | (line == "")
    return F.when(uneven, F.array_remove(words, "")).otherwise(words)


def _halves() -> Column:
    """Hashes of both halves of ``words``: two lines within one word share a half, so those that share none with
    another line need no neighbourhood."""
    n = F.size("words")
    short, long = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    cut = lambda side, size: F.xxhash64(F.lit(side), size, F.slice("words", 1, size) if side else F.slice("words", n - size + 1, size))
    return F.array_distinct(F.array(cut(1, short), cut(1, long), cut(0, short), cut(0, long)))


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """(rk, at, code, all): a hash of the line's words without word ``at``, and a hash of all of them.

    A line's hash is the exclusive or of hashes of (word, place), so a deletion shifts the places of
    what follows: prefix and suffix hashes of one sorted window give all variants in linear time.
    """
    words = lines.select("rk", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    words = words.select("rk", "n", "at", F.xxhash64("word", "at").alias("here"), F.xxhash64("word", F.col("at") - 1).alias("left"))
    line = Window.partitionBy("rk").orderBy("at")
    up, whole = line.rowsBetween(Window.unboundedPreceding, Window.currentRow), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = lambda c, w: F.bit_xor(c).over(w)
    words = words.select("rk", "n", "at", "here", over("here", up).alias("before"), over("left", up).alias("shifted"), over("here", whole).alias("whole"), over("left", whole).alias("moved"))
    code = F.col("before").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("moved")).bitwiseXOR(F.col("shifted"))
    return words.select("rk", "at", F.xxhash64(code, F.col("n") - 1).alias("code"), F.xxhash64("whole", "n").alias("all"))


def _one_apart(a: str, b: str) -> Column:
    """True if two arrays of words are equal but for one word replaced, added or left out."""
    m, n = F.size(a), F.size(b)
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    replaced = (m == n) & (F.slice(a, differs + 1, m) == F.slice(b, differs + 1, m))
    added = (m == n + 1) & (F.slice(a, differs + 1, m) == F.slice(b, differs, m + 1))
    left = (n == m + 1) & (F.slice(a, differs, n + 1) == F.slice(b, differs + 1, n))
    return (differs == 0) | (differs > 0) & (replaced | added | left)


def _near(docs: DataFrame, close: DataFrame) -> DataFrame:
    """(h1, h2) of the lines of ``close`` (h1, h2, first) that are one word from an earlier one of them."""
    # Places in the order of the lines: a sorted table numbered as it lies.
    ranked = settle(close.orderBy("first").withColumn("rk", F.monotonically_increasing_id()))
    places = settle(ranked.groupBy("first.doc_id", "first.th").agg(F.collect_list(F.struct("first.pos", "rk")).alias("places")))
    hashed = settle(places.select(F.xxhash64("doc_id", "th").alias("id")))
    texts = among(docs, F.xxhash64("doc_id", "th"), hashed).withColumnsRenamed({"doc_id": "d", "th": "t"})
    found = texts.join(places, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th"))).select(_lines("text").alias("lines"), F.explode("places").alias("p"))
    lines = settle(found.select("p.rk", _words(F.element_at("lines", F.col("p.pos") + 1)).alias("words")).dropDuplicates(["rk"]))

    around = settle(_neighbourhood(lines))
    # Without the word at the same place: one word replaced. The earliest of a group stands for all later ones.
    same = settle(around.groupBy("code", "at").agg(F.min("rk").alias("by"), F.count("*").alias("n")).where("n > 1").select("code", "at", "by"))
    swapped = among(around.select("rk", "code", "at"), F.col("code"), same.select("code")).join(same, ["code", "at"]).where("rk <> by").select("rk", "by")
    # All words of one line are a variant of another: one word added or left out.
    whole = settle(around.where("at = 0").select(F.col("all").alias("code"), F.col("rk").alias("rw")))
    cut = settle(among(around.select("rk", "code"), F.col("code"), whole.select("code")).join(whole, "code").select("rk", "rw"))
    longer = cut.where("rk > rw").select("rk", F.col("rw").alias("by"))
    shorter = cut.groupBy("rw").agg(F.min("rk").alias("by")).where("rw > by").select(F.col("rw").alias("rk"), "by")
    pairs = swapped.unionAll(longer).unionAll(shorter).distinct()
    theirs = lines.select(F.col("rk").alias("by"), F.col("words").alias("words_by"))
    checked = pairs.join(lines, "rk").join(theirs, "by").where(_one_apart("words", "words_by"))
    return settle(ranked.join(checked.select("rk").distinct(), "rk").select("h1", "h2"))


def repeated_lines(docs: DataFrame, min_words: int = 3, near_words: int = 8) -> DataFrame:
    """(doc_id, th, pos, n_words) of the lines of ``docs`` (doc_id, th, text) that are dropped.

    Lines are ordered by (doc_id, th, pos); a null doc_id comes first. A line is dropped if an earlier line
    anywhere has the same words (lower-cased, ``min_words`` at least), or, from ``near_words`` words on, is within
    an edit distance of one word. Shorter and blank lines stay. The earlier line counts even if it is dropped
    itself. Texts are split where they are read; of the lines only hashes are shuffled, and of those that repeat no
    hash and share no half nothing more than these.
    """
    lines = docs.select("doc_id", "th", F.posexplode(_lines("text")).alias("pos", "line")).withColumn("words", _words(F.col("line")))
    lines = lines.select(
        "doc_id",
        "th",
        "pos",
        F.size("words").alias("n_words"),
        F.xxhash64("words").alias("h1"),
        F.xxhash64(F.lit(0), "words").alias("h2"),
        F.when(F.size("words") >= near_words, _halves()).alias("halves"),
    )
    lines = settle(lines)
    long = lines.where(F.col("n_words") >= min_words)

    keys = lines.where("halves is not null").select("h1", "h2", F.explode("halves").alias("half"))
    shared = settle(keys.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half"))
    close = settle(among(keys, F.col("half"), shared).join(shared, "half", "left_semi").select("h1", "h2").distinct())
    twice = long.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1")
    some = settle(among(long.drop("halves"), F.col("h1"), settle(twice.unionAll(close.select("h1")))))
    firsts = settle(some.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count("*").alias("n")))

    near = _near(docs, firsts.join(close, ["h1", "h2"]).select("h1", "h2", "first"))
    told = firsts.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("n > 1 or near")
    gone = join_in_parts(some, told.drop("n"), ["h1", "h2"], ["doc_id", "th", "pos"], firsts, some.count())
    gone = gone.where(F.coalesce("near", F.lit(False)) | ~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    return gone.select("doc_id", "th", "pos", "n_words")


def dedup_lines(docs: DataFrame, min_words: int = 3, near_words: int = 8) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, any other columns) with its text less the repeated lines,
    and n_lines, n_dropped, n_words, n_words_dropped. See ``repeated_lines`` for what is dropped.

    The kept lines keep their order and bytes. A null text stays null, with 0 lines; an empty one stays empty,
    with one line; a text all of whose lines go becomes empty. Rows of one doc_id and text are one document and
    get one result; other rows that repeat a doc_id are documents of their own, and so are those with a null
    doc_id, which come first. Very long texts are split like any other. Columns named like the results are replaced.
    """
    counts = ("n_lines", "n_dropped", "n_words", "n_words_dropped")
    names = [c for c in docs.columns if c not in counts]
    rows = docs.select(*names).withColumn("text", F.col("text").cast("string")).withColumn("th", F.xxhash64("text"))
    gone = repeated_lines(rows.select("doc_id", "th", "text"), min_words, near_words)
    # Equal rows bring their lines several times.
    told = gone.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "n_words")).alias("gone"))
    told = settle(told.select(F.col("doc_id").alias("told_id"), F.col("th").alias("told_th"), "gone"))
    ids, key = settle(told.select(F.xxhash64("told_id", "told_th"))), F.xxhash64("doc_id", "th")
    # Only texts that may lose a line are shuffled.
    changed = among(rows, key, ids).join(told, F.col("doc_id").eqNullSafe(F.col("told_id")) & (F.col("th") == F.col("told_th")), "left").drop("told_id", "told_th")
    both = changed.unionByName(among(rows, key, ids, False).withColumn("gone", F.lit(None).cast(told.schema["gone"].dataType)))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.transform("gone", lambda g: g["pos"]), i))
    words = F.array_remove(F.split(F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" ")), " "), "")
    told_of = {
        "n_lines": F.size(F.split("text", "\n")),
        "n_dropped": F.size("gone"),
        "n_words": F.size(words),
        "n_words_dropped": F.aggregate("gone", F.lit(0), lambda n, x: n + x["n_words"]),
    }
    text = F.when(F.col("gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    zero = F.lit(0).cast("long")
    return both.select(*[text.alias(c) if c == "text" else F.col(c) for c in names], *[F.coalesce(told_of[c].cast("long"), zero).alias(c) for c in counts])
