"""Benchmark decontamination by winnowing: fingerprints of every window, an equi join, extended hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from indemna.llm.common import gram_hashes, pieces, settle, utf8, word_hashes

#: A-Z to a-z, all other ASCII but digits and letters to a space; bytes of other letters stay.
_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))

#: Bits of the filter of benchmark fingerprints, 2**22: 512 KB whatever the size of the benchmark.
_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the least of some window of ``window`` consecutive hashes (all ties)."""
    if len(grams) < window:
        return np.empty(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(grams, window).min(axis=1)
    top = np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)])
    return np.flatnonzero(np.lib.stride_tricks.sliding_window_view(top, window).max(axis=1) == grams)


def _prints(words: list[bytes], k: int, span: int, short: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes, positions, length) of the fingerprints: winnowed k-grams, and all grams of the lengths in ``short``."""
    hashes = word_hashes(words)
    grams = gram_hashes(hashes, k)
    at = winnowed(grams, span - k + 1)
    found = [(grams[at], at, 0)]
    for m in short:
        grams = gram_hashes(hashes, m) + np.uint64(m)
        found.append((grams, np.arange(len(grams)), m))
    return found


def _item_prints(items: DataFrame, k: int, span: int) -> DataFrame:
    """(item_id, print, m, before, body, after): m is 0 for a winnowed print and the number of words of a short item;
    before and after are the words that a window round the print can hold."""
    reach = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = words_of(text)
                if 0 < len(words) < span:
                    (grams, _, m), *_ = _prints(words, k, span, (len(words),))[1:]
                    rows.append((i, int(grams.view(np.int64)[0]), m, [], [w.decode("utf-8", "replace") for w in words], []))
                elif words:
                    grams, at, _ = _prints(words, k, span, ())[0]
                    for h, p in zip(grams.view(np.int64).tolist(), at.tolist(), strict=True):
                        cut = lambda x: [w.decode("utf-8", "replace") for w in x]
                        rows.append((i, h, 0, cut(words[max(0, p - reach) : p]), cut(words[p : p + k]), cut(words[p + k : p + k + reach])))
            names = ["item_id", "print", "m", "before", "body", "after"]
            text = pa.list_(pa.string())
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), text, text, text]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string")).mapInArrow(run, f"item_id {kind}, print long, m int, before array<string>, body array<string>, after array<string>")


def _filter_bits(prints: DataFrame) -> np.ndarray:
    """The 2**22 bits that tell which fingerprints the benchmark may hold: at most 65,536 longs reach the driver."""
    slots = prints.select(F.shiftrightunsigned("print", 64 - _BITS).alias("slot"))
    packed = slots.selectExpr("cast(slot div 64 as int) as at", "shiftleft(1L, cast(slot % 64 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(2**_BITS // 64, np.int64)
    bits[packed["at"].to_numpy(np.int64)] = packed["bits"].to_numpy(np.int64)
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def _doc_prints(docs: DataFrame, k: int, span: int, short: tuple[int, ...], bits: np.ndarray) -> DataFrame:
    """(row, doc_id, th, n_words, hits): the fingerprints that the benchmark may hold, with the words round them."""
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    reach = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(known.value).astype(bool)
        for batch in pieces(batches):
            n_words, counts = [], []
            hits: list[tuple] = []
            for text in utf8(batch.column(1)):
                words, before = words_of(text), len(hits)
                n_words.append(len(words))
                for grams, at, m in _prints(words, k, span, short) if words else ():
                    likely = there[grams >> np.uint64(64 - _BITS)]
                    for h, p in zip(grams[likely].view(np.int64).tolist(), at[likely].tolist(), strict=True):
                        back, on = (0, m) if m else (reach, k)
                        cut = lambda x: [w.decode("utf-8", "replace") for w in x]
                        ahead = 0 if m else reach
                        hits.append((h, m, p, cut(words[max(0, p - back) : p]), cut(words[p : p + on]), cut(words[p + on : p + on + ahead])))
                counts.append(len(hits) - before)
            text = pa.list_(pa.string())
            kinds = {"print": pa.int64(), "m": pa.int32(), "pos": pa.int32(), "before": text, "body": text, "after": text}
            inner = pa.StructArray.from_arrays([pa.array([x[j] for x in hits], t) for j, t in enumerate(kinds.values())], names=list(kinds))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(offsets, inner)], names=["doc_id", "th", "n_words", "hits"])

    hit = "struct<print:bigint,m:int,pos:int,before:array<string>,body:array<string>,after:array<string>>"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th")).mapInArrow(run, f"doc_id long, th long, n_words long, hits array<{hit}>")
    return settle(found.withColumn("row", F.monotonically_increasing_id()))


def _shared(x: Column, y: Column) -> Column:
    """How many words two arrays share from their start."""
    differs = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(x)).cast("int")


def winnow_hits(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as (row, doc_id, th, n_words), th a hash of the text, and the hits as (row, item_id, start, stop), in words.

    A window is ``span`` consecutive words of an item; an item of fewer words, but not none, is one
    window. Of every ``span - k + 1`` consecutive k-grams the least hash is kept on both sides, so each
    window of an item that occurs in a document gives an equal fingerprint at the same place of both;
    short items give the hash of their whole sequence. Fingerprints are joined by value, the words
    round them are compared, and each hit is the longest equal stretch that is as long as a window.
    """
    items = items.where("item_id is not null").select("item_id", "text").distinct()
    prints = settle(_item_prints(items, k, span))
    short = tuple(sorted(r["m"] for r in prints.where("m > 0").select("m").distinct().collect()))  # at most span - 1 lengths
    found = _doc_prints(docs, k, span, short, _filter_bits(prints))

    # Items that share a print and its words are compared once, then taken apart again.
    context = ["print", "m", "before", "body", "after"]
    kinds = prints.select(*context).distinct().withColumn("kind", F.xxhash64(*context))
    theirs = kinds.select("print", "m", "kind", F.col("before").alias("ib"), F.col("body").alias("io"), F.col("after").alias("ia"))
    mine = found.where("size(hits) > 0").select("row", F.explode("hits").alias("h")).select("row", "h.*")
    met = mine.join(theirs, ["print", "m"]).where("body = io")
    met = met.select("row", "kind", "pos", "m", F.size("body").alias("n"), _shared(F.reverse("before"), F.reverse("ib")).alias("l"), _shared(F.col("after"), F.col("ia")).alias("r"))
    met = met.where((F.col("m") > 0) | (F.col("l") + F.col("n") + F.col("r") >= span))
    met = settle(met.select("row", "kind", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("n") + F.col("r")).alias("stop")))
    members = prints.select("item_id", F.xxhash64(*context).alias("kind")).distinct()
    return found.select("row", "doc_id", "th", "n_words"), met.join(members, "kind").select("row", "item_id", "start", "stop")


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash) of every row of ``docs``.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. n_hit
    counts the words inside any occurrence of a window of an item (see ``winnow_hits``), n_items the
    items that occur, items_sha256 is the digest of their ids as sorted strings joined by commas; text_hash is
    xxhash64 of the text, to find the row of a repeated id.
    A null text or one without words has no hit; items without an id or words match nothing; repeated
    rows, and rows with a repeated or null id, are counted one by one; very long texts are read whole; bytes that are
    no UTF-8 are letters; other columns are ignored; an empty benchmark leaves every document clean.
    """
    found, hits = winnow_hits(docs, items, span, k)
    spans = hits.select("row", "start", "stop").distinct()
    order = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(order), F.lit(0))))
    n_hit = spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    names = hits.select("row", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("names"))
    told = n_hit.join(names, "row").select("row", "n_hit", F.size("names").cast("long").alias("n_items"), F.concat_ws(",", "names").alias("ids"))
    return (
        found.join(told, "row", "left")
        .select("doc_id", "n_words", "th", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.col("th").alias("text_hash"))
    )
