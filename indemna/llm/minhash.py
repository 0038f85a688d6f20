"""Near-duplicate documents: universal hash minima, banding, signature check, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indemna.llm.common import among, gram_hashes, join_in_parts, lists, mixed, pieces, settle, utf8, word_hashes
from indemna.llm.components import connected_components

#: Rows of a block of shingles whose minima are taken at once; bounds the memory of a long text.
_BLOCK = 512
#: Pairs with one pivot that are compared in one group; a pivot of more pairs has its text copied to each group.
_PAIRS = 256


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles of a text, A-Z lower-cased, words between
    ASCII white space; the whole sequence as one shingle if it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(k, len(words))))


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of every universal hash a*x+b (mod 2**32) over the items."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _BLOCK):
        h = x[i : i + _BLOCK, None] * a
        h += b
        np.minimum(low, h.min(axis=0), out=low)
    return low


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, th, n_shingles, h1, h2, signature, bands) of every row, th a hash of the text; no band if it has no word."""
    a, b = _coefficients(bands * rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = {"n": [], "h1": [], "h2": [], "sig": [], "bands": []}
            for text in utf8(batch.column(1)):
                s = shingles(text, shingle)
                out["n"].append(len(s))
                out["h1"].append(np.bitwise_xor.reduce(mixed(s)) if len(s) else np.uint64(0))
                out["h2"].append(s.sum(dtype=np.uint64))
                low = minima(s, a, b)
                out["sig"].append(low.view(np.int32))
                keys = low.reshape(bands, rows).astype(np.uint64)
                acc = np.arange(bands, dtype=np.uint64)
                for j in range(rows):
                    acc = mixed(acc * np.uint64(0x100000001B3) + keys[:, j])
                out["bands"].append(acc.view(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(out["n"], pa.int64()),
                    pa.array(np.array(out["h1"], np.uint64).view(np.int64)),
                    pa.array(np.array(out["h2"], np.uint64).view(np.int64)),
                    lists(out["sig"], pa.int32()),
                    lists(out["bands"], pa.int64()),
                ],
                names=["doc_id", "th", "n_shingles", "h1", "h2", "signature", "bands"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, th long, n_shingles long, h1 long, h2 long, signature array<int>, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def _agreement(a: str, b: str) -> Column:
    """The share of equal minima of two signatures."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.size(a)


def _grouped(pairs: DataFrame) -> DataFrame:
    """(u, v, part): distinct pairs, those with one ``u`` dealt to groups of about ``_PAIRS``."""
    pairs = settle(pairs.distinct())
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / _PAIRS).cast("int").alias("parts")).where("parts > 1")
    return pairs.join(many, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))


def _agreeing(pairs: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v, part) whose signatures agree in at least the share ``least`` of their minima."""
    left = pairs.select("u", "part").distinct().join(members.select(F.col("id").alias("u"), F.col("signature").alias("su")), "u")
    right = members.select(F.col("id").alias("v"), F.col("signature").alias("sv"))
    return pairs.join(right, "v").join(left, ["u", "part"]).where(_agreement("su", "sv") >= least).select("u", "v", "part")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v, part) with den * intersection >= num * union of their whole shingle sets, as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, of = None, None
        for batch in pieces(batches):
            same = []
            for u, x, y in zip(batch.column(0).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                if u != seen:
                    seen, of = u, shingles(x, shingle)
                other = shingles(y, shingle)
                both = len(np.intersect1d(of, other, assume_unique=True))
                same.append(den * both >= num * (len(of) + len(other) - both))
            yield batch.filter(pa.array(same, pa.bool_())).select([0, 1])

    right = texts.select(F.col("id").alias("v"), F.col("text").alias("tv"))
    left = pairs.select("u", "part").distinct().join(texts.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u")
    return pairs.join(right, "v").join(left, ["u", "part"]).select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def _still_apart(met: DataFrame, components: DataFrame) -> DataFrame:
    """The entries of the buckets whose members are in several components, with their component c."""
    placed = met.drop("u").join(components.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.withColumn("c", F.coalesce("component", "id")).drop("component")
    several = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return settle(placed.join(several, "key", "left_semi"))


def _close_pairs(rest: DataFrame, bands: DataFrame, texts: DataFrame, shingle: int, similarity: float, seed: int, block: int = 1024) -> DataFrame:
    """(u, v): pairs of a bucket that are in different components and whose longer signatures (512 minima) agree within
    four standard deviations. Buckets are compared in pairs of blocks of about ``block`` members, as matrices; a pair
    that shares several buckets is given by the first."""
    n = 512
    a, b = _coefficients(n, seed + 1)
    spread = (similarity * (1 - similarity)) ** 0.5

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = [minima(shingles(text, shingle), a, b).tobytes() for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "minima"])

    ids = rest.select("id").distinct()
    signed = settle(texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(sign, "id long, minima binary").join(bands, "id"))
    sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rest.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "c").join(signed, "id")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        bucket, lo, hi = (k.as_py() for k in key)
        own, ids, c = (table.column(x).to_numpy() for x in ("own", "id", "c"))
        low = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint32).reshape(-1, n)
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        found: list[np.ndarray] = []
        for i in range(0, len(left), 64):
            x = left[i : i + 64]
            near = (low[x, None, :128] == low[None, right, :128]).mean(axis=2) >= similarity - 4 * spread / 128**0.5
            near &= (c[x][:, None] != c[right][None, :]) & ((ids[x][:, None] < ids[right][None, :]) if lo == hi else True)
            p, q = np.nonzero(near)
            p, q = x[p], right[q]
            for j in range(0, len(p), 4096):
                u, v = p[j : j + 4096], q[j : j + 4096]
                same = keys[u] == keys[v]
                first = keys[u, same.argmax(axis=1)] == bucket
                good = first & ((low[u] == low[v]).mean(axis=1) >= similarity - 4 * spread / n**0.5)
                found.append(np.sort(np.stack([ids[u[good]], ids[v[good]]], axis=1), axis=1))
        out = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return pa.table({"u": out[:, 0], "v": out[:, 1]})

    return rows.groupBy("key", "lo", "hi").applyInArrow(compare, "u long, v long")


def near_duplicate_rows(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, bands: int = 24, rows: int = 5, seed: int = 17, slack: float = 0.13) -> DataFrame:
    """(row, doc_id, th, n_shingles, component) of every row of ``docs`` (doc_id, text), each a document of its own
    whatever its id: th is a hash of its text, row a number of its own, and component the least row that links reach.

    See ``minhash_components`` for what is linked and how. A row without words is alone in its component.
    """
    sigs = settle(signatures(docs, shingle, bands, rows, seed).withColumn("row", F.monotonically_increasing_id()))
    usable = sigs.where("n_shingles > 0")
    same = ["h1", "h2", "n_shingles"]
    classes = settle(usable.groupBy(*same).agg(F.min("row").alias("id"), F.count("*").alias("n")))
    # A class with one row is that row; only what may have copies is looked up.
    copied = settle(classes.where("n > 1"))
    hashes = settle(copied.select("h1"))
    first = among(usable, F.col("h1"), hashes, False).unionAll(among(usable, F.col("h1"), hashes).join(classes.select(F.col("id").alias("row")), "row", "left_semi").select(*usable.columns))
    reps = first.select(F.col("row").alias("id"), "doc_id", "th", "signature", "bands")

    turned = F.concat(F.slice("bands", 2, bands - 1), F.slice("bands", 1, 1))
    entries = reps.select("id", F.explode(F.arrays_zip(F.col("bands").alias("key"), turned.alias("then"))).alias("e")).select("id", "e.key", "e.then")
    pivots = entries.groupBy("key").agg(F.min("id").alias("u"), F.count("*").alias("n")).where("n > 1").select("key", "u")
    met = settle(entries.join(pivots, "key"))  # the buckets with several members
    ids = settle(met.select("id").distinct())
    members = settle(reps.join(ids, "id", "left_semi"))
    places = settle(members.select("id", F.col("doc_id").alias("d"), F.col("th").alias("t")))
    whole = among(_texts(docs), F.xxhash64("doc_id", "th"), settle(places.select(F.xxhash64("d", "t"))))
    texts = settle(whole.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("id", "doc_id", "th", "text").dropDuplicates(["doc_id", "th", "id"]).select("id", "text"))
    least = num / den - slack

    def linked(pairs: DataFrame) -> DataFrame:
        return settle(_confirmed(settle(_agreeing(_grouped(pairs), members, least)), texts, shingle, num, den))

    edges = linked(met.where("id > u").select("u", F.col("id").alias("v")))
    rest = _still_apart(met, connected_components(edges))
    nearer = rest.groupBy("key", "then").agg(F.min(F.struct("id", "c")).alias("p"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = edges.unionAll(linked(rest.join(nearer, ["key", "then"]).where("id > p.id and c <> p.c").select(F.col("p.id").alias("u"), F.col("id").alias("v"))))

    rest = _still_apart(met, connected_components(edges))
    pairs = _close_pairs(rest, members.select("id", "bands"), texts, shingle, num / den, seed)
    edges = edges.unionAll(settle(_confirmed(_grouped(pairs), texts, shingle, num, den)))

    parts = connected_components(edges).withColumnRenamed("node", "id")
    told = settle(classes.join(parts, "id", "left").select(*same, F.coalesce("component", "id").alias("component"), "n"))
    placed = join_in_parts(usable.select(*same, "row", "doc_id", "th"), told.drop("n"), same, ["row"], told, sigs.count())
    columns = ("row", "doc_id", "th", "n_shingles", "component")
    return placed.select(*columns).unionAll(sigs.where("n_shingles = 0").withColumn("component", F.col("row")).select(*columns))


def minhash_components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, bands: int = 24, rows: int = 5, seed: int = 17, slack: float = 0.13) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Two texts are linked if den * |A n B| >= num * |A u B| for their sets of distinct word shingles.
    Texts with equal sets are one class from the start. Of ``bands * rows`` minima per class, those
    that agree in a whole band are candidates (at a similarity of 0.8 with the default 24 x 5, all
    but 1 in 10,000 pairs); signatures that agree in less than num/den - ``slack`` of the minima are
    dropped (four standard deviations), the rest is decided on the whole sets. In a band's bucket every
    member is first compared with the smallest one only, and then with the smallest one that shares the
    next band too. Members that are still in different components afterwards are compared with each other by
    longer signatures, so no link between components is missed and a large group of copies never makes all its pairs.

    Null and empty texts have no shingle and are linked with nothing; very long ones are taken whole. Rows that repeat
    a doc_id share its component; with different texts under one id the id joins the groups of all of them. A null
    doc_id is returned with a null component and not kept, and joins no groups. Other columns are ignored.
    """
    told = settle(near_duplicate_rows(docs.where("doc_id is not null"), shingle, num, den, bands, rows, seed, slack))
    # An id met in several components bridges them.
    several = told.groupBy("doc_id").agg(F.min("component").alias("u"), F.max("component").alias("v")).where("u <> v").select("doc_id", "u")
    bridges = settle(told.join(several, "doc_id").where("component <> u").select("u", F.col("component").alias("v")).distinct())
    joined = connected_components(bridges).select(F.col("node").alias("component"), F.col("component").alias("to"))
    sizes = told.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(joined, "component", "left")
    sizes = settle(sizes.select("component", F.coalesce("to", "component").alias("to"), "least", "n"))
    least = sizes.groupBy("to").agg(F.min("least").alias("component_id"))
    named = settle(sizes.join(least, "to").select("component", "component_id", "n"))
    placed = join_in_parts(told, named.drop("n"), ["component"], ["row"], named, told.count())
    placed = placed.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    lost = signatures(docs.where("doc_id is null"), shingle, bands, rows, seed)
    return placed.unionAll(lost.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("kept")))
