"""What the operators of this subpackage share: settled tables and hashing of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the rolling combination of word hashes (2**64 / golden ratio).
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


#: Bits of the filters of ids: 16 for each id, 2**27 (16 MB in one broadcast row) at most.
_LEAST_BITS, _MOST_BITS = 16, 27
#: A key that more than a thousandth of all rows have is joined in parts; there are fewer than _SHARE of these.
_SHARE, _PARTS = 1000, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later stages neither recompute it
    nor depend on the executors that made it."""
    path = f"{shared_folder(df.sparkSession)}/indemna-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def among(rows: DataFrame, value: Column, ids: DataFrame, there: bool = True) -> DataFrame:
    """The rows whose ``value`` (a long hash) may be among ``ids`` (one settled long column of hashes); those that surely
    aren't if not ``there``. Some rows more may be among them, the more the fuller the filter, so whatever follows has
    to be exact by itself; it then shuffles only what has passed."""
    bits = min(_MOST_BITS, max(_LEAST_BITS, (16 * ids.count()).bit_length()))
    slots = ids.select(F.shiftrightunsigned(F.col(ids.columns[0]), 64 - bits).alias("slot"))
    packed = slots.selectExpr("slot div 64 as at", "shiftleft(1L, cast(slot % 64 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = ids.sparkSession.range(2**bits // 64).withColumnRenamed("id", "at").join(packed, "at", "left")
    filled = every.agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("f"))
    filled = filled.select(F.transform("f", lambda x: x["bits"]).alias("indemna_filter"))
    rows = rows.withColumn("indemna_slot", F.shiftrightunsigned(value, 64 - bits)).crossJoin(F.broadcast(filled))
    bit = F.expr("shiftright(element_at(indemna_filter, cast(indemna_slot div 64 as int) + 1), cast(indemna_slot % 64 as int))")
    return rows.where(bit.bitwiseAND(F.lit(1).cast("long")) == int(there)).drop("indemna_slot", "indemna_filter")


def join_in_parts(rows: DataFrame, told: DataFrame, on: list[str], spread: list[str], counts: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``told``, which has each key once. ``counts`` (on, n) tells how many of the ``n`` rows have a
    key; the rows of very frequent keys are dealt to parts by their ``spread`` columns, and ``told`` is copied to each.
    Fewer than 1,000 keys can be that frequent, so these are broadcast."""
    common = F.broadcast(counts.where(F.col("n") > F.lit(max(1, n // _SHARE))).select(*on, F.lit(_PARTS).alias("parts")))
    dealt = rows.join(common, on, "left").withColumn("part", F.pmod(F.xxhash64(*spread), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copied = told.join(common, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copied, [*on, "part"], how).drop("part")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that what is made of texts at once, and sent back, stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (one xor-shift-multiply round)."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words, from the hashes of the words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc *= _ROLL
        acc += hashes[j : n + j]
    return mixed(acc)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array a row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def held_out(doc_id: str, folds: int, fold: int):
    """True where crc32 of the id as text falls into ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))
