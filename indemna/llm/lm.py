"""Cross-entropy difference of two matched n-gram models with one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indemna.llm.common import gram_hashes, mixed, settle, word_hashes

#: Bytes of text that a task counts as one group, and the least number of buckets that n-grams are dealt to.
_GROUP = 8 << 20
_BUCKETS = 256
_START = np.uint64(1)


def _cells(text: bytes, word_bits: int, pair_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, pair, first) cells of a text: its words, A-Z lower-cased, after a mark for the start."""
    hashes = np.concatenate([np.array([_START], np.uint64), word_hashes(text.lower().split())])
    words = (hashes >> np.uint64(64 - word_bits)).astype(np.int64)
    pairs = (gram_hashes(hashes, 2) >> np.uint64(64 - pair_bits)).astype(np.int64)
    return words[1:], pairs, words[:-1]


def _per_text(text: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How often each token's id occurs in its own text."""
    _, at, n = np.unique(text * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True, return_counts=True)
    return n[at]


class Grams:
    """The n-grams of a group of texts: for every token its text, word, the word before it and both as a pair, as
    places in ``words`` and ``pairs``. These list each n-gram once, by itself or by its cell where bits are given;
    ``routes`` are hashes that only deal them to buckets. The same texts always give the same lists."""

    def __init__(self, texts: pa.Array, bits: tuple[int, int] | None = None) -> None:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
        flat, text = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
        full = pc.binary_length(flat).to_numpy() > 0
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.text = text[full].astype(np.int64)
        known = coded.dictionary.cast(pa.large_binary())
        word = coded.indices.to_numpy().astype(np.int64)
        hashes = np.append(word_hashes(known.to_pylist()), _START)
        known = pa.concat_arrays([known, pa.array([b""], pa.large_binary())])  # the mark for the start
        before = np.append(len(known) - 1, word[:-1])[: len(word)]
        before[np.append(True, self.text[1:] != self.text[:-1])[: len(word)]] = len(known) - 1
        if bits:
            shift = [np.uint64(64 - b) for b in bits]
            cells, of = np.unique(hashes >> shift[0], return_inverse=True)
            pair_hash = mixed(hashes[before] * np.uint64(0x9E3779B97F4A7C15) + hashes[word])
            pairs, self.pair = np.unique(pair_hash >> shift[1], return_inverse=True)
            self.word, self.before = of[word], of[before]
            keys = [pc.cast(pc.cast(pa.array(c), pa.large_string()), pa.large_binary()) for c in (cells, pairs)]
            self.words, self.pairs = keys
            self.routes = mixed(cells), mixed(pairs)
        else:
            pairs, self.pair = np.unique(before * len(known) + word, return_inverse=True)
            first, second = np.divmod(pairs, len(known))
            self.word, self.before, self.words = word, before, known
            self.pairs = pc.binary_join_element_wise(known.take(pa.array(first)), known.take(pa.array(second)), pa.scalar(b" ", pa.large_binary()))
            self.routes = mixed(hashes), mixed(hashes[first] * np.uint64(0x9E3779B97F4A7C15) + hashes[second])

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts by model: (background, target) of each word and of each word as a history; and of each pair."""
        own = target[self.text]
        count = lambda ids, n: [np.bincount(ids[own == m], minlength=n) for m in (False, True)]
        return np.array(count(self.word, len(self.words)) + count(self.before, len(self.words))), np.array(count(self.pair, len(self.pairs)))

    def dealt(self, kind: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words (kind 0) or pairs (1) by bucket, and where each bucket starts among them."""
        bucket = (self.routes[kind] % np.uint64(buckets)).astype(np.int64)
        return np.argsort(bucket, kind="stable"), np.searchsorted(np.sort(bucket), np.arange(buckets + 1))


def _pack(numbers: np.ndarray, raw: np.ndarray | None = None) -> bytes:
    """Whole numbers, byte by byte of all of them, and bytes, each compressed by itself."""
    planes = np.ascontiguousarray(np.ascontiguousarray(numbers).reshape(-1).view(np.uint8).reshape(-1, numbers.itemsize).T)
    parts = [planes.tobytes(), b"" if raw is None else raw.tobytes()]
    packed = [pa.Codec("zstd", 3).compress(x, asbytes=True) for x in parts]
    return np.array([len(parts[0]), len(parts[1]), len(packed[0])], np.int64).tobytes() + b"".join(packed)


def _unpack(data: bytes, kind: type) -> tuple[np.ndarray, bytes]:
    n, m, end = (int(x) for x in np.frombuffer(data, np.int64, 3))
    planes = np.frombuffer(pa.decompress(data[24 : 24 + end], n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1), pa.decompress(data[24 + end :], m, codec="zstd", asbytes=True)


def _groups(docs: DataFrame, size: int) -> DataFrame:
    """(part, texts): the rows of ``docs`` (doc_id, text, target), packed by about ``size`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes, part = [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as to:
                to.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([sink.getvalue().to_pybytes()])], names=["part", "texts"])

        for batch in batches:
            ends, at = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < len(ends):
                done = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + size - held_bytes, "right")))
                held.append(batch.slice(at, stop - at))
                held_bytes, at = held_bytes + int(ends[stop - 1] - done), stop
                if held_bytes >= size or at < len(ends):
                    yield out()
                    held, held_bytes, part = [], 0, part + 1
        if held:
            yield out()

    return docs.mapInArrow(run, "part long, texts binary")


def _column(table: pa.Table, i: int) -> pa.Array:
    return pa.concat_arrays(table.column(i).chunks) if table.column(i).num_chunks else pa.array([], table.column(i).type)


def _read(texts: bytes, marks: list[int] | None) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(doc_id, text, target) of a group; ``marks`` are the places of further targets."""
    table = pa.ipc.open_stream(texts).read_all()
    target = _column(table, 2).to_numpy(zero_copy_only=False).astype(bool)
    target[np.array(marks or [], np.int64)] = True
    return _column(table, 0), _column(table, 1), target


def _marked(groups: DataFrame, targets: DataFrame | None) -> DataFrame:
    """``groups`` with ``marks``, the places of the rows whose doc_id is among ``targets``. Only ids are joined."""
    if targets is None:
        return groups.withColumn("marks", F.lit(None).cast("array<int>"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _column(pa.ipc.open_stream(texts.as_py()).read_all(), 0)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int64()), pa.array(range(len(own)), pa.int32()), own], names=["part", "at", "doc_id"])

    good = targets.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    there = groups.mapInArrow(ids, "part long, at int, doc_id long").join(good, "doc_id")
    return groups.join(settle(there.groupBy("part").agg(F.collect_list("at").alias("marks"))), "part", "left")


def gather_counts(groups: DataFrame, buckets: int, bits: tuple[int, int] | None = None) -> DataFrame:
    """(part, kind, bucket, others, n_words, n_background, n_target): for every group of ``_groups`` and bucket, how
    often each of its n-grams occurs in the other groups, in the group's own order; and in rows without a part,
    how many distinct words a bucket holds and how many tokens each model has of them.

    Each group passes on every n-gram once, as bytes with its counts, so a frequent one has no more rows than there
    are groups. A bucket adds up equal n-grams, not equal hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                _, text, target = _read(texts.as_py(), marks)
                grams = Grams(text, bits)
                counts = grams.counts(target)
                for kind, keys in enumerate((grams.words, grams.pairs)):
                    order, starts = grams.dealt(kind, buckets)
                    taken = keys.take(pa.array(order))
                    sizes = pc.binary_length(taken).to_numpy().astype(np.int32)
                    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
                    raw = np.frombuffer(taken.buffers()[2] or b"", np.uint8)
                    own = counts[kind][:, order].astype(np.int32)
                    used = np.flatnonzero(starts[1:] > starts[:-1])
                    data = [_pack(np.vstack([sizes[a:b], own[:, a:b]]), raw[ends[a] : ends[b]]) for a, b in zip(starts[used], starts[used + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([kind] * len(used), pa.int32()), pa.array([part] * len(used), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "kind", "part", "data"])

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, parts, keys, own = key[1].as_py(), [], [], []
        for batch in rows:
            for part, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                numbers, raw = _unpack(data, np.int32)
                numbers = numbers.reshape(3 if kind else 5, -1)
                ends = np.append(0, np.cumsum(numbers[0], dtype=np.int64))
                own.append(numbers[1:])
                keys.append(pa.Array.from_buffers(pa.large_binary(), len(numbers[0]), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)]))
                parts.append(part)
        coded = pa.concat_arrays(keys).dictionary_encode()
        at, mine = coded.indices.to_numpy(), np.concatenate(own, axis=1)
        total = np.array([np.bincount(at, c, len(coded.dictionary)) for c in mine]).astype(np.int64)
        others = total[:, at] - mine
        ends = np.append(0, np.cumsum([len(x) for x in keys]))
        data = [_pack(others[:, a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        n_words = 0 if kind else int((total[0] + total[1] > 0).sum())
        tokens = [0, 0] if kind else [int(total[0].sum()), int(total[1].sum())]
        n, bucket = len(parts), key[0].as_py()
        columns = [pa.array([*parts, None], pa.int64()), pa.array([kind] * (n + 1), pa.int32()), pa.array([bucket] * (n + 1), pa.int32()), pa.array([*data, None], pa.binary())]
        columns += [pa.array([None] * n + [x], pa.int64()) for x in (n_words, *tokens)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "kind", "bucket", "others", "n_words", "n_background", "n_target"])

    rows = groups.mapInArrow(count, "bucket int, kind int, part long, data binary")
    return rows.groupBy("bucket", "kind").applyInArrow(add, "part long, kind int, bucket int, others binary, n_words long, n_background long, n_target long")


def cross_entropy_difference(docs: DataFrame, word_bits: int | None = None, pair_bits: int | None = None, weight: float = 0.7, add: float = 0.5, group_bytes: int = _GROUP, targets: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) of every row of ``docs`` (doc_id, text, target).

    Both models are interpolated bigram models: ``weight`` times the share of a word after the one before
    it, plus the rest times the word's smoothed share. Their vocabulary is one, all words of ``docs``, so no word
    is unknown to one model only. Words and pairs are counted as they are, in a table that grows with the corpus
    and is dealt to buckets; only with ``word_bits`` and ``pair_bits`` do they share so many cells by hash. The
    target model is counted over all texts with ``target``, the background model over all others; every token of
    every text counts. ``targets`` (doc_id) may name the targets instead, where ``docs`` has no such column.

    A document is scored as if it hadn't been counted: its own counts are taken off the model that has them.
    Losses are nats a token; score = loss_target - loss_background, lower where a text is more like the
    target. A null text or one without words has 0 tokens and null losses. Without any target text the
    target model is uniform. Rows with a null target count as background; repeated rows count as often.
    """
    bits = (word_bits, pair_bits) if word_bits and pair_bits else None
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.coalesce("target", F.lit(False)) if targets is None else F.lit(False)).alias("target"))
    groups = settle(_groups(docs, group_bytes))
    buckets = max(_BUCKETS, groups.count())
    groups = _marked(groups, targets)
    rows = settle(gather_counts(groups, buckets, bits))
    size, *tokens = rows.where("part is null").agg(F.sum("n_words"), F.sum("n_background"), F.sum("n_target")).first()
    size, tokens = 1 << word_bits if bits else size or 0, [n or 0 for n in tokens]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for texts, marks in zip(left.column("texts").to_pylist(), left.column("marks").to_pylist(), strict=True):
            ids, text, target = _read(texts, marks)
            grams = Grams(text, bits)
            counts = grams.counts(target)
            for kind in (0, 1):
                order, starts = grams.dealt(kind, buckets)
                of = right.filter(pc.equal(right.column("kind"), kind))
                for bucket, others in zip(of.column("bucket").to_pylist(), of.column("others").to_pylist(), strict=True):
                    at = order[starts[bucket] : starts[bucket + 1]]
                    counts[kind][:, at] += _unpack(others, np.int64)[0].reshape(-1, len(at))
            n = np.bincount(grams.text, minlength=len(target))
            less = [_per_text(grams.text, ids) for ids in (grams.word, grams.before, grams.pair)]
            losses = []
            for m in (1, 0):
                own = (target == bool(m))[grams.text].astype(np.int64)
                word, seen, pair = (c - own * x for c, x in zip((counts[0][m][grams.word], counts[0][2 + m][grams.before], counts[1][m][grams.pair]), less, strict=True))
                # A cell of pairs may hold other pairs too: no more than all that follows the first word.
                after = np.minimum(pair, seen) / np.maximum(seen, 1)
                smooth = (word + add) / (tokens[m] - own * n[grams.text] + add * size)
                loss = -np.log(np.where(seen > 0, weight * after + (1 - weight) * smooth, smooth))
                losses.append(np.bincount(grams.text, loss, len(target)) / np.maximum(n, 1))
            arrays = [pa.array(x, pa.float64(), mask=n == 0) for x in (*losses, losses[0] - losses[1])]
            out.append(pa.Table.from_arrays([ids, pa.array(n, pa.int64()), *arrays], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"]))
        return pa.concat_tables(out)

    replies = rows.where("part is not null").select("part", "kind", "bucket", "others")
    return groups.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(run, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
