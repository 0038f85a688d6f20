"""Encoding and decoding with merge-type vocabularies of the sentencepiece library."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indemna.llm.common import lists, pieces, utf8

#: The mark that stands for a blank in pieces.
SPACE = "▁"
#: Words that a Python worker remembers, and their greatest length.
_WORDS, _LONG = 500_000, 32
_NEVER = np.inf
#: Texts that are worked on at once.
_TEXTS = 128

codecs.register_error("indemna-bytewise", lambda e: ("�" * (e.end - e.start), e.end))


class Merger:
    """Pieces, scores and surfaces of a model, and the ids of texts by merging.

    The symbols of a text are its characters. An agenda holds every pair of adjacent symbols whose concatenation is a
    piece, the highest score first and of equal ones the leftmost. The pair on top becomes one symbol, unless one of its
    symbols has been merged meanwhile, and offers itself to both neighbours. Symbols that are no piece are
    spelled in bytes or, without pieces for bytes, unknown; a run of these is one id.
    """

    def __init__(self, model: bytes):
        self.library = library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(library.get_piece_size())
        names = [library.id_to_piece(i) for i in ids]
        kinds = [(library.is_control(i), library.is_unknown(i), library.is_byte(i)) for i in ids]
        self.id = {names[i]: i for i in ids if not any(kinds[i])}
        self.cost = {p: -library.get_score(i) for p, i in self.id.items()}
        self.byte = {int(names[i][1:-1], 16): i for i in ids if kinds[i][2]}
        self.unknown = library.unk_id()
        surface = [b"" if c else " ⁇ ".encode() if u else bytes([int(p[1:-1], 16)]) if b else p.replace(SPACE, " ").encode() for p, (c, u, b) in zip(names, kinds, strict=True)]
        self.surface = surface
        longer = [p for p in self.id if len(p) > 1]
        # No merge reaches over a character that no longer piece has, nor into a mark from before it if no piece has one inside.
        self.alone = re.compile("[^ " + re.escape("".join(sorted(set(chain.from_iterable(longer))))) + "]")
        self.starts = not any(SPACE in p.lstrip(SPACE) for p in longer)
        #: The ids of words, 32 bits each.
        self.known: dict[str, bytes] = {}

        # The same as numbers: symbols are pieces by id, and characters that only longer pieces have behind them.
        chars = sorted(set(chain.from_iterable(self.id)))
        symbol = self.id | {c: len(ids) + i for i, c in enumerate(c for c in chars if c not in self.id)}
        self.of_char = np.full(0x110000, -1, np.int32)
        self.of_char[[ord(c) for c in chars]] = [symbol[c] for c in chars]
        pairs = sorted((symbol[p[:i]] << 32 | symbol[p[i:]], self.cost[p], self.id[p]) for p in longer for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol)
        self.pair = np.array([k for k, _, _ in pairs] or [-1], np.int64)
        self.pair_cost = np.array([c for _, c, _ in pairs] or [_NEVER])
        self.pair_id = np.array([i for _, _, i in pairs] or [-1], np.int32)

    def words(self, text: str) -> list[str]:
        """Parts of a normalised text that no merge reaches out of; blanks separate them, since it has none itself."""
        if self.starts:
            text = text.replace(SPACE, " " + SPACE)
            if f"{SPACE} {SPACE}" in text:  # runs of marks stay whole
                text = text.replace(f"{SPACE} {SPACE}", SPACE * 2).replace(f"{SPACE} {SPACE}", SPACE * 2)
        return self.alone.sub(" \\g<0> ", text).split(" ")

    def merged(self, word: str) -> list[str]:
        """The symbols that are left of a word when its agenda is done."""
        cost = self.cost
        symbols, n = list(word), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pairs = [a + b for a, b in zip(word, word[1:], strict=False)]
        agenda = [(cost[p], i, i + 1, p) for i, p in enumerate(pairs) if p in cost]
        heapify(agenda)
        while agenda:
            _, left, right, both = heappop(agenda)
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, ""
            after[left] = beyond = after[right]
            if beyond < n:
                before[beyond] = left
                if (pair := both + symbols[beyond]) in cost:
                    heappush(agenda, (cost[pair], left, beyond, pair))
            if (prior := before[left]) >= 0 and (pair := symbols[prior] + both) in cost:
                heappush(agenda, (cost[pair], prior, left, pair))
        return [s for s in symbols if s]

    def spelled(self, word: str) -> bytes:
        """The ids of a word."""
        ids: list[int] = []
        for s in self.merged(word):
            i = self.id.get(s)
            if i is not None:
                ids.append(i)
            elif self.byte:
                ids += [self.byte[b] for b in s.encode()]
            else:
                ids.append(self.unknown)
        return np.array(ids, np.int32).tobytes()

    def costs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and id of what pairs of symbols merge to; an endless cost where they are no piece together."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        there = self.pair[at] == key
        return np.where(there, self.pair_cost[at], _NEVER), self.pair_id[at]

    def spelled_together(self, words: list[str]) -> dict[str, bytes]:
        """The ids of many words of at least two characters, all of which pieces have: the agendas of all words side by side.

        A word's agenda is a row with the cost of the pair that begins at each place; the least of it, and of equal ones the first, is
        merged in all words at once, until no row has a pair left.
        """
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        row, width = np.repeat(np.arange(len(words)), n), int(n.max())
        at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        symbol = np.full((len(words), width), -1, np.int32)
        symbol[row, at] = flat
        after = np.tile(np.arange(1, width + 1), (len(words), 1))
        before = after - 2
        cost, into = np.full(symbol.shape, _NEVER), np.full(symbol.shape, -1, np.int32)
        inner = at[1:] > 0
        cost[row[:-1][inner], at[:-1][inner]], into[row[:-1][inner], at[:-1][inner]] = self.costs(flat[:-1][inner], flat[1:][inner])
        r = np.arange(len(words))
        while len(r):
            left = cost[r].argmin(1)
            more = cost[r, left] < _NEVER
            r, left = r[more], left[more]
            right = after[r, left]
            beyond, prior = after[r, right], before[r, left]
            symbol[r, left] = into[r, left]
            symbol[r, right], cost[r, right] = -1, _NEVER
            after[r, left] = beyond
            ends = beyond >= n[r]
            i, j, k = r[~ends], left[~ends], beyond[~ends]
            before[i, k] = j
            cost[r[ends], left[ends]] = _NEVER
            cost[i, j], into[i, j] = self.costs(symbol[i, j], symbol[i, k])
            i, j, k = r[prior >= 0], prior[prior >= 0], left[prior >= 0]
            cost[i, j], into[i, j] = self.costs(symbol[i, j], symbol[i, k])
        kept = symbol >= 0
        ids, ends = symbol[kept].tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        told = {w: ids[a:b] for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True)}
        # A character that is no piece itself is spelled in bytes.
        return told | {words[i]: self.spelled(words[i]) for i in np.flatnonzero((symbol >= len(self.surface)).any(1))}

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words."""
        many = [w for w in words if 1 < len(w) <= _LONG]
        told = self.spelled_together(many) if many else {}
        return told | {w: self.spelled(w) for w in words if not 1 < len(w) <= _LONG}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of normalised texts; words that are met for the first time are learned together."""
        parts = [self.words(t) for t in texts]
        known = self.known
        if len(known) > _WORDS:
            known.clear()
        new = set(chain.from_iterable(parts)).difference(known)
        known |= self.learn(new)
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in parts]
        for w in new:
            if len(w) > _LONG:
                del known[w]
        if self.byte:
            return out
        return [ids[~((ids == self.unknown) & (np.roll(ids, 1) == ids) & (np.arange(len(ids)) > 0))] for ids in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids of a text; the blank that the library puts before every text goes, bytes that are no UTF-8 become U+FFFD each."""
        ids = ids.tolist()
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "indemna-bytewise")
        first = next((self.library.id_to_piece(i) for i in ids if self.surface[i]), "")
        return text[1:] if first.startswith(SPACE) else text


_MERGERS: dict[bytes, Merger] = {}


def merger(model: bytes) -> Merger:
    """The merger of a model, made once in each Python worker."""
    if model not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[model] = Merger(model)
    return _MERGERS[model]


def encode_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids, decoded, agrees) of every row of ``docs`` (doc_id, text).

    ids: the whole text as the vocabulary of ``model_file`` has it, without begin and end, normalised as the model says.
    decoded: the text of the ids. agrees: the sentencepiece library, asked for every text of the Arrow batch, gives the
    same ids and decodes them to the same text. Other models than merging ones without symbols of their users
    don't agree. A null or empty text has no ids. Every row is encoded by itself, so repeated rows, repeated and null ids
    change nothing; other columns are ignored. The model is read on the driver (half a megabyte) and broadcast. A worker
    remembers the ids of ``_WORDS`` words; a text is held whole in one task with its ids, so memory grows with the longest.
    """
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model.value)
        for batch in pieces(batches, _TEXTS):
            texts = [t.decode("utf-8", "replace") for t in utf8(batch.column(1))]
            ids = m.encode_all(m.library.normalize(texts))
            decoded = [m.decode(i) for i in ids]
            theirs = m.library.encode_as_numpy(texts, num_threads=1)
            same = [len(a) == len(b) and bool((a == b).all()) for a, b in zip(ids, theirs, strict=True)]
            agrees = [x and a == b for x, a, b in zip(same, decoded, m.library.decode(theirs, num_threads=1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(ids, pa.int32()), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], names=["doc_id", "ids", "decoded", "agrees"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>, decoded string, agrees boolean")
