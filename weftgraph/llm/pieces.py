"""SentencePiece encoding and decoding with forward states shared between words.

Blanks become the mark and start words, so no piece reaches over a word's start and words are encoded once each. The distinct
marked words of a batch are sorted, which makes their trie: words with a common prefix are neighbours. Each distinct prefix has
one forward state, computed once from the states of shorter prefixes; the trie's nodes are visited a level at a time, all of a
level at once in NumPy.

The model given is a byte-pair model: the segmentation it defines is the one that merging by score reaches, which is in
general not the one of highest total score, so the forward state of a prefix is not a best score but the one last piece with
which the prefix's segmentation can end (piecetables.py); the path is read backwards as in Viterbi decoding. Words that start
with several marks, whose pieces tie in score, and words of over LONG characters are merged directly.

Encoding adds the leading mark (no piece for an empty text), and spells characters without a piece as bytes, all as the
library does for this model; null texts count as empty. Decoding gives back every text without the mark itself, which stands
for a blank. Repeated rows get equal pieces. Texts of any length are encoded whole. Nothing is kept from batch to batch but
the compiled model. An empty table gives an empty result. Other columns pass through; the added column is replaced if it exists.
"""

from __future__ import annotations

import functools
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .piecetables import PieceTables

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
SPELL = -1
BLOCK = 1 << 20  # cells of a block of words
LONG = 1 << 12


class Pieces:
    """Encoder and decoder of a SentencePiece byte-pair model, from its serialised file."""

    def __init__(self, model: bytes):
        import sentencepiece

        # The library reads the file: pieces, scores and kinds. Encoding and decoding are done here.
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        self.is_control = [sp.is_control(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.is_byte[i] or self.is_control[i] or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if self.is_byte[i]:
                self.byte_id[int(self.piece[i][3:5], 16)] = i
        # Bytes of ASCII are characters by themselves; only others, and controls, need more than a look-up to decode.
        self.plain = [chr(int(p[3:5], 16)) if b and int(p[3:5], 16) < 128 else p for p, b in zip(self.piece, self.is_byte, strict=True)]
        self.hard = np.array([c or (b and int(p[3:5], 16) > 127) for p, b, c in zip(self.piece, self.is_byte, self.is_control, strict=True)])
        self.tables = PieceTables({self.piece[i]: -sp.get_score(i) for i in plain})
        # For the tables' pieces, their ids; SPELL for characters that are spelled as bytes.
        self.ids = np.array([self.id.get(p, SPELL) for p in self.tables.pieces] + [SPELL], np.int32)

    def learn(self, words: Iterable[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """(each word's number, the ids of all words in a row, where each word's begin) of marked words.

        Words are sorted, so that equal prefixes are neighbours, and handled in blocks of about one length.
        """
        words = sorted(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        bits = np.maximum(4, np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        bits[lengths > LONG] = 0
        bits[bisect_left(words, MARK + MARK) : bisect_left(words, MARK + chr(ord(MARK) + 1))] = 0
        order, ids, counts = [], [], []
        for b in np.unique(bits).tolist():
            some = np.flatnonzero(bits == b).tolist()
            size = max(1, BLOCK >> b)
            for at in range(0, len(some), size):
                block = [words[i] for i in some[at : at + size]]
                order += block
                parts, n = self._merged(block) if not b else self._forward(block)
                ids.append(parts)
                counts.append(n)
        starts = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))))
        return dict(zip(order, range(len(order)), strict=True)), np.concatenate([np.zeros(0, np.int32), *ids]), starts

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in a row, number of ids of each) by plain merging."""
        out = [[self.id.get(p, SPELL - ord(p[0])) for p in self.tables.merges.merge(w)] for w in words]
        return self._spelled(np.fromiter(itertools.chain.from_iterable(out), np.int64), np.array([len(x) for x in out], np.int64))

    def _forward(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by forward states: one for each distinct prefix of the block's sorted words, a trie level at a time."""
        t = self.tables
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        most = int(lengths.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(n), lengths)
        column = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        code = np.full((n, most), 0x110000, np.int32)
        code[row, column] = codes
        same = np.zeros((n, most + 1), bool)
        np.equal(code[1:], code[:-1], out=same[1:, :most])
        shared = np.argmin(same, axis=1)  # characters in common with the word before
        shared[0] = 0
        shared = np.minimum(shared, lengths)
        kind = t.classes[np.minimum(code, 0x10FFFF)]
        # Cell (w, d) is the prefix of d characters of word w; owner: the first word of the block with the same prefix.
        width = most + 1
        state, last, owner = np.zeros(n * width, np.int32), np.full(n * width, t.unknown, np.int32), np.zeros((width, n), np.int32)
        here = np.arange(n, dtype=np.int32)
        for d in range(1, width):
            new = (shared < d) & (lengths >= d)
            np.maximum.accumulate(np.where(new, here, 0), out=owner[d])
            rows = np.flatnonzero(new)
            before = owner[d - 1][rows].astype(np.int64) * width + d - 1
            at = rows * width + d
            state[at] = to = t.step(state[before].astype(np.int64) * t.width + kind[rows, d - 1])
            piece = t.ends[to]
            piece[kind[rows, d - 1] == 0] = t.unknown
            open_ = np.arange(len(rows))
            while len(open_):
                p = piece[open_]
                start = d - t.length[p]
                prior = last[owner[start, rows[open_]].astype(np.int64) * width + start]
                fits = (start == 0) | (t.follows(prior.astype(np.int64) * (t.unknown + 1) + p) > 0)
                done = open_[fits]
                last[at[done]] = p[fits]
                open_, p = open_[~fits], p[~fits]
                piece[open_] = t.shorter[p]
        # Backwards from each word's end.
        rows, end = here, lengths.copy()
        steps, found = [], []
        while len(rows):
            p = last[owner[end, rows].astype(np.int64) * width + end]
            ids = t_ids = self.ids[p].astype(np.int64)
            if (t_ids == SPELL).any():
                ids = np.where(t_ids == SPELL, SPELL - code[rows, end - 1].astype(np.int64), t_ids)
            steps.append(rows)
            found.append(ids)
            end = end - t.length[p]
            rows, end = rows[end > 0], end[end > 0]
        counts = np.bincount(np.concatenate(steps), minlength=n)
        stop = np.cumsum(counts)
        out = np.empty(int(stop[-1]), np.int64)
        for k, (r, ids) in enumerate(zip(steps, found, strict=True)):
            out[stop[r] - 1 - k] = ids
        return self._spelled(out, counts)

    def _spelled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spells the characters that stand as SPELL less their code point as bytes."""
        if not (ids < 0).any():
            return ids.astype(np.int32), counts
        own = np.unique(ids[ids < 0])
        spelling = [np.frombuffer(chr(SPELL - int(c)).encode("utf-8", "surrogatepass"), np.uint8) for c in own]
        which = np.searchsorted(own, ids)
        size = np.ones(len(ids), np.int64)
        low = ids < 0
        size[low] = np.array([len(x) for x in spelling])[which[low]]
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        out[start[~low]] = ids[~low]
        for k, x in enumerate(spelling):
            at = start[low & (which == k)]
            for i, b in enumerate(x.tolist()):
                out[at + i] = self.byte_id[b]
        edges = np.concatenate(([0], np.cumsum(counts)))
        return out, np.diff(np.concatenate(([0], np.cumsum(size)))[edges])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the piece ids of all texts in a row, the number of ids of each text)."""
        split = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        number, ids, starts = self.learn(set(itertools.chain.from_iterable(split)))
        which = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(map(len, split)))
        sizes = np.diff(starts)[which] if len(which) else which
        ends = np.cumsum(sizes)
        shift = np.repeat(starts[:-1][which] - (ends - sizes), sizes) if len(which) else which
        edges = np.cumsum([0, *map(len, split)])
        return ids[np.arange(len(shift)) + shift] if len(shift) else ids, np.diff(np.concatenate(([0], ends))[edges])

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; controls give nothing, bytes that are not UTF-8 the replacement character."""
        ids = np.asarray(ids, np.int64)
        if not self.hard[ids].any():
            return "".join(map(self.plain.__getitem__, ids.tolist())).replace(MARK, " ")[1:]
        parts: list[str] = []
        raw = bytearray()
        for i in ids.tolist():
            if self.is_byte[i]:
                raw.append(int(self.piece[i][3:5], 16))
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if not self.is_control[i]:
                parts.append(self.piece[i])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        return "".join(parts).replace(MARK, " ")[1:]


@functools.lru_cache(maxsize=2)
def pieces_of(model: bytes) -> Pieces:
    """One encoder for each Python worker and model."""
    return Pieces(model)


def _model(docs: DataFrame, model: str):
    with open(model, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _runs(batches: Iterable[pa.Array], size: int = 6 << 20) -> Iterable[list[list[str]]]:
    """Runs of batches of about size characters, as texts, so that words that recur in a run are encoded once; a batch over
    that size is a run of its own."""
    held, total = [], 0
    for batch in batches:
        held.append([t.as_py() or "" for t in batch])
        total += sum(map(len, held[-1]))
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def encode(docs: DataFrame, model: str, into: str = "pieces") -> DataFrame:
    """docs with the piece ids of text (array<int>). model: a path on the driver; its contents go to the executors."""
    shared = _model(docs, model)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for run in _runs(batches):
            ids, counts = pieces_of(shared.value).encode(list(itertools.chain.from_iterable(run)))
            ends = np.concatenate(([0], np.cumsum(counts)))
            at = 0
            for batch in run:
                some = ends[at : at + len(batch) + 1]
                at += len(batch)
                yield pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), pa.array(ids[some[0] : some[-1]]))

    return small_batches(docs).withColumn(into, encoded("text"))


def decode(docs: DataFrame, model: str, ids: str = "pieces", into: str = "decoded") -> DataFrame:
    """docs with the text of the piece ids; null ids give an empty text."""
    shared = _model(docs, model)

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        return pa.array([pieces_of(shared.value).decode(x.values.to_numpy() if x.is_valid else []) for x in lists], pa.string())

    return small_batches(docs).withColumn(into, decoded(ids))
