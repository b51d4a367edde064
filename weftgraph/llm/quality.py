"""Quality rules, with repetition measured on suffix arrays.

The words of many documents at a time form one sequence; suffixes are sorted by prefix doubling, each round only inside
groups that are still tied, and never across documents. The ranks kept from each round give the longest common prefix of
neighbouring suffixes. The larger of a suffix's two values is the length of its longest repeated prefix: these are the
maximal repeated substrings of the LCP intervals, and the union of their spans is what repeats cover. Documents whose
repeats of min_repeat words or more cover too large a part, or hold too long a repeat, are rejected, besides those that the
base rules reject. Overlapping occurrences count, so a phrase said over and over is one long repeat.

Null and empty texts have no words and are rejected by the base rules. Very long texts are scanned whole; memory is about
150 bytes for each word of the longest text of a task. Repeated rows get equal results. An empty table gives an empty
result. Other columns pass through; a column named quality is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, small_batches
from .textscan import IS_BLANK, column_bytes, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
BATCH_BYTES = 4 << 20
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.3, 200


def suffix_repeats(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of its suffix's longest prefix that the same document holds elsewhere (0 if under 2).

    tokens: any integers; ends: for each position, where its document ends.
    """
    n = len(tokens)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order = np.lexsort((tokens, ends))
    new = np.empty(n, bool)
    new[0] = True
    np.logical_or(tokens[order[1:]] != tokens[order[:-1]], ends[order[1:]] != ends[order[:-1]], out=new[1:])
    heads = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = heads[np.cumsum(new) - 1]
    levels = [rank.copy()]
    sizes = np.diff(np.append(heads, n))
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = 1
    while len(slots):
        tied = order[slots]
        ahead = tied + h
        inside = ahead < ends[tied]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        order[slots] = tied
        first = np.empty(len(key), bool)
        first[0] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        at = np.flatnonzero(first)
        rank[tied] = slots[at[np.cumsum(first) - 1]]
        levels.append(rank.copy())
        sizes = np.diff(np.append(at, len(key)))
        slots = slots[np.repeat(sizes > 1, sizes)]
        h *= 2
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(levels[min(1, len(levels) - 1)][a] == levels[min(1, len(levels) - 1)][b])
    a, b = a[near], b[near]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = (x < ends[a]) & (y < ends[b])
        same = ok.copy()
        same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        lcp[same] += 1 << k
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the spans [start, start + length) cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, min_repeat: int) -> list[np.ndarray]:
    """FIELDS for each of the documents whose bytes lie between the offsets."""
    docs = len(offsets) - 1
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    hashes, counts = [], np.zeros(docs, np.int64)
    # Words must not run across documents: a blank goes between them.
    joined = np.full(len(data) + docs, 32, np.uint8)
    shift = np.repeat(np.arange(docs), np.diff(offsets))
    joined[np.arange(len(data)) + shift] = data
    bounds = offsets + np.arange(docs + 1)
    hashes, starts, _ = words(joined)
    edges = np.searchsorted(starts, bounds)
    counts = np.diff(edges)
    per_doc = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[bounds])
    word_chars = per_doc(~IS_BLANK[joined] & ((joined & 0xC0) != 0x80))
    n_symbols = per_doc(SYMBOLS[joined])
    dup_lines = np.zeros(docs, np.int64)
    blanks = BLANKS.encode()
    for i in range(docs):
        lines = [x for x in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x.strip(blanks)]
        dup_lines[i] = len(lines) - len(set(lines))
    ends = np.repeat(edges[1:], counts)
    longest = suffix_repeats(hashes, ends)
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[edges])
    three = np.flatnonzero(longest >= 3)
    repeat_words = sums(_covered(three, np.full(len(three), 3), len(hashes)))
    long = np.flatnonzero(longest >= min_repeat)
    covered = sums(_covered(long, longest[long], len(hashes)))
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, np.repeat(np.arange(docs), counts), longest)
    return [counts, word_chars, n_symbols, dup_lines, repeat_words, covered, most]


def measures(min_repeat: int = MIN_REPEAT):
    """An Arrow UDF from text to a struct of FIELDS."""

    @F.arrow_udf("struct<" + ",".join(f"{f}:long" for f in FIELDS) + ">")
    def measured(texts: pa.Array) -> pa.Array:
        data, offsets = column_bytes(texts)
        parts, at = [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
            parts.append(measure(data, offsets[at : end + 1], min_repeat))
            at = end
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], list(FIELDS))

    return measured


def with_quality(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """docs with a struct quality of FIELDS and the booleans base_failed and kept."""
    docs = small_batches(docs).drop("quality").withColumn("quality", measures(min_repeat)("text"))
    q = F.col("quality")
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    repeats = (q["covered_words"] > max_covered * q["n_words"]) | (q["longest_repeat"] > max_longest)
    return docs.withColumn("quality", q.withField("base_failed", failed).withField("kept", ~failed & ~repeats))
