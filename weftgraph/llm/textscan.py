"""Vectorised word hashing over UTF-8 bytes, in windows of bounded size.

Words are runs of bytes outside the six blanks; UTF-8 never uses those bytes inside another character, so byte and
character views agree. A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15) | U(1)
WINDOW = 1 << 20
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random odd-free value for every byte, so that short words differ in all bits.
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    filled = 1
    with np.errstate(over="ignore"):
        while filled < n:
            step = min(filled, n - filled)
            top = out[filled - 1] * base
            out[filled : filled + step] = out[:step] * top
            filled += step
    return out


_INVERSE = U(pow(int(BASE), -1, 2**64))
POWERS = _powers(BASE, WINDOW + 1)
INVERSES = _powers(_INVERSE, WINDOW + 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(31))
        x = x * U(0x7FB5D329728EA185)
        x = x ^ (x >> U(27))
        x = x * U(0x81DADEF4BC2DD44D)
        return x ^ (x >> U(33))


def _window_words(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of at most WINDOW bytes that no word crosses the end of."""
    if lower:
        data = LOWER[data]
    solid = ~IS_BLANK[data]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, U)
        sums[0] = 0
        np.cumsum(BYTE_VALUE[data] * POWERS[: len(data)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * INVERSES[starts]
        return mix64(value ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93))), starts, ends


def _long_word(data: np.ndarray, lower: bool) -> np.uint64:
    """The hash of one word longer than a window, folded window by window."""
    h = U(len(data))
    for at in range(0, len(data), WINDOW):
        part = np.ascontiguousarray(data[at : at + WINDOW])
        if lower:
            part = LOWER[part]
        with np.errstate(over="ignore"):
            h = mix64(np.array([h * BASE + np.sum(BYTE_VALUE[part] * POWERS[: len(part)])], U))[0]
    return h


def words(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of all words of a byte array of any length."""
    if len(data) <= WINDOW:
        return _window_words(data, lower)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + WINDOW)
        if end < len(data):
            blanks = np.flatnonzero(IS_BLANK[data[at:end]])
            if not len(blanks):  # inside a word longer than a window
                far = end
                while far < len(data) and not len(gap := np.flatnonzero(IS_BLANK[data[far : far + WINDOW]])):
                    far += WINDOW
                far = min(len(data), far + (gap[0] if far < len(data) else 0))
                parts.append((np.array([_long_word(data[at:far], lower)], U), np.array([at]), np.array([far])))
                at = far
                continue
            end = at + int(blanks[-1]) + 1
        h, s, e = _window_words(data[at:end], lower)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """The hashes of the bytes of spans that rise and do not overlap, of any length; equal bytes have equal hashes."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + WINDOW, "right"))
        if j <= i:
            out[i] = _long_word(data[starts[i] : ends[i]], lower)
            i += 1
            continue
        base = int(starts[i])
        part = data[base : int(ends[j - 1])]
        if lower:
            part = LOWER[part]
        s, e = starts[i:j] - base, ends[i:j] - base
        with np.errstate(over="ignore"):
            sums = np.empty(len(part) + 1, U)
            sums[0] = 0
            np.cumsum(BYTE_VALUE[part] * POWERS[: len(part)], out=sums[1:])
            out[i:j] = mix64((sums[e] - sums[s]) * INVERSES[s] ^ ((e - s).astype(U) * U(0xD6E8FEB86659FD93)))
        i = j
    return out


def trimmed_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in the document, start, end, code points) of the lines of documents whose bytes lie between the
    offsets; start and end leave out the blanks at both ends of a line. Every document has a line at least."""
    first_byte, last_byte = int(offsets[0]), int(offsets[-1])
    part = data[first_byte:last_byte]
    offsets = offsets - first_byte
    docs = len(offsets) - 1
    breaks = np.flatnonzero(part == 10)
    per_doc = np.diff(np.searchsorted(breaks, offsets)) + 1
    first = np.cumsum(per_doc) - per_doc
    doc = np.repeat(np.arange(docs), per_doc)
    place = np.arange(len(doc)) - first[doc]
    starts, ends = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    inner = np.ones(len(doc), bool)
    inner[first] = False
    starts[first], starts[inner] = offsets[:-1], breaks + 1
    inner[:] = True
    inner[first + per_doc - 1] = False
    ends[first + per_doc - 1], ends[inner] = offsets[1:], breaks
    solid = np.flatnonzero(~IS_BLANK[part])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    ends = np.where(some, solid[np.maximum(b, 1) - 1] + 1 if len(solid) else 0, starts)
    starts = np.where(some, solid[np.minimum(a, max(len(solid) - 1, 0))] if len(solid) else 0, starts)
    chars = ends - starts
    if len(part) and part.max() > 127:
        inside = np.concatenate(([0], np.cumsum((part & 0xC0) == 0x80, dtype=np.int64)))
        chars = chars - (inside[ends] - inside[starts])
    return doc, place, starts + first_byte, ends + first_byte, chars


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows in order; with fewer words the whole sequence as one; none without words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - n + 1, U(n))
        for i in range(n):
            out = mix64(out * BASE + hashes[i : len(hashes) - n + 1 + i])
    return out


def joined_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of documents whose bytes lie between the offsets, where each document's begin)."""
    docs = len(offsets) - 1
    part = data[offsets[0] : offsets[-1]]
    if docs == 1:
        hashes, _, _ = words(part, lower)
        return hashes, np.array([0, len(hashes)])
    # Words must not run across documents: a blank goes between them.
    joined = np.full(len(part) + docs, 32, np.uint8)
    joined[np.arange(len(part)) + np.repeat(np.arange(docs), np.diff(offsets))] = part
    hashes, starts, _ = words(joined, lower)
    return hashes, np.searchsorted(starts, offsets - offsets[0] + np.arange(docs + 1))


def shingles_of_each(hashes: np.ndarray, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of each document in a row, where each document's begin) from the words of several documents."""
    counts = np.diff(edges)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(int(starts[-1]), U)
    full = counts >= n
    if full.any():
        whole = shingles(hashes, n) if len(hashes) >= n else np.zeros(0, U)
        # Windows that start in a document of n words or more and end in it.
        inside = np.repeat(full, sizes)
        at = np.arange(len(out)) + np.repeat(edges[:-1] - starts[:-1], sizes)
        out[inside] = whole[at[inside]]
    for i in np.flatnonzero((counts > 0) & ~full).tolist():
        out[starts[i]] = shingles(hashes[edges[i] : edges[i + 1]], n)[0]
    return out, starts


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets) of an Arrow string or binary array; null rows are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets
