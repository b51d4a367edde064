"""Document fingerprints by winnowing.

Every run of K code points is hashed by a rolling polynomial; of every WINDOW hashes in a row the smallest is kept, the
rightmost of equals. Any passage of K + WINDOW - 1 code points that two texts share leaves the same hash in both, at the
position of the passage in each; positions are kept for that. In texts of less than twice that length the window shrinks, so
that half the text is enough, down to 1; a smaller window keeps all that a larger one keeps, so fingerprints of all lengths
compare. Texts shorter than K have one hash, of the whole text.

near_edited and near_next compare a pair of which one text is so short by shorter runs as well (fitted), so that a passage of
half the shorter text, at any length, is found; of texts of a few code points that is a comparison of single code points.

Null and empty texts have an empty fingerprint; two empty fingerprints are alike (1), an empty and another are not (0).
Equal texts have equal fingerprints. Texts of any length are hashed in segments. An empty table gives an empty result. Other
columns of the input are ignored. Rows with equal doc_id follow each other in an order that their texts fix; null ids come last.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textscan import BASE, INVERSES, POWERS, U, mix64

K, WINDOW = 25, 26
SEGMENT = 1 << 19
LOW = (1 << 24) - 1
RECORD = np.dtype([("hash", ">u8"), ("at", ">u4")])


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w values in a row, from minima over powers of two."""
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (w - span)], v[w - span :]) if w > span else v


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """40-bit hashes of all runs of k code points of a segment."""
    with np.errstate(over="ignore"):
        sums = np.empty(len(codes) + 1, U)
        sums[0] = 0
        np.cumsum((codes.astype(U) + U(0x51ED270B)) * POWERS[: len(codes)], out=sums[1:])
        return mix64((sums[k:] - sums[:-k]) * INVERSES[: len(codes) - k + 1] ^ U(k)) >> U(24)


def fitted(n: int, k: int = K, window: int | None = None) -> tuple[int, int]:
    """(k, window) that guarantee a match for a passage of half of n code points, or as given where they do."""
    window = window or WINDOW
    half = max(1, n // 2)
    if k + window - 1 <= half:
        return k, window
    k = min(k, (half + 1) // 2)
    return k, min(window, half - k + 1)


def winnow(text: str, k: int = K, window: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the fingerprint of one text, by position; without a window, WINDOW or less in a short text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    window = max(1, min(WINDOW, n // 2 - k + 1)) if window is None else window
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    if n < k:
        with np.errstate(over="ignore"):
            h = U(n)
            for c in codes:
                h = mix64(np.array([h * BASE + U(c)]))[0]
        return np.array([h >> U(24)], U), np.zeros(1, np.int64)
    total = n - k + 1
    window = min(window, total)
    found_h, found_at = [], []
    for at in range(0, total - window + 1, SEGMENT):
        last = min(total - window + 1, at + SEGMENT)  # windows that start in [at, last)
        h = _hashes(codes[at : last - 1 + window + k - 1], k)
        v = (h << U(24)) | (U(LOW) - np.arange(len(h), dtype=U))
        low = _window_min(v, window)
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        found_h.append(low >> U(24))
        found_at.append(at + LOW - (low & U(LOW)).astype(np.int64))
    h, pos = np.concatenate(found_h), np.concatenate(found_at)
    keep = np.concatenate(([True], pos[1:] != pos[:-1]))
    return h[keep], pos[keep]


def as_string(h: np.ndarray, at: np.ndarray) -> str:
    """Hexadecimal records of 10 digits of hash and 8 of position."""
    raw = np.empty(len(h), RECORD)
    raw["hash"], raw["at"] = h, at
    return raw.view(np.uint8).reshape(-1, RECORD.itemsize)[:, 3:].tobytes().hex() if len(h) else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the shared hashes through all hashes of both (0 to 1)."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def alike(a: str, b: str, of_a: np.ndarray, of_b: np.ndarray, k: int = K, window: int | None = None) -> float:
    """The likeness of two texts from their hashes of (k, window), or from shorter runs if one text needs them."""
    n = min(len(a), len(b))
    fit = fitted(n, k, window)
    if not n or a == b or fit == (k, window or WINDOW):
        return likeness(of_a, of_b)
    return likeness(winnow(a, *fit)[0], winnow(b, *fit)[0])


def with_fingerprint(docs: DataFrame, k: int = K, window: int | None = None) -> DataFrame:
    """docs with a struct winnowed of hashes and positions (arrays of long); a column of that name is replaced."""

    @F.arrow_udf("struct<hashes:array<long>,positions:array<long>>")
    def winnowed(texts: pa.Array) -> pa.Array:
        both = [winnow(t.as_py() or "", k, window) for t in texts]
        return pa.array([{"hashes": h.astype(np.int64), "positions": p} for h, p in both], pa.struct([("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))]))

    return small_batches(docs).withColumn("winnowed", winnowed("text"))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _dealt(bounds: np.ndarray, top: int | None):
    """Adds to each row the part of the descending order that it is in; the first row of a part also ends the part before."""
    rising = bounds[::-1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            known = np.asarray(ids.is_valid())
            d = np.asarray(ids.fill_null(0))
            part = np.where(known, len(bounds) - np.searchsorted(rising, d, "left"), len(bounds))
            is_bound = known & np.isin(d, bounds)
            is_top = (known & (d == top)) if top is not None else ~known
            here = np.arange(len(d))
            rows = np.concatenate((here, here[is_bound], here[is_top]))
            parts = np.concatenate((part, part[is_bound] - 1, np.full(int(is_top.sum()), len(bounds))))
            trail = np.concatenate((np.zeros(len(d), np.int64), np.ones(int(is_bound.sum()), np.int64), np.full(int(is_top.sum()), 2)))
            took = batch.take(pa.array(rows))
            packed = pa.array([zlib.compress((t.as_py() or "").encode("utf-8", "surrogatepass"), 1) for t in took.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([took.column("doc_id").cast(pa.int64()), packed, pa.array(parts.astype(np.int32)), pa.array(trail.astype(np.int32))], ["doc_id", "packed", "part", "trail"])

    return deal


def _compared(k: int, window: int | None):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc_id, text, part, trail, hashes, positions)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, packed, part, trail in zip(*(batch.column(c) for c in ("doc_id", "packed", "part", "trail")), strict=True):
                part, trail, text = part.as_py(), trail.as_py(), zlib.decompress(packed.as_py()).decode("utf-8", "surrogatepass")
                if held and (held[3] or held[2] != part) and trail:
                    held = None
                    continue  # only the first row that follows a part counts
                h, at = winnow(text, k, window)
                if held and not held[3] and held[2] == part:
                    out.append(_row(held, text, h, k, window))
                held = (doc_id.as_py(), text, part, trail, h, at)
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return compare


def _row(held: tuple, following: str, following_hashes: np.ndarray, k: int, window: int | None) -> tuple:
    doc_id, text, _, _, h, at = held
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    eh, eat = winnow(edited, k, window)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, as_string(h, at), as_string(eh, eat), alike(text, edited, h, eh, k, window), alike(text, following, h, following_hashes, k, window)


def edited_pairs(docs: DataFrame, k: int = K, window: int | None = None) -> DataFrame:
    """Each document against its edited text and against the next document, in descending order of doc_id (RESULT).

    Range bounds are ids of documents; the text at a bound is sent to both sides, so that every task holds the document
    that follows its last one, and texts are shuffled once, compressed. The bounds number as many as shuffle partitions.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.array(*[F.lit((i + 1) / parts) for i in range(parts)])
    found = docs.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", share, max(10_000, 20 * parts)).alias("b")).first()
    bounds = np.array(sorted(set(found.b or ()), reverse=True), np.int64)
    dealt = docs.mapInArrow(_dealt(bounds, found.top), "doc_id long, packed binary, part int, trail int")
    placed = dealt.repartition(parts, "part").sortWithinPartitions("part", "trail", F.col("doc_id").desc_nulls_last(), "packed")
    return placed.mapInArrow(_compared(k, window), RESULT)
