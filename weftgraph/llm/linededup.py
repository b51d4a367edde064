"""Line dedup: lines whose key many documents hold stay in one of them.

Pass 1 hashes every line's key; the hashes alone, each once for a task's run of documents, are written and counted. From them
two Bloom filters are made, of hashes seen once and of hashes seen twice, cut into blocks by the hash: the number of blocks
follows the number of lines, a block is made in one task, and there are no false negatives. Pass 2 probes the twice filter
with all lines; only lines that it suspects are shuffled, with their keys, for the exact count of documents and the choice of
the document that keeps them. Then each document drops its lines; the places of dropped lines meet the texts in one join.

While the twice filter has at most max_blocks blocks (32 MiB, that is 33 million lines) it is broadcast. Beyond that its blocks
stay where they are and the lines' hashes, with their documents' numbers, are shuffled to them; what it suspects is the same. A
key that very many documents hold is reduced before each shuffle, so that no task receives its lines.

Null and empty texts have one empty line. Lines shorter than the least length always stay. Rows with one doc_id are one
document; null ids are one document, below all others. Texts of any length are scanned whole. An empty table gives an empty
result. Other columns pass through, except that n_lines and n_dropped are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, small_batches, written
from .textscan import LOWER, column_bytes, mix64, span_hashes, trimmed_lines

HASHES = 4
BLOCK_BITS = 20
BLOCK_LINES = 1 << 17  # 8 bits for each line
MAX_BLOCKS = 256
SLICE_BYTES = 4 << 20
PLACE = np.dtype([("hash", "<u8"), ("row", "<i4"), ("pos", "<i4")])


class Blocks:
    """How hashes are dealt to a number of blocks, and to bits of a block."""

    def __init__(self, number: int, bits: int = BLOCK_BITS):
        self.number, self.bits = number, bits

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(40)) % np.uint64(self.number)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """HASHES rows of bit numbers."""
        with np.errstate(over="ignore"):
            h = mix64(hashes)
            step = (h >> np.uint64(32)) | np.uint64(1)
            return ((h[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * step[None, :]) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def empty(self) -> np.ndarray:
        return np.zeros((1 << self.bits) // 8, np.uint8)


def _put(block: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(block, places >> 3, np.left_shift(np.uint8(1), (places & 7).astype(np.uint8)))


def _has(block: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (block[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def _slices(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about SLICE_BYTES."""
    data, offsets = column_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, data, offsets[at : end + 1]
        at = end


def _long_lines(column, min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, start, end, hash, bytes) of the lines of at least min_chars code points."""
    for at, data, offsets in _slices(column):
        doc, place, starts, ends, chars = trimmed_lines(data, offsets)
        long = chars >= min_chars
        doc, place, starts, ends = doc[long], place[long], starts[long], ends[long]
        yield doc + at, place, starts, ends, span_hashes(data, starts, ends, lower=True), data


def _hashed(min_chars: int, fold: int = 1 << 18):
    """Rows (n, once, twice): the number of lines, and the packed hashes that a run of documents holds once and more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            own, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([int(counts.sum())]), pa.array([own[counts == 1].tobytes()], pa.binary()), pa.array([own[counts > 1].tobytes()], pa.binary())], ["n", "once", "twice"])

        for batch in batches:
            for doc, _, _, _, hashes, _ in _long_lines(batch.column(0), min_chars):
                by = np.lexsort((hashes, doc))  # a document counts once
                doc, hashes = doc[by], hashes[by]
                held.append(hashes[np.concatenate(([True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])))] if len(doc) else hashes)
                if sum(map(len, held)) >= fold:
                    yield row()
        if held:
            yield row()

    return run


def _dealt(blocks: Blocks):
    """Rows (block, once, twice) of the packed hashes of a run of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for once, twice in zip(batch.column(0), batch.column(1), strict=True):
                parts = []
                for x in (once, twice):
                    h = np.frombuffer(x.as_buffer(), np.uint64)
                    b = blocks.of(h)
                    by = np.argsort(b, kind="stable")
                    h, edges = h[by], np.searchsorted(b[by], np.arange(blocks.number + 1))
                    parts.append([h[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks.number), pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], ["block", "once", "twice"])

    return run


def _filled(blocks: Blocks):
    """Rows (block, twice): the twice filter's blocks, from all rows of a block in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for b, *both in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                once, twice = filters.setdefault(b, (blocks.empty(), blocks.empty()))
                single, several = (np.frombuffer(x.as_buffer(), np.uint64) for x in both)
                places = np.unique(blocks.places(single))
                _put(twice, places[_has(once, places)])
                _put(once, places)
                places = np.unique(blocks.places(several))
                _put(twice, places)
                _put(once, places)
        yield pa.RecordBatch.from_arrays([pa.array(list(filters), pa.int32()), pa.array([zlib.compress(t.tobytes(), 1) for _, t in filters.values()], pa.binary())], ["block", "twice"])

    return run


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _probed(blocks: Blocks, shared, min_chars: int):
    """Rows (doc_id, rid, pos, key) of the lines that the broadcast filter suspects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.concatenate([_unpacked(x) for x in shared.value])
        size = (1 << blocks.bits) // 8
        for batch in batches:
            for row, place, starts, ends, hashes, data in _long_lines(batch.column(2), min_chars):
                at = blocks.places(hashes) + 8 * size * blocks.of(hashes)
                yield _suspects(batch, row, place, starts, ends, data, _has(whole, at).all(axis=0))

    return run


def _suspects(batch: pa.RecordBatch, row, place, starts, ends, data, hit) -> pa.RecordBatch:
    rows = pa.array(row[hit])
    keys = [LOWER[data[a:b]].tobytes() for a, b in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place[hit].astype(np.int32)), pa.array(keys, pa.binary())], ["doc_id", "rid", "pos", "key"])


def _sent(blocks: Blocks, min_chars: int):
    """Rows (block, ids, rids, packed): the places of a batch's lines for each block, as PLACE records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(h, row, place) for row, place, _, _, h, _ in _long_lines(batch.column(2), min_chars)]
            p = np.empty(sum(len(h) for h, _, _ in parts), PLACE)
            if not len(p):
                continue
            p["hash"], row, p["pos"] = (np.concatenate(x) for x in zip(*[(h, r, q) for h, r, q in parts], strict=True))
            b = blocks.of(p["hash"])
            by = np.lexsort((row, b))
            p, b, row = p[by], b[by], row[by]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)]))
            ids, rids, packed = [], [], []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                own, p["row"][i:j] = np.unique(row[i:j], return_inverse=True)
                ids.append(batch.column(0).take(pa.array(own)))
                rids.append(batch.column(1).take(pa.array(own)))
                packed.append(p[i:j].tobytes())
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays(x)) for x in (ids, rids)]
            yield pa.RecordBatch.from_arrays([pa.array(b[cuts[:-1]].astype(np.int32)), *lists, pa.array(packed, pa.binary())], ["block", "ids", "rids", "packed"])

    return run


def _met(blocks: Blocks):
    """Rows (doc_id, rid, pos) of the lines that the filter of their block suspects; a block's filter comes before its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = blocks.empty()
        for batch in batches:
            for filled, ids, rids, packed in zip(*(batch.column(c) for c in ("twice", "ids", "rids", "packed")), strict=True):
                if filled.is_valid:
                    twice = _unpacked(filled.as_py())
                    continue
                p = np.frombuffer(packed.as_buffer(), PLACE)
                p = p[_has(twice, blocks.places(np.ascontiguousarray(p["hash"]))).all(axis=0)]
                rows = pa.array(np.ascontiguousarray(p["row"]))
                yield pa.RecordBatch.from_arrays([ids.values.take(rows), rids.values.take(rows), pa.array(np.ascontiguousarray(p["pos"]))], ["doc_id", "rid", "pos"])

    return run


def _keys_at(min_chars: int):
    """Rows (doc_id, rid, pos, key) of the lines at given places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [np.asarray(x.values) for x in batch.column(3)]
            for row, place, starts, ends, _, data in _long_lines(batch.column(2), min_chars):
                hit = np.zeros(len(row), bool)
                for r in np.unique(row).tolist():
                    of_row = row == r
                    hit[of_row] = np.isin(place[of_row], wanted[r])
                yield _suspects(batch, row, place, starts, ends, data, hit)

    return run


def suspected_lines(docs: DataFrame, min_chars: int, block_lines: int, block_bits: int, max_blocks: int) -> DataFrame:
    """A written table (doc_id, rid, pos, key) of all lines that several documents may hold. docs: doc_id, rid, text."""
    spark = docs.sparkSession
    hashed = written(docs.select("text").mapInArrow(_hashed(min_chars), "n long, once binary, twice binary"), "hashes")
    lines = hashed.agg(F.sum("n")).first()[0] or 0
    blocks = Blocks(max(1, -(-lines // block_lines)), block_bits)
    dealt = hashed.select("once", "twice").mapInArrow(_dealt(blocks), "block int, once binary, twice binary").where("length(once) + length(twice) > 0")
    filled = dealt.repartition("block").mapInArrow(_filled(blocks), "block int, twice binary")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if blocks.number <= max_blocks:
        found = {r.block: bytes(r.twice) for r in filled.toLocalIterator()}
        none = zlib.compress(blocks.empty().tobytes(), 1)
        shared = spark.sparkContext.broadcast([found.get(b, none) for b in range(blocks.number)])
        out = written(docs.mapInArrow(_probed(blocks, shared, min_chars), f"doc_id {id_type}, rid long, pos int, key binary"), "suspects")
        shared.destroy()
        forget(hashed)
        return out
    filters = written(filled, "filters")
    sent = docs.mapInArrow(_sent(blocks, min_chars), f"block int, ids array<{id_type}>, rids array<long>, packed binary")
    both = sent.withColumn("twice", F.lit(None).cast("binary")).unionByName(filters, allowMissingColumns=True)
    met = both.repartition("block").sortWithinPartitions("block", F.col("twice").isNull()).mapInArrow(_met(blocks), f"doc_id {id_type}, rid long, pos int")
    places = met.groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("places")).select(F.col("doc_id").alias("p_id"), F.col("rid").alias("p_rid"), "places")
    placed = docs.join(places, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("rid") == F.col("p_rid"))).select("doc_id", "rid", "text", "places")
    out = written(placed.mapInArrow(_keys_at(min_chars), f"doc_id {id_type}, rid long, pos int, key binary"), "suspects")
    forget(hashed, filters)
    return out


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    kept, before, dropped = [], [], []
    for t, g in zip(texts, gone, strict=True):
        t, g = t.as_py(), g.as_py()
        if g:
            own, g = t.split("\n"), set(g)
            before.append(len(own))
            t = "\n".join([x for i, x in enumerate(own) if i not in g])
        else:
            before.append(t.count("\n") + 1 if t else 1)
        kept.append(t)
        dropped.append(len(g or ()))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, block_lines: int = BLOCK_LINES, block_bits: int = BLOCK_BITS, max_blocks: int = MAX_BLOCKS
) -> DataFrame:
    """docs with text less its repeated lines, and n_lines (before), n_dropped (long).

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys of at least min_chars code points that at
    least min_docs documents hold lose all their lines except in the largest doc_id that holds them.
    """
    small_batches(docs)
    others = [c for c in docs.columns if c.lower() not in ("text", "doc_id", "n_lines", "n_dropped")]
    suspects = suspected_lines(docs.select("doc_id", F.xxhash64("text").alias("rid"), "text"), min_chars, block_lines, block_bits, max_blocks)
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    holders = suspects.select("key", "doc_id").distinct()
    repeated = holders.groupBy("key").agg(F.count("*").alias("n"), F.max_by("doc_id", order).alias("stays")).where(F.col("n") >= min_docs)
    repeated = written(repeated.select("key", "stays"), "repeated")  # so that a key of very many lines can be split in the join
    gone = suspects.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("stays")))
    gone = gone.groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("gone")).select(F.col("doc_id").alias("g_id"), F.col("rid").alias("g_rid"), "gone")
    gone = written(gone, "gone")
    forget(suspects, repeated)
    rows = docs.select("doc_id", "text", F.struct(*others).alias("others") if others else F.lit(0).alias("others"), F.xxhash64("text").alias("rid"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("rid") == F.col("g_rid")), "left")
    out = joined.withColumn("out", F.arrow_udf(_without, "struct<text:string,n_lines:long,n_dropped:long>")("text", "gone"))
    cols = {c.lower(): F.col(f"others.`{c}`").alias(c) for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("out.text").alias("text")}
    keep = [c for c in docs.columns if c.lower() in cols]
    return out.select(*[cols[c.lower()] for c in keep], F.col("out.n_lines").alias("n_lines"), F.col("out.n_dropped").alias("n_dropped"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (r.key IS NOT NULL AND k.doc_id <> r.stays)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (r.key IS NULL OR k.doc_id = r.stays), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY k.doc_id
"""
