"""N-gram Jaccard join by T-occurrence search.

1. Documents with one shingle set are one class, found by a 128-bit hash of the set; one document stands for a class.
2. Shingles are ordered by how often a counting sketch of fixed size, over all documents, has seen them, rarest first. Two
   sets of Jaccard similarity t share a shingle among the first |x| - ceil(t |x|) + 1 of either; only those are indexed.
   Postings travel in packed blocks by slices of the hash range, and shingles of one class only are dropped there.
3. An inverted list has a head, the smallest document in it. First every document meets the heads of its lists, as far as
   sizes and places in the lists allow the overlap; that joins groups of near copies without their pairs. Then, in the lists
   that still hold several components, documents that by sizes and places may link with one of another component form
   neighbourhoods: two documents that can reach the overlap share a list, so they meet. Candidate pairs are never rows: a
   neighbourhood travels as its documents' sets, and a search gives fewer links than it has documents.
4. A neighbourhood is cut into parts of bounded total size and each pair of parts is searched in one task: for a query
   document, the short inverted lists of its shingles are merged, and documents that reach the overlap less the number of long
   lists are probed in the long lists by binary search (DivideSkip). Only documents of other components are looked for.
5. Links and classes give components.

Texts are read where they lie, three or four times, and never shuffled; nothing is broadcast but the sketch (2^21 counters) and
Bloom filters of bounded size that say which documents' sets are needed. Results are exact but for collisions of 64-bit hashes
(of shingles, and of a row's doc_id and text, its key). Null and empty texts have no shingles and link with nothing. Rows with
one doc_id are one document, linked if any of its texts links; null ids are one document (not so in one_of_each, where each
distinct text under an id, null or not, is a document of its own). Texts are scanned whole. An empty table gives an empty
result. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, small_batches, written
from .components import components
from .textscan import U, column_bytes, joined_words, mix64, shingles_of_each

SKETCH_BITS = 21
SLICES = 32
SLICE_POSTINGS = 250_000
HEAVY = 1 << 14
NULL_ID = -(2**63)
CELL_SHINGLES = 1 << 18
SCAN_BYTES = 2 << 20
HEAP_LIMIT = 2048
WANTED_BITS = (16, 26)  # least and most bits of the filter of wanted documents, by powers of two
#: A list is found by 32 bits of its shingle's hash inside a slice; lists that this runs together only give more candidates.
POSTING = np.dtype([("token", "<u4"), ("id", "<i8"), ("n", "<i4"), ("pos", "<i4")])
COMMON = 1 << 62


def _sets(column, n_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingles of each row in a row, where each row's begin) of runs of about SCAN_BYTES."""
    data, offsets = column_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SCAN_BYTES, "right")) - 1)
        hashes, edges = joined_words(data, offsets[at : end + 1], lower=True)
        flat, starts = shingles_of_each(hashes, edges, n_words)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            flat[a:b].sort()
        keep = np.ones(len(flat), bool)
        keep[1:] = flat[1:] != flat[:-1]
        keep[starts[:-1][starts[:-1] < len(flat)]] = True
        yield at, flat[keep], np.concatenate(([0], np.cumsum(keep)))[starts]
        at = end


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Wrapping sums of each run."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U), np.cumsum(x, dtype=U)))
        return total[starts[1:]] - total[starts[:-1]]


def _identity(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    s1, s2 = _sums(mix64(flat), starts), _sums(mix64(flat ^ U(0xA5A5F00D12345678)), starts)
    return s1.view(np.int64), s2.view(np.int64)


def _at(shingle: np.ndarray, bits: int) -> np.ndarray:
    return (shingle >> U(64 - bits)).astype(np.int64)


FIRST = "k long, doc long, n long, s1 long, s2 long, slice int, counts binary"


def _first_pass(n_words: int, bits: int):
    """A row for each document, and at the end the partition's counting sketch in compressed slices."""
    names = [x.split()[0] for x in FIRST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for at, flat, starts in _sets(batch.column(2), n_words):
                np.add.at(sketch, _at(flat, bits), 1)
                m = len(starts) - 1
                own = [pa.array(x, pa.int64()) for x in (np.diff(starts), *_identity(flat, starts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, m), batch.column(1).slice(at, m), *own, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        parts = [zlib.compress(x.tobytes(), 1) for x in sketch.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(SLICES, pa.int64())] * 5, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
            total[s] = total[s] + x if s in total else x.astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["slice", "counts"])


class Wanted:
    """A Bloom filter of keys on the executors: which documents are needed, and some others."""

    def __init__(self, shared, bits: int):
        self.shared, self.bits = shared, bits

    def kept(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows whose first column may be a wanted key."""
        filter_ = np.frombuffer(zlib.decompress(self.shared.value), np.uint8)
        for batch in batches:
            at = _wanted_places(np.asarray(batch.column(0)), self.bits)
            hit = ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0).astype(bool)
            if hit.any():
                yield batch.filter(pa.array(hit))


def _wanted_places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix64(keys.astype(np.int64).view(U))
    with np.errstate(over="ignore"):
        return ((h[None, :] + np.arange(3, dtype=U)[:, None] * ((h >> U(32)) | U(1))[None, :]) & U((1 << bits) - 1)).astype(np.int64)


def _wanted_filter(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            at = np.unique(_wanted_places(np.asarray(batch.column(0)), bits))
            np.bitwise_or.at(own, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["bits"])

    return run


def wanted_of(ids: DataFrame) -> Wanted:
    """The filter of the keys of a written table of one column: 8 to 16 bits for each key, 8 MiB at most; with very many keys it
    lets more through."""
    bits = min(max(WANTED_BITS[0], (8 * ids.count()).bit_length()), WANTED_BITS[1])
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for row in ids.coalesce(64).mapInArrow(_wanted_filter(bits), "bits binary").toLocalIterator():
        whole |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return Wanted(ids.sparkSession.sparkContext.broadcast(zlib.compress(whole.tobytes(), 1)), bits)


def _postings(n_words: int, num: int, den: int, sketch, bits: int, slices: int, heavy: int, wanted: Wanted):
    """Packed postings of the indexed shingles of the wanted documents: a row for each slice that a run of documents has some in.

    The filter lets some others through. Of a class the document of the smallest key stands for it, so in a task a class comes
    again only with a smaller key than before: others cannot be the one, and the one is never left out.
    Shingles counted more than heavy times are not gathered by hash: their postings stay where they are, and all are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.minimum(np.frombuffer(zlib.decompress(sketch.value), np.uint64), U(2**32 - 1)).astype(np.uint32)
        done: dict[tuple[int, int], int] = {}
        for batch in wanted.kept(batches):
            keys = np.asarray(batch.column(0))
            for at, flat, starts in _sets(batch.column(1), n_words):
                s1, s2 = _identity(flat, starts)
                found = []
                for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    n, own, key = b - a, (int(s1[i]), int(s2[i])), int(keys[at + i])
                    if not n or done.get(own, key + 1) <= key:
                        continue
                    done[own] = key
                    s = flat[a:b]
                    indexed = n - -(-num * n // den) + 1
                    seen = counts[_at(s, bits)]
                    first = np.lexsort((s, seen))[:indexed]
                    p = np.empty(indexed, POSTING)
                    h = mix64(s[first])
                    p["token"], p["id"], p["n"], p["pos"] = h >> U(32), key, n, np.arange(indexed)
                    found.append((p, seen[first] > heavy, (h & U(0xFFFFFFFF)) % U(slices)))
                if not found:
                    continue
                p, common, where = (np.concatenate(x) for x in zip(*found, strict=True))
                where = where.astype(np.int64)
                spread = (mix64(np.ascontiguousarray(p["id"]).view(U)) % U(slices)).astype(np.int64)
                where = np.where(common, -1 - spread, where)
                by = np.argsort(where, kind="stable")
                p, where = p[by], where[by]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1, [len(where)]))
                packed = [p[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(where[cuts[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], ["slice", "packed"])

    return run


LIVE = "token long, id long, n int, pos int, common boolean, h long, nh int, ph int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of shingles that several documents have, with the head of the list, and all common ones, without. Rows come
    slice by slice; one is held at a time."""

    def rows(p: np.ndarray, base: int, head: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        column = lambda x, f: pa.array(np.ascontiguousarray(x[f]))
        for at in range(0, len(p), 1 << 16):
            some, of = p[at : at + (1 << 16)], None if head is None else head[at : at + (1 << 16)]
            own = [pa.array(some["token"].astype(np.int64) + base), *(column(some, f) for f in ("id", "n", "pos")), pa.array(np.full(len(some), of is None))]
            heads = [pa.nulls(len(some), t) if of is None else column(of, f) for f, t in (("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()))]
            yield pa.RecordBatch.from_arrays(own + heads, [x.split()[0] for x in LIVE.split(", ")])

    def of_slice(held: list[np.ndarray], number: int) -> Iterator[pa.RecordBatch]:
        p = np.concatenate(held)
        p = p[np.lexsort((p["pos"], p["n"], p["id"], p["token"]))]
        p = p[np.concatenate(([True], p[1:] != p[:-1]))]
        new = np.concatenate(([True], p["token"][1:] != p["token"][:-1]))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        several = ~new
        several[:-1] |= ~new[1:]
        yield from rows(p[several], number << 32, p[first[several]])

    held, now = [], None
    for batch in batches:
        for where, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            p = np.frombuffer(packed.as_py(), POSTING)
            if where < 0:
                yield from rows(p, COMMON, None)
                continue
            if where != now and held:
                yield from of_slice(held, now)
                held = []
            now = where
            held.append(p)
    if held:
        yield from of_slice(held, now)


class Lists:
    """The inverted lists of some sets: for each shingle the documents that have it, in rising order."""

    def __init__(self, sets: list[np.ndarray]):
        tokens = np.concatenate([np.zeros(0, U), *sets])
        by = np.argsort(tokens, kind="stable")
        tokens = tokens[by]
        first = np.concatenate(([True], tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, bool)
        self.owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[by]
        self.tokens, self.edges = tokens[first], np.append(np.flatnonzero(first), len(tokens))
        self.sizes = np.array([len(s) for s in sets], np.int64)

    def of(self, query: np.ndarray) -> list[np.ndarray]:
        """The lists of a query's shingles, shortest first."""
        if not len(self.tokens):
            return []
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        at = at[np.argsort(self.edges[at + 1] - self.edges[at], kind="stable")]
        return [self.owner[a:b] for a, b in zip(self.edges[at].tolist(), self.edges[at + 1].tolist(), strict=True)]


def divide_skip(query: np.ndarray, lists: Lists, wanted: np.ndarray, num: int, den: int, margins: list[int] | None = None) -> list[int]:
    """Which of the wanted documents (a mask) have Jaccard similarity num / den or more with the query set. margins: gets by how
    many shingles each surpasses the overlap that it needs, or less.

    The short lists are merged by a heap; where they hold over HEAP_LIMIT entries, by counting, which gives the same counts.
    """
    n, sizes = len(query), lists.sizes
    wanted = wanted & (den * np.minimum(sizes, n) >= num * np.maximum(sizes, n)) & (sizes > 0)
    if not n or not wanted.any():
        return []
    need = -(-num * (n + sizes) // (num + den))
    least = int(need[wanted].min())
    found = lists.of(query)
    if len(found) < least:
        return []
    # DivideSkip's number of long lists: the fewer, the longer the longest list is.
    n_long = min(least - 1, int(least / (0.01 * np.log2(len(found[-1]) + 1) + 1)))
    short, long = found[: len(found) - n_long], found[len(found) - n_long :]
    if sum(map(len, short)) <= HEAP_LIMIT:
        merged = [(doc, sum(1 for _ in hits)) for doc, hits in groupby(heapq.merge(*[x.tolist() for x in short]))]
        docs, counts = np.array([d for d, _ in merged], np.int64), np.array([c for _, c in merged], np.int64)
    else:
        total = np.bincount(np.concatenate(short), minlength=len(sizes))
        docs = np.flatnonzero(total)
        counts = total[docs]
    for left in range(n_long, -1, -1):
        open_ = wanted[docs] & (counts + left >= need[docs])
        docs, counts = docs[open_], counts[open_]
        if not len(docs) or not left:
            if margins is not None:
                margins += (counts - need[docs]).tolist()
            break
        x = long[n_long - left]
        at = np.minimum(np.searchsorted(x, docs), len(x) - 1)
        counts = counts + (x[at] == docs)
    return docs.tolist()


def narrowed(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """32 bits of each shingle of some sorted sets, sorted within each set."""
    short = (mix64(flat) >> U(32)).astype(np.uint32)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        short[a:b].sort()
    return short


def widened(short: np.ndarray) -> np.ndarray:
    """Distinct tokens for the short forms of one set: a form's second occurrence is another token, and so on. Two sets then
    share as many tokens as shingles, or more."""
    if len(short) < 2:
        return short.astype(U)
    first = np.concatenate(([True], short[1:] != short[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(short)), 0))
    return short.astype(U) + ((np.arange(len(short)) - start).astype(U) << U(32))


def surely(margin: int, n: int) -> bool:
    """Whether so large a margin over the needed overlap, in short forms of a set of n, cannot come from forms that meet by
    chance: about n * n / 2**32 do."""
    return margin >= 6 + 100 * n * n / 2**32


LINK = "h long, u long, v long, sure boolean"


def _search(num: int, den: int, short: bool):
    """The links (h, u, v, sure) in one cell of a neighbourhood: rows of h, id, comp, part, asks, shingles.

    Documents that ask are queries for those of other components. A component asks only those that come after it when ordered
    by their number of rows here, so each pair is looked at once and the largest is never a query. In a cell of two parts only
    documents of different parts meet. With short forms a link that is close to the limit is not sure. A link, sure or not,
    joins its components, so that there are fewer links than components; who finds one untrue has to search again.
    """

    def run(cell: pa.Table) -> pa.Table:
        ids, comps, parts = (np.asarray(cell.column(c)) for c in ("id", "comp", "part"))
        asks = cell.column("asks").to_pylist()
        sets = [widened(np.frombuffer(x.as_buffer(), np.uint32)) if short else np.frombuffer(x.as_buffer(), U) for x in cell.column("shingles")]
        size = Counter(comps.tolist())
        place = {c: i for i, c in enumerate(sorted(size, key=lambda c: (size[c], c)))}
        group = np.array([place[c] for c in comps.tolist()], np.int64)
        head = list(range(len(place)))  # components joined so far, by their place

        def top(x: int) -> int:
            while head[x] != x:
                head[x] = head[head[x]]
                x = head[x]
            return x

        two = len(set(parts.tolist())) > 1
        all_ask = all(asks)
        lists = Lists(sets)
        links = []
        for i in sorted(range(len(ids)), key=group.__getitem__):
            if not asks[i]:
                continue
            wanted = group > group[i] if all_ask else group != group[i]
            if two:
                wanted &= parts != parts[i]
            margins: list[int] = []
            for j, margin in zip(divide_skip(sets[i], lists, wanted, num, den, margins), margins, strict=True):
                a, b = top(int(group[i])), top(int(group[j]))
                if a == b:
                    continue
                head[a] = b
                links.append((int(ids[i]), int(ids[j]), not short or surely(margin, max(len(sets[i]), len(sets[j])))))
        u, v, sure = zip(*links, strict=True) if links else ((), (), ())
        return pa.table({"h": cell.column("h")[: len(links)], "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "sure": pa.array(sure, pa.bool_())})

    return run


def _wanted_sets(n_words: int, wanted: Wanted, short: bool):
    """Rows (id, shingles), packed, of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in wanted.kept(batches):
            for a, flat, starts in _sets(some.column(1), n_words):
                tokens = narrowed(flat, starts) if short else flat
                packed = pa.array([tokens[i:j].tobytes() for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0).slice(a, len(packed)), packed], ["id", "shingles"])

    return run


def sets_of(ids: DataFrame, texts: DataFrame, n_words: int, short: bool) -> DataFrame:
    """(id, shingles, packed: 8 bytes each or 4) of the documents with these keys (a written table), and of some others."""
    return texts.select("k", "text").mapInArrow(_wanted_sets(n_words, wanted_of(ids), short), "id long, shingles binary")


def linked(groups: DataFrame, texts: DataFrame, n_words: int, num: int, den: int, cell: int = CELL_SHINGLES) -> DataFrame:
    """Links (u, v) that join what hangs together among documents of different components in the same neighbourhood.

    The search in short forms of the shingles gives links enough to join all that link, fewer than documents. Those that are
    close to the limit are looked at again in whole shingles. Where one of them comes from forms that meet by chance, others
    that it made needless may be missing: the neighbourhood is searched again as a whole in whole shingles.
    """
    groups = written(groups, "groups")
    found = _searched(groups, texts, n_words, num, den, cell, True)
    unsure = written(found.where("NOT sure").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "h").distinct(), "unsure")
    one = unsure.select("u", "v").distinct().select(F.xxhash64("u", "v").alias("h"), F.explode(F.array("u", "v")).alias("id"))
    one = written(one.select("h", "id", F.lit(0).alias("n"), F.col("id").alias("comp"), F.lit(True).alias("asks")), "groups")
    again = _searched(one, texts, n_words, num, den, cell, False)
    true = again.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    links = found.where("sure").select("u", "v").unionByName(true)
    doubtful = written(unsure.join(true, ["u", "v"], "left_anti").select("h").distinct(), "doubtful")
    whole = None
    if not doubtful.isEmpty():
        rest = written(groups.join(doubtful, "h", "left_semi"), "groups")
        whole = _searched(rest, texts, n_words, num, den, cell, False)
        links = links.unionByName(whole.select("u", "v"))
        forget(rest)
    links = written(links, "links")
    forget(groups, found, unsure, one, again, doubtful, *([whole] if whole is not None else []))
    return links


def _searched(groups: DataFrame, texts: DataFrame, n_words: int, num: int, den: int, cell: int, short: bool) -> DataFrame:
    """A written table of links (h, u, v, sure).

    groups: a written table (h, id, n, comp, asks): id, of n shingles, is in the neighbourhood h; asks: whether it looks for
    others. Where not all ask, those that do are in every part.
    """
    parts = groups.groupBy("h").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / cell)).cast("int").alias("k"), F.min("asks").alias("all_ask"))
    part = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    every = F.sequence(F.lit(0), F.col("k") - 1)
    pair = lambda p, q: F.struct(F.least(p, q).alias("x"), F.greatest(p, q).alias("y"))
    cells = F.when(F.col("all_ask"), F.transform(every, lambda q: pair(F.col("part"), q))).when(F.col("asks"), F.transform(every, lambda q: pair(q, q))).otherwise(F.array(pair(F.col("part"), F.col("part"))))
    placed = groups.join(parts, "h").withColumn("part", part).select("h", "id", "comp", "asks", "part", "all_ask", F.inline(cells))
    placed = written(placed.withColumn("part", F.when(F.col("all_ask"), F.col("part")).otherwise(0)).drop("all_ask"), "placed")
    ids = written(groups.select("id").distinct(), "ids")
    if groups.isEmpty():
        return groups.selectExpr("h", "id AS u", "id AS v", "asks AS sure")
    # One plan at every size: the table of places grows with the corpus, so it is not broadcast where it happens to be small.
    full = sets_of(ids, texts, n_words, short).hint("merge").join(placed, "id")
    links = written(full.groupBy("h", "x", "y").applyInArrow(_search(num, den, short), LINK), "links")
    forget(placed, ids)
    return links


def _may_link(x: str, nx: str, px: str, y: str, ny: str, py: str, num: int, den: int) -> str:
    """SQL: the sizes allow the similarity, and the overlap that it needs is still open at this shared shingle."""
    return (
        f"{x} <> {y} AND {den}L * least({nx}, {ny}) >= {num}L * greatest({nx}, {ny}) "
        f"AND ({num + den}L) * least({nx} - {px}, {ny} - {py}) >= {num}L * ({nx} + {ny})"
    )


OPEN = "h long, id long, n int, comp long"


def _open_lists(num: int, den: int, chunk: int = 1 << 16, most_pairs: int = 1 << 20):
    """Rows (h, id, n, comp) of the documents that one of another component in their list may link with, by sizes and places.

    Rows come list by list. Documents of a list that hang together by such pairs form a neighbourhood, named by the smallest of
    them. The pairs of some lists at a time are looked at as arrays and never leave; of a list with over most_pairs pairs a run
    of rows at a time, and all its documents that have a partner are one neighbourhood.
    """

    def may(n, pos, comp, a, b):
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        return (comp[a] != comp[b]) & (den * small >= num * large) & ((num + den) * np.minimum(n[a] - pos[a], n[b] - pos[b]) >= num * (small + large))

    def rows(h, ids, n, comp) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(n.astype(np.int32)), pa.array(comp)], ["h", "id", "n", "comp"])

    def of_lists(ids, n, pos, comp, sizes) -> pa.RecordBatch:
        starts = np.cumsum(sizes) - sizes
        behind = np.repeat(starts + sizes, sizes) - np.arange(len(ids)) - 1
        a = np.repeat(np.arange(len(ids)), behind)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(behind) - behind, behind)
        ok = may(n, pos, comp, a, b)
        a, b = a[ok], b[ok]
        label, least = np.arange(len(ids)), ids.copy()
        while True:
            low = np.minimum(label[a], label[b])
            if (low == label[a]).all() and (low == label[b]).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        with_partner = np.unique(np.concatenate((a, b)))
        np.minimum.at(least, label[with_partner], ids[with_partner])
        return rows(least[label[with_partner]], ids[with_partner], n[with_partner], comp[with_partner])

    def of_long_list(ids, n, pos, comp) -> pa.RecordBatch:
        everyone, step = np.arange(len(ids)), max(1, most_pairs // len(ids))
        has = np.concatenate([may(n, pos, comp, everyone[at : at + step, None], everyone[None, :]).any(axis=1) for at in range(0, len(ids), step)])
        return rows(np.full(int(has.sum()), ids[has].min() if has.any() else 0), ids[has], n[has], comp[has])

    def of_chunk(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, ids, n, pos, comp = cols
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        sizes = np.diff(np.append(first, len(token)))
        several = np.minimum.reduceat(comp, first) < np.maximum.reduceat(comp, first)
        pairs = sizes * (sizes - 1) // 2
        for i in np.flatnonzero(several & (pairs > most_pairs)).tolist():
            own = slice(first[i], first[i] + sizes[i])
            yield of_long_list(ids[own], n[own], pos[own], comp[own])
        some = np.flatnonzero(several & (pairs <= most_pairs))
        part = np.cumsum(pairs[some]) // most_pairs
        for lists in np.split(some, np.flatnonzero(np.diff(part)) + 1) if len(some) else ():
            at = np.repeat(first[lists], sizes[lists]) + np.arange(sizes[lists].sum()) - np.repeat(np.cumsum(sizes[lists]) - sizes[lists], sizes[lists])
            yield of_lists(ids[at], n[at], pos[at], comp[at], sizes[lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([np.asarray(c).astype(np.int64) for c in batch.columns])
            if sum(len(x[0]) for x in held) >= chunk:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                end = int(np.flatnonzero(cols[0] == cols[0][-1])[0]) if cols[0][0] != cols[0][-1] else 0
                if end:  # the last list may go on
                    yield from of_chunk([c[:end] for c in cols])
                held = [[c[end:] for c in cols]]
        if held and len(held[0][0]):
            yield from of_chunk([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def classes_and_links(texts: DataFrame, same_id: bool, n_words: int = 5, num: int = 75, den: int = 100, sketch_bits: int = SKETCH_BITS, heavy: int = HEAVY, cell: int = CELL_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of texts (k, doc, text): rows (k, doc, n, s1, s2); classes (n, s1, s2, rep, doc, comp), where doc is
    the smallest of the class and comp names its component. same_id: rows with one doc are linked."""
    sc = small_batches(texts).sparkSession.sparkContext
    first = written(texts.select("k", "doc", "text").mapInArrow(_first_pass(n_words, sketch_bits), FIRST), "first")
    rows = first.where("slice IS NULL").drop("slice", "counts")
    found = first.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(_added, "slice int, counts binary").collect()
    of_slice = {r.slice: np.frombuffer(zlib.decompress(r.counts), np.uint64) for r in found}
    width = (1 << sketch_bits) // SLICES
    sketch = np.concatenate([of_slice.get(i, np.zeros(width, np.uint64)) for i in range(SLICES)])
    shared = sc.broadcast(zlib.compress(sketch.tobytes(), 1))
    mean = int(sketch.sum()) >> sketch_bits

    key = ["n", "s1", "s2"]
    classes = written(rows.where("n > 0").groupBy(*key).agg(F.min("k").alias("rep"), F.min("doc").alias("doc")), "classes")
    links = []
    if same_id:
        member = rows.where("n > 0").join(classes.drop("doc"), key).select("doc", "rep").distinct()
        several = member.groupBy("doc").agg(F.min("rep").alias("u"), F.max("rep").alias("hi")).where("u < hi")
        links.append(written(member.join(several.select("doc", "u"), "doc").select("u", F.col("rep").alias("v")), "links"))

    # Postings of the classes' first shingles.
    postings = classes.agg(F.sum(F.col("n") * (den - num) / den + 1)).first()[0] or 0
    slices = max(1, -(-int(postings) // SLICE_POSTINGS))
    wanted = wanted_of(classes.select("rep"))  # of the members of a class, the one that stands for it
    packed = texts.select("k", "text").mapInArrow(_postings(n_words, num, den, shared, sketch_bits, slices, heavy + 8 * mean, wanted), "slice int, packed binary")
    live = written(packed.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(_shared, LIVE), "live")
    shared.unpersist()

    # Every document against the heads of its lists.
    common = live.where("common").select("token", "id", "n", "pos")
    heads = common.groupBy("token").agg(F.min(F.struct("id", "n", "pos")).alias("head")).selectExpr("token", "head.id AS h", "head.n AS nh", "head.pos AS ph")
    near = live.where("NOT common").select("token", "id", "n", "pos", "h", "nh", "ph").unionByName(common.join(heads, "token"))
    near = near.where(_may_link("h", "nh", "ph", "id", "n", "pos", num, den))
    near = written(near.select("h", "nh", "id", "n").distinct(), "near")
    asking = near.select("h", F.col("h").alias("id"), F.col("nh").alias("n"), F.lit(True).alias("asks")).distinct()
    groups = asking.unionByName(near.select("h", "id", "n", F.lit(False).alias("asks"))).withColumn("comp", F.col("id"))
    links.append(linked(groups, texts, n_words, num, den, cell))
    forget(near)
    comps = components(_all(links))

    # All documents of different components in the neighbourhoods of lists that hold several.
    tagged = live.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    few = tagged.where("NOT common").select("token", "id", "n", "pos", "comp")
    groups = few.repartition("token").sortWithinPartitions("token").mapInArrow(_open_lists(num, den), OPEN)
    many = tagged.where("common").drop("h", "nh", "ph")
    lists = many.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("h"), F.min("n").alias("a"), F.max("n").alias("b")).where("lo < hi")
    many = many.join(lists, "token").where(f"{den}L * n >= {num}L * a AND {num}L * n <= {den}L * b").select("h", "id", "n", "comp")
    groups = groups.unionByName(many).distinct().withColumn("asks", F.lit(True))
    links.append(linked(groups, texts, n_words, num, den, cell))
    merged = components(_all(links))
    out = written(classes.join(merged, F.col("rep") == F.col("id"), "left").select(*key, "rep", "doc", F.coalesce("comp", "rep").alias("comp")), "classes")
    forget(classes, live, comps, merged, *links)
    return rows, out


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def jaccard_components(docs: DataFrame, n_words: int = 5, num: int = 75, den: int = 100, **options) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Two documents link when den * |intersection| >= num * |union| of their sets of n_words-word shingles.
    """
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.col("text").cast("string")
    texts = docs.select(F.xxhash64(doc, text).alias("k"), doc.alias("doc"), text.alias("text"))
    rows, classes = classes_and_links(texts, True, n_words, num, den, **options)
    least = classes.groupBy("comp").agg(F.min("doc").alias("least"))
    placed = classes.join(least, "comp").select("n", "s1", "s2", "least")
    of_doc = rows.where("n > 0").join(placed, ["n", "s1", "s2"]).groupBy("doc").agg(F.min("least").alias("least"))
    null = lambda c: F.when(c != NULL_ID, c)
    out = rows.select("doc", "n").join(of_doc, "doc", "left")
    return out.select(null(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), null(F.coalesce("least", "doc")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs less all but one row of each component: the one with the smallest doc_id stays (null before all; of equal ids, the
    one whose text hashes lowest).

    Here each distinct text under an id is a document of its own, also where the id is null: a 64-bit hash of both is its key.
    Only rows with equal id and equal text are one.
    """
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.col("text").cast("string")
    key, h = F.xxhash64(doc, text), F.xxhash64(text)
    rows, classes = classes_and_links(docs.select(key.alias("k"), doc.alias("doc"), text.alias("text")), False, **options)
    of_key = rows.where("n > 0").join(classes.select("n", "s1", "s2", "comp"), ["n", "s1", "s2"]).select("k", "comp", "doc")
    of_key = of_key.unionByName(rows.where("n = 0").select("k", F.col("k").alias("comp"), "doc"))
    # Where ids are equal the text's hash decides; keys are told apart by the texts' hashes, which only such components need.
    hashed = docs.select(key.alias("k"), h.alias("h")).distinct()
    stays = written(of_key.distinct().join(hashed, "k").groupBy("comp").agg(F.min(F.struct("doc", "h", "k")).alias("m")).select("m.k"), "stays")
    # The key travels beside the row, so that no name of the input's can clash with it.
    all_rows = docs.select(F.struct("*").alias("row"), key.alias("k"))
    first = F.row_number().over(Window.partitionBy("k").orderBy("k"))
    return all_rows.join(stays, "k", "left_semi").withColumn("first", first).where("first = 1").select("row.*")
