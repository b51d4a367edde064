import random
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.llm.helpers import LINE, ODD, WORD, docs
from weftgraph.llm import linededup, nearjoin
from weftgraph.llm.components import components

BLANKS = " \t\n\x0b\x0c\r"


def lines_by_hand(rows, min_chars=40, min_docs=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(BLANKS).translate(low)
    held = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(r[0])
    order = lambda i: -(2**63) if i is None else i
    stays = {k: max(v, key=order) for k, v in held.items() if len(v) >= min_docs}
    out = Counter()
    for r in rows:
        own = (r[1] or "").split("\n")
        kept = [x for x in own if key(x) not in stays or stays[key(x)] == r[0]]
        out[r[0], len(own), len(own) - len(kept), None if r[1] is None else "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize(("block_lines", "block_bits", "max_blocks"), [(1, 3, 256), (1 << 17, 20, 256), (3, 6, 0), (1 << 17, 20, 0)])
def test_line_dedup(spark, block_lines, block_bits, max_blocks):
    got = linededup.dedup_lines(docs(spark, ODD), block_lines=block_lines, block_bits=block_bits, max_blocks=max_blocks)
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect())) == lines_by_hand(ODD)


@pytest.mark.parametrize("max_blocks", [0, 256])
def test_line_dedup_keeps_other_columns(spark, max_blocks):
    frame = docs(spark, ODD).selectExpr("*", "source as `key`", "1 as n_lines", "2 as pos", "'x' as gone")
    got = linededup.dedup_lines(frame, max_blocks=max_blocks)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "pos", "gone", "n_lines", "n_dropped"]
    assert got.where("pos = 2 and gone = 'x' and key <=> source").count() == len(ODD)
    assert linededup.dedup_lines(frame.where("false"), max_blocks=max_blocks).count() == 0


def test_lines_of_random_texts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from weftgraph.llm import textscan

    rnd = random.Random(11)
    texts = [None if rnd.random() < 0.1 else "".join(rnd.choice("ab é🙂 \n\t\r") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    monkeypatch.setattr(linededup, "SLICE_BYTES", 100)
    monkeypatch.setattr(textscan, "WINDOW", 64)
    seen, want = {}, {(i, k, x.strip(BLANKS)) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if len(x.strip(BLANKS)) >= 2}
    got = set()
    for row, place, starts, ends, hashes, data in linededup._long_lines(pa.array(texts), 2):
        for r, p, a, b, h in zip(row, place, starts, ends, hashes, strict=True):
            line = data[a:b].tobytes().decode()
            got.add((int(r), int(p), line))
            assert seen.setdefault(line, int(h)) == int(h)
    assert got == want and len(set(seen.values())) == len(seen)
    assert np.all(np.diff(np.fromiter((r for r, _, _ in sorted(got)), int)) >= 0)


def components_by_hand(rows, num=75, den=100):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(low))
        sets.append((r[0], {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i != j and a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)), key=lambda v: -(2**63) if v is None else v)
                parent[y] = x
    return Counter((i, len(s), find(i)) for i, s in sets)


def near_rows(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    rows, doc = [], 0
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((3, 5, 12, 60, 150)))]
        for _ in range(rnd.choice((1, 1, 3, 8))):
            words = list(base)
            for _ in range(rnd.choice((0, 0, 1, 2, 3))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                words += passage
            rows.append((doc, rnd.choice((" ", "\n")).join(words).capitalize()))
            doc += 1
    return rows


@pytest.mark.parametrize(("seed", "heavy", "cell"), [(0, -100, 60), (1, 1 << 14, 1 << 18)])
def test_jaccard_join(spark, seed, heavy, cell):
    rows = near_rows(seed) + ([(r[0] if r[0] is None else r[0] + 1000, *r[1:]) for r in ODD] if seed else [])
    got = nearjoin.jaccard_components(docs(spark, rows), heavy=heavy, sketch_bits=10, cell=cell)
    assert Counter(map(tuple, got.collect())) == components_by_hand(rows)


def test_jaccard_join_empty_and_one_of_each(spark):
    frame = docs(spark, [(3, LINE), (1, LINE), (2, LINE + " more"), (2, LINE + " more"), (9, ""), (9, "")]).selectExpr("*", "7 as k", "8 as first", "9 as h")
    assert nearjoin.jaccard_components(frame.where("false")).count() == 0
    kept = nearjoin.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 9]


def test_one_of_each_keeps_each_text_under_null_and_repeated_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (1, text("b") + " more"), (2, text("c")), (2, text("d")), (3, text("d") + " more"), (4, text("e")), (None, None), (5, None)]
    kept = [(r.doc_id, r.text) for r in nearjoin.one_of_each(docs(spark, rows)).collect()]
    assert Counter(kept) == Counter([rows[0], rows[1], rows[4], rows[5], rows[7], rows[8], rows[9]])


def test_divide_skip_against_sets(monkeypatch):
    import numpy as np

    rnd = random.Random(5)
    for _ in range(60):
        query = np.array(sorted(rnd.sample(range(80), rnd.randint(1, 40))), np.uint64)
        cands = [np.array(sorted(rnd.sample(query.tolist() + list(range(80, 100)), rnd.randint(1, len(query)))), np.uint64) for _ in range(12)]
        want = [i for i, c in enumerate(cands) if 100 * len({*query.tolist()} & {*c.tolist()}) >= 75 * len({*query.tolist()} | {*c.tolist()})]
        for limit in (0, 2048):
            monkeypatch.setattr(nearjoin, "HEAP_LIMIT", limit)
            assert nearjoin.divide_skip(query, nearjoin.Lists(cands), np.ones(len(cands), bool), 75, 100) == want


@pytest.mark.parametrize(("chunk", "most"), [(1, 1), (7, 3), (1 << 16, 1 << 20)])
def test_open_lists_leave_out_nobody_with_a_partner(chunk, most):
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(9)
    rows = sorted((rnd.randrange(30), i, n := rnd.randint(4, 40), rnd.randrange(n), rnd.randrange(5)) for i in range(300))
    may = lambda x, y: x[0] == y[0] and x[4] != y[4] and 4 * min(x[2], y[2]) >= 3 * max(x[2], y[2]) and 7 * min(x[2] - x[3], y[2] - y[3]) >= 3 * (x[2] + y[2])
    batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*rows[at : at + 11], strict=True)], ["token", "id", "n", "pos", "comp"]) for at in range(0, 300, 11)]
    got = {(h, i): (n, c) for b in nearjoin._open_lists(75, 100, chunk, most)(iter(batches)) for h, i, n, c in zip(*(x.to_pylist() for x in b.columns), strict=True)}
    want = {(x[1], y[1]) for x in rows for y in rows if may(x, y)}
    assert {i for _, i in got} == {i for i, _ in want}
    under = defaultdict(set)
    for h, i in got:
        under[i].add(h)
        assert got[h, i] == next((x[2], x[4]) for x in rows if x[1] == i)
    assert all(under[a] & under[b] for a, b in want)


def test_short_forms_find_all_links_and_margins():
    import numpy as np

    rnd = np.random.default_rng(3)
    base = np.unique(rnd.integers(0, 2**63, 400, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[: 400 - k], rnd.integers(0, 2**63, k, dtype=np.uint64)))) for k in range(0, 120, 4)]
    flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    short = nearjoin.narrowed(flat, starts)
    wide = [nearjoin.widened(short[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    everyone = np.ones(len(sets), bool)
    for i in range(len(sets)):
        margins, exact = [], []
        found = nearjoin.divide_skip(wide[i], nearjoin.Lists(wide), everyone, 75, 100, margins)
        assert found == nearjoin.divide_skip(sets[i], nearjoin.Lists(sets), everyone, 75, 100, exact) and margins == exact and margins
    same = np.array([5, 5, 5, 7], np.uint32)  # forms that meet inside a set still count one by one
    assert len(np.intersect1d(nearjoin.widened(same), nearjoin.widened(np.array([5, 5, 7, 7], np.uint32)))) == 3


def test_links_close_to_the_limit_are_fewer_than_documents():
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 2**63, 128, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base, rnd.integers(0, 2**63, 20, dtype=np.uint64)))) for _ in range(60)]
    packed = [nearjoin.narrowed(s, np.array([0, len(s)])).tobytes() for s in sets]
    n = len(sets)
    cell = pa.table({"h": [7] * n, "id": list(range(n)), "comp": list(range(n)), "part": [0] * n, "asks": [True] * n, "shingles": pa.array(packed, pa.binary())})
    found = nearjoin._search(75, 100, True)(cell).to_pylist()
    assert len(found) == n - 1 and not any(x["sure"] for x in found) and {x["h"] for x in found} == {7}


def test_forms_that_meet_by_chance_hide_no_link(spark):
    import numpy as np
    import pyarrow as pa

    def forms(texts):
        flat, starts = (np.concatenate([x[i] if i == 1 else np.diff(x[2]) for x in nearjoin._sets(pa.array(texts), 5)]) for i in (1, 2))
        starts = np.concatenate(([0], np.cumsum(starts)))
        return [nearjoin.narrowed(flat[a:b], np.array([0, b - a])) for a, b in zip(starts[:-1], starts[1:], strict=True)]

    one = [f"q{i} r s t u" for i in range(300_000)]
    short = np.concatenate(forms(one))
    by = np.argsort(short, kind="stable")
    at = np.flatnonzero(short[by][1:] == short[by][:-1])[0]
    common = " ".join(f"w{i}" for i in range(27))
    texts = [f"{common} {one[by[at]]}", f"{common} {one[by[at + 1]]}", common]
    a, b, c = (nearjoin.widened(x) for x in forms(texts))
    assert len(np.intersect1d(a, b)) == 24 and len(c) == 23  # 23 in truth, where 24 are needed
    groups = spark.createDataFrame([(0, i, 28 if i < 2 else 23, i, True) for i in range(3)], "h long, id long, n int, comp long, asks boolean")
    links = nearjoin.linked(groups, spark.createDataFrame(list(enumerate(texts)), "k long, text string"), 5, 75, 100)
    found = {tuple(sorted(x)) for x in links.collect()}
    assert found == {(0, 2), (1, 2)}


def test_copies_that_the_filter_lets_through_hide_no_class(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "WANTED_BITS", (3, 3))  # nearly everything passes
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(40)] + [(i, " ".join([*base, "more"])) for i in range(40, 80)]
    got = nearjoin.jaccard_components(docs(spark, rows))
    assert Counter(map(tuple, got.collect())) == Counter((i, 56 + (i >= 40), 0) for i in range(80))


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 110)] + [(5, 5)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 110)}}


def test_line_sql_agrees(spark, data):
    from weftgraph.llm import queries

    got = queries.op1_line_dedup(spark, data)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{data}/documents.parquet'")
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == sorted(c.sql(linededup.ORACLE).fetchall())
