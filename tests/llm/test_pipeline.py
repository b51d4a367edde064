"""The pipeline's rows against its stages done by hand over the smallest documents."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.helpers import LINE, ODD, WORD, docs
from tests.llm.test_lines_and_near import components_by_hand, lines_by_hand
from tests.llm.test_mix_shard_secrets import targets_by_hand
from weftgraph.llm.common import written
from weftgraph.llm.queries import tokenizer_path


def repeated(words, n):
    """The places of the n-word windows that occur more than once."""
    seen = defaultdict(list)
    for i in range(len(words) - n + 1):
        seen[tuple(words[i : i + n])].append(i)
    return [i for places in seen.values() if len(places) > 1 for i in places]


def good(text):
    words = WORD.findall(text or "")
    covered = lambda n: len({j for i in repeated(words, n) for j in range(i, i + n)})
    failed = len(words) < 50 or 100 * covered(3) > 50 * len(words)
    return not failed and covered(8) <= 0.3 * len(words) and not repeated(words, 201)


def mixed(rows):
    size = lambda t: len(WORD.findall(t or ""))
    by_source = defaultdict(list)
    for r in rows:
        key = int(hashlib.md5(f"{r[0]}:{size(r[1])}".encode()).hexdigest()[:15], 16)
        by_source[r[3]].append((key, r[0], size(r[1]), r))
    sizes = {s: sum(x[2] for x in v) for s, v in by_source.items()}
    target = targets_by_hand(sizes)
    for source, own in by_source.items():
        budget, before = int(target[source] + 0.5), 0
        epochs = budget // sizes[source] if sizes[source] else 0
        for _, _, n, r in sorted(own, key=lambda x: x[:3]):
            taken = epochs * n + max(0, min(n, budget - epochs * sizes[source] - before))
            before += n
            yield from [r] * (taken // n if n else 0)
            if n and taken % n:
                end = [m.end() for m in re.finditer(WORD.pattern, r[1])][taken % n - 1]
                yield (r[0], r[1][:end], *r[2:])


def pipeline_by_hand(rows):
    rows = [r for r in rows if good(r[1])]
    kept = lines_by_hand(rows)
    assert len(kept) == len(rows)
    text = {i: t for i, _, _, t in kept}
    rows = [(r[0], text[r[0]], *r[2:]) for r in rows]
    alone = {i for i, _, top in components_by_hand(rows) if i == top}
    return list(mixed([r for r in rows if r[0] in alone]))


def test_pipeline_by_hand(spark, data):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    frame = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source")
    want = Counter((r[0], r[2], r[3], tuple(library.encode(r[1]))) for r in pipeline_by_hand([tuple(r) for r in frame.collect()]))
    got = Counter((r.doc_id, r.lang, r.source, tuple(r.pieces)) for r in C.run(spark, data).collect())
    assert got == want and 50 < len(got) < 200


def test_every_stage_keeps_the_columns_and_tells_the_length(spark, data):
    frame = spark.read.parquet(f"{data}/documents.parquet")
    columns = frame.columns
    for name, stage in C.STAGES[:-1]:
        frame = written(stage(spark, frame, data), "test")
        assert frame.columns == columns and frame.where("n_chars <> char_length(text)").count() == 0, name


def test_stages_in_a_row_over_odd_rows(spark):
    """Nulls, empty texts, ties and repeated rows pass all stages; of what the rules keep nothing is lost but what a stage drops."""
    long = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [*ODD, (50, long("a") + f"\n{LINE}", "s"), (50, long("a") + f"\n{LINE}", "s"), (None, long("b"), None), (None, long("c"), None), (51, long("d"), None), (52, long("d") + " more", "t")]
    frame = docs(spark, rows).selectExpr("*", "1 as k", "2 as quality", "3 as pos", "4 as taken", "'x' as pieces")
    for i, (_, stage) in enumerate(C.STAGES[:-1]):
        frame = written(stage(spark, frame, ""), f"odd{i}")
    left = Counter(r.doc_id for r in frame.collect())
    assert set(left) == {50, None, 51} and left[None] >= 2
    last = C.STAGES[-1][1](spark, frame, "")
    assert last.where("n_pieces <> size(pieces)").count() == 0 and last.count() == frame.count()
    empty = frame.where(F.lit(False))
    for _, stage in C.STAGES:
        empty = written(stage(spark, empty, ""), "empty")
        assert empty.count() == 0
