import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, WORD, docs
from weftgraph.llm import extraction, labelledpages, pieces, quality, tokencount, winnowing
from weftgraph.llm.queries import tokenizer_path
from weftgraph.llm.textscan import WINDOW, words


def fuzz(seed, n, alphabet="abcdefgstrvelm'''  \n\t!?.,-…123٣éßΣσİ中文字한글́  \x1f\x85🙂👍▁<|endoftext|>'re've'll'd_%"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def repeats_by_hand(w):
    n, out = len(w), []
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def quality_by_hand(text, least):
    w = WORD.findall(text or "")
    m = repeats_by_hand(w)
    span = lambda k, length: len({i for s, x in enumerate(m) if x >= k for i in range(s, s + length(x))})
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), span(3, lambda x: 3), span(least, lambda x: x), max([x for x in m if x > 1], default=0)


def test_quality(spark, monkeypatch):
    monkeypatch.setattr(quality, "BATCH_BYTES", 300)
    rnd = random.Random(3)
    rows = [r for r in ODD if r[0] != 11] + [(200 + i, rnd.choice((" ", "\n")).join(rnd.choice("abcd") for _ in range(rnd.randint(0, 70))) + "#<é") for i in range(25)]
    rows += [(300, "same words again " * 30), (301, " ".join(f"w{i}" for i in range(80)))]
    frame = docs(spark, rows).selectExpr("*", "1 as quality")
    got = quality.with_quality(frame, min_repeat=4).collect()
    want = Counter((r[0], *quality_by_hand(r[1], 4)) for r in rows)
    assert Counter((r.doc_id, *(r.quality[f] for f in quality.FIELDS)) for r in got) == want
    kept = {r.doc_id: (r.quality.base_failed, r.quality.kept) for r in got}
    assert kept[300] == (True, False) and kept[301] == (False, True) and kept[2] == (True, False)
    assert quality.with_quality(docs(spark, [])).count() == 0


def test_quality_of_a_long_text(spark):
    (r,) = quality.with_quality(docs(spark, [r for r in ODD if r[0] == 11])).collect()
    assert r.quality.n_words == 40_000 and r.quality.longest_repeat == 39_998 and not r.quality.kept


def test_words_longer_than_a_window():
    text = b"a " + b"x" * (2 * WINDOW + 5) + b" b " + b"x" * (2 * WINDOW + 5) + b" c"
    h, s, e = words(np.frombuffer(text, np.uint8))
    assert [text[a:b] for a, b in zip(s, e, strict=True)] == text.split() and h[1] == h[3] and len(set(h.tolist())) == 4


def test_token_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    vocabulary = [v.replace("</w>", "") for v in json.load(open(path, encoding="utf-8"))["model"]["vocab"]]
    rnd = random.Random(1)
    texts = fuzz(1, 1500) + ["".join(rnd.choice(vocabulary) for _ in range(6)) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|endoftext|>b<|startoftext|>", "'s't're", "x'rx 'l 'll 'v 've", "don't DON'T", "a" * 5000, "ab " * 1000, ""]
    rows = ODD + [(1000 + i, t) for i, t in enumerate(texts)]
    got = tokencount.with_token_counts(docs(spark, rows).selectExpr("*", "'x' as n_tokens"), path)
    want = Counter((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter(map(tuple, got.select("doc_id", "n_tokens").collect())) == want
    assert tokencount.with_token_counts(docs(spark, []), path).count() == 0


def test_token_counts_across_segments(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    monkeypatch.setattr(tokencount, "SEGMENT", 400)
    counter = tokencount.Counter(json.load(open(path, encoding="utf-8")), max_words=50)
    texts = ["word's and 'll run " * 60, "x" * 1000 + " y", "\n".join(fuzz(7, 40)), "a b"]
    assert counter.counts(texts).tolist() == [len(e.ids) for e in tokenizers.Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_pieces(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(1)
    vocabulary = [library.id_to_piece(i).replace("▁", " ") for i in range(32_000)]
    texts = fuzz(2, 1500) + ["".join(rnd.choice(vocabulary) for _ in range(6)) for _ in range(1500)]
    texts += ["".join(rnd.choice("abcdeéß中文字한글🙂") for _ in range(n)) for n in (31, 32, 33, 65, 600, 5000)]
    texts += ["<s>", "</s>", "<unk>", "a" * 3000, " " * 300 + "x", "    " * 3 + "a", "", " ", "x▁▁y", "\n\n\n   \n"]
    rows = ODD + [(1000 + i, t) for i, t in enumerate(texts)]
    got = pieces.decode(pieces.encode(docs(spark, rows).selectExpr("*", "1 as pieces"), path), path)
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in got.collect():
        assert list(r.pieces) == library.encode(text_of[r.doc_id]) and r.decoded == text_of[r.doc_id].replace("▁", " ")
    assert pieces.encode(docs(spark, []), path).count() == 0


def winnow_by_hand(text, k, w):
    """The rightmost smallest hash of every window, from the same hashes."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h = winnowing._hashes(codes, k).tolist()
    w = min(w, len(h))
    picked = {max(range(i, i + w), key=lambda j: (-h[j], j)) for i in range(len(h) - w + 1)}
    return [(h[j], j) for j in sorted(picked)]


def test_winnow(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab é🙂") for _ in range(n)) for n in (8, 9, 20, 200, 700)] + ["a" * 300, "abcabc" * 60]
    for segment in (1 << 19, 64):
        monkeypatch.setattr(winnowing, "SEGMENT", segment)
        for t in texts:
            h, at = winnowing.winnow(t, 8, 12)
            assert list(zip(h.tolist(), at.tolist(), strict=True)) == winnow_by_hand(t, 8, 12)
    shared = "".join(rnd.choice("abcdefgh") for _ in range(8 + 12 - 1))
    for _ in range(20):
        a, b = ("".join(rnd.choice("abcdefgh") for _ in range(50)) for _ in "ab")
        (ha, pa), (hb, pb) = (winnowing.winnow(x + shared + x, 8, 12) for x in (a, b))
        inside = lambda h, p: {(x, y - 50) for x, y in zip(h.tolist(), p.tolist(), strict=True) if 50 <= y <= 50 + 11}
        assert inside(ha, pa) & inside(hb, pb)


@pytest.mark.parametrize("rows", [ODD[:3] + ODD[5:], [(1, "only one")], [(None, "x"), (None, "yy")]])
def test_edited_pairs(spark, rows):
    frame = docs(spark, rows).selectExpr("*", "1 as part", "2 as packed")
    got = winnowing.edited_pairs(frame).collect()
    assert len(got) == len(rows)
    known = [r for r in rows if r[0] is not None]
    if len({r[0] for r in rows}) == len(rows):
        order = sorted(known, key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
        for r, n in zip(order, order[1:] + order[:1], strict=True):
            (g,) = [g for g in got if g.doc_id == r[0]]
            t, nt = r[1] or "", n[1] or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + nt[:half]
            assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert g.fingerprint == winnowing.as_string(*winnowing.winnow(t)) and g.edited_fingerprint == winnowing.as_string(*winnowing.winnow(edited))
            assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1


def test_edited_pairs_over_many_rows_and_none(spark):
    rows = [(i * 3 % 1009, f"text {i} " * 3) for i in range(1009)]
    got = {r.doc_id: r.edited_sha256 for r in winnowing.edited_pairs(docs(spark, rows)).collect()}
    text = dict(rows)
    for i in range(1009):
        t, n = text[i], text[(i - 1) % 1009]
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
    assert winnowing.edited_pairs(docs(spark, [])).count() == 0
    (r,) = winnowing.with_fingerprint(docs(spark, [(1, "a" * 500)]).selectExpr("*", "1 as winnowed")).collect()
    assert len(r.winnowed.hashes) == len(r.winnowed.positions) > 0


def test_half_equal_texts_of_any_length_are_alike():
    rnd = random.Random(8)
    make = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz 中文字") for _ in range(n))
    for n in (*range(1, 300), 1000):
        for m in (0, 3, n // 2, n, 5 * n):
            text, following = make(n), make(m)
            h, at = winnowing.winnow(text)
            row = winnowing._row((1, text, 0, 0, h, at), following, winnowing.winnow(following)[0], winnowing.K, None)
            assert 0 < row[5] <= 1, (n, m)
        if n >= 60:  # half-equal texts share hashes in the stored fingerprints too, if the half is K long
            edited = text[: n - n // 2] + make(n // 2)
            assert set(h.tolist()) & set(winnowing.winnow(edited)[0].tolist())


PAGE = "<html><head><title>T</title><script>var t='<p>no</p>';</script></head><body><nav><ul><li><a href=/>Menu</a></li></ul></nav>{}<footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>One\n  two&nbsp;three.</p><p>Four.</article>", "A & B\nOne two three.\nFour."),
        ("<article><h1>Title</h1><p><b>Bold text here.<br><p>More text here.</p></article>", "Title\nBold text here.\nMore text here."),
        ("<div class=\"ad\">Buy this now please.</div><article><p>Real text of it.</p><!-- <p>hidden --><p>And the end.</p></article>", "Real text of it.\nAnd the end."),
        ("<article><p>Kept to the end of a cut pa", "Kept to the end of a cut pa"),
        ("", ""),
    ],
)
def test_extraction(body, text):
    page = PAGE.format(body)
    if "cut pa" in body:
        page = page[: page.index("<footer>")]
    assert extraction.main_text(page, extraction.model()) == text


@pytest.mark.parametrize("n", [12, 300])
def test_letters_that_lower_makes_longer_move_no_end_tag(n):
    from weftgraph.llm.dom import blocks

    page = "<p>" + "\u0130" * n + "</p><SCRIPT>var a;</Script>some words here<script>var b;</SCRIPT><p>more</p>"
    assert [b.text for b in blocks(page)] == ["\u0130" * n, "some words here", "more"]


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ("<p>The value is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> exactly so.</p><p>And on.</p>", "The value is x=2 exactly so.\nAnd on."),
        ("<p>A film: <object data=x><param name=a>no player here</object> was shown.</p><p>And on.</p>", "A film: no player here was shown.\nAnd on."),
        ("<p>Type this text:</p><xmp>a <b> &amp; c</xmp><p>And on with it.</p>", "Type this text:\na <b> &amp; c\nAnd on with it."),
        ("<p>One choice <select><option>red<option>blue</p><p>The text goes on here.</p><p>And here.</p>", "One choice\nThe text goes on here.\nAnd here."),
        ("<p>Math <math><mi>y</p><p>never ends here.</p><p>And on.</p>", "Math y\nnever ends here.\nAnd on."),
        ("<p>An <b>open <i>crossed</b> end</i> of tags.</p><p>And on.</p>", "An open crossed end of tags.\nAnd on."),
    ],
)
def test_text_inside_of_special_elements(inside, text):
    assert extraction.main_text(PAGE.format(f"<article>{inside}</article>"), extraction.model()) == text


@pytest.mark.parametrize("open_tags", ["<ul><li>", "<div>x ", "<div class=c{i}>y ", "<b><i></b>", "<p><b>", "<select>", "<a <b"])
def test_deep_pages_take_time_in_proportion(open_tags):
    import time

    from weftgraph.llm.dom import blocks

    page = "".join(open_tags.replace("{i}", str(i)) for i in range(1_000_000 // len(open_tags)))
    began = time.process_time()
    crf = extraction.model()
    began = time.process_time()
    crf.decode(extraction.features(blocks(page, crf.names)))
    assert time.process_time() - began < 30


def test_whole_texts_of_held_out_pages():
    crf = extraction.model()
    pages = labelledpages.labelled_pages(200, seed=123)
    whole = [(page, marked) for page, marked in pages if len(extraction.blocks(page)) == len(marked)]
    right = sum(extraction.main_text(page, crf) == "\n".join(t for t, label in marked if label) for page, marked in whole)
    assert len(whole) > 150 and right / len(whole) > 0.8


def test_extraction_on_held_out_pages():
    crf = extraction.model()
    right = total = 0
    for feats, labels in extraction.examples(labelledpages.labelled_pages(200, seed=99)):
        right += sum(a == b for a, b in zip(crf.decode(feats), labels, strict=True))
        total += len(labels)
    assert total > 3000 and right / total > 0.985


def test_extraction_of_odd_pages(spark):
    odd = [None, "", "   ", "no tags at all", "<p", "<!-- open", "<script>x", "</p></p><div>", "a<b>b</i>c", "<table><tr><td>x<td>y", "&am &amp &#8364; &#x41;", "<a <b>>", "<p>" * 3000]
    frame = spark.createDataFrame([(i, x, "u") for i, x in enumerate(odd)], "page_id long, html string, text string")
    got = extraction.extract(frame)
    assert got.count() == len(odd) and got.where("text is null").count() == 0 and got.columns == ["page_id", "html", "text"]
    assert extraction.extract(frame.where("false")).count() == 0


def test_viterbi_finds_the_likeliest_labels():
    from itertools import product

    from weftgraph.llm.crf import Crf

    rnd = random.Random(4)
    crf = Crf({f"f{i}": rnd.uniform(-2, 2) for i in range(6)}, ((0.3, -0.7), (-0.4, 0.9)), (0.5, -0.5))
    for _ in range(20):
        seq = [[f"f{rnd.randrange(8)}" for _ in range(3)] for _ in range(rnd.randint(1, 7))]
        score = lambda ys: crf.start[ys[0]] + sum(crf.weights.get(f, 0) for fs, y in zip(seq, ys, strict=True) if y for f in fs) + sum(crf.step[a][b] for a, b in zip(ys, ys[1:], strict=False))  # noqa: B023, E731
        assert score(crf.decode(seq)) == pytest.approx(max(map(score, product((0, 1), repeat=len(seq)))))
