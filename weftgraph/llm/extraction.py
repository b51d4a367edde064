"""HTML extraction: a linear-chain conditional random field over the leaf blocks of the page.

A tolerant parser cuts the page into leaf blocks (dom.py); open elements, words in their class names and the text's shape are
the features; the field (crf.py) is trained on labelled pages (labelledpages.py: TRAINING pages of a fixed seed, the bound of
the sample) and Viterbi decoding labels all blocks of a page together.

Null and empty pages, and pages without text, give an empty text. Pages of any length are parsed whole. Repeated rows get
equal texts. An empty table gives an empty result. Other columns pass through; the added column is replaced if it exists.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .crf import Crf, train
from .dom import blocks, features
from .labelledpages import labelled_pages

TRAINING, SEED = 600, 7


def examples(pages: list[tuple[str, list[tuple[str, int]]]]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the blocks that the parser finds; blocks that a cut page has lost in part are left out."""
    out = []
    for page, marked in pages:
        found = blocks(page)
        if [b.text for b in found] == [t for t, _ in marked[: len(found)]]:
            out.append((features(found), [label for _, label in marked[: len(found)]]))
    return out


@functools.lru_cache(maxsize=2)
def model(training: int = TRAINING, seed: int = SEED) -> Crf:
    return train(examples(labelled_pages(training, seed)))


def main_text(page: str | None, crf: Crf) -> str:
    """The article's blocks, each with single spaces, joined by line feeds."""
    found = blocks(page, crf.names)
    return "\n".join(b.text for b, label in zip(found, crf.decode(features(found)), strict=True) if label)


def extract(pages: DataFrame, crf: Crf | None = None, into: str = "text") -> DataFrame:
    """pages with the main text of html."""
    shared = pages.sparkSession.sparkContext.broadcast(crf or model())

    @F.arrow_udf("string")
    def extracted(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), shared.value) for x in column], pa.string())

    return small_batches(pages).withColumn(into, extracted("html"))
