"""Mixing sources to target weights.

Every document gets a hash-random key. Its leading bits name a cell, so the cells of one source are consecutive key
ranges of about equal row count: sorting inside cells and adding up the cells before gives the prefix sums of a sort over
the whole source, and no task sees more than one cell, whatever the source's share. Each source is cut where its prefix
sum meets the budget; budgets beyond the source's size repeat it, whole epochs first.

Null texts have size 0, null sources form a source of their own, sorted last. Repeated rows count each for itself (equal
rows swap places freely). An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cell_bits, n_words, small_batches, spread, written

KEY_BITS = 60
BLOCK_BITS = 10


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Rows (skey, source_size, target) from rows (skey, source, source_size), one for each source.

    The level at which weight times level meets the total, with no source above max_epochs times its size, is found in
    closed form: sorted by the level at which each fills up, the first source that the level of all those left does not
    fill fixes it. One task handles one row for each source, never for each document.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", "skey")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    ranked = (
        sizes.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("level", level)
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything))
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    return ranked.select("skey", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, rows_per_cell: int = 2_000) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    skey = F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit("n"))
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    rows = written(narrow.select("*", skey.alias("skey"), spread(F.col("doc_id"), F.col("size")).alias("key")), "mix")
    bits = cell_bits(rows.count(), rows_per_cell)
    rows = rows.withColumn("cell", F.shiftright("key", KEY_BITS - bits))
    cells = rows.groupBy("skey", "cell").agg(F.sum("size").alias("cell_size"), F.first("source").alias("source"))
    sizes = cells.groupBy("skey").agg(F.sum("cell_size").alias("source_size"), F.first("source").alias("source"))
    # Prefix sums over a source's cells in two levels: over blocks of cells, and over the cells of each block.
    cells = cells.withColumn("block", F.shiftright("cell", BLOCK_BITS))
    before_block = Window.partitionBy("skey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("skey", "block").agg(F.sum("cell_size").alias("s")).select("skey", "block", F.coalesce(F.sum("s").over(before_block), F.lit(0)).alias("base"))
    before_cell = Window.partitionBy("skey", "block").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    within = cells.select("skey", "block", "cell", F.coalesce(F.sum("cell_size").over(before_cell), F.lit(0)).alias("inside"))
    offsets = within.join(blocks, ["skey", "block"]).select("skey", "cell", (F.col("base") + F.col("inside")).alias("offset"))
    offsets = offsets.join(source_targets(sizes, weights, share, max_epochs), "skey")
    inside = Window.partitionBy("skey", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["skey", "cell"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a document comes once for each epoch that takes it whole, and the one that
    the budget cuts comes with its first words only. n_chars, if there is such a column, follows the text."""
    takes = mix(small_batches(docs), **options)
    key = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    by = ["k_id", "k_source", "k_size"]
    takes = takes.select(key("doc_id").alias("k_id"), key("source").alias("k_source"), F.col("size").alias("k_size"), "taken")
    takes = takes.groupBy(*by).agg(F.sort_array(F.collect_list("taken")).alias("takes"))
    rows = docs.select(F.struct("*").alias("row"), key("doc_id").alias("k_id"), key("source").alias("k_source"), n_words(F.col("text")).alias("k_size"))
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*by))  # rows that agree in all three share the takes out
    each = rows.join(takes, by).withColumn("taken", F.element_at("takes", turn)).where("taken > 0")
    rest = F.col("taken") % F.col("k_size")
    whole = F.array_repeat(F.col("k_size"), F.floor(F.col("taken") / F.col("k_size")).cast("int"))
    copies = each.select("row", "k_size", F.explode(F.concat(whole, F.when(rest > 0, F.array(rest)).otherwise(F.expr("cast(array() as array<bigint>)")))).alias("limit"))
    cut = copies.withColumn("cut", F.when(F.col("limit") < F.col("k_size"), F.col("limit"))).withColumn("text", F.arrow_udf(_first_words, "string")("row.text", "cut"))
    out = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return cut.select(*[out[c].alias(c) if c in out else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _first_words(texts: pa.Array, limits: pa.Array) -> pa.Array:
    """Each text up to the end of its first limit words; whole where there is no limit."""
    out = []
    for t, n in zip(texts, limits, strict=True):
        t = t.as_py()
        if n.is_valid:
            t = t[: next(itertools.islice(re.finditer(WORD, t), n.as_py() - 1, None)).end()]
        out.append(t)
    return pa.array(out, pa.string())


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~') || ':' || size::VARCHAR), 1, 15))::BIGINT AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
r AS (SELECT *, 2 * source_size AS cap, 2 * source_size / w AS ratio FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT min_by(lev, ratio) FROM l WHERE lev <= ratio) * w, cap::DOUBLE)) AS target FROM l),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM p
"""
