"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing to target weights, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. All but the last return the
columns of documents; the next stage reads them from a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import linededup, mixing, nearjoin, pieces, quality
from weftgraph.llm.common import forget, written
from weftgraph.llm.queries import tokenizer_path

#: SQL cannot express suffix arrays, components or piece encoding; tests/llm/test_pipeline.py does all stages by hand.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.with_quality(docs).where("quality.kept").drop("quality")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all but one document; n_chars follows the text."""
    out = linededup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays."""
    return nearjoin.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's budget takes them; the one at the cut comes in part."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and the piece ids of every text."""
    out = pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage{i}")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
