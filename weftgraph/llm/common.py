"""What the training-data operators share: written tables, the word pattern, hash keys and the size of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import scratch
from ..plans.scratch import forget  # noqa: F401

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and outlives lost executors."""
    return scratch.written(df, name)


def small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """df, with the session set to send at most so many rows (and at most 8 MiB) to Python at a time: a worker's memory then
    depends on the length of its texts, not on the size of its partition. Spark has no such setting for a single plan, so this
    one stays with the session; it changes no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, rows)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    return df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def cell_bits(rows: int, per_cell: int) -> int:
    """Bits of a uniform hash that split so many rows into cells of about per_cell rows."""
    return max(0, (max(rows, 1) // per_cell).bit_length())


def spread(*parts: Column) -> Column:
    """A uniform 60-bit integer that depends on the parts' text alone."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")
