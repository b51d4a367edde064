"""Secret scans through an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its bytes. The ledger holds, for each blob and version of the
rules, the spans found; Ledger keeps it in a folder. A scan looks at pairs of blob and rule version that the ledger lacks, each
once however many paths hold it, and findings are joined back to all paths. DataFrame and SQL functions only.

Null texts are empty blobs, which have no findings. Repeated rows and copies share a blob. An empty table gives an empty
result. Other columns of the input are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import file_system
from .common import written

# The base rules as (kind, pattern, group that is measured, least length of it).
BASE = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
# Rules beyond the base, in the same form.
MORE = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
RULES_VERSION = "1"
#: A text without one of these strings cannot hold a match of the rule.
NEEDS = {"assign": (":", "="), "access": ("AKIA",), "pem": ("PRIVATE KEY-----",), "jwt": ("eyJ",), "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")}
NO_SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


def spans_of(text: Column, no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kind_no, kind, end) of one rule's leftmost non-overlapping matches whose group is long enough.

    split() gives the gaps between the same matches that regexp_extract_all() gives, so running sums of both lengths are
    the positions.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda g: F.char_length(g)) if group else F.transform(found, lambda g: F.char_length(g))
    parts = F.zip_with(F.zip_with(gaps, F.transform(found, lambda g: F.char_length(g)), lambda g, m: F.struct(g.alias("gap"), m.alias("len"))), measured, lambda p, m: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), m.alias("m")))
    parts = F.filter(parts, lambda p: p["len"].isNotNull())

    def step(acc, p):
        start = acc["at"] + p["gap"]
        span = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), (start + p["len"]).alias("end"))
        return F.struct((start + p["len"]).alias("at"), F.when(p["m"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.expr(f"cast(array() as {NO_SPANS})")
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    may = F.lit(False)
    for s in NEEDS.get(kind, ()):
        may = may | F.contains(text, F.lit(s))
    has = F.regexp_instr(text, F.lit(pattern)) > 0
    return F.when((may & has) if kind in NEEDS else has, spans).otherwise(none)


def empty_ledger(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], f"blob string, rules string, spans {NO_SPANS}")


class Ledger:
    """The ledger as an append-only table in a folder, by version of the rules. A scan that is run again adds nothing twice."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        schema = f"blob string, spans {NO_SPANS}, rules string"
        fs, p = file_system(self.spark, self.path)
        found = self.spark.read.schema(schema).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], schema)
        return found.select("blob", "rules", "spans")

    def append(self, entries: DataFrame) -> None:
        entries.write.mode("append").partitionBy("rules").parquet(self.path)

    def scan(self, docs: DataFrame, rules: tuple | None = None, version: str | None = None) -> DataFrame:
        """The findings of docs; what had to be scanned for them is in the ledger afterwards."""
        findings, entries = scan(docs, self.read(), rules or BASE + MORE, version or RULES_VERSION)
        self.append(entries)
        return findings


def blobs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, blob): the content address of every path's text."""
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple = BASE + MORE, version: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of every path, entries to add to the ledger).

    Findings: doc_id, blob, spans sorted by start and rule. Entries: blob, rules (the version), spans, one for each blob
    that the ledger lacks under this version, with an empty array if clean; append them to the ledger's table.
    """
    paths = written(blobs_of(docs), "paths")
    known = (ledger if ledger is not None else empty_ledger(docs)).where(F.col("rules") == version)
    # Copies are reduced to one path before the exchange, so a blob that a third of all paths hold is no hot key.
    unseen = paths.groupBy("blob").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit(-(2**63)))).alias("doc_id")).join(known, "blob", "left_anti")
    text = F.coalesce(F.col("t.text"), F.lit(""))
    fresh = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("blob", F.sha2("text", 256))
        .alias("t")
        .join(unseen.alias("u"), F.col("t.doc_id").eqNullSafe(F.col("u.doc_id")) & (F.col("t.blob") == F.col("u.blob")), "left_semi")
    )
    lists = [spans_of(text, i, *r) for i, r in enumerate(rules)]
    # The same blob comes twice only where one doc_id repeats with the same text.
    entries = fresh.select(F.col("t.blob").alias("blob"), F.lit(version).alias("rules"), F.array_sort(F.flatten(F.array(*lists))).alias("spans")).dropDuplicates(["blob"])
    entries = written(entries, "ledger")
    findings = paths.join(known.select("blob", "spans").unionByName(entries.select("blob", "spans")), "blob").select("doc_id", "blob", "spans")
    return findings, entries


def digest(findings: DataFrame, base: int = len(BASE)) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (joined kind:start:end) of scan()'s findings."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    own = F.filter("spans", lambda s: s["kind_no"] < base)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind, *_ in BASE]
    return findings.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The base columns for the BASE rules and the joined spans for all rules, in DuckDB SQL."""
    one = """
  SELECT doc_id, {no} AS kind_no, '{kind}' AS kind, start, start + len AS stop FROM (
    SELECT doc_id, m, len, g, (sum(gap + len) OVER (PARTITION BY doc_id ORDER BY i) - len)::BIGINT AS start FROM (
      SELECT doc_id, i, length(gaps[i]) AS gap, length(ms[i]) AS len, ms[i] AS m, gs[i] AS g FROM (
        SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, gaps, ms, gs FROM (
          SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms,
            regexp_extract_all(text, '{pattern}', {group}) AS gs
          FROM documents WHERE regexp_matches(text, '{pattern}'))))) WHERE length(g) >= {least}"""
    parts = [one.format(no=i, kind=k, pattern=p.replace("'", "''"), group=g, least=n) for i, (k, p, g, n) in enumerate(BASE + MORE)]
    order = "kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no"
    counts = ", ".join(f"count(*) FILTER (f.kind = '{k}')::BIGINT AS n_{k}" for k, *_ in BASE)
    return f"""
WITH f AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({order}) FILTER (kind_no < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({order}), '') AS spans
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""


ORACLE = _oracle()
