"""Graphs on disk: Parquet as the native form, and a blank-separated text form for exchange.

The text form is three files and a manifest. Values are 'text' for strings, * for none, digits for integers, and digits with
a point (or exponent) for doubles; true and false for booleans. Blanks, line ends and % in names and strings are written as
% and two hexadecimal digits. A type that very many vertices have is written as several records of the same id, so that no
task holds all members; they are one type again when read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import ATTR, ATTRS
from ..model import EDGE, TYPE, VERTEX, PropertyGraph, union
from ..plans.scratch import MOST_PARTS, appended, delete, file_system, parts, written

# Suffixes of the text form's files, and the characters that are escaped, in order of escaping.
VERTEX_FILE, TYPE_FILE, EDGE_FILE, MANIFEST = "_Vertex.gdbt", "_Type.gdbt", "_Edge.gdbt", ".gdbf"
POINTER, PARTS, TABLES = "CURRENT", "PARTS", "tables"
ESCAPED = (("%", "%25"), (" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"))
MEMBERS_PER_RECORD = 100_000
#: Attributes of an object up to which they are written and read one by one in compiled code; more go through a lambda.
UNROLLED = 6


def save(g: PropertyGraph, path: str, mode: str = "error") -> None:
    """Writes the three tables as Parquet for a new version, vertices by type so that typed scans read only their part.

    Of a graph that was loaded from there only what is new is written: a version names the folders that its tables' parts are in,
    and those of the version before serve again. A pointer file then names the version, so a graph may be saved over the path that it was loaded from, readers see the old
    or the new version whole, and a failed save changes nothing. The version before stays; what older ones hold and
    neither needs is deleted.
    """
    spark = g.spark
    now = current_version(spark, path)
    if now is not None and mode != "overwrite":
        raise FileExistsError(f"{path} holds a graph; mode='overwrite' saves over it")
    number = 1 + (int(now.split("-")[1]) if now else 0)
    version = f"v-{number}-{uuid.uuid4().hex[:8]}"
    before = _folders(spark, path, now) if now else {}
    folders = {}
    for name in ("vertices", "edges", "types"):
        own = parts(getattr(g, name))
        known = [getattr(x, "_weft_stored", None) for x in own]
        kept = [k is not None and k[0] == path and k[1] in before.get(name, ()) for k in known]
        if len(own) > MOST_PARTS:
            kept = [False] * len(own)
        fresh = [x for x, k in zip(own, kept, strict=True) if not k]
        folders[name] = [k[1] for k, old in zip(known, kept, strict=True) if old]
        if fresh:
            writer = union(fresh).write
            (writer.partitionBy("type_id") if name == "vertices" else writer).parquet(f"{path}/{TABLES}/{version}/{name}")
            folders[name].append(f"{TABLES}/{version}/{name}")
    _put(spark, f"{path}/{version}/{PARTS}", json.dumps(folders))
    fs, folder = file_system(spark, path)
    new = _put(spark, f"{path}/{POINTER}.{version}", version)
    _, pointer = file_system(spark, f"{path}/{POINTER}")
    fs.delete(pointer, False)
    if not fs.rename(new, pointer):
        raise OSError(f"{path}/{POINTER} could not be moved in place")
    needed = {f for x in (folders, before) for own in x.values() for f in own}
    names = lambda p: [x.getPath().getName() for x in fs.listStatus(p)]
    _, tables = file_system(spark, f"{path}/{TABLES}")
    for v in names(tables):
        _, of_version = file_system(spark, f"{path}/{TABLES}/{v}")
        left = [n for n in names(of_version) if f"{TABLES}/{v}/{n}" in needed]
        for n in set(names(of_version)) - set(left):
            delete(spark, f"{path}/{TABLES}/{v}/{n}")
        if not left:
            fs.delete(of_version, True)
    for v in names(folder):
        if v.startswith("v-") and v not in (version, now) and not any(f.startswith(f"{v}/") for f in needed):
            delete(spark, f"{path}/{v}")


def _put(spark: SparkSession, path: str, text: str):
    """Writes a small file; gives its path."""
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return p


def _folders(spark: SparkSession, path: str, version: str) -> dict[str, list[str]]:
    """The folders that hold each table of a version, in parts."""
    fs, p = file_system(spark, f"{path}/{version}/{PARTS}")
    if not fs.exists(p):  # saved before versions had parts
        return {name: [f"{version}/{name}"] for name in ("vertices", "edges", "types")}
    return json.loads(spark.read.text(f"{path}/{version}/{PARTS}").first()[0])


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version folder that the pointer names; None if nothing has been saved there."""
    fs, pointer = file_system(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        # A save was cut off between taking the old pointer away and moving the new one in place: the newest one holds.
        fs, folder = file_system(spark, path)
        left = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        left = [x.removeprefix(f"{POINTER}.") for x in left if x.startswith(f"{POINTER}.v-")]
        return max(left, key=lambda v: int(v.split("-")[1]), default=None)
    return spark.read.text(f"{path}/{POINTER}").first()[0].strip()


def load(spark: SparkSession, path: str) -> PropertyGraph:
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} holds no graph")
    folders = _folders(spark, path, version)

    def read(name: str, schema: str) -> DataFrame:
        out = None
        for folder in folders[name]:
            part = spark.read.schema(schema).parquet(f"{path}/{folder}")
            part._weft_stored = (path, folder)
            out = part if out is None else appended(out, part)
        return out

    return PropertyGraph(read("vertices", VERTEX), read("edges", EDGE), read("types", TYPE))


def _escape(c: Column) -> Column:
    for plain, code in ESCAPED:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _unescape(c: Column) -> Column:
    out = c
    for plain, code in reversed(ESCAPED):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.when(c.contains("%"), out).otherwise(c)


def _value(v: Column) -> Column:
    text = F.when(v["t"] == "string", F.concat(F.lit("'"), _escape(v["s"]), F.lit("'"))).when(v["t"] == "int", v["i"].cast("string"))
    return F.when(v.isNull(), F.lit("*")).otherwise(text.when(v["t"] == "double", v["d"].cast("string")).otherwise(v["b"].cast("string")))


def _with_attributes(frame: DataFrame, *ends: str) -> DataFrame:
    """(value): the columns ends, then 'n key value key value ...' of the attributes, by key."""
    text = lambda e: F.concat_ws(" ", _escape(e["key"]), _value(e["value"]))
    n, entries = F.size("entries"), F.col("entries")
    one_by_one = F.concat_ws(" ", *[F.when(n > i, text(F.get("entries", F.lit(i)))) for i in range(UNROLLED)])
    listed = F.when(n <= UNROLLED, one_by_one).otherwise(F.array_join(F.transform(entries, text), " "))
    sorted_ = frame.select(*ends, F.sort_array(F.map_entries("attrs")).alias("entries"))
    return sorted_.select(F.rtrim(F.concat_ws(" ", *[_escape(F.col(c)) for c in ends], n.cast("string"), listed)).alias("value"))


def vertex_lines(g: PropertyGraph) -> DataFrame:
    return _with_attributes(g.vertices, "id")


def edge_lines(g: PropertyGraph) -> DataFrame:
    return _with_attributes(g.edges, "id", "src", "dst")


def type_lines(g: PropertyGraph) -> DataFrame:
    sizes = g.vertices.where("type_id IS NOT NULL").groupBy("type_id").agg(F.count("*").alias("n"))
    typed = g.vertices.select("id", "type_id").join(sizes.join(g.types.select(F.col("id").alias("type_id")), "type_id", "left_semi"), "type_id")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / MEMBERS_PER_RECORD))
    members = typed.groupBy("type_id", part.alias("part")).agg(F.array_sort(F.collect_list(_escape(F.col("id")))).alias("members"))
    own = F.array_join(F.transform("attr_order", lambda k: F.concat_ws(" ", _escape(k), _value(F.try_element_at("attrs", k)))), " ")
    attrs = F.rtrim(F.concat_ws(" ", F.size("attr_order").cast("string"), own))
    empty = F.expr("cast(array() as array<string>)")
    full = g.types.join(members, F.col("id") == F.col("type_id"), "left").withColumn("members", F.coalesce("members", empty))
    return full.select(F.rtrim(F.concat_ws(" ", _escape(F.col("id")), _escape(F.col("name")), attrs, F.size("members").cast("string"), F.array_join("members", " "))).alias("value"))


def export_text(g: PropertyGraph, path: str) -> None:
    """Writes <path>_Vertex.gdbt, _Type.gdbt, _Edge.gdbt and the manifest <path>.gdbf, over what is there.

    All files are written beside the old ones before any is put in place, so a graph may be exported over the files that it was
    read from.
    """
    spark = g.spark
    spaced = lambda lines: lines.select(F.concat("value", F.lit("\n")).alias("value"))  # noqa: E731  a blank line after each
    names = [path.rsplit("/", 1)[-1] + s for s in (TYPE_FILE, VERTEX_FILE, EDGE_FILE)]
    manifest = spark.createDataFrame([("\n".join(names),)], "value string")
    fresh = f".new-{uuid.uuid4().hex[:8]}"
    files = ((spaced(type_lines(g)), TYPE_FILE), (spaced(vertex_lines(g)), VERTEX_FILE), (spaced(edge_lines(g)), EDGE_FILE), (manifest, MANIFEST))
    for frame, suffix in files:
        frame.write.text(path + suffix + fresh)
    for _, suffix in files:
        fs, new = file_system(spark, path + suffix + fresh)
        _, place = file_system(spark, path + suffix)
        delete(spark, path + suffix)
        if not fs.rename(new, place):
            raise OSError(f"{path}{suffix} could not be moved in place")


def _read_value(v: Column) -> Column:
    none = F.lit(None).cast(ATTR)
    field = lambda t, name, c: F.struct(
        F.lit(t).alias("t"), *[(c if n == name else F.lit(None)).cast(k).alias(n) for n, k in (("s", "string"), ("i", "bigint"), ("d", "double"), ("b", "boolean"))]
    )
    quoted = (F.length(v) >= 2) & v.startswith("'") & v.endswith("'")
    out = F.when(v == "*", none).when(quoted, field("string", "s", _unescape(v.substr(F.lit(2), F.length(v) - 2))))
    out = out.when(v.isin("true", "false"), field("bool", "b", v)).when(v.rlike(r"^-?\d+$"), field("int", "i", v.try_cast("bigint")))
    return out.otherwise(field("double", "d", v.try_cast("double")))


def _read_attributes(at: int) -> tuple[Column, Column, Column]:
    """(map, keys in order, index of the token after them) of the attributes whose count is the token of index at (from 0)."""
    t = F.col("t")
    n = F.coalesce(F.element_at(t, at + 1).try_cast("int"), F.lit(0))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    # The tokens are taken out first: each is looked at several times, and lambdas are not compiled.
    token = lambda i, j: F.element_at(t, (F.lit(at + j) + 2 * i).cast("int"))
    pairs = F.transform(places, lambda i: F.struct(token(i, 2).alias("k"), token(i, 3).alias("v")))
    key = lambda k: F.lower(_unescape(k))
    entry = lambda k, v: F.struct(key(k).alias("key"), _read_value(v).alias("value"))
    few = F.array(*[F.when(n > i, entry(F.get(t, F.lit(at + 1 + 2 * i)), F.get(t, F.lit(at + 2 + 2 * i)))) for i in range(UNROLLED)])
    listed = F.when(n <= UNROLLED, F.slice(few, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(F.transform(pairs, lambda e: entry(e["k"], e["v"])))
    return F.map_from_entries(listed).cast(ATTRS), F.transform(pairs, lambda e: key(e["k"])), F.lit(at + 1) + 2 * n


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), " ").alias("t"))


def import_text(spark: SparkSession, path: str) -> PropertyGraph:
    """Reads what export_text() wrote, or files of the same form from elsewhere. All attributes and all members are kept."""
    token = lambda i: _unescape(F.element_at("t", i + 1))
    seq = F.monotonically_increasing_id()
    # True of all rows. It keeps the number in the plan, below which no later condition can go: that would read a line's
    # attributes once for the condition and once more for the result.
    numbered = lambda frame: frame.where("seq >= 0")
    attrs, order, after = _read_attributes(2)
    raw = written(_records(spark, path + TYPE_FILE).select(token(0).alias("id"), token(1).alias("name"), order.alias("attr_order"), attrs.alias("attrs"), after.alias("after"), "t"))
    count = F.coalesce(F.element_at("t", (F.col("after") + 1).cast("int")).try_cast("int"), F.lit(0))
    members = raw.where(count > 0).select(F.col("id").alias("type_id"), F.explode(F.slice("t", F.col("after") + 2, count)).alias("v")).select("type_id", _unescape(F.col("v")).alias("id")).dropDuplicates(["id"])
    types = raw.dropDuplicates(["id"]).select(seq.alias("seq"), "id", "name", "attr_order", "attrs")
    attrs, _, _ = _read_attributes(1)
    vertices = numbered(_records(spark, path + VERTEX_FILE).select(seq.alias("seq"), token(0).alias("id"), attrs.alias("attrs"))).join(members, "id", "left").select("seq", "id", "type_id", "attrs")
    attrs, _, _ = _read_attributes(3)
    edges = numbered(_records(spark, path + EDGE_FILE).select(seq.alias("seq"), token(0).alias("id"), token(1).alias("src"), token(2).alias("dst"), attrs.alias("attrs")))
    return PropertyGraph(vertices, edges, types)
