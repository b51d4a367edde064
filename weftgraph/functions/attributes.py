"""Attribute values, and access to them under both layouts.

In the map layout an object's attributes are one map from lower-case keys to tagged values; in the wide layout they are
columns. Equality is strict in type: 22, "22" and 22.0 differ. A key may be present with no value in the map layout; in the
wide layout a key is present where its column is not null.
"""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTR = "struct<t:string,s:string,i:bigint,d:double,b:boolean>"
ATTRS = f"map<string,{ATTR}>"


class _Exists:
    def __repr__(self) -> str:
        return "EXISTS"


#: As a predicate's value: the key is present, whatever its value.
EXISTS = _Exists()


def tagged(value: Any) -> tuple | None:
    """A Python value as a tagged value; None for a key without a value."""
    if value is None:
        return None
    if isinstance(value, bool):
        return ("bool", None, None, None, value)
    if isinstance(value, int):
        return ("int", None, value, None, None)
    if isinstance(value, float):
        return ("double", None, None, value, None)
    if isinstance(value, str):
        return ("string", value, None, None, None)
    raise TypeError(f"attribute values are strings, integers, floats, booleans or None, not {type(value).__name__}")


def untagged(value: Any) -> Any:
    """The Python value of a collected tagged value."""
    return None if value is None else {"string": value.s, "int": value.i, "double": value.d, "bool": value.b}[value.t]


def literal(value: Any) -> Column:
    """A tagged value as a column."""
    v = tagged(value)
    if v is None:
        return F.lit(None).cast(ATTR)
    names, kinds = "tsidb", ("string", "string", "bigint", "double", "boolean")
    return F.struct(*[F.lit(x).cast(k).alias(n) for x, k, n in zip(v, kinds, names, strict=True)])


def literals(attrs: dict[str, Any]) -> Column:
    """A dictionary as an attribute map; of keys that differ in case only, the last counts."""
    low = {k.lower(): v for k, v in attrs.items()}
    return F.map_from_arrays(F.array(*[F.lit(k) for k in low]), F.array(*[literal(v) for v in low.values()])) if low else F.expr(f"cast(map() as {ATTRS})")


def upserted(attrs: Column, new: Column) -> Column:
    """Map attrs with the entries of map new in place of or besides its own."""
    apart = ~F.arrays_overlap(F.map_keys(attrs), F.map_keys(new))  # compiled, other than the lambda
    return F.when(apart, F.map_concat(attrs, new)).otherwise(F.map_concat(F.map_filter(attrs, lambda k, _: ~F.map_contains_key(new, k)), new))


class Access(Protocol):
    """How predicates reach the attributes of the rows of one frame."""

    def has(self, key: str) -> Column: ...
    def equals(self, key: str, value: Any) -> Column: ...
    def number(self, key: str) -> Column: ...
    def order(self, key: str) -> list[Column]: ...


class MapAccess:
    """Attributes in a map column."""

    def __init__(self, column: str = "attrs"):
        self.column = column

    def value(self, key: str) -> Column:
        return F.try_element_at(F.col(self.column), F.lit(key.lower()))

    def has(self, key: str) -> Column:
        return F.map_contains_key(F.col(self.column), key.lower())

    def equals(self, key: str, value: Any) -> Column:
        if value is EXISTS:
            return self.has(key)
        if value is None:
            return self.value(key).isNull()
        v = self.value(key)
        t, s, i, d, b = tagged(value)
        field, want = {"string": ("s", s), "int": ("i", i), "double": ("d", d), "bool": ("b", b)}[t]
        return F.coalesce((v["t"] == t) & (v[field] == F.lit(want)), F.lit(False))

    def number(self, key: str) -> Column:
        """The value as a double; null where it is missing, null or not numeric."""
        v = self.value(key)
        return F.coalesce(v["d"], v["i"].cast("double"), v["s"].try_cast("double"), v["b"].cast("double"))

    def order(self, key: str) -> list[Column]:
        return [self.value(key).asc_nulls_first()]


class ColumnAccess:
    """Attributes in columns. names: attribute (lower case) to column; a missing one is never present."""

    def __init__(self, frame: DataFrame, names: dict[str, str] | None = None):
        self.types = {f.name: f.dataType for f in frame.schema.fields}
        self.names = {k.lower(): v for k, v in (names or {c: c for c in frame.columns}).items()}

    def _column(self, key: str) -> str | None:
        return self.names.get(key.lower())

    def has(self, key: str) -> Column:
        c = self._column(key)
        return F.col(c).isNotNull() if c else F.lit(False)

    def equals(self, key: str, value: Any) -> Column:
        c = self._column(key)
        if value is EXISTS:
            return self.has(key)
        if value is None:
            return F.col(c).isNull() if c else F.lit(True)
        if c is None:
            return F.lit(False)
        kinds = {bool: (T.BooleanType,), int: (T.ByteType, T.ShortType, T.IntegerType, T.LongType), float: (T.FloatType, T.DoubleType), str: (T.StringType,)}
        return F.col(c) == F.lit(value) if isinstance(self.types[c], kinds[type(value)]) else F.lit(False)

    def number(self, key: str) -> Column:
        c = self._column(key)
        if c is None:
            return F.lit(None).cast("double")
        return F.col(c).try_cast("double") if isinstance(self.types[c], T.StringType) else F.col(c).cast("double")

    def order(self, key: str) -> list[Column]:
        c = self._column(key)
        return [F.col(c).asc_nulls_first()] if c else []


#: Comparisons by number that conditions may use.
COMPARISONS = {"=": "__eq__", ">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__"}


def compares(access: Access, key: str, op: str, value: float) -> Column:
    """A numeric condition; missing, null and non-numeric values never satisfy it."""
    return F.coalesce(getattr(access.number(key), COMPARISONS[op])(F.lit(float(value))), F.lit(False))
