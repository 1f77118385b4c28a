"""The type language of relation schemas: fixed-width type strings mapped to Spark types."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type names, their Spark types and their defaults.
_PLAIN = {
    "byte": (T.ShortType(), 0),
    "short": (T.ShortType(), 0),
    "int": (T.IntegerType(), 0),
    "float": (T.FloatType(), 0.0),
    "double": (T.DoubleType(), 0.0),
}
_SIZED = ("char", "text")
# Types that the Parquet tables need besides.
_MORE = {
    "long": (T.LongType(), 0),
    "string": (T.StringType(), ""),
    "boolean": (T.BooleanType(), False),
    "date": (T.DateType(), None),
    "timestamp": (T.TimestampNTZType(), None),
}
_GRAMMAR = re.compile(r"(\w+?)(?:\((\d+)\))?")


@dataclass(frozen=True)
class FieldType:
    """A parsed type string."""

    kind: str
    size: int | None = None

    @property
    def spark(self) -> T.DataType:
        return T.StringType() if self.kind in _SIZED else (_PLAIN | _MORE)[self.kind][0]

    @property
    def default(self):
        return "" if self.kind in _SIZED else (_PLAIN | _MORE)[self.kind][1]

    def __str__(self) -> str:
        return f"{self.kind}({self.size})" if self.size is not None else self.kind

    def cast(self, value: Column) -> Column:
        """A value as this type: strings are cut to their size, bytes are checked for their range."""
        out = value.cast(self.spark)
        if self.kind in _SIZED:  # trailing padding doesn't count
            return F.regexp_replace(F.substring(out, 1, self.size), "[\\x00 \\n]+$", "")
        if self.kind == "byte":
            return F.when(out.between(0, 255) | out.isNull(), out).otherwise(F.raise_error(F.lit("byte out of range")).cast("smallint"))
        return out


def parse_type(text: str) -> FieldType | None:
    """The type of a string; None if it is unknown or ill-formed (a size where none belongs, or none where one must)."""
    found = _GRAMMAR.fullmatch(text.strip())
    if not found:
        return None
    kind, size = found[1], found[2]
    if kind in _SIZED:
        return FieldType(kind, int(size)) if size else None
    return FieldType(kind) if size is None and kind in _PLAIN | _MORE else None


def type_of(kind: T.DataType) -> FieldType:
    """The type string of a Spark type."""
    for name in ("int", "short", "float", "double", "long", "boolean", "date", "timestamp"):
        if (_PLAIN | _MORE)[name][0] == kind:
            return FieldType(name)
    return FieldType("timestamp" if isinstance(kind, T.TimestampType) else "string")


class Schema:
    """An ordered list of (name, type string) with a name of its own."""

    def __init__(self, name: str, fields: list[tuple[str, str]]):
        self.name = name
        self.types = {n: parse_type(t) for n, t in fields}
        bad = [f"{n} {t}" for n, t in fields if self.types[n] is None]
        if bad or len(self.types) != len(fields):
            raise ValueError(f"schema {name}: {', '.join(bad) or 'a field occurs twice'}")

    @classmethod
    def of(cls, name: str, df: DataFrame) -> Schema:
        return cls(name, [(f.name, str(type_of(f.dataType))) for f in df.schema])

    @property
    def fields(self) -> list[str]:
        return list(self.types)

    @property
    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(n, t.spark, True, {"size": t.size} if t.size else {}) for n, t in self.types.items()])

    def rename(self, name: str, names: dict[str, str]) -> Schema:
        """Every field under its new name; a field without one is an error."""
        return Schema(name, [(names[n], str(t)) for n, t in self.types.items()])

    def match(self, other: Schema) -> bool:
        """Equal names, types and order; the schemas' own names don't count."""
        return list(self.types.items()) == list(other.types.items())

    def project(self, name: str, fields: list[str]) -> Schema:
        missing = [f for f in fields if f not in self.types]
        if missing:
            raise ValueError(f"schema {self.name} has no field {', '.join(missing)}")
        return Schema(name, [(f, str(self.types[f])) for f in fields])

    def defaults(self) -> dict[str, object]:
        return {n: t.default for n, t in self.types.items()}

    def conform(self, df: DataFrame) -> DataFrame:
        """The fields of a frame in this order and of these types."""
        return df.select(*(t.cast(F.col(n)).alias(n) for n, t in self.types.items()))

    def from_strings(self, df: DataFrame) -> DataFrame:
        """A frame of strings, by position, as this schema."""
        return self.conform(df.toDF(*self.fields))

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "fields": [[n, str(t)] for n, t in self.types.items()]})

    @classmethod
    def from_json(cls, text: str) -> Schema:
        found = json.loads(text)
        return cls(found["name"], [tuple(f) for f in found["fields"]])

    def __str__(self) -> str:
        return f"{self.name}[{','.join(f'({n},{t})' for n, t in self.types.items())}]"
