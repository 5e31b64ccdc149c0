"""The seven types, their Spark counterparts and their text forms.

There are no nulls within a flow: on entry a null becomes its type's default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import PipelineError

#: Type tags, each with what stands for a missing value.
DEFAULTS = {"string": "", "istring": "", "int": 0, "uint": 0, "double": 0.0, "bool": False, "ipaddress": "0.0.0.0"}
SPARK = {
    "string": T.StringType(), "istring": T.StringType("UTF8_LCASE"), "int": T.LongType(), "uint": T.LongType(),
    "double": T.DoubleType(), "bool": T.BooleanType(), "ipaddress": T.StringType(),
}
TEXTUAL = ("string", "istring")


def split_heading(heading: str) -> tuple[str | None, str]:
    """``type:name`` or ``name``."""
    tag, colon, name = heading.partition(":")
    if not colon:
        return None, heading
    if tag not in DEFAULTS:
        raise PipelineError(f"unknown type {tag!r} in heading {heading!r}")
    return tag, name


def import_heading(text: str) -> tuple[str, str]:
    """A heading of a text file: odd characters become ``_``, and a colon survives only after a type."""
    tag, colon, name = text.partition(":")
    if not colon or tag not in DEFAULTS:
        tag, name = "string", text
    return tag, "".join(c if c.isascii() and c.isalnum() or c == "_" else "_" for c in name)


def default(tag: str) -> Column:
    return F.lit(DEFAULTS[tag]).cast(SPARK[tag])


def widen(field: T.StructField) -> tuple[str, Column] | None:
    """The tag of a foreign column, and the column in that type; None for what the types don't cover."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    tag = (field.metadata or {}).get("millrace.type")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return tag or "int", c.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double", c.cast("double")
    if isinstance(kind, T.BooleanType):
        return "bool", c
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "int", F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.StringType):
        found = tag or ("istring" if "LCASE" in str(getattr(kind, "collation", "")).upper() else "string")
        return found, c.cast(SPARK[found])
    return None


def enter(df: DataFrame) -> tuple[list[Column], dict[str, str]]:
    """Columns of ``df`` in the seven types and null-free, and their tags; others are left out."""
    cols, tags = [], {}
    for field in df.schema:
        if found := widen(field):
            tag, c = found
            tags[field.name] = tag
            cols.append(F.coalesce(c, default(tag)).alias(field.name))
    return cols, tags


def to_text(c: Column, tag: str) -> Column:
    if tag == "double":
        # the JVM's format rounds the shortest digits that stand for the double, not the double itself
        @F.pandas_udf("string")
        def shown(values):
            return values.map("{:.6f}".format)

        return F.when(F.abs(c) < F.lit(float("inf")), shown(c)).otherwise(F.format_string("%.6f", c))
    if tag == "uint":
        return unsigned(c).cast("string")
    return c.cast("string")


def unsigned(c: Column) -> Column:
    """A uint's 64 bits as a decimal."""
    wide = c.cast("decimal(20,0)")
    return F.when(c < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide)


def from_text(c: Column, tag: str) -> Column:
    """Lenient reading: numbers may have blanks before and after; an empty number is zero."""
    if tag in ("int", "uint"):
        digits = F.regexp_extract(c, r"^\s*([+-]?\d*)(?:\s.*)?$", 1)
        wide = F.when(digits.isin("", "+", "-"), "0").otherwise(digits).cast("decimal(38,0)")
        low = F.pmod(wide, F.lit("18446744073709551616").cast("decimal(38,0)"))
        value = F.when(low >= F.lit("9223372036854775808").cast("decimal(38,0)"), low - F.lit("18446744073709551616").cast("decimal(38,0)")).otherwise(low).cast("long")
        bad = ~c.rlike(r"^\s*([+-]?\d*)(?:\s.*)?$")
        return F.when(bad, F.raise_error(F.concat(F.lit("no integer: "), c)).cast("long")).otherwise(value)
    if tag == "double":
        shown = F.trim(c)
        value = F.when(shown == "", F.lit(0.0)).otherwise(shown.cast("double"))
        return F.when(value.isNull(), F.raise_error(F.concat(F.lit("no number: "), c)).cast("double")).otherwise(value)
    if tag == "bool":
        return F.when(c == "true", True).when(c == "false", False).otherwise(F.raise_error(F.concat(F.lit("neither true nor false: "), c)).cast("boolean"))
    return c.cast(SPARK[tag])


def ip_number(c: Column) -> Column:
    """An IPv4 address, dotted or as a number, as a long."""
    parts = F.split(c.cast("string"), r"\.")
    dotted = sum((F.get(parts, i).cast("long") * (1 << (8 * (3 - i))) for i in range(1, 4)), F.get(parts, 0).cast("long") * (1 << 24))
    return F.when(F.size(parts) == 4, dotted).otherwise(c.cast("string").cast("long"))


def key(c: Column, tag: str) -> Column:
    """What a column is compared, sorted and joined by."""
    if tag == "ipaddress":
        return ip_number(c)
    return c.bitwiseXOR(F.lit(-(1 << 63))) if tag == "uint" else c
