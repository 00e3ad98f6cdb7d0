"""Canonical text of one result cell, for both serializer versions.

Version 1 keeps numbers at two decimals of their DOUBLE value and dates as ISO days.
Version 2 writes a typed JSON pair and never sends an integer or DECIMAL through DOUBLE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: separators and JSON escapes of the two serializer versions ----
UNIT_SEPARATOR = "\x1f"
RECORD_SEPARATOR = "\x1e"
JSON_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


def _not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (*_INTEGRAL, *_FLOATING, T.DecimalType)):
        return "number"
    if isinstance(dtype, _TIMESTAMPS):
        return "datetime"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dtype, T.NullType):
        return "null"
    return "unsupported"


def _cents_text(x: Column) -> Column:
    """Two-decimal text of a DOUBLE below 9e18: whole part and fraction are split without error."""
    whole = F.floor(F.abs(x))
    cents = F.rint((F.abs(x) - whole) * 100.0).cast("bigint")
    carried = whole + F.when(cents == 100, 1).otherwise(0)
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(sign, carried.cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _no_tie(x: Column) -> Column:
    """The third decimal decides clearly, so every rounding rule gives the same cents."""
    scaled = (F.abs(x) - F.floor(F.abs(x))) * 100.0
    return (x != 0) & (F.abs(scaled - F.rint(scaled)) < 0.4999)


def plain_text(c: Column, dtype: T.DataType) -> Column:
    """Version 1 text of a cell."""
    kind = kind_of(dtype)
    if kind == "null":
        return F.lit("null")
    if kind == "number":
        x = c.cast("double")
        text = (
            # From 2**33 on the fraction has few enough bits for an exact product, ties included.
            F.when((F.abs(x) < 9e18) & (_no_tie(x) | (F.abs(x) >= 2.0**33)), _cents_text(x))
            .when(F.isnan(x), F.lit("nan"))
            .when(x == F.lit(float("inf")), F.lit("inf"))
            .when(x == F.lit(float("-inf")), F.lit("-inf"))
            .otherwise(F.call_function("format_number", x, F.lit("0.00")))
        )
    elif kind in ("date", "datetime"):
        text = F.substring(c.cast("string"), 1, 10)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def _shortest(n: Column) -> Column:
    """``n`` (digits, unit, x) with the digits without the last one where that is still the DOUBLE ``x``, else as they are."""
    def still(fewer: Column) -> Column:
        return F.concat(fewer.cast("string"), F.lit("E"), (n["unit"] + 1).cast("string")).try_cast("double") == n["x"]

    last = F.pmod(n["digits"], F.lit(10))
    lower = ((n["digits"] - last) / F.lit(10).cast("decimal(2,0)")).cast("bigint")
    tried = F.array(F.struct(n.alias("n"), last.alias("last"), lower.alias("lower"), still(lower).alias("down"), still(lower + 1).alias("up")))
    chosen = F.transform(tried, lambda t: F.struct(
        t["n"].alias("n"), F.when(t["down"] & ((t["last"] <= 5) | ~t["up"]), t["lower"]).when(t["up"], t["lower"] + 1).alias("fewer")))
    return F.transform(chosen, lambda t: F.struct(
        F.coalesce(t["fewer"], t["n"]["digits"]).cast("string").alias("kept"),
        F.when(t["fewer"].isNotNull(), t["n"]["unit"] + 1).otherwise(t["n"]["unit"]).alias("unit")))[0]


def _large_text(x: Column) -> Column:
    """Two-decimal text of a DOUBLE of 1e15 and more: its shortest decimal text, as long as it takes.

    Some Java versions write a digit more than needed, so the last one is tried without. Such a DOUBLE has one digit after the point at most.
    Each step is a lambda over an array of one, so that what it uses several times is computed once."""
    def parts(v: Column) -> Column:
        text = v.cast("string")
        return F.struct(v.alias("x"), F.replace(F.substring_index(text, "E", 1), F.lit(".")).alias("mantissa"),
                        F.substring_index(text, "E", -1).try_cast("int").alias("power"))

    def numbers(p: Column) -> Column:
        return F.struct(p["x"].alias("x"), p["mantissa"].try_cast("bigint").alias("digits"),
                        (p["power"] - F.length(p["mantissa"]) + 1).alias("unit"))

    def whole(n: Column) -> Column:
        kept, unit = n["kept"], n["unit"]
        return F.when(unit >= 0, F.concat(F.rpad(kept, F.length(kept) + unit, "0"), F.lit(".00"))).otherwise(
            F.concat(F.substring(kept, F.lit(1), F.length(kept) + unit), F.lit("."), F.rpad(F.substring(kept, F.length(kept) + unit + 1, F.lit(2)), 2, "0")))

    steps = F.array(F.abs(x))
    for step in (parts, numbers, _shortest, whole):
        steps = F.transform(steps, step)
    return F.concat(F.when(x < 0, "-").otherwise(""), steps[0])


def _whole_text(x: Column) -> Column:
    """The same for a DOUBLE from 2**53 to 9e18, a whole number of which the fewest digits that mean it are kept."""
    n = F.abs(x).cast("bigint")
    fewest = F.coalesce(*[F.when(F.bround(n, -k).cast("double") == F.abs(x), F.bround(n, -k)) for k in (3, 2, 1)], n)
    return F.concat(F.when(x < 0, "-").otherwise(""), fewest.cast("string"), F.lit(".00"))


def _two_decimals(c: Column, dtype: T.DataType) -> Column:
    """Decimal rounding of the shortest decimal text, ties to even; negative zero only for x < 0."""
    if isinstance(dtype, _INTEGRAL):
        return F.concat(c.cast("string"), F.lit(".00"))
    if isinstance(dtype, T.DecimalType):
        if dtype.scale <= 2:
            return F.concat(c.cast("string"), F.lit((".00", "0", "")[dtype.scale]))
        rounded = F.bround(c, 2)
        return F.concat(F.when((c < 0) & (rounded == 0), "-").otherwise(""), rounded.cast("string"))
    x = c.cast("double")
    rounded = F.bround(x.try_cast("decimal(38,18)"), 2).cast("decimal(38,2)")
    near_tie = F.concat(F.when((x < 0) & (rounded == 0), "-").otherwise(""), rounded.cast("string"))
    return F.when((F.abs(x) < 1e9) & _no_tie(x), _cents_text(x)).when(F.abs(x) < 1e15, near_tie).when(
        (F.abs(x) >= 2.0**53) & (F.abs(x) < 9e18), _whole_text(x)).otherwise(_large_text(x))


def json_text(s: Column) -> Column:
    """A JSON string literal with lower-case control escapes and everything else as it is."""
    controls = [(chr(i), f"\\u{i:04x}") for i in range(32) if chr(i) not in {raw for raw, _ in JSON_ESCAPES}]
    escaped = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), JSON_ESCAPES + controls, s)
    special = s.rlike(r'[\x00-\x1f"\\]')
    return F.concat(F.lit('"'), F.when(special, escaped).otherwise(s), F.lit('"'))


def typed_pair(c: Column, dtype: T.DataType) -> Column:
    """Version 2 JSON of a cell; NULL where the value breaks the result contract."""
    kind = kind_of(dtype)
    if kind == "null":
        return F.lit('["null"]')
    if kind == "unsupported":
        return F.when(c.isNull(), F.lit('["null"]'))
    if kind == "bool":
        body = c.cast("string")
    elif kind == "number":
        body = F.concat(F.lit('"'), _two_decimals(c, dtype), F.lit('"'))
    elif kind == "datetime":
        # Spark drops trailing zeros of the fraction; ISO text has six digits or none.
        iso = F.replace(c.cast("string"), F.lit(" "), F.lit("T"))
        body = F.concat(F.lit('"'), F.when(F.length(iso) > 19, F.rpad(iso, 26, "0")).otherwise(iso), F.lit('"'))
    elif kind == "date":
        body = F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    else:
        body = json_text(c.cast("string"))
    pair = F.concat(F.lit(f'["{kind}",'), body, F.lit("]"))
    return F.when(c.isNull(), F.lit('["null"]')).otherwise(pair)


def contract_defect(c: Column, dtype: T.DataType) -> Column | None:
    """Why a cell cannot be serialized, NULL when it can; None for a type that always can.

    Fixed values: the wording, which verdict files carry."""
    kind = kind_of(dtype)
    if kind == "unsupported":
        return F.when(c.isNotNull(), F.lit(f"TypeError: unsupported result type: {dtype.simpleString()}"))
    if isinstance(dtype, _FLOATING):
        return F.when(_not_finite(c), F.lit("ValueError: non-finite result number"))
    return None


def row_line(df: DataFrame, columns: list[str], version: int, types: dict[str, T.DataType] | None = None) -> Column:
    """The text of one result row. ``types`` stand for the columns' own where these hold what was stored of others."""
    types = types or {f.name: f.dataType for f in df.schema.fields}
    if version == 1:
        return F.concat_ws(UNIT_SEPARATOR, *[plain_text(df[c], types[c]) for c in columns])
    if version == 2:
        cells = [typed_pair(df[c], types[c]) for c in columns]
        joined = reduce(lambda a, b: F.concat(a, F.lit(","), b), cells)
        return F.concat(F.lit("["), joined, F.lit("]"))
    raise ValueError(f"unsupported serializer version: {version}")


def row_defect(df: DataFrame, columns: list[str], types: dict[str, T.DataType] | None = None) -> Column:
    types = types or {f.name: f.dataType for f in df.schema.fields}
    defects = [contract_defect(df[c], types[c]) for c in columns]
    return F.coalesce(*[d for d in defects if d is not None], F.lit(None).cast("string"))


def storable(dtype: T.DataType) -> T.DataType:
    """What a cell is stored as before it is written as text: its own type, or text for a type that no version writes otherwise."""
    return T.StringType() if kind_of(dtype) in ("text", "null", "unsupported") else dtype
