"""Scalar Column functions.

Everything is a built-in expression (no Python UDF), so it runs inside
whole-stage codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names of the reference's tick record and messages.
TICK_FIELDS = ("name", "stockUpAndDrop", "currMonth", "index")
TICK_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("stockUpAndDrop", T.DoubleType()),
    T.StructField("currMonth", T.StringType()),
    T.StructField("index", T.StringType()),
])
NUMBER = r"^(?i)[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"
STAFF_SCHEMA = "struct<data:struct<staff:array<struct<mid:bigint,name:string>>>>"


def split_cast(line: Column, pattern: str, pos: int, to: str, limit: int = -1) -> Column:
    """Field ``pos`` (0-based) of a delimited line, cast with ``try_cast``
    (ANSI mode would throw on a bad field)."""
    return F.split(line, pattern, limit).getItem(pos).try_cast(to)


def category_prefix(c: Column) -> Column:
    """Text before the first '/'."""
    return F.substring_index(c, "/", 1)


def parse_percent(c: Column) -> Column:
    """Strip '%' at both ends, read as double; unreadable or NaN → 0 (Q8).

    Only plain numbers and infinities are read: a cast alone would also take
    type suffixes such as ``1.5d``."""
    v = F.trim(F.trim(c, F.lit("%")))
    d = F.when(v.rlike(NUMBER), v.try_cast("double"))
    return F.coalesce(F.nanvl(d, F.lit(None).cast("double")), F.lit(0.0))


def date_parts_from_filename(name: Column) -> tuple[Column, Column, Column]:
    """``YYYY-MM-DD.ext`` → (year, month, day) strings."""
    rx = r"^(\d+)-(\d+)-(\d+)"
    return tuple(F.regexp_extract(name, rx, i) for i in (1, 2, 3))  # type: ignore[return-value]


def month_key(year: Column, month: Column) -> Column:
    """P5: 'year-month'."""
    return F.concat_ws("-", year, month)


def to_record(cols: list[Column], names: tuple[str, ...] = TICK_FIELDS) -> Column:
    """Positional values → named struct."""
    return F.struct(*[c.alias(n) for c, n in zip(cols, names)])


def parse_tick(value: Column) -> Column:
    """JSON text → tick struct; bad JSON or a missing key gives the
    default of that field ("" / 0.0), as the reference counts such rows (Q7).
    An integer percent parses into the double field."""
    p = F.from_json(value, TICK_SCHEMA)
    return F.struct(
        F.coalesce(p["name"], F.lit("")).alias("name"),
        F.coalesce(p["stockUpAndDrop"], F.lit(0.0)).alias("stockUpAndDrop"),
        F.coalesce(p["currMonth"], F.lit("")).alias("currMonth"),
        F.coalesce(p["index"], F.lit("")).alias("index"))


def tick_is_valid(value: Column) -> Column:
    """True when the text is a JSON object carrying every tick key."""
    p = F.from_json(value, TICK_SCHEMA)
    return F.coalesce(p["name"].isNotNull() & p["stockUpAndDrop"].isNotNull()
                      & p["currMonth"].isNotNull() & p["index"].isNotNull(), F.lit(False))


def staff_map(value: Column) -> Column:
    """JSON → ``data.staff[]`` → map mid → name; null when absent.

    A mid listed twice keeps its last name (dict assignment order).  The text is
    parsed once: what reads the list reads the variable of the outer function."""
    def by_mid(staff: Column) -> Column:
        mids = F.array_distinct(F.transform(staff, lambda x: x["mid"]))
        names = F.transform(mids, lambda k: F.element_at(
            F.filter(staff, lambda x: x["mid"] == k), -1)["name"])
        return F.when(staff.isNotNull(), F.map_from_arrays(mids, names))
    return F.transform(F.array(F.from_json(value, STAFF_SCHEMA)["data"]["staff"]), by_mid)[0]


def has_members(m: Column) -> Column:
    """a non-empty staff map."""
    return F.coalesce(F.size(m) > 0, F.lit(False))


def drop_rename_by_position(df: DataFrame, drop: list[int], names: list[str]) -> DataFrame:
    """Drop columns by 0-based position, name the rest in order."""
    keep = [c for i, c in enumerate(df.columns) if i not in set(drop)]
    return df.select(*keep).toDF(*names)


def date_spine(start: Column, end: Column) -> Column:
    """Every date from ``start`` to ``end`` inclusive (explode it)."""
    return F.explode(F.sequence(start.cast("date"), end.cast("date"),
                                F.expr("interval 1 day")))


def encode_message(fields: dict[str, Column]) -> Column:
    """Result row → JSON text with fixed field names."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def message_route(value: Column) -> Column:
    """'total' if the object has a ``total`` key, else 'trend' if it has
    ``trend``, else null (dropped).  Key presence, as the JS ``in`` test."""
    return route_of(F.from_json(value, "map<string,string>"))


def route_of(m: Column) -> Column:
    """F4 on a message that is parsed to a map already."""
    return (F.when(F.map_contains_key(m, "total"), F.lit("total"))
             .when(F.map_contains_key(m, "trend"), F.lit("trend")))


def view_pairs(name: Column, value: Column) -> tuple[Column, Column]:
    """Record → (name, value as double)."""
    return name, value.try_cast("double")


def filter_ids(df: DataFrame, ids: list[int], col: str = "id") -> DataFrame:
    """keep the rows of the given ids (a literal list: an IN filter that
    is pushed to the scan)."""
    return df.where(F.col(col).isin(list(ids)))
