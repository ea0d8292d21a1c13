"""Reading attribute values written in many notations, in the JVM.

``with_reading`` adds columns ``state`` and ``canon`` to each row. It works in stages, each a projection whose columns the next one
uses more than once, so that Spark evaluates no part twice. ``state`` is ``missing``, ``bad`` (there, but
not readable as the type) or ``ok``; ``canon`` is a string that is equal for equal values, null unless ``ok``:
the double, the whole number, ``true``/``false``, the second since 1970 in UTC, or the trimmed text in lower case.

Defined results: null, blank and the missing-value words are ``missing`` for every type; an unknown type is read as string;
very long texts are compared whole; a double beyond the range of doubles and a whole number beyond 64 bits are ``bad``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trimmed

# Words that stand for a missing value, and dates that stand for none.
MISSING = ("", "none", "n/a", "-", "nenhum", "null")
SENTINEL_DATES = ("1970-01-01", "9999-12-31")
TRUE = ("true", "1", "yes", "y", "sim", "s")
FALSE = ("false", "0", "no", "n", "não", "não", "nao")

# Patterns of instants; the groups are joined to "year|month|day|hour|minute|second|offset".
_CLOCK = r"(?:[Tt ]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?\s*([Zz]|[+-][0-9]{2}:?[0-9]{2})?)"
_ISO = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"
_DMY = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
_DEFAULT_OFFSET_S = -3 * 3600
_EXP = r"(?:E[+-]?[0-9]+)?$"


def fenced(df: DataFrame) -> DataFrame:
    """``df`` with a fence that filters and join conditions above it don't cross: Spark would copy costly expressions into them."""
    return df.withColumn("__fence", F.monotonically_increasing_id()).where(F.col("__fence") >= 0).drop("__fence")


def number_text(u: Column) -> Column:
    """An upper-case text without currency mark as the text of a double; null if it is none.

    Brazilian or English notation. A single separator is the decimal mark, whichever of the two it is.
    """
    return (
        F.when(u.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)" + _EXP), u)
        .when(u.rlike(r"^[+-]?[0-9]+,[0-9]+" + _EXP), F.translate(u, ",", "."))
        .when(u.rlike(r"^[+-]?[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?$"), F.translate(F.translate(u, ".", ""), ",", "."))
        .when(u.rlike(r"^[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?$"), F.translate(u, ",", ""))
    )


def without_currency(u: Column) -> Column:
    return F.regexp_replace(u, r"^([+-]?)\s*(?:R\$|US\$|BRL|USD|\$)[\s\u00a0]*|[\s\u00a0]*(?:R\$|BRL)$", "$1")


def boolean_of(low: Column) -> Column:
    """A trimmed text in lower case as boolean; null if it is none."""
    return F.when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False))


def _parts(t: Column, time_needed: bool) -> Column:
    """The seven parts of an instant as written, or null."""
    clock = (_CLOCK if time_needed else _CLOCK + "?") + "$"
    return (
        F.when((F.substring(t, 5, 1) == "-") & t.rlike(_ISO + clock), F.split(F.regexp_replace(t, _ISO + clock, "$1|$2|$3|$4|$5|$6|$7"), r"\|"))
        .when(t.contains("/") & t.rlike(_DMY + clock), F.split(F.regexp_replace(t, _DMY + clock, "$3|$2|$1|$4|$5|$6|$7"), r"\|"))
    )


def _int(c: Column) -> Column:
    return F.when(c == "", F.lit(0)).otherwise(c.try_cast("int"))


def with_instant(df: DataFrame, t: str, out: str, only: Column | None = None, time_needed: bool = True) -> DataFrame:
    """Adds ``out``: a struct ``(written, second)`` of the trimmed text in column ``t``.

    ``written`` is the calendar date as written (yyyy-mm-dd), ``second`` the second since 1970 in UTC, fractions cut: date and time, ISO or
    day/month/year, without an offset in -03:00, or epoch milliseconds; null if it is no possible instant. ``only``: for these rows.
    """
    c = F.col(t) if only is None else F.when(only, F.col(t))
    staged = df.withColumn("__c", c)
    staged = staged.withColumns({"__p": _parts(F.col("__c"), time_needed), "__ms": F.when(F.col("__c").rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"), F.floor(F.col("__c").try_cast("double") / 1000))})
    p = lambda k: F.col("__p").getItem(k)
    zone = F.translate(p(6), ":+-", "")
    staged = staged.withColumns({
        "__w": F.when(F.col("__p").isNotNull(), F.concat_ws("-", p(0), F.lpad(p(1), 2, "0"), F.lpad(p(2), 2, "0"))),
        "__h": _int(p(3)), "__i": _int(p(4)), "__s": _int(p(5)),
        "__z": F.when(p(6) == "", F.lit(_DEFAULT_OFFSET_S)).when(F.upper(p(6)) == "Z", F.lit(0)).otherwise(
            F.when(p(6).startswith("-"), F.lit(-1)).otherwise(F.lit(1)) * (F.substring(zone, 1, 2).try_cast("int") * 3600 + F.substring(zone, 3, 2).try_cast("int") * 60)),
    })
    day = F.datediff(F.col("__w").try_cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    ok = (F.col("__h") <= 23) & (F.col("__i") <= 59) & (F.col("__s") <= 59) & (F.abs(F.col("__z")) <= 18 * 3600)
    second = F.when(ok, day * 86400 + F.col("__h") * 3600 + F.col("__i") * 60 + F.col("__s") - F.col("__z"))
    staged = staged.withColumn(out, F.struct(F.col("__w").alias("written"), F.coalesce(second, F.col("__ms").cast("bigint")).alias("second")))
    return staged.drop("__c", "__p", "__ms", "__w", "__h", "__i", "__s", "__z")


def with_reading(df: DataFrame, o: str = "o", value_type: str = "value_type", unit: str = "unit") -> DataFrame:
    """Adds ``state``, ``canon`` and ``shown`` (the trimmed text, null unless ``ok``); see the module."""
    kind = F.col(value_type)
    df = df.withColumn("__t", trimmed(F.col(o)))
    df = df.withColumns({
        "__l": F.lower(F.col("__t")),
        "__u": F.when(kind == "double", without_currency(F.upper(F.col("__t")))).when(kind == "bigint", F.upper(F.col("__t"))),
    })
    u = F.col("__u")
    df = with_instant(df, "__t", "__at", kind == "timestamp")
    amount = F.translate(F.regexp_extract(u, r"^\+?(-?[0-9]+(?:[.,][0-9]+)?)\s*(?:MB|GB)$", 1), ",", ".").try_cast("decimal(28,9)")
    df = df.withColumns({
        "__n": F.when(kind == "double", number_text(u).try_cast("double") + F.lit(0.0)),
        "__whole": F.when((kind == "bigint") & u.rlike(r"^[+-]?[0-9]+(?:[.,]0+)?$"), F.regexp_replace(u, r"^\+|[.,]0+$", "").try_cast("bigint")),
        "__mb": F.when((kind == "bigint") & (F.upper(F.col(unit)) == "MB"), amount * F.when(u.endswith("GB"), F.lit(1024)).otherwise(F.lit(1))),
    })
    is_missing = F.col(o).isNull() | F.col("__l").isin(*MISSING) | ((kind == "timestamp") & F.coalesce(F.col("__at.written").isin(*SENTINEL_DATES), F.lit(False)))
    canon = (
        F.when(kind == "double", F.when(F.abs(F.col("__n")) < F.lit(float("inf")), F.col("__n").cast("string")))
        .when(kind == "bigint", F.coalesce(F.col("__whole"), F.when(F.col("__mb") == F.floor(F.col("__mb")), F.col("__mb").try_cast("bigint"))).cast("string"))
        .when(kind == "boolean", boolean_of(F.col("__l")).cast("string"))
        .when(kind == "timestamp", F.col("__at.second").cast("string"))
        .otherwise(F.col("__l"))
    )
    df = df.withColumns({"__miss": is_missing, "__canon": canon})
    df = df.withColumns({
        "state": F.when(F.col("__miss"), F.lit("missing")).when(F.col("__canon").isNull(), F.lit("bad")).otherwise(F.lit("ok")),
        "canon": F.when(~F.col("__miss"), F.col("__canon")),
        "shown": F.when(~F.col("__miss") & F.col("__canon").isNotNull(), F.col("__t")),
    })
    return fenced(df.drop("__t", "__l", "__u", "__at", "__n", "__whole", "__mb", "__miss", "__canon"))


def typed(canon: Column, shown: Column, value_type: str) -> Column:
    """The value of a ``canon`` in its type; texts as shown."""
    if value_type == "timestamp":
        return F.timestamp_seconds(canon.cast("bigint"))
    if value_type in ("double", "bigint", "boolean"):
        return canon.cast(value_type)
    return shown
