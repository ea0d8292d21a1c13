"""Filters by criteria, exact samples and splits, lookups, ranks, unions and upserts."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered

_OPERATORS = {
    "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "ne": lambda c, v: c != v,
    "contains": lambda c, v: c.rlike(v), "startswith": lambda c, v: c.startswith(v), "endswith": lambda c, v: c.endswith(v),
}


def criteria_condition(columns: list[str], criteria: dict[str, Any]) -> Column:
    """All criteria at once: a list means one of, a dict operators (unknown ones are ignored; ``contains`` is a regular expression), else
    equality. ``a.b`` is the column ``a_b``. No criteria hold for every row; a criterion on a missing column for none."""
    parts: list[Column] = []
    for key, wanted in criteria.items():
        name = key.replace(".", "_")
        if name not in columns:
            return F.lit(False)
        c = F.col(name)
        if isinstance(wanted, dict):
            parts += [_OPERATORS[op](c, v) for op, v in wanted.items() if op in _OPERATORS]
        else:
            parts.append(c.isin(*wanted) if isinstance(wanted, (list, tuple)) else c == wanted)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(df: DataFrame, criteria: dict[str, Any], limit: int | None = None) -> DataFrame:
    """The rows that meet all criteria, the first ``limit`` of them if it is given."""
    found = df.where(criteria_condition(df.columns, criteria))
    return found if limit is None else found.limit(limit)


def match_patterns(triples: DataFrame, criteria: dict[str, str]) -> DataFrame:
    """Triples that meet any criterion predicate -> object, each as often as it does; ``*`` is any predicate or any object."""
    hits = []
    for p, o in criteria.items():
        cond = F.lit(True) if p == "*" else (F.col("p") == p) if o == "*" else (F.col("p") == p) & (F.col("o") == o)
        hits.append(triples.where(cond))
    return reduce(DataFrame.unionAll, hits) if hits else triples.limit(0)


def lookup(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """The distinct triples with the given parts."""
    bound = {c: v for c, v in (("s", s), ("p", p), ("o", o)) if v is not None}
    return triples.select("s", "p", "o").where(reduce(lambda a, b: a & b, (F.col(c) == v for c, v in bound.items()), F.lit(True))).distinct()


def hash_order(keys: list[str], seed: str = "42") -> Column:
    """A fixed pseudo-random order of rows, by md5 of their keys and a seed."""
    return F.md5(F.concat_ws("|", F.lit(seed), *keys))


def exact_split(df: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.8, 0.1, 0.1), names: tuple[str, ...] = ("train", "valid", "test"), seed: str = "42") -> DataFrame:
    """``df`` with ``split``: shares of the rows, truncated to whole rows, in a pseudo-random order; the rest goes to the last. An action."""
    n = df.count()
    placed = numbered(df.withColumn("__h", hash_order(keys, seed)), ["__h", *keys], "__rn").drop("__h")
    split, edge = F.lit(names[-1]), 0
    bounds = []
    for share, name in list(zip(shares, names))[:-1]:
        edge += int(n * share)
        bounds.append((edge, name))
    for edge, name in reversed(bounds):
        split = F.when(F.col("__rn") < edge, F.lit(name)).otherwise(split)
    return placed.withColumn("split", split).drop("__rn")


def exact_sample(df: DataFrame, keys: list[str], n: int, seed: str = "42") -> DataFrame:
    """Exactly ``n`` rows (or all), without replacement, by a pseudo-random order."""
    return df.withColumn("__h", hash_order(keys, seed)).orderBy("__h", *keys).limit(n).drop("__h")


def chunked(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``df`` with ``chunk``, consecutive chunks of ``size`` rows. An action."""
    return numbered(df, order, "__rn").withColumn("chunk", F.floor(F.col("__rn") / size)).drop("__rn")


def union_diagonal(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert_latest(kept: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last in ``order`` (new rows come last). Combined where the rows are, so a hot key costs a row per task."""
    both = kept.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    whole = F.struct(*(F.col(f"`{c}`") for c in kept.columns))
    return both.groupBy(F.col(key).alias("__key")).agg(F.max_by(whole, F.struct("__new", *order)).alias("__row")).select("__row.*")


def touched(kept: DataFrame, new: DataFrame, key: str, at: str = "updated_at") -> DataFrame:
    """``kept`` after ``new`` is put in by ``key``: rows that change get the current time in ``at``, those that don't keep theirs. ``new`` has a row per key."""
    values = [c for c in kept.columns if c not in (key, at)]
    j = kept.withColumn("__old", F.lit(True)).alias("a").join(new.withColumn("__in", F.lit(True)).alias("b"), key, "full")
    differs = reduce(lambda x, y: x | y, (~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in values), F.col("__old").isNull())
    moved = F.col("__in").isNotNull() & differs
    cols = {c: F.when(F.col("__in").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) for c in values}
    return j.select(key, *(v.alias(c) for c, v in cols.items()), F.when(moved, F.current_timestamp()).otherwise(F.col(f"a.{at}")).alias(at)).select(*kept.columns)


def update_from(df: DataFrame, other: DataFrame, key: str, other_key: str, column: str, default: Any = None) -> DataFrame:
    """``df`` with ``column`` of the row of ``other`` that its key names, else the default; ``other`` has a row per key."""
    there = other.select(F.col(other_key).alias("__k"), F.col(column).alias("__v"))
    return df.join(there, df[key] == F.col("__k"), "left").withColumn(column, F.coalesce("__v", F.lit(default)) if default is not None else F.col("__v")).drop("__k", "__v")


def top_by(df: DataFrame, value: str, tie: str, n: int = 10) -> DataFrame:
    """The ``n`` rows of greatest value, ties by the smaller ``tie``; nulls don't count."""
    return df.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), tie).limit(n)


def lookup_strict(df: DataFrame, key: str, labels: DataFrame, name: str = "id") -> DataFrame:
    """``df`` with the id of its ``key`` in the map (id, label); a key that isn't there is an error when the row is read."""
    j = df.join(labels.select(F.col("label").alias(key), F.col("id").alias("__id")), key, "left")
    missing = F.raise_error(F.concat(F.lit("not in the map: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return j.withColumn(name, F.when(F.col("__id").isNull(), missing.cast("long")).otherwise(F.col("__id"))).drop("__id")


def predicate_counts(t: DataFrame, doc: str, names: list[str]) -> DataFrame:
    """A row per document with a column per predicate of ``names``, in that order: how often it occurs."""
    return t.groupBy(doc).agg(*(F.count_if(F.col("p") == n).alias(n) for n in names))


def group_samples(t: DataFrame, sample: str, order: str) -> DataFrame:
    """``(sample, triples)``: the triples of each sample in order; a row without a sample is one of its own, by its ``order``. A sample fits in memory."""
    own = F.coalesce(F.col(sample).cast("string"), F.concat(F.lit("row_"), F.col(order).cast("string")))
    got = t.groupBy(own.alias("sample")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), "s", "p", "o"))).alias("l"))
    return got.select("sample", F.transform("l", lambda x: F.struct(x["s"].alias("s"), x["p"].alias("p"), x["o"].alias("o"))).alias("triples"))


def counts_by(df: DataFrame, column: str, default: str = "unknown") -> DataFrame:
    """Rows per value of a column; null counts as the default."""
    return df.groupBy(F.coalesce(column, F.lit(default)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def coerced_map(df: DataFrame) -> DataFrame:
    """``(id, label)`` of any table: its first whole-number column and its first text column; the last id of a label holds. Raises without them."""
    text = next((c for c, t in df.dtypes if t == "string"), None)
    number = next((c for c, t in df.dtypes if t in ("bigint", "int", "smallint", "tinyint")), None)
    if text is None or number is None:
        raise ValueError("a map has a text and a whole-number column")
    return df.select(F.col(f"`{number}`").cast("long").alias("id"), F.col(f"`{text}`").alias("label")).where("id is not null and label is not null").groupBy("label").agg(F.max("id").alias("id")).select("id", "label")


def breaks(df: DataFrame, by: list[str], order: str, value: str, name: str = "brk") -> DataFrame:
    """``df`` with a flag where ``value`` differs from the one before in its group; the first row counts."""
    return df.withColumn(name, ~F.col(value).eqNullSafe(F.lag(value).over(Window.partitionBy(*by).orderBy(order))))


def upsert_greatest(kept: DataFrame, new: DataFrame) -> DataFrame:
    """Unique triples with their greatest confidence."""
    cols = ["s", "p", "o", "confidence"]
    return kept.select(*cols).unionByName(new.select(*cols)).groupBy("s", "p", "o").agg(F.max("confidence").alias("confidence"))


def ranked(df: DataFrame, by: list[str], score: str, tie: str, name: str = "rank") -> DataFrame:
    """Ordinal rank within ``by`` by falling score; ties go to the smaller ``tie``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)))


def rolling_mean(df: DataFrame, by: list[str], order: list[str], value: str, size: int, name: str) -> DataFrame:
    """The mean of the last ``size`` rows, fewer at the beginning."""
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - size, 0)))


def best_so_far(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The running maximum ``best`` and the ``order`` value that first reached it, ``best_at``."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max(value).over(run)).withColumn("best_at", F.max_by(F.col(order[0]), F.struct(F.col(value), -F.col(order[0]))).over(run))


def changes(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in their group; the first row counts."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    marked = df.withColumn("__change", first | ~F.col(value).eqNullSafe(before))
    return marked.where("__change").drop("__change")


def numeric_columns(df: DataFrame) -> DataFrame:
    """String columns that hold digits only become bigint, if all values fit. An action: one pass for all columns."""
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return df
    fits = df.agg(*(F.coalesce(F.bool_and(F.col(f"`{c}`").rlike(r"^\d+$") & F.col(f"`{c}`").try_cast("bigint").isNotNull()), F.lit(False)).alias(str(i)) for i, c in enumerate(names))).first()
    return df.withColumns({c: F.col(f"`{c}`").cast("bigint") for i, c in enumerate(names) if fits[str(i)]})


def violations_of(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with ``broken``, the names of the checks they break. A check that is null isn't broken."""
    broken = F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in checks.items())))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cascade(children: DataFrame, deleted: DataFrame, key: str, parent_key: str) -> DataFrame:
    """The children whose parent isn't deleted; those without a parent stay."""
    return children.join(deleted.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def query(df: DataFrame, sql: str, name: str) -> DataFrame:
    """The result of a SQL text over ``df`` as table ``name``."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(sql)
