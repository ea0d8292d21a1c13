"""Functions of one's own over rows: mapped in order, best of several, and registered for SQL.

Defined results: a function that raises gives a row with the error and a null result, the others go on; of equal ranks the earlier function wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import numbered


def mapped(df: DataFrame, order: list[str], f: Callable[[dict[str, Any]], Any], kind: str = "string") -> DataFrame:
    """``(place, result, error)``: ``f`` of each row, as a dict, with the row's place in ``order``. Batches of rows go to Python by Arrow. An action (the places)."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(T._parse_datatype_string(kind))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, errors = [], []
            for row in batch.select(names).to_pylist():
                try:
                    got.append(f(row))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    got.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(len(names)), pa.array(got, arrow), pa.array(errors, pa.string())], ["place", "result", "error"])

    return numbered(df, order, "place").select(*names, "place").mapInArrow(run, f"place long, result {kind}, error string")


def best_of(df: DataFrame, key: str, fs: dict[str, Callable[[dict[str, Any]], Any]], rank: Callable[[Any], float], kind: str = "string") -> DataFrame:
    """``(key, name, result, rank)``: for each row the result that ranks highest among those of the functions; failures and nulls don't count, and a row
    without a result has nulls."""
    from pyspark.sql.pandas.types import to_arrow_type

    key_kind = dict(df.dtypes)[key]
    arrow = to_arrow_type(T._parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                best: tuple = (None, None, None)
                for name, f in fs.items():
                    try:
                        got = f(row)
                        value = None if got is None else float(rank(got))
                    except Exception:  # noqa: BLE001, S112
                        continue
                    if value is not None and (best[2] is None or value > best[2]):
                        best = (name, got, value)
                out.append(best)
            cols = [list(c) for c in zip(*out)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array(cols[0], pa.string()), pa.array(cols[1], arrow), pa.array(cols[2], pa.float64())], [key, "name", "result", "rank"])

    return df.mapInArrow(run, f"{key} {key_kind}, name string, result {kind}, rank double")


def register(spark: SparkSession, name: str, f: Callable, kind: str, aggregate: bool = False) -> None:
    """Registers a function of pandas series for SQL: of rows, or with ``aggregate`` of groups, which must fit in memory."""
    if aggregate:

        def grouped(v: pd.Series) -> float:
            return f(v)

        spark.udf.register(name, F.pandas_udf(grouped, kind))
    else:

        def each(v: pd.Series) -> pd.Series:
            return v.map(f)

        spark.udf.register(name, F.pandas_udf(each, kind))


def register_rows(spark: SparkSession, name: str, f: Callable[..., Iterator[tuple]], schema: str) -> None:
    """Registers a function that gives rows for SQL's FROM."""

    class Rows:
        def eval(self, *args: Any) -> Iterator[tuple]:
            yield from f(*args)

    spark.udtf.register(name, F.udtf(Rows, returnType=schema))
