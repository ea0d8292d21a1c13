"""Documents, texts and tables into triples and back."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WHITE_CLASS, clean_cell, trimmed
from ..functions.values import SENTINEL_DATES

# Members that hold the table of a document, in order of priority.
TABLE_MEMBERS = ("contract", "product", "customer", "party", "enquiry")


def leaves(value: Any, path: str = "") -> Iterator[tuple[str, Any]]:
    """(path, value) of the leaves of a JSON value in document order: ``a.b``, ``a[0]``; objects in lists are entered, lists in lists are
    leaves, empty objects and lists have none, null is a leaf."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack += reversed([(f"{at}.{k}" if at else k, x) for k, x in v.items()])
        elif isinstance(v, list) and not at.endswith("]\0"):
            stack += reversed([(f"{at}[{i}]" + ("\0" if isinstance(x, list) else ""), x) for i, x in enumerate(v)])
        else:
            yield at.replace("\0", ""), v


def kind_of(v: Any) -> str:
    return {bool: "bool", int: "int", float: "double", str: "string", type(None): "null"}.get(type(v), "json")


def as_text(v: Any) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


FLAT = "doc_id long, seq int, s string, p string, o string, o_type string"


def _per_document(df: DataFrame, doc_id: str, data: str, f: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows (doc_id, *f(text)) of each readable document; others give none. One document at a time."""
    kinds = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(key, *r) for r in f(text)] if text is not None else []
                except (ValueError, RecursionError):
                    continue
            cols = list(zip(*rows)) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, arrow)], schema=arrow)

    return df.select(F.col(doc_id).cast("long"), F.col(data).cast("string")).mapInArrow(run, kinds)


def json_to_triples(df: DataFrame, doc_id: str, data: str) -> DataFrame:
    """``FLAT``: an object is the entity ``entity_0``, the objects of a list ``entity_i``, lists of three are triples as they are."""

    def flatten(text: str) -> list[tuple]:
        v = json.loads(text)
        if isinstance(v, dict):
            v = [v]
        if not isinstance(v, list):
            return []
        out: list[tuple] = []
        if v and all(isinstance(x, list) and len(x) == 3 for x in v):
            out = [(as_text(s), as_text(p), o) for s, p, o in v]
        elif all(isinstance(x, dict) for x in v):
            out = [(f"entity_{i}", p, o) for i, x in enumerate(v) for p, o in leaves(x)]
        return [(n, s, p, as_text(o), kind_of(o)) for n, (s, p, o) in enumerate(out)]

    return _per_document(df, doc_id, data, flatten, FLAT)


def nodes(df: DataFrame, doc_id: str, data: str) -> DataFrame:
    """``(doc_id, seq, path, node)``: all nested objects, each before those in it."""

    def walk(text: str) -> list[tuple]:
        out, stack = [], [("", json.loads(text))]
        while stack:
            at, v = stack.pop()
            if isinstance(v, dict):
                out.append((len(out), at, json.dumps(v, ensure_ascii=False)))
                stack += reversed([(f"{at}.{k}" if at else k, x) for k, x in v.items()])
            elif isinstance(v, list):
                stack += reversed([(f"{at}[{i}]", x) for i, x in enumerate(v)])
        return out

    return _per_document(df, doc_id, data, walk, "doc_id long, seq int, path string, node string")


_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def rebuild(pairs: list[tuple[str, Any]]) -> dict:
    """The object with the given leaves; the last value of a path stays, gaps in lists are null."""
    root: dict = {}
    for path, value in pairs:
        steps = [m.group(1) if m.group(1) is not None else int(m.group(2)) for m in _STEP.finditer(path)]
        at: Any = root
        for step, after in zip(steps, [*steps[1:], None]):
            last = after is None
            if isinstance(step, int):
                at.extend([None] * (step + 1 - len(at)))
            fresh: Any = value if last else [] if isinstance(after, int) else {}
            have = at[step] if isinstance(step, int) else at.get(step)
            if last or not isinstance(have, type(fresh)):
                at[step] = fresh
            at = at[step]
    return root


def triples_to_json(flat: DataFrame) -> DataFrame:
    """``(doc_id, s, data)`` from ``FLAT``: each entity as an object again. An entity's leaves are those of one document."""
    per = flat.groupBy("doc_id", "s").agg(F.array_sort(F.collect_list(F.struct("seq", "p", "o", "o_type"))).alias("l"))

    def build(rows: list) -> str:
        read = lambda r: r["o"] if r["o_type"] == "string" or r["o"] is None else json.loads(r["o"])
        return json.dumps(rebuild([(r["p"], read(r)) for r in rows]), ensure_ascii=False)

    as_json = F.pandas_udf(lambda s: s.map(build), "string")
    return per.select("doc_id", "s", as_json("l").alias("data"))


def rows_to_triples(df: DataFrame, s: str, p: str, o: str, drop_empty: bool = False) -> DataFrame:
    """Cleaned triples of three columns: nulls empty, tabs blanks, trimmed; rows with a sentinel date drop out, with ``drop_empty`` also those
    with an empty part."""
    t = df.select(clean_cell(s).alias("s"), clean_cell(p).alias("p"), clean_cell(o).alias("o"))
    for c in ("s", "p", "o"):
        for d in SENTINEL_DATES:
            t = t.where(~F.col(c).contains(d))
        if drop_empty:
            t = t.where(F.length(c) > 0)
    return t


# Lines and values of brackets only, which say nothing, and the form of a key with its value.
SKIPPED_LINES = ("{", "}", "[", "]", "},", "],", "{}", "[]")
SKIPPED_VALUES = ("{", "[", "{}", "[]")
KEY_VALUE = r"""^\s*["']?([^"':\t]+)["']?\s*:\s*["']?([^"']+)["']?\s*,?\s*$"""
#: Where a text is cut into lines.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def _dateless(*parts: Column) -> Column:
    """Whether no part holds a sentinel date."""
    return reduce(lambda a, b: a & b, (~F.coalesce(c, F.lit("")).contains(d) for c in parts for d in SENTINEL_DATES))


def text_to_triples(docs: DataFrame, doc_id: str, text: str, subject: Column | None = None) -> DataFrame:
    """``(doc_id, line, s, p, o)`` of the lines of texts, numbered from 0.

    Lines of brackets only are skipped. ``key: value`` is said of the current subject, or makes the value of a key ``id`` the current
    subject; without a value, or with a bracket as value, it says nothing. Of other lines that don't begin with a quote, three parts between tabs, or
    else between white space, are a triple whose subject becomes current; the third part is all the rest of the line. Any other
    line is (current, line_<n>, line). The current subject is at first ``subject``, or ``document_<id>``. What holds a sentinel
    date gives no triple and no subject. Null texts have no lines.
    """
    first = subject if subject is not None else F.concat(F.lit("document_"), F.col(doc_id))
    lines = docs.select(F.col(doc_id).alias("doc_id"), first.cast("string").alias("first"), F.posexplode(F.split(F.col(text), LINE_END)).alias("line", "raw")).withColumn("t", trimmed("raw"))
    t = F.col("t")
    lines = lines.where((t != "") & ~t.isin(*SKIPPED_LINES) & ~F.btrim(t, F.lit('",')).isin(*SKIPPED_LINES))
    lines = lines.withColumns({"is_pair": t.rlike(KEY_VALUE), "k": trimmed(F.regexp_extract(t, KEY_VALUE, 1)), "v": trimmed(F.regexp_extract(t, KEY_VALUE, 2))})
    tabs, blanks = F.split(t, "\t", 3), F.split(t, WHITE_CLASS + "+", 3)
    cut = F.when(F.col("is_pair") | t.startswith('"'), None).when(t.contains("\t") & (F.size(tabs) == 3), tabs).when(F.size(blanks) == 3, blanks)
    lines = lines.withColumn("x", F.transform(cut, clean_cell))
    pair = F.when(F.col("is_pair") & (F.col("v") != "") & ~F.col("v").isin(*SKIPPED_VALUES) & _dateless(F.col("k"), F.col("v")), F.struct("k", "v"))
    three = F.when(_dateless(F.col("x")[0], F.col("x")[1], F.col("x")[2]), F.col("x"))
    lines = lines.select("doc_id", "first", "line", "t", "is_pair", pair.alias("kv"), F.col("x").isNotNull().alias("is_three"), three.alias("x"))
    is_id = F.lower("kv.k") == "id"
    based = lines.withColumn("base", F.when(is_id, F.col("kv.v")).when(F.col("x").isNotNull(), F.col("x")[0]))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    current = clean_cell(F.coalesce(F.last("base", ignorenulls=True).over(before), "first"))
    rest = F.when(~F.col("is_pair") & ~F.col("is_three") & _dateless(t), F.struct(F.col("current").alias("s"), F.concat(F.lit("line_"), F.col("line")).alias("p"), clean_cell(t).alias("o")))
    said = (
        F.when(is_id, F.struct(clean_cell(F.col("kv.v")).alias("s"), F.lit("id").alias("p"), clean_cell(F.col("kv.v")).alias("o")))
        .when(F.col("kv").isNotNull(), F.struct(F.col("current").alias("s"), clean_cell(F.col("kv.k")).alias("p"), clean_cell(F.col("kv.v")).alias("o")))
        .when(F.col("x").isNotNull(), F.struct(F.col("x")[0].alias("s"), F.col("x")[1].alias("p"), F.col("x")[2].alias("o")))
        .otherwise(rest)
    )
    return based.withColumn("current", current).select("doc_id", "line", said.alias("said")).where(F.col("said").isNotNull()).select("doc_id", "line", "said.*")


def parse_tasks(texts: DataFrame, text: str, default_sequence: str | None = None) -> DataFrame:
    """``(msisdn, sequence)`` of lines: 11 to 13 digits, then a dash or blank and a word; digits alone take the default, if there is one."""
    t = F.trim(F.col(text))
    number, word = F.regexp_extract(t, r"^(\d{11,13})(?:\s*[-–]\s*|\s+)(\w+)", 1), F.regexp_extract(t, r"^(\d{11,13})(?:\s*[-–]\s*|\s+)(\w+)", 2)
    alone = F.regexp_extract(t, r"^(\d{11,13})$", 1)
    rows = texts.select(F.when(number != "", number).when(alone != "", alone).alias("msisdn"), F.when(number != "", word).otherwise(F.lit(default_sequence)).alias("sequence"))
    return rows.where(F.col("msisdn").isNotNull() & F.col("sequence").isNotNull())


def table_of(v: Any) -> tuple[str, list[dict]] | None:
    """The member that holds the table of a document, and its rows: by priority, else the first list of objects; a list is its own."""
    is_table = lambda x: isinstance(x, list) and bool(x) and all(isinstance(r, dict) for r in x)
    if is_table(v):
        return "list", v
    if isinstance(v, dict):
        for k in [*TABLE_MEMBERS, *v]:
            if is_table(v.get(k)):
                return k, v[k]
    return None


def tabularize(df: DataFrame, doc_id: str, data: str) -> DataFrame:
    """``(doc_id, row, source_type, fields)``: the rows of each document's table, scalars and nested values as text."""

    def rows(text: str) -> list[tuple]:
        got = table_of(json.loads(text))
        return [] if got is None else [(i, got[0], {k: as_text(x) for k, x in r.items()}) for i, r in enumerate(got[1])]

    return _per_document(df, doc_id, data, rows, "doc_id long, row int, source_type string, fields map<string,string>")


def unnest(df: DataFrame, depth: int = 3) -> DataFrame:
    """Struct columns replaced by their fields, ``depth`` levels deep; a name that would occur twice raises."""
    for _ in range(depth):
        structs = [f.name for f in df.schema if isinstance(f.dataType, T.StructType)]
        if not structs:
            break
        out: list[Column] = []
        for f in df.schema:
            out += [F.col(f"`{f.name}`.`{g}`").alias(g) for g in f.dataType.names] if f.name in structs else [F.col(f"`{f.name}`")]
        df = df.select(*out)
        if len(set(df.columns)) < len(df.columns):
            raise ValueError("a field name occurs twice")
    return df


def value_sets(flat: DataFrame) -> DataFrame:
    """``(path, n_values, n)`` of the string leaves by path, places in lists left out."""
    paths = flat.where(F.col("o_type") == "string").withColumn("path", F.regexp_replace("p", r"\[\d+\]", "[]"))
    return paths.groupBy("path", "o").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n"))


def enums(flat: DataFrame, most: int = 10) -> DataFrame:
    """``(path, vals)``: paths with 2 to ``most`` different strings that aren't all dates nor all UUIDs."""
    paths = flat.where((F.col("o_type") == "string")).select(F.regexp_replace("p", r"\[\d+\]", "[]").alias("path"), F.col("o").alias("v")).distinct()
    date, uuid = r"^\d{4}-\d{2}-\d{2}", r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
    few = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("v").rlike(date)).alias("dates"), F.bool_and(F.col("v").rlike(uuid)).alias("uuids"))
    few = few.where(F.col("n").between(2, most) & ~F.col("dates") & ~F.col("uuids")).select("path")
    return paths.join(few, "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list("v")).alias("vals"))


def depth(flat: DataFrame) -> DataFrame:
    """``(doc_id, depth)``: the number of steps of the longest path."""
    return flat.groupBy("doc_id").agg(F.max(F.size(F.split("p", r"[.\[]"))).alias("depth"))


def contains(have: Any, want: Any) -> bool:
    """Whether nested ``have`` meets ``want``: objects member by member (``ANY`` is any member or any value), lists by some element for each
    element wanted."""
    if want == "ANY":
        return True
    if isinstance(want, dict):
        return isinstance(have, dict) and all(any(contains(x, v) for x in have.values()) if k == "ANY" else k in have and contains(have[k], v) for k, v in want.items())
    if isinstance(want, list):
        return isinstance(have, list) and all(any(contains(x, w) for x in have) for w in want)
    return have == want and isinstance(have, bool) == isinstance(want, bool)


def search_documents(df: DataFrame, doc_id: str, data: str, criteria: list[dict]) -> DataFrame:
    """``(doc_id)`` of documents in which each criterion is met by some nested object."""

    def hit(text: str) -> list[tuple]:
        stack, found, todo = [json.loads(text)], [], list(criteria)
        while stack and todo:
            v = stack.pop()
            if isinstance(v, dict):
                todo = [c for c in todo if not contains(v, c)]
                stack += v.values()
            elif isinstance(v, list):
                stack += v
        return found if todo else [()]

    return _per_document(df, doc_id, data, hit, "doc_id long")


def build(members: DataFrame, name: str, text: str, most: int | None = None) -> DataFrame:
    """``(member, line, s, p, o)`` of the texts of a source, each said at first of its name. ``most``: the first so many members by name."""
    rows = members.select(F.col(name).alias("member"), F.col(text).alias("t"))
    if most is not None:
        rows = rows.orderBy("member").limit(most)
    return text_to_triples(rows, "member", "t", F.col("member")).withColumnRenamed("doc_id", "member")


def document_key(data: Column) -> Column:
    """The key under which what was made of a document is kept: the md5 of its text."""
    return F.md5(data)


def ensured(df: DataFrame, doc_id: str, data: str, folder: str) -> DataFrame:
    """``FLAT`` of the documents, flattened once: kept in ``folder`` under a key of the ids and texts of all documents, and read from there the next
    time. An action."""
    from ..sources.files import load_cached, save_cached

    spark = df.sparkSession
    key = df.agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64(doc_id, data).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(data, doc_id)))).first()[0]
    kept = load_cached(spark, folder, key)
    if kept is None:
        save_cached(json_to_triples(df, doc_id, data), folder, key)
        kept = load_cached(spark, folder, key)
    return kept
