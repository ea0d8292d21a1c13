"""Nested documents into related flat tables: shared inlining.

``schema_graph`` reads which members occur under which elements, of what kind and how often. ``plan_tables`` decides from that
graph: an element that repeats or recurs, or is shared by several parents and has members of varying shape, gets a table of its
own, and so do the elements in OWN_TABLES, whatever the documents hold; a singleton is inlined into its nearest table as columns named by its path (``validFor.startDateTime``). As JSON has no
references, a singleton value object of the same name under several parents (``validFor``) is inlined in each. ``shred`` then
emits the rows of all tables in one pass, each with its own key and the key of its parent, and ``flat_tables`` gives each table with its columns, typed.
Whether elements of one name under several parents are one table follows from the members they have in all documents: at least half of
the smaller set of members and two fifths of all in common (SAME_SMALLER, SAME_ALL).

An element is known by (member of its parent, its own member), so products within products are one recursive element, while
the parts of a price of the same member name are another; elements of one member name and mostly the same members are one
shared table.

Scale: two passes over the documents, no shuffle but for the schema graph, whose size is that of the schema and is checked
(MAX_EDGES). One document at a time is in memory.

Defined results: null, blank, cut-off or otherwise unreadable documents give one row in the table ``unreadable`` with the reason;
JSON kept as a JSON string is read through; null members and null list elements give no row, but count in the places of a
path; an empty object gives a row without columns; a string where an object is usual gives a row with the string in a column
of the element's name, a number or boolean one in the column OTHER_SCALAR; documents ingested twice are two documents.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..functions.values import SENTINEL_DATES, fenced, with_instant
from ..storage import new_path

MAX_EDGES = 50_000
SAME_SMALLER, SAME_ALL = 0.5, 0.4
ROOT = "customer"
#: Elements (parent, own) that have a table, be they lists, objects or plain values.
OWN_TABLES = {(ROOT, "account"), (ROOT, "contract"), ("contract", "product"), ("contract", "resource"), ("product", "comprisedOf"), ("comprisedOf", "comprisedOf")} | {
    (p, "status") for p in (ROOT, "account", "contract", "product", "comprisedOf", "resource")
}
#: The column of an element written as a number or boolean.
OTHER_SCALAR = "#value"
EDGES = "parent string, own string, member string, n long, objects long, lists long, scalars long, below string"
ROWS = "id long, tab string, node int, parent_tab string, parent_node int, path string, parent_path string, ordinal int, fields map<string,string>"
_ROWS = pa.schema(
    [("id", pa.int64()), ("tab", pa.string()), ("node", pa.int32()), ("parent_tab", pa.string()), ("parent_node", pa.int32()), ("path", pa.string()), ("parent_path", pa.string()), ("ordinal", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))]
)


def load_document(text: str | None) -> tuple[dict | None, str]:
    """The object of a document, or None and the reason."""
    if text is None:
        return None, "null"
    value: object = text
    while isinstance(value, str):  # each reading takes two quotes at least
        if not value.strip():
            return None, "blank"
        try:
            value = json.loads(value)
        except (ValueError, RecursionError) as e:
            return None, "cut off or damaged" if isinstance(e, ValueError) else "too deep"
    return (value, "") if isinstance(value, dict) else (None, "no object")


def _text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False)


def _elements(value: object) -> Iterator[tuple[str, int, object]]:
    """(index text, ordinal, value) of a member: itself, or each element of a list, of lists in it too."""
    if not isinstance(value, list):
        yield "", 0, value
        return
    stack = [(f"[{i}]", x) for i, x in reversed(list(enumerate(value)))]
    n = 0
    while stack:
        at, x = stack.pop()
        if isinstance(x, list):
            stack += [(f"{at}[{i}]", y) for i, y in reversed(list(enumerate(x)))]
        else:
            yield at, n, x
            n += 1


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        below: dict[tuple[str, str, str], set[str]] = defaultdict(set)
        for text in batch.column(0).to_pylist():
            doc, _ = load_document(text)
            stack: list[tuple[str, str, dict]] = [("", ROOT, doc)] if doc is not None else []
            while stack:
                parent, own, node = stack.pop()
                for member, value in node.items():
                    e = seen[(parent, own, member)]
                    e[0] += 1
                    e[2] += isinstance(value, list)
                    for _, _, x in _elements(value):
                        if isinstance(x, dict):
                            e[1] += 1
                            below[(parent, own, member)].update(x)
                            stack.append((own, member, x))
                        else:
                            e[3] += x is not None
        rows = [[*k, *v, json.dumps(sorted(below[k]))] for k, v in seen.items()]
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.string()] * 3 + [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["parent", "own", "member", "n", "objects", "lists", "scalars", "below"])


def schema_graph(docs: DataFrame, data: str = "data") -> DataFrame:
    """``(parent, own, member, n, objects, lists, scalars, members)``: one row per member of an element (parent, own)."""
    raw = docs.select(F.col(data).cast("string")).mapInArrow(_edges, EDGES)
    return raw.groupBy("parent", "own", "member").agg(
        *(F.sum(c).alias(c) for c in ("n", "objects", "lists", "scalars")),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.from_json("below", "array<string>"))))).alias("members"),
    )


def plan_tables(graph: DataFrame) -> dict[tuple[str, str], str]:
    """The table of each element (parent, own) that has one. An action; raises beyond MAX_EDGES rows of the graph."""
    edges = graph.limit(MAX_EDGES + 1).collect()
    if len(edges) > MAX_EDGES:
        raise ValueError("the documents use more member names than a schema has: their keys look like data")
    members: dict[tuple[str, str], set[str]] = {}
    repeated: set[tuple[str, str]] = set()
    nested: set[tuple[str, str]] = set()
    for e in edges:
        if e.objects or e.lists:
            members[(e.own, e.member)] = members.get((e.own, e.member), set()) | set(e.members)
            nested.add((e.parent, e.own))
            if e.lists:
                repeated.add((e.own, e.member))
    by_name: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for k in sorted(members):
        by_name[k[1]].append(k)
    tables: dict[tuple[str, str], str] = {("", ROOT): ROOT}
    for name, kinds in by_name.items():
        groups: list[list[tuple[str, str]]] = []
        for k in kinds:
            for g in groups:
                one, two = members[g[0]], members[k]
                if not one or not two or len(one & two) >= SAME_SMALLER * min(len(one), len(two)):
                    same = one == two or len(one & two) >= SAME_ALL * len(one | two)
                    if same or not one or not two:
                        g.append(k)
                        break
            else:
                groups.append([k])
        for g in groups:
            recursive = any(k[0] == k[1] for k in g)
            shared = len(g) > 1 and any(k in nested for k in g) and any(k in repeated for k in g)
            if recursive or shared or any(k in repeated or k in OWN_TABLES for k in g):
                label = name if len(groups) == 1 or g is max(groups, key=lambda x: (len(x), sum(len(members[k]) for k in x))) else f"{g[0][0]}_{name}"
                tables |= {k: label for k in g}
    labels = set(tables.values())
    for e in edges:  # written as a plain value here, as an element elsewhere
        if (e.member in labels or (e.own, e.member) in OWN_TABLES) and e.member != e.own and not e.objects and not e.lists:
            tables.setdefault((e.own, e.member), e.member)
    return tables


def shred(docs: DataFrame, tables: dict[tuple[str, str], str], doc_id: str = "id", data: str = "data") -> DataFrame:
    """All rows of all tables: ``ROWS``. ``(id, node)`` is the key of a row, ``(id, parent_node)`` that of its parent."""

    def rows_of(key: int, text: str | None) -> Iterator[tuple]:
        doc, why = load_document(text)
        if doc is None:
            yield key, "unreadable", 0, None, None, "", None, 0, {"reason": why}
            return
        stack: list[tuple] = [(("", ROOT), doc, None, None, "", None, 0)]
        node = 0
        while stack:
            kind, value, parent_tab, parent_node, path, parent_path, ordinal = stack.pop()
            fields: dict[str, str | None] = {}
            me, tab = node, tables[kind]
            node += 1
            below: list[tuple] = []
            if not isinstance(value, dict):
                fields[kind[1] if isinstance(value, str) else OTHER_SCALAR] = _text(value)
            inner = [(kind, "", path, value)] if isinstance(value, dict) else []
            while inner:
                at, prefix, here, obj = inner.pop()
                for member, x in obj.items():
                    child, spot = (at[1], member), f"{here}.{member}" if here else member
                    if child in tables:
                        below += [(child, y, tab, me, spot + i, path, n) for i, n, y in _elements(x) if y is not None]
                    elif isinstance(x, dict):
                        inner.append((child, f"{prefix}{member}.", spot, x))
                    elif x is not None:
                        fields[prefix + member] = _text(x)
            yield key, tab, me, parent_tab, parent_node, path, parent_path, ordinal, fields
            stack += reversed(below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for r in rows_of(key, text):
                    out.append((*r[:8], list(r[8].items())))
                if len(out) >= 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * len(_ROWS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROWS)], schema=_ROWS)

    return docs.select(F.col(doc_id).cast("long"), F.col(data).cast("string")).mapInArrow(run, ROWS)


def relational(docs: DataFrame, doc_id: str = "id", data: str = "data") -> DataFrame:
    """``shred`` by the tables planned for these documents. An action (the schema graph)."""
    return shred(docs, plan_tables(schema_graph(docs, data)), doc_id, data)


def flat(rows: DataFrame, tabs: list[str], fields: dict[str, str], extra: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """The table of ``tabs`` with a column per entry of ``fields`` (name -> member path).

    With ``path`` also the rows at such paths that are in other tables: elements that differ in shape have tables called ``<parent>_<name>``."""
    picked = [F.col("fields").getItem(member).alias(name) for name, member in fields.items()]
    mine = F.col("tab").isin(*tabs)
    return rows.where(mine | F.col("path").rlike(path) if path else mine).select("id", "node", "parent_tab", "parent_node", "path", *extra, *picked)


TYPES = ("bigint", "double", "boolean", "string")


def columns_of(rows: DataFrame) -> list[tuple[str, str, str]]:
    """``(table, member path, type)`` of all columns of all tables, by the values they hold: whole numbers, numbers, booleans or texts.
    An action; as many rows as the schema has members, checked against MAX_EDGES."""
    v = F.col("value")
    cells = rows.select("tab", F.explode("fields").alias("member", "value")).where(v.isNotNull())
    kinds = cells.groupBy("tab", "member").agg(
        F.min(v.rlike(r"^-?(0|[1-9][0-9]{0,17})$").cast("int")).alias("whole"), F.min(v.rlike(r"^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?$").cast("int")).alias("number"), F.min(v.isin("true", "false").cast("int")).alias("truth")
    )
    kind = F.when(F.col("whole") == 1, "bigint").when(F.col("number") == 1, "double").when(F.col("truth") == 1, "boolean").otherwise("string")
    found = kinds.select("tab", "member", kind.alias("kind")).orderBy("tab", "member").limit(MAX_EDGES + 1).collect()
    if len(found) > MAX_EDGES:
        raise ValueError("more columns than a schema has")
    return [tuple(r) for r in found]


def flat_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Every table of the rows of ``shred`` with all its columns, typed: ``id``, ``node`` (its key), ``parent_tab``, ``parent_node``, ``path``, ``parent_path``,
    ``ordinal``, and a column per member path. The rows are shredded once and written, partitioned by table. An action.

    A member called like a key column gets ``member.`` before its name; names that differ in case only are told apart by a number.
    """
    spark = rows.sparkSession
    path = new_path(spark, "tables")
    rows.write.partitionBy("tab").parquet(path)
    kept = spark.read.schema(rows.schema).parquet(path)
    by_table: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for tab, member, kind in columns_of(kept):
        by_table[tab].append((member, kind))
    keys = ["id", "node", "parent_tab", "parent_node", "path", "parent_path", "ordinal"]
    tabs = [r.tab for r in kept.select("tab").distinct().limit(MAX_EDGES).collect()]
    out: dict[str, DataFrame] = {}
    for tab in sorted(tabs):
        taken = {k.lower() for k in keys}
        picked = []
        for member, kind in by_table[tab]:
            name = f"member.{member}" if member.lower() in keys else member
            n = 1
            while name.lower() in taken:
                n += 1
                name = f"{member}.{n}"
            taken.add(name.lower())
            picked.append(F.col("fields").getItem(member).cast(kind).alias(name))
        out[tab] = kept.where(F.col("tab") == tab).select(*keys, *picked)
    return out


def with_usable_start(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the instant of a start date, or null: epoch milliseconds (numbers, also as strings), or a date with or without
    time, without an offset in -03:00; neither on a sentinel date as written nor in UTC."""
    df = with_instant(df.withColumn("__text", trimmed(F.col(text))), "__text", "__at", time_needed=False)
    possible = (F.col("__at.second") >= -62135596800) & (F.col("__at.second") < 253402300800 + 86400)
    df = df.withColumn("__possible", F.when(possible, F.timestamp_seconds(F.col("__at.second"))))
    in_utc = F.date_format(F.col("__possible"), "yyyy-MM-dd").isin(*SENTINEL_DATES)
    as_written = F.coalesce(F.col("__at.written").isin(*SENTINEL_DATES), F.lit(False))
    return fenced(df.withColumn(out, F.when(~in_utc & ~as_written, F.col("__possible"))).drop("__text", "__at", "__possible"))


#: Paths of the status entries of a customer, account, contract, product or resource.
STATUS_PATH = r"^(account(\[\d+\])*\.|contract(\[\d+\])*\.(product(\[\d+\])*\.(comprisedOf(\[\d+\])*\.)*|resource(\[\d+\])*\.)?)?status(\[\d+\])*$"

#: Paths of the products, in contracts and at any depth within products, and of the resources of contracts.
PRODUCT_PATH = r"^contract(\[\d+\])*\.product(\[\d+\])*(\.comprisedOf(\[\d+\])*)*$"
RESOURCE_PATH = r"^contract(\[\d+\])*\.resource(\[\d+\])*$"
ACCOUNT_PATH, CONTRACT_PATH = r"^account(\[\d+\])*$", r"^contract(\[\d+\])*$"


def statuses(rows: DataFrame) -> DataFrame:
    """The status entries with their start date as written and as instant."""
    rows = rows.where(~F.map_contains_key("fields", F.lit(OTHER_SCALAR)))  # objects and strings are entries
    got = flat(rows, ["status"], {"status": "status", "reason": "reason", "start_written": "validFor.startDateTime", "end_written": "validFor.endDateTime"}, path=STATUS_PATH)
    return with_usable_start(got.where(F.col("path").rlike(STATUS_PATH)), "start_written", "start_at")


def undated(rows: DataFrame) -> DataFrame:
    """Status entries without a usable start: ``(id, path)``."""
    return statuses(rows).where(F.col("start_at").isNull()).select("id", "path")
