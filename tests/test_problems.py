"""Attribute rows, nested documents, heavy keys and references, against plain Python on small tables."""

import json
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tripleflow.operators import eav, nested, references, skew

MAP = "id long, label string, value_type string, unit string, multi_valued boolean, o_is_entity boolean"
RELATIONS = [(0, "size", "bigint", "MB", False, False), (1, "name", "string", None, False, False), (2, "fee", "double", None, False, False), (3, "tag", "string", None, True, False), (4, "on", "boolean", None, False, False)]
TRIPLES = "s string, p string, o string, p_extra int, canon string"


def _wide(spark, rows, block=2):
    t = spark.createDataFrame([(*r, 1, "clash") for r in rows], TRIPLES)
    return eav.pivot_blocks(t, spark.createDataFrame(RELATIONS, MAP), block_size=block)


def test_wide_rows_and_conflicts(spark):
    rows = [
        ("a", "size", "1 GB"), (" A", "size", "1024"), ("a", "name", "Xy"), ("a", "name", "xY "), ("a", "fee", "1,50"), ("a", "fee", "1.5"), ("a", "tag", "q"), ("a", "tag", "p"), ("a", " on", "sim"),
        ("b", "size", "x"), ("b", "size", "5"), ("b", "name", "u"), ("b", "name", "v"), ("b", "fee", "n/a"), ("c", "unknown", "1"), ("d", None, None), (None, "size", "1"), ("a", "size", "1 GB"),
    ]
    for block in (1, 2, 8):
        got = {r.s: r.asDict() for r in _wide(spark, rows, block).collect()}
        assert set(got) == {"A", "B", "C", "D"}
        assert got["A"] == {"s": "A", "size": 1024, "name": "Xy", "fee": 1.5, "tag": ["p", "q"], "on": True, "unfilled": [], "unreadable": [], "overflow": []}
        assert got["B"]["size"] is None and got["B"]["name"] is None and got["B"]["fee"] is None and sorted(got["B"]["unfilled"]) == ["name", "size"]
        assert got["C"]["unfilled"] == [] and got["D"]["size"] is None


def test_wide_flags_only_and_large_cells(spark):
    rows = [("a", "tag", str(i)) for i in range(5)] + [("a", "size", "x"), ("b", "tag", "1"), ("b", "tag", "1 ")]
    t = spark.createDataFrame(rows, "s string, p string, o string")
    maps = spark.createDataFrame(RELATIONS, MAP)
    flags = {r.s: r.asDict() for r in eav.pivot_blocks(t, maps, 2, values=False).collect()}
    assert flags == {"A": {"s": "A", "unfilled": ["size"], "unreadable": ["size"]}, "B": {"s": "B", "unfilled": [], "unreadable": []}}
    got = {r.s: r for r in eav.pivot_blocks(t, maps, 2, most=3).collect()}
    assert got["A"].tag is None and got["A"].overflow == ["tag"] and got["B"].tag == ["1"] and got["B"].overflow == []
    assert eav.multi_values(t, maps).where("s = 'A'").count() == 5  # what the wide table leaves to it


def test_many_attributes_in_blocks(spark):
    n = 40
    maps = spark.createDataFrame([(i, f"a{i}", "bigint", None, i % 2 == 0, False) for i in range(n)], MAP)
    t = spark.createDataFrame([(f"e{j}", f"a{i}", str(i * j)) for i in range(n) for j in range(3)], "s string, p string, o string")
    got = {r.s: r for r in eav.pivot_blocks(t, maps, block_size=7).collect()}
    assert all(got[f"E{j}"][f"a{i}"] == ([i * j] if i % 2 == 0 else i * j) for i in range(n) for j in range(3))


def test_wide_of_nothing(spark):
    empty = _wide(spark, [])
    assert empty.count() == 0 and dict(empty.dtypes)["fee"] == "double"
    no_attributes = eav.pivot_blocks(spark.createDataFrame([("a", "x", "1")], "s string, p string, o string"), spark.createDataFrame([], MAP))
    assert [r.s for r in no_attributes.collect()] == ["A"]


def test_multi_values(spark):
    t = spark.createDataFrame([("a", "tag", "Q"), ("a", "tag", "q "), ("a", "tag", None), ("b", "tag", "r"), ("b", "name", "z")], "s string, p string, o string")
    got = eav.multi_values(t, spark.createDataFrame(RELATIONS, MAP)).collect()
    assert {tuple(r) for r in got} == {("A", "tag", "q", 2), ("B", "tag", "r", 1)}


DOC = {
    "id": "c", "status": "on", "account": [{"id": "a", "status": None}, None, {"id": "b", "status": [{"status": "x", "validFor": {"startDateTime": 0}}, None, "y", 5]}],
    "contract": [{"id": "k", "product": [{"id": "p", "price": [{"comprisedOf": [{"id": "t", "tax": None}]}], "comprisedOf": [{"id": "q", "status": {"status": "z", "validFor": {"startDateTime": "28/02/2024 16:39:20"}}, "comprisedOf": [{"id": "r", "status": [{"validFor": None}]}]}]}], "resource": []}],
}


def test_nested_documents(spark):
    docs = [(1, json.dumps(DOC)), (2, json.dumps(json.dumps(DOC))), (3, None), (4, "  "), (5, '{"id": "c", "status'), (6, "[1]"), (7, "{}")]
    df = spark.createDataFrame([(i, d, "x") for i, d in docs], "id long, data string, path string")
    rows = nested.relational(df).cache()
    want = {"status", "account[2].status[0]", "account[2].status[2]", "contract[0].product[0].comprisedOf[0].comprisedOf[0].status[0]"}
    found = nested.undated(rows).collect()
    for i in (1, 2):
        assert {r.path for r in found if r.id == i} == want
    assert {r.id for r in found} == {1, 2}
    assert {r.id for r in rows.where("tab = 'unreadable'").collect()} == {3, 4, 5, 6}
    tabs = Counter(r.tab for r in rows.where("id = 1").collect())
    assert tabs["comprisedOf"] == 2 and tabs["price_comprisedOf"] == 1 and tabs["product"] == 1 and tabs["account"] == 2
    # every row but the root has its parent
    orphan = rows.alias("a").join(rows.selectExpr("id", "node as parent_node"), ["id", "parent_node"], "left_anti").where("parent_node is not null")
    assert orphan.count() == 0
    rows.unpersist()


def test_json_kept_in_strings_and_flat_tables(spark):
    text = json.dumps(DOC)
    for _ in range(6):
        text = json.dumps(text)
    assert nested.load_document(text)[0] == DOC
    doc = {"id": "c", "path": "p", "contract": [{"id": 1, "price": [{"amount": 1.5}, {"amount": 2}], "on": True}, {"id": 2, "On": "x", "price": [{"amount": -3}]}]}
    tables = nested.flat_tables(nested.relational(spark.createDataFrame([(1, json.dumps(doc)), (2, None)], "id long, data string")))
    assert {"customer", "contract", "price", "unreadable"} <= set(tables)
    assert dict(tables["price"].dtypes)["amount"] == "double" and dict(tables["contract"].dtypes)["member.id"] == "bigint" and {"On", "on.2"} <= set(tables["contract"].columns)
    joined = tables["price"].alias("x").join(tables["contract"].select("id", F.col("node").alias("parent_node"), F.col("`member.id`").alias("c")), ["id", "parent_node"])
    assert {(r.amount, r.c) for r in joined.collect()} == {(1.5, 1), (2.0, 1), (-3.0, 2)}
    assert tables["customer"].first()["member.path"] == "p"


def test_elements_that_never_are_lists(spark):
    at = {"validFor": {"startDateTime": "a definir"}}
    doc = {
        "status": {"status": "on", **at}, "account": {"id": "a", "status": {"status": "x", "reason": "r", "changedBy": "me", **at}},
        "contract": {"id": "k", "resource": {"id": "r", "status": "y"}, "product": {"id": "p", "status": {"note": "z"}, "comprisedOf": {"id": "q", "status": {"status": "w", **at}}}},
    }
    rows = nested.relational(spark.createDataFrame([(1, json.dumps(doc))], "id long, data string")).cache()
    where = {"status", "account.status", "contract.resource.status", "contract.product.status", "contract.product.comprisedOf.status"}
    assert {r.path for r in nested.undated(rows).collect()} == where
    assert {r.path for r in nested.flat(rows, ["product", "comprisedOf"], {"p": "id"}, path=nested.PRODUCT_PATH).collect()} == {"contract.product", "contract.product.comprisedOf"}
    assert [(r.path, r.p) for r in nested.flat(rows, ["resource"], {"p": "id"}, path=nested.RESOURCE_PATH).collect()] == [("contract.resource", "r")]
    rows.unpersist()
    plain = spark.createDataFrame([(1, json.dumps({"status": "on"}))], "id long, data string")
    assert [r.path for r in nested.undated(nested.relational(plain)).collect()] == ["status"]


def test_start_dates(spark):
    cases = [
        ("2019-10-04T23:07:37.393-03:00", True), ("1585332138725", True), ("1970-01-01T22:59:59.151-03:00", False), ("1969-12-31T22:00:00-03:00", False), ("0", False), ("86399999", False), ("86400000", True), ("31/12/9999 23:59:59", False),
        ("9999-12-30T23:00:00-03:00", False), ("a definir", False), (" ", False), ("0000-00-00", False), ("2023-02-30", False), ("2023-02-28", True), ("2024-12-28 04:39:08", True), ("1.5e12", True), (None, False), ("2024-01-01T24:00:00Z", False),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = nested.with_usable_start(df, "t", "at").orderBy("i").collect()
    assert [(c[0], r.at is not None) for c, r in zip(cases, got)] == cases


def test_heavy_keys(spark):
    rows = [("hot", f"s{i % 7}", f"o{i % 11}") for i in range(3000)] + [("mild", "s", str(i)) for i in range(180)] + [(None, "s", "o")] * 20 + [("rare", None, None)]
    df = spark.createDataFrame(rows, "p string, s string, o string").repartition(5)
    got = {r.key: r for r in skew.profile(df, df.p, {"subjects": df.s, "objects": df.o}, fan_in=2).collect()}
    assert (got["hot"]["rows"], got["hot"].subjects, got["hot"].objects) == (3000, 7, 11)
    assert (got["rare"]["rows"], got["rare"].subjects) == (1, 0) and set(got) == {"hot", "mild", "rare"}
    assert {r.key for r in skew.heavy_keys(df, df.p, 0.05).collect()} == {"hot", "mild"}
    assert skew.profile(df.limit(0), df.p).count() == 0


T0 = datetime(2024, 1, 1)
LIVES = "label string, added_at timestamp, deleted_at timestamp"
REFS = "tab string, field string, row_id long, key string, at timestamp"
_day = st.integers(0, 70)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), _day, st.none() | _day), max_size=8), st.lists(st.tuples(st.sampled_from("abc"), _day), max_size=12))
def test_references_against_plain_python(spark, lives, refs):
    at = lambda d: None if d is None else T0 + timedelta(days=d)
    life = references.life_deltas(spark.createDataFrame([(k.lower() + " ", at(a), at(b)) for k, a, b in lives], LIVES), "label", "added_at", "deleted_at")
    ref = spark.createDataFrame([("t", "s", i, k.upper(), at(d)) for i, (k, d) in enumerate(refs)], REFS)
    want = {i for i, (k, d) in enumerate(refs) if not any(k == x and a <= d and (b is None or d < b) for x, a, b in lives)}
    assert {r.row_id for r in references.orphans(life, ref).collect()} == want


def test_hot_reference_key(spark):
    lives = spark.createDataFrame([("hot", T0, None), ("gone", T0, T0 + timedelta(days=5))], LIVES)
    refs = spark.range(30_000).selectExpr("'t' tab", "'s' field", "id row_id", "if(id % 3 = 0, 'GONE', 'HOT') key", "timestamp'2024-01-03' + make_interval(0, 0, 0, cast(id % 4 as int)) at")
    found = references.orphans(references.life_deltas(lives, "label", "added_at", "deleted_at"), refs, rows_a_task=500)
    want = sum(1 for i in range(30_000) if i % 3 == 0 and 3 + i % 4 >= 6)
    assert found.count() == want
    assert references.report(found).collect()[0].n_refs == want


def test_state_kept_from_period_to_period(spark):
    life = spark.createDataFrame([("A", T0, 1), ("A", T0 + timedelta(days=40), -1), ("B", T0 + timedelta(days=3), 1)], "key string, at timestamp, delta long")
    refs = spark.createDataFrame([("t", "s", i, k, T0 + timedelta(days=d)) for i, (k, d) in enumerate([("A", 1), ("A", 50), ("B", 5), ("C", 60)])] + [("t", "s", 9, "C", None)], REFS)
    once = {tuple(r) for r in references.maintained(life, refs, []).collect()}
    assert once == {tuple(r) for r in references.maintained(life, refs, ["2024-01-10", "2024-02-15"]).collect()} == {("A", 2, 0), ("B", 1, 1), ("C", 2, 0)}


def test_signed_counts_accumulate(spark):
    life = lambda rows: spark.createDataFrame(rows, "key string, at timestamp, delta long")
    ref = lambda keys: spark.createDataFrame([("t", "s", i, k, T0) for i, k in enumerate(keys)], REFS)
    first = references.merge_state(None, life([("A", T0, 1)]), ref(["A", "B"]))
    second = references.merge_state(first, life([("A", T0, -1), ("B", T0, 1)]), ref(["A"]))
    assert {tuple(r) for r in references.current_orphans(first).collect()} == {("B", 1)}
    assert {tuple(r) for r in references.current_orphans(second).collect()} == {("A", 2)}


