"""Small fixtures of the graph, relational, triple, file, vector and workflow operators."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tripleflow.operators import embed, graph, metrics, ordered, relational, triples
from tripleflow.plans.workflow import Workflow, evaluate, render
from tripleflow.sources import files

T = "s string, p string, o string"


def sparse_graph(spark):
    rows = [(f"user_{i}", "has_product", f"product_{i % 20}") for i in range(100)] + [(f"user_{i}", "special_offer", f"offer_{i}") for i in range(30)]
    rows += [(f"user_sparse_{i}", "has_product", f"product_{i}") for i in range(10)] + [(f"user_{i}", "uses_service", f"service_{i % 10}") for i in range(50)] + [(f"user_{i}", "location", f"city_{i % 5}") for i in range(50)]
    return spark.createDataFrame(rows, T)


def test_graph_quality_and_filters(spark):
    t = sparse_graph(spark)
    q = graph.quality(t).first()
    assert (q.n_triples, q.n_entities, q.n_relations, q.min_degree, q.max_degree, q.n_low_degree, q.n_rare_relations) == (240, 175, 4, 1, 10, 90, 1)
    assert q.density == pytest.approx(240 / (175**2 * 4)) and q.mean_degree == pytest.approx(480 / 175) and q.median_degree == 1
    kept = graph.filter_sparse(t)
    assert kept.count() == 150 and graph.balance_relations(kept).count() == 150
    assert {r.p for r in kept.select("p").distinct().collect()} == {"has_product", "uses_service", "location"}
    assert graph.quality(t.limit(0)).first().n_triples == 0


def test_loops_and_degrees(spark):
    t = spark.createDataFrame([("a", "p", "a")], T)
    assert graph.degree(t).first().degree == 2 and graph.degree_rows(t).first().degree == 1


def test_vocabulary_and_index(spark):
    t = spark.createDataFrame([("b", "p", "a"), ("b", "q", "c"), ("a", "p", "é")], T)
    e = graph.vocabulary(graph.entity_labels(t))
    assert [tuple(r) for r in e.orderBy("id").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "é")]
    more = graph.extend_vocabulary(e, spark.createDataFrame([("z",), ("a",)], "label string"))
    assert more.count() == 5 and more.where("label = 'z'").first().id == 4
    v = graph.validate_map(e).first()
    assert v.is_dense and v.is_unique
    r = graph.vocabulary(t.select(F.col("p").alias("label")))
    assert graph.index_triples(t, e.where("label <> 'é'"), r).count() == 2 and graph.unmapped(t, e.where("label <> 'é'")).collect()[0].entity == "é"


def test_numbers_over_ranges(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit(2).alias("x"))
    assert [r.n for r in ordered.numbered(df, ["k"], "n", 1).orderBy("k").collect()] == list(range(1, 501))
    assert ordered.running(df, ["k"], {"sum": "x"}).where("k = 499").first()["sum"] == 1000
    assert ordered.numbered(df.limit(0), ["k"]).count() == 0


def test_exact_split_and_sample(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("k"))
    counts = {r.split: r["count"] for r in relational.exact_split(df, ["k"]).groupBy("split").count().collect()}
    assert counts == {"train": 82, "valid": 10, "test": 11}
    one, two = ({r.k for r in relational.exact_sample(df.repartition(n), ["k"], 20).collect()} for n in (1, 7))
    assert one == two and len(one) == 20


def test_criteria(spark):
    df = spark.createDataFrame([("x", 1, "abc"), ("y", 5, "abd"), ("z", None, None)], "k string, a_b int, t string")
    ks = lambda c: {r.k for r in relational.search(df, c).collect()}
    assert ks({}) == {"x", "y", "z"} and ks({"a.b": {"gt": 1, "what": 3}}) == {"y"} and ks({"t": {"contains": "^ab[cd]$"}, "k": ["x", "z"]}) == {"x"} and ks({"no": 1}) == set()


def test_json_to_triples_and_back(spark):
    doc = {"id": 1, "a": {"b": [1, {"c": None}, [2, 3]], "e": {}, "l": []}, "t": True, "x": 1.5}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps([{"k": "v"}, {"k": "w"}])), (3, "{bad"), (4, None), (5, "[]"), (6, '[["s","p","o"]]'), (7, "3")], "id long, d string")
    flat = triples.json_to_triples(df, "id", "d")
    got = {(r.doc_id, r.s, r.p, r.o, r.o_type) for r in flat.collect()}
    assert {(x[2], x[3], x[4]) for x in got if x[0] == 1} == {("id", "1", "int"), ("a.b[0]", "1", "int"), ("a.b[1].c", None, "null"), ("a.b[2]", "[2, 3]", "json"), ("t", "true", "bool"), ("x", "1.5", "double")}
    assert {x[1:4] for x in got if x[0] == 2} == {("entity_0", "k", "v"), ("entity_1", "k", "w")} and {x[1:4] for x in got if x[0] == 6} == {("s", "p", "o")}
    assert {x[0] for x in got} == {1, 2, 6}
    back = {r.s: json.loads(r.data) for r in triples.triples_to_json(flat.where("doc_id = 1")).collect()}
    assert back["entity_0"] == {"id": 1, "a": {"b": [1, {"c": None}, [2, 3]]}, "t": True, "x": 1.5}


def test_nested_search(spark):
    docs = [{"a": {"s": [{"v": 1}, {"v": 2}]}, "k": "x"}, {"a": {"s": [{"v": 3}]}, "k": "x"}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "id long, d string")
    hits = lambda *c: {r.doc_id for r in triples.search_documents(df, "id", "d", list(c)).collect()}
    assert hits({"s": [{"v": 2}]}) == {0} and hits({"k": "x"}, {"v": 3}) == {1} and hits({"ANY": "x"}) == {0, 1} and hits({"k": "ANY"}) == {0, 1} and hits({"v": True}) == set()


def test_text_to_triples(spark):
    lines = [
        "{", "id: A1", '"name": "Ana",', "\tqux: 3", "empty:", "note: {", "a b c", "one two three four five", "s1\tp 1\to\t1", "two words", '"quoted line here', "1970-01-01 was it",
        "date: 9999-12-31T00", "id: 1970-01-01", "after: x", "],", "http://x/y: 1", "",
    ]
    got = [tuple(r) for r in triples.text_to_triples(spark.createDataFrame([(7, "\n".join(lines)), (8, None), (9, "\r\n key : v \r\n")], "id long, t string"), "id", "t").orderBy("doc_id", "line").collect()]
    assert got == [
        (7, 1, "A1", "id", "A1"), (7, 2, "A1", "name", "Ana"), (7, 3, "A1", "qux", "3"), (7, 4, "A1", "line_4", "empty:"), (7, 6, "a", "b", "c"), (7, 7, "one", "two", "three four five"),
        (7, 8, "s1", "p 1", "o 1"), (7, 9, "s1", "line_9", "two words"), (7, 10, "s1", "line_10", '"quoted line here'), (7, 14, "s1", "after", "x"), (7, 16, "s1", "http", "//x/y: 1"), (9, 1, "document_9", "key", "v"),
    ]


def test_tasks_and_rows(spark):
    lines = [("55119999988887 - cancel",), ("5511999998888 block it",), ("55119999988",), ("12 - x",), ("5511999998888 - status",)]
    got = {tuple(r) for r in triples.parse_tasks(spark.createDataFrame(lines, "l string"), "l", "default").collect()}
    assert got == {("5511999998888", "block"), ("55119999988", "default"), ("5511999998888", "status")}
    rows = spark.createDataFrame([(" a\t", "p", None), ("b", "p", "1970-01-01T00:00"), ("c", "p", "o")], T)
    assert [tuple(r) for r in triples.rows_to_triples(rows, "s", "p", "o").orderBy("s").collect()] == [("a", "p", ""), ("c", "p", "o")]
    assert triples.rows_to_triples(rows, "s", "p", "o", True).count() == 1


def test_files(spark, tmp_path):
    d = f"file://{tmp_path}"
    (tmp_path / "a.csv").write_text("x;y\n1;é\n2;b,c\n", "latin-1")
    assert [tuple(r) for r in files.read(spark, f"{d}/a.csv").orderBy("x").collect()] == [("1", "é"), ("2", "b,c")]
    (tmp_path / "a.tsv").write_text("1\t2\n3\t4\n")
    assert files.read(spark, f"{d}/a.tsv").columns == ["column_1", "column_2"]
    (tmp_path / "e.json").write_text("")
    assert files.read(spark, f"{d}/e.json").count() in (0, 1)
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("in/customer_enquiry_5511.txt", '{"a": 1}')
        z.writestr("latin_7.txt", "é".encode("latin-1"))
        z.writestr("skip.bin", b"\0")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    members = files.read(spark, f"{d}/*.zip")
    assert {(r.msisdn, r.data) for r in files.enquiries(members).collect()} == {("5511", '{"a": 1}'), ("7", "é")}
    assert members.where("text is null").count() == 1
    (tmp_path / "r.json").write_text(json.dumps({"cat": [{"id": "1", "confidence": 0.5, "pattern": "h(A) <= b(A)"}, {"id": None}]}))
    assert [tuple(r) for r in files.read_rules_json(spark, f"{d}/r.json").collect()] == [("cat", "1", 0.5, "h(A) <= b(A)")]
    (tmp_path / "rules.tsv").write_text("10\t5\t0.5\th(X) <= b(X)\nq(X) <= r(X)\n")
    assert {tuple(r) for r in files.read_rules_tsv(spark, f"{d}/rules.tsv").collect()} == {(10, 5, 0.5, "h(X) <= b(X)"), (100, 100, 1.0, "q(X) <= r(X)")}
    with pytest.raises(ValueError):
        files.read(spark, f"{d}/x.docx")
    assert files.sniff_separator("a\tb\n") == "\t" and io.StringIO("x").read() == "x"


def test_curves_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "score double, label int")
    assert metrics.roc_auc(df, "score", "label").first()[0] == pytest.approx((0.5 + 1 + 1 + 0) / 4 + 0.0)
    assert metrics.average_precision(df, "score", "label").first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3, abs=1e-8)
    assert metrics.roc_auc(df.where("label = 1"), "score", "label").first()[0] == 0.5
    assert metrics.best_threshold(df, "score", "label").first().threshold == 0.5


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "id long, v array<double>")
    asked = df.where("id = 1").toDF("query", "qv")
    assert [r.id for r in embed.nearest(df, "id", "v", asked, 3).orderBy("place").collect()] == [2, 3, 4]
    assert [r.id for r in embed.nearest(df, "id", "v", asked, 2, "euclid").orderBy("place").collect()] == [2, 3]
    e = df.select(F.col("id").cast("string").alias("label"), "v")
    t = spark.createDataFrame([("1", "1", "2"), ("1", "1", "9")], T)
    assert [r.score for r in embed.score_triples(t, e, e).orderBy(F.desc("score")).collect()] == [0.0, float("-inf")]


def test_workflow(spark):
    flow = Workflow(spark, {"a": [{"set": "x", "value": "{{ 2 + 3 }}"}, {"when": "x > 9", "set": "y", "value": 1}, {"loop_over": "items", "next_sequence": "b"}], "b": [{"method": "m", "args": {"v": "<{{ item }}>"}, "save_as": "z"}]}, {"m": lambda v: seen.append(v) or v})
    seen: list[str] = []
    out = flow.run("a", {"items": [1, 2]})
    assert out["x"] == 5 and "y" not in out and "z" not in out and seen == ["<1>", "<2>"] and flow.lint() == []
    assert Workflow(spark, {"a": [{"set": "x"}, {"method": "n", "next_sequence": "q"}]}, {}).lint() == ["a[0]: set without value", "a[1]: method and next_sequence", "a[1]: unknown sequence q", "a[1]: unknown method n"]
    assert render("{{ missing }}", {}) is False and evaluate("'a' in d and not (1 > 2)", {"d": {"a": 1}}) is True
    with pytest.raises(ValueError):
        evaluate("().__class__", {})


def test_nearest_to_many(spark):
    rows = spark.range(5200).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    asked = rows.select(F.col("id").alias("query"), F.col("v").alias("qv"))
    got = {r.query: r.id for r in embed.nearest(rows, "id", "v", asked, 1, "euclid").collect()}
    assert got == {i: abs(i - 1) for i in range(5200)}
