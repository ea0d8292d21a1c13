from tripleflow.operators import ml, triples


def test_trees_learn_and_give_rules(spark):
    rows = spark.createDataFrame([(i, float(i % 10), float(i * 7 % 13), float(i % 10 > 5)) for i in range(200)], "k int, a double, b double, y double")
    model = ml.boosted(["a", "b"], "y", 3, 2).fit(rows)
    got = ml.probability(model, rows).collect()
    assert all((r.p > 0.5) == (r.y == 1) for r in got)
    rules = ml.tree_rules(model, ["a", "b"], least=0.5)
    assert rules and all(t.startswith("valid_data(X) <= " if v > 0 else "invalid_data(X) <= ") and "(a(X), " in t for t, v in rules) and any(v < 0 for _, v in rules)
    assert ml.importances(model, ["a", "b"])[0][0] == "a"


def test_structure_features(spark):
    flat = triples.json_to_triples(spark.createDataFrame([(1, '{"a": {"b": [1, null]}, "d": "2024-01-02"}'), (2, "{}")], "id long, d string"), "id", "d")
    r = ml.structure_features(flat).collect()
    assert len(r) == 1 and (r[0].n_leaves, r[0].n_int, r[0].n_null, r[0].max_depth, r[0].n_dates, r[0].n_in_lists) == (3, 1, 1, 3, 1, 2)
