"""Link prediction, rules on pairs, stand-ins and preparation, against plain Python on small graphs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripleflow.operators import embed, finders, linkpred, metrics, oov, prepare, relational, rules
from tripleflow import storage
from tripleflow.sources import files

SPO = "s string, p string, o string"


def graph(seed, n=12, facts=60):
    dice = random.Random(seed)
    names = [f"e{i}" for i in range(n)]
    t = {(dice.choice(names), dice.choice(["p", "q"]), dice.choice(names)) for _ in range(facts)}
    v = {x: [dice.choice([0.0, 0.5, 1.0]) for _ in range(3)] for x in names}
    r = {"p": [0.5, 0.0, -0.5], "q": [0.0, 0.5, 0.0]}
    return sorted(t), v, r


def frames(spark, t, v, r):
    e = spark.createDataFrame([(i, x, w) for i, (x, w) in enumerate(sorted(v.items()))], "id long, label string, v array<double>")
    return spark.createDataFrame(t, SPO), e, spark.createDataFrame([(i, x, w) for i, (x, w) in enumerate(sorted(r.items()))], "id long, label string, v array<double>")


def score(v, r, h, p, t):
    return -round(math.sqrt(sum((a + b - c) ** 2 for a, b, c in zip(v[h], r[p], v[t]))), 9)


@pytest.mark.parametrize("blocks", [(8192, 2048), (5, 4)])
def test_ranks_and_best_tails(spark, monkeypatch, blocks):
    monkeypatch.setattr(linkpred, "ENTITIES", blocks[0])
    monkeypatch.setattr(linkpred, "PAIRS", blocks[1])
    t, v, r = graph(1)
    test = [*t[:15], t[0], ("nobody", "p", "e1")]
    known, e, rel = frames(spark, t, v, r)
    ids = {x: i for i, x in enumerate(sorted(v))}
    for hide in (True, False):
        want = {}
        for s, p, o in set(test):
            if s in v:
                own = score(v, r, s, p, o)
                rest = [x for x in v if x != o and not (hide and (s, p, x) in t)]
                want[s, p, o] = 1 + sum(score(v, r, s, p, x) > own or (score(v, r, s, p, x) == own and ids[x] < ids[o]) for x in rest)
            else:
                want[s, p, o] = None
        got = linkpred.rank_filtered(spark.createDataFrame(test, SPO), known, e, rel, hide).collect()
        assert {(x.s, x.p, x.o): x["rank"] for x in got} == want and len(got) == len(want)
    found = linkpred.predict(spark.createDataFrame(test, SPO), known, e, rel, 3).collect()
    for s, p in {(s, p) for s, p, _ in test if s in v}:
        best = sorted((-score(v, r, s, p, x), ids[x], x) for x in v if (s, p, x) not in t)[:3]
        assert [x.o for x in sorted((x for x in found if (x.s, x.p) == (s, p)), key=lambda x: x.place)] == [x for _, _, x in best]
    heads = linkpred.predict(spark.createDataFrame(test, SPO), known, e, rel, 2, tail=False).collect()
    for p, o in {(p, o) for _, p, o in test}:
        best = sorted((-score(v, r, x, p, o), ids[x], x) for x in v if (x, p, o) not in t)[:2]
        assert [x.s for x in sorted((x for x in heads if (x.p, x.o) == (p, o)), key=lambda x: x.place)] == [x for _, _, x in best]


def test_equal_vectors_are_met_once(spark, monkeypatch):
    """60 entities of 3 vectors, with crowds of ties: right ranks, and a block holds each vector once."""
    dice = random.Random(5)
    names = [f"e{i:02d}" for i in range(60)]
    v = {x: [[0.0, -0.0, 1.0], [0.5, 0.0, 0.0], [1.0, 1.0, 0.0]][i % 3] for i, x in enumerate(names)}
    t, r = sorted({(dice.choice(names), "p", dice.choice(names)) for _ in range(150)}), {"p": [0.25, 0.0, 0.25]}
    known, e, rel = frames(spark, t, v, r)
    ids = {x: i for i, x in enumerate(names)}
    for most in (linkpred.ROWS, 7):
        monkeypatch.setattr(linkpred, "ROWS", most)
        for x in linkpred.rank_filtered(known, known, e, rel).collect():
            own, rest = score(v, r, x.s, x.p, x.o), [y for y in names if y != x.o and (x.s, x.p, y) not in t]
            assert x["rank"] == 1 + sum(score(v, r, x.s, x.p, y) > own or (score(v, r, x.s, x.p, y) == own and ids[y] < ids[x.o]) for y in rest)
        found = linkpred.predict(known, known, e, rel, 25).collect()
        for s in {s for s, _, _ in t}:
            best = sorted((-score(v, r, s, "p", y), ids[y], y) for y in names if (s, "p", y) not in t)[:25]
            assert [y.o for y in sorted((y for y in found if y.s == s), key=lambda y: y.place)] == [y for _, _, y in best]
    block = linkpred._packed(e.withColumn("block", F.lit(0)), "id", False).first()
    assert (len(block.ids), len(block.vectors)) == (60 * 8, 3 * 3 * 8)


def test_metrics_of_ranks_and_flags(spark):
    ranked = spark.createDataFrame([(1,), (2,), (None,), (20,)], "rank long")
    m = linkpred.rank_metrics(ranked).first()
    assert (m.n, m.hits_1, m.hits_3, m.hits_10) == (3, pytest.approx(1 / 3, abs=1e-8), pytest.approx(2 / 3, abs=1e-8), pytest.approx(2 / 3, abs=1e-8)) and m.mrr == pytest.approx((1 + 0.5 + 0.05) / 3, abs=1e-8)
    assert linkpred.rank_metrics(ranked.limit(0)).first().mrr == 0
    scores = spark.createDataFrame([("tail", "p", "a", "b", 0.9), ("head", "p", "b", "a", 0.5), ("head", "p", "a", "b", 0.5)], "direction string, rel string, src string, cand string, score double")
    got = {(x.direction, x.src): x.is_true for x in linkpred.true_flags(scores, spark.createDataFrame([("a", "p", "b"), ("a", "p", "b")], SPO)).collect()}
    assert got == {("tail", "a"): 1, ("head", "b"): 1, ("head", "a"): 0}
    one = spark.createDataFrame([(1, 0.9, 1), (2, 0.1, 1)], "cand int, score double, label int")
    m = metrics.all_metrics(one, "score", "cand", "label").first()
    assert (m.roc_auc, m.average_precision, m.mrr, m.accuracy) == (0.5, 1.0, 1.0, 0.5)
    none = metrics.mrr_hits(one.withColumn("label", F.lit(0)).withColumn("q", F.lit(1)), ["q"], "score", "cand", "label").first()
    assert (none.n_true, none.n_queries, none.mrr, none.hits_10) == (0, 2, 0.0, 0.0)


def test_training_brings_facts_near(spark):
    t = [(i, 0, (i + 1) % 30) for i in range(30)] + [(i, 1, (i * 7) % 30) for i in range(30)]
    indexed = spark.createDataFrame(t, "s_id long, p_id long, o_id long")

    def loss(epochs):
        v = {(x.kind, x.id): x.v for x in embed.train_transe(indexed, 30, 2, 8, epochs, rate=0.1).collect()}
        assert len(v) == 32
        return sum(math.sqrt(sum((a + b - c) ** 2 for a, b, c in zip(v["entity", s], v["relation", p], v["entity", o]))) for s, p, o in t)

    assert loss(8) < 0.9 * loss(0)


def test_training_in_blocks_is_repeatable(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 7)
    indexed = spark.createDataFrame([(i, 0, (i * 3) % 20) for i in range(20)], "s_id long, p_id long, o_id long")
    one, two = ({(x.kind, x.id): [round(y, 9) for y in x.v] for x in embed.train_transe(indexed, 20, 1, 4, 2).collect()} for _ in (0, 1))
    assert one == two and len(one) == 21


def test_training_leaves_only_the_last_vectors_on_disk(spark, monkeypatch):
    import glob

    monkeypatch.setattr(embed, "BLOCK", 5)
    monkeypatch.setattr(embed, "FACTS", 4)
    monkeypatch.setattr(embed, "TASKS", 3)
    folder = storage.local_path(storage.shared_dir(spark))
    count = lambda name: len(glob.glob(f"{folder}/tripleflow/{name}-*"))
    before = count("blocks"), count("moves")
    indexed = spark.createDataFrame([(i, 0, (i * 3 + 1) % 23) for i in range(23)], "s_id long, p_id long, o_id long")
    got = embed.train_transe(indexed, 23, 2, 4, 3)
    assert (count("blocks"), count("moves")) == (before[0] + 1, before[1])
    rows = got.collect()
    assert len(rows) == 25 and {(x.kind, x.id) for x in rows} == {*(("entity", i) for i in range(23)), ("relation", 0), ("relation", 1)}


def test_rules_conclude_about_pairs(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("b", "q", "d"), ("a", "r", "c"), ("x", "p", "a"), ("a", "p", "b")], SPO)
    rs = rules.parse_rules([("one", "r(X,Y) <= p(X,Z), q(Z,Y)", 0.5), ("two", "r(X,Y) <= p(Y,X)", 0.2), ("const", "r(X,'k') <= p(X,Z)", 0.9), ("self", "r('a',Y) <= p(Y,Z)", 1.0)], fixed=True)
    got = rules.derived(t, rs, spark.createDataFrame([("a", "r"), ("a", "r"), ("b", "p")], "s string, p string"))
    assert {tuple(x) for x in got.collect()} == {("one", 0.5, "a", "r", "c"), ("one", 0.5, "a", "r", "d"), ("two", 0.2, "a", "r", "x"), ("const", 0.9, "a", "r", "k")}
    assert {(x.o, tuple(x.rules)) for x in rules.explained(got).collect()} == {("c", ("one",)), ("d", ("one",)), ("x", ("two",)), ("k", ("const",))}
    assert rules.derived(t, [], t.select("s", "p")).count() == 0


def test_noisy_or_of_certain_rules(spark):
    ev = spark.createDataFrame([("a", "r", "x", 1.0), ("a", "r", "x", 0.5), ("a", "r", "y", 1.0), ("a", "r", "z", 0.5), ("a", "r", "z", 0.5)], "src string, rel string, cand string, confidence double")
    got = {x.cand: (x.score, x["rank"]) for x in rules.rank_candidates(ev, ev.limit(0).select("src", "rel", "cand")).collect()}
    assert got == {"x": (1.0, 1), "y": (1.0, 2), "z": (0.75, 3)}


def test_reports_and_their_words(spark):
    t = spark.createDataFrame([(1, "a", "p", "b"), (1, "a", "s", "c"), (2, "a", "p", "b"), (2, "b", "q", "a"), (3, "z", "t", "z")], "doc int, " + SPO)
    rs = rules.parse_rules([("r1", "q(Y,X) <= p(X,Y)", 0.8), ("r2", "t(X,X) <= t(X,Y)", 0.4)], fixed=True)
    scores = spark.createDataFrame([(2, 0.9), (3, 0.4)], "doc int, score double")
    got = {x.doc: x for x in rules.validated(t, rs, "doc", scores).collect()}
    assert got[1].n_violations == 1 and not got[1].is_valid and got[1].confidence_score == 0.4 and got[1].hybrid_score == 0.2
    assert "'q(b, a)'" in got[1].diagnostic and "[X='a', Y='b']" in got[1].diagnostic and got[1].top_violations == [got[1].diagnostic]
    assert got[2].is_valid and got[2].confidence_score == pytest.approx((0.64 + 0.16) / 1.2) and not got[3].is_valid and got[3].n_violations == 0


def test_candidates_for_unknown_labels(spark):
    known = ["CITY_00011", "CITY_00012", "OFF_99", "Ana Lima", "12345"]
    unknown = ["CITY_00013", "1234", "?", None]
    got = oov.candidates(spark.createDataFrame([(x,) for x in unknown], "label string"), spark.createDataFrame([(x,) for x in known], "label string")).collect()
    for label in unknown[:3]:
        want = sorted(((round(oov.alike(label, k), 9), k) for k in known if oov.alike(label, k) > 0.5), reverse=True)[:3]
        assert [(x.score, x.candidate) for x in sorted((x for x in got if x.label == label), key=lambda x: x.place)] == want
    e = spark.createDataFrame([(k, [float(i), 1.0]) for i, k in enumerate(known)], "label string, v array<double>")
    near = {x.label: x.v for x in oov.stand_ins(spark.createDataFrame([("CITY_00013",), ("?",)], "label string"), e).collect()}
    assert near["?"] == [2.0, 1.0] and near["CITY_00013"][1] == pytest.approx(1.0) and near["CITY_00013"][0] < 1.2


def test_candidates_are_exact_and_few_pairs_are_compared(spark, monkeypatch, tmp_path):
    dice = random.Random(8)
    draw = lambda n: "".join(dice.choice("0123456789ABCDEF") for _ in range(n))
    known = sorted({*(draw(32) for _ in range(150)), *(f"ENTITY_{dice.randrange(3000)}" for _ in range(60)), "", "A", "ÁB\n", "Z" * 70 + "Y" * 70, "2024-01-02T03:04:05Z", "12", "T\n", "\U0001f600abcd"})
    unknown = [draw(32), "\t" + known[70], known[60][:24], known[50][:4] + draw(28), draw(28) + known[40][-4:], known[30][2:] + "AB", "ENTITY_77", "ENTITY_12345", "", "A", "13", "ÁB", "Y" * 70 + "Z" * 75, "2024-01-03T03:04:06Z", "T", "\U0001f600abce"]
    seen = tmp_path / "seen"
    whole = oov.alike

    def counted(a, b, least=0.0):
        with open(seen, "a") as f:
            f.write(".")
        return whole(a, b, least)

    want = {(a, i + 1): (b, s) for a in unknown for i, (s, b) in enumerate(sorted(((round(oov.alike(a, b), 9), b) for b in known if oov.alike(a, b) > 0.5), reverse=True)[:3])}
    many = spark.createDataFrame([(b,) for b in known], "label string")
    for least_parts in (20_000, 7):
        monkeypatch.setattr(oov, "KNOWN_OF_END", least_parts)
        got = oov.candidates(spark.createDataFrame([(a,) for a in unknown], "label string"), many).collect()
        assert {(x.label, x.place): (x.candidate, x.score) for x in got} == want
    monkeypatch.setattr(oov, "alike", counted)
    labels = oov._Labels([draw(32) for _ in range(500)])
    assert labels.best(draw(32), 3, 0.5, 0.5) is not None and (not seen.exists() or len(seen.read_text()) < 50)


def test_steps_are_skipped_while_nothing_changes(spark, tmp_path):
    source, folder, ran = f"file://{tmp_path}/in", f"file://{tmp_path}/steps", []

    def chain(least):
        steps = prepare.Steps(spark, folder)
        a = steps.run("a", lambda: ran.append("a") or spark.read.parquet(source), [source])
        b = steps.run("b", lambda: ran.append("b") or a.where(F.col("id") >= least), params={"least": least})
        steps.run("c", lambda: ran.append("c") or b.agg(F.count(F.lit(1)).alias("n")))
        return [(x.step, x.skipped) for x in steps.report().orderBy("place").collect()], spark.read.parquet(f"{folder}/c").first().n

    spark.range(10).write.parquet(source)
    assert chain(5) == ([("a", False), ("b", False), ("c", False)], 5) and chain(5) == ([("a", True), ("b", True), ("c", True)], 5)
    assert chain(7) == ([("a", True), ("b", False), ("c", False)], 3)
    spark.range(20).write.mode("overwrite").parquet(source)
    assert chain(7) == ([("a", False), ("b", False), ("c", False)], 13) and len(ran) == 8


def test_optimizing_reaches_the_target(spark):
    rows = [(f"s{i % 20}", "p" if i % 3 else "q", f"o{i % 7}") for i in range(200)] + [("lone", "rare", "one")]
    t = spark.createDataFrame(rows, SPO)
    n = t.distinct().count()
    strict = prepare.filtered(t.distinct(), 0.05, 2, 10 * n)
    assert strict.count() == 0
    got = prepare.optimized(t, prepare.Targets(0.05, 2, 20, n // 2))
    assert got.count() >= n // 2 and got.distinct().count() == got.count() and got.join(t.distinct(), ["s", "p", "o"], "left_anti").where("p <> 'p' and p <> 'q'").count() == 0
    empty = prepare.optimized(t.limit(0), prepare.Targets())
    assert empty.count() == 0


def test_status_shapes():
    ok = finders.status_is
    assert ok({"status": "on"}, "on") and ok({"status": {"status": "on"}}, "on") and ok({"statuses": [None, {"status": "x"}, {"status": "on"}]}, "on")
    assert not ok({"status": []}, "on") and not ok({}, "on") and ok({}, None) and ok({}, "ALL") and not ok({"status": "off"}, "on")
    assert finders.offering_of({"productOffering": {"productOfferingId": "i"}}) == "i" and finders.offering_of({"productOffering": "x"}) is None


def test_small_relational_operators(spark):
    maps = spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string")
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    assert {x.id for x in relational.lookup_strict(rows, "k", maps).collect()} == {1, 2}
    with pytest.raises(Exception, match="not in the map"):
        relational.lookup_strict(rows.union(spark.createDataFrame([("z",)], "k string")), "k", maps).collect()
    with pytest.raises(ValueError):
        relational.coerced_map(rows)
    got = relational.upsert_latest(spark.createDataFrame([(1, "x", 9), (2, "y", 1)], "k int, v string, at int"), spark.createDataFrame([(1, "z", 1), (3, None, 1)], "k int, v string, at int"), "k", ["at"])
    assert {tuple(x) for x in got.collect()} == {(1, "z", 1), (2, "y", 1), (3, None, 1)}


def test_folders_of_files(spark, tmp_path):
    (tmp_path / "top").mkdir()
    (tmp_path / "top" / "a.csv").write_text("x;y\n1;2\n")
    (tmp_path / "top" / "sub").mkdir()
    (tmp_path / "top" / "sub" / "b.csv").write_text("x;y\n3;4\n")
    assert [tuple(r) for r in files.read_folder(spark, f"file://{tmp_path}/top").collect()] == [("1", "2")]
    (tmp_path / "deep" / "one").mkdir(parents=True)
    (tmp_path / "deep" / "one" / "c.csv").write_text("k\n1\n")
    (tmp_path / "deep" / "one" / "d.txt").write_bytes("é".encode("latin-1"))
    assert {tuple(r) for r in files.read_folder(spark, f"file://{tmp_path}/deep").collect()} == {("one/c.csv", "k\n1\n"), ("one/d.txt", "é")}
