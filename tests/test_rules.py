"""Rules against a matcher in plain Python, and the traps of their semantics."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tripleflow.operators import rules as u


def naive(triples, rules):
    """Violations as (rule id, sorted bindings), by nested loops."""
    out = []
    for r in rules:
        states = [{}]
        for p, args in r.body:
            after = []
            for b in states if len(args) >= 2 else []:
                for s, q, o in triples:
                    if p not in ("*", q):
                        continue
                    new, ok = dict(b), True
                    for arg, value in zip(args, (s, o)):
                        if r.is_variable(arg):
                            ok = ok and new.setdefault(arg, value) == value
                        else:
                            ok = ok and r.constant(arg) == value
                    if ok:
                        after.append(new)
            states = after
        for b in states:
            head = [b.get(a, a if r.is_variable(a) else r.constant(a)) for a in r.head[1][:2]]
            if len(head) < 2 or (head[0], r.head[0], head[1]) not in set(triples):
                out.append((r.id, tuple(sorted(b.items()))))
    return sorted(out)


def found(spark, triples, rules):
    t = spark.createDataFrame(triples, "s string, p string, o string")
    return sorted((r.rule_id, tuple(sorted(r.bindings.items()))) for r in u.violations(t, rules).collect())


def test_traps(spark):
    cases = [
        ([("a", "st", "x")], "ok(A,'Z') <= st(A,'BARRED')", False, 1),  # quoted capitals are a variable
        ([("a", "st", "x")], "ok(A,'Z') <= st(A,'BARRED')", True, 0),
        ([("a", "st", "active")], "ok(A,B) <= st(A,'active')", False, 0),  # quotes stay in constants
        ([("a", "st", "active")], "ok(A,B) <= st(A,'active')", True, 1),
        ([("a", "p", "b"), ("a", "q", "c")], "q(A,Z) <= p(A,B)", False, 1),  # a free head variable is its own name
        ([("a", "p", "b")], "q(A,B) <= r(A,B)", False, 0),
        ([("a", "p", "b")] * 2, "q(A,B) <= p(A,B)", False, 2),  # bags
        ([("a", "p", "b")], "q(A) <= p(A,B)", False, 1),
        ([("a", "p", "b")], "q(A,B) <= p(A)", False, 0),
        ([("a", "p", "b")], "q(x,y) <= ", False, 1),
        ([("x", "q", "y")], "q(x,y) <= ", False, 0),
        ([("a", "p", "a"), ("a", "p", "b")], "q(A,A) <= p(A,A)", False, 1),
        ([("a", "p", "b"), ("b", "z", "c")], "q(A,C) <= *(A,B), *(B,C)", False, 1),
    ]
    for triples, text, fixed, n in cases:
        rule = u.parse_rule(text, "r", fixed=fixed)
        assert len(found(spark, triples, [rule])) == n == len(naive(triples, [rule])), text


TEXTS = ["q(X,Y) <= p(X,Y)", "q(X,Y) <= p(X,Z), q(Z,Y)", "p(X,a) <= q(X,b)", "p(X,X) <= *(X,Y), p(Y,X)", "q(b,Y) <= p(a,Y), q(Y,Z), p(Z,W)", "p(X,Y) <= q(Y,X), p(X,X)", "q(X,V) <= p(X,Y), q(X,Z)"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("pq"), st.sampled_from("abc")), min_size=1, max_size=9), st.lists(st.sampled_from(range(len(TEXTS))), min_size=1, max_size=4, unique=True))
def test_against_nested_loops(spark, triples, chosen):
    rules = [u.parse_rule(TEXTS[i], f"r{i}") for i in chosen]
    assert found(spark, triples, rules) == naive(triples, rules)


def test_verdicts_and_scores(spark):
    t = spark.createDataFrame([("a", "p", "b")], "s string, p string, o string")
    rules = u.parse_rules([("x", "q(A,B) <= p(A,B)", 0.5), ("y", "p(A,B) <= p(A,B)", 0.8), ("z", "no rule", 1.0), ("w", "q(A,B) <= r(A,B)", 0.2)])
    judged = u.verdicts(t, rules)
    assert {(r.rule_id, r.n_violations, r.satisfied) for r in judged.collect()} == {("x", 1, False), ("y", 0, True), ("w", 0, True)}
    assert abs(u.confidence_score(judged).first()[0] - (0.64 + 0.04) / 1.0) < 1e-9
    f = u.violation_features(judged).first()
    assert f.n_violations == 1 and f.n_violated == 1 and abs(f.penalty - 0.3) < 1e-9
    assert u.violations(t, []).count() == 0


def test_atoms_stay_connected():
    rule = u.parse_rule("h(X,Y) <= p(X,Z), q(U,V), r(Z,U)", "r")
    assert [a[0] for a in u.connected(rule.body, rule)] == ["p", "r", "q"]
    assert [a[0] for a in u.connected(rule.body, rule, {"p": 9, "q": 5, "r": 1})][0] == "r"


def test_learned_paths(spark):
    t = spark.createDataFrame([("a", "parent", "b"), ("b", "parent", "c"), ("a", "grand", "c"), ("x", "parent", "y"), ("y", "parent", "z"), ("x", "grand", "z"), ("b", "child", "a")], "s string, p string, o string")
    got = {r.rule: (r.support, r.groundings) for r in u.learn_paths(t, least=1).collect()}
    assert got["grand(X,Y) <= parent(X,Z), parent(Z,Y)"] == (2, 2)
    assert got["child(X,Y) <= parent(Y,X)"] == (1, 4) and got["parent(X,Y) <= child(Y,X)"] == (1, 1)
