from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tripleflow.llm import terms

SCHEMA = "s string, p string, o string, term string"


def brute(rows):
    rows_of, records = defaultdict(set), defaultdict(set)
    for i, (s, p, o) in enumerate(rows):
        if s is None:
            continue
        for key in ([("p", p.strip())] if p is not None else []) + ([("o", t) for t in terms.terms_of(o)] if o is not None else []):
            rows_of[key].add(i)
            records[key].add(s.strip().upper())
    return {(f, t, len(rows_of[f, t]), len(records[f, t])) for f, t in rows_of}


def counts(spark, rows, **kw):
    return {tuple(r) for r in terms.term_counts(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), **kw).collect()}


def test_terms_of():
    assert terms.terms_of("  (Olá), olá! x1 ab2 été -- a 'tis don't\xa0ÇA. ___") == {"olá", "été", "tis", "ça"}
    assert terms.terms_of("") == set() and terms.terms_of(" \t") == set() and terms.terms_of("Ab " * 50_000) == {"ab"}


def test_capitals_of_two_lower_forms(spark):
    assert terms.terms_of("İzmir DİYARBAKIR I\u0307zmit ΟΔΟΣ οδος") == {"izmir", "diyarbakir", "izmit", "οδοσ", "οδος"}
    assert counts(spark, [("a", "p", "ΟΔΟΣ İzmir"), ("b", "p", "οδοΣ")]) == {("p", "p", 2, 2), ("o", "οδοσ", 2, 2), ("o", "izmir", 1, 1)}


word = st.sampled_from(["alpha", "Beta", "beta.", "x", "1a", "ção", ""])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "A ", "b", "c", None]), st.sampled_from(["p", " p", "q", None]), st.none() | st.lists(word, max_size=4).map(" ".join)), max_size=25))
def test_against_plain_python(spark, rows):
    assert counts(spark, rows) == brute(rows)


def test_one_term_is_split_by_records(spark):
    rows = [(f"s{i % 300}", "hot", "Common text here") for i in range(900)] + [("t", "q", "rare")]
    assert counts(spark, rows, limit=40, bits=2) == brute(rows)


def test_marks_and_nothing(spark):
    t = spark.createDataFrame([(f"s{i}", "p", "often") for i in range(60)] + [("s1", "q", "seldom")], "s string, p string, o string")
    got = {(r.field, r.term, r.mark) for r in terms.marked(terms.term_counts(t), t).collect()}
    assert got == {("p", "p", "common"), ("o", "often", "common"), ("p", "q", "rare"), ("o", "seldom", "rare")}
    assert terms.marked(terms.term_counts(t.limit(0)), t.limit(0)).count() == 0
