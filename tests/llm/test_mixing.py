import pytest

from tripleflow.llm import mixing

PLAN = ("source", "lang", "share", "repeats", "tokens", "cap", "budget", "short")
DOMAINS = {"ticket": "service", "chat": "service", "faq": "service"}


def plan(sources):
    return [dict(zip(PLAN, r)) for r in mixing.budgets(sources, DOMAINS)]


def test_budgets_meet_the_shares():
    rows = plan([("ticket", 0.5, 2, {"pt": 600, "en": 200}), ("runbook", 0.5, 3, {"pt": 400})])
    assert sum(r["budget"] for r in rows if r["source"] == "ticket") == pytest.approx(600) and sum(r["budget"] for r in rows) == pytest.approx(1200)


def test_shortage_goes_to_siblings_first():
    # chat lacks tokens: ticket, of the same domain and language, makes up for it, runbook is left as it is
    rows = {r["source"]: r for r in plan([("ticket", 0.4, 5, {"pt": 700}), ("chat", 0.3, 1, {"pt": 100}), ("runbook", 0.3, 5, {"pt": 200})])}
    assert rows["chat"]["budget"] == pytest.approx(100) and rows["ticket"]["budget"] == pytest.approx(600) and rows["runbook"]["budget"] == pytest.approx(300)


def test_nothing_beyond_the_caps():
    rows = plan([("ticket", 0.5, 1, {"pt": 10}), ("chat", 0.5, 1, {"pt": 10, "en": 0}), ("faq", 0.0, 1, {})])
    assert all(r["budget"] <= r["cap"] + 1e-9 for r in rows) and sum(r["budget"] for r in rows) == pytest.approx(20)


def tables(spark):
    docs = [(i, "word " * (1 + i % 5), "PT", ["Ticket ", "chat", "misc", None][i % 4]) for i in range(400)] + [(900, None, "pt", "chat"), (901, "", None, "chat"), (902, "x", "zz", "faq")]
    targets = [("ticket", 0.3, 2), ("chat", 0.5, 3), ("faq", 0.1, 2), ("none", 0.1, 1)]
    d = spark.createDataFrame([(*r, 7, "x") for r in docs], "doc_id long, text string, lang string, source string, n_tokens int, leaf string")
    return d, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mix(spark):
    docs, targets = tables(spark)
    sizes = mixing.sized_documents(docs, targets)
    planned = mixing.plan(sizes, targets)
    assert {r.source for r in mixing.short_sources(planned).collect()} == {"faq", "none"}
    mixed = mixing.mix(sizes, planned).collect()
    limit = {"ticket": 2, "chat": 3, "faq": 2}
    assert all(1 <= r.uses <= limit[r.source] for r in mixed) and len({r.doc_id for r in mixed}) == len(mixed)
    budget = {}
    for r in planned.collect():
        budget[r.source] = budget.get(r.source, 0) + r.budget
    for source in limit:
        used = sum(r.uses * r.n_tokens for r in mixed if r.source == source)
        assert abs(used - budget[source]) <= 10
    again = mixing.mix(sizes, planned, docs_a_range=9).collect()
    assert {(r.doc_id, r.uses) for r in again} == {(r.doc_id, r.uses) for r in mixed}
    shares = {r.source: r for r in mixing.shares(mixing.mix(sizes, planned), planned).collect()}
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1) and shares["none"].used == 0


def test_shortage_before_redistribution():
    rows = {r["source"]: r for r in plan([("ticket", 0.4, 5, {"pt": 700}), ("chat", 0.3, 1, {"pt": 100}), ("runbook", 0.3, 5, {"pt": 200})])}
    assert rows["chat"]["short"] == pytest.approx(200) and rows["ticket"]["short"] == rows["runbook"]["short"] == 0
    half = {r["source"]: r for r in plan([("ticket", 0.2, 1, {"pt": 10, "en": 10}), ("chat", 0.3, 1, {"pt": 80})])}
    assert half["ticket"]["short"] == 0 and half["chat"]["short"] == 0  # shares as given, not of their sum


def test_domains_are_a_table(spark):
    docs, targets = tables(spark)
    sizes = mixing.sized_documents(docs, targets)
    domains = spark.createDataFrame([(" CHAT", "service"), ("ticket", "service"), ("faq", None), (None, "x")], "source string, domain string")
    got = {(r.source, r.lang): r.budget for r in mixing.plan(sizes, targets, domains).collect()}
    assert {k[1] for k in got} <= {"pt", "zz", "other"} and sum(got.values()) > 0


def test_no_documents(spark):
    docs, targets = tables(spark)
    sizes = mixing.sized_documents(docs.limit(0), targets)
    planned = mixing.plan(sizes, targets)
    assert mixing.mix(sizes, planned).count() == 0 and mixing.short_sources(planned).count() == 0
