"""Mixing sources to target weights: hierarchical budgeting.

The leaves of the tree are (domain, language, source); the domains are a table. A source's target share is spread over its languages by their tokens, and the weights
are propagated from the root, every leaf's budget being its share of the tokens of all documents of the sources. A leaf can give at
most ``max_repeats`` times its tokens. What it lacks goes to its siblings
with room, in proportion to their weights, then to those of the parent, and so on (``budgets``). A leaf's budget is filled by seeded
epochs: in each, every document is used once, in an order of its own; the last epoch is a prefix of that order by tokens.

Scale: tokens are counted where the documents are read and written once, as (doc_id, leaf, n_tokens). The tree has a leaf per source and language (bounded by MAX_SOURCES). The prefix of a
leaf is found by sums over ranges of the order, which are carried forward, and running sums within a range: a source with a
third of all documents is spread over as many ranges as its documents ask for (DOCS_A_RANGE).

Defined results: a document counts for the source whose name equals its own, trimmed and in lower case; null or other sources take
no part; a language is its first two letters if it begins with two, else "other"; null and empty texts have no tokens and are never used; a source without tokens gives nothing; nulls in target_share count as 0, in
max_repeats as 1; documents at the edge of a budget are used if at least half of their tokens fit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..storage import written
from .bpe import TOKENIZERS, token_counts

MAX_SOURCES, SEED = 10_000, 13
#: Documents of a range of the order, which one task takes.
DOCS_A_RANGE = 200_000


def name_of(c: str):
    return F.lower(trimmed(c))


def sized_documents(docs: DataFrame, targets: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, source, lang, n_tokens)`` of the documents of the sources, written. An action."""
    names = targets.select(name_of("source").alias("source")).where(F.col("source").isNotNull()).distinct()
    two = F.substring(name_of("lang"), 1, 2)
    lang = F.when(two.rlike("^[a-z][a-z]$"), two).otherwise(F.lit("other"))
    mine = docs.select("doc_id", "text", name_of("source").alias("source"), lang.alias("lang")).join(names, "source", "left_semi")
    sizes = token_counts(mine.select("doc_id", "text", F.concat_ws("\n", "lang", "source").alias("leaf")), folder=folder, keep="leaf")
    part = F.split("leaf", "\n", 2)
    return written(sizes.select("doc_id", part.getItem(1).alias("source"), part.getItem(0).alias("lang"), "n_tokens"), "sizes")


@dataclass
class Node:
    """A node of the tree of sources; ``cap`` is the most tokens it can give, ``budget`` what it shall give, ``short`` what it lacked of its own
    weight before any redistribution."""

    name: str
    weight: float = 0.0
    cap: float = 0.0
    budget: float = 0.0
    short: float = 0.0
    children: list[Node] = field(default_factory=list)


def _pour(nodes: list[Node], amount: float) -> float:
    """Gives ``amount`` to nodes by weight, none above its cap, and gives back what doesn't fit."""
    open_nodes = [n for n in nodes if n.cap - n.budget > 1e-9]
    while open_nodes and amount > 1e-9:
        weight = sum(n.weight for n in open_nodes)
        full = [n for n in open_nodes if n.budget + (amount * n.weight / weight if weight else amount / len(open_nodes)) >= n.cap - 1e-9]
        if not full:
            for n in open_nodes:
                n.budget += amount * n.weight / weight if weight else amount / len(open_nodes)
            return 0.0
        for n in full:
            amount -= n.cap - n.budget
            n.budget = n.cap
        open_nodes = [n for n in open_nodes if n not in full]
    return max(0.0, amount)


def _fill(node: Node, wanted: float) -> float:
    """Fills the subtree with ``wanted`` tokens: first by weight, then shortages among siblings; gives back what didn't fit."""
    node.cap = sum(c.cap for c in node.children) if node.children else node.cap
    if not node.children:
        node.budget = min(wanted, node.cap)
        node.short = wanted - node.budget
        return node.short
    for c in node.children:
        c.budget = 0.0
    weight = sum(c.weight for c in node.children)
    missing = 0.0
    for c in node.children:
        missing += _fill(c, wanted * c.weight / weight if weight else wanted / len(node.children))
    before = {id(c): c.budget for c in node.children}
    left = _pour(node.children, missing)
    for c in node.children:
        if c.children and c.budget - before[id(c)] > 1e-9:
            _top_up(c, c.budget - before[id(c)])
    node.budget = wanted - left
    return left


def _top_up(node: Node, more: float) -> None:
    before = {id(c): c.budget for c in node.children}
    _pour(node.children, more)
    for c in node.children:
        if c.children:
            _top_up(c, c.budget - before[id(c)])


def budgets(sources: list[tuple[str, float, int, dict[str, int]]], domains: dict[str, str] | None = None) -> list[tuple]:
    """``(source, lang, target_share, max_repeats, tokens, cap, budget, short)`` per leaf, from (source, share, max_repeats, tokens by language).

    ``domains``: the domain of a source; one that isn't there is a domain of its own. Shares that don't sum to 1 are shares of their sum; ``short`` is by
    the shares as given."""
    total = sum(sum(s[3].values()) for s in sources)
    shares = sum(s[1] for s in sources) or 1.0
    tree: dict[str, dict[str, list[Node]]] = {}
    leaves: list[tuple[tuple, Node]] = []
    for name, share, repeats, by_lang in sources:
        own = sum(by_lang.values())
        for lang, tokens in sorted(by_lang.items()) or [("other", 0)]:
            part = tokens / own if own else 1.0 / max(1, len(by_lang))
            leaf = Node(name, share * part, float(repeats * tokens))
            tree.setdefault((domains or {}).get(name, name), {}).setdefault(lang, []).append(leaf)
            leaves.append(((name, lang, share, repeats, tokens), leaf))
    inner = lambda name, nodes: Node(name, sum(n.weight for n in nodes), 0.0, 0.0, 0.0, nodes)
    root = inner("", [inner(d, [inner(lang, ns) for lang, ns in langs.items()]) for d, langs in tree.items()])
    _caps(root)
    _fill(root, float(total))
    if abs(shares - 1.0) > 1e-6:  # the tree was filled by shares of their sum
        for (_, _, share, _, _), leaf in leaves:
            leaf.short = max(0.0, leaf.weight * total - leaf.cap)
    return [(*head, leaf.cap, leaf.budget, leaf.short) for head, leaf in leaves]


def _caps(node: Node) -> float:
    if node.children:
        node.cap = sum(_caps(c) for c in node.children)
    return node.cap


PLAN = "source string, lang string, target_share double, max_repeats int, tokens long, cap double, budget double, short double, docs long"


def plan(sizes: DataFrame, targets: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """The budgets, a row per leaf. An action; leaves are bounded by MAX_SOURCES, beyond which it raises. ``domains``: the upper level of
    the tree, as rows (source, domain)."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    wanted = targets.select(name_of("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats")).where(F.col("source").isNotNull()).dropDuplicates(["source"])
    rows = wanted.join(totals, "source", "left").orderBy("source", "lang").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} leaves")
    by_source: dict[str, tuple[str, float, int, dict[str, int]]] = {}
    docs = {(r.source, r.lang or "other"): int(r.docs or 0) for r in rows}
    tree = {}
    if domains is not None:
        named = domains.select(name_of("source").alias("source"), "domain").where(F.col("source").isNotNull() & F.col("domain").isNotNull())
        tree = {r.source: r.domain for r in named.join(wanted.select("source"), "source", "left_semi").groupBy("source").agg(F.min("domain").alias("domain")).limit(MAX_SOURCES).collect()}
    for r in rows:
        mine = by_source.setdefault(r.source, (r.source, float(r.share), int(r.repeats), {}))
        if r.lang is not None:
            mine[3][r.lang] = int(r.tokens or 0)
    return spark.createDataFrame([(*r, docs.get((r[0], r[1]), 0)) for r in budgets(list(by_source.values()), tree)], PLAN)


def by_source(planned: DataFrame) -> DataFrame:
    """The plan summed over languages, with ``wanted``, the tokens of the target share, before any redistribution."""
    rows = planned.groupBy("source").agg(F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"), *(F.sum(c).alias(c) for c in ("tokens", "cap", "budget", "short")))
    total = rows.agg(F.sum("tokens").alias("all_tokens"))
    return rows.crossJoin(F.broadcast(total)).withColumn("wanted", F.col("target_share") * F.col("all_tokens")).drop("all_tokens")


def short_sources(planned: DataFrame) -> DataFrame:
    """Sources that can't reach their share: after the weights are propagated, leaves of theirs lack tokens (beyond the error of sums in doubles)."""
    return by_source(planned).where(F.col("short") > F.col("wanted") * F.lit(1e-12)).select("source")


def mix(sizes: DataFrame, planned: DataFrame, seed: int = SEED, docs_a_range: int = DOCS_A_RANGE) -> DataFrame:
    """``(doc_id, source, n_tokens, uses)``: the documents used and how often, by the budgets of ``planned``."""
    full = F.floor(F.col("budget") / F.col("tokens") + F.lit(1e-9))
    epochs = planned.where((F.col("tokens") > 0) & (F.col("budget") > 0)).select("source", "lang", full.cast("int").alias("full"), (F.col("budget") - full * F.col("tokens")).alias("rest"), F.ceil(F.col("docs") / docs_a_range).alias("ranges"))
    leaf = ["source", "lang"]
    keyed = sizes.where(F.col("n_tokens") > 0).join(F.broadcast(epochs), leaf)
    keyed = keyed.withColumn("order", F.xxhash64(F.lit(seed), "full", "doc_id"))
    keyed = keyed.withColumn("range", F.floor((F.shiftright("order", 32).cast("double") + 2147483648.0) / 4294967296.0 * F.col("ranges")).cast("long"))
    sums = keyed.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("in_range"))
    before = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("carried", F.coalesce(F.sum("in_range").over(before), F.lit(0))).drop("in_range")
    within = Window.partitionBy(*leaf, "range").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("so_far", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(carried, [*leaf, "range"])
    used = F.col("full") + F.when(F.col("carried") + F.col("so_far") + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    return placed.select("doc_id", "source", "n_tokens", used.cast("int").alias("uses")).where(F.col("uses") > 0)


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per source the tokens used, the share reached and the target."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used"), F.count(F.lit(1)).alias("n_docs"), F.max("uses").alias("most_uses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = by_source(planned).join(used, "source", "left").select("source", "target_share", "max_repeats", "tokens", zero("used"), zero("n_docs"), zero("most_uses"))
    total = rows.agg(F.sum("used").alias("all_used"))
    return rows.crossJoin(F.broadcast(total)).withColumn("actual_share", F.round(F.col("used") / F.greatest(F.col("all_used"), F.lit(1)), 9)).drop("all_used")
