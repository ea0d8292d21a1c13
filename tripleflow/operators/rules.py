"""Horn rules over triples: parsing, checking whole corpora, statistics, learning and ranking.

Rules are grouped by shape (which arguments are variables, which are equal, which are constants), and a shape is one plan: its rules are a
table that is joined to the triples by predicate, so that thousands of rules need as many jobs as they have shapes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Atom = tuple[str, tuple[str, ...]]
_CLAUSE = re.compile(r"^\s*(\w+|\*)\((.*)\)\s*$")
_VARIABLE = re.compile(r"^[A-Z]\w*$")
#: Rules of a shape that may be broadcast; more are joined by shuffle.
MAX_BROADCAST_RULES = 100_000
#: Predicates of a shape that are listed in a filter of the scan.
MAX_LISTED = 200


@dataclass(frozen=True)
class Rule:
    id: str
    head: Atom
    body: tuple[Atom, ...]
    confidence: float = 1.0
    fixed: bool = field(default=False, compare=False)

    def is_variable(self, arg: str) -> bool:
        """In reference semantics whatever is in upper case is a variable, quoted or not; else only bare names that begin with a capital."""
        return bool(_VARIABLE.match(arg)) if self.fixed else arg.isupper()

    def constant(self, arg: str) -> str:
        return arg[1:-1] if self.fixed and len(arg) > 1 and arg[0] == arg[-1] and arg[0] in "'\"" else arg


def parse_atom(text: str) -> Atom:
    m = _CLAUSE.match(text)
    if not m:
        raise ValueError(f"no clause: {text!r}")
    return m.group(1), tuple(a.strip() for a in m.group(2).split(",") if a.strip())


def parse_rule(text: str, id: str, confidence: float = 1.0, fixed: bool = False) -> Rule:
    """``head(X,Y) <= body(X,Z), body(Z,Y)``; the body may be empty."""
    head, arrow, body = text.partition("<=")
    if not arrow:
        raise ValueError(f"no rule: {text!r}")
    atoms = tuple(parse_atom(p if p.rstrip().endswith(")") else p + ")") for p in re.split(r"\)\s*,", body) if p.strip())
    return Rule(id, parse_atom(head), atoms, confidence, fixed)


def parse_rules(texts: list[tuple[str, str, float]], fixed: bool = False) -> list[Rule]:
    """Rules of (id, text, confidence); those that can't be read are left out."""
    out = []
    for id, text, confidence in texts:
        try:
            out.append(parse_rule(text, id, confidence, fixed))
        except ValueError:
            continue
    return out


def connected(body: tuple[Atom, ...], rule: Rule, support: dict[str, int] | None = None, known: set[str] | None = None) -> list[Atom]:
    """The atoms in an order in which each shares a variable with one before it, or with ``known``, where that can be, rare predicates first."""
    n = support or {}
    left, out, known = list(body), [], set(known or ())
    while left:
        vars_of = lambda a: {x for x in a[1] if rule.is_variable(x)}
        best = min(range(len(left)), key=lambda i: (bool(out or known) and not (vars_of(left[i]) & known), n.get(left[i][0], 0), i))
        out.append(left.pop(best))
        known |= vars_of(out[-1])
    return out


def _shape(rule: Rule, support: dict[str, int] | None, given: str | None = None) -> tuple[tuple, dict]:
    """The shape of a rule, and the values of its place holders; ``given``: a variable that is bound before the body, the first then."""
    names: dict[str, int] = {given: 0} if given else {}
    values: dict[str, str] = {}
    atoms = []
    for i, (p, args) in enumerate(connected(rule.body, rule, support, set(names))):
        parts = []
        for j, a in enumerate(args[:2]):
            if rule.is_variable(a):
                parts.append(("v", names.setdefault(a, len(names))))
            else:
                values[f"b{i}_{j}"] = rule.constant(a)
                parts.append(("c", f"b{i}_{j}"))
        if p != "*":
            values[f"p{i}"] = p
        atoms.append((p == "*", tuple(parts)))
    head = []
    for j, a in enumerate(rule.head[1][:2]):
        if a in names:
            head.append(("v", names[a]))
        else:
            values[f"h_{j}"] = a if rule.is_variable(a) else rule.constant(a)
            head.append(("c", f"h_{j}"))
    values["ph"] = rule.head[0]
    return (tuple(atoms), tuple(head), tuple(sorted(values))), values | {"names": list(names)}


def _bodies(t: DataFrame, rules: list[Rule], key: list[str], support: dict[str, int] | None, asked: DataFrame | None = None):
    """Of each shape the ways to meet the bodies of its rules: ``(head, rules of the shape, state, number of variables)``.

    ``asked``: pairs (s, p) that the heads must have as predicate and first argument; the bodies are met from there."""
    spark = t.sparkSession
    doc = key[0] if key else None
    shapes: dict[tuple, list[tuple[Rule, dict]]] = defaultdict(list)
    for r in rules:
        if all(len(args) >= 2 for _, args in r.body):
            given = r.head[1][0] if asked is not None else None
            if given is None or (len(r.head[1]) >= 2 and r.is_variable(given)):
                shape, values = _shape(r, support, given)
                shapes[shape].append((r, values))
    for (atoms, head, names), members in shapes.items():
        rows = [(r.id, r.confidence, v["names"], *(v[n] for n in names)) for r, v in members]
        state = spark.createDataFrame(rows, "rule_id string, confidence double, names array<string>" + "".join(f", {n} string" for n in names))
        if len(rows) <= MAX_BROADCAST_RULES:
            state = F.broadcast(state)
        bound: list[int] = []
        if asked is not None:
            state = asked.select(F.col("s").alias("v0"), F.col("p").alias("asked_")).join(state, F.col("asked_") == F.col("ph")).drop("asked_")
            bound = [0]
        if not atoms and doc:
            state = state.crossJoin(t.select(doc).distinct())
        for i, (wild, args) in enumerate(atoms):
            a = t.select(*(F.col(k).alias("d_") if i else F.col(k) for k in key), F.col("s").alias("s_"), F.col("p").alias("p_"), F.col("o").alias("o_"))
            conds: list[Column] = [] if wild else [F.col("p_") == F.col(f"p{i}")]
            wanted = sorted({v[f"p{i}"] for _, v in members}) if not wild else []
            if 0 < len(wanted) <= MAX_LISTED:  # the scan reads these predicates only
                a = a.where(F.col("p_").isin(*wanted))
            if doc and i:
                conds.append(F.col("d_") == F.col(doc))
            fresh: dict[int, str] = {}
            for c, (kind, ref) in zip(("s_", "o_"), args):
                if kind == "c":
                    conds.append(F.col(c) == F.col(ref))
                elif ref in bound:
                    conds.append(F.col(c) == F.col(f"v{ref}"))
                elif ref in fresh:
                    conds.append(F.col(c) == F.col(fresh[ref]))
                else:
                    fresh[ref] = c
            state = state.join(a, reduce(lambda x, y: x & y, conds, F.lit(True)))
            state = state.withColumns({f"v{k}": F.col(c) for k, c in fresh.items()}).drop("s_", "p_", "o_", "d_")
            bound += fresh
        yield head, members, state, len(bound)


def _head_column(h: tuple) -> Column:
    return F.col(f"v{h[1]}") if h[0] == "v" else F.col(h[1])


def violations(triples: DataFrame, rules: list[Rule], doc: str | None = None, support: dict[str, int] | None = None) -> DataFrame:
    """``(rule_id, confidence, bindings, names, head)``: each way to meet a rule's body whose head isn't among the triples (s, p, o); ``names`` are the variables in
    the order in which the body binds them, ``head`` the text of what is missing.

    Repeated triples give repeated violations. A head variable that the body doesn't bind is looked up by its own name; a head with fewer
    than two arguments is never met; a body atom with fewer never matches; an empty body is met once. ``doc``: a column that keeps
    documents apart, then the first column of the result.
    """
    key = [doc] if doc else []
    t = triples.select(*key, "s", "p", "o")
    facts = t.distinct()
    parts = []
    for head, members, state, n in _bodies(t, rules, key, support):
        if len(head) == 2:
            there = facts.select(*(F.col(k).alias("hd_") for k in key), F.col("s").alias("hs_"), F.col("p").alias("hp_"), F.col("o").alias("ho_"))
            heads = sorted({v["ph"] for _, v in members})
            if len(heads) <= MAX_LISTED:
                there = there.where(F.col("hp_").isin(*heads))
            cond = (F.col("hp_") == F.col("ph")) & (F.col("hs_") == _head_column(head[0])) & (F.col("ho_") == _head_column(head[1]))
            state = state.join(there, cond & (F.col("hd_") == F.col(doc)) if doc else cond, "left_anti")
        bindings = F.map_from_arrays("names", F.array(*(F.col(f"v{k}") for k in range(n))).cast("array<string>"))
        text = F.concat("ph", F.lit("("), F.concat_ws(", ", *(_head_column(h) for h in head)), F.lit(")"))
        parts.append(state.select(*key, "rule_id", "confidence", bindings.alias("bindings"), "names", text.alias("head")))
    if not parts:
        none = (F.lit("").alias("rule_id"), F.lit(1.0).alias("confidence"), F.create_map().cast("map<string,string>").alias("bindings"), F.array().cast("array<string>").alias("names"), F.lit("").alias("head"))
        return t.limit(0).select(*key, *none)
    return reduce(DataFrame.unionAll, parts)


def described(found: DataFrame) -> DataFrame:
    """Violations with ``description``, what was expected and the variables for which it was."""
    # The wording of a violation.
    start, middle, end = "Conclusão esperada '", "' não encontrada. A violação ocorreu porque as condições da regra foram satisfeitas com as variáveis: [", "]"
    each = F.transform("names", lambda n: F.concat(n, F.lit("='"), F.element_at("bindings", n), F.lit("'")))
    return found.withColumn("description", F.concat(F.lit(start), "head", F.lit(middle), F.array_join(each, ", "), F.lit(end)))


def derived(triples: DataFrame, rules: list[Rule], asked: DataFrame, support: dict[str, int] | None = None) -> DataFrame:
    """``(rule_id, confidence, s, p, o)``: what the rules conclude about the asked pairs (s, p), each conclusion of a rule once.

    Rules whose head isn't of two arguments, the first of them a variable and the second no open one, conclude nothing here."""
    t = triples.select("s", "p", "o").distinct()
    pairs = asked.select("s", "p").distinct()
    parts = []
    for head, members, state, _ in _bodies(t, rules, [], support, pairs):
        if len(head) == 2:
            if head[1][0] == "c":  # constants, but not variables that the body leaves open
                state = state.where(~F.col("rule_id").isin([r.id for r, _ in members if r.is_variable(r.head[1][1])]))
            parts.append(state.select("rule_id", "confidence", F.col("v0").alias("s"), F.col("ph").alias("p"), _head_column(head[1]).alias("o")))
    if not parts:
        return pairs.limit(0).select(F.lit("").alias("rule_id"), F.lit(1.0).alias("confidence"), "s", "p", F.lit("").alias("o"))
    return reduce(DataFrame.unionAll, parts).distinct()


def explained(conclusions: DataFrame) -> DataFrame:
    """``(s, p, o, n_rules, best, rules)``: the rules behind each conclusion, the surest first."""
    per = conclusions.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n_rules"), F.max("confidence").alias("best"), F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "rule_id"))).alias("l"))
    return per.select("s", "p", "o", "n_rules", "best", F.transform("l", lambda x: x["rule_id"]).alias("rules"))


def ranking_lines(ranked: DataFrame, k: int = 10) -> DataFrame:
    """``(line)`` per query: relation, source and the first ``k`` candidates with their scores, between tabs."""
    top = ranked.where(F.col("rank") <= k)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand", "score"))), lambda x: F.concat(x["cand"].cast("string"), F.lit(":"), F.format_number(x["score"], 6)))
    return top.groupBy("src", "rel").agg(shown.alias("l")).select(F.concat_ws("\t", "rel", F.col("src").cast("string"), F.array_join("l", "\t")).alias("line"))


def validated(triples: DataFrame, rules: list[Rule], doc: str, scores: DataFrame | None = None, top: int = 10) -> DataFrame:
    """A report per document ``doc`` of triples: ``n_violations``, ``confidence_score`` (the mean confidence of its satisfied rules, weighted by itself),
    ``hybrid_score`` (that of ``scores`` (doc, score), 0.5 without, less the penalty for violations), ``is_valid``, ``diagnostic`` (the description of the
    surest violation) and ``top_violations`` (descriptions of the ``top`` surest, ties by rule and text)."""
    bad = described(violations(triples, rules, doc))
    sums = (sum(r.confidence**2 for r in rules), sum(r.confidence for r in rules))
    per_rule = bad.groupBy(doc, "rule_id", "confidence").agg(F.count(F.lit(1)).alias("n"))
    broken = per_rule.groupBy(doc).agg(F.sum("n").alias("n_violations"), F.sum(F.col("confidence") * F.col("confidence")).alias("c2"), F.sum("confidence").alias("c1"))
    w = Window.partitionBy(doc).orderBy(F.col("confidence").desc(), "rule_id", "description")
    first = bad.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    texts = first.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "description"))), lambda x: x["description"]).alias("top_violations"))
    docs = triples.select(doc).distinct().join(broken, doc, "left").join(texts, doc, "left")
    docs = docs.join(scores.select(doc, "score"), doc, "left") if scores is not None else docs.withColumn("score", F.lit(None).cast("double"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    left1 = F.lit(sums[1]) - zero("c1")
    penalty = F.least(zero("n_violations") / F.lit(max(1, len(rules))) * 10, F.lit(0.3))
    hybrid = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.5)) - penalty))
    confidence = F.when(left1 > 1e-9, (F.lit(sums[0]) - zero("c2")) / left1).otherwise(F.lit(0.0))
    out = docs.select(doc, zero("n_violations").alias("n_violations"), F.round(confidence, 9).alias("confidence_score"), F.round(hybrid, 9).alias("hybrid_score"), F.coalesce("top_violations", F.array().cast("array<string>")).alias("top_violations"))
    return out.withColumns({"is_valid": (F.col("n_violations") == 0) & (F.col("hybrid_score") > 0.5), "diagnostic": F.coalesce(F.get("top_violations", F.lit(0)), F.lit("Nenhuma violação encontrada"))})


def rules_frame(spark, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.id, r.confidence) for r in rules], "rule_id string, confidence double")


def verdicts(triples: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(rule_id, confidence, n_violations, satisfied)`` of every rule; a rule whose body is never met is satisfied."""
    n = violations(triples, rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return rules_frame(triples.sparkSession, rules).join(n, "rule_id", "left").select("rule_id", "confidence", F.coalesce("n", F.lit(0)).alias("n_violations"), F.col("n").isNull().alias("satisfied"))


def confidence_score(judged: DataFrame) -> DataFrame:
    """One row: the mean confidence of the satisfied rules, weighted by itself; 0 if there are none."""
    c = F.when(F.col("satisfied"), F.col("confidence"))
    return judged.agg(F.coalesce(F.sum(c * c) / F.nullif(F.sum(c), F.lit(0.0)), F.lit(0.0)).alias("confidence_score"))


def violation_features(judged: DataFrame) -> DataFrame:
    """One row: violations, violations per rule, their mean confidence, rules violated, and the penalty."""
    a = judged.agg(
        F.sum("n_violations").alias("n_violations"), F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_rules"),
        F.coalesce(F.sum(F.col("confidence") * F.col("n_violations")) / F.nullif(F.sum("n_violations"), F.lit(0)), F.lit(0.0)).alias("mean_confidence"),
        F.count_if(~F.col("satisfied")).alias("n_violated"),
    )
    rate = F.col("n_violations") / F.col("n_rules")
    return a.withColumn("violation_rate", rate).withColumn("penalty", F.least(rate * 10, F.lit(0.3)))


def rule_features(judged: DataFrame, group_size: int) -> DataFrame:
    """Rules in groups by order of their ids: mean, any and share of violated rules. The order is that of ``ord``."""
    v = F.when(F.col("satisfied"), F.lit(0)).otherwise(F.lit(1))
    return judged.groupBy(F.floor(F.col("ord") / group_size).alias("grp")).agg(F.avg(v).alias("mean"), F.max(v).alias("any"), F.sum(v).alias("n_violated"))


def dedup_rules(rules: DataFrame) -> DataFrame:
    """Rules ``(ord, id, head, body, confidence)`` that are the same in head and body as one: the first, how often, and the sum of confidences."""
    same = F.array_join(F.array_sort("body"), " & ") if dict(rules.dtypes)["body"].startswith("array") else F.col("body")
    return rules.groupBy("head", same.alias("body")).agg(
        F.min_by("id", "ord").alias("id"), F.min_by("confidence", "ord").alias("confidence"), F.count(F.lit(1)).alias("occurrences"), F.sum("confidence").alias("aggregated_confidence")
    )


def match_batch(triples: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(pattern_id, s, p, o)``: the triples each pattern (pattern_id, ps, pp, po) meets; null is anything. Patterns are grouped by
    which parts they bind, and joined on those."""
    parts = []
    for mask in range(8):
        on = [c for k, c in enumerate(("s", "p", "o")) if mask >> k & 1]
        mine = patterns.where(reduce(lambda a, b: a & b, (F.col(f"p{c}").isNotNull() if c in on else F.col(f"p{c}").isNull() for c in ("s", "p", "o"))))
        cond = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"p{c}") for c in on), F.lit(True))
        parts.append(triples.join(mine, cond).select("pattern_id", "s", "p", "o"))
    return reduce(DataFrame.unionAll, parts)


def ground_violated(sample: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules without variables (rule_id, head, body as texts ``p(s,o)``) that are violated: all of the body is there, the head isn't."""
    there = sample.select(F.concat("p", F.lit("("), "s", F.lit(","), "o", F.lit(")")).alias("atom")).distinct()
    atoms = rules.where(F.size("body") > 0).select("rule_id", "head", F.size(F.array_distinct("body")).alias("n"), F.explode(F.array_distinct("body")).alias("atom"))
    met = atoms.join(there, "atom").groupBy("rule_id", "head", "n").agg(F.count(F.lit(1)).alias("k")).where("k = n")
    return met.withColumnRenamed("head", "wanted").join(there, F.col("wanted") == F.col("atom"), "left_anti").select("rule_id")


def learn_paths(t: DataFrame, least: int = 2) -> DataFrame:
    """``(rule, support, groundings, confidence)``: rules h(X,Y) <= b(X,Y), b(Y,X), and b1(X,Z), b2(Z,Y) in both directions of each.

    ``groundings`` are the ways to meet the body, ``support`` those whose head is there. Both are counted without listing the paths of the
    body: groundings by the degrees of the middle node, support from the head's pairs on, each from its end of lower degree.
    """
    e = t.select("s", "p", "o").distinct()
    both = e.select(F.col("s").alias("x"), F.col("p").alias("b"), F.col("o").alias("y"), F.lit(True).alias("fwd")).unionByName(e.select(F.col("o").alias("x"), F.col("p").alias("b"), F.col("s").alias("y"), F.lit(False).alias("fwd")))
    text = lambda b, fwd, x, y: F.when(fwd, F.concat(b, F.lit(f"({x},{y})"))).otherwise(F.concat(b, F.lit(f"({y},{x})")))
    heads = e.select(F.col("s").alias("x"), F.col("p").alias("h"), F.col("o").alias("y"))
    one_sup = heads.join(both, ["x", "y"]).where((F.col("h") != F.col("b")) | ~F.col("fwd")).groupBy("h", "b", "fwd").agg(F.count(F.lit(1)).alias("support"))
    one_all = both.groupBy("b", "fwd").agg(F.count(F.lit(1)).alias("groundings"))
    one = one_sup.join(one_all, ["b", "fwd"]).select(F.concat(F.col("h"), F.lit("(X,Y) <= "), text(F.col("b"), F.col("fwd"), "X", "Y")).alias("rule"), "support", "groundings")
    first, second = both.toDF("x", "b1", "z", "f1"), both.toDF("z", "b2", "y", "f2")
    into, out = first.groupBy("b1", "f1", "z").agg(F.count(F.lit(1)).alias("n1")), second.groupBy("b2", "f2", "z").agg(F.count(F.lit(1)).alias("n2"))
    back = F.when((F.col("b1") == F.col("b2")) & (F.col("f1") != F.col("f2")), F.col("n1")).otherwise(F.lit(0))
    two_all = into.join(out, "z").groupBy("b1", "f1", "b2", "f2").agg(F.sum(F.col("n1") * F.col("n2") - back).alias("groundings"))
    # from the end of the head with fewer neighbours: the other may be a hub
    deg = both.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    sized = heads.where("x <> y").join(deg.toDF("x", "nx"), "x").join(deg.toDF("y", "ny"), "y")
    from_x = sized.where("nx <= ny").join(first, "x").join(second, ["z", "y"]).select("h", "b1", "f1", "b2", "f2")
    from_y = sized.where("nx > ny").join(second, "y").join(first, ["x", "z"]).select("h", "b1", "f1", "b2", "f2")
    two_sup = from_x.unionByName(from_y).groupBy("h", "b1", "f1", "b2", "f2").agg(F.count(F.lit(1)).alias("support"))
    two = two_sup.join(two_all, ["b1", "f1", "b2", "f2"]).select(
        F.concat(F.col("h"), F.lit("(X,Y) <= "), text(F.col("b1"), F.col("f1"), "X", "Z"), F.lit(", "), text(F.col("b2"), F.col("f2"), "Z", "Y")).alias("rule"), "support", "groundings"
    )
    return one.unionByName(two).where((F.col("support") >= least) & (F.col("groundings") > 0)).withColumn("confidence", F.col("support") / F.col("groundings"))


def rank_candidates(evidence: DataFrame, known: DataFrame, how: str = "noisyor") -> DataFrame:
    """``(src, rel, cand, score, rank)`` from (src, rel, cand, confidence), a row per rule that gives the candidate; known facts drop out.

    ``noisyor``: 1 - product of (1 - confidence). ``maxplus``: by the largest confidence, ties by the next, and so on.
    """
    fresh = evidence.join(known, ["src", "rel", "cand"], "left_anti")
    listed = F.sort_array(F.collect_list("confidence"), asc=how == "noisyor")
    per = fresh.groupBy("src", "rel", "cand").agg(listed.alias("sorted"))
    if how == "noisyor":  # multiplied in order of size, so that the result doesn't depend on the order of rows
        per = per.withColumn("score", 1 - F.aggregate("sorted", F.lit(1.0), lambda product, c: product * (1 - c)))
    else:
        per = per.withColumn("score", F.col("sorted")[0])
    first = F.col("score") if how == "noisyor" else F.col("sorted")
    order = Window.partitionBy("src", "rel").orderBy(first.desc(), "cand")
    return per.select("src", "rel", "cand", "score", F.row_number().over(order).alias("rank"))


def quality(confidence: Column, support: Column, most: int = 100) -> Column:
    """A rule's confidence weighted by its support, as a share of ``most``."""
    return F.round(confidence * support / most, 9)


def combined(sources: list[DataFrame]) -> DataFrame:
    """``(rule, confidence, source, n_sources)``: rules (rule, confidence, source) of several sources as one, by their text without blanks at the ends; the surest holds, of
    equals the earlier source."""
    rows = reduce(DataFrame.unionAll, [f.select(F.trim("rule").alias("rule"), F.col("confidence").cast("double").alias("confidence"), "source", F.lit(-i).alias("__i")) for i, f in enumerate(sources)])
    best = F.max_by(F.struct("confidence", "source"), F.struct("confidence", "__i"))
    return rows.where(F.coalesce(F.col("rule") != "", F.lit(False))).groupBy("rule").agg(best.alias("b"), F.countDistinct("source").alias("n_sources")).select("rule", "b.confidence", "b.source", "n_sources")


def phase(has_model: bool, has_mined: bool, has_combined: bool) -> str:
    """What to do with the sources of rules: bootstrap from the mined ones, refine the combined ones by the model, or both."""
    if has_model:
        return "refinement" if has_combined else "hybrid"
    return "bootstrap"


def head_triples(rules: DataFrame) -> DataFrame:
    """``(s, p, o)`` of the heads of rule texts (rule) ``p(s,o) <= ...`` or ``p(s,o) :- ...`` of two arguments, distinct."""
    head = r"^\s*(\w+)\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*\)\s*(?:<=|:-)"
    got = rules.where(F.col("rule").rlike(head)).select(F.regexp_extract("rule", head, 2).alias("s"), F.regexp_extract("rule", head, 1).alias("p"), F.regexp_extract("rule", head, 3).alias("o"))
    return got.distinct()
