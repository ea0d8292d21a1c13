"""Graphs of triples: degrees, quality, filters, vocabularies, types, paths, splits and augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capitalized
from .ordered import numbered


def degree(t: DataFrame) -> DataFrame:
    """``(entity, degree)``: occurrences as subject and as object; a loop counts twice."""
    return t.select(F.explode(F.array("s", "o")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("degree"))


def degree_rows(t: DataFrame) -> DataFrame:
    """``(entity, degree)``: rows in which an entity occurs; a loop counts once."""
    return t.select(F.explode(F.array_distinct(F.array("s", "o"))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("degree"))


def relation_support(t: DataFrame, least: int = 1) -> DataFrame:
    return t.groupBy("p").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)


def quality(t: DataFrame, low: int = 3, rare: int = 50, loops_apart: bool = False) -> DataFrame:
    """One row: sizes, density, degrees and how many entities and relations are weak. ``loops_apart``: density by n / (E (E-1) R)."""
    d = (degree_rows if loops_apart else degree)(t).agg(
        F.count(F.lit(1)).alias("n_entities"), F.avg("degree").alias("mean_degree"), F.percentile("degree", F.lit(0.5)).alias("median_degree"),
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") < low).alias("n_low_degree"),
    )
    r = relation_support(t).agg(F.count(F.lit(1)).alias("n_relations"), F.coalesce(F.sum("support"), F.lit(0)).alias("n_triples"), F.count_if(F.col("support") < rare).alias("n_rare_relations"))
    e = F.col("n_entities").cast("double")
    pairs = e * (e - 1) if loops_apart else e * e
    return d.crossJoin(r).withColumn("density", F.col("n_triples") / F.nullif(pairs * F.col("n_relations"), F.lit(0.0)))


def keep_entities(t: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples both of whose ends are among ``entities`` (entity)."""
    e = entities.select("entity")
    return t.join(e.withColumnRenamed("entity", "s"), "s", "left_semi").join(e.withColumnRenamed("entity", "o"), "o", "left_semi").select(*t.columns)


def filter_sparse(t: DataFrame, least: int = 3) -> DataFrame:
    """Triples both of whose ends have at least ``least`` occurrences; a single pass."""
    return keep_entities(t, degree(t).where(F.col("degree") >= least))


def balance_relations(t: DataFrame, least: int = 50) -> DataFrame:
    return t.join(relation_support(t, least).select("p"), "p", "left_semi").select(*t.columns)


def percentile_filter(t: DataFrame, share: float = 0.05, at_least: int = 2) -> DataFrame:
    """Triples whose ends have at least max(``at_least``, the percentile of degrees, cut to a whole number) rows."""
    d = degree_rows(t)
    least = d.agg(F.greatest(F.lit(at_least), F.floor(F.percentile("degree", F.lit(share)))).alias("least"))
    return keep_entities(t, d.crossJoin(F.broadcast(least)).where(F.col("degree") >= F.col("least")))


def homogenize(t: DataFrame, level: float = 0.01) -> DataFrame:
    """Sentinel dates become SPECIAL_DATE, other dates their year, objects of relations above the threshold p_CATEGORY.

    The threshold is max(1, the number of triples times ``level``, cut).
    """
    n = t.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(level))).alias("threshold"))
    stats = relation_support(t)
    joined = t.join(stats, "p", "left").crossJoin(F.broadcast(n))
    sentinel = F.col("o").startswith("1970-01-01") | F.col("o").startswith("9999-12-31")
    o = (
        F.when(sentinel, F.lit("SPECIAL_DATE"))
        .when(F.col("o").rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring("o", 1, 4))
        .when(F.col("support") > F.col("threshold"), F.concat("p", F.lit("_CATEGORY")))
        .otherwise(F.col("o"))
    )
    return joined.select("s", "p", o.alias("o"))


def vocabulary(labels: DataFrame, start: int = 0) -> DataFrame:
    """``(id, label)``: the distinct labels in code point order, numbered without gaps. An action."""
    return numbered(labels.select("label").where(F.col("label").isNotNull()).distinct(), ["label"], "id", start).select("id", "label")


def entity_labels(t: DataFrame) -> DataFrame:
    return t.select(F.explode(F.array("s", "o")).alias("label"))


def merge_vocabularies(maps: list[DataFrame]) -> DataFrame:
    """The union of labels, numbered anew. An action."""
    labels = maps[0].select("label")
    for m in maps[1:]:
        labels = labels.unionByName(m.select("label"))
    return vocabulary(labels)


def extend_vocabulary(known: DataFrame, labels: DataFrame) -> DataFrame:
    """``known`` with the new labels from the largest id + 1 on. An action."""
    top = known.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    fresh = labels.select("label").distinct().join(known, "label", "left_anti")
    return known.select("id", "label").unionByName(vocabulary(fresh, top + 1))


def index_triples(t: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(s_id, p_id, o_id)``; triples with an unknown part drop out."""
    e, r = entities.select("id", "label"), relations.select("id", "label")
    return t.join(r.toDF("p_id", "p"), "p").join(e.toDF("s_id", "s"), "s").join(e.toDF("o_id", "o"), "o").select("s_id", "p_id", "o_id")


def unmapped(t: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of the triples that the map lacks, with their rows."""
    return degree_rows(t).join(entities.select(F.col("label").alias("entity")), "entity", "left_anti").withColumnRenamed("degree", "n_rows")


def validate_map(m: DataFrame) -> DataFrame:
    """One row: size, least and largest id, whether ids and labels are unique and ids dense from 0."""
    a = m.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.countDistinct("id").alias("n_ids"), F.countDistinct("label").alias("n_labels"))
    return a.withColumn("is_dense", (F.col("min_id") == 0) & (F.col("max_id") == F.col("n") - 1) & (F.col("n_ids") == F.col("n"))).withColumn("is_unique", F.col("n_labels") == F.col("n"))


def inverse_share(t: DataFrame) -> DataFrame:
    """``(p, n, n_inverse, share)``: distinct triples of a relation, and those whose inverse is there."""
    d = t.select("s", "p", "o").distinct()
    back = d.select(F.col("o").alias("s"), "p", F.col("s").alias("o"), F.lit(1).alias("hit"))
    return d.join(back, ["s", "p", "o"], "left").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_inverse")).withColumn("share", F.col("n_inverse") / F.col("n"))


def augment_inverse(t: DataFrame, least: float = 0.5) -> DataFrame:
    """Inverse triples that are missing, of the relations that are symmetric in more than ``least`` of their triples."""
    d = t.select("s", "p", "o").distinct()
    symmetric = inverse_share(t).where(F.col("share") > least).select("p")
    back = d.join(symmetric, "p", "left_semi").select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    return back.join(d, ["s", "p", "o"], "left_anti").select("s", "p", "o")


# Prefixes of labels and their types.
TYPE_PREFIXES = {"product_": "Product", "char_": "Characteristic", "offer_": "Offer", "status_": "Status", "date_": "Date", "id_": "Identifier"}


def entity_type(label: Column) -> Column:
    """The type of a label by its prefix, else its first part up to ``_``, with a capital."""
    out = capitalized(F.element_at(F.split(label, "_"), 1))
    for prefix, kind in reversed(list(TYPE_PREFIXES.items())):
        out = F.when(label.startswith(prefix), F.lit(kind)).otherwise(out)
    return out


def type_counts(t: DataFrame) -> DataFrame:
    return entity_labels(t).distinct().groupBy(entity_type(F.col("label")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def relation_types(t: DataFrame) -> DataFrame:
    """``(p, head_type, tail_type)``: the most frequent type on either side; ties go to the smaller name."""
    typed = t.select("p", entity_type(F.col("s")).alias("h"), entity_type(F.col("o")).alias("t"))

    def mode(side: str, name: str) -> DataFrame:
        n = typed.groupBy("p", side).agg(F.count(F.lit(1)).alias("n"))
        return n.withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("n"), side))).where("rn = 1").select("p", F.col(side).alias(name))

    return mode("h", "head_type").join(mode("t", "tail_type"), "p")


def meta_edges(t: DataFrame) -> DataFrame:
    """``(domain, relation, range)``, with ``relation``_inv where domain and range are the same."""
    e = relation_types(t).select(F.col("head_type").alias("domain"), F.col("p").alias("relation"), F.col("tail_type").alias("range")).distinct()
    return e.unionByName(e.where(F.col("domain") == F.col("range")).select("domain", F.concat("relation", F.lit("_inv")).alias("relation"), "range"))


def meta_paths(t: DataFrame, hops: int = 2) -> DataFrame:
    """``(path, n)``: walks of ``hops`` triples by their types and relations. Walks are counted by end point and path, step by step, so no walk
    is ever a row of its own, however many run through a hub. The last step needs no end points: its triples are counted by start,
    relation and type first."""
    e = t.select("s", "p", "o").distinct()
    state = e.groupBy("o", F.concat_ws(" ", entity_type(F.col("s")), "p", entity_type(F.col("o"))).alias("path")).agg(F.count(F.lit(1)).alias("n"))
    for step in range(hops - 1):
        last = step == hops - 2
        if last:
            out = e.groupBy("s", F.concat_ws(" ", "p", entity_type(F.col("o"))).alias("more")).agg(F.count(F.lit(1)).alias("m"))
            met = state.withColumnRenamed("o", "s").join(out, "s")
            state = met.groupBy(F.concat_ws(" ", "path", "more").alias("path")).agg(F.sum(F.col("n") * F.col("m")).alias("n"))
        else:
            met = state.withColumnRenamed("o", "s").join(e, "s")
            state = met.groupBy("o", F.concat_ws(" ", "path", "p", entity_type(F.col("o"))).alias("path")).agg(F.sum("n").alias("n"))
    return state.groupBy("path").agg(F.sum("n").alias("n"))


def shortest_hops(t: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """``(start, entity, hop)``: entities within ``hops`` steps of each start (entity), at the first step that reaches them."""
    e = t.select("s", "o").distinct()
    seen = starts.select(F.col("entity").alias("start"), "entity", F.lit(0).alias("hop"))
    edge = seen
    for k in range(1, hops + 1):
        reached = edge.select("start", F.col("entity").alias("s")).join(e, "s").select("start", F.col("o").alias("entity")).distinct()
        edge = reached.join(seen.select("start", "entity"), ["start", "entity"], "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(edge)
    return seen


def orphan_filter(train: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``other`` both of whose ends occur in ``train``."""
    return keep_entities(other, entity_labels(train).distinct().withColumnRenamed("label", "entity"))


def orphan_entities(train: DataFrame, other: DataFrame) -> DataFrame:
    """Entities of ``other`` that don't occur in ``train``."""
    return entity_labels(other).distinct().join(entity_labels(train).distinct(), "label", "left_anti")


def split_overlap(t: DataFrame) -> DataFrame:
    """``(a, b, n)``: distinct triples that two splits share, one pass over all splits."""
    per = t.select("s", "p", "o", "split").distinct().groupBy("s", "p", "o").agg(F.array_sort(F.collect_set("split")).alias("in"))
    pairs = per.where(F.size("in") > 1).select(F.explode("in").alias("a"), "in").select("a", F.explode("in").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def presence(t: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each wanted label, its rows per split."""
    rows = t.select("split", F.explode(F.array_distinct(F.array("s", "o"))).alias("label"))
    return labels.select("label").join(rows, "label", "left").groupBy("label", "split").agg(F.count("split").alias("n"))


def corrupt(t: DataFrame, entities: DataFrame, per_triple: int = 1, seed: int = 42) -> DataFrame:
    """Negative triples ``(s, p, o)``: head or tail replaced by an entity of the dense map (id, label), chosen by a hash; never a known triple."""
    n = entities.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    tries = t.select("s", "p", "o").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_triple))))
    h = F.md5(F.concat_ws("|", F.lit(seed), "s", "p", "o", "k"))
    number = F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")
    picked = tries.crossJoin(F.broadcast(n)).withColumn("id", F.pmod(number, F.col("n"))).withColumn("head", F.substring(h, 16, 1) < "8")
    with_label = picked.join(entities.select("id", "label"), "id")
    made = with_label.select(F.when(F.col("head"), F.col("label")).otherwise(F.col("s")).alias("s"), "p", F.when(F.col("head"), F.col("o")).otherwise(F.col("label")).alias("o"))
    return made.join(t.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti").select("s", "p", "o")
