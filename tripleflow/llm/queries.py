"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE
from ..plans.problems import READ_SQL
from ..storage import ship, table
from . import ann, bpe, mixing, overlap, reading, terms

DIMENSION = 128
# The domain of each source of the documents.
DOMAINS = {
    "ticket": "service", "chat": "service", "faq": "service", "forum_export": "service",
    "runbook": "technical", "rule_note": "technical", "paper_note": "technical",
    "run_log": "machine", "enquiry_json": "machine",
}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ann.similar_pairs(ann.usable(table(spark, d, "node_embeddings"), "id", "entity_embeddings", DIMENSION))


def p3_similar(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar vectors of each row whose id is divisible by 100."""
    vectors = ann.usable(table(spark, d, "node_embeddings"), "id", "entity_embeddings", DIMENSION)
    return ann.most_similar(vectors, vectors.where(F.col("id") % 100 == 0), 10).withColumn("cosine", F.round("cosine", 6))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    triples = table(spark, d, "triples")
    return terms.marked(terms.term_counts(triples), triples)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "triples"), table(spark, d, "transe_relation_map"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("train_id", "eval_id").alias("triple_id_a"), F.greatest("train_id", "eval_id").alias("triple_id_b")).distinct()


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """The overlaps of all facts but texts, which SQL can check."""
    relations = table(spark, d, "transe_relation_map").where("value_type <> 'text'")
    found = overlap.overlaps(table(spark, d, "triples"), relations)
    return found.select("train_id", "eval_id").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(_overlaps(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts, decoded from their ids."""
    return bpe.decode(bpe.encode(table(spark, d, "documents")))


def _sizes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "source_targets")
    sizes = mixing.sized_documents(table(spark, d, "documents"), targets)
    return sizes, mixing.plan(sizes, targets, spark.createDataFrame(list(DOMAINS.items()), "source string, domain string"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(_sizes(spark, d)[1])


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_sizes(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, planned = _sizes(spark, d)
    return mixing.shares(mixing.mix(sizes, planned), planned)


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding(_levels(spark, d))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words per level, rounded, and source."""
    docs = table(spark, d, "documents").select("doc_id", mixing.name_of("source").alias("source"))
    rounded = _levels(spark, d).withColumn("reading_level", F.round("level").cast("int"))
    return rounded.join(docs, "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))


_ALL = (p3_found, p3_similar, p4_found, p4_terms, p6_found, p6_values, p6_report, p8_ids, p8_text, p9_found, p9_mix, p9_shares, p10_found, p10_levels, p10_profile)


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    query.__doc__ = f.__doc__
    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _shipped(f) for f in _ALL}

_W = "'" + WHITE + "'"
_TERMS = rf"""
with r as (select upper(trim(s, {_W})) s, trim(p, {_W}) p, o, triple_id from triples where s is not null),
piece as (select s, triple_id, unnest(regexp_split_to_array(lower(nfc_normalize(o)), '[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+')) x from r),
occ as (
  select 'p' field, p term, s, triple_id from r where p is not null
  union all
  select 'o', term, s, triple_id from (select distinct regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') term, s, triple_id from piece) where regexp_full_match(term, '\p{{L}}{{2,}}')
),
k as (select field, term, count(*) n_rows, count(distinct s) n_records from occ group by all),
tot as (select count(distinct s) records from r),
marked as (
  select field, term, n_rows, n_records, 'rare' mark from k where n_records <= 2
  union all select field, term, n_rows, n_records, 'common' from k, tot where n_records >= 0.07 * records
  union all select field, term, n_rows, n_records, null from k, tot where n_records > 2 and n_records < 0.07 * records
)
"""
_VECTORS = f"""
with v as (select id, entity_embeddings::double[{DIMENSION}] e from node_embeddings
  where len(entity_embeddings) = {DIMENSION} and len(list_filter(entity_embeddings, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(entity_embeddings, lambda x: x <> 0)) > 0)
"""

SQL: dict[str, str] = {
    "p3_found": _VECTORS + "select a.id id_a, b.id id_b from v a join v b on a.id < b.id where array_cosine_similarity(a.e, b.e) >= 0.9",
    "p3_similar": _VECTORS + """, w as (select id, e, e::varchar bits from v), q as (select * from w where id % 100 = 0),
x as (select q.id, w.id neighbour, q.bits = w.bits same, round(array_cosine_similarity(q.e, w.e), 9) near, round(array_cosine_similarity(q.e, w.e), 12) cosine from q join w on q.id <> w.id),
y as (select *, row_number() over (partition by id order by same desc, near desc, neighbour)::int place from x) select id, neighbour, place, round(cosine, 6) cosine from y where place <= 10""",
    "p6_values": READ_SQL + """, f as (select triple_id, split, s, p, canon from r where vt <> 'text' and canon is not null)
select distinct a.triple_id train_id, b.triple_id eval_id from f a join f b on a.s = b.s and a.p = b.p and a.canon = b.canon and a.split = 'train' and b.split in ('valid', 'test')""",
    "p4_found": _TERMS + "select field, term, mark from marked where mark is not null",
    "p8_text": "select doc_id, coalesce(text, '') as text from documents",
    "p4_terms": _TERMS + "select field, term, n_rows, n_records, mark from marked",
}
