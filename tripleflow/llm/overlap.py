"""Same or near-same facts across splits: an exact prefix-filter join of the evaluation splits with the training split.

A fact is (s, p, o) with o read by the value type of p. For all but texts, equal readings are the same fact. A text is the same fact if
its digits are the same and its words differ in the manner of writing only. Facts are first put in blocks (s, p, reading) or, for
texts, (s, p, digits): that part must be equal, so facts whose block lacks one of the two sides drop out before anything is compared.

Texts of a block are sets of shingles, the three-letter pieces of their folded words, which neither the order of the words nor their
case or accents change. The shingles are ordered from rare to common; the prefix of a set of n holds its n - ceil(t n) + 1 rarest. Two sets
with a Jaccard similarity of t share a shingle of their prefixes, so the prefixes of the evaluation side are indexed and those of the
training side probe them, with the length and the position filter. The pairs left are verified, by the whole sets and then word by word.
t is LEAST for sets of any size: as low as slips in every word of a short text can bring it, and what it lets through is verified.

Scale: one shuffle of the facts by block; what follows is over the facts with both sides only. Copies of a text are one class: classes are
compared, and rows joined to their classes last.

Defined results: null, missing or unreadable values, null s or p, and p outside the relation map state no fact; rows of other
splits than train, valid and test are on neither side; repeated rows are pairs of their own, as p6_found asks; a text without letters and
digits is compared as written; empty tables give no rows; texts are used whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_key, trimmed
from ..functions.values import with_reading
from ..storage import written

LEAST = 0.3
TRAIN, EVALUATION = "train", ("valid", "test")
#: A word of up to so many letters (an article, a preposition) may be left out in writing; slips of a word may be this share of its letters.
FILLER, SLIPS = 4, 0.4
_TOKEN = re.compile(r"\d+|[^\W\d_]+")


def folded(text: str) -> tuple[str, str]:
    """The digits of a text, sorted by number, and its words without case and accents, in order."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))
    tokens = _TOKEN.findall(flat)
    numbers = sorted(t for t in tokens if t.isdigit())
    words = " ".join(t for t in tokens if not t.isdigit())
    return " ".join(numbers), words if words or numbers else text


def shingles(words: str) -> list[str]:
    """The distinct three-letter pieces of the words with their ends marked."""
    return sorted({m[i : i + 3] for w in words.split() for m in [f"#{w}#"] for i in range(len(m) - 2)})


def slips(a: str, b: str, most: int) -> int:
    """Edits, swaps of neighbours included, that turn a into b; ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def same_writing(a: str, b: str) -> bool:
    """Whether the words of two folded texts differ in the manner of writing only: order, slips, abbreviations, small words left out."""
    x, y = list((Counter(a.split()) - Counter(b.split())).elements()), list((Counter(b.split()) - Counter(a.split())).elements())
    for u in list(x):
        near = []
        for v in y:
            most = int(SLIPS * min(len(u), len(v)))
            if most and (n := slips(u, v, most)) <= most:
                near.append((n, v))
        if near:
            x.remove(u)
            y.remove(min(near)[1])
    for u in list(x):
        short = next((v for v in y if min(len(u), len(v)) >= 2 and (u.startswith(v) or v.startswith(u))), None)
        if short:
            x.remove(u)
            y.remove(short)
    rest = x or y
    return not (x and y) and all(len(w) <= FILLER for w in rest)


def facts(triples: DataFrame, relation_map: DataFrame) -> DataFrame:
    """``(triple_id, ev, split, source, s, p, key, words)``: key is the reading or the digits, words the folded text or null."""
    known = F.broadcast(relation_map.where(F.col("label").isNotNull()).dropDuplicates(["label"]).select(trimmed("label").alias("p"), "value_type", "unit"))
    side = triples.where(F.col("split").isin(TRAIN, *EVALUATION) & F.col("s").isNotNull() & F.col("o").isNotNull())
    rows = side.select(F.col("triple_id").cast("long").alias("triple_id"), (F.col("split") != TRAIN).alias("ev"), "split", "source", entity_key("s").alias("s"), trimmed("p").alias("p"), F.col("o").cast("string").alias("o")).join(known, "p")
    head = ["triple_id", "ev", "split", "source", "s", "p"]
    read = with_reading(rows).where(F.col("canon").isNotNull()).select(*head, F.col("canon").alias("key"), F.coalesce(F.col("value_type") == "text", F.lit(False)).alias("is_text"))
    schema = read.select(*head, "key", F.lit(None).cast("string").alias("words")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, is_text = batch.column(len(head)), batch.column(len(head) + 1)
            both = [folded(t) for t in key.filter(is_text).to_pylist()]
            words = pc.replace_with_mask(pa.nulls(len(key), key.type), is_text, pa.array([b[1] for b in both], key.type))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(head)], pc.replace_with_mask(key, is_text, pa.array([b[0] for b in both], key.type)), words], [*head, "key", "words"])

    return read.mapInArrow(fold, schema)


BLOCK = ["s", "p", "key"]


def two_sided(rows: DataFrame) -> DataFrame:
    """The facts whose block has rows of either side, written. An action."""
    blocks = rows.groupBy(*BLOCK).agg(F.bool_or("ev").alias("has_ev"), F.bool_or(~F.col("ev")).alias("has_tr")).where("has_ev and has_tr").select(*BLOCK)
    return written(rows.join(blocks, BLOCK, "left_semi"), "facts")


def text_classes(rows: DataFrame) -> DataFrame:
    """``(s, p, key, words, ev, tr, cid)``: the different texts of each block."""
    return rows.where(F.col("words").isNotNull()).groupBy(*BLOCK, "words").agg(F.bool_or("ev").alias("ev"), F.bool_or(~F.col("ev")).alias("tr"), F.min("triple_id").alias("cid"))


def class_pairs(classes: DataFrame, t: float = LEAST) -> DataFrame:
    """``(e, t)``: the classes of an evaluation and a training text that are the same but not equal in their folded words."""
    pieces = F.pandas_udf(lambda s: s.map(shingles), "array<string>")
    exploded = classes.select("cid", F.explode(pieces("words")).alias("g"))
    often = exploded.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    ordered = exploded.join(often, "g").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("o"))
    sized = classes.join(ordered, "cid").withColumn("size", F.size("o"))
    prefix = sized.withColumn("len", F.col("size") - F.ceil(t * F.col("size") - F.lit(1e-9)) + 1)
    posted = prefix.select("cid", *BLOCK, "ev", "tr", "size", F.posexplode(F.slice("o", F.lit(1), F.col("len").cast("int"))).alias("pos", "og")).withColumn("g", F.col("og.g")).drop("og")
    left = posted.where("ev").select(*BLOCK, "g", F.col("cid").alias("e"), F.col("size").alias("se"), F.col("pos").alias("pe"))
    right = posted.where("tr").select(*BLOCK, "g", F.col("cid").alias("t"), F.col("size").alias("st"), F.col("pos").alias("pt"))
    met = left.join(right, [*BLOCK, "g"]).where(F.col("e") != F.col("t"))
    least = F.ceil(F.lit(t / (1 + t)) * (F.col("se") + F.col("st")) - F.lit(1e-9))
    fits = (F.least("se", "st") >= t * F.greatest("se", "st") - F.lit(1e-9)) & (1 + F.least(F.col("se") - F.col("pe"), F.col("st") - F.col("pt")) - 1 >= least)
    candidates = met.where(fits).select("e", "t").distinct()
    texts = classes.select("cid", "words")
    both = candidates.join(texts.toDF("e", "we"), "e").join(texts.toDF("t", "wt"), "t")

    def same(a: str, b: str) -> bool:
        x, y = set(shingles(a)), set(shingles(b))
        return len(x & y) >= t * len(x | y) - 1e-9 and same_writing(a, b)

    check = F.pandas_udf(lambda a, b: a.combine(b, same).astype(bool), "boolean")
    return both.where(check("we", "wt")).select("e", "t")


def overlaps(triples: DataFrame, relation_map: DataFrame) -> DataFrame:
    """``(train_id, eval_id, split, source, train_source)``: pairs of a training and an evaluation row that state the same fact. An action."""
    rows = two_sided(written(facts(triples, relation_map), "read"))  # values are read once
    fact = [*BLOCK, F.coalesce("words", F.lit("")).alias("w")]
    tr = rows.where(~F.col("ev")).select(*fact, F.col("triple_id").alias("train_id"), F.col("source").alias("train_source"))
    ev = rows.where(F.col("ev")).select(*fact, F.col("triple_id").alias("eval_id"), "split", "source")
    equal = ev.join(tr, [*BLOCK, "w"]).select("train_id", "eval_id", "split", "source", "train_source")
    classes = written(text_classes(rows), "classes")
    pairs = class_pairs(classes)
    names = classes.select("cid", *BLOCK, F.col("words").alias("w"))
    ev_c = ev.join(names, [*BLOCK, "w"]).select("eval_id", "split", "source", F.col("cid").alias("e"))
    tr_c = tr.join(names, [*BLOCK, "w"]).select("train_id", "train_source", F.col("cid").alias("t"))
    near = pairs.join(ev_c, "e").join(tr_c, "t").select("train_id", "eval_id", "split", "source", "train_source")
    return equal.unionByName(near)


def report(found: DataFrame) -> DataFrame:
    """Per split and source of the evaluation row: its rows with an overlap, and the pairs."""
    per_row = found.groupBy("split", "source", "eval_id").agg(F.count(F.lit(1)).alias("n"))
    return per_row.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_pairs"))
