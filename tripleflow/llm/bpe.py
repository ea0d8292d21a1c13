"""Encoding a corpus with a public byte-level BPE tokenizer: recursive queries in DuckDB, partition by partition.

A text is cut into pieces at blanks, and a piece into words by the tokenizer's own pattern. In each task, the distinct words of a batch
that aren't known yet become rows (word, position, token) in DuckDB, a token being a byte at first. A recursive query joins neighbours
with the merge table and contracts the pair of least rank, until no word has a pair left that the merge table knows; ordered
aggregation gives the ids of each word. The ids of a text are those of its pieces, gathered in order.

In a step, all occurrences of a word's least pair are contracted, from the left and without overlap. That gives the same ids as one
at a time: a pair that holds a merged token has a higher rank than the merge that made it. It keeps the steps of a word to the number of
different merges in it, not their total, which matters for very long words.

A word that is an entry of the vocabulary has the id of that entry, by the tokenizer's own rule; a join with the vocabulary gives it, and the
recursion begins with the others. ``decode`` turns ids back into text by an ordered aggregation of the tokens' bytes.

Scale: no shuffle; a task holds a batch of documents (``BATCH_CHARS`` of text) and its words. The vocabulary file (its size is that of the
public vocabulary) is sent to each executor once, from the driver. A document longer than a batch is a batch of its own.

Defined results: null and empty texts give an empty list; blank texts are encoded as they are; the strings of special tokens are
ordinary text; lone surrogates can't occur, as Spark's strings are UTF-8; ids outside the vocabulary decode to nothing, and bytes that
are no UTF-8 to the replacement character.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import local_path, new_path

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters of text encoded together in a task, pieces kept from batch to batch, and rows a recursive query begins with.
BATCH_CHARS, KEPT_PIECES, QUERY_ROWS = 4_000_000, 300_000, 1_000_000

_READY: dict[str, "Encoder"] = {}


# Rows of words without a known pair leave the recursion, so a step costs only what is still open. Where the least pair is twice the same
# token, its places may overlap, and only every second of them in a row is contracted.
CONTRACT = """
    with recursive step(w, pos, tok, open) as (
        select w, pos, tok, true from start
        union all
        select w, pos, tok, open from (
            with paired as (
                select w, pos, tok, lead(tok) over seq nxt, row_number() over seq k from step where open window seq as (partition by w order by pos)
            ), known as (
                select p.*, m.r from paired p left join merges m on m.a = p.tok and m.b = p.nxt
            ), least as (select w, min(r) least from known group by w
            ), ranked as (select k.*, l.least, coalesce(k.r=l.least,false) starts from known k join least l using(w)
            ), merged as (
                select w, pos, tok, least, starts and (tok <> nxt or (k - max(case when starts then 0 else k end) over seq) % 2 = 1) takes
                from ranked window seq as (partition by w order by pos)
            )
            select w, pos, case when takes then least else tok end tok, least is not null open
            from (select *, lag(takes, 1, false) over (partition by w order by pos) gone from merged) where not gone
        )
    )
    select w, list(tok order by pos) ids from step where not open group by w
"""


_UNEVEN = re.compile(r"^ | $| \s|\s ")


def pieces_of(text: str) -> list[str]:
    """The text in pieces that begin with the blank before them. The pattern never joins what is cut here, a blank between two
    characters that aren't white space; blanks in other places stay inside a piece."""
    parts = text.split(" ")
    if not _UNEVEN.search(text):
        return [parts[0], *[" " + x for x in parts[1:]]]
    out = [parts[0]]
    for part in parts[1:]:
        last = out[-1]
        if part and not part[0].isspace() and last and not last[-1].isspace():
            out.append(" " + part)
        else:
            out[-1] = f"{last} {part}"
    return out


class Encoder:
    """A DuckDB with the merge table of a vocabulary. Pieces of text (from one blank to the next) are encoded once and remembered."""

    def __init__(self, path: str, spill: str = "") -> None:
        import duckdb
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(PATTERN)
        self.db = duckdb.connect(config={"memory_limit": "500MB", "threads": 1, "temp_directory": spill})
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._table("pairs", {c: pa.array([p[i] for p in pairs], pa.int32()) for i, c in enumerate("abr")})
        self.db.execute("create table merges as select a, b, r from pairs")
        self._table("entries", {"b": pa.array(list(ranks), pa.binary()), "r": pa.array(list(ranks.values()), pa.int32())})
        self.db.execute("create table vocabulary as select b, r from entries")
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self._forget()

    def _table(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register(name, pa.table(columns))

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.pieces = pa.array([], pa.list_(pa.int32()))

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """The ids of each word: entries of the vocabulary by a join, the rest by the recursive query."""
        out: list[list[int]] = [[]] * len(words)
        raw = [word.encode("utf-8") for word in words]
        self._table("words", {"w": pa.array(range(len(raw)), pa.int32()), "b": pa.array(raw, pa.binary())})
        found = self.db.sql("select w, r from words join vocabulary using (b)").to_arrow_table()
        for k, r in zip(*(c.to_pylist() for c in found.columns)):
            out[k] = [r]
        w: list[int] = []
        pos: list[int] = []
        tok: list[int] = []
        byte = self.byte

        def contract() -> None:
            self._table("start", {"w": pa.array(w, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(tok, pa.int32())})
            for k, ids in zip(*(c.to_pylist() for c in self.db.sql(CONTRACT).to_arrow_table().columns)):
                out[k] = ids
            w.clear(), pos.clear(), tok.clear()

        for k, letters in enumerate(raw):
            if out[k]:
                continue
            w += [k] * len(letters)
            pos += range(len(letters))
            tok += [byte[c] for c in letters]
            if len(w) > QUERY_ROWS:
                contract()
        if w:
            contract()
        return out

    def decode(self, ids: pa.Array) -> list[str]:
        """The text of each list of ids."""
        n = len(ids)
        flat = ids.flatten()
        lengths = ids.value_lengths().fill_null(0).to_numpy()
        doc = np.repeat(np.arange(n), lengths)
        self._table("told", {"d": pa.array(doc, pa.int32()), "pos": pa.array(np.arange(len(doc)), pa.int64()), "r": flat})
        got = self.db.sql("select d, list(b order by pos) l from told join vocabulary using (r) group by d").to_arrow_table()
        out = [""] * n
        for d, parts in zip(*(c.to_pylist() for c in got.columns)):
            out[d] = b"".join(parts).decode("utf-8", "replace")
        return out

    def learn(self, fresh: list[str]) -> None:
        """Gives each piece of ``fresh`` the next code and its ids."""
        cut = [self.pattern.findall(x) for x in fresh]
        words = list(dict.fromkeys(x for c in cut for x in c))
        ids = dict(zip(words, self.word_ids(words)))
        for x in fresh:
            self.code[x] = len(self.code)
        self.pieces = pa.concat_arrays([self.pieces, pa.array([[i for x in c for i in ids[x]] for c in cut], pa.list_(pa.int32()))])

    def encode(self, texts: list[str | None]) -> pa.Array:
        """The ids of each text."""
        if len(self.code) > KEPT_PIECES:
            self._forget()
        cut = [pieces_of(t) if t else [] for t in texts]
        code = self.code
        fresh = list(dict.fromkeys(x for c in cut for x in c if x not in code))
        if fresh:
            self.learn(fresh)
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(c) for c in cut], out=starts[1:])
        seq = np.fromiter((code[x] for c in cut for x in c), np.int64, starts[-1])
        got = self.pieces.take(pa.array(seq))
        offsets = got.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(offsets[starts] - offsets[0], pa.int32()), got.flatten())


def encoder(path: str, spill: str | None = None) -> Encoder:
    """The encoder of a vocabulary, one for each Python worker; its DuckDB spills to a folder of its own under ``spill``, if there is one."""
    from pyspark import SparkFiles

    if path not in _READY:
        own = f"{spill}/{uuid.uuid4().hex[:12]}" if spill else ""
        _READY[path] = Encoder(path if os.path.isabs(path) else SparkFiles.get(path), own)
    return _READY[path]


def sent(spark: SparkSession, folder: str) -> tuple[str, str | None]:
    """Sends the vocabulary in ``folder`` of the driver to the executors, once per application; gives the name it has there, and where to spill."""
    context = spark.sparkContext
    done = getattr(context, "_tripleflow_vocabularies", set())
    if folder not in done:
        context.addFile(f"{folder}/{VOCABULARY}")
        context._tripleflow_vocabularies = done | {folder}
    return VOCABULARY, local_path(new_path(spark, "duck"))


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= BATCH_CHARS:
                yield keys[at : i + 1], texts[at : i + 1]
                at, size = i + 1, 0
        if at < len(texts):
            yield keys[at:], texts[at:]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, ids)``: the token ids of each text, without special tokens."""
    at_hand = sent(docs.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _batched(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), encoder(*at_hand).encode(texts)], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, text)``: the text of each list of ids."""
    at_hand = sent(encoded.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder(*at_hand).decode(part.column(1)), pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, keep: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens)``, by the same queries, with the string column ``keep`` between them if it is given."""
    at_hand = sent(docs.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for keys, texts in _batched(iter([batch])):
                n = encoder(*at_hand).encode(texts).value_lengths().cast(pa.int64())
                kept = [batch.column(2).slice(at, len(keys))] if keep else []
                at += len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *kept, n], ["doc_id", *([keep] if keep else []), "n_tokens"])

    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string"), *([F.col(keep)] if keep else [])]
    return docs.select(*columns).mapInArrow(run, f"doc_id long, {keep + ' string, ' if keep else ''}n_tokens long")
