import base64
import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripleflow.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def tools():
    path = f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return bpe.encoder(path), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(text=st.text(st.sampled_from("ab é's1 \n\t\xa0.,-<|ção漢😀") | st.characters(codec="utf-8"), max_size=60))
def test_any_text(tools, text):
    mine, public = tools
    assert mine.encode([text])[0].as_py() == public.encode_ordinary(text)


def test_long_and_odd_texts(tools):
    mine, public = tools
    dice = random.Random(1)
    texts = ["", None, " ", "  \n ", "a" * 20_000, "ab" * 10_000, " " * 5_000 + "x", "".join(dice.choice(string.ascii_letters + string.digits) for _ in range(5_000)), "<|endoftext|>", "it's we'll I'M", "x  y 　z\x1c\x1d"]
    got = mine.encode(texts).to_pylist()
    assert got == [public.encode_ordinary(t) if t else [] for t in texts]
    assert public.decode(got[7]) == texts[7]


def test_forgetting_words_changes_nothing(tools, monkeypatch):
    mine, public = tools
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    monkeypatch.setattr(bpe, "QUERY_ROWS", 5)
    for text in ("zxqwv unabridgedness", "other qqqwords entirely", "zxqwv again"):
        assert mine.encode([text])[0].as_py() == public.encode_ordinary(text)


def test_documents(spark, tools):
    rows = [(1, "Olá mundo", "x"), (2, None, "y"), (3, "", "z"), (4, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    assert got == {i: tools[1].encode_ordinary(t) if t else [] for i, t, _ in rows}
    assert {r.doc_id: (r.ids, r.n_tokens) for r in bpe.token_counts(docs, keep="ids").collect()} == {i: (x, len(got[i])) for i, _, x in rows}
    assert bpe.encode(docs.limit(0)).count() == 0


def test_decoding_gives_the_texts_back(spark):
    texts = ["Olá mundo", None, "", " ", "a\n\t b  <b>漢😀", "word " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()} == {i: t or "" for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, [-1, 10_000_000]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd).collect()} == {1: "", 2: "", 3: ""}
