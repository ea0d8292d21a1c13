import itertools
import random

from tripleflow.llm import overlap

MAP = [(0, "note", "text", None, True, False), (1, "fee", "double", None, False, False), (2, "hasProduct", "string", None, True, True)]
SCHEMA = "id long, label string, value_type string, unit string, multi_valued boolean, o_is_entity boolean"
TRIPLES = "triple_id long, s string, p string, o string, split string, source string, key string"


def run(spark, rows):
    t = spark.createDataFrame([(i, *r, "crm", "x") for i, r in enumerate(rows)], TRIPLES)
    return overlap.overlaps(t, spark.createDataFrame(MAP, SCHEMA))


def pairs(spark, rows):
    got = [(r.train_id, r.eval_id) for r in run(spark, rows).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_same_facts(spark):
    rows = [
        ("a", "fee", "R$ 1,50", "train"), ("A ", " fee", "1.5", "test"), ("a", "fee", "1.51", "valid"), ("b", "fee", "1.5", "valid"), ("a", "hasProduct", "off_1", "train"), ("a", "hasProduct", " OFF_1\t", "valid"),
        ("a", "fee", "none", "train"), ("a", "fee", "none", "test"), ("a", "fee", "x", "train"), ("a", "fee", "x", "test"), ("a", "other", "1", "train"), ("a", "other", "1", "test"), (None, "fee", "1.5", "test"), ("a", None, "1.5", "test"),
        ("a", "fee", None, "test"), ("a", "fee", "1.5", None), ("a", "fee", "1,50", "train"),
    ]
    assert pairs(spark, rows) == {(0, 1), (16, 1), (4, 5)}
    report = {(r.split, r.n_rows, r.n_pairs) for r in overlap.report(run(spark, rows)).collect()}
    assert report == {("test", 1, 2), ("valid", 1, 1)}


BASE = "Suspensão temporária por fatura 11/2023 em aberto, aviso 3141855 enviado"
SAME = [
    BASE.upper(), "suspensao temporaria por fatura 11/2023 em aberto aviso 3141855 enviado", "temporária Suspensão por fatura 11/2023 em aberto, aviso 3141855 enviado", "Suspensão temporária fatura 11/2023 em aebtro, aviso 3141855 enviado",
    "suspensão temporária por fat. 11/2023 em aberto, aviso 3141855 enviado", "Suspensão  temporária\tpor fatura 11/2023 em aberto; aviso 3141855 enviado.",
]
OTHER = ["Suspensão temporária por fatura 11/2023 em aberto, aviso 3141856 enviado", "Suspensão temporária por fatura 12/2023 em aberto, aviso 3141855 enviado", "Suspensão definitiva por contrato 11/2023 em aberto, aviso 3141855 enviado"]


def test_manner_of_writing(spark):
    rows = [("s", "note", BASE, "train"), ("t", "note", BASE, "test")] + [("s", "note", x, "valid") for x in SAME + OTHER]
    assert pairs(spark, rows) == {(0, 2 + k) for k in range(len(SAME))}


def test_short_and_numberless_texts(spark):
    rows = [
        ("s", "note", "dmiollopadi 399973663", "train"), ("s", "note", "dimolopadi 399973663", "test"), ("s", "note", "pedido no canal sul", "train"), ("s", "note", "pedido no canal norte", "test"), ("s", "note", "pedido canal sul", "test"),
        ("s", "note", "...", "train"), ("s", "note", "...", "test"), ("s", "note", "", "train"), ("s", "note", "", "test"), ("s", "note", "w " * 30_000 + "7", "train"), ("s", "note", "W " * 30_000 + "7", "test"),
    ]
    assert pairs(spark, rows) == {(0, 1), (2, 4), (5, 6), (9, 10)}


def test_prefix_filter_loses_nothing(spark):
    dice = random.Random(4)
    vocabulary = ["linha", "plano", "fatura", "cliente", "contrato", "aberto", "serviço", "cobrança", "pacote", "sinal", "de", "no"]
    rows = []
    for k in range(120):
        words = dice.sample(vocabulary, dice.randint(2, 9))
        rows.append(("s", "note", " ".join(words), "train"))
        w = list(words)
        for _ in range(dice.randint(0, 2)):
            i = dice.randrange(len(w))
            w[i] = w[i][:1] + w[i][2:] if len(w[i]) > 3 and dice.random() < 0.7 else w[i]
        dice.shuffle(w)
        rows.append(("s", "note", " ".join(w), dice.choice(["test", "valid"])))
    fold = [overlap.folded(r[2])[1] for r in rows]
    grams = [set(overlap.shingles(f)) for f in fold]
    want = set()
    for i, j in itertools.product(range(len(rows)), repeat=2):
        if rows[i][3] == "train" and rows[j][3] != "train":
            alike = len(grams[i] & grams[j]) >= overlap.LEAST * len(grams[i] | grams[j]) - 1e-9
            if fold[i] == fold[j] or alike and overlap.same_writing(fold[i], fold[j]):
                want.add((i, j))
    assert len(want) > 120 and pairs(spark, rows) == want


def test_nothing(spark):
    assert pairs(spark, []) == set() and pairs(spark, [("a", "note", "x", "train")]) == set()
