from pyspark.sql import functions as F

from tripleflow.functions.values import with_reading

CASES = [
    ("double", None, "2.711,40", "ok", "2711.4"), ("double", None, "2,711.40", "ok", "2711.4"), ("double", None, "R$ 1.115,11", "ok", "1115.11"), ("double", None, "R$ -8,24", "ok", "-8.24"),
    ("double", None, "BRL-980.10", "ok", "-980.1"), ("double", None, "1.04200000e+01", "ok", "10.42"), ("double", None, "-0", "ok", "0.0"), ("double", None, "1O0,00", "bad", None),
    ("double", None, "12,3,4", "bad", None), ("double", None, "R$", "bad", None), ("double", None, "--", "bad", None), ("double", None, "-", "missing", None), ("double", None, " N/A\t", "missing", None),
    ("double", None, None, "missing", None), ("double", None, "1e999", "bad", None), ("double", None, "  ", "missing", None),
    ("bigint", None, "001", "ok", "1"), ("bigint", None, " +7 ", "ok", "7"), ("bigint", None, "12.0", "ok", "12"), ("bigint", None, "12,00", "ok", "12"), ("bigint", None, "1..2", "bad", None),
    ("bigint", None, "dia 5", "bad", None), ("bigint", None, "5 GB", "bad", None), ("bigint", "MB", "5 GB", "ok", "5120"), ("bigint", "MB", "0,25GB", "ok", "256"), ("bigint", "MB", "10240MB", "ok", "10240"),
    ("bigint", "MB", "GB", "bad", None), ("bigint", "MB", "2 x 5", "bad", None), ("bigint", "MB", "0.3 MB", "bad", None), ("bigint", None, "99999999999999999999", "bad", None),
    ("boolean", None, "Sim", "ok", "true"), ("boolean", None, "NÃO", "ok", "false"), ("boolean", None, "0", "ok", "false"), ("boolean", None, "2", "bad", None), ("boolean", None, "None", "missing", None),
    ("timestamp", None, "2024-12-28 04:39:08", "ok", "1735371548"), ("timestamp", None, "28/12/2024 04:39:08", "ok", "1735371548"), ("timestamp", None, "2024-12-28T07:39:08.999Z", "ok", "1735371548"),
    ("timestamp", None, "2024-12-28T09:39:08+02:00", "ok", "1735371548"), ("timestamp", None, "1735371548999", "ok", "1735371548"), ("timestamp", None, "2024-13-01T00:00:00Z", "bad", None),
    ("timestamp", None, "30/02/2024 00:00:00", "bad", None), ("timestamp", None, "00/00/0000 00:00:00", "bad", None), ("timestamp", None, "ontem", "bad", None), ("timestamp", None, "2024-12-28T25:00:00Z", "bad", None),
    ("timestamp", None, "1970-01-01T22:59:59.151-03:00", "missing", None), ("timestamp", None, "31/12/9999 00:00:00", "missing", None), ("timestamp", None, "nenhum", "missing", None),
    ("string", None, "\tEm Aviso ", "ok", "em aviso"), ("string", None, "", "missing", None), ("text", None, "x" * 200_000, "ok", "x" * 200_000), (None, None, "Aa", "ok", "aa"),
]


def test_every_notation(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, value_type string, unit string, o string, want_state string, want string")
    rows = with_reading(df).orderBy("i").collect()
    wrong = [(r.value_type, r.o[:40] if r.o else r.o, r.state, r.canon) for r in rows if (r.state, r.canon) != (r.want_state, r.want)]
    assert len(rows) == len(CASES) and not wrong


def test_shown_only_where_readable(spark):
    df = spark.createDataFrame([("string", None, " Ab "), ("double", None, "x")], "value_type string, unit string, o string")
    assert [r.shown for r in with_reading(df).orderBy(F.desc("value_type")).collect()] == ["Ab", None]
