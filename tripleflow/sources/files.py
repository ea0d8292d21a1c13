"""Reading and writing files of many formats, by their names."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SNIFF_BYTES = 65_536


def suffix(path: str) -> str:
    return PurePosixPath(path.rstrip("/*")).suffix.lower()


def sniff_separator(head: str) -> str:
    """``;`` if there are more of them than commas, else tab if there are more of those, else comma."""
    n = {c: head.count(c) for c in ";\t,"}
    return ";" if n[";"] > n[","] else "\t" if n["\t"] > n[","] else ","


def _head(spark: SparkSession, path: str) -> bytes:
    got = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, _SNIFF_BYTES).alias("c")).limit(1).collect()
    return bytes(got[0].c) if got else b""


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str | None = None, **options: object) -> DataFrame:
    """CSV with a header; the separator is told from the head of a file unless given, the encoding too (UTF-8, else Latin-1). Without a schema
    all columns are strings: types are never guessed by another pass. Ragged lines are kept as far as they go."""
    head = _head(spark, path) if sep is None else b""
    try:
        text, encoding = head.decode("utf-8"), "UTF-8"
    except UnicodeDecodeError as e:
        cut = e.start >= len(head) - 4
        text, encoding = head.decode("utf-8", "ignore") if cut else head.decode("latin-1"), "UTF-8" if cut else "ISO-8859-1"
    r = spark.read.options(header=True, mode="PERMISSIVE", sep=sep or sniff_separator(text), encoding=encoding, **options)
    return (r.schema(schema) if schema else r).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated without a header: ``column_1`` and so on, all strings unless a schema is given."""
    df = (spark.read.schema(schema) if schema else spark.read).option("sep", "\t").option("header", False).csv(path)
    return df if schema else df.toDF(*(f"column_{i}" for i in range(1, len(df.columns) + 1)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """``(path, data)``: a row per file, the whole text; an empty file is an empty object."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("data"))
    return t.withColumn("data", F.when(F.trim("data") == "", "{}").otherwise(F.col("data")))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``: a row per file; UTF-8, else Latin-1."""
    b = spark.read.format("binaryFile").load(path).select("path", "content")
    return b.select("path", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1")).alias("text"))


def read_zip(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt", ".json", ".csv", ".tsv", ".ndjson", ".jsonl", ".xml")) -> DataFrame:
    """``(path, member, text)`` of archives: members of the given kinds, decoded one by one; a damaged member or archive gives null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    z = zipfile.ZipFile(io.BytesIO(raw))
                    names = [n for n in z.namelist() if PurePosixPath(n).suffix.lower() in suffixes]
                except zipfile.BadZipFile:
                    z, names = None, [""]
                for name in names:
                    try:
                        content = z.read(name) if z else None
                        text = None if content is None else content.decode("utf-8") if _is_utf8(content) else content.decode("latin-1")
                    except (zipfile.BadZipFile, RuntimeError, OSError, ValueError):
                        text = None
                    yield pa.RecordBatch.from_arrays([pa.array([where], pa.string()), pa.array([name], pa.string()), pa.array([text], pa.string())], ["path", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, text string")


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def enquiries(members: DataFrame) -> DataFrame:
    """``(msisdn, data)`` of archive members called ``..._<msisdn>.txt``."""
    return members.select(F.regexp_extract("member", r"_([^_/]+)\.txt$", 1).alias("msisdn"), F.col("text").alias("data")).where(F.col("msisdn") != "")


RULE_COLUMNS = ["predictions", "support", "confidence", "rule"]


def read_rules_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(predictions, support, confidence, rule)``: lines of four parts, or of the rule alone (100, 100, 1.0); other widths raise."""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("x"))
    width = F.size("x")
    bad = F.raise_error(F.concat(F.lit("a line of rules has "), width.cast("string"), F.lit(" parts")))
    four = lambda i, kind, one: F.when(width == 4, F.col("x")[i].cast(kind)).when(width == 1, F.lit(one).cast(kind)).otherwise(bad.cast(kind))
    return parts.select(four(0, "bigint", 100).alias("predictions"), four(1, "bigint", 100).alias("support"), four(2, "double", 1.0).alias("confidence"), F.when(width == 4, F.col("x")[3]).otherwise(F.col("x")[0]).alias("rule"))


def read_rules_json(spark: SparkSession, path: str) -> DataFrame:
    """``(category, id, confidence, pattern)`` of an object category -> list of rules; entries without id or pattern drop out."""
    docs = read_json(spark, path).select(F.from_json("data", "map<string,array<struct<id:string,confidence:double,pattern:string>>>").alias("m"))
    return docs.select(F.explode("m").alias("category", "l")).select("category", F.inline("l")).where("id is not null and pattern is not null")


def read_rules_any(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """``(rule, confidence)`` of Parquet (head or rule, confidence, else the first two columns), TSV, JSON (a list, or its ``rules``), or text."""
    kind = suffix(path)
    if kind == ".parquet":
        df = spark.read.parquet(path)
        name = next((c for c in ("rule", "head") if c in df.columns), df.columns[0])
        conf = "confidence" if "confidence" in df.columns else df.columns[1]
        got = df.select(F.col(name).cast("string").alias("rule"), F.col(conf).cast("double").alias("confidence"))
    elif kind in (".tsv", ".csv"):
        got = read_rules_tsv(spark, path).select("rule", "confidence")
    elif kind == ".json":
        raw = read_json(spark, path)
        entry = "array<struct<rule:string,pattern:string,confidence:double>>"
        both = raw.select(F.coalesce(F.from_json("data", f"struct<rules:{entry}>")["rules"], F.from_json("data", entry)).alias("l"))
        got = both.select(F.inline("l")).select(F.coalesce("rule", "pattern").alias("rule"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    else:
        got = read_text(spark, path).select(F.col("text").alias("rule"), F.lit(1.0).alias("confidence"))
    return got.where(F.col("confidence") >= least)


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, n)``: lines per file."""
    return spark.read.text(path).groupBy(F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("n"))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".csv": read_csv, ".tsv": read_tsv, ".parquet": lambda s, p: s.read.parquet(p), ".pq": lambda s, p: s.read.parquet(p), ".parq": lambda s, p: s.read.parquet(p),
    ".ndjson": lambda s, p: s.read.json(p), ".jsonl": lambda s, p: s.read.json(p), ".json": read_json, ".txt": read_text, ".log": read_text, ".zip": read_zip, ".orc": lambda s, p: s.read.orc(p),
}
#: Formats that need a library or can't be read safely.
GATED = {".xlsx": "openpyxl", ".xls": "openpyxl", ".yaml": "yaml", ".yml": "yaml"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file, a folder of files or a pattern, by its suffix; a folder without one by what it holds (Parquet, CSV, NDJSON, in that order)."""
    kind = suffix(path)
    if kind in READERS:
        return READERS[kind](spark, path)
    if kind in GATED:
        return _gated(spark, path, kind)
    if not kind:
        return read_folder(spark, path)
    raise ValueError(f"no reader for {path!r}")


FOLDER_KINDS = (".csv", ".parquet", ".ndjson", ".jsonl", ".json", ".txt")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The files of the first of FOLDER_KINDS that is in the folder itself; else all files of the folders below, as ``(path, text)`` with their
    relative paths. An empty folder raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.substring_index(F.col("path"), f"{root}/", -1)
    kinds = {r.k for r in files.where(~relative.contains("/")).select(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("k")).distinct().limit(100).collect()}
    for kind in FOLDER_KINDS:
        if kind in kinds:
            return READERS[kind](spark, f"{path.rstrip('/')}/*{kind}")
    if files.limit(1).count() == 0:
        raise ValueError(f"nothing to read in {path!r}")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return whole.select(relative.alias("path"), text.alias("text"))


def read_bytes(spark: SparkSession, raw: bytes, kind: str) -> DataFrame:
    """A small file that is in memory already, by its suffix; CSV and TSV as strings, JSON lines as they are, else ``(data)``."""
    text = raw.decode("utf-8") if _is_utf8(raw) else raw.decode("latin-1")
    if kind in (".csv", ".tsv"):
        import csv

        rows = list(csv.reader(io.StringIO(text), delimiter="\t" if kind == ".tsv" else sniff_separator(text)))
        if kind == ".tsv":
            rows.insert(0, [f"column_{i}" for i in range(1, max(map(len, rows), default=1) + 1)])
        if not rows:
            return spark.createDataFrame([], "column_1 string")
        width = len(rows[0])
        return spark.createDataFrame([tuple((r + [None] * width)[:width]) for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0]))
    if kind in (".ndjson", ".jsonl"):
        lines = spark.createDataFrame([(x,) for x in text.splitlines() if x.strip()], "value string")
        schema = lines.select(F.schema_of_json(F.lit(lines.first()[0]))).first()[0] if lines.count() else "a string"
        return lines.select(F.from_json("value", schema).alias("v")).select("v.*")
    return spark.createDataFrame([(text,)], "data string")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line, text)``: the lines of each file, from 1. A file is read whole."""
    return read_text(spark, path).select("path", F.posexplode(F.split("text", "\r?\n")).alias("k", "text")).select("path", (F.col("k") + 1).alias("line"), "text").where(F.col("text") != "")


def lines_with(lines: DataFrame, needles: tuple[str, ...] = ("1970-01-01", "9999-12-31")) -> DataFrame:
    """The lines that hold one of the needles."""
    return lines.where(reduce(lambda a, b: a | b, (F.col("text").contains(n) for n in needles)))


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """``(path, line, v, error)``: each line by the schema, or the place and the text of one that is no JSON object."""
    v = F.from_json("text", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    got = lines.select("path", "line", v.alias("v"))
    return got.select("path", "line", F.col("v").dropFields("__bad").alias("v"), F.when(F.col("v.__bad").isNotNull(), F.concat_ws(":", "path", F.col("line").cast("string"), F.col("v.__bad"))).alias("error"))


def log_parts(lines: DataFrame, text: str, header: str = "#") -> DataFrame:
    """``lines`` with ``thread``, ``msisdn`` and ``message``: of JSON log records, of lines of four parts between bars, and ``_meta`` for headers, blank and
    other lines."""
    raw = F.col(text)
    ok = F.try_parse_json(raw).isNotNull() & F.ltrim(raw).startswith("{")
    of = lambda p: F.get_json_object(raw, p)
    bars = F.size(F.split(raw, r"\|")) >= 4
    name = F.regexp_extract(raw, r"Thread-\d+", 0)
    meta = raw.isNull() | (raw == "") | raw.startswith(header)
    task = F.regexp_extract(raw, r"\[([^\]]+)\]", 1)
    return lines.withColumns({
        "thread": F.when(meta, "_meta").when(ok, F.coalesce(of("$.record.thread.name"), F.lit("_meta"))).when(bars, F.when(name != "", name).otherwise("MainThread")).otherwise("_meta"),
        "msisdn": F.when(meta, None).when(ok, F.coalesce(F.nullif(of("$.record.extra.msisdn"), F.lit("")), of("$.record.extra.task_id"))).when(bars, F.when(task != "", task)),
        "message": F.when(ok & ~meta, F.rtrim(F.coalesce(of("$.text"), F.lit("")))).otherwise(raw),
    })


def save_cached(df: DataFrame, folder: str, key: str) -> str:
    """``df`` under a key in a folder of cached tables; gives its path. An action."""
    path = f"{folder.rstrip('/')}/{hashlib.md5(key.encode()).hexdigest()}"
    df.write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", 1_000_000).parquet(path)
    return path


def load_cached(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """The table that was saved under a key, or None."""
    path = f"{folder.rstrip('/')}/{hashlib.md5(key.encode()).hexdigest()}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if there else None


def _gated(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Small files that only the driver can read: a sheet as a table, YAML as ``(path, data)`` with the data as JSON."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if kind in (".yaml", ".yml"):
        import yaml

        return spark.createDataFrame([(path, json.dumps(yaml.safe_load(raw), default=str))], "path string, data string")
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(io.BytesIO(raw), dtype=str))


def write(df: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """Writes by suffix. An action. ``files``: so many files at most."""
    df = df.coalesce(files) if files else df
    w = df.write.mode(mode)
    kind = suffix(path)
    if kind in (".parquet", ".pq", ".parq"):
        w.option("compression", "zstd").parquet(path)
    elif kind == ".csv":
        w.option("header", True).csv(path)
    elif kind == ".tsv":
        w.option("header", True).option("sep", "\t").csv(path)
    elif kind in (".ndjson", ".jsonl"):
        w.json(path)
    elif kind == ".json":
        _write_documents(df, path, mode)
    elif kind in GATED:
        _write_small(df, path, kind)
    elif kind in (".txt", ".log"):
        w.text(path)
    elif kind == ".orc":
        w.orc(path)
    else:
        raise ValueError(f"no writer for {path!r}")


#: Rows that a file written by the driver holds at most.
MAX_SMALL = 1_000_000


def _write_documents(df: DataFrame, path: str, mode: str) -> None:
    """A JSON document, a list of objects, for each partition of ``df``; nulls are members too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = [x for b in batches for x in b.column(0).to_pylist()]
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(["[" + ",\n".join(lines) + "]"])], ["value"])

    rows = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(run, "value string").write.mode(mode).text(path)


def _write_small(df: DataFrame, path: str, kind: str) -> None:
    """A sheet or YAML, which only the driver can write; raises beyond MAX_SMALL rows, and where the library is missing."""
    rows = df.limit(MAX_SMALL + 1).toPandas()
    if len(rows) > MAX_SMALL:
        raise ValueError(f"more than {MAX_SMALL} rows in a file of the driver")
    target = path.split(":", 1)[1] if path.startswith("file:") else path
    if kind in (".yaml", ".yml"):
        import yaml

        with open(target, "w", encoding="utf-8") as f:
            yaml.safe_dump(json.loads(rows.to_json(orient="records", date_format="iso")), f, allow_unicode=True, sort_keys=False)
    else:
        rows.to_excel(target, index=False)


def write_triples_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.select("s", "p", "o").write.option("sep", "\t").option("header", header).csv(path)


def convert(spark: SparkSession, source: str, target: str) -> None:
    write(read(spark, source), target)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_triples(spark: SparkSession, path: str, columns: tuple[str, ...] = ("s", "p", "o")) -> DataFrame:
    """A table of triples; one that lacks a column raises."""
    df = read(spark, path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path!r} lacks {', '.join(missing)}")
    return df


def read_splits(spark: SparkSession, folder: str, names: tuple[str, ...] = ("train", "valid", "test"), prefer: str = "_optimized") -> dict[str, DataFrame]:
    """The Parquet splits that are in a folder; of a split that was optimised, that. None at all raises."""
    out = {}
    for name in names:
        for path in (f"{folder}/{name}{prefer}.parquet", f"{folder}/{name}.parquet"):
            if exists(spark, path):
                out[name] = read_triples(spark, path)
                break
    if not out:
        raise FileNotFoundError(f"no splits in {folder!r}")
    return out


def write_response(docs: DataFrame, doc_id: str, data: str, path: str) -> int:
    """The tables of responses as Parquet, a row each with its members as text; gives their number, and writes nothing where no response is
    tabular. An action."""
    from ..operators.triples import tabularize
    from ..storage import written

    rows = written(tabularize(docs, doc_id, data), "responses")
    n = rows.count()
    if n:
        write(rows, path)
    return n


def append_observations(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines, with the time at which they were written. An action."""
    rows.withColumn("observed_at", F.current_timestamp()).write.mode("append").json(path)


def save_rules(rules: DataFrame, folder: str) -> None:
    """Rules (rule, confidence, source): all of them, those of each source, and the counts by source, as JSON. An action."""
    rules.write.mode("overwrite").json(f"{folder}/combined")
    rules.write.mode("overwrite").partitionBy("source").json(f"{folder}/by_source")
    rules.groupBy("source").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").json(f"{folder}/counts")


def results(rows: DataFrame, details: str) -> DataFrame:
    """Result rows once per MSISDN (the first by request), a map of lists as text: ``k: a, b | k2: nenhum``."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(details)), lambda e: F.concat(e["key"], F.lit(": "), F.when(F.size(e["value"]) > 0, F.array_join(e["value"], ", ")).otherwise(F.lit("nenhum")))), " | ")
    return rows.withColumn(details, shown).groupBy("MSISDN").agg(*(F.min_by(c, "request").alias(c) for c in rows.columns if c != "MSISDN"))
