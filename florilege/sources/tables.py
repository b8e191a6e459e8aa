"""Reading tables of several formats with flexible columns, and writing bundles with a manifest."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions.text import squish
from florilege.operators.quality import table_signature

#: Longest text of a cell in exported CSV tables.
CELL_LIMIT = 30_000


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by the ending of its path: csv, tsv, json, jsonl or ndjson (also .gz), orc, else Parquet.

    Text tables are read with the given schema, or with every column as text: no pass over the data
    to infer types.
    """
    ending = re.sub(r"\.gz$", "", path.lower()).rsplit(".", 1)[-1]
    if ending in ("csv", "tsv"):
        reader = spark.read.option("header", True).option("sep", "\t" if ending == "tsv" else ",").option("multiLine", True).option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(path)
    if ending in ("json", "jsonl", "ndjson"):
        reader = spark.read.option("multiLine", ending == "json")
        return (reader.schema(schema) if schema else reader.option("primitivesAsString", True)).json(path)
    if ending == "orc":
        return spark.read.orc(path)
    return spark.read.parquet(path)


def snake_names(df: DataFrame) -> DataFrame:
    """Column names in lower snake case; names that clash after that get a number."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        name = re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_") or "column"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*out)


def detect_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that the table has, case ignored."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def with_columns(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns under standard names by ordered candidate names; missing ones are null."""
    return df.select(*[(F.col(f"`{found}`") if (found := detect_column(df, names)) else F.lit(None).cast("string")).alias(name) for name, names in wanted.items()])


def export_ready(df: DataFrame, limit: int = CELL_LIMIT) -> DataFrame:
    """Texts without control white space and cut to what a cell may hold."""
    return df.select(*[F.substring(squish(F.col(f"`{c}`")), 1, limit).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def write_bundle(tables: dict[str, DataFrame], path: str, formats: str = "parquet") -> DataFrame:
    """Write named tables under a folder and a manifest (table, rows, columns, signature) beside them."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        writer = (export_ready(df) if formats == "csv" else df).write.mode("overwrite")
        if formats == "csv":
            writer.option("header", True).option("escape", '"').csv(f"{path}/{name}")
        else:
            writer.parquet(f"{path}/{name}")
        facts = table_signature(df).first()
        rows.append((name, facts["n_rows"], len(df.columns), str(facts["signature"]), json.dumps(df.columns)))
    manifest = spark.createDataFrame(rows, "table_name string, n_rows bigint, n_columns int, signature string, columns string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def validate_bundle(spark: SparkSession, path: str, required: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_name, check, status) of a Parquet bundle: row counts, signatures, required columns."""
    rows = []
    for m in spark.read.json(f"{path}/manifest").collect():  # one row per table of the bundle
        try:
            df = spark.read.parquet(f"{path}/{m['table_name']}")
        except Exception:  # noqa: BLE001 - a missing table is a finding
            rows.append((m["table_name"], "readable", "fail"))
            continue
        facts = table_signature(df).first()
        rows.append((m["table_name"], "row_count", "pass" if facts["n_rows"] == m["n_rows"] else "fail"))
        rows.append((m["table_name"], "signature", "pass" if str(facts["signature"]) == m["signature"] else "fail"))
        lacking = [c for c in (required or {}).get(m["table_name"], []) if c not in df.columns]
        rows.append((m["table_name"], "required_columns", "fail" if lacking else "pass"))
    return spark.createDataFrame(rows, "table_name string, check string, status string")


def read_many(spark: SparkSession, paths: list[str], wanted: dict[str, list[str]]) -> DataFrame:
    """Tables of several formats under standard column names (see with_columns), one under the other, repeated rows once, with the file they come from."""
    out = None
    for path in paths:
        part = with_columns(read_table(spark, path), wanted).withColumn("source_file", F.lit(path.rsplit("/", 1)[-1]))
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(list(wanted))


def write_counted(df: DataFrame, path: str, expected: int | None = None, max_records: int = 5_000_000, formats: str = "parquet") -> int:
    """Write a table in files of at most ``max_records`` rows and return how many rows are there.

    Spark's commit protocol shows the files only when all are complete. If another number is expected, the
    written table is removed again and ValueError says so.
    """
    from florilege.session import hadoop_path

    writer = df.write.mode("error").option("maxRecordsPerFile", max_records)
    if formats == "csv":
        writer.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
        written = df.sparkSession.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).count()
    else:
        writer.parquet(path)
        written = df.sparkSession.read.parquet(path).count()
    if expected is not None and written != expected:
        fs, target = hadoop_path(df.sparkSession, path)
        fs.delete(target, True)
        raise ValueError(f"{written} rows written, {expected} expected")
    return written


def cached_files(spark: SparkSession, path: str) -> DataFrame:
    """(provider, file, n_bytes, modified_at) of the files under a cache folder; the provider is the first folder below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    inside = F.element_at(F.split("path", re.escape("/" + path.rstrip("/").rsplit("/", 1)[-1] + "/")), -1)
    parts = F.split(inside, "/")
    return files.select(F.when(F.size(parts) > 1, F.get(parts, 0)).otherwise("(none)").alias("provider"), inside.alias("file"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified_at"))


def cache_summary(files: DataFrame) -> DataFrame:
    """Per provider: files, bytes, and the times of the oldest and the newest."""
    return files.groupBy("provider").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.min("modified_at").alias("oldest_at"), F.max("modified_at").alias("newest_at"))
