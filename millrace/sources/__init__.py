"""Sources and sinks."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import file_states


def read_json_lines(spark: SparkSession, path: str, schema: str, fail_fast: bool = False) -> DataFrame:
    """JSON lines by an explicit schema; compressed files by their extension. Bad lines have their text in _corrupt_record, or fail the read."""
    reader = spark.read.option("mode", "FAILFAST" if fail_fast else "PERMISSIVE")
    return reader.schema(schema if fail_fast else f"{schema}, _corrupt_record STRING").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet, only the named columns."""
    return spark.read.parquet(path).select(*columns)


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header. one_file is for small results."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_single_json(df: DataFrame, path: str, most: int = 100_000) -> int:
    """All rows as one minified JSON array in a local file, safe inside a script element, without NaN. Refuses more than most rows."""
    rows = df.select(F.to_json(F.struct("*")).alias("j")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")

    def clean(x):
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list) else None if x in ("NaN", "Infinity", "-Infinity") else x

    text = json.dumps([clean(json.loads(r["j"])) for r in rows], separators=(",", ":"), ensure_ascii=False, allow_nan=False).replace("</", "<\\/")
    Path(path).write_text(text, encoding="utf-8")
    return len(rows)


def write_report(tables: dict[str, DataFrame], path: str, most: int = 200) -> None:
    """Small result tables as one markdown file; each is cut, visibly, after most rows."""
    parts = []
    for title, df in tables.items():
        rows = df.limit(most + 1).collect()
        lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:most]]
        parts.append("\n".join(lines + ["", f"More than {most} rows."] * (len(rows) > most)))
    Path(path).write_text("\n\n".join(parts) + "\n", encoding="utf-8")


def cached_vectors(spark: SparkSession, path: str, names: Sequence[str], inputs: Sequence[str], build: Callable[[], np.ndarray]) -> np.ndarray:
    """One vector a name, in order: those stored under path if they are of exactly these names in this order and of these inputs, else built and stored there.

    names is a bounded vocabulary. The inputs' files, sizes and times are kept beside the vectors, so other data of the same vocabulary isn't taken for these.
    """
    state = repr((list(names), file_states(spark, inputs)))
    at = f"{path}/{hashlib.md5(state.encode()).hexdigest()}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows = spark.read.parquet(at).orderBy("place").collect()
        if [r["name"] for r in rows] == list(names):
            return np.array([r["vector"] for r in rows], float).reshape(len(rows), -1)
    made = build()
    spark.createDataFrame([(i, n, [float(x) for x in v]) for i, (n, v) in enumerate(zip(names, made, strict=True))], "place int, name string, vector array<double>").write.mode("overwrite").parquet(at)
    return made


def manifest(spark: SparkSession, paths: dict[str, str]) -> list[tuple[str, int, int]]:
    """Name, rows and columns of parquet artefacts."""
    out = []
    for name, path in paths.items():
        df = spark.read.parquet(path)
        out.append((name, df.count(), len(df.columns)))
    return out
