"""Sources and sinks: CSV in three readings, ragged CSV, JSON documents, hierarchies, encodings, releases."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Sequence
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_suppressed

_NEVER = "\u0000"


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; headers and cells trimmed, empty cells stay empty strings."""
    raw = spark.read.csv(path, header=True, inferSchema=False, nullValue=_NEVER, emptyValue="")
    return raw.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in raw.columns])


def read_csv_missing(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; empty cells become the text ``nan``."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("nan")).alias(c) for c in raw.columns])


def read_csv_typed(spark: SparkSession, path: str) -> DataFrame:
    """A column is double (or long) if every non-empty cell is one, else string: one pass of checks over all cells."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    checks = []
    for i, c in enumerate(raw.columns):
        cell = F.col(f"`{c}`")
        checks += [F.bool_and(cell.isNull() | F.expr(f"try_cast(`{c}` as {kind})").isNotNull()).alias(f"{kind}{i}") for kind in ("bigint", "double")]
        checks.append(F.count(cell).alias(f"n{i}"))
    found = raw.agg(*checks).first() if checks else None
    kinds = ["bigint" if found[f"bigint{i}"] and found[f"n{i}"] else "double" if found[f"double{i}"] and found[f"n{i}"] else None for i in range(len(raw.columns))]
    return raw.select(*[F.expr(f"try_cast(`{c}` as {k})").alias(c) if k else F.col(f"`{c}`") for c, k in zip(raw.columns, kinds, strict=True)])


def header_of(spark: SparkSession, path: str) -> list[str]:
    return [c.strip() for c in spark.read.csv(path, header=True, inferSchema=False).columns]


def read_csv_ragged(spark: SparkSession, path: str) -> DataFrame:
    """The header's columns only; short rows are padded with null, long ones cut."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header_of(spark, path)])
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", enforceSchema=True)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Lists are joined by ``|``; maps and structs become JSON."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
        elif isinstance(f.dataType, (T.MapType, T.StructType)):
            c = F.to_json(c)
        columns.append(c.alias(f.name))
    df.select(*columns).write.csv(path, header=True, mode=mode, emptyValue="")


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet summary; new columns are allowed."""
    df.write.mode("append").parquet(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were appended, with the columns of all of them."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_hierarchy(spark: SparkSession, path: str, attr: str) -> DataFrame:
    """(attr, leaf, levels) of a header-less, maybe ragged CSV: cells trimmed, empty ones dropped."""
    cells = F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = spark.read.text(path).select(cells.alias("levels")).filter(F.size("levels") > 0)
    return rows.select(F.lit(attr).alias("attr"), F.col("levels")[0].alias("leaf"), "levels")


def hierarchy_files(folder: str, attrs: Iterable[str]) -> dict[str, str]:
    """A hierarchy file is named as its attribute."""
    return {a: f"{folder.rstrip('/')}/{a}.csv" for a in attrs}


def read_encodings(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet encodings of several parties under one another; ``side`` is the party's number; ids stay as they are, unique within a party."""
    parties = [spark.read.parquet(p).withColumn("side", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parties)


def drop_fully_suppressed(df: DataFrame, qis: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with any quasi-identifier left, and one row (before, dropped, after)."""
    gone = reduce(lambda a, b: a & b, [F.trim(F.col(f"`{q}`").cast("string")) == "*" for q in qis]) if qis else F.lit(False)
    gone = F.coalesce(gone, F.lit(False))
    counts = df.agg(F.count("*").alias("n_before"), F.count_if(gone).alias("n_dropped"), F.count_if(~gone).alias("n_after"))
    return df.filter(~gone), counts


def public_release(df: DataFrame, private: Sequence[str]) -> DataFrame:
    return df.drop(*private)


def suppressed_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns in which every value is suppressed; none in an empty table."""
    if not columns:
        return []
    r = df.agg(*[F.bool_and(is_suppressed(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if r[f"c{i}"]]


def to_jsonable(x: Any) -> Any:
    """Plain JSON values of nested Python, NumPy and Spark values; what has no number becomes null."""
    if isinstance(x, dict):
        return {str(k): to_jsonable(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return to_jsonable(x.asDict(recursive=True))
    if isinstance(x, (list, tuple, set, frozenset)):
        return [to_jsonable(v) for v in (sorted(x, key=str) if isinstance(x, (set, frozenset)) else x)]
    if hasattr(x, "tolist"):
        return to_jsonable(x.tolist())
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
        return None
    return x if x is None or isinstance(x, (str, int, float, bool)) else str(x)


def save_json(x: Any, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(to_jsonable(x), f, ensure_ascii=False, indent=2)


def load_json(path: str) -> Any:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def ratio(limit: float) -> float:
    """A suppression limit as a ratio: values above 1 are percent."""
    return limit / 100 if limit > 1 else float(limit)
