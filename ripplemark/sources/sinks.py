"""Results to JSON and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, most: int | None = None) -> list[dict]:
    """Rows as plain dicts, in order: for a report's few rows."""
    return [r.asDict(recursive=True) for r in (df.limit(most) if most else df).collect()]


def as_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    as_json_lines(df).write.mode("overwrite").text(path)


def write_text(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def to_json(payload: dict) -> str:
    return json.dumps(payload, default=str, ensure_ascii=False, indent=2)
