"""Golden question sets from YAML files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import ValidationError
from ..schemas import GOLDEN

FIELDS = ("id", "question", "category", "gold_route", "gold_chunk_ids", "gold_answer", "must_refuse")


def load_golden(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.yaml of a folder in name order, each a list of maps; a null gold list is empty.  Adds pos."""
    import yaml

    root = Path(folder)
    if not root.is_dir():
        raise ValidationError(f"no golden folder {folder}")
    files = sorted(root.glob("*.yaml"))
    if not files:
        raise ValidationError(f"no golden files in {folder}")
    rows = []
    for file in files:
        items = yaml.safe_load(file.read_text()) or []
        if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
            raise ValidationError(f"{file.name} is not a list of maps")
        for item in items:
            if missing := [f for f in ("id", "question", "category", "gold_route") if f not in item]:
                raise ValidationError(f"{file.name}: {item.get('id')} lacks {missing}")
            rows.append((str(item["id"]), item["question"], item["category"], item["gold_route"], [str(c) for c in item.get("gold_chunk_ids") or []], item.get("gold_answer"), bool(item.get("must_refuse", False)), len(rows)))
    return spark.createDataFrame(rows, GOLDEN + ", pos int")


def subset(golden: DataFrame, n: int | None) -> DataFrame:
    """The first n items in file order; all without n."""
    return golden if n is None else golden.filter(golden["pos"] < n)
