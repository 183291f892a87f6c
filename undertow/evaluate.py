"""python -m undertow.evaluate MODEL ROWS: scores the published model on labelled rows (text, label) and prints JSON."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from undertow.operators.labels import CurrentModel, class_counts, enough, evaluated, newest_labelled
from undertow.session import session, ship


def evaluation(spark: SparkSession, model: str, rows: str) -> dict:
    """Metrics of the model on the rows that a retraining cycle would fetch now, and whether these are enough to tell."""
    fetched = newest_labelled(spark.read.parquet(rows))
    counts = {r["label"]: r["n"] for r in class_counts(fetched).collect()}
    held = CurrentModel(spark, model)
    weights = held.get()
    if weights is None:
        return {"version": None, "counts": counts}
    return {"version": held.version, "counts": counts, "enough": enough(counts)} | evaluated(fetched, weights)


if __name__ == "__main__":
    print(json.dumps(evaluation(ship(session("evaluate")), *sys.argv[1:3])))
