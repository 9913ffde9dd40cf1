"""Stored states of a training, so that one that was broken off can go on.

A state is one folder per finished epoch: weights, optimizer moments, losses and counters as (name, part, shape, values)
rows. A folder counts once it is written in full, and an older one goes only after a newer one is there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from labelpick.session import check_model_size, delete_path, list_folder

SCHEMA = "name string, part string, shape array<int>, values array<double>"


@dataclass
class Resume:
    """Where the state of one training lives. ``keep`` is how many epochs back states stay."""
    spark: SparkSession
    path: str
    keep: int = 2

    def _epochs(self) -> list[int]:
        """Numbers of the epochs whose state is whole."""
        names = [n for n in list_folder(self.spark, self.path) if n.startswith("epoch-") and n[6:].isdigit()]
        return sorted(int(n[6:]) for n in names if "_SUCCESS" in list_folder(self.spark, f"{self.path}/{n}"))

    def save(self, state: dict) -> None:
        """Store arrays, lists of arrays and dicts of arrays, under the number of losses so far."""
        rows = []
        for name, value in state.items():
            parts = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else [("", value)]
            for part, array in parts:
                array = np.asarray(array, float)
                rows.append((name, str(part), [int(s) for s in array.shape], array.ravel().tolist()))
        check_model_size(sum(len(r[3]) for r in rows), "state of a training")
        epoch = len(state["losses"])
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/epoch-{epoch}")
        for old in self._epochs()[:-self.keep]:
            delete_path(self.spark, f"{self.path}/epoch-{old}")

    def load(self) -> dict | None:
        """The newest whole state, or None."""
        epochs = self._epochs()
        if not epochs:
            return None
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/epoch-{epochs[-1]}").collect()
        found: dict[str, dict[str, np.ndarray]] = {}
        for r in rows:
            found.setdefault(r["name"], {})[r["part"]] = np.array(r["values"]).reshape(r["shape"])
        lists = {name: [found[name][str(i)] for i in range(len(found.get(name, ())))]
                 for name in ("params", "best", "mean", "square")}
        single = {name: found[name][""] for name in ("losses", "checks", "counters")}
        return lists | single | {"extra": found.get("extra", {})}
