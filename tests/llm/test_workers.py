"""Executors need no copy of the package: task functions and broadcasts travel with plain values."""

import os
import pathlib
import subprocess
import sys
import textwrap

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[2]
NAMES = ["op3_line_dedup", "op4_jaccard_join", "op6_topk", "op7_decontaminate", "op8_toxicity", "op9_secrets",
         "op11_fingerprints", "op12_resample", "op13_manifest", "op5_token_counts", "op10_bpe", "seed_parallel",
         "row_density_small_blocks", "supervised_steps_2"]

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import os
os.environ.pop("PYTHONPATH", None)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

def probe(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        found = importlib.util.find_spec("labelpick") is not None
        yield pa.RecordBatch.from_arrays([pa.array([found])], ["found"])

assert not spark.range(1).mapInArrow(probe, "found boolean").first()[0], "workers can import the package"
import __spark_entry__ as entry
for name in {names!r}:
    try:
        entry.queries()[name](spark, "/root/testdata/sf0.001").count()
        print("ok", name, flush=True)
    except Exception as error:
        print("failed", name, str(error)[-600:], flush=True)
"""


def test_queries_run_on_workers_without_the_package(tmp_path):
    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    script = textwrap.dedent(SCRIPT.format(root=str(ROOT), names=NAMES))
    (tmp_path / "run.py").write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    said = done.stdout.splitlines()
    assert [line for line in said if line.startswith("failed")] == [] and len(said) == len(NAMES), done.stderr[-2000:]
