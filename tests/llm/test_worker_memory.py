"""What a Python worker holds between tasks, and the batches that it gets."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from gridwise.llm import common

_KEPT = """
import re, sys
import numpy as np, pandas, pyarrow as pa
from gridwise.llm.jaccard_join import _deal

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

def batches(n):
    rng = np.random.default_rng(1)
    for k in range(n):
        texts = [" ".join(map(str, rng.integers(0, 1 << 40, 200))) for _ in range(1_500)]
        yield pa.RecordBatch.from_pydict({"row_id": pa.array(np.arange(len(texts)) + k * len(texts)), "text": pa.array(texts)})

for _ in _deal(8)(batches(1)):
    pass
before = held()
for _ in _deal(8)(batches(6)):
    pass
print(before, held())
"""


@pytest.mark.skipif(sys.platform != "linux", reason="memory is read from /proc")
def test_a_task_that_ended_keeps_no_free_memory():
    said = subprocess.run([sys.executable, "-c", _KEPT], capture_output=True, text=True, timeout=200, env=os.environ | {"PYTHONPATH": ":".join(sys.path)})
    assert said.returncode == 0, said.stderr
    before, after = map(int, said.stdout.split())
    assert before < 110 and after < 110, (before, after)


def test_python_stages_write_in_limited_batches(spark, tmp_path, monkeypatch):
    """The rows of quality and leaks reach Python workers under stage()'s limit, whoever reads the stage's result."""
    limits = []
    write = common.stage

    def noted(df, tag):
        limits.append(tag)
        return write(df, tag)

    monkeypatch.setattr(corpus_pipeline, "stage", noted)
    docs = corpus_pipeline.read(spark, "/root/testdata/sf0.001", "documents")
    for name, stage_of in corpus_pipeline.STAGES:
        if name in ("quality", "leaks"):
            rows = stage_of(spark, docs, "/root/testdata/sf0.001")
            assert limits == [f"pipeline-{name}"]
            assert "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()
            limits.clear()
