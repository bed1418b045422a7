"""A worker that has ended its task holds little."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import re, sys
from pathlib import Path
import pyarrow as pa
from pyspark.sql import types
from sweepline.llm import common

types._parse_datatype_string = lambda schema: types.StructType([types.StructField("n", types.LongType())])  # asks the JVM else

class Table:  # stands for a DataFrame: calls the task as a worker does
    def mapInArrow(self, run, schema):
        return run(iter([pa.record_batch({"n": [1]})]))

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) // 1024

last, most = [], 0
def task(batches):
    global most
    for batch in batches:
        own = [bytes(2000) for _ in range(150_000)]  # 300 MB in pieces that malloc keeps
        most = held()
        last.append(own[-1])
        yield {"n": [len(own)]}

before = held()
assert [b.column(0).to_pylist() for b in getattr(common, sys.argv[1])(Table(), task, "n long")] == [[150_000]]
print(most - before, held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
@pytest.mark.parametrize("name", ["map_arrow", "map_batches"])
def test_memory_goes_back_after_a_task(name):
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", CODE, name], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    most, after = map(int, done.stdout.split())
    assert most > 250
    assert after < 60
