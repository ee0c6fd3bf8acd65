"""What executors get runs where this package is not."""

import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from runloom.llm import event_runs, leakage, mojibake

LOAD = "import sys, pickle\ntry:\n    import runloom\n    sys.exit('the package is here')\nexcept ImportError:\n    pass\nf, x = pickle.load(sys.stdin.buffer)\nprint(sum(b.num_rows for b in f(iter([x]))) if hasattr(x, 'num_rows') else f(x))"


@pytest.mark.parametrize("name", ["judge", "stretches", "index"])
def test_runs_elsewhere(name, tmp_path):
    if name == "judge":
        what = (mojibake._judge, pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "A fun��o ignora"}, {"doc_id": 2, "text": "好 plain"}]))
    elif name == "stretches":
        rows = [{"run": "r", "step": i, "call": i, "tool": "t", "action": "a", "status": "ok", "s": None, "e": None, "part": 0} for i in range(4)]
        what = (event_runs._stretches(0.95, None), pa.RecordBatch.from_pylist(rows))
    else:
        import numpy as np

        index = leakage.kernel.SeedIndex.build([1], [np.arange(40, dtype=np.uint64)], np.empty(0, np.uint64))
        kernel = leakage.kernel
        what = (lambda arrays: len(kernel.SeedIndex(*arrays).h) > 0, index.arrays())
    done = subprocess.run([sys.executable, "-c", LOAD], input=cloudpickle.dumps(what), capture_output=True, cwd=tmp_path, env={"PATH": "/usr/bin"})
    assert done.returncode == 0, done.stderr.decode()
    assert done.stdout.decode().split()[-1] == {"judge": "1", "stretches": "1", "index": "True"}[name]
