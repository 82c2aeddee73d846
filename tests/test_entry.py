"""The entry without the libraries that only the training-data queries need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["regex", "zstandard", "xxhash"])
def test_queries_without_an_optional_library(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op')])"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split(maxsplit=1)
    assert int(out[0]) > 150 and out[1].strip() == "[]"
