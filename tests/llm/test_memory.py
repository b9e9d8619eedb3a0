"""Python workers give back what a task has used."""

import ctypes
import re
from pathlib import Path

import pyarrow as pa
import pytest

from logtide.llm.common import releasing


def _held_mb():
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def _task(batches):
    sizes = 200 + 16 * 64
    known = [ctypes.create_string_buffer(sizes) for _ in range(150_000)]
    for buffer in known:
        buffer[0] = b"x"
    pin.append(ctypes.create_string_buffer(sizes))  # at the top of the heap
    yield from batches


pin = []


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="not glibc")
def test_memory_is_given_back_after_a_task():
    batch = pa.record_batch({"a": [1]})
    before = _held_mb()
    assert list(releasing(_task)(iter([batch]))) == [batch]
    after = _held_mb()
    pin.clear()
    kept = list(_task(iter([batch])))
    assert kept == [batch] and after - before < 60 < _held_mb() - before
