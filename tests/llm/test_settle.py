"""What a task of op 4 holds while it settles its buckets."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from glossarium.llm import substring_dedup


def _sent(buckets):
    """What tasks send of 300 texts of random words, some of which begin with 120 words of another."""
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 5000, 400)) for _ in range(300)]
    texts = [" ".join(texts[k - 1].split()[:120] + t.split()) if k % 7 == 3 else t for k, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts), pa.array([0] * 300, pa.int64())], ["doc", "text", "version"])
    none = SimpleNamespace(value=np.zeros(0, np.uint64))
    return [b for k in range(0, 300, 100) for b in substring_dedup._send(50, 10, buckets, none)(iter([batch.slice(k, 100)]))]


def _settled(batches):
    """The ranges found, and the most bytes held meanwhile."""
    tracemalloc.start()
    try:
        rows = {row for b in substring_dedup._settle(50)(iter(batches)) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        return rows, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_buckets_are_settled_one_after_the_other():
    sent = _sent(12)
    one = [[b for b in sent if b.column(0)[0].as_py() == k] for k in range(12)]
    _settled(one[0])  # tables that hashing keeps
    alone = [_settled(part) for part in one]
    rows, most = _settled(sent)
    assert rows and rows == set().union(*(x for x, _ in alone))
    assert most < 3 * max(x for _, x in alone)
