import os
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from oreweave.llm import jaccard, langid, packed


def traced(f):
    """What ``f`` gives, and the bytes it held at most."""
    tracemalloc.start()
    out = f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_words_held_at_once():
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(40_000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(1500)]
    field = langid.train(texts[:4], ["a", "b", "c", "d"], epochs=1)
    slices = packed.slices(pa.array(texts), limit=getattr(langid, "BYTES", packed.SLICE), lower=True)
    tracemalloc.start()
    for _, _, p in slices:
        field.shares(p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000


def _texts(n, words=200):
    rng = np.random.default_rng(2)
    known = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(20_000)]
    return [" ".join(rng.choice(known, words)) for _ in range(n)]


def test_training_held_at_once():
    texts = _texts(1200)
    _, peak = traced(lambda: langid.train(texts, ["a", "b", "c", "d"] * 300, epochs=1))
    assert peak < 120_000_000


def test_sets_held_at_once():
    texts = [None, "", *_texts(2000), "short text", None]
    column = pa.array(texts)
    runs, peak = traced(lambda: list(jaccard.sets_in_runs(column, 5)))
    assert peak < 50_000_000
    # the runs are those that whole slices made, and hold the same sets
    whole = [(i, j, *jaccard.sets_of(p, 5)) for i, j, p in packed.slices(column, lower=True)]
    assert [j for _, j, _, _ in runs][-1] == len(texts) and [i for i, _, _, _ in runs] == [0, *[j for _, j, _, _ in runs][:-1]]
    assert np.array_equal(np.concatenate([i + d for i, _, d, _ in runs]), np.concatenate([i + d for i, _, d, _ in whole]))
    assert np.array_equal(np.concatenate([g for *_, g in runs]), np.concatenate([g for *_, g in whole]))
    assert len(runs) <= len(whole) + 1
    assert list(jaccard.sets_in_runs(pa.array([], pa.string()), 5)) == []


def test_freed_memory_goes_back():
    """Many small pieces below one that stays are free, but the system's only after a trim."""
    code = """
import re
from pathlib import Path
from oreweave.llm import packed
mb = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024
held = [bytes(2000) for _ in range(50_000)]
last = bytes(2000)
held = None
before = mb()
packed.trim()
print(before - mb())
"""
    out = subprocess.run([sys.executable, "-c", code.replace("\\\\", "\\")], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert float(out.stdout) > 50
