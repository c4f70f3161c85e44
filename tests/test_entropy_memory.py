"""Window entropies of a long text: the same as those of all windows at once, in bounded memory."""

import tracemalloc

import numpy as np

from agentguard.functions import entropy


def test_memory_does_not_grow_with_a_text():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 90, 4_000_000, dtype=np.uint8).tobytes()
    tracemalloc.start()
    found = np.concatenate([e for _, e in entropy.entropy_blocks(data, 100, 50)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == (len(data) - 100) // 50 + 1 and peak < 40_000_000
    for k in (0, 1, 1023, 1024, 1025, len(found) - 1):
        counts = np.bincount(np.frombuffer(data[50 * k:50 * k + 100], np.uint8), minlength=256)
        p = counts[counts > 0] / 100
        assert abs(found[k] + (p * np.log2(p)).sum()) < 1e-9
