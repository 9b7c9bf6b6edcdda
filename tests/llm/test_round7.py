"""Extents of repeated strings around an anchor with many different surroundings."""

import numpy as np
import pytest

from parley.llm import repeats

SIZE, GRAM, SIDE = 60, 20, 40


def _grid(n):
    """Anchors that share 25 bytes before it with some others and 30 after it with some others: both together make 75, one alone 45 or 50."""
    rng = np.random.default_rng(3)
    noise = lambda k: rng.integers(97, 123, k, dtype=np.uint8).tobytes()
    gram, m = noise(GRAM), int(n ** 0.5) * 2
    before, after = [noise(25) for _ in range(m)], [noise(30) for _ in range(m)]
    pairs = rng.integers(m, size=(n, 2))
    bodies = [noise(SIDE - 25) + before[a] + gram + after[b] + noise(SIDE - 30) for a, b in pairs]
    return bodies, np.full(n, SIDE, np.int64)


def _plain(bodies, left):
    """Windows of SIZE bytes at the same place around the anchor, one by one."""
    places = {}
    for i, b in enumerate(bodies):
        for at in range(len(b) - SIZE + 1):
            places.setdefault((left[i] - at, b[at:at + SIZE]), set()).add(i)
    found = [[] for _ in bodies]
    for (off, _), owners in places.items():
        for i in owners if len(owners) > 1 else ():
            found[i].append(off)
    return [max(x, default=0) for x in found], [SIZE - min(x) if x else 0 for x in found]


def _extents(bodies, left):
    got = repeats.extents(np.zeros(len(bodies), np.int64), bodies, left, np.ones(len(bodies), np.int64), SIZE)
    return tuple(x.tolist() for x in got)


def test_anchors_of_a_group_are_not_compared_pair_by_pair(monkeypatch):
    compared, common = [0], repeats.Strings.common

    def counted(self, i, j):
        compared[0] += len(i)
        return common(self, i, j)

    monkeypatch.setattr(repeats.Strings, "common", counted)
    bodies, left = _grid(1200)
    got = _extents(bodies, left)
    assert got == _plain(bodies, left)
    assert 100 < np.count_nonzero(got[0]) < 1100
    assert compared[0] < 4 * len(bodies) * np.log2(len(bodies)) ** 2  # two merge sorts with searches; all pairs would be five times that


@pytest.mark.parametrize("same", [lambda x: np.zeros(len(x), np.uint64), lambda x: x % np.uint64(7)], ids=["all", "many"])
def test_equal_hashes_of_different_windows_claim_nothing(monkeypatch, same):
    bodies, left = _grid(150)
    bodies += [b[:-5] + b[-5:].upper() for b in bodies[:20]]
    left = np.full(len(bodies), SIDE, np.int64)
    monkeypatch.setattr(repeats, "mix", same)
    assert _extents(bodies, left) == _plain(bodies, left)
