"""Random access to token shards expands what is asked for, and nothing else."""

import numpy as np
import pytest

from clustrum.llm import token_files


@pytest.fixture(scope="module")
def shard():
    rng = np.random.default_rng(6)
    phrases = [rng.integers(0, 900, rng.integers(2, 9)) for _ in range(12)]
    parts = [np.r_[np.concatenate([phrases[j] for j in rng.integers(0, 12, rng.integers(0, 40))] or [np.zeros(0, np.int64)]), 0] for _ in range(60)]
    ids, ends = np.concatenate(parts).astype(np.uint16), np.cumsum([len(p) for p in parts])
    return token_files.Shard(token_files.pack(list(range(60)), ids, ends, 1000)), parts, ids


def test_documents_and_ranges(shard):
    found, parts, ids = shard
    assert len(found.rules) > 5
    assert all((found.document(i) == p).all() for i, p in enumerate(parts))
    rng = np.random.default_rng(1)
    for a, b in [(0, 0), (0, 1), (0, len(ids)), (len(ids) - 1, len(ids)), (len(ids), len(ids) + 5), (5, 2), *np.sort(rng.integers(0, len(ids) + 1, (300, 2)), 1).tolist()]:
        assert found.tokens(a, b).tolist() == ids[a:b].tolist(), (a, b)
    assert found.pool is None, "no table of all expansions was made"
    assert [d.tolist() for _, d in found.documents()] == [p.tolist() for p in parts]


def test_few_reads_few_rules(shard):
    found, parts, _ = shard
    read = set()

    class Watched(np.ndarray):
        def __getitem__(self, i):
            read.add(int(i))
            return np.asarray(self).__getitem__(i)

    rules, found.rules = found.rules, found.rules.view(Watched)
    try:
        shortest = min(range(60), key=lambda i: len(parts[i]))
        found.document(shortest)
        assert len(read) <= len(parts[shortest]) < len(rules)
    finally:
        found.rules = rules
