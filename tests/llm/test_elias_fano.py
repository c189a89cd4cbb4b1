import numpy as np
import pytest

from lodestone.llm.elias_fano import EliasFano, Trie


@pytest.mark.parametrize("n,u", [(0, 1), (1, 1), (1, 10**12), (500, 3), (3000, 10**9), (4000, 4100), (100, 2**55)])
def test_sequence(n, u):
    rng = np.random.default_rng(n + u % 97)
    v = np.sort(rng.integers(0, u, n).astype(np.uint64))
    ef = EliasFano.build(v)
    assert ef.access(np.arange(n)).tolist() == v.tolist()
    x = np.concatenate([v, rng.integers(0, u + 50, 300).astype(np.uint64), v + np.uint64(1)])
    at, equal = ef.successor(x)
    assert at.tolist() == np.searchsorted(v, x).tolist()
    assert equal.tolist() == np.isin(x, v).tolist()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_trie(order, tmp_path):
    rng = np.random.default_rng(order)
    grams = np.unique(np.minimum(rng.geometric(0.02, (5000, order)), 400), axis=0)
    logs = -rng.random(len(grams)) * 6
    path = tmp_path / "trie"
    path.write_bytes(Trie.build(grams, logs).to_bytes())
    trie = Trie.open(str(path))
    assert trie.find(grams).tolist() == list(range(len(grams)))
    other = rng.integers(0, 500, (4000, order))
    known = {tuple(g): i for i, g in enumerate(grams.tolist())}
    assert trie.find(other).tolist() == [known.get(tuple(g), -1) for g in other.tolist()]
    assert np.abs(trie.table[trie.codes] - logs).max() < 6 / 254
    empty = Trie.from_buffer(Trie.build(grams[:0], logs[:0]).to_bytes())
    assert (empty.find(other) == -1).all()
