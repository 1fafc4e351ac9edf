import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from test_text_ops import docs  # noqa: E402

from weftline.llm import ngram_join  # noqa: E402


def family(r, base, n, most):
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randrange(most + 1)):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("most", [1, 5])
def test_large_groups_in_chunks(spark, monkeypatch, most):
    """Hubs with many chunks: near copies of one text, and texts that share a passage but are no copies, lose no link."""
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 12)
    r = random.Random(most)
    base = [f"w{i}" for i in range(120)]
    texts = family(r, base, 110, most)
    texts += [" ".join([*base[:60], *(f"y{k}_{i}" for i in range(20 + k % 40))]) for k in range(60)]
    texts += [t + " tail end" for t in texts[:30]]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x.doc_id: x.component_id for x in ngram_join.assign(docs(spark, rows)).collect()}
    assert got == dict(zip(range(len(rows)), brute.components(rows), strict=True))


def test_connect_with_some_asking():
    import numpy as np

    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 2**62, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[r.permutation(60)[: 60 - int(k % 7)]], r.integers(0, 2**62, int(k % 5)).astype(np.uint64)))) for k in range(40)]
    asks = r.random(40) < 0.4
    links, root = ngram_join.connect(sets, asks)
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    assert all(linked(i, j) for i, j in links)
    assert all(root[i] == root[j] for i in np.flatnonzero(asks) for j in range(40) if linked(i, j))
