"""The features, the trees and the calibration against plain versions."""

import random
import re

import numpy as np

from weftline.llm import toxicity


def plain_features(text, lexicon):
    words, n_near = re.findall(r"[^\W\d_]+", text.lower()), 0
    hits = [lexicon.words[w] for w in words if w in lexicon.words]
    stems = [lexicon.stems[w[:4]] for w in words if len(w) > 4 and w[:4] in lexicon.stems]
    for i, w in enumerate(words):
        if w in lexicon.words and any(words[j] in toxicity.SECOND_PERSON for j in range(max(0, i - 5), min(len(words), i + 6))):
            n_near += 1
    raw, n = text.encode("utf-8", "replace"), len(words) or 1
    capital = lambda b: 65 <= b <= 90
    letter = lambda b: capital(b) or 97 <= b <= 122 or b >= 128
    symbol = lambda b: 33 <= b <= 126 and not letter(b)
    mixed = sum(letter(raw[i - 1]) and symbol(raw[i]) and letter(raw[i + 1]) for i in range(1, len(raw) - 1))
    size = max(1, len(raw))
    return [len(hits) / n, sum(hits) / n, max(hits, default=0.0), len(stems) / n, sum(stems) / n, max(stems, default=0.0), n_near / n, sum(map(capital, raw)) / size, sum(map(symbol, raw)) / size, mixed / n]


def test_features_against_plain_python():
    r = random.Random(1)
    lexicon = toxicity.Lexicon({"bad": 1.5, "idiot": 2.0, "você": 1.0}, {"hate": 1.2, "idio": 0.7})
    bits = ["bad ", "IDIOT", " you ", "h@te", "hateful ", "b.a.d ", "é", "word ", "123 ", "!!", " du ", "você ", "\n", "_x_ "]
    for text in ["", " ", "a", *("".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(300))]:
        assert np.allclose(toxicity.features(text, lexicon), plain_features(text, lexicon)), text


def test_first_split_against_every_cut():
    """The root of the first tree is the split of the highest gain among all features and cuts."""
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(200, 4)), 1)
    y = (x[:, 2] + 0.4 * r.normal(size=200) > 0.3).astype(float)
    model = toxicity.fit_trees(x, y)
    feature, cut, _ = model.nodes[0]
    p = 1 / (1 + np.exp(-model.start))
    grad, hess = p - y, np.full(200, p * (1 - p))
    gain = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1) + grad[~m].sum() ** 2 / (hess[~m].sum() + 1)
    tried = {(j, c): gain(x[:, j] <= c) for j in range(4) for c in np.unique(x[:, j])[:-1]}
    own = gain(x[:, feature[0]] <= cut[0])
    assert own >= 0.97 * max(tried.values())  # cuts are quantiles, so the very best one may lie between two of them
    margin = np.full(200, model.start)
    for f, c, leaf in model.nodes:  # the margin, walked row by row
        for k in range(200):
            at = 0
            for _ in range(toxicity.DEPTH):
                at = 2 * at + 1 + int(x[k, f[at]] > c[at])
            margin[k] += leaf[at - (2**toxicity.DEPTH - 1)]
    assert np.allclose(margin, model.margin(x))


def test_isotonic_against_the_definition():
    """Each fitted value is the max over starts of the min over ends of the means between: the closed form."""
    r = np.random.default_rng(5)
    for _ in range(20):
        m = np.sort(r.choice(1000, 25, replace=False)).astype(float)
        y = (r.random(25) < np.linspace(0.1, 0.9, 25)).astype(float)
        xs, ys = toxicity.fit_isotonic(m, y)
        want = [max(min(y[a : b + 1].mean() for b in range(k, 25)) for a in range(k + 1)) for k in range(25)]
        assert np.allclose(np.interp(m, xs, ys), want)
