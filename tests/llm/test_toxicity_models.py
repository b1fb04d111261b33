"""The two Kneser-Ney models against a plain implementation, and what their bigrams are worth."""

import math
import random
from collections import Counter

import numpy as np
import pytest


def plain_model(texts):
    """log P(toxic) - log P(ordinary) of a word after another, by dictionaries and loops; texts: (ordinary, toxic) lists of word lists without repetitions of three words."""
    from twinfold.llm.toxicity import PAIR_POWER, WORD_POWER

    seen = Counter(w for part in texts for ws in part for w in ws)
    known = lambda w: w if seen[w] > 1 else "?"
    pairs = [Counter((known(v) if v else "?", known(w)) for ws in part for v, w in zip([None, *ws], ws, strict=False)) for part in texts]
    vocabulary = {w for w in seen if seen[w] > 1} | {"?"}
    follows = [Counter(w for _, w in p) for p in pairs]
    shared = {w: max(1.0, sum(f[w] ** WORD_POWER for f in follows if f[w])) for w in vocabulary}
    whole = sum(shared.values())
    g = max(sum(n**WORD_POWER for n in f.values()) / sum(f.values()) for f in follows)
    both = Counter()
    for p in pairs:
        for k, n in p.items():
            both[k] += n**PAIR_POWER

    def level(counts, v, w):
        n = sum(c for (a, _), c in counts.items() if a == v)
        if not n:
            return 0.0, 1.0
        c = counts.get((v, w), 0)
        return (c - c**PAIR_POWER) / n if c else 0.0, sum(x**PAIR_POWER for (a, _), x in counts.items() if a == v) / n

    def p(c, v, w):
        own = sum(n - n**WORD_POWER for n in follows[c].values())
        word = (1 - g) * (follows[c][w] - follows[c][w] ** WORD_POWER if follows[c][w] else 0.0) / own + g * shared[w] / whole
        (m1, l1), (m2, l2) = level(pairs[c], v, w), level(both, v, w)
        return m1 + l1 * (m2 + l2 * word)

    return known, p, vocabulary


def texts(rnd, n, phrase, mixed):
    """Texts of common words; the two words of phrase come together in one class and apart in the other."""
    out = []
    for _ in range(n):
        ws = [f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(30, 60))]
        for _ in range(3):
            at = rnd.randrange(1, len(ws) - 8)
            if mixed:
                ws[at], ws[at + 5] = phrase
            else:
                ws[at : at + 2] = phrase
        out.append(" ".join(ws))
    return out


@pytest.fixture(scope="module")
def parts():
    rnd = random.Random(4)
    phrase = ("drop", "dead")
    return texts(rnd, 120, phrase, True), texts(rnd, 120, phrase, False), texts(rnd, 60, phrase, True), texts(rnd, 60, phrase, False)


def test_probabilities_equal_the_plain_form(monkeypatch):
    from twinfold.llm import toxicity as T

    rnd = random.Random(9)
    some = [[[f"w{rnd.randrange(6)}" for _ in range(rnd.randrange(1, 12))] + [f"only{c}{i}" * (i % 2) or "w0"] for i in range(15)] for c in (0, 1)]
    monkeypatch.setattr(T, "_fresh", lambda chain, after: np.ones(chain.size, dtype=bool))
    model = T.fit_models([" ".join(ws) for ws in some[1]], [" ".join(ws) for ws in some[0]])
    known, p, vocabulary = plain_model(some)
    for ws in some[0] + some[1] + [["w3", "never", "w1", "w1"]]:
        got = model.differences(" ".join(ws))
        want = [math.log(p(1, known(v) if v else "?", known(w)) / p(0, known(v) if v else "?", known(w))) for v, w in zip([None, *ws], ws, strict=False)]
        assert np.allclose(got, want)
    for c in (0, 1):
        for v in vocabulary:
            assert abs(sum(p(c, v, w) for w in vocabulary) - 1) < 1e-9


def accuracy(model, clean, toxic):
    return (sum(model.score(t) < 0.5 for t in clean) + sum(model.score(t) >= 0.5 for t in toxic)) / (len(clean) + len(toxic))


def test_bigrams_find_what_words_alone_can_not(parts):
    from twinfold.llm.toxicity import calibrate, fit_models

    clean, toxic, more_clean, more_toxic = parts
    labels = np.array([0] * 60 + [1] * 60)
    model = fit_models(toxic[:60], clean[:60])
    calibrate(model, clean[60:] + toxic[60:], labels)
    assert (model.coefficients[1:] > 0).all()
    whole = accuracy(model, more_clean, more_toxic)
    model.keys, model.mass, model.backoff = np.empty(0, dtype=np.int64), np.empty((2, 0)), np.ones_like(model.backoff)
    calibrate(model, clean[60:] + toxic[60:], labels)
    assert whole >= 0.95 and accuracy(model, more_clean, more_toxic) <= whole - 0.2


def test_the_length_normalised_difference_alone_tells_classes_apart(parts):
    from twinfold.llm.toxicity import fit_models

    clean, toxic, more_clean, more_toxic = parts
    model = fit_models(toxic, clean)
    assert min(np.mean([model.figures(t)[1] for t in more_toxic]) - np.mean([model.figures(t)[1] for t in more_clean]), 1) > 0.05
    assert model.figures("")[1] == 0 and model.figures(None)[1] == 0
