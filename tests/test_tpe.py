import math
import random

import numpy as np

from arborlane.operators import tpe

SPACE = {"a": [1, 2, 4, 8, 16, 32], "b": ["x", "y", "z"], "c": [0.1, 0.2, 0.3, 0.4, 0.5], "d": [True, False]}


def score(s):
    return -((SPACE["a"].index(s["a"]) - 4) ** 2) - 4 * (s["b"] != "z") - 10 * (s["c"] - 0.3) ** 2 - 2 * s["d"]


def brute(values, tried):
    """The density by the formula, with loops."""
    n, numeric = len(values), not isinstance(values[0], str | bool)
    out = []
    for i in range(n):
        p = 1.0 / n
        for t in tried:
            j = values.index(t)
            if numeric:
                w = max(0.5, (n - 1) / max(2.0, len(tried)))
                g = lambda k: math.exp(-0.5 * ((k - j) / w) ** 2)  # noqa: B023, E731
                p += g(i) / sum(map(g, range(n)))
            else:
                p += i == j
        out.append(p / (1 + len(tried)))
    return out


def test_suggestions_by_the_formula():
    rng = random.Random(3)
    history = []
    while len(history) < 40:
        s = {k: rng.choice(v) for k, v in SPACE.items()}
        if s not in [x for x, _ in history]:
            history.append((s, score(s)))
    ranked = sorted(history, key=lambda t: -t[1])
    good, rest = [s for s, _ in ranked[:4]], [s for s, _ in ranked[4:]]
    draw, best = np.random.default_rng([7, 40]), None
    for _ in range(24):
        at = {k: int(draw.choice(len(v), p=tpe.density(v, [s[k] for s in good]))) for k, v in SPACE.items()}
        s = {k: SPACE[k][i] for k, i in at.items()}
        ratio = sum(math.log(brute(v, [x[k] for x in good])[at[k]] / brute(v, [x[k] for x in rest])[at[k]]) for k, v in SPACE.items())
        if s not in [x for x, _ in history] and (best is None or ratio > best[0] + 1e-12):
            best = (ratio, s)
    assert tpe.suggest(history, SPACE, 7) == best[1]
    for k, v in SPACE.items():
        assert np.allclose(tpe.density(v, [s[k] for s in good]), brute(v, [s[k] for s in good]))


def run(seed, n, pick):
    history = []
    for _ in range(n):
        s = pick(history, seed)
        history.append((s, score(s)))
    return max(x for _, x in history)


def test_beats_random_on_a_planted_optimum():
    space = dict(SPACE, e=list(range(12)), f=list("pqrs"))
    globals()["score"] = lambda s: -abs(SPACE["a"].index(s["a"]) - 4) - 3 * (s["b"] != "z") - 10 * abs(s["c"] - 0.3) - s["d"] - abs(s["e"] - 7) - 2 * (s["f"] != "r")
    guess = lambda history, seed: (lambda r: {k: r.choice(v) for k, v in space.items()})(random.Random(seed * 1000 + len(history)))
    better = [run(seed, 45, lambda h, s: tpe.suggest(h, space, s)) - run(seed, 45, guess) for seed in range(20)]
    assert sum(better) / 20 > 0.5 and sum(b >= 0 for b in better) >= 14


def test_all_settings_once_and_then_none():
    space, history = {"a": [1, 2, 3], "b": ["u", "v"]}, []
    while (s := tpe.suggest(history, space, 1)) is not None:
        history.append((s, float(s["a"])))
    assert len(history) == 6 == len({tuple(s.values()) for s, _ in history})
