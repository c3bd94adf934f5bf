"""Tree-structured Parzen estimation: which settings to try next, from those tried.

Trials are split into the good ones (the best share) and the rest.  For each
parameter both give a density over its values: numbers by Gaussian kernels at
the tried values' places in the list plus a uniform prior, other values by
counts plus the prior.  Candidates are drawn from the good density, and the one
with the largest ratio of good to rest is tried, the first among equals.

A suggestion hangs on the seed, its number and the trials before it, so a
search that was lost goes on as it would have.
"""

from __future__ import annotations

import math

import numpy as np

#: Trials drawn at random first; share of good trials and their number at most; candidates of a suggestion; weight of the prior.
STARTUP, SHARE, MOST_GOOD, CANDIDATES, PRIOR = 10, 0.1, 25, 24, 1.0

Setting = dict[str, object]


def good_and_rest(history: list[tuple[Setting, float]]) -> tuple[list[Setting], list[Setting]]:
    """The best trials (the earlier among equals) and the others."""
    ranked = [s for s, _ in sorted(history, key=lambda t: -t[1])]  # sorted() keeps the order of equals
    n = min(MOST_GOOD, math.ceil(SHARE * len(ranked)))
    return ranked[:n], ranked[n:]


def density(values: list, tried: list) -> np.ndarray:
    """A probability for each of a parameter's values."""
    n = len(values)
    place = {v: i for i, v in enumerate(values)}
    out = np.full(n, PRIOR / n)
    if n > 1 and all(isinstance(v, int | float) and not isinstance(v, bool) for v in values):
        width = max(0.5, (n - 1) / max(2.0, len(tried)))
        for v in tried:
            kernel = np.exp(-0.5 * ((np.arange(n) - place[v]) / width) ** 2)
            out += kernel / kernel.sum()
    else:
        for v in tried:
            out[place[v]] += 1.0
    return out / out.sum()


def suggest(history: list[tuple[Setting, float]], space: dict[str, list], seed: int) -> Setting | None:
    """The next setting, one that was not tried; None when all were.

    Settings that aren't of the space raise KeyError.
    """
    names, sizes = list(space), [len(v) for v in space.values()]
    total = math.prod(sizes)
    tried = {tuple(s[n] for n in names) for s, _ in history}
    if len(tried) >= total:
        return None
    rng = np.random.default_rng([seed, len(history)])
    if len(history) < STARTUP:
        for k in np.random.default_rng(seed).permutation(total).tolist():
            setting = {}
            for name, values in space.items():
                k, at = divmod(k, len(values))
                setting[name] = values[at]
            if tuple(setting.values()) not in tried:
                return setting
    good, rest = good_and_rest(history)
    pairs = {n: (density(space[n], [s[n] for s in good]), density(space[n], [s[n] for s in rest])) for n in names}
    best: tuple[float, Setting] | None = None
    while best is None:  # each round draws anew, so an untried setting comes up
        for _ in range(CANDIDATES):
            at = {n: int(rng.choice(len(space[n]), p=pairs[n][0])) for n in names}
            setting = {n: space[n][k] for n, k in at.items()}
            ratio = sum(math.log(pairs[n][0][k]) - math.log(pairs[n][1][k]) for n, k in at.items())
            if tuple(setting.values()) not in tried and (best is None or ratio > best[0]):
                best = (ratio, setting)
    return best[1]
