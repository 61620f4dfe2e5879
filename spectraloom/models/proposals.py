"""Adaptive proposals of settings: after random trials, where good trials are dense and bad ones are not.

The finished trials are parted into the best share and the rest. Per parameter each part gives a density: for an
interval a mixture of bells around the part's values, as wide as the gaps to their neighbours, and a flat part; for a
choice smoothed counts. Values are drawn from the good density, and the draw with the largest ratio of the two is
proposed. Trials that are proposed but not finished count as bad, so that settings tried side by side differ.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence

CANDIDATES = 24
BEST_SHARE = 0.1
MOST_GOOD = 25


def draw(space: Mapping[str, tuple], rng: random.Random) -> dict[str, object]:
    """One setting from ``("interval", low, high)`` and ``("choice", values)`` entries."""
    setting = {}
    for name, (kind, *rest) in space.items():
        if kind == "interval":
            setting[name] = rng.uniform(*rest)
        elif kind == "choice":
            setting[name] = rng.choice(list(rest[0]))
        else:
            raise ValueError(f"unknown kind of parameter space {kind!r}")
    return setting


class Bells:
    """Density on an interval: truncated bells around the values and one as wide as the interval."""

    def __init__(self, values: Sequence[float], low: float, high: float):
        self.low, self.high = low, high
        span = high - low
        middle = (low + high) / 2
        ordered = sorted([*values, middle])
        self.centres, self.widths = [], []
        for i, value in enumerate(ordered):
            left = value - (ordered[i - 1] if i else low)
            right = (ordered[i + 1] if i + 1 < len(ordered) else high) - value
            self.centres.append(value)
            self.widths.append(min(max(left, right, span / min(100, len(ordered) + 1)), span))
        at = ordered.index(middle)
        self.widths[at] = span

    def draw(self, rng: random.Random) -> float:
        i = rng.randrange(len(self.centres))
        while True:
            value = rng.gauss(self.centres[i], self.widths[i])
            if self.low <= value <= self.high:
                return value

    def log_density(self, value: float) -> float:
        phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
        total = 0.0
        for centre, width in zip(self.centres, self.widths):
            mass = phi((self.high - centre) / width) - phi((self.low - centre) / width)
            total += math.exp(-0.5 * ((value - centre) / width) ** 2) / (width * math.sqrt(2 * math.pi)) / max(mass, 1e-12)
        return math.log(total / len(self.centres) + 1e-300)


class Counts:
    """Chances of choices: how often each occurred, plus one."""

    def __init__(self, values: Sequence[object], choices: Sequence[object]):
        self.choices = list(choices)
        self.weights = [1 + sum(v == c for v in values) for c in self.choices]

    def draw(self, rng: random.Random) -> object:
        return rng.choices(self.choices, self.weights)[0]

    def log_density(self, value: object) -> float:
        return math.log(self.weights[self.choices.index(value)] / sum(self.weights))


def density(kind: str, rest: Sequence, values: Sequence):
    return Bells(values, *rest) if kind == "interval" else Counts(values, rest[0])


def propose(space: Mapping[str, tuple], finished: Sequence[tuple[dict, float]], pending: Sequence[dict],
            rng: random.Random) -> dict[str, object]:
    """One setting; ``finished`` holds settings with scores, larger is better."""
    ranked = [s for s, _ in sorted(finished, key=lambda t: -t[1] if t[1] == t[1] else math.inf)]
    good = min(math.ceil(BEST_SHARE * len(ranked)), MOST_GOOD)
    best, rest = ranked[:good], ranked[good:] + list(pending)
    setting = {}
    for name, (kind, *given) in space.items():
        likely, unlikely = (density(kind, given, [s[name] for s in part]) for part in (best, rest))
        drawn = [likely.draw(rng) for _ in range(CANDIDATES)]
        setting[name] = max(drawn, key=lambda v: likely.log_density(v) - unlikely.log_density(v))
    return setting


def settings_of_round(space: Mapping[str, tuple], finished: Sequence[tuple[dict, float]], count: int, startup: int,
                      rng: random.Random) -> list[dict[str, object]]:
    """The next ``count`` settings: random ones as long as fewer than ``startup`` are known."""
    found: list[dict] = []
    for _ in range(count):
        random_one = len(finished) + len(found) < startup
        found.append(draw(space, rng) if random_one else propose(space, finished, found, rng))
    return found
