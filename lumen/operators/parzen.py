"""Guided search: settings drawn where good trials are dense and others are not."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np

#: Trials drawn at random first, the share that counts as good, and draws of which the best is proposed.
STARTUP, GOOD, DRAWS = 8, 0.15, 32


def _unit(spec, value) -> float:
    """A number's place in its range, 0 to 1."""
    lo, hi = spec[-2:]
    return float(np.log(value / lo) / np.log(hi / lo)) if spec[0] == "log" else (value - lo) / (hi - lo)


def _value(spec, u: float) -> float | int:
    lo, hi = spec[-2:]
    u = min(1.0, max(0.0, u))
    if spec[0] == "log":
        return float(np.exp(np.log(lo) + u * np.log(hi / lo)))
    return int(round(lo + u * (hi - lo))) if isinstance(lo, int) else float(lo + u * (hi - lo))


class _Density:
    """Normal bumps over the places of trials, as wide as the gaps between them, and a flat part worth one trial."""

    def __init__(self, places: list[float]):
        self.at = np.sort(np.array(places))
        gap = np.diff(self.at)
        wide = np.maximum(np.concatenate([[0.0], gap]), np.concatenate([gap, [0.0]])) if len(places) > 1 else np.full(len(places), 0.5)
        self.width = np.clip(wide, 0.3 / (1 + len(places)), 0.5)

    def draw(self, rng: np.random.Generator) -> float:
        i = int(rng.integers(len(self.at) + 1))
        if i == len(self.at):
            return float(rng.random())
        u = float(rng.normal(self.at[i], self.width[i]))
        return u if 0 <= u <= 1 else float(rng.random())

    def __call__(self, u: float) -> float:
        bumps = np.exp(-0.5 * ((u - self.at) / self.width) ** 2) / (self.width * np.sqrt(2 * np.pi))
        return (1.0 + float(bumps.sum())) / (len(self.at) + 1)


class _Shares:
    """Choices in proportion to how often trials took them, each counted once more."""

    def __init__(self, choices: list, taken: list):
        n = np.array([1 + sum(t == c for t in taken) for c in choices], float)
        self.choices, self.p = choices, n / n.sum()

    def draw(self, rng: np.random.Generator) -> Any:
        return self.choices[int(rng.choice(len(self.choices), p=self.p))]

    def __call__(self, value: Any) -> float:
        return float(self.p[self.choices.index(value)])


def random_setting(space: dict[str, Any], rng: np.random.Generator) -> dict[str, Any]:
    return {name: s[int(rng.integers(len(s)))] if isinstance(s, list) else _value(s, float(rng.random())) for name, s in space.items()}


def propose(space: dict[str, Any], trials: list[tuple[dict, float]], n: int, rng: np.random.Generator) -> list[dict[str, Any]]:
    """n settings, from trials (setting, score), higher being better.

    A dimension at a time, the best of the trials (GOOD of them) give one density and
    the rest, with the settings just proposed, another; of some draws from the
    first the one with the greatest quotient of both is taken. A space maps a name
    to a list of choices, (lo, hi) or ("log", lo, hi); integers stay integers.
    """
    ranked = [p for p, _ in sorted(trials, key=lambda t: -t[1])]
    if len(ranked) < STARTUP or not space:
        return [random_setting(space, rng) for _ in range(n)]
    cut = max(2, round(GOOD * len(ranked)))
    good, rest, out = ranked[:cut], ranked[cut:], []
    for _ in range(n):
        made = {}
        for name, s in space.items():
            a, b = ([p[name] for p in part if name in p] for part in (good, [*rest, *out]))
            if isinstance(s, list):
                one, two = _Shares(s, a), _Shares(s, b)
                made[name] = max((one.draw(rng) for _ in range(DRAWS)), key=lambda v: one(v) / two(v))  # noqa: B023
            else:
                one, two = (_Density([_unit(s, v) for v in x]) for x in (a, b))
                made[name] = _value(s, max((one.draw(rng) for _ in range(DRAWS)), key=lambda u: one(u) / two(u)))  # noqa: B023
        out.append(made)
    return out


def search(space: dict[str, Any], score: Callable[[dict], float], trials: int, batch: int = 1, seed: int = 42, first: dict | None = None) -> list[tuple[dict, float]]:
    """All (setting, score) in order; `first` is tried before any draw. The trials of a batch are scored at once, each in a thread of the driver, and proposed without each other's scores, so a seed and a batch size give the same trials every time. A score that is not a number counts as the worst."""
    rng, out = np.random.default_rng(seed), []
    todo = [first] if first is not None else []
    while len(out) < trials:
        n = min(batch, trials - len(out))
        todo += propose(space, [t for t in out if np.isfinite(t[1])], n - len(todo), rng) if n > len(todo) else []
        if n == 1:
            scores = [score(todo[0])]
        else:
            with ThreadPoolExecutor(n) as pool:
                scores = list(pool.map(score, todo[:n]))
        out += [(p, s if np.isfinite(s) else -np.inf) for p, s in zip(todo[:n], scores, strict=True)]
        todo = todo[n:]
    return out
