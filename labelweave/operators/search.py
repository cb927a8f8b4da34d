"""Particle-swarm search over hyperparameters.

The swarm is one array of records on the driver, a row per particle; a step is one
function from the swarm to the next. Each evaluation is a fit and a scoring as Spark
jobs, several at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from . import learning, metrics
from .scoring import LabelSide, long_scores

# How strongly a particle keeps its course, returns to its own
# best place and is drawn to the best place of the swarm.
INERTIA, COGNITIVE, SOCIAL = 0.5, 1.5, 1.5


@dataclass(frozen=True)
class Real:
    """A number between two others, on a line or, with ``log``, by its logarithm."""

    name: str
    low: float
    high: float
    log: bool = False

    @property
    def range(self) -> tuple[float, float]:
        return (math.log10(self.low), math.log10(self.high)) if self.log else (self.low, self.high)

    def value(self, x: float) -> float:
        return 10.0**x if self.log else float(x)


@dataclass(frozen=True)
class Whole(Real):
    """A whole number between two others."""

    def value(self, x: float) -> int:
        return round(x)


@dataclass(frozen=True)
class Choice:
    """One of several values, side by side on a line."""

    name: str
    values: tuple

    @property
    def range(self) -> tuple[float, float]:
        return 0.0, len(self.values) - 1.0

    def value(self, x: float):
        return self.values[int(np.clip(round(x), 0, len(self.values) - 1))]


def parameter(spec: Mapping) -> Real | Whole | Choice:
    """A parameter from its declaration: name, kind and limits or choices."""
    name, kind = spec["name"], spec["kind"]
    if kind == "choice":
        return Choice(name, tuple(spec["choices"]))
    if kind == "bool":
        return Choice(name, (False, True))
    made = Whole if kind == "int" else Real
    return made(name, float(spec["min"]), float(spec["max"]), kind == "log_float")


class Space:
    """All parameters, as a box of numbers."""

    def __init__(self, specs: Sequence[Mapping]) -> None:
        self.parameters = [parameter(s) for s in specs]
        self.low, self.high = np.array([p.range for p in self.parameters], float).reshape(-1, 2).T

    def values(self, place: np.ndarray) -> dict[str, object]:
        return {p.name: p.value(float(x)) for p, x in zip(self.parameters, place)}


@dataclass
class SearchResult:
    values: dict[str, object]
    fitness: float
    threshold: float
    history: list[dict] = field(default_factory=list)


def _swarm(space: Space, size: int, rng: np.random.Generator) -> np.ndarray:
    """Particles spread over the box, at rest."""
    n = len(space.parameters)
    swarm = np.zeros(size, [("at", float, n), ("speed", float, n), ("best_at", float, n), ("best", float)])
    swarm["at"] = rng.uniform(space.low, space.high, (size, n))
    swarm["best_at"], swarm["best"] = swarm["at"], np.inf
    return swarm


def _moved(swarm: np.ndarray, space: Space, rng: np.random.Generator) -> np.ndarray:
    """The swarm one step on."""
    leader = swarm["best_at"][swarm["best"].argmin()]
    own, common = rng.random(swarm["at"].shape), rng.random(swarm["at"].shape)
    out = swarm.copy()
    out["speed"] *= INERTIA
    out["speed"] += COGNITIVE * own * (swarm["best_at"] - swarm["at"])
    out["speed"] += SOCIAL * common * (leader - swarm["at"])
    out["at"] = np.clip(swarm["at"] + out["speed"], space.low, space.high)
    return out


def swarm_search(
    evaluate: Callable[[dict], tuple[float, float]],
    specs: Sequence[Mapping],
    particles: int = 5,
    iterations: int = 4,
    seed: int = 42,
    threshold: float = 0.5,
    parallel: int = 4,
) -> SearchResult:
    """Smallest fitness found; ``evaluate`` gives (fitness, threshold) of some values.

    The particles of one step are independent and run ``parallel`` at a time. An
    evaluation that fails counts as infinitely bad and is noted.
    """
    space, rng, history = Space(specs), np.random.default_rng(seed), []

    def record(job: tuple[int, int, dict]) -> dict:
        step, number, values = job
        seen = {"iteration": step, "particle": number, "values": values, "error": None}
        try:
            fitness, found = evaluate(values)
            return seen | {"fitness": float(fitness), "threshold": float(found)}
        except Exception as failure:  # a bad setting must not end the search
            return seen | {"fitness": math.inf, "threshold": threshold, "error": f"{type(failure).__name__}: {failure}"}

    swarm = _swarm(space, particles, rng)
    with ThreadPoolExecutor(parallel) as pool:
        for step in range(iterations + 1):
            if step:
                swarm = _moved(swarm, space, rng)
            rows = list(pool.map(record, [(step, i, space.values(p["at"])) for i, p in enumerate(swarm)]))
            fitness = np.array([r["fitness"] for r in rows])
            ahead = fitness < swarm["best"]
            swarm["best_at"][ahead], swarm["best"][ahead] = swarm["at"][ahead], fitness[ahead]
            history += rows
    top = min(history, key=lambda r: (r["fitness"], r["iteration"], r["particle"]))
    return SearchResult(top["values"], top["fitness"], top["threshold"], history)


def _tuned(fit, eval_rows, side, specs, metric, tune_threshold, threshold, vector, labels, swarm):
    """Swarm search over ``fit(values)``, which gives a model or None."""

    def fitness(values: dict) -> tuple[float, float]:
        model = fit(values)
        if model is None:
            raise ValueError("too few pairs to train")
        snapshot = learning.score_snapshot(model, eval_rows, [], labels, vector)
        long = long_scores(snapshot, side, [], truth="truth")
        if metric == "val_loss":
            return float(metrics.pair_log_loss(long).first()[0]), threshold
        grid = None if tune_threshold else [threshold]
        best = metrics.best_threshold(metrics.threshold_sweep(long, side, grid), metric).first()
        return -best["score"], best["threshold"]

    return swarm_search(fitness, specs, threshold=threshold, **swarm)


def tune_linear_pairs(
    train_rows: DataFrame,
    eval_rows: DataFrame,
    side: LabelSide,
    row_id: str,
    specs: Sequence[Mapping],
    metric: str = "macro_f1",
    tune_threshold: bool = True,
    threshold: float = 0.5,
    vector: str = "vector",
    labels: str = "labels",
    fixed: Mapping | None = None,
    **swarm,
) -> SearchResult:
    """Swarm search for the pair regression: values of C, n_neg, mode, balanced.

    The metric is ``macro_f1``, ``micro_f1`` (with the best threshold of the sweep
    per particle) or ``val_loss``.
    """
    usual = {"C": 1.0, "n_neg": 3, "mode": "concat+diff+prod", "balanced": True} | dict(fixed or {})

    def fit(values: dict):
        v = usual | values
        pairs_of = learning.training_pairs(
            train_rows, side, row_id, vector, labels, int(v["n_neg"]), mode=v["mode"]
        )
        return learning.fit_linear_pairs(pairs_of, side, v["mode"], float(v["C"]), balanced=bool(v["balanced"]))

    return _tuned(fit, eval_rows, side, specs, metric, tune_threshold, threshold, vector, labels, swarm)


#: What a boosted model is searched over unless other parameters are named.
BOOSTED_SPACE = (
    {"name": "learning_rate", "kind": "log_float", "min": 0.01, "max": 0.3},
    {"name": "max_depth", "kind": "int", "min": 3, "max": 8},
    {"name": "n_neg", "kind": "int", "min": 1, "max": 6},
    {"name": "pca_components", "kind": "choice", "choices": (None, 8, 16)},
    {"name": "mode", "kind": "choice", "choices": ("concat", "concat+diff+prod")},
)


def tune_boosted_pairs(
    train_rows: DataFrame,
    eval_rows: DataFrame,
    side: LabelSide,
    row_id: str,
    specs: Sequence[Mapping] = BOOSTED_SPACE,
    metric: str = "macro_f1",
    tune_threshold: bool = True,
    threshold: float = 0.5,
    vector: str = "vector",
    labels: str = "labels",
    fixed: Mapping | None = None,
    **swarm,
) -> SearchResult:
    """Swarm search for the boosted pairs: negatives and feature mode, and any named
    argument of ``learning.fit_boosted_pairs``."""

    def fit(values: dict):
        v = {"n_neg": 3, "mode": "concat+diff+prod"} | dict(fixed or {}) | values
        n_neg, mode = int(v.pop("n_neg")), v.pop("mode")
        pairs_of = learning.training_pairs(train_rows, side, row_id, vector, labels, n_neg, mode=mode)
        return learning.fit_boosted_pairs(pairs_of, side, mode, **v)

    return _tuned(fit, eval_rows, side, specs, metric, tune_threshold, threshold, vector, labels, swarm)
