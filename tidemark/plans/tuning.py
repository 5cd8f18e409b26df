"""Search over settings, one trial at a time, with a log that a later run resumes from."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

Config = dict[str, object]


def canonical(config: Config) -> str:
    """Equal settings have equal text, whatever their order; 1.0 and 1 are equal."""
    plain = {k: int(v) if isinstance(v, float) and v.is_integer() else v for k, v in config.items()}
    return json.dumps(plain, sort_keys=True)


@dataclass
class Tuner:
    """Trials of one model. evaluate(config) returns its metrics, of which `metric` is maximised."""

    evaluate: Callable[[Config], dict[str, float]]
    metric: str = "ndcg"
    log: str | None = None
    done: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.log and os.path.exists(self.log):
            with open(self.log, encoding="utf-8") as file:
                self.done |= {row["config"]: row for row in map(json.loads, file)}

    def trial(self, config: Config) -> float:
        key = canonical(config)
        if key not in self.done:
            began = time.time()
            row = {"config": key, "metrics": self.evaluate(config), "seconds": round(time.time() - began, 3)}
            self.done[key] = row
            if self.log:
                with open(self.log, "a", encoding="utf-8") as file:
                    file.write(json.dumps(row, sort_keys=True) + "\n")
        return self.done[key]["metrics"][self.metric]

    def best(self) -> Config:
        """The settings of the best trial, the first of equals."""
        return json.loads(max(self.done.values(), key=lambda r: r["metrics"][self.metric])["config"])

    def line(self, fixed: Config, key: str, values: Sequence[float], grow: float | None = None, extend: int = 0, floor: float | None = None) -> Config:
        """Try the values of one key. While the best lies at an end, go on beyond it by the factor
        grow, at most `extend` times and not below floor."""
        tried = {v: self.trial({**fixed, key: v}) for v in values}
        while grow and extend > 0:
            at = max(tried, key=lambda v: (tried[v], -list(tried).index(v)))
            beyond = at * grow if at == max(tried) else at / grow if at == min(tried) else None
            if beyond is None or beyond in tried or (floor is not None and beyond < floor):
                break
            if isinstance(at, int):
                beyond = int(round(beyond))
                if beyond in tried:
                    break
            tried[beyond] = self.trial({**fixed, key: beyond})
            extend -= 1
        return {**fixed, key: max(tried, key=lambda v: tried[v])}

    def coordinates(self, start: Config, plan: Sequence[tuple], rounds: int = 1) -> Config:
        """One key after the other, each from the best of those before: (key, values, grow, extend, floor)."""
        config = dict(start)
        for _ in range(rounds):
            for key, values, *more in plan:
                config = self.line(config, key, values, *more)
        return config


#: Search plans by model: start, steps, rounds.
PLANS: dict[str, tuple[Config, list[tuple], int]] = {
    "knn": ({"k": 100, "shrink": 10.0, "min_positives": 20}, [("k", (50, 100, 200), 2.0, 2, 1), ("shrink", (0.0, 10.0, 100.0))], 2),
    "ease": ({"lam": 500.0, "min_positives": 20}, [("lam", (250.0, 500.0, 1000.0), 2.0, 4, 1.0), ("min_positives", (20, 10))], 1),
    "als": ({"rank": 64, "reg": 0.1, "alpha": 5.0}, [("reg", (0.01, 0.1, 1.0), 10.0, 1), ("alpha", (1.0, 5.0, 20.0), 4.0, 1), ("rank", (64, 128, 256)), ("reg", (0.03, 0.1, 0.3))], 1),
    "two_tower": ({"dim": 64, "temperature": 0.1, "rate": 0.01, "history": 10, "batch": 512, "hidden": 64, "epochs": 6}, [("temperature", (0.05, 0.1, 0.2)), ("dim", (64, 128, 256)), ("rate", (0.003, 0.01, 0.03)), ("history", (10, 20, 50)), ("batch", (512, 2048)), ("hidden", (32, 64, 128)), ("epochs", (4, 6, 8))], 1),
    "ranker": ({"rate": 0.1, "depth": 6, "leaf": 20}, [("depth", (4, 6, 8)), ("leaf", (5, 20, 100)), ("rate", (0.03, 0.1))], 1),
}


def score_once(path: str, score: Callable[[], dict[str, float]], about: Config) -> dict:
    """Score a sealed test set a single time: a result that is there is never written again."""
    row = {"about": about, "metrics": None}
    with open(path, "x", encoding="utf-8") as file:  # raises if it exists
        try:
            row["metrics"] = score()
        except BaseException:
            os.remove(path)
            raise
        json.dump(row, file, sort_keys=True)
    return row
