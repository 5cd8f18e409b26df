"""Train, evaluate, gate, publish: a run is live only if it beats the live one by a margin."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from ..functions import safe_run_id
from ..operators.statistics import MARGIN
from ..sources import write_json_atomic


class Rejected(RuntimeError):
    """The run didn't pass the gate."""


@dataclass
class Registry:
    """A folder with a folder for each run, registry.json, decisions.csv and the link `live`."""

    folder: str
    margin: float = MARGIN

    def _state(self) -> dict:
        path = f"{self.folder}/registry.json"
        if not os.path.exists(path):
            return {"live": None, "history": []}
        with open(path, encoding="utf-8") as file:
            return json.load(file)

    def run_folder(self, run_id: str) -> str:
        path = f"{self.folder}/candidates/{safe_run_id(run_id)}"
        os.makedirs(path, exist_ok=True)
        return path

    @property
    def live(self) -> dict | None:
        return self._state()["live"]

    def gate(self, run_id: str, value: float) -> bool:
        """Whether value beats the live run's by more than the margin (equal is not enough); logged."""
        live = self.live
        passed = live is None or value > live["value"] + self.margin
        path = f"{self.folder}/decisions.csv"
        new = not os.path.exists(path)
        os.makedirs(self.folder, exist_ok=True)
        with open(path, "a", encoding="utf-8", newline="") as file:
            writer = csv.writer(file)
            if new:
                writer.writerow(["run", "value", "live", "margin", "passed"])
            writer.writerow([safe_run_id(run_id), f"{value:.6f}", "" if live is None else f"{live['value']:.6f}", self.margin, int(passed)])
        write_json_atomic({"value": value, "passed": passed}, f"{self.run_folder(run_id)}/gate.json")
        return passed

    def publish(self, run_id: str, smoke: Callable[[str], None] | None = None) -> dict:
        """Make a run live that passed its gate and its smoke test, at once for all readers."""
        own = self.run_folder(run_id)
        path = f"{own}/gate.json"
        if not os.path.exists(path):
            raise Rejected("no gate decision")
        with open(path, encoding="utf-8") as file:
            decision = json.load(file)
        if not decision["passed"]:
            raise Rejected("the gate was closed")
        if smoke is not None:
            smoke(own)
        link, part = f"{self.folder}/live", f"{self.folder}/live.part"
        if os.path.lexists(part):
            os.remove(part)
        os.symlink(os.path.abspath(own), part)
        os.replace(part, link)
        state = self._state()
        state = {"live": {"run": safe_run_id(run_id), "value": decision["value"]}, "history": [*state["history"], {"run": safe_run_id(run_id), "value": decision["value"]}]}
        write_json_atomic(state, f"{self.folder}/registry.json")
        return state["live"]


def retrain(registry: Registry, run_id: str, train: Callable[[str], None], evaluate: Callable[[str], float], smoke: Callable[[str], None] | None = None) -> str:
    """One pass: 'published' or 'rejected'."""
    own = registry.run_folder(run_id)
    train(own)
    if not registry.gate(run_id, evaluate(own)):
        return "rejected"
    registry.publish(run_id, smoke)
    return "published"
