"""A retraining run from end to end: train a chain, judge it on val, pass the gate, publish a bundle."""

from __future__ import annotations

import subprocess
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import evaluation as ev
from ..operators import models as mo
from ..sources import get_json, put_json
from .publishing import Registry, retrain
from .serving import MAX_K, export_bundle, profiles, with_fallback
from .two_stage import TwoStage


@dataclass
class Run:
    splits: DataFrame
    items: DataFrame
    relevance: DataFrame
    settings: dict = field(default_factory=dict)

    def train(self, folder: str) -> None:
        self.chain = TwoStage(**self.settings).fit(self.splits, self.items, self.relevance)

    def evaluate(self, folder: str) -> float:
        """NDCG on val; the bundle is laid down beside its metrics, so that publishing only swaps."""
        spark, data, catalog = self.splits.sparkSession, ev.eval_data(self.splits), self.items.select("item_id")
        top = self.chain.recommend(data.population)
        row = ev.summary(top, data, self.splits, catalog).first().asDict()
        put_json(spark, row, f"{folder}/metrics.json")
        self.bundle(folder, row)
        return row["ndcg"] or 0.0

    def bundle(self, folder: str, metrics: dict) -> None:
        train = self.chain.last.context.train
        everyone = self.splits.select("user_id").distinct()
        known = mo.likes(train).select("user_id").distinct()
        popular = mo.popularity(mo.likes(train), self.items.select("item_id"))
        seen = train.select("user_id", "item_id").distinct()
        most = seen.groupBy("user_id").count().agg({"count": "max"}).first()[0] or 0
        table = with_fallback(everyone, self.chain.recommend(known), train, popular)
        about = {"settings": self.settings, "features": self.chain.names, "retriever": self.chain.last.retriever.about, "metrics": metrics}
        export_bundle(f"{folder}/bundle", {"recommendations": table, "profiles": profiles(train), "popular": mo.popular_list(popular, most + MAX_K), "seen": seen}, about)

    def run(self, registry: Registry, run_id: str, smoke=None) -> str:
        return retrain(registry, run_id, self.train, self.evaluate, smoke)


def smoke_test(folder: str, python: str = sys.executable) -> None:
    """Load the bundle and ask it in a process of its own; raises with what that process said."""
    done = subprocess.run([python, "-m", "tidemark.plans.runs", folder], capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr[-2000:])


def ask(spark, folder: str) -> None:
    """Requests that any bundle must answer."""
    from .serving import Recommender

    service = Recommender(spark, f"{folder}/bundle")
    if service.health()["status"] != "ok" or get_json(spark, f"{folder}/bundle/manifest.json") is None:
        raise SystemExit("the bundle isn't ready")
    service.warm_up()
    user = service.sample_user()
    if not service.recommend(user)["items"] or not service.recommend(-1)["items"] or not service.profile(user)["known"]:
        raise SystemExit("the bundle doesn't answer")


if __name__ == "__main__":
    from ..session import get_session

    ask(get_session("smoke", "local[1]"), sys.argv[1])
