"""Search plans wired to the models: every trial trains on train and is judged on val."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import evaluation as ev
from ..operators import models as mo
from ..operators import sequences as sq
from ..operators.splits import training_set
from ..sources import written
from .retriever import TwoTower
from .tuning import PLANS, Config, Tuner
from .two_stage import TwoStage

#: Users that a trial is judged on, by hash.
TRIAL_USERS = 5_000


class Bench:
    """What the trials share: the log, one training set, and the users they are judged on."""

    def __init__(self, splits: DataFrame, items: DataFrame, relevance: DataFrame, users: int = TRIAL_USERS, seed: int = 0) -> None:
        self.splits, self.items, self.relevance = splits, items, relevance
        self.train = written(training_set(splits, "train"), "search-train")
        data = ev.eval_data(splits)
        own = written(ev.subsample(data.population, users, seed), "search-users")
        of = lambda df: written(df.join(own, "user_id", "left_semi"), "search-rows")
        self.data = ev.EvalData(own, of(data.seen), of(data.relevant), data.train_items, of(data.ever_rated))
        self.liked = written(mo.likes(self.train), "search-liked")
        self.asked = self.liked.join(own, "user_id", "left_semi")

    def judged(self, top: DataFrame) -> dict[str, float]:
        row = ev.per_user(top, self.data, self.items.select("item_id")).agg({"recall": "avg", "ndcg": "avg"}).first()
        return {"recall": row["avg(recall)"] or 0.0, "ndcg": row["avg(ndcg)"] or 0.0}

    def popular(self, config: Config) -> dict[str, float]:
        scores = mo.popularity(self.liked, self.items.select("item_id"))
        return self.judged(mo.popular_top_k(scores, self.data.population, self.data.seen))

    def knn(self, config: Config) -> dict[str, float]:
        least = int(config["min_positives"])
        sim = mo.knn_similarity(mo.item_gram(self.liked, least), int(config["k"]), float(config["shrink"]))
        scores = mo.fill_zero(mo.history_scores(self.asked, sim), mo.kept_items(self.liked, least), self.data.population, self.data.seen)
        return self.judged(ev.top_k(ev.mask_seen(scores, self.data.seen)))

    def ease(self, config: Config) -> dict[str, float]:
        weights = mo.ease(mo.item_gram(self.liked, int(config["min_positives"])), float(config["lam"]))
        return self.judged(mo.ease_top_k(self.asked, weights, self.data.seen))

    def als(self, config: Config) -> dict[str, float]:
        model = mo.als_factors(self.liked, int(config["rank"]), float(config["reg"]), float(config["alpha"]))
        return self.judged(mo.als_top_k(model, self.data.population, self.data.seen))

    def two_tower(self, config: Config) -> dict[str, float]:
        own = {k: v if k in ("temperature", "rate") else int(v) for k, v in config.items()}
        pairs = written(sq.training_pairs(sq.sequences(self.train), int(config.get("history", sq.HISTORY))), "search-pairs")
        return self.judged(TwoTower(**own).fit(pairs).top_k(self.train, self.data.population, self.data.seen))

    def ranker(self, config: Config) -> dict[str, float]:
        own = {k: v if k == "rate" else int(v) for k, v in config.items()}
        chain = TwoStage(ranker=own).fit(self.splits, self.items, self.relevance)
        return self.judged(chain.recommend(self.data.population))


def search(bench: Bench, model: str, log: str | None = None, plan: tuple | None = None) -> tuple[Config, Tuner]:
    """The best settings of a model by its plan, and the trials; a log is resumed from."""
    start, steps, rounds = plan or PLANS[model]
    evaluate: Callable[[Config], dict[str, float]] = getattr(bench, model)
    tuner = Tuner(evaluate, log=log)
    tuner.coordinates(start, steps, rounds)
    return tuner.best(), tuner
