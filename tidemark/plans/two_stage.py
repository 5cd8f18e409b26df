"""The chain of two stages: a retriever, its candidates, features of one training set, a ranker,
and scores that the evaluation protocol and serving take like any model's.

The ranker learns from candidates of the earlier part of train and what users liked in the later
one. Then the retriever and all that features are made of are fitted again on the whole
training set, whose users are ranked: nothing of the slice that is judged is ever seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as mo
from ..operators import ranking as rk
from ..operators import sequences as sq
from ..operators.ease import Ease
from ..operators.evaluation import K, top_k
from ..operators.features import content_vectors
from ..operators.splits import positive, training_set
from ..sources import written
from .ranker import LambdaMart
from .retriever import TwoTower


@dataclass
class Stage:
    """A retriever and EASE, fitted on one training set, and the context of features."""

    context: rk.Context
    retriever: TwoTower
    ease: Ease

    def candidates(self, users: DataFrame, k: int) -> DataFrame:
        train = self.context.train
        seen = train.select("user_id", "item_id").distinct().join(users, "user_id", "left_semi")
        return rk.candidates(self.retriever.top_k(train, users, seen, k), train, k)

    def features(self, cands: DataFrame) -> DataFrame:
        liked = mo.likes(self.context.train).join(cands.select("user_id").distinct(), "user_id", "left_semi")
        return rk.rank_features(cands, self.context, self.ease.pair_scores(liked, cands))


@dataclass
class TwoStage:
    retriever: dict[str, object] = field(default_factory=dict)
    ranker: dict[str, object] = field(default_factory=dict)
    names: list[str] = field(default_factory=lambda: list(rk.HEADLINE))
    lam: float = 50.0
    min_positives: int = 10
    candidates: int = rk.CANDIDATES
    max_users: int = 30_000
    seed: int = 42

    def stage(self, train: DataFrame, items: DataFrame, relevance: DataFrame) -> Stage:
        pairs = written(sq.training_pairs(sq.sequences(train)), "pairs")
        tower = TwoTower(**self.retriever).fit(pairs, seed=self.seed)
        return Stage(rk.Context(train, items, content_vectors(relevance)), tower, Ease(mo.likes(train), self.min_positives, self.lam))

    def fit(self, splits: DataFrame, items: DataFrame, relevance: DataFrame, train: str = "train") -> TwoStage:
        """Learn to rank from core and tail of train; then fit again on the training set of that name."""
        core = written(training_set(splits, "train_core"), "core")
        liked = splits.where((F.col("train_part") == "tail") & positive()).select("user_id", "item_id").distinct()
        first = self.stage(core, items, relevance)
        users = rk.ranker_users(core, liked, self.max_users, self.seed)
        rows = rk.require_labelled(written(rk.labelled(first.features(first.candidates(users, self.candidates)), liked), "labelled"))
        self.model = LambdaMart(self.names, **self.ranker).fit(rows, hold_out=0.1)
        self.last = self.stage(written(training_set(splits, train), "train"), items, relevance)
        return self

    def scores(self, users: DataFrame) -> DataFrame:
        """user_id, item_id, score of each user's candidates, as the ranker orders them. Users
        without positives have none."""
        cands = written(self.last.candidates(users, self.candidates), "candidates")
        ranked = self.model.transform(self.last.features(cands)).select("user_id", "item_id", "score")
        base = cands.select("user_id", "item_id", F.col("retriever_score").alias("score"))
        return rk.adapt_scores(cands, ranked, base)

    def recommend(self, users: DataFrame, k: int = K) -> DataFrame:
        """user_id, item_id, score, rank: what a bundle is made of."""
        return top_k(self.scores(users), k)
