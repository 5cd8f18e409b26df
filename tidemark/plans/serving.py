"""Recommendations as a table, looked up by user, with a popularity fallback; bundles on disk."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import key_hash
from ..operators.evaluation import K
from ..operators.models import likes, popular_top_k, recent_history
from ..operators.splits import positive
from ..sources import get_json, put_json, remove, written_at

MAX_K, MAX_PROFILE = 100, 50
#: Users, and rows but for one user's own, that a request reads at once; numbers that are kept on the driver.
USERS_A_BUCKET, ROWS_A_BUCKET, KEPT_NUMBERS = 20_000, 100_000, 2_000_000


def recommend_all(users: DataFrame, train: DataFrame, scores: DataFrame, k: int = K) -> DataFrame:
    """user_id, item_id, score, rank: the k most popular items that each user hasn't rated."""
    seen = train.select("user_id", "item_id").distinct().join(users.select("user_id").distinct(), "user_id", "left_semi")
    return popular_top_k(scores, users, seen, k)


def with_fallback(users: DataFrame, ranked: DataFrame, train: DataFrame, scores: DataFrame, k: int = K) -> DataFrame:
    """ranked (user_id, item_id, score, rank) for users with positives, popularity for the rest, and strategy."""
    known = likes(train).select("user_id").distinct()
    own = ranked.join(known, "user_id", "left_semi").select("user_id", "item_id", "score", "rank", F.lit("ranked").alias("strategy"))
    rest = recommend_all(users.join(known, "user_id", "left_anti"), train, scores, k)
    return own.unionByName(rest.withColumn("strategy", F.lit("popular")))


def profiles(train: DataFrame, n: int = MAX_PROFILE) -> DataFrame:
    """user_id, n_ratings, n_positives, items: the last n positives, newest first."""
    counts = train.groupBy("user_id").agg(F.count("*").alias("n_ratings"), F.count(F.when(positive(), 1)).alias("n_positives"))
    last = recent_history(train, n).join(train.select("user_id", "item_id", "ts"), ["user_id", "item_id"])
    rows = F.sort_array(F.collect_list(F.struct("ts", "item_id")), asc=False)
    last = last.groupBy("user_id").agg(rows.getField("item_id").alias("items"))
    return counts.join(last, "user_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<bigint>")))


def export_bundle(folder: str, tables: dict[str, DataFrame], about: dict[str, object], users_a_bucket: int = USERS_A_BUCKET) -> None:
    """The tables as Parquet, and a manifest of their schemas, row counts, buckets and origin, written last.

    Tables with a user_id are laid out in buckets of users, so that a request reads one of them.
    """
    rows = {}
    for name, df in tables.items():
        spark, path = df.sparkSession, f"{folder}/{name}"
        df.write.mode("overwrite").parquet(f"{path}.part" if "user_id" in df.columns else path)
        told = {"columns": dict(df.dtypes)}
        if "user_id" in df.columns:
            own = spark.read.schema(df.schema).parquet(f"{path}.part")
            told_rows = own.agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("rows")).first()
            buckets = max(1, -(-told_rows["users"] // users_a_bucket), -(-told_rows["rows"] // ROWS_A_BUCKET))
            own = own.withColumn("__bucket", F.pmod("user_id", F.lit(buckets)))
            own.repartition(buckets, "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(path)
            remove(spark, f"{path}.part")
            told["buckets"] = buckets
        rows[name] = told | {"rows": spark.read.schema(df.schema).parquet(path).count()}
    put_json(spark, {"tables": rows, "about": about}, f"{folder}/manifest.json")


class NotReady(LookupError):
    """There is no bundle to serve from."""


class OutOfRange(ValueError):
    """A request's parameter is outside its bounds."""


@dataclass
class Recommender:
    """Requests against a bundle with the tables recommendations, profiles, popular and, where users
    may be known but not ranked, seen. A bucket of users is read by Spark once and then kept, the
    last `keep` of them, and of those so many as hold KEPT_NUMBERS numbers, the last one always: a request
    for a kept bucket starts no job. A bundle that is written anew is noticed by its manifest."""

    spark: SparkSession
    folder: str | None
    keep: int = 64
    _at: int | None = None
    _manifest: dict | None = None
    _kept: OrderedDict = field(default_factory=OrderedDict)
    _sizes: dict = field(default_factory=dict)

    def _bundle(self) -> dict:
        at = written_at(self.spark, f"{self.folder}/manifest.json") if self.folder else None
        if at is None:
            raise NotReady("no bundle")
        if at != self._at:
            self._manifest, self._at = get_json(self.spark, f"{self.folder}/manifest.json"), at
            self._kept.clear()
            self._sizes.clear()
        return self._manifest

    def _rows(self, name: str, bucket: int | None = None) -> dict[int | None, list]:
        """Rows by user of a bucket, or all rows of a small table under None."""
        if (name, bucket) not in self._kept:
            path = f"{self.folder}/{name}" + ("" if bucket is None else f"/__bucket={bucket}")
            found: dict[int | None, list] = {}
            # Of a bounded number of users; a bucket without any has no folder.
            for r in [] if written_at(self.spark, path) is None else self.spark.read.parquet(path).toLocalIterator():
                found.setdefault(None if bucket is None else r["user_id"], []).append(r)
            self._kept[name, bucket] = found
            self._sizes[name, bucket] = sum(len(x) if isinstance(x, list) else 1 for own in found.values() for r in own for x in r)
            while len(self._kept) > self.keep or len(self._kept) > 1 and sum(self._sizes.values()) > KEPT_NUMBERS:
                del self._sizes[self._kept.popitem(last=False)[0]]
        self._kept.move_to_end((name, bucket))
        return self._kept[name, bucket]

    def _of(self, name: str, user_id: int) -> list:
        told = self._bundle()["tables"].get(name)
        return self._rows(name, user_id % told["buckets"]).get(user_id, []) if told else []

    def warm_up(self) -> int:
        """Read the popular list and as many buckets as are kept before the first request; how many."""
        tables = self._bundle()["tables"]
        wanted = [("popular", None), *[(n, b) for n, t in sorted(tables.items()) for b in range(t.get("buckets", 0))]]
        for name, bucket in wanted[: self.keep]:
            # What would push out what was just read isn't read.
            if self._sizes and sum(self._sizes.values()) + max(self._sizes.values()) > KEPT_NUMBERS:
                break
            self._rows(name, bucket)
        return len(self._kept)

    def health(self) -> dict[str, object]:
        try:
            return {"status": "ok", "about": self._bundle()["about"]}
        except NotReady:
            return {"status": "no bundle"}

    def recommend(self, user_id: int, k: int = K) -> dict[str, object]:
        if not 1 <= k <= MAX_K:
            raise OutOfRange(f"k must be from 1 to {MAX_K}")
        rows = sorted((r for r in self._of("recommendations", user_id) if r["rank"] <= k), key=lambda r: r["rank"])
        if rows:
            return {"user_id": user_id, "strategy": rows[0]["strategy"], "items": [r["item_id"] for r in rows]}
        seen = {r["item_id"] for r in self._of("seen", user_id)}
        popular = sorted(self._rows("popular").get(None, []), key=lambda r: r["place"])
        return {"user_id": user_id, "strategy": "popular", "items": [r["item_id"] for r in popular if r["item_id"] not in seen][:k]}

    def profile(self, user_id: int, n: int = 10) -> dict[str, object]:
        if not 1 <= n <= MAX_PROFILE:
            raise OutOfRange(f"n must be from 1 to {MAX_PROFILE}")
        rows = self._of("profiles", user_id)
        if not rows:
            return {"user_id": user_id, "known": False, "n_ratings": 0, "n_positives": 0, "items": []}
        return {"user_id": user_id, "known": True, "n_ratings": rows[0]["n_ratings"], "n_positives": rows[0]["n_positives"], "items": rows[0]["items"][:n]}

    def sample_user(self, seed: int = 0) -> int:
        """A known user with history."""
        self._bundle()
        rows = self.spark.read.parquet(f"{self.folder}/profiles").where("n_positives > 0").orderBy(key_hash(seed, "user_id"), "user_id").limit(1).collect()
        if not rows:
            raise NotReady("no user has a history")
        return rows[0]["user_id"]
