"""Predictions that were written down before a test set was scored, and their verdicts.

A verdict that is settled stays: settle() adds only predictions that have none yet.
"""

from __future__ import annotations

from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.statistics import REPORT_REPLICATES, bootstrap, mean_over_seeds, paired

SCHEMA = "id int, verdict string, evidence string"
#: Least ratios, greatest gap and change, and the greatest latencies in milliseconds.
LEAST_RATIO, GREATEST_GAP = 1.5, 0.10
CHANGE = (-0.01, 0.05)
P50_MS, P99_MS = 10.0, 25.0

Verdict = tuple[int, bool | None, str]


def _medians(figures: DataFrame) -> dict[str, dict[str, float]]:
    """model -> the medians over its seeds; a handful of rows."""
    names = ["ndcg", "recall", "coverage"]
    rows = figures.groupBy("model").agg(*[F.expr(f"percentile({n}, 0.5D)").alias(n) for n in names]).collect()
    return {r["model"]: {n: r[n] for n in names} for r in rows}


def of_models(figures: DataFrame, per_user: DataFrame, replicates: int = REPORT_REPLICATES) -> list[Verdict]:
    """1 to 4, from figures (model, seed, ndcg, recall, coverage) and per-user metrics (model, seed,
    user_id, ndcg, recall) of popular, ease, two_tower and two_stage among others."""
    m = _medians(figures)
    if missing := sorted({"popular", "ease", "two_tower", "two_stage"} - set(m)):
        return [(n, None, f"no figures of {', '.join(missing)}") for n in (1, 2, 3, 4)]

    def interval(a: str, b: str, metric: str):
        own = mean_over_seeds(per_user, metric)
        of = lambda x: own.where(F.col("model") == x).select("user_id", metric)
        return bootstrap(paired(of(a), of(b), metric), n=replicates).first()

    ratio = m["two_tower"]["ndcg"] / m["popular"]["ndcg"]
    gap = (m["ease"]["recall"] - m["two_tower"]["recall"]) / m["ease"]["recall"]
    ahead = interval("two_tower", "ease", "recall")
    change = (m["two_stage"]["ndcg"] - m["two_tower"]["ndcg"]) / m["two_tower"]["ndcg"]
    moved = interval("two_stage", "two_tower", "ndcg")
    lowest = min((x["coverage"], name) for name, x in m.items() if name != "popular")
    within = CHANGE[0] <= change <= CHANGE[1] or change < CHANGE[0] and moved["hi"] >= 0
    return [
        (1, ratio >= LEAST_RATIO, f"two_tower / popular ndcg {ratio:.3f}"),
        (2, ahead["lo"] <= 0 and gap <= GREATEST_GAP, f"ease ahead in recall by {gap:+.3f}; two_tower - ease {ahead['mean']:+.4f} [{ahead['lo']:+.4f}, {ahead['hi']:+.4f}]"),
        (3, within, f"two_stage changes ndcg by {change:+.3f}; difference {moved['mean']:+.4f} [{moved['lo']:+.4f}, {moved['hi']:+.4f}]"),
        (4, m["popular"]["coverage"] < lowest[0], f"coverage of popular {m['popular']['coverage']:.4f}, lowest other {lowest[0]:.4f} ({lowest[1]})"),
    ]


def of_engines(seconds: dict[tuple[str, str, str], list[float]], clean: bool = True) -> Verdict:
    """5: the single-node engine is faster than Spark at every size, with start-up and without.
    seconds are runs by (engine, size, kind); runs that others disturbed settle nothing."""
    mid = {k: median(v) for k, v in seconds.items()}
    pairs = sorted({k[1:] for k in mid})
    told = "; ".join(f"{size} {kind}: {mid['single', size, kind]:.2f} s, Spark {mid['spark', size, kind]:.2f} s" for size, kind in pairs)
    return 5, all(mid["single", *p] < mid["spark", *p] for p in pairs) if clean else None, told


def of_latency(p50: float, p99: float, clean: bool = True) -> Verdict:
    """6: requests are answered fast enough."""
    return 6, (p50 < P50_MS and p99 < P99_MS) if clean else None, f"p50 {p50:.2f} ms, p99 {p99:.2f} ms"


def of_schemes(random: float, user: float, global_: float) -> Verdict:
    """7: a random split flatters a model against a split in time, and the per-user one lies between."""
    return 7, random >= LEAST_RATIO * global_ and random > user > global_, f"ndcg random {random:.4f}, user {user:.4f}, global {global_:.4f}"


def settle(status: DataFrame, found: list[Verdict]) -> DataFrame:
    """status (id, verdict, evidence) with the verdicts found for what isn't settled yet."""
    spark = status.sparkSession
    word = {True: "confirmed", False: "refuted", None: "not settled"}
    new = spark.createDataFrame([(n, word[ok], told) for n, ok, told in found], SCHEMA)
    kept = status.where("verdict in ('confirmed', 'refuted')")
    rest = status.join(kept.select("id"), "id", "left_anti").join(new.select("id"), "id", "left_anti")
    return kept.unionByName(rest).unionByName(new.join(kept.select("id"), "id", "left_anti")).select("id", "verdict", "evidence")


def report_values(status: DataFrame, figures: DataFrame, summary: DataFrame) -> dict[str, object]:
    """Values of a report's placeholders: verdicts, medians by model, and figures of the data."""
    out: dict[str, object] = {f"prediction.{r['id']}": r["verdict"] for r in status.collect()}
    for model, own in sorted(_medians(figures).items()):
        out |= {f"test.{model}.ndcg": f"{own['ndcg']:.4f}", f"test.{model}.recall": f"{own['recall']:.4f}", f"test.{model}.coverage": f"{100 * own['coverage']:.1f}%"}
    return out | {f"data.{k}": f"{v:,}" if isinstance(v, int) else v for k, v in summary.first().asDict().items()}
