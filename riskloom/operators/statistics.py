"""Exact sample statistics, endpoint signal and threshold gates.

Exact order statistics of a group of any size: equal values are counted first, the distinct values
are cut into buckets at approximate quantiles, and ranks are running sums inside a bucket plus the
size of the buckets before it. A group with a third of all rows is spread over its buckets. The
counted values are stored, so the samples themselves are read once.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import stored

BUCKETS = 256


def ranked_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per group with the 0-based ranks [lo, hi) they take, and group size n."""
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(
        *keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")))
    cuts = counts.agg(F.percentile_approx(
        "v", [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).scalar()
    step = 16
    coarse = F.array(*[F.get("_cuts", F.lit(i)) for i in range(step - 1, BUCKETS - 1, step)])
    below = lambda points: F.size(F.filter(points, lambda x: x < F.col("v")))
    placed = counts.withColumn("_cuts", cuts).withColumn("_block", below(coarse) * step)
    placed = placed.withColumn("b", F.col("_block") + below(
        F.slice("_cuts", F.col("_block") + 1, step))).drop("_cuts", "_block")
    per_bucket = placed.groupBy(*keys, "b").agg(F.sum("c").alias("bc"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by_key.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "b", F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("before"),
        F.sum("bc").over(by_key).alias("n"))
    same = F.lit(True)
    left, right = placed.alias("l"), offsets.alias("r")
    for k in [*keys, "b"]:
        same = same & F.col("l." + k).eqNullSafe(F.col("r." + k))
    joined = left.join(right, same).select("l.*", "r.before", "r.n")
    running = Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumn("hi", F.col("before") + F.sum("c").over(running))
    return out.select(*keys, "v", (F.col("hi") - F.col("c")).alias("lo"), "hi", "n")


def _at(rank: Column) -> Column:
    return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col("v")))


def _interpolated(p: float) -> Column:
    rank = F.lit(p) * (F.col("n") - 1)
    low, high = _at(F.floor(rank)), _at(F.ceil(rank))
    weight = F.max(rank - F.floor(rank))
    return low + (high - low) * weight


def quantiles(df: DataFrame, value: str, points: Mapping[str, float], keys: tuple[str, ...] = ()
              ) -> DataFrame:
    """Linearly interpolated quantiles, one column per name."""
    ranked = ranked_values(df, list(keys), value)
    return ranked.groupBy(*keys).agg(*[_interpolated(p).alias(name) for name, p in points.items()])


def sample_stats(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Min, max, mean, median, p95 and population deviation."""
    v = F.col(value).cast("double")
    plain = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("stddev"))
    exact = quantiles(df, value, {"median": 0.50, "p95": 0.95}, keys)
    if not keys:
        both = exact.select(F.struct("median", "p95").alias("q")).scalar()
        return plain.withColumn("q", both).select("min", "max", "mean", "stddev", "q.*")
    return plain.join(exact, list(keys))


def nearest_rank(df: DataFrame, value: str, p: float, keys: tuple[str, ...] = (),
                 name: str = "value") -> DataFrame:
    """The value at rank ceil(p * n)."""
    index = F.least(F.greatest(F.ceil(F.lit(p) * F.col("n")) - 1, F.lit(0)), F.col("n") - 1)
    return ranked_values(df, list(keys), value).groupBy(*keys).agg(_at(index).alias(name))


def endpoint_signal(samples: DataFrame) -> DataFrame:
    """Per endpoint requests, failures, error percent, p50/p95 of good probes, coverage."""
    code = F.col("code").try_cast("int")
    failed = (F.col("code") == "000") | (F.coalesce(code, F.lit(0)) >= 400)
    plain = samples.groupBy("endpoint").agg(
        F.count("*").alias("requests"), F.count_if(failed).alias("failures"),
        F.min("coverage_pct").alias("coverage_min"), F.avg("coverage_pct").alias("coverage_avg"))
    good = ranked_values(samples.where(F.col("code") == "200"), ["endpoint"], "latency_ms")

    def nearest(p: int) -> Column:
        rank = F.floor(F.lit(p / 100.0) * F.col("n") + 0.999999)
        return _at(F.least(F.greatest(rank, F.lit(1)), F.col("n")) - 1)

    latency = good.groupBy("endpoint").agg(nearest(50).alias("p50_ms"), nearest(95).alias("p95_ms"))
    out = plain.join(latency, "endpoint", "left")
    return out.withColumn("error_pct", F.round(F.col("failures") / F.col("requests") * 100.0, 2)
                          ).fillna(0.0, ["p50_ms", "p95_ms"])


def probe_metrics(samples: DataFrame, summary: str = "summary", gaps: str = "compliance-gaps"
                  ) -> DataFrame:
    """One row of the metrics that the gates look at."""
    code = F.coalesce(F.col("code").try_cast("int"), F.lit(0))
    failed = (F.col("code") == "000") | (code >= 400)
    totals = samples.agg(
        F.count("*").alias("total_requests"), F.count_if(failed).alias("failed_requests"),
        F.min(F.when(F.col("endpoint") == gaps, F.col("coverage_pct"))).alias("coverage_pct"))
    p95 = quantiles(samples.where((F.col("code") == "200")
                                  & F.col("endpoint").isin(summary, gaps)),
                    "latency_ms", {"p95": 0.95}, ("endpoint",))

    def pick(name: str) -> Column:
        return p95.where(F.col("endpoint") == name).agg(F.max("p95")).scalar()

    return totals.withColumns({
        "error_rate_pct": F.when(F.col("total_requests") > 0, F.col("failed_requests")
                                 / F.col("total_requests") * 100.0).otherwise(F.lit(0.0)),
        "summary_p95_ms": pick(summary), "compliance_p95_ms": pick(gaps)})


def evaluate_gates(metrics: DataFrame, max_error_rate_pct: float | None = None,
                   max_summary_p95_ms: float | None = None,
                   max_compliance_p95_ms: float | None = None,
                   min_coverage_pct: float | None = None, missing: str = "violation") -> DataFrame:
    """The violated thresholds as rows; a missing metric is a violation or is skipped."""
    checks = []

    def add(name: str, limit: float | None, label: str, unit: str, why: str, above: bool) -> None:
        if limit is None:
            return
        c = F.col(name)
        style = "%.2f%%" if unit else "%.3f"
        sign = ">" if above else "<"
        text = F.format_string(f"{name} {style} {sign} {label} {style}", c, F.lit(float(limit)))
        check = F.when((c > limit) if above else (c < limit), text)
        if missing == "violation" and why:
            check = F.when(c.isNull(), F.lit(f"{name} is unavailable {why}")).otherwise(check)
        checks.append(check)

    add("error_rate_pct", max_error_rate_pct, "max_error_rate_pct", "%", "", True)
    add("summary_p95_ms", max_summary_p95_ms, "max_summary_p95_ms", "",
        "(no successful summary probe)", True)
    add("compliance_p95_ms", max_compliance_p95_ms, "max_compliance_p95_ms", "",
        "(no successful compliance probe)", True)
    add("coverage_pct", min_coverage_pct, "min_coverage_pct", "%",
        "in compliance-gaps response", False)
    found = F.filter(F.array(*checks), lambda c: c.isNotNull()) if checks else F.array().cast(
        "array<string>")
    return metrics.select(F.explode(found).alias("violation"))


def _digest(col: str) -> Column:
    return F.xxhash64(col)


def count_different(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Per key the rows as ``n`` and the different values of a long column as ``different``, exactly. Eight
    bytes of a value cross the shuffle; a value whose eight bytes occur once differs from all others, and
    only rows that share theirs are compared by the value itself. ``df`` is read three times."""
    held = df.where(F.col(col).isNotNull()).withColumn("_d", _digest(col))
    shared = stored(held.groupBy(*keys, "_d").agg(F.count("*").alias("_n")).where("_n > 1"))
    same = [F.col("a." + k).eqNullSafe(F.col("b." + k)) for k in (*keys, "_d")]
    met = held.alias("a").join(shared.alias("b"), reduce(lambda a, b: a & b, same), "left_semi")
    compared = met.groupBy(*keys).agg(
        (F.count("*") - F.count_distinct(F.col(col))).alias("_n"), F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("held"))
    whole = df.groupBy(*keys).agg(F.lit(0).cast("bigint").alias("_n"), F.count("*").alias("n"),
                                  F.count(col).alias("held"))
    return whole.unionByName(compared).groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum("held") - F.sum("_n")).alias("different"))
