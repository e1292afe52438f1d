"""Forecasts of remaining time from samples of past work: by lane, combined over lanes, with workloads of padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW, MIN_SAMPLES, SESSION, HALF = 24, 3, 3600, 6


def recent(samples: DataFrame, keys: list[str], now: Column, window: int = WINDOW) -> DataFrame:
    """The last window valid samples of each lane (observed_at, work, seconds), none older than ten times their median, a minute at least and a session at most."""
    fine = (F.col("work") > 0) & (F.col("seconds") > 0) & (F.col("work") < float("inf")) & (F.col("seconds") < float("inf")) & (now - F.col("observed_at")).between(0, SESSION)
    newest = W.partitionBy(*keys).orderBy(F.col("observed_at").desc(), F.col("sample_id").desc())
    last = samples.where(fine).withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= window)
    middle = last.groupBy(*keys).agg(F.expr("percentile_cont(0.5) within group (order by seconds)").alias("_middle"))
    expiry = F.least(F.lit(float(SESSION)), F.greatest(F.lit(60.0), F.col("_middle") * 10))
    return last.join(middle, keys).where(now - F.col("observed_at") <= expiry).drop("_middle", "_rn")


def weighted(rows: DataFrame, keys: list[str], value: str, weight: str, share: float, name: str) -> DataFrame:
    """The weighted quantile of value by keys."""
    rising = W.partitionBy(*keys).orderBy(value, weight)
    placed = rows.withColumns({"_cum": F.sum(weight).over(rising.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum(weight).over(W.partitionBy(*keys))})
    return placed.where(F.col("_cum") >= F.col("_all") * share - 1e-12).groupBy(*keys).agg(F.min(value).alias(name))


def lanes(samples: DataFrame, keys: list[str], now: Column, remaining: float, projection: float = 0.0, digits: int = 1) -> DataFrame:
    """For each lane its rate (seconds for a unit of work) and the seconds that remaining units take, with bounds; null below MIN_SAMPLES samples.

    Recent samples weigh by their work and half as much every HALF samples back. A sample counts within a factor of two of the median
    rate. projection (0 to 1) is the share of the work that is only guessed: it widens the bounds by up to a half.
    """
    newest = W.partitionBy(*keys).orderBy(F.col("observed_at").desc(), F.col("sample_id").desc())
    own = recent(samples, keys, now)
    rates = own.withColumns({"rate": F.col("seconds") / F.col("work"), "weight": F.col("work") * F.pow(F.lit(0.5), (F.row_number().over(newest) - 1) / F.lit(float(HALF)))})
    bounded = rates.join(weighted(rates, keys, "rate", "weight", 0.5, "centre"), keys).withColumn("bounded", F.least(F.col("centre") * 2, F.greatest(F.col("centre") / 2, F.col("rate"))))
    mean = bounded.groupBy(*keys).agg((F.sum(F.col("bounded") * F.col("weight")) / F.sum("weight")).alias("rate"), F.count(F.lit(1)).alias("samples"))
    both = mean.join(weighted(bounded, keys, "bounded", "weight", 0.2, "_low"), keys).join(weighted(bounded, keys, "bounded", "weight", 0.8, "_high"), keys)
    doubt = min(1.0, max(0.0, projection)) * 0.5
    ok = F.col("samples") >= MIN_SAMPLES
    seconds = lambda c: F.when(ok, F.round(remaining * c, digits))
    low, high = F.least(F.col("rate") * 0.8, F.col("_low")), F.greatest(F.col("rate") * 1.2, F.col("_high"))
    return both.select(*keys, "samples", F.when(ok, F.col("rate")).alias("rate"), seconds(F.col("rate")).alias("seconds"), seconds(low * (1 - doubt)).alias("lower"), seconds(high * (1 + doubt)).alias("upper"))


def combined(forecasts: DataFrame, keys: list[str], digits: int = 1) -> DataFrame:
    """Lanes that work side by side, as one: times add as resistances in parallel do; null if one lane has no rate."""
    known = F.count_if(F.col("rate").isNull()) == 0
    together = lambda c: F.when(known, F.round(1 / F.sum(1 / F.col(c)), digits)).alias(c)
    return forecasts.groupBy(*keys).agg(F.sum("samples").alias("samples"), F.when(known, 1 / F.sum(1 / F.col("rate"))).alias("rate"), *(together(c) for c in ("seconds", "lower", "upper")))


def workload(staged: DataFrame, unbuilt: DataFrame, built_tokens: Column, built_chars: Column) -> DataFrame:
    """Work by batch size: what staged batches (size, slots, tokens) take with their padding, and what unbuilt texts (size, chars) are thought to, with that share of it.

    Characters become tokens as they did in what is built; padding is that of the staged batches of the size, a tenth if there are none.
    """
    expansion = F.coalesce(F.greatest(F.lit(0.02), F.least(F.lit(4.0), built_tokens / F.nullif(built_chars, F.lit(0)))), F.lit(1.25 / 3.5))
    both = staged.join(unbuilt, "size", "full")
    guessed = F.coalesce(F.col("chars") * expansion * F.coalesce(F.col("slots") / F.nullif("tokens", F.lit(0)), F.lit(1.1)), F.lit(0.0))
    known = F.coalesce(F.col("slots").cast("double"), F.lit(0.0))
    return both.select("size", (known + guessed).alias("work"), (guessed / F.greatest(F.lit(1.0), known + guessed)).alias("projection"))


def kept_samples(samples: DataFrame, keys: list[str], now: Column, each: int = WINDOW, most: int = 1024, age: int = 86400) -> DataFrame:
    """Samples that are kept: the newest of each lane, the newest in all, none older than age."""
    young = samples.where(now - F.col("observed_at") <= age)
    newest = [F.col("observed_at").desc(), F.col("sample_id").desc()]
    own = young.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*newest))).where(F.col("_rn") <= each).drop("_rn")
    return own.orderBy(*newest).limit(most)


def stage_metrics(spans: DataFrame, keys: list[str]) -> DataFrame:
    """By stage: samples, units, errors, time that the spans (started, finished, units, errors) cover together, units a minute (from two samples on), and the median and 95th percentile of seconds a unit."""
    order = W.partitionBy(*keys).orderBy("started", "finished").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.max("finished").over(order), F.col("started"))
    each = spans.withColumns({"_fresh": F.greatest(F.lit(0), F.col("finished") - F.greatest("started", before)), "_unit": (F.col("finished") - F.col("started")) / F.col("units")})
    place = W.partitionBy(*keys).orderBy("_unit", "started", "finished")
    ranked = each.withColumns({"_rn": F.row_number().over(place), "_n": F.count(F.lit(1)).over(W.partitionBy(*keys))})
    at = lambda k: F.max(F.when(F.col("_rn") == k, F.col("_unit")))
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("units").alias("units"), F.sum("errors").alias("errors"), F.sum("_fresh").alias("covered"),
        F.round(at(F.floor(F.col("_n") / 2) + 1), 4).alias("p50"), F.round(at(F.ceil(F.col("_n") * 0.95)), 4).alias("p95"),
    )
    return sums.withColumn("per_minute", F.when((F.col("samples") >= 2) & (F.col("covered") > 0), F.round(F.col("units") / F.col("covered") * 60, 2)))
