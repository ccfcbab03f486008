"""Rate control as plans over a table of requests: budgets, waits, retries and pacing. Times are columns, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def two_budgets(requests: DataFrame, key: str, order: list[str], units: str, most_requests: int, most_units: int) -> DataFrame:
    """Numbers the windows that requests fall into when each window admits at most so many requests and so many units. A request
    larger than the budget is admitted alone in a window of its own. The fold runs per key over its requests in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(units).cast("long").alias("u"))))
    start = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        fits = (a["n"] < most_requests) & ((a["s"] + r["u"] <= most_units) | (a["n"] == 0))
        w = F.when(fits, a["w"]).otherwise(a["w"] + 1)
        return F.struct(w.alias("w"), F.when(fits, a["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"), F.when(fits, a["s"] + r["u"]).otherwise(r["u"]).alias("s"), F.concat(a["out"], F.array(w)).alias("out"))

    rows = requests.groupBy(key).agg(listed.alias("r")).withColumn("w", F.aggregate("r", start, step)["out"])
    return rows.select(key, F.inline(F.arrays_zip("r", "w"))).select(key, *[F.col(f"r.{c}").alias(c) for c in order], F.col("w").alias("window"))


def retry_plan(attempts: DataFrame, keys: list[str], most: int = 3, base: float = 1.0, longest: float = 300.0) -> DataFrame:
    """attempts (keys, attempt from 1, status, retry_after) with what follows: done, give_up, or a wait before the next try. The server's
    wait is kept up to the longest; else waits double."""
    transient = F.col("status").isin(429, 500, 502, 503, 504)
    wait = F.least(F.coalesce(F.col("retry_after").cast("double"), F.lit(base) * F.pow(F.lit(2.0), F.col("attempt") - 1)), F.lit(longest))
    state = F.when(~transient, "done").when(F.col("attempt") >= most, "give_up").otherwise("wait")
    return attempts.select(*keys, "attempt", state.alias("state"), F.when(state == "wait", wait).alias("wait_seconds"))


def pacing(requests: DataFrame, key: str, ts: str, least: float = 0.4) -> DataFrame:
    """Adds the seconds each request has to wait so that requests of a key stand `least` seconds apart: a request goes out at the latest of
    its own time and, for each one before it, that one's time and the gaps between them."""
    w = W.partitionBy(key).orderBy(ts, "request_id")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = int(least * 1_000_000)
    rows = requests.withColumn("__k", F.row_number().over(w) - 1).withColumn("__t", micros)
    sent = F.max(F.col("__t") - F.col("__k") * gap).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("__k") * gap
    return rows.withColumn("wait_seconds", F.round((sent - F.col("__t")) / 1_000_000, 6)).drop("__k", "__t")


def cached(lookups: DataFrame, key: str, as_of: Column, days: int = 7) -> DataFrame:
    """The latest answer of each key that still counts: positive ones always, negative ones for some days, transient ones never."""
    fresh = ~F.col("status").isin(429, -1) & (~F.col("status").isin(300, 404) | (as_of.cast("timestamp") - F.expr(f"interval {days} days") <= F.col("stored").cast("timestamp")))
    return lookups.where(fresh).groupBy(key).agg(F.max_by("status", F.struct("stored", "status")).alias("status"))
