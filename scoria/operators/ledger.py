"""Job ledgers and incremental state as snapshots: a state table merged with a batch by one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backoff(attempts: Column, step: float = 30, most: float = 3600, top: int = 7) -> Column:
    """Seconds until the next try: doubling, capped."""
    return F.least(F.lit(float(most)), step * F.pow(F.lit(2.0), F.least(attempts, F.lit(top))))


def record(state: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Failures after a batch: a success removes the key's failure, a failure counts up and backs off.

    state: key, attempts, retry_at; batch: key, ok, distinct keys. One full join, no update in place.
    """
    s, b = state.alias("s"), batch.alias("b")
    j = s.join(b, "key", "full").filter(F.col("b.ok").isNull() | ~F.col("b.ok"))
    tries = F.when(F.col("b.ok").isNull(), F.col("s.attempts")).otherwise(F.coalesce("s.attempts", F.lit(0)) + 1)
    again = F.when(F.col("b.ok").isNull(), F.col("s.retry_at")).otherwise(now + backoff(tries))
    return j.select("key", tries.alias("attempts"), again.alias("retry_at"))


def finish(tasks: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Tasks after their results: done with its bytes, pending again with backoff, error from the fifth try on."""
    j = tasks.join(results.select("key", F.col("ok").alias("_ok"), F.col("bytes").alias("_b")), "key", "left")
    tries = F.when(~F.coalesce("_ok", F.lit(True)), F.col("attempts") + 1).otherwise(F.col("attempts"))
    status = F.when(F.col("_ok"), "done").when(~F.col("_ok"), F.when(F.col("attempts") + 1 >= 5, "error").otherwise("pending")).otherwise(F.col("status"))
    retry = F.when(~F.col("_ok"), now + backoff(F.col("attempts") + 1, 5, 300, 30)).otherwise(F.col("retry_at"))
    return j.select("key", status.alias("status"), tries.alias("attempts"), retry.alias("retry_at"), F.when(F.col("_ok"), F.col("_b")).otherwise(F.col("bytes")).alias("bytes"))


def conflicts(objects: DataFrame) -> DataFrame:
    """Keys put with different bytes: there must be none."""
    return objects.groupBy("key").agg(F.countDistinct("sha").alias("hashes"), F.countDistinct("size").alias("sizes")).filter("hashes > 1 or sizes > 1")


def evict(objects: DataFrame, budget: int, by: list[str], cell: str | None = None) -> DataFrame:
    """Objects to remove, oldest first, until the rest fits the budget of its `cell` (all rows without one)."""
    part = Window.partitionBy(cell) if cell else Window.partitionBy(F.lit(0))
    total = F.sum("size").over(part)
    before = F.coalesce(F.sum("size").over(part.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return objects.withColumn("excess", total - budget).withColumn("before", before).filter("before < excess").drop("excess", "before")


def finished_prefix(tasks: DataFrame, group: list[str], order: str) -> DataFrame:
    """How far each group is done without a gap: everything before its first unfinished task."""
    first = F.min(F.when(F.col("status") != "done", F.col(order)))
    return tasks.groupBy(*group).agg(F.coalesce(first - 1, F.max(order)).alias("upto"))


def minute_limited(requests: DataFrame, limit: int) -> DataFrame:
    """Requests with `allowed`: at most limit in a minute of each role, in order of arrival."""
    w = Window.partitionBy("role", F.date_trunc("minute", "ts")).orderBy("ts", "id")
    return requests.withColumn("allowed", F.row_number().over(w) <= limit)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(differing): rows, as JSON with columns by name, that either table has more often than the other."""
    rows = lambda df: df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row"))
    a, b = rows(a), rows(b)
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("differing"))


def mass(spans: DataFrame, row: str, start: str, length: str, at: str = "x") -> DataFrame:
    """(row, at, mass): how many spans cover each cell of a row.

    A span counts where it starts and where it ends; the running sum of these between two places is the mass of all cells
    there. Spans are added up by place before they move, so that a row has as many entries as places.
    """
    edge = F.explode(F.array(F.struct(F.col(start).alias(at), F.lit(1).alias("d")), F.struct((F.col(start) + F.col(length)).alias(at), F.lit(-1).alias("d"))))
    steps = spans.filter(F.col(length) > 0).select(row, edge.alias("e")).groupBy(row, F.col(f"e.{at}").alias("a")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(row).orderBy("a")
    runs = steps.select(row, "a", F.lead("a").over(w).alias("b"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("mass")).filter("mass > 0")
    return runs.select(row, F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias(at), "mass")


def two_limits(requests: DataFrame, key: list[str], order: list[str], short: Column, short_limit: int, long: Column, long_limit: int) -> DataFrame:
    """Requests with `granted`: each is one unit of a limit for a short time and one for a long time; what is refused uses neither.

    As all ask for one unit, those of a short time beyond its limit are refused whatever came before, and of the rest those
    beyond the long limit: two windows do what a fold would.
    """
    r = requests.withColumn("_short", short).withColumn("_long", long)
    nth = F.row_number().over(Window.partitionBy(*key, "_short").orderBy(*order))
    r = r.withColumn("_fits", (nth <= short_limit).cast("int"))
    used = F.sum("_fits").over(Window.partitionBy(*key, "_long").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("granted", (F.col("_fits") == 1) & (used <= long_limit)).drop("_short", "_long", "_fits")


def viewport_queue(tiles: DataFrame, now: Column, ttl_s: int, cooldown_s: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(waiting, dropped): tiles (tile, seen, failed) to be warmed, newest first with their place, and how many beyond the bound are dropped.

    A tile looked at too long ago, or failed too lately, does not wait. The bound is the feature: a queue holds no more.
    """
    ago = lambda s: now - F.make_dt_interval(secs=F.lit(s))
    fresh_ = tiles.filter((F.col("seen") >= ago(ttl_s)) & (F.col("failed").isNull() | (F.col("failed") < ago(cooldown_s))))
    first = fresh_.orderBy(F.col("seen").desc(), "tile").limit(most)
    waiting = first.withColumn("pos", F.row_number().over(Window.orderBy(F.col("seen").desc(), "tile")))  # of at most `most` rows
    return waiting, fresh_.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("dropped"))
