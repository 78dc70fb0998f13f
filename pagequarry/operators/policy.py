"""Policies of a run: failing services, device placement, measured costs, what a client is told of progress."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as X, text as T


def out_of_memory(message: Column) -> Column:
    """Whether an error's text reads as memory of a device run out, or the device lost."""
    return F.coalesce(T.any_part(F.lower(message), X.MEMORY_ERRORS), F.lit(False))


class Breaker:
    """A translator that is left alone for a while after failures in a row, each of which costs its timeout."""

    def __init__(self, step: Callable[[DataFrame], DataFrame], failures: int = X.BREAK_AFTER, rest: float = X.BREAK_SECONDS, clock: Callable[[], float] = time.monotonic) -> None:
        self.step, self.most, self.rest, self.clock = step, failures, rest, clock
        self.failed, self.until = 0, float("-inf")

    def __call__(self, left: DataFrame) -> DataFrame:
        if self.clock() < self.until:
            raise RuntimeError("left alone after failures in a row")
        try:
            out = self.step(left)
        except Exception:
            self.failed += 1
            if self.failed >= self.most:
                self.until = self.clock() + self.rest
            raise
        self.failed = 0
        return out


def measured_costs(defaults: DataFrame, measured: DataFrame) -> DataFrame:
    """model, need: the last plausible measurement (model, n, delta) with its margin, else the default (model, need)."""
    low, high = X.MEASURED_MB
    margin = F.greatest(F.lit(100), (F.col("delta") * X.MEASURED_MARGIN).cast("int")).cast("long")
    good = measured.filter(F.col("delta").between(low, high)).groupBy("model").agg(F.max_by(margin, "n").alias("seen"))
    return defaults.join(good, "model", "left").select("model", F.coalesce("seen", "need").alias("need"))


def placement(models: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, model, device: gpu for the models (host, model, priority, capable, resident, need) that fit, by priority.

    hosts: host, free, reserve.  A resident model stays while half the reserve is free and takes nothing more of the
    budget; of an unknown free amount (null) nothing is placed.
    """
    item = F.struct("priority", "model", "capable", "resident", F.col("need").cast("double").alias("need"))
    per = models.groupBy("host").agg(F.array_sort(F.collect_list(item)).alias("models")).join(hosts, "host")
    free, reserve = F.col("free").cast("double"), F.col("reserve").cast("double")
    start = F.struct((free - reserve).alias("left"), F.array().cast("array<struct<model:string,device:string>>").alias("out"))

    def place(s: Column, m: Column) -> Column:
        fits = m["capable"] & ~m["resident"] & (s["left"] >= m["need"])
        on = F.coalesce(F.when(m["resident"], m["capable"] & (free >= reserve / 2)).otherwise(fits), F.lit(False))
        taken = F.when(F.coalesce(fits, F.lit(False)), m["need"]).otherwise(0.0)
        one = F.struct(m["model"].cast("string").alias("model"), F.when(on, "gpu").otherwise("cpu").alias("device"))
        return F.struct((s["left"] - taken).alias("left"), F.concat(s["out"], F.array(one)).alias("out"))

    done = per.select("host", F.explode(F.aggregate("models", start, place, lambda s: s["out"])).alias("m"))
    return done.select("host", "m.model", "m.device")


def progress_events(statuses: DataFrame) -> DataFrame:
    """task, n, event, percent of the statuses (task, n, percent, status) that a client is told: changes, and the end once.

    A review is told when it begins; leaving it is progress even at the same percent; after the end there is nothing.
    """
    order = Window.partitionBy("task").orderBy("n")
    ends = F.col("status").isin("complete", "failed")
    ended = F.coalesce(F.max(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    before, percent = F.lag("status").over(order), F.lag("percent", 1, -1).over(order)
    reviewing = F.coalesce(before == "review", F.lit(False))
    event = (
        F.when(F.col("status") == "complete", "complete").when(F.col("status") == "failed", "error")
        .when(F.col("status") == "review", F.when(~reviewing, "review")).when((F.col("percent") != percent) | reviewing, "progress")
    )
    told = statuses.withColumns({"ended": ended, "event": event})
    return told.filter("NOT ended AND event IS NOT NULL").select("task", "n", "event", "percent")
