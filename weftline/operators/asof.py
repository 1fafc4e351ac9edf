"""As-of joins, gap classes and the life of a slowly changing state.

An as-of join is a union of events and probes and one window over it: one shuffle by key, no range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_state(events: DataFrame, key: str, at: str, state: str, tie: str) -> DataFrame:
    """One state per key and date: the one of the greatest tie column."""
    return events.groupBy(key, at).agg(F.max_by(state, tie).alias(state))


def asof(probes: DataFrame, events: DataFrame, key: str, at: str, state: str, direction: str = "backward", out: str = "state") -> DataFrame:
    """Each probe with the state at the nearest event at or before it (backward) or at or after it (forward)."""
    both = probes.withColumn("__state", F.lit(None).cast(events.schema[state].dataType)).withColumn("__probe", F.lit(True))
    both = both.unionByName(events.select(key, at, F.col(state).alias("__state"), F.lit(False).alias("__probe")), allowMissingColumns=True)
    order = [F.col(at).asc(), F.col("__probe").asc()] if direction == "backward" else [F.col(at).desc(), F.col("__probe").asc()]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("__state", ignorenulls=True).over(w)).filter("__probe").drop("__state", "__probe")


def classify_gaps(probes: DataFrame, events: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """Probes with gap_class and filled state: recorded, carried forward, not yet launched or never tracked.

    One union and one shuffle by key serve the look back, the look ahead and the event at the probe itself.
    """
    kind = events.schema[state].dataType
    both = probes.withColumn("__state", F.lit(None).cast(kind)).withColumn("__probe", F.lit(True))
    both = both.unionByName(events.select(key, at, F.col(state).alias("__state"), F.lit(False).alias("__probe")), allowMissingColumns=True)
    back = Window.partitionBy(key).orderBy(F.col(at).asc(), F.col("__probe").asc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col("__probe").asc()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__state").isNotNull(), F.struct(F.col(at).alias("at"), F.col("__state").alias("state"))), ignorenulls=True)
    got = both.withColumns({"__back": last.over(back), "__ahead": last.over(ahead)}).filter("__probe")
    own = F.when(F.col("__back.at") == F.col(at), F.col("__back.state"))
    named = F.when(own.isNotNull(), "recorded").when(F.col("__back").isNotNull(), "carried_forward").when(F.col("__ahead").isNotNull(), "not_yet_launched").otherwise("never_tracked")
    got = got.withColumns({"gap_class": named, "filled": F.col("__back.state"), "has_record": own.isNotNull().cast("int")})
    return got.drop("__state", "__probe", "__back", "__ahead")


def lifecycle(states: DataFrame, key: str, t: str, state: str, watched: list[str]) -> DataFrame:
    """From a dense (key, t, state or null): filled state, age, run length, transitions so far, ever and time in state."""
    w = Window.partitionBy(key).orderBy(t)
    to_now = w.rowsBetween(Window.unboundedPreceding, 0)
    df = states.withColumn("filled", F.last(state, ignorenulls=True).over(to_now))
    df = df.withColumn("__first", F.min(F.when(F.col("filled").isNotNull(), F.col(t))).over(Window.partitionBy(key)))
    age = F.col(t) - F.col("__first")
    df = df.withColumn("age", F.when(age >= 0, age)).withColumn("__prev", F.lag("filled", 1).over(w))
    df = df.withColumn("__new", (~F.col("filled").eqNullSafe(F.col("__prev"))).cast("int"))
    df = df.withColumn("__since", F.max(F.when(F.col("__new") == 1, F.col(t))).over(to_now))
    df = df.withColumn("run_length", F.when(F.col("filled").isNotNull(), F.col(t) - F.col("__since") + 1))
    moved = F.col("filled").isNotNull() & F.col("__prev").isNotNull() & (F.col("filled") != F.col("__prev"))
    df = df.withColumn("transitions", F.sum(moved.cast("int")).over(to_now))
    flags = {s: F.coalesce((F.col("filled") == s).cast("int"), F.lit(0)) for s in watched}
    df = df.withColumns({f"ever_{s}": F.max(f).over(to_now) for s, f in flags.items()} | {f"time_{s}": F.sum(f).over(to_now) for s, f in flags.items()})
    return df.drop("__first", "__prev", "__new", "__since")
