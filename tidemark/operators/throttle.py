"""Write throttling: keep a row only when it differs enough from the last row kept.

The comparison is with the last *kept* row, so it is a fold along time. Keys are cut into
slices of bounded length. All slices are folded at once from a guessed entry state; slices
whose entry state turns out to be another one are folded again until nothing changes. The
first slice of a key has no predecessor, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.operators.scale import number_rows, same_key
from tidemark.session import materialize


def moved(new: Column, old: Column, threshold: float = fixed.WRITE_THRESHOLD) -> Column:
    """True when there is no usable old value or the relative change is above the threshold."""
    return old.isNull() | (old == 0) | (F.abs(new - old) / F.nullif(old, F.lit(0.0)) > threshold)


def significant_changes(df: DataFrame, keys: list[str], time: str, values: list[str],
                        order: list[str] | None = None, threshold: float = fixed.WRITE_THRESHOLD,
                        ttl_seconds: int = fixed.WRITE_TTL_SECONDS, slice_rows: int = 2000) -> DataFrame:
    """Rows to write: the first of a key, or any value moved, or the last write is too old.

    A null value has not moved; after a row kept with a null value, the next row is kept.
    """
    columns = df.columns
    sequence = [F.col(c) for c in [time, *(order or []), *values]]
    placed = number_rows(df, keys, sequence, "_pos")
    payload = [c for c in columns if c not in keys]
    micros = F.unix_micros(time).alias("_t")
    slices = materialize(
        placed.withColumn("_slice", F.floor((F.col("_pos") - 1) / slice_rows))
        .groupBy(*keys, "_slice")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", micros, *payload))).alias("_rows")), "slices")

    state_type = "struct<_t:bigint," + ",".join(f"v{i}:double" for i in range(len(values))) + ">"

    def is_write(state: Column, row: Column) -> Column:
        old = state["_t"].isNull() | (row["_t"] - state["_t"] >= ttl_seconds * 1_000_000)
        for i, v in enumerate(values):
            old = old | moved(row[v], state[f"v{i}"], threshold)
        return old

    def state_of(row: Column) -> Column:
        return F.struct(row["_t"].alias("_t"), *[row[v].cast("double").alias(f"v{i}")
                                                 for i, v in enumerate(values)]).cast(state_type)

    def fold(state: Column) -> Column:
        return F.aggregate("_rows", state, lambda s, r: F.when(is_write(s, r), state_of(r)).otherwise(s))

    nothing = F.lit(None).cast(state_type)
    at = [*keys, "_slice"]
    states = materialize(slices.select(*at, nothing.alias("entry"), fold(nothing).alias("exit")), "states")
    along = Window.partitionBy(*keys).orderBy("_slice")
    while True:
        found = states.withColumn("found", F.lag("exit").over(along))
        stale = found.filter(~F.col("found").eqNullSafe(F.col("entry")))
        if stale.isEmpty():
            break
        again = (same_key(slices, stale.select(*at, "found"), at)
                 .select(*at, F.col("found").alias("entry"), fold(F.col("found")).alias("exit")))
        settled = found.filter(F.col("found").eqNullSafe(F.col("entry"))).select(*at, "entry", "exit")
        states = materialize(settled.unionByName(again), "states")

    joined = same_key(slices, states.select(*at, "entry"), at)
    row_type = joined.schema["_rows"].dataType.simpleString()
    start = F.struct(F.col("entry").alias("state"), F.array().cast(row_type).alias("kept"))
    walked = F.aggregate("_rows", start, lambda acc, r: F.when(
        is_write(acc["state"], r),
        F.struct(state_of(r).alias("state"), F.concat(acc["kept"], F.array(r)).alias("kept")))
        .otherwise(acc), lambda acc: acc["kept"])
    return (joined.select(*keys, F.explode(walked).alias("_row"))
            .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in columns]))
