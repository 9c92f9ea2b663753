"""Per-key results over keys of which a few hold most rows.

``key_states`` range-partitions on (key, secondary) with Spark's sampled quantiles. As the
secondary column is part of the range, a heavy key is cut over as many partitions as its share
needs, and every task gets an even load. Within its sorted partition a task folds each run of
equal keys into one partial state; only the first and the last run of a partition can go on in a
neighbour, so only those (two a partition) are shuffled again and stitched in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinmesh.session import Scratch

STATE = "key string, n_rows bigint, n_second bigint, first_second string, last_second string, min_value timestamp, max_value timestamp, part int, edge boolean"


def _differs(a: pa.Array) -> np.ndarray:
    """For each row but the first, whether it differs from the one before; null equals null."""
    x, y = a.slice(1), a.slice(0, len(a) - 1)
    d = pc.fill_null(pc.not_equal(x, y), False)
    return pc.or_(d, pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds runs of equal keys of one sorted partition. The open last run of a batch is carried
    into the next one as a state, never as rows, so memory doesn't grow with a key."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("key", pa.string()), ("n_rows", pa.int64()), ("n_second", pa.int64()), ("first_second", pa.string()), ("last_second", pa.string()), ("min_value", pa.timestamp("us", "UTC")), ("max_value", pa.timestamp("us", "UTC")), ("part", pa.int32()), ("edge", pa.bool_())])
    carried: list | None = None
    first = True

    def emit(columns: list[list], flags: list[bool]) -> pa.RecordBatch:
        n = len(flags)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip([*columns, [part] * n, flags], schema)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        key, second, value = b.column(0), b.column(1), b.column(2).cast(pa.int64())
        new_key = np.concatenate([[True], _differs(key)])
        new_second = new_key | np.concatenate([[True], _differs(second)])
        starts = np.flatnonzero(new_key)
        ends = np.append(starts[1:], b.num_rows)
        v = pc.fill_null(value, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        lo = np.minimum.reduceat(v, starts)
        v = pc.fill_null(value, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        hi = np.maximum.reduceat(v, starts)
        states = list(
            map(
                list,
                zip(
                    key.take(pa.array(starts)).to_pylist(), (ends - starts).tolist(), np.add.reduceat(new_second.astype(np.int64), starts).tolist(),
                    second.take(pa.array(starts)).to_pylist(), second.take(pa.array(ends - 1)).to_pylist(), lo.tolist(), hi.tolist(),
                ),
            )
        )
        if carried is not None:
            head = states[0]
            if carried[0] == head[0]:
                states[0] = [head[0], carried[1] + head[1], carried[2] + head[2] - (carried[4] == head[3]), carried[3], head[4], min(carried[5], head[5]), max(carried[6], head[6])]
            else:
                states.insert(0, carried)
        carried = states.pop()
        if states:
            yield emit(_columns(states), [first] + [False] * (len(states) - 1))
            first = False
    if carried is not None:
        yield emit(_columns([carried]), [True])


def _columns(states: list[list]) -> list[list]:
    columns = [list(c) for c in zip(*states)]
    columns[5] = [None if x == np.iinfo(np.int64).max else x for x in columns[5]]
    columns[6] = [None if x == np.iinfo(np.int64).min else x for x in columns[6]]
    return columns


def key_states(df: DataFrame, key: str, second: str, value: str, scratch: Scratch) -> DataFrame:
    """One row per value of ``key``: n_rows, n_second (distinct values of ``second``, null counting
    as one) and the least and greatest ``value`` (a timestamp).

    A null key is a group of its own; an empty table gives no rows; other columns are ignored,
    whatever their names. The partial states are a written table, since both halves of the
    result read them; they hold one row per key and partition."""
    lean = df.select(F.col(key).cast("string").alias("key"), F.col(second).cast("string").alias("second"), F.col(value).cast("timestamp").alias("value"))
    ranged = lean.repartitionByRange("key", "second", "value").sortWithinPartitions("key", "second")
    parts = scratch.store(ranged.mapInArrow(_fold, STATE), "states")
    along = Window.partitionBy("key").orderBy("part")
    before = F.lag(F.struct(F.col("last_second").alias("second"))).over(along)
    joined = parts.where("edge").withColumn("again", before.eqNullSafe(F.struct(F.col("first_second").alias("second"))))
    stitched = joined.groupBy("key").agg(F.sum("n_rows").alias("n_rows"), (F.sum("n_second") - F.sum(F.col("again").cast("bigint"))).alias("n_second"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))
    return parts.where(~F.col("edge")).select(stitched.columns).unionByName(stitched)


def heavy_keys(states: DataFrame, share: float) -> DataFrame:
    """The non-null keys that hold at least ``share`` of all rows: at most 1/share of them."""
    total = states.agg(F.sum("n_rows")).first()[0] or 0
    return states.where(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(total * share)))
