"""Running totals and row numbers over a whole ordered table, without bringing it into one task.

A window without partitions, or over one hot key, is a single task. Here rows are range-partitioned by their order, each
partition has its own running totals, and only one row per partition, its totals, is summed up in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placetrail.plans.session import cut


def running_totals(df: DataFrame, order: list[str], sums: list[str], keys: list[str] | None = None) -> DataFrame:
    """``df`` with ``run_<c>`` for each column of ``sums``: its total up to and including the row.

    With ``keys`` totals start anew for each key. ``order`` must be total within a key; sums are doubles. Null keys form
    one key, null summands count as 0.
    """
    keys = keys or []
    by = [*keys, *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_key", F.to_json(F.struct(*keys)) if keys else F.lit("")))
    amounts = [F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_sum_{c}") for c in sums]
    totals = ranged.groupBy("_part", "_key").agg(*amounts)
    # only the first key of a partition can go on from partitions before it
    first = ranged.groupBy("_part").agg(F.min_by("_key", F.struct(*by)).alias("_key"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals
    for c in sums:
        offsets = offsets.withColumn(f"_off_{c}", F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0.0)))
    offsets = offsets.join(first, ["_part", "_key"]).select("_part", F.col("_key").alias("_first"), *(f"_off_{c}" for c in sums))
    joined = ranged.join(F.broadcast(offsets), "_part")  # one row per partition
    out = [*df.columns]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`run_{c}` double" for c in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, np.zeros(len(sums))
        for b in batches:
            if not b.num_rows:
                continue
            key = b["_key"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            columns = [np.nan_to_num(b[c].cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)) for c in sums]
            result = [np.zeros(b.num_rows) for _ in sums]
            for s, e in zip(starts, np.r_[starts[1:], b.num_rows]):
                if key[s] != last:
                    goes_on = key[s] == b["_first"][int(s)].as_py() and last is None
                    state = np.array([b[f"_off_{c}"][int(s)].as_py() if goes_on else 0.0 for c in sums])
                    last = key[s]
                for k, v in enumerate(columns):
                    total = np.cumsum(v[s:e]) + state[k]
                    result[k][s:e] = total
                    state[k] = total[-1]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in out), *map(pa.array, result)], names=[*out, *(f"run_{c}" for c in sums)])

    return joined.mapInArrow(run, schema)


def row_numbers(df: DataFrame, order: list[str], name: str, keys: list[str] | None = None) -> DataFrame:
    """``df`` with the rank of each row from 0 in a total order, within ``keys`` if given."""
    counted = running_totals(df.withColumn("_one", F.lit(1)), order, ["_one"], keys)
    return counted.withColumn(name, (F.col("run__one") - 1).cast("bigint")).drop("_one", "run__one")
