"""Pairs of frames of a sequence under a distance predicate: block against block, only matches leave a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def distances(a: np.ndarray, b: np.ndarray, norm: str) -> np.ndarray:
    """Distances of all rows of a to all of b; L2 without cancellation, 64 rows at a time."""
    out = np.empty((len(a), len(b)))
    for s in range(0, len(a), 64):
        diff = a[s : s + 64, None] - b[None]
        out[s : s + 64] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff)) if norm == "l2" else np.abs(diff).max(axis=2)
    return out


def _blocks(frames: DataFrame, upper: Column | float, lower: Column | float | None, block: int) -> DataFrame:
    """One row per block of places of a seq: its places and vectors, packed, in the vectors' own precision."""
    low = F.lit(float("-inf")) if lower is None else (lower if isinstance(lower, Column) else F.lit(float(lower)))
    up = upper if isinstance(upper, Column) else F.lit(float(upper))
    narrow = frames.schema["x"].dataType.simpleString() == "array<float>"
    rows = frames.where(F.col("x").isNotNull()).select(
        "seq", F.col("pos").cast("bigint").alias("pos"), (F.col("x") if narrow else F.col("x").cast("array<double>")).alias("x"),
        up.cast("double").alias("up"), low.cast("double").alias("low"), F.floor(F.col("pos") / block).alias("own"),
    )

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        x = np.stack(t["x"].to_numpy(zero_copy_only=False)).astype(np.float32 if narrow else np.float64)
        row = {"seq": t["seq"][0].as_py(), "own": t["own"][0].as_py(), "up": t["up"][0].as_py(), "low": t["low"][0].as_py()}
        row |= {"places": t["pos"].to_numpy().tobytes(), "vectors": x.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("seq", pa.string()), ("own", pa.int64()), ("up", pa.float64()), ("low", pa.float64()), ("places", pa.binary()), ("vectors", pa.binary())]))

    packed = rows.groupBy("seq", "own").applyInArrow(pack, "seq string, own bigint, up double, low double, places binary, vectors binary")
    return packed.withColumn("narrow", F.lit(narrow))


def _met(frames: DataFrame, norm: str, upper, lower, block: int, result, schema: str) -> DataFrame:
    """``result(seq, late places, early places, distances, which match)`` of each two blocks of a seq."""
    blocks = _blocks(frames, upper, lower, block)
    last = frames.groupBy("seq").agg(F.floor(F.max("pos") / block).alias("last")).withColumnRenamed("seq", "_s")
    meets = F.transform(
        F.sequence(F.lit(0).cast("bigint"), "last"), lambda o: F.struct(F.greatest("own", o).alias("bi"), F.least("own", o).alias("bj"))
    )

    def compare(t: pa.Table) -> pa.Table:
        own, bi, bj = t["own"].to_pylist(), t["bi"][0].as_py(), t["bj"][0].as_py()
        kind = np.float32 if t["narrow"][0].as_py() else np.float64
        if bi not in own or bj not in own:  # a block of places without vectors
            return result(None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros((0, 0), bool))
        sides = []
        for b in (bi, bj):
            k = own.index(b)
            places = np.frombuffer(t["places"][k].as_py(), np.int64)
            sides += [places, np.frombuffer(t["vectors"][k].as_py(), kind).reshape(len(places), -1).astype(np.float64)]
        late, x, early, y = sides
        d = distances(x, y, norm)
        earlier = early[None] < late[:, None]
        return result(t["seq"][0].as_py(), late, early, d, earlier & (d <= t["up"][0].as_py()) & (d > t["low"][0].as_py()))

    spread = blocks.join(last, F.col("seq").eqNullSafe(F.col("_s"))).drop("_s")
    return spread.select("*", F.explode(meets).alias("m")).select(*blocks.columns, "m.bi", "m.bj").groupBy("seq", "bi", "bj").applyInArrow(compare, schema)


def _of(seq: str | None, **columns: np.ndarray) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({"seq": pa.array([seq] * n, pa.string()), **{c: pa.array(v) for c, v in columns.items()}})


def earlier_pairs(
    frames: DataFrame, norm: str, upper: Column | float, lower: Column | float | None = None, block: int = BLOCK
) -> DataFrame:
    """seq, i, j, d of all pairs j < i of a seq with ``lower < d <= upper`` (bounds may differ by seq).

    ``frames`` has seq, pos (a frame's place in its seq, each once) and x (the vector; all of one width within a seq).
    Null vectors match nothing. Every pair of a seq is compared, as the predicate has no index; a task holds two blocks
    of rows, and only pairs that match are shuffled.
    """

    def pairs(seq, late, early, d, near):
        r, c = np.nonzero(near)
        return _of(seq, i=late[r], j=early[c], d=d[r, c])

    return _met(frames, norm, upper, lower, block, pairs, "seq string, i bigint, j bigint, d double")


def earlier_runs(
    frames: DataFrame, norm: str, upper: Column | float, lower: Column | float | None = None, block: int = BLOCK
) -> DataFrame:
    """The pairs of ``earlier_pairs`` as stretches: seq, i, first, last of successive places of a block that all match."""

    def runs(seq, late, early, d, near):
        goes_on = np.zeros(near.shape, bool)  # a place without a vector ends a stretch
        goes_on[:, 1:] = near[:, 1:] & near[:, :-1] & (np.diff(early) == 1)
        ends = near.copy()
        ends[:, :-1] &= ~goes_on[:, 1:]
        r, first = np.nonzero(near & ~goes_on)
        return _of(seq, i=late[r], first=early[first], last=early[np.nonzero(ends)[1]])

    return _met(frames, norm, upper, lower, block, runs, "seq string, i bigint, first bigint, last bigint")


def earlier_extent(frames: DataFrame, norm: str, block: int = BLOCK) -> DataFrame:
    """Of each frame how many are before it, and the least and the largest distance: seq, i, n, nearest, farthest.

    Each two blocks give one row per frame; the pairs themselves never leave a task.
    """

    def extent(seq, late, early, d, near):
        n = near.sum(axis=1)
        at = np.flatnonzero(n)
        low, high = np.where(near, d, np.inf)[at], np.where(near, d, -np.inf)[at]
        none = np.zeros(0)
        return _of(seq, i=late[at], n=n[at].astype(np.int64), nearest=low.min(axis=1) if len(at) else none, farthest=high.max(axis=1) if len(at) else none)

    parts = _met(frames, norm, float("inf"), None, block, extent, "seq string, i bigint, n bigint, nearest double, farthest double")
    return parts.groupBy("seq", "i").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))


def probe(frames: DataFrame, target: DataFrame, distance) -> DataFrame:
    """Every frame against one fixed descriptor (``target``: one row with x): pos, d."""
    return frames.crossJoin(F.broadcast(target.select(F.col("x").alias("_y")))).select("pos", distance(F.col("x"), F.col("_y")).alias("d"))
