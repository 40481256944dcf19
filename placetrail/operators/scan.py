"""The keyframe-suppressed scan: frames in order against a database that only unreported frames enter.

Stage 1, parallel: the matches of each frame among all frames before it (see ``pairs``). Stage 2, in order, one stream
per sequence: which of these are in the database, the belief count, the decision. Stage 2 needs no vectors; it holds one
number per accepted frame of the sequence at hand.

Where limits are wide nearly all frames match, and the matches grow with the square of a sequence. ``vector_scan`` has one
stage instead: the vectors of a sequence in order, each against the accepted ones alone; no pair is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placetrail.operators.pairs import distances
from placetrail.plans.presets import Preset

_SCAN = "seq string, pos bigint, chunk bigint, i bigint, lp bigint, is_loop boolean"


def belief(places: np.ndarray, k_run: int) -> int:
    """Sum over runs of consecutive database places of max(0, length - K + 1)."""
    if not len(places):
        return 0
    ends = np.flatnonzero(np.r_[places[1:] != places[:-1] + 1, True])
    runs = np.diff(np.r_[-1, ends])
    return int(np.maximum(runs - k_run + 1, 0).sum())


def belief_fixed_database(pairs: DataFrame, k_run: int) -> DataFrame:
    """The belief count of each frame against all frames before it (no suppression): seq, i, lp."""
    island = F.col("j") - F.row_number().over(Window.partitionBy("seq", "i").orderBy("j"))
    runs = pairs.withColumn("island", island).groupBy("seq", "i", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("seq", "i").agg(F.sum(F.greatest(F.lit(0), F.col("n") - k_run + 1)).alias("lp"))


def warm(preset: Preset, chunk, i):
    """Whether a frame enters the database without a test."""
    if preset.warmup == "none":
        return F.lit(False)
    early = i < 3
    return early & (chunk == 0) if preset.warmup == "first_chunk" else early


def suppressed_scan(frames: DataFrame, pairs: DataFrame, preset: Preset) -> DataFrame:
    """The decision on each frame: seq, pos, chunk, i, lp, is_loop.

    ``frames`` has seq, pos, chunk, i, and may have k_run, which then goes before the preset's; ``pairs`` has seq, i, j
    (places, j < i), or first and last of stretches of matching places. Warm-up frames have lp 0. Null seq is a sequence
    of its own.
    """
    stretch = F.struct("first", "last") if "first" in pairs.columns else F.struct(F.col("j").alias("first"), F.col("j").alias("last"))
    lists = pairs.groupBy(F.col("seq").alias("_s"), F.col("i").alias("_i")).agg(F.sort_array(F.collect_list(stretch)).alias("near"))
    k = F.col("k_run") if "k_run" in frames.columns else F.lit(preset.k_run)
    rows = frames.join(lists, F.col("seq").eqNullSafe(F.col("_s")) & (F.col("pos") == F.col("_i")), "left").select(
        "seq", F.col("pos").cast("bigint"), F.col("chunk").cast("bigint"), F.col("i").cast("bigint"),
        warm(preset, F.col("chunk"), F.col("i")).alias("warm"), k.cast("int").alias("k_run"), "near",
    )
    more_than = preset.more_than

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place = object(), {}
        for b in batches:
            seq, pos = b["seq"].to_pylist(), b["pos"].to_pylist()
            warm_, k_run, near = b["warm"].to_pylist(), b["k_run"].to_pylist(), b["near"].to_pylist()
            lp, loop = [], []
            for s, p, w, kr, m in zip(seq, pos, warm_, k_run, near):
                if s != now:
                    now, place = s, {}
                held = [] if w or not m else [place[j] for s_ in m for j in range(s_["first"], s_["last"] + 1) if j in place]
                n = belief(np.array(held), kr) if len(held) >= kr else 0
                is_loop = n > more_than
                if not is_loop:
                    place[p] = len(place)
                lp.append(n)
                loop.append(is_loop)
            yield pa.RecordBatch.from_arrays(
                [b["seq"], b["pos"], b["chunk"], b["i"], pa.array(lp, pa.int64()), pa.array(loop, pa.bool_())],
                names=[c.split()[0] for c in _SCAN.split(", ")],
            )

    return rows.repartition("seq").sortWithinPartitions("seq", "pos").mapInArrow(fold, _SCAN)


def near_flags(x: np.ndarray, y: np.ndarray, norm: str, up: float, low: float) -> np.ndarray:
    """Which rows of y each row of x matches (``low < d <= up``), by distances in double precision.

    L2 by a product of matrices; pairs too near a bound for its rounding are decided by their own differences.
    """
    if not up >= 0:
        return np.zeros((len(x), len(y)), bool)
    if norm != "l2":
        d = distances(x, y, norm)
        return (d > low) & (d <= up)
    size = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
    square = (-2 * x) @ y.T
    square += size
    near = square <= up * up
    size *= 4 * (x.shape[1] + 4) * np.finfo(float).eps
    size += 1e-300
    doubt = ~(np.abs(square - up * up) > size)
    if low >= 0:
        near &= square > low * low
        doubt |= ~(np.abs(square - low * low) > size)
    r, c = np.nonzero(doubt)
    for s in range(0, len(r), 16_384):
        a, b = r[s : s + 16_384], c[s : s + 16_384]
        d = np.sqrt(np.cumsum((x[a] - y[b]) ** 2, axis=1)[:, -1])  # summed up in order
        near[a, b] = (d > low) & (d <= up)
    return near


def _windows(near: np.ndarray, k_run: int) -> np.ndarray:
    """Of each row, the number of places from which k_run in a row match."""
    width = 1
    while width < k_run and near.shape[1]:
        step = min(width, k_run - width)
        near = near[:, step:] & near[:, :-step]
        width += step
    return near.sum(axis=1)


class _Database:
    """The accepted vectors of one sequence, in order and in their own precision, and its decisions."""

    def __init__(self, preset: Preset, up: float, k_run: int, tile: int):
        self.preset, self.up, self.k_run, self.tile = preset, up, k_run, tile
        self.low = float("-inf") if preset.min_part is None else preset.min_part * up
        self.held, self.n = None, 0

    def _add(self, x: np.ndarray) -> None:
        if self.held is None:
            self.held = np.empty((0, x.shape[1]), x.dtype)
        if self.n + len(x) > len(self.held):
            more = np.empty((2 * len(self.held) + len(x), x.shape[1]), x.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)

    def decide(self, x: np.ndarray, warm_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lp and is_loop of the next frames; those that are not reported enter."""
        k, wide = self.k_run, x.astype(np.float64)
        lp, end = np.zeros(len(x), np.int64), np.zeros((len(x), 0), bool)
        for s in range(0, self.n, self.tile):
            tile = self.held[s : min(s + self.tile, self.n)].astype(np.float64)
            near = np.concatenate([end, near_flags(wide, tile, self.preset.norm, self.up, self.low)], axis=1)
            lp += _windows(near, k)
            end = near[:, max(0, near.shape[1] - k + 1) :]
        run = np.logical_and.accumulate(end[:, ::-1], axis=1).sum(axis=1)  # places at the database's end that match
        own = near_flags(wide, wide, self.preset.norm, self.up, self.low)
        lp[warm_] = 0
        entered = np.zeros(len(x), bool)
        for f in range(len(x)):
            if lp[f] <= self.preset.more_than:
                entered[f] = True
                run[f + 1 :] += 1
                run[f + 1 :] *= own[f, f + 1 :]
                lp[f + 1 :] += (run[f + 1 :] >= k) & ~warm_[f + 1 :]
        self._add(x[entered])
        return lp, ~entered


def vector_scan(
    frames: DataFrame, order: list[str], preset: Preset, upper: Column | float, block: int = 256, tile: int = 1024
) -> DataFrame:
    """``suppressed_scan`` from the vectors themselves: seq, pos, chunk, i, lp, is_loop; pos is a frame's place in its seq.

    ``frames`` has seq, chunk, i, x (never null; all of one width within a seq) and the columns of ``order``, which must be
    total within a seq; it may have k_run, which then goes before the preset's. ``upper`` and k_run are one value per
    seq; where one is null nothing matches. The frames are shuffled once. A task holds the accepted vectors of the
    sequence at hand and a block of frames, which meets them tile by tile.
    """
    narrow = frames.schema["x"].dataType.simpleString() == "array<float>"
    k = F.col("k_run") if "k_run" in frames.columns else F.lit(preset.k_run)
    up = upper if isinstance(upper, Column) else F.lit(float(upper))
    rows = frames.select(
        "seq", F.col("chunk").cast("bigint"), F.col("i").cast("bigint"), F.col("x").cast("array<float>" if narrow else "array<double>"),
        warm(preset, F.col("chunk"), F.col("i")).alias("_warm"), F.coalesce(k.cast("int"), F.lit(2**31 - 1)).alias("_k"),
        F.coalesce(up.cast("double"), F.lit(float("-inf"))).alias("_up"), *(F.col(c).alias(f"_by{n}") for n, c in enumerate(order)),
    )
    by = [f"_by{n}" for n in range(len(order))]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pos, base = object(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            seq = b["seq"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            warm_ = b["_warm"].fill_null(False).to_numpy(zero_copy_only=False)
            places, lp, loop = [], [], []
            for s, e in zip(starts, np.r_[starts[1:], b.num_rows]):
                if seq[s] != now:
                    now, pos = seq[s], 0
                    base = _Database(preset, b["_up"][int(s)].as_py(), b["_k"][int(s)].as_py(), tile)
                x = b["x"].slice(s, e - s).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
                for f in range(0, len(x), block):
                    for out, v in zip((lp, loop), base.decide(x[f : f + block], warm_[s:e][f : f + block])):
                        out.append(v)
                places.append(np.arange(pos, pos + len(x)))
                pos += len(x)
            yield pa.RecordBatch.from_arrays(
                [b["seq"], pa.array(np.concatenate(places)), b["chunk"], b["i"], pa.array(np.concatenate(lp)), pa.array(np.concatenate(loop))],
                names=[c.split()[0] for c in _SCAN.split(", ")],
            )

    return rows.repartition("seq").sortWithinPartitions("seq", *by).mapInArrow(fold, _SCAN)
