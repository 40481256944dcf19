"""Collapsing stretches of repeated consecutive events (problem 2): adjacent agglomeration.

Events are range-partitioned by sequence and order number, so that a sequence with a third of all rows is many
partitions, whatever its numbers are. A partition is read in pieces of bounded size. In a piece each event starts as a run
of one in a linked list, and a priority queue of links joins the most similar neighbouring runs until no link meets the
limits; the last run of a piece stays open for the next one. Only the first and the last run of a partition may go on in
another one: these two rows per partition are joined after.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placetrail.functions.images import PIXELS, close_pixels, decode_images

MIN_CLOSE = 60
MAX_NUMBER_GAP = 1.0
PIECE = 65536

_RUN = (
    "seq string, first_capture_no bigint, last_capture_no bigint, n_frames bigint, "
    "t_min timestamp, t_max timestamp, at_head boolean, at_tail boolean, head_image array<tinyint>, "
    "head_number double, tail_image array<tinyint>, tail_number double"
)


def agglomerate(similarity: np.ndarray) -> np.ndarray:
    """The run of each of n events, from the similarity of each event with the next (negative: they may not join).

    Runs are a linked list, named by their first event; the queue holds the borders between runs, the most similar
    first. Two runs are as similar as the events that face each other, so joining two leaves their outer borders as
    they were, and each border is taken from the queue once.
    """
    n = len(similarity) + 1
    after = list(range(1, n + 1))  # of a run: the run behind it
    last = list(range(n))  # of a run: its last event
    owner = list(range(n))  # of a last event: its run
    queue = [(-s, k) for k, s in enumerate(similarity.tolist()) if s >= 0]
    heapq.heapify(queue)
    while queue:
        _, k = heapq.heappop(queue)
        left = owner[k]
        right = after[left]
        last[left], after[left] = last[right], after[right]
        owner[last[left]] = left
    out, run, number = np.zeros(n, np.int64), 0, 0
    while run < n:
        out[run : last[run] + 1] = number
        run, number = after[run], number + 1
    return out


def _similarities(image, ok, number, same):
    """Similarity of each event with the next of its seq, -1 where they don't agree."""
    a, b = slice(None, -1), slice(1, None)
    both = ok[a] & ok[b]
    close = np.where(both, close_pixels(image[a], image[b]), 0)
    with np.errstate(invalid="ignore"):
        gap = np.abs(number[a] - number[b])
        unknown = np.isnan(number[a]) | np.isnan(number[b])
        seen = both & (close >= MIN_CLOSE) & (unknown | (gap <= MAX_NUMBER_GAP))
        counted = ~both & ~unknown & (number[a] == number[b])
    s = np.where(seen, close / PIXELS, np.where(counted, 1.0, -1.0))
    return np.where(same, s, -1.0)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows in order, in tables of ``rows`` and more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _runs(piece: int):
    none = np.iinfo(np.int64).min

    def runs_of(t: pa.Table) -> tuple[list[dict], pa.Table]:
        """The runs of a piece, and its last event, which also stands first in the next piece."""
        seq = t["seq"].to_numpy(zero_copy_only=False)
        no, event = t["capture_no"].to_numpy(), t["event_id"].to_numpy()
        again = np.zeros(len(no), bool)  # a repeated delivery stands right behind the first one
        again[1:] = (event[1:] == event[:-1]) & (no[1:] == no[:-1]) & (seq[1:] == seq[:-1])
        keep = np.flatnonzero(~again)
        t, seq, no = t.take(pa.array(keep)), seq[keep], no[keep]
        image, ok = decode_images(t["image"])
        number = t["image_number"].to_numpy(zero_copy_only=False).astype(float)
        when = t["captured_at"].cast(pa.timestamp("us", "UTC")).cast(pa.int64()).fill_null(none).to_numpy()
        run = agglomerate(_similarities(image, ok, number, seq[1:] == seq[:-1]))
        start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        end = np.r_[start[1:], len(no)] - 1
        edge = lambda r: {"image": image[r] if ok[r] else None, "number": None if np.isnan(number[r]) else float(number[r])}
        columns = {
            "seq": seq[start].tolist(), "first": no[start].tolist(), "last": no[end].tolist(), "n": (end - start + 1).tolist(),
            "t_min": np.minimum.reduceat(np.where(when == none, np.iinfo(np.int64).max, when), start).tolist(),
            "t_max": np.maximum.reduceat(when, start).tolist(),
        }
        runs = [dict(zip(columns, r)) for r in zip(*columns.values())]
        runs[0]["head"], runs[-1]["tail"] = edge(start[0]), edge(end[-1])
        return runs, t.slice(len(no) - 1)

    def table(runs: list[dict]) -> pa.RecordBatch:
        stamp = pa.timestamp("us", "UTC")
        time = lambda c: pa.array([r[c] if r["t_max"] != none else None for r in runs], pa.int64()).cast(stamp)
        at = {e: [r.get(e) for r in runs] for e in ("head", "tail")}
        edges = []
        for e in ("head", "tail"):
            edges += [
                pa.array([v["image"].tolist() if v and v["image"] is not None else None for v in at[e]], pa.list_(pa.int8())),
                pa.array([v["number"] if v else None for v in at[e]], pa.float64()),
            ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r["seq"] for r in runs], pa.string()),
                *(pa.array([r[c] for r in runs], pa.int64()) for c in ("first", "last", "n")),
                time("t_min"), time("t_max"),
                *(pa.array([v is not None for v in at[e]]) for e in ("head", "tail")), *edges,
            ],
            names=[x.split()[0] for x in _RUN.split(", ")],
        )

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last = None, None
        for t in _pieces(batches, piece):
            before = last
            runs, last = runs_of(t if before is None else pa.concat_tables([before, t]))
            tail = runs[-1].pop("tail")
            if before is None:
                runs[0]["at_start"] = runs[0].pop("head")
            else:  # the first run begins with the last event before, which is counted in the open one
                first = runs[0]
                first.pop("head")
                open_.update(last=first["last"], n=open_["n"] + first["n"] - 1)
                open_.update(t_min=min(open_["t_min"], first["t_min"]), t_max=max(open_["t_max"], first["t_max"]))
                runs[0] = open_
            open_ = runs.pop()
            open_["at_end"] = tail
            if runs:
                yield table([{**r, "head": r.get("at_start")} for r in runs])
        if open_ is not None:
            yield table([{**open_, "head": open_.get("at_start"), "tail": open_["at_end"]}])

    return go


def collapse_runs(events: DataFrame, piece: int = PIECE) -> DataFrame:
    """Each stretch of agreeing consecutive events of a seq as one row, every other event as a row of its own.

    Columns: seq, first_capture_no, last_capture_no, n_frames, started_at, duration_us (between the earliest and the
    latest captured_at of the stretch; null if it has none). Two neighbours in order of capture_no agree if both images
    are readable and near-identical, and their image_numbers, unless one is null, at most 1 apart; or if one image is
    unreadable and the image_numbers are there and equal (not-a-number counts as null). Repeated deliveries of an
    event_id count once, the earliest first. Events without seq or capture_no have no place in a sequence and give no
    row. Further columns of ``events`` are ignored; an empty table gives an empty result.
    """
    rows = (
        events.where(F.col("seq").isNotNull() & F.col("capture_no").isNotNull())
        .select("seq", "capture_no", F.coalesce("event_id", F.lit(-1)).alias("event_id"), "captured_at", "image", "image_number", "arrived")
    )
    runs = (
        rows.repartitionByRange("seq", "capture_no")
        .sortWithinPartitions("seq", "capture_no", "event_id", "arrived")
        .drop("arrived")
        .mapInArrow(_runs(piece), _RUN)
    )
    w = Window.partitionBy("seq").orderBy("first_capture_no", "last_capture_no")
    close = F.size(F.filter(F.zip_with("before_image", "head_image", lambda a, b: F.abs(a - b)), lambda x: x <= 1))
    both = F.col("before_image").isNotNull() & F.col("head_image").isNotNull()
    numbers = F.col("before_number").isNull() | F.col("head_number").isNull()
    agrees = F.when(
        both, (close >= MIN_CLOSE) & (numbers | (F.abs(F.col("before_number") - F.col("head_number")) <= MAX_NUMBER_GAP))
    ).otherwise(F.coalesce(F.col("before_number") == F.col("head_number"), F.lit(False)))
    joined = F.col("at_head") & F.coalesce(F.lag("at_tail").over(w), F.lit(False)) & agrees
    edges = (
        runs.where("at_head or at_tail")  # two rows a partition
        .withColumn("before_image", F.lag("tail_image").over(w))
        .withColumn("before_number", F.lag("tail_number").over(w))
        .withColumn("island", F.sum(F.when(joined, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("seq", "island")
        .agg(*(f(c).alias(c) for f, c in ((F.min, "first_capture_no"), (F.max, "last_capture_no"), (F.sum, "n_frames"), (F.min, "t_min"), (F.max, "t_max"))))
        .drop("island")
    )
    return (
        runs.where("not at_head and not at_tail")
        .select(*edges.columns)
        .unionByName(edges)
        .select(
            "seq", "first_capture_no", "last_capture_no", "n_frames", F.col("t_min").alias("started_at"),
            (F.unix_micros("t_max") - F.unix_micros("t_min")).alias("duration_us"),
        )
    )
