"""Chunks of a frame sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrail.plans.presets import Preset


def assign_chunks(frames: DataFrame, preset: Preset, index: str = "frame_idx") -> DataFrame:
    """Each frame with its chunk (from 0) and its place ``i`` in it.

    Chunk n holds the frames n*S+1 .. (n+1)*S, and in mode ``inclusive`` also (n+1)*S+1, which then stands in two
    chunks; frame 0 is in none. With ``drop_partial`` an inclusive chunk whose last frame never came is lost.
    """
    s = preset.chunk_size
    idx = F.col(index)
    own = F.floor((idx - 1) / s)
    if preset.chunk_mode == "half_open":
        return frames.where(idx >= 1).withColumn("chunk", own).withColumn("i", idx - 1 - own * s)
    both = F.when((idx > s) & (idx % s == 1), F.array(own, own - 1)).otherwise(F.array(own))
    out = frames.where(idx >= 1).withColumn("chunk", F.explode(both)).withColumn("i", idx - 1 - F.col("chunk") * s)
    if preset.drop_partial:
        last = frames.agg(F.max(index).alias("last"))  # one row
        out = out.crossJoin(F.broadcast(last)).where((F.col("chunk") + 1) * s + 1 <= F.col("last")).drop("last")
    return out


def chunk_status(frames: DataFrame, preset: Preset, index: str = "frame_idx") -> DataFrame:
    """Each chunk with its number of frames and whether it was saved: chunk, n_frames, saved.

    An inclusive chunk that lacks its last frame is never saved where ``drop_partial`` holds; all others are.
    """
    wanted = preset.chunk_size + (preset.chunk_mode == "inclusive")
    per = assign_chunks(frames, preset.but(drop_partial=False), index).groupBy("chunk").agg(F.count("*").alias("n_frames"), F.max("i").alias("last_i"))
    lost = F.lit(preset.drop_partial and preset.chunk_mode == "inclusive") & (F.col("last_i") < wanted - 1)
    return per.select("chunk", "n_frames", (~lost).cast("int").alias("saved"))


def union_chunks(chunked: DataFrame, preset: Preset) -> DataFrame:
    """The chunks that a preset scans, in scan order; frames that stand in two chunks stay twice.

    ``place`` is the chunk's place in the list of scanned chunks: behind a hole it is less than the chunk.
    """
    out = chunked
    if preset.chunks_scanned is not None:
        out = out.where(F.col("chunk") < preset.chunks_scanned)
    if preset.excluded_chunks:
        out = out.where(~F.col("chunk").isin(*preset.excluded_chunks))
    skipped = sum((F.when(F.col("chunk") > c, 1).otherwise(0) for c in preset.excluded_chunks), F.lit(0))
    return out.withColumn("place", F.col("chunk") - skipped)


def scan_order(frames: DataFrame, preset: Preset, index: str = "frame_idx") -> DataFrame:
    """The frames as a preset scans them, chunk list after chunk list: with chunk (its place in the list), i and pos.

    ``pos`` orders the scan; a frame that neighbouring chunks share has two. It needs no numbering over all rows.
    """
    listed = union_chunks(assign_chunks(frames, preset, index), preset).drop("chunk").withColumnRenamed("place", "chunk")
    return listed.withColumn("pos", F.col("chunk") * (preset.chunk_size + 1) + F.col("i"))
