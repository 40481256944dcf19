"""The revisit detection and its source as Structured Streaming jobs."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from placetrail.functions.images import READABLE
from placetrail.operators.scan import belief
from placetrail.plans.presets import Preset
from placetrail.plans.session import shared_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """A table of a data directory as a stream of its files."""
    path = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        s = reader.parquet(path)
    else:
        s = reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
    return s.select(*columns) if columns else s


def throttled_frames(frames: DataFrame, seconds: int = 4, late: str = "1 hour") -> DataFrame:
    """Of each seq the first readable frame of each window by captured_at; repeated deliveries count once.

    Frames later than ``late`` behind the newest are dropped. Columns seq, slot, event_id, capture_no.
    """
    good = frames.where(F.col("image").rlike(READABLE) & F.col("captured_at").isNotNull())
    slot = F.window("captured_at", f"{seconds} seconds")
    return (
        good.withWatermark("captured_at", late)
        .groupBy("seq", slot.alias("slot"))
        .agg(F.min_by(F.struct("event_id", "capture_no"), F.struct("captured_at", "event_id")).alias("m"))
        .select("seq", F.col("slot.start").alias("slot"), "m.*")
    )


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into files in the shared folder (exactly once), and give these."""
    out, spark = shared_path(stream.sparkSession, name), stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{out}/data")
    else:  # the whole result of each batch in place of the last one
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/data"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def near_flags(x: np.ndarray, y: np.ndarray, preset: Preset) -> np.ndarray:
    """Which rows of y each row of x matches."""
    out = np.empty((len(x), len(y)), bool)
    for s in range(0, len(x), 64):
        diff = x[s : s + 64, None] - y[None]
        d = np.sqrt((diff * diff).sum(axis=2)) if preset.norm == "l2" else np.abs(diff).max(axis=2)
        out[s : s + 64] = (d <= preset.limit) & (d > (-np.inf if preset.min_part is None else preset.min_part * preset.limit))
    return out


class Scan(StatefulProcessor):
    """The accepted vectors of one seq as a list of blocks; a micro-batch reads them once and adds its own blocks."""

    BLOCK = 256

    def __init__(self, preset: Preset):
        self.preset = preset

    def init(self, handle) -> None:
        self.held = handle.getListState("held", "width int, vectors binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        p, frames = self.preset, pd.concat(list(rows)).sort_values("pos")
        x = np.stack(frames["x"].to_numpy()).astype(np.float32)
        wide = x.astype(np.float64)
        blocks = [np.frombuffer(v, np.float32).reshape(-1, w) for w, v in self.held.get()]
        before = np.concatenate([np.zeros((len(x), 0), bool), *(near_flags(wide, b.astype(np.float64), p) for b in blocks)], axis=1)
        own = near_flags(wide, wide, p)
        accepted: list[int] = []
        lp = np.zeros(len(x), np.int64)
        for k, (chunk, i) in enumerate(zip(frames["chunk"], frames["i"])):
            warm = p.warmup != "none" and i < 3 and (p.warmup == "per_chunk" or chunk == 0)
            if not warm:
                lp[k] = belief(np.flatnonzero(np.r_[before[k], own[k, accepted]]), p.k_run)
            if lp[k] <= p.more_than:
                accepted.append(k)
        for s in range(0, len(accepted), self.BLOCK):
            part = x[accepted[s : s + self.BLOCK]]
            self.held.appendValue((part.shape[1], part.tobytes()))
        yield pd.DataFrame({"seq": key[0], "pos": frames["pos"].to_numpy(), "lp": lp, "is_loop": lp > p.more_than})

    def close(self) -> None:
        pass


def detect(frames: DataFrame, preset: Preset) -> DataFrame:
    """The suppressed scan on a stream of frames (seq, pos, i, chunk, x): a decision per frame, state per seq.

    Frames of a micro-batch are sorted by pos; one that comes after later ones of its seq were decided is decided at its
    arrival. State: the accepted vectors, a list of blocks to which each micro-batch adds. Needs the RocksDB state store.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = "seq string, pos bigint, lp bigint, is_loop boolean"
    # the worker that sets up the state does not get the files sent to executors: what it needs goes along by value
    modules = [sys.modules[m] for m in (__name__, belief.__module__, Preset.__module__)]
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    try:
        return frames.groupBy("seq").transformWithStateInPandas(Scan(preset), out, "Append", "None")
    finally:
        for m in modules:
            cloudpickle.unregister_pickle_by_value(m)
