"""Readers and writers of files: image folders, CSV evaluations, text logs, descriptor chunks, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placetrail.operators.prefix import row_numbers

EVALUATION = "actual int, pred double"


def read_images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Images of a folder with one sub-folder per class: path, label (rank of the sub-folder), capture_no, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    named = files.select("path", F.element_at(F.split("path", "/"), -2).alias("class"), "content")
    labels = named.select("class").distinct()  # one row per class
    labels = labels.withColumn("label", F.dense_rank().over(Window.orderBy("class")) - 1)
    number = F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).try_cast("bigint")
    return named.join(labels, "class").select("path", "label", number.alias("capture_no"), "content")


def read_splits(spark: SparkSession, folders: dict[str, str], pattern: str = "*") -> DataFrame:
    """Image folders of several splits in one table, with the column ``split``; labels are ranked within each split."""
    parts = [read_images(spark, folder, pattern).withColumn("split", F.lit(name)) for name, folder in folders.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def frame_index(images: DataFrame, order: list[str]) -> DataFrame:
    """``images`` with ``frame_idx``, the loader's order: by ``order``, names compared as strings."""
    return row_numbers(images, order, "frame_idx")


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVALUATION).option("header", "true").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text logs: log (path), pos (from 0), value. A long log is read in splits, and numbered over these."""
    place = F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("log"), *place, "value")
    return row_numbers(rows, ["_start", "_at"], "pos", ["log"]).select("log", "pos", "value")


def save_chunks(descriptors: DataFrame, path: str, keys: list[str]) -> None:
    """Descriptors as a partitioned table; chunks that are saved again replace what stood there, all others stay."""
    (
        descriptors.repartition(*keys)
        .sortWithinPartitions(*keys)
        .write.partitionBy(*keys)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def append_poses(poses: DataFrame, path: str) -> None:
    """Pose texts (column text) added to a log; what stands there stays."""
    poses.select("text").write.mode("append").text(path)


def save_report(records: DataFrame, path: str, order: list[str]) -> None:
    """A report as text files in order. Records are separated by one line end; an empty line before the first is not kept."""
    text = F.regexp_replace("text", r"^\n|\n$", "").alias("text")
    records.repartitionByRange(*order).sortWithinPartitions(*order).select(text).write.mode("overwrite").text(path)


def parse_report(spark: SparkSession, path: str) -> DataFrame:
    """The image numbers of a report in any of the three formats: log, pos, image_number."""
    return read_lines(spark, path).select("log", "pos", F.regexp_extract("value", r"^\s*(?:image: )?(\d+(?:\.\d+)?)\s*$", 1).alias("image_number")).where(
        "image_number <> ''"
    )
