"""Consolidating a store of very many small saves into few files of good size (problem 3).

Plan: (1) the valid save of each canonical path by one map-side combined aggregation, in one scan, written once;
(2) small files are counted per bucket, from metadata only; (3) only buckets above the limit are rewritten, each by one
task into one file, by dynamic overwrite below a new snapshot version with a conflict check; (4) readers take the
compacted buckets and, for buckets under the limit, the saves as they are. Buckets are hashes of the path, so that no
directory, however large, is one bucket, and their number follows from the bytes of the valid saves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrail.functions.paths import canonical_path
from placetrail.plans.session import cut, shared_path
from placetrail.sources.snapshots import SnapshotTable

LINE_END = "\r\n|\r|\n"
RECORDS = "path string, file_id bigint, item_no bigint, record string"


def completed(files: DataFrame) -> DataFrame:
    """The complete saves with their canonical path, and ``o``, which orders the saves of one path."""
    complete = (F.octet_length("body") == F.col("n_bytes")) & (F.length(F.regexp_replace("body", "[\r\n]", "")) > 0)
    order = F.struct(F.col("saved_at").isNotNull(), F.coalesce("saved_at", F.lit(0).cast("timestamp")), F.col("file_id"))
    return files.where(complete & F.col("out_path").isNotNull() & F.col("file_id").isNotNull()).select(
        canonical_path(F.col("out_path")).alias("path"), order.alias("o"), "file_id", "n_bytes", "body"
    )


def valid_saves(files: DataFrame) -> DataFrame:
    """The valid save of each file: columns path, file_id, n_bytes, body.

    Paths are compared in canonical form. A save is complete if ``body`` has exactly ``n_bytes`` bytes in UTF-8 and at
    least one line that is not empty. The latest ``saved_at`` wins, null being the earliest, then the largest
    ``file_id``. Rows with a null path, body, n_bytes or file_id are no valid save; repeated rows count once; other
    columns are ignored.
    """
    best = F.max_by(F.struct("file_id", "n_bytes", "body"), "o")  # partial maxima are taken before the shuffle
    return completed(files).groupBy("path").agg(best.alias("s")).select("path", "s.*")


def records(saves: DataFrame) -> DataFrame:
    """One row per line that is not empty, numbered from 0 within its save; other columns stay."""
    lines = F.filter(F.split("body", LINE_END), lambda x: x != "")
    keep = [c for c in saves.columns if c not in ("body", "item_no", "record")]
    return saves.select(*keep, F.posexplode(lines).alias("item_no", "record")).withColumn(
        "item_no", F.col("item_no").cast("bigint")
    )


def compact_saves(
    files: DataFrame,
    root: str | None = None,
    target_bytes: int = 128 << 20,
    small_bytes: int = 16 << 20,
    max_small: int = 4,
) -> tuple[SnapshotTable, DataFrame]:
    """Compact the valid saves of ``files`` into the table at ``root`` (by default a new one in the shared folder).

    A bucket is rewritten if it has more than ``max_small`` saves under ``small_bytes``. Gives the table and all valid
    records (path, file_id, item_no, record, bucket): from the compacted files, and for the other buckets straight from
    the saves. A table that is there already keeps its records, but for paths that ``files`` saves again (the caller gives
    saves later than those in the table). Empty input gives an empty result.
    """
    spark = files.sparkSession
    store = SnapshotTable(spark, root or shared_path(spark, "compact"))
    base = store.version()
    valid = cut(valid_saves(files).select("path", "file_id", F.octet_length("body").cast("bigint").alias("n_bytes"), "body"))
    # the table's number of buckets stays what its first version had
    n = store.property("n_buckets")
    if n is None:
        total = valid.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        n = max(1, -(-int(total) // target_bytes))
    saves = valid.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(n)).cast("int"))
    full = saves.groupBy("bucket").agg(F.count_if(F.col("n_bytes") < small_bytes).alias("n_small")).where(F.col("n_small") > max_small)
    full = cut(full.select("bucket"))
    columns = ("path", "file_id", "item_no", "record", "bucket")
    over = saves.join(full, "bucket", "left_semi").repartition(n, "bucket")
    rows = records(over).select(*columns)
    held = store.buckets(base)
    if held:  # what the table has of these buckets stays, but for paths that were saved again
        old = store.read(base).join(full, "bucket", "left_semi").join(saves.select("path"), "path", "left_anti")
        rows = old.select(*columns).unionByName(rows).repartition(n, "bucket")
    version = store.replace(rows.sortWithinPartitions("bucket", "path", "item_no"), base, properties={"n_buckets": n})
    rest = records(saves.join(full, "bucket", "left_anti")).select(*columns)
    now = store.read(version, RECORDS)
    if held:
        now = now.join(rest.select("path").distinct(), "path", "left_anti")
    return store, now.unionByName(rest)


def compact_table(
    store: SnapshotTable, target_bytes: int = 128 << 20, small_bytes: int = 16 << 20, max_small: int = 4
) -> int:
    """Rewrite the buckets of a snapshot table that hold more than ``max_small`` files under ``small_bytes``.

    Sizes come from the file metadata alone; each such bucket becomes files of about ``target_bytes``. Gives the new
    version, or the present one if no bucket is over the limit. Raises ConflictError if a writer changed one of them.
    """
    base = store.version()
    if base == 0:
        return base
    now = store.read(base)
    sizes = now.select("bucket", "_metadata.file_path", "_metadata.file_size").distinct()
    over = (
        sizes.groupBy("bucket")
        .agg(F.count_if(F.col("file_size") < small_bytes).alias("n_small"), F.sum("file_size").alias("bytes"))
        .where(F.col("n_small") > max_small)
        .select("bucket", F.ceil(F.col("bytes") / target_bytes).cast("int").alias("n_files"))
    )
    rows = now.join(over, "bucket").withColumn("slot", F.pmod(F.xxhash64(*now.columns), F.col("n_files")))
    parts = max(1, over.agg(F.coalesce(F.sum("n_files"), F.lit(0))).first()[0])
    if over.isEmpty():
        return base
    return store.replace(rows.repartition(parts, "bucket", "slot").drop("slot", "n_files"), base)
