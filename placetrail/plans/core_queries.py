"""Registered queries of the core, and the SQL that each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrail.functions import arrays
from placetrail.functions.images import READABLE
from placetrail.functions.pixels import embed
from placetrail.operators import chunks, evaluation, history, pairs, poses, scan
from placetrail.operators.compaction import RECORDS, compact_saves, compact_table, records, valid_saves
from placetrail.plans.presets import PRESETS, Preset
from placetrail.plans.session import shared_path
from placetrail.sources import files
from placetrail.sources.snapshots import SnapshotTable
from placetrail.sources.tables import table
from placetrail.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _six(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- frames, chunks, halves ------------------------------------------------------------------------------------------


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as one sequence: chunk and place by hundreds."""
    e = table(spark, d, "embeddings")
    return e.select(
        F.lit("embeddings").alias("seq"),
        F.col("vec_id").alias("pos"),
        F.floor(F.col("vec_id") / 100).alias("chunk"),
        (F.col("vec_id") % 100).alias("i"),
        F.col("embedding").alias("x"),
        "label",
    )


@query("SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS frame_idx FROM embeddings")
def frame_index(spark: SparkSession, d: str) -> DataFrame:
    return files.frame_index(table(spark, d, "embeddings", "vec_id", "label"), ["label", "vec_id"])


_INCLUSIVE = """
SELECT vec_id, n - 1 AS chunk, vec_id - ((n - 1) * 100 + 1) AS i FROM embeddings, (SELECT unnest(range(1, 1000)) AS n)
WHERE vec_id BETWEEN (n - 1) * 100 + 1 AND n * 100 + 1"""


@query(_INCLUSIVE + " AND n * 100 + 1 <= (SELECT max(vec_id) FROM embeddings)")
def chunk_assign_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return chunks.assign_chunks(table(spark, d, "embeddings", "vec_id"), Preset(), "vec_id").select("vec_id", "chunk", "i")


@query(_INCLUSIVE)
def chunk_assign_keep_partial(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "embeddings", "vec_id")
    return chunks.assign_chunks(frames, Preset(drop_partial=False), "vec_id").select("vec_id", "chunk", "i")


@query("SELECT vec_id, (vec_id - 1) // 100 AS chunk, (vec_id - 1) % 100 AS i FROM embeddings WHERE vec_id >= 1")
def chunk_assign_half_open(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "embeddings", "vec_id")
    return chunks.assign_chunks(frames, Preset(chunk_mode="half_open"), "vec_id").select("vec_id", "chunk", "i")


@query(f"""SELECT chunk, count(*) AS n_frames, (max(i) >= 100)::INT AS saved FROM ({_INCLUSIVE}) GROUP BY chunk""")
def chunk_status(spark: SparkSession, d: str) -> DataFrame:
    """Which chunks were saved and which were lost with their last frame."""
    return chunks.chunk_status(table(spark, d, "embeddings", "vec_id"), Preset(), "vec_id")


@query("SELECT vec_id, vec_id // 100 AS chunk, vec_id % 100 AS i FROM embeddings WHERE vec_id // 100 NOT IN (2, 4)")
def chunk_union(spark: SparkSession, d: str) -> DataFrame:
    preset = Preset(excluded_chunks=(2, 4))
    return chunks.union_chunks(_frames(spark, d), preset).select(F.col("pos").alias("vec_id"), "chunk", "i")


@query("SELECT vec_id, vec_id // 100 AS chunk, vec_id % 100 AS i FROM embeddings WHERE vec_id // 100 <> 2")
def chunk_union_all(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of the table but one."""
    return chunks.union_chunks(_frames(spark, d), Preset(excluded_chunks=(2,))).select(F.col("pos").alias("vec_id"), "chunk", "i")


@query("""
SELECT seq, count(*) AS n_frames, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame
FROM (SELECT DISTINCT out_id, seq, frame_idx FROM descriptor WHERE seq IS NOT NULL) GROUP BY seq""")
def chunk_store(spark: SparkSession, d: str) -> DataFrame:
    """Save descriptors by sequence with dynamic overwrite, save one part again, read back."""
    path = shared_path(spark, "chunks")
    rows = table(spark, d, "descriptor", "out_id", "seq", "frame_idx", "outputs").where("seq is not null")
    rows = rows.dropDuplicates(["out_id"])
    files.save_chunks(rows, path, ["seq"])
    files.save_chunks(rows.where("seq like 'depot%'"), path, ["seq"])
    back = spark.read.schema("out_id bigint, frame_idx bigint, outputs array<float>, seq string").parquet(path)
    return back.groupBy("seq").agg(
        F.count("*").alias("n_frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame")
    )


def _side() -> Column:
    letter = F.upper(F.substring(F.trim("side"), 1, 1))
    return F.when(letter.isin("R", "L"), letter)


@query("""
WITH h AS (SELECT DISTINCT half_id, seq, frame_idx, model, upper(left(trim(side), 1)) AS s, coalesce(output8, outputs) AS x
           FROM half_descriptor WHERE coalesce(output8, outputs) IS NOT NULL)
SELECT r.half_id AS right_id, l.half_id AS left_id, len(r.x) + len(l.x) AS width,
  round(list_concat(r.x, l.x)[1]::DOUBLE, 6) AS first_value
FROM h r JOIN h l ON r.seq = l.seq AND r.frame_idx = l.frame_idx AND r.model = l.model AND r.s = 'R' AND l.s = 'L'""")
def half_concat(spark: SparkSession, d: str) -> DataFrame:
    """Right and left halves of a frame joined to one descriptor, right first."""
    h = table(spark, d, "half_descriptor").where("coalesce(output8, outputs) is not null").dropDuplicates(["half_id"])
    h = h.select("half_id", "seq", "frame_idx", "model", _side().alias("s"), F.coalesce("output8", "outputs").alias("x"))
    keys = ["seq", "frame_idx", "model"]
    right = h.where("s = 'R'").select(*keys, F.col("half_id").alias("right_id"), F.col("x").alias("rx"))
    left = h.where("s = 'L'").select(*keys, F.col("half_id").alias("left_id"), F.col("x").alias("lx"))
    both = right.join(left, keys).withColumn("x", F.concat("rx", "lx"))
    return both.select(
        "right_id", "left_id", F.size("x").cast("bigint").alias("width"), _six(F.get("x", F.lit(0)).cast("double")).alias("first_value")
    )


@query("""
SELECT r.vec_id, len(list_concat(r.h, l.h)) AS width, round(list_concat(r.h, l.h)[1]::DOUBLE, 6) AS first_value,
  round(list_concat(r.h, l.h)[64]::DOUBLE, 6) AS last_value
FROM (SELECT vec_id, embedding[1:32] AS h FROM embeddings) r JOIN (SELECT vec_id, embedding[33:64] AS h FROM embeddings) l USING (vec_id)""")
def half_split_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    right, left = (e.select("vec_id", F.slice("embedding", s, 32).alias(n)) for s, n in ((1, "rx"), (33, "lx")))
    x = right.join(left, "vec_id").select("vec_id", F.concat("rx", "lx").alias("x"))
    at = lambda k: _six(F.get("x", F.lit(k)).cast("double"))
    return x.select("vec_id", F.size("x").cast("bigint").alias("width"), at(0).alias("first_value"), at(63).alias("last_value"))


@query("""
SELECT coalesce(model, 'unknown') AS model, count(*) AS n_halves, count(DISTINCT seq) AS n_seqs, max(len(coalesce(output8, outputs))) AS width
FROM (SELECT DISTINCT half_id, model, seq, output8, outputs FROM half_descriptor) GROUP BY 1""")
def model_inventory(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "half_descriptor").dropDuplicates(["half_id"])
    return h.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(
        F.count("*").alias("n_halves"),
        F.count_distinct("seq").alias("n_seqs"),
        F.max(F.size(F.coalesce("output8", "outputs"))).cast("bigint").alias("width"),
    )


# --- pixels and vectors ----------------------------------------------------------------------------------------------


@query("""
SELECT vec_id, p - 1 AS pos, round((embedding[p]::DOUBLE - 0.36) / 0.28, 6) AS value
FROM embeddings, (SELECT unnest(range(1, 65)) AS p)""")
def normalize_pixels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    out = e.select("vec_id", F.posexplode(arrays.normalize(F.col("embedding"))).alias("pos", "value"))
    return out.select("vec_id", F.col("pos").cast("bigint"), _six("value").alias("value"))


@query("""
SELECT event_id, round(list_avg(l), 6) AS mean_level, round(list_min(l), 6) AS min_level, round(list_max(l), 6) AS max_level
FROM (SELECT event_id, list_transform(range(1, 65), lambda k: ((instr('0123456789abcdef', lower(right(image, 64))[k]) - 1) * 17 / 255.0 - 0.36) / 0.28) AS l
      FROM (SELECT DISTINCT event_id, image FROM frame_event WHERE regexp_full_match(image, '(0x)?[0-9a-fA-F]{64}')))""")
def pixel_tensor(spark: SparkSession, d: str) -> DataFrame:
    """Readable thumbnails as normalised pixels: scaled to 0..1, then mean 0.36 and deviation 0.28."""
    f = table(spark, d, "frame_event", "event_id", "image").where(F.col("image").rlike(READABLE)).dropDuplicates(["event_id"])
    digits = F.filter(F.split(F.lower(F.right("image", F.lit(64))), ""), lambda c: c != "")
    levels = F.transform(digits, lambda c: (F.instr(F.lit("0123456789abcdef"), c) - 1) * 17)
    x = arrays.normalize(arrays.scale_pixels(levels))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    return f.select("event_id", x.alias("x")).select(
        "event_id", _six(mean).alias("mean_level"), _six(F.array_min("x")).alias("min_level"), _six(F.array_max("x")).alias("max_level")
    )


@query("""
SELECT vec_id, r AS pos, round(embedding[r + 1]::DOUBLE, 6) AS value
FROM embeddings, (SELECT unnest(range(0, 64)) AS r)""")
def flatten_vector(spark: SparkSession, d: str) -> DataFrame:
    rows = arrays.grid(F.col("embedding"), 8)
    flat = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode(F.flatten(rows)).alias("pos", "value"))
    return flat.select("vec_id", F.col("pos").cast("bigint"), _six(F.col("value").cast("double")).alias("value"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS class, round(list_max(embedding)::DOUBLE, 6) AS score FROM embeddings")
def argmax_class(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    x = F.col("embedding")
    return e.select("vec_id", arrays.argmax(x).cast("bigint").alias("class"), _six(F.array_max(x).cast("double")).alias("score"))


def _crop_sql(left: int, name: str, size: int) -> str:
    cell = f"CASE WHEN c + {left} < 8 THEN embedding[(r + 1) * 8 + c + {left} + 1]::DOUBLE ELSE 0 END"
    return f"round({cell}, 6) AS {name}" if size else cell


def _crops(spark: SparkSession, d: str, width: int) -> DataFrame:
    """Right and left window of the vector seen as 8 x 8 pixels; they overlap in one column, the lower half is unused."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    x = F.col("embedding")
    right, left = (arrays.crop(x, 8, 1, at, 3, width) for at in (4, 1))
    both = e.select("vec_id", F.posexplode(F.arrays_zip(right.alias("r"), left.alias("l"))).alias("pos", "z"))
    return both.select("vec_id", F.col("pos").cast("bigint"), _six("z.r").alias("right_value"), _six("z.l").alias("left_value"))


@query(f"""SELECT vec_id, r * 4 + c AS pos, {_crop_sql(4, 'right_value', 8)}, {_crop_sql(1, 'left_value', 8)}
FROM embeddings, (SELECT unnest(range(0, 3)) AS r), (SELECT unnest(range(0, 4)) AS c)""")
def crop_right_left(spark: SparkSession, d: str) -> DataFrame:
    return _crops(spark, d, 4)


@query(f"""SELECT vec_id, r * 6 + c AS pos, {_crop_sql(4, 'right_value', 8)}, {_crop_sql(1, 'left_value', 8)}
FROM embeddings, (SELECT unnest(range(0, 3)) AS r), (SELECT unnest(range(0, 6)) AS c)""")
def crop_padded(spark: SparkSession, d: str) -> DataFrame:
    """Windows that reach beyond the image, padded with 0."""
    return _crops(spark, d, 6)


# a resized pixel mixes its neighbours by their distance; windows of 31 pixels from row 1 and columns 31 and 1, cells of 8 (the last of 7)
@query("""WITH im AS (SELECT DISTINCT event_id, lower(right(image, 64)) AS h FROM frame_event WHERE regexp_full_match(image, '(0x)?[0-9a-fA-F]{64}')),
px AS (SELECT event_id, i, j, 17 * (instr('0123456789abcdef', h[i * 8 + j + 1]) - 1) AS v FROM im, range(8) a(i), range(8) b(j)),
taps AS (SELECT r, i, greatest(0, 1 - abs(least(greatest((r + 0.5::DOUBLE) / 8 - 0.5::DOUBLE, 0), 7) - i)) AS w FROM range(64) a(r), range(8) b(i)),
part AS (SELECT start, (r - start) // 8 AS cell, i, avg(w) AS w FROM taps, (VALUES (1), (31)) s(start) WHERE r BETWEEN start AND start + 30 GROUP BY ALL),
y AS (SELECT i, cell AS row_cell, w AS rw FROM part WHERE start = 1 AND w > 0),
x AS (SELECT i AS j, start, cell AS col_cell, w AS cw FROM part WHERE w > 0),
m AS (SELECT event_id, start, row_cell, col_cell, (sum(v * rw * cw) / 255 - 0.36) / 0.28 AS value FROM px JOIN y USING (i) JOIN x USING (j) GROUP BY ALL)
SELECT event_id, count(*) AS width, round(sum(value), 4) AS total FROM m GROUP BY event_id""")
def embed_stub_images(spark: SparkSession, d: str) -> DataFrame:
    """Thumbnails as image files through decode, resize, both crops, normalisation and a stand-in network."""
    f = table(spark, d, "frame_event", "event_id", "image").where(F.col("image").rlike(READABLE)).dropDuplicates(["event_id"])
    digits = F.regexp_replace(F.right("image", F.lit(64)), "(.)", "$1$1")  # a level and its 17-fold byte
    content = F.concat(F.lit(b"P5 8 8 255\n"), F.unhex(digits))
    x = f.select(F.col("event_id").alias("id"), content.alias("content")).mapInArrow(embed(size=64, side=31), "id bigint, x array<double>")
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return x.select(F.col("id").alias("event_id"), F.size("x").cast("bigint").alias("width"), F.round(total, 4).alias("total"))


# --- distances and the scan -----------------------------------------------------------------------------------------


_V = "v AS (SELECT vec_id, list_transform(embedding, lambda t: t::DOUBLE) AS x, label FROM embeddings)"
_D = {"l2": "list_distance(a.x, b.x)", "linf": "list_max(list_transform(list_zip(a.x, b.x), lambda t: abs(t[1] - t[2])))"}


def _pairs_sql(norm: str, v: str = _V) -> str:
    return f"{v}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, {_D[norm]} AS d FROM v a JOIN v b ON b.vec_id < a.vec_id)"


def _nearest(spark: SparkSession, d: str, norm: str) -> DataFrame:
    every = pairs.earlier_extent(_frames(spark, d), norm)
    return every.select("i", F.col("n").alias("n_earlier"), _six("nearest").alias("nearest"), _six("farthest").alias("farthest"))


_NEAREST = " SELECT i, count(*) AS n_earlier, round(min(d), 6) AS nearest, round(max(d), 6) AS farthest FROM p GROUP BY i"


@query(f"WITH {_pairs_sql('l2')}{_NEAREST}")
def pairwise_l2(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, "l2")


@query(f"WITH {_pairs_sql('linf')}{_NEAREST}")
def pairwise_linf(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, "linf")


def _near(spark: SparkSession, d: str, preset: Preset) -> DataFrame:
    low = None if preset.min_part is None else preset.min_part * preset.limit
    return pairs.earlier_pairs(_frames(spark, d), preset.norm, preset.limit, low)


@query(f"WITH {_pairs_sql('l2')} SELECT i, j, round(d, 6) AS d FROM p WHERE d <= 1.25")
def match_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, Preset(limit=1.25)).select("i", "j", _six("d").alias("d"))


@query(f"WITH {_pairs_sql('l2')} SELECT i, count(*) AS n, round(min(d), 6) AS nearest FROM p WHERE d > 0.93 * 1.35 AND d <= 1.35 GROUP BY i")
def match_band(spark: SparkSession, d: str) -> DataFrame:
    band = _near(spark, d, Preset(limit=1.35, min_part=0.93))
    return band.groupBy("i").agg(F.count("*").alias("n"), _six(F.min("d")).alias("nearest"))


@query(f"WITH {_V} SELECT a.vec_id, round({_D['l2']}, 6) AS l2, round({_D['linf']}, 6) AS linf FROM v a, (SELECT x FROM v ORDER BY vec_id LIMIT 1) b")
def one_vs_all_probe(spark: SparkSession, d: str) -> DataFrame:
    frames = _frames(spark, d)
    first = frames.agg(F.min_by("x", "pos").alias("x"))
    both = pairs.probe(frames, first, lambda a, b: F.struct(arrays.l2(a, b).alias("l2"), arrays.linf(a, b).alias("linf")))
    return both.select(F.col("pos").alias("vec_id"), _six("d.l2").alias("l2"), _six("d.linf").alias("linf"))


@query(f"""WITH {_pairs_sql('l2')}, g AS (SELECT i, j, j - row_number() OVER (PARTITION BY i ORDER BY j) AS isl FROM p WHERE d <= 1.30),
n AS (SELECT i, isl, count(*) AS n FROM g GROUP BY i, isl) SELECT i, sum(greatest(0, n - 2))::BIGINT AS lp FROM n GROUP BY i""")
def belief_fixed_db(spark: SparkSession, d: str) -> DataFrame:
    return scan.belief_fixed_database(_near(spark, d, Preset(limit=1.30)), 3).select("i", F.col("lp").cast("bigint"))


def _scan_sql(p: Preset, tail: str, v: str = _V, width: int = 100) -> str:
    low = "" if p.min_part is None else f" AND d > {p.min_part} * {p.limit}"
    warm = {"per_chunk": "f.i < 3", "first_chunk": "(f.i < 3 AND f.chunk = 0)", "none": "false"}[p.warmup]
    flags = "list_transform(r.db, lambda q: CASE WHEN list_contains(f.ms, q) THEN '1' ELSE '0' END)"
    lp = f"coalesce(list_sum(list_transform(string_split(array_to_string({flags}, ''), '0'), lambda s: greatest(length(s) - {p.k_run - 1}, 0))), 0)"
    return f"""
WITH RECURSIVE {_pairs_sql(p.norm, v)},
m AS MATERIALIZED (SELECT i, list(j ORDER BY j) AS ms FROM p WHERE d <= {p.limit}{low} GROUP BY i),
f AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn, vec_id // {width} AS chunk, vec_id % {width} AS i, label, coalesce(ms, []) AS ms
      FROM v LEFT JOIN m ON m.i = vec_id),
r(rn, db, vec_id, chunk, i, label, lp, is_loop) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::INTEGER, 0::BIGINT, false
  UNION ALL
  SELECT rn, CASE WHEN lp > {p.more_than} THEN db ELSE list_append(db, vec_id) END, vec_id, chunk, i, label, lp, lp > {p.more_than} FROM (
    SELECT f.rn, r.db, f.vec_id, f.chunk, f.i, f.label, (CASE WHEN {warm} THEN 0 ELSE {lp} END)::BIGINT AS lp FROM r JOIN f ON f.rn = r.rn + 1))
{tail}"""


_LOOPS = "SELECT vec_id, chunk, i, lp FROM r WHERE is_loop"


def _scanned(frames: DataFrame, preset: Preset) -> DataFrame:
    low = None if preset.min_part is None else preset.min_part * preset.limit
    return scan.suppressed_scan(frames, pairs.earlier_runs(frames, preset.norm, preset.limit, low), preset)


def _scan(spark: SparkSession, d: str, preset: Preset) -> DataFrame:
    return _scanned(_frames(spark, d), preset)


def _loops(preset: Preset) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _scan(spark, d, preset).where("is_loop").select(F.col("pos").alias("vec_id"), "chunk", "i", "lp")

    return run


_L2 = Preset(limit=1.30)
for _name, _preset in {
    "loop_scan_l2": _L2,
    "loop_scan_l2_tight": Preset(limit=1.25),
    "loop_scan_linf": Preset(norm="linf", limit=0.38),
    "loop_scan_band": Preset(limit=1.35, min_part=0.93),
    "loop_scan_warmup_first": _L2.but(warmup="first_chunk"),
    "loop_scan_no_warmup": _L2.but(warmup="none"),
    "loop_scan_gt1": _L2.but(more_than=1),
    "loop_scan_k5": Preset(limit=1.35, k_run=5),
    "loop_scan_k30": Preset(limit=1.55, k_run=30),
}.items():
    QUERIES[_name], SQL[_name] = _loops(_preset), _scan_sql(_preset, _LOOPS)


@query(_scan_sql(_L2, "SELECT vec_id, chunk, i FROM r WHERE vec_id IS NOT NULL AND NOT is_loop"))
def keyframes(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, _L2).where("not is_loop").select(F.col("pos").alias("vec_id"), "chunk", "i")


@query(_scan_sql(_L2, "SELECT vec_id, label, is_loop::INT AS pred FROM r WHERE vec_id IS NOT NULL"))
def loop_vs_truth(spark: SparkSession, d: str) -> DataFrame:
    """Every frame with its label and whether it was reported (null-safe join of report and truth)."""
    loops = _scan(spark, d, _L2).where("is_loop").select(F.col("pos").alias("vec_id"))
    truth = table(spark, d, "embeddings", "vec_id", "label")
    return evaluation.against_truth(loops, truth, "vec_id").select("vec_id", "label", "pred")


def _preset_sql(p: Preset) -> str:
    s = p.chunk_size
    hole = f" AND n - 1 NOT IN ({', '.join(map(str, p.excluded_chunks))})" if p.excluded_chunks else ""
    skipped = "".join(f" - (n - 1 > {c})::INT" for c in p.excluded_chunks)
    v = f"""v AS (SELECT (n - 1{skipped}) * {s + 1} + vec_id - ((n - 1) * {s} + 1) AS vec_id, list_transform(embedding, lambda t: t::DOUBLE) AS x, label
FROM embeddings, (SELECT unnest(range(1, 1000)) AS n) WHERE vec_id BETWEEN (n - 1) * {s} + 1 AND n * {s} + 1 AND n * {s} + 1 <= (SELECT max(vec_id) FROM embeddings){hole})"""
    number = f"(chunk + {p.base}) * {p.stride} + i"
    number = f"round_even(({number}) / 2, 0)" if p.halve else number
    return _scan_sql(p, f"SELECT chunk, i, lp, ({number})::VARCHAR AS image_number FROM r WHERE is_loop", v, s + 1)


def _preset(preset: Preset) -> Query:
    """A preset from the chunks on: shared frames, holes, the scan over the list of chunks, image numbers."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "embeddings", "vec_id", "embedding")
        frames = e.select(F.lit("embeddings").alias("seq"), "vec_id", F.col("embedding").alias("x"))
        loops = _scanned(chunks.scan_order(frames, preset, "vec_id"), preset).where("is_loop")
        return loops.select("chunk", "i", "lp", arrays.image_number(preset, F.col("chunk"), F.col("i")).alias("image_number"))

    return run


#: Published presets with limits that fit these vectors, over as many chunks as there are.
for _name, _preset_ in {
    "preset_kitti05_resnet": PRESETS["kitti05_resnet"].but(limit=0.38, chunks_scanned=None),
    "preset_tum_vgg16_adapted": PRESETS["tum_vgg16_adapted"].but(limit=1.35, min_part=0.93, chunks_scanned=None),
    "preset_tum_vit": PRESETS["tum_vit"].but(limit=1.30, chunks_scanned=None, excluded_chunks=(5,)),
}.items():
    QUERIES[_name], SQL[_name] = _preset(_preset_), _preset_sql(_preset_)


_FLAGS = "list_transform(r.db, lambda q: CASE WHEN list_contains(f.ms, q) THEN '1' ELSE '0' END)"


@query(f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY chunk, i, out_id) - 1 AS pos, i, list_transform(outputs, lambda t: t::DOUBLE) AS x, dist_limit, k_run
  FROM (SELECT DISTINCT out_id, seq, coalesce(chunk, -1) AS chunk, coalesce(i, -1) AS i, outputs FROM descriptor
    WHERE seq IS NOT NULL AND len(outputs) = 64 AND list_aggregate(list_transform(outputs, lambda t: (t IS NOT NULL AND isfinite(t))::INT), 'min') = 1)
  JOIN seq_info USING (seq)),
m AS MATERIALIZED (SELECT a.seq, a.pos, list(b.pos ORDER BY b.pos) AS ms FROM v a JOIN v b
  ON a.seq = b.seq AND b.pos < a.pos AND list_distance(a.x, b.x) <= a.dist_limit GROUP BY a.seq, a.pos),
f AS MATERIALIZED (SELECT seq, pos, i, k_run, coalesce(ms, []) AS ms FROM v LEFT JOIN m USING (seq, pos)),
r(seq, pos, db, lp, is_loop) AS (
  SELECT DISTINCT seq, -1::BIGINT, []::BIGINT[], 0::BIGINT, false FROM v
  UNION ALL
  SELECT seq, pos, CASE WHEN lp > 0 THEN db ELSE list_append(db, pos) END, lp, lp > 0 FROM (
    SELECT f.seq, f.pos, r.db, (CASE WHEN f.i < 3 THEN 0 ELSE coalesce(list_sum(list_transform(
      string_split(array_to_string({_FLAGS}, ''), '0'), lambda s: greatest(length(s) - f.k_run + 1, 0))), 0) END)::BIGINT AS lp
    FROM r JOIN f ON f.seq = r.seq AND f.pos = r.pos + 1))
SELECT seq, count(*) AS n_frames, count(*) FILTER (is_loop) AS n_loops, sum(lp)::BIGINT AS lp FROM r WHERE pos >= 0 GROUP BY seq""")
def loop_scan_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The scan over all recorded sequences at once, each with its own limit and run length."""
    info = table(spark, d, "seq_info", "seq", "dist_limit", "k_run")
    rows = table(spark, d, "descriptor", "out_id", "seq", "chunk", "i", "outputs").where(
        "seq is not null and size(outputs) = 64 and not exists(outputs, v -> v is null or isnan(v) or abs(v) = float('infinity'))"
    )
    rows = rows.dropDuplicates(["out_id"]).join(F.broadcast(info), "seq")  # seq_info does not grow
    rows = rows.withColumn("chunk", F.coalesce("chunk", F.lit(-1))).withColumn("i", F.coalesce("i", F.lit(-1)))
    frames = rows.withColumnRenamed("outputs", "x")
    out = scan.vector_scan(frames, ["chunk", "i", "out_id"], Preset(), F.col("dist_limit"))
    return out.groupBy("seq").agg(F.count("*").alias("n_frames"), F.count_if("is_loop").alias("n_loops"), F.sum("lp").alias("lp"))


_NUMBERS = {
    "image_number_raw": (Preset(base=1), "((chunk + 1) * 100 + i)::VARCHAR"),
    "image_number_half_even": (Preset(halve=True), "round_even((chunk * 100 + i) / 2, 0)::VARCHAR"),
    "image_number_trunc_offsets": (
        Preset(offsets=(None, 221, 441, 661)),
        "coalesce((i + [NULL, 221, 441, 661][chunk + 1]) // 2, i)::VARCHAR",
    ),
}


def _numbers(preset: Preset) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = _frames(spark, d)
        return f.select(F.col("pos").alias("vec_id"), arrays.image_number(preset, F.col("chunk"), F.col("i")).alias("image_number"))

    return run


for _name, (_preset, _sql) in _NUMBERS.items():
    QUERIES[_name] = _numbers(_preset)
    SQL[_name] = f"SELECT vec_id, {_sql} AS image_number FROM (SELECT vec_id, vec_id // 100 AS chunk, vec_id % 100 AS i FROM embeddings)"


def _report(preset: Preset) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        loops = _scan(spark, d, preset).where("is_loop")
        number = arrays.image_number(preset, F.col("chunk"), F.col("i"))
        return loops.select(F.col("pos").alias("vec_id"), arrays.report_record(preset, number).alias("text"))

    return run


_REPORTS = {
    "loop_report_a": (_L2.but(report="a", halve=True), "chr(10) || ' Found loop' || chr(10) || ' image: ' || round_even((chunk * 100 + i) / 2, 0)::VARCHAR"),
    "loop_report_b": (_L2.but(report="b", base=1), "'Found loop' || chr(10) || ' image: ' || ((chunk + 1) * 100 + i)::VARCHAR || chr(10)"),
    "loop_report_c": (
        _L2.but(report="c", offsets=(None, 221, 441, 661)),
        "chr(10) || ' Found loop' || chr(10) || coalesce((i + [NULL, 221, 441, 661][chunk + 1]) // 2, i)::VARCHAR",
    ),
}
for _name, (_preset, _sql) in _REPORTS.items():
    QUERIES[_name], SQL[_name] = _report(_preset), _scan_sql(_preset, f"SELECT vec_id, {_sql} AS text FROM r WHERE is_loop")


@query(_scan_sql(_L2, "SELECT round_even((chunk * 100 + i) / 2, 0)::VARCHAR AS image_number, count(*) AS n FROM r WHERE is_loop GROUP BY 1"))
def report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A report written as text and parsed again, with the number of reports of each image."""
    path = shared_path(spark, "report")
    files.save_report(_report(_L2.but(report="a", halve=True))(spark, d), path, ["vec_id"])
    return files.parse_report(spark, path).groupBy("image_number").agg(F.count("*").alias("n"))


# --- evaluation ------------------------------------------------------------------------------------------------------


_EVAL = "(SELECT event_type, (event_type = 'purchase')::INT AS actual, (value > 50)::INT AS pred, value AS score FROM events)"


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    return e.select(
        "event_type", (F.col("user_id") % 10).alias("part"), (F.col("event_type") == "purchase").cast("int").alias("actual"),
        (F.col("value") > 50).cast("int").alias("pred"), F.col("value").alias("score"),
    )


_ACC = """count(*) AS n, round(avg((actual = pred)::INT), 6) AS accuracy, round(coalesce(2.0 * count(*) FILTER (actual = 1 AND pred = 1)
 / nullif(2 * count(*) FILTER (actual = 1 AND pred = 1) + count(*) FILTER (actual <> pred), 0), 0), 6) AS f1"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _six(c) for c in columns})


@query(f"SELECT {_ACC} FROM {_EVAL} WHERE actual IS NOT NULL AND pred IS NOT NULL")
def accuracy_f1(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.accuracy_f1(_evaluated(spark, d)), "accuracy", "f1")


@query(f"SELECT {_ACC} FROM {_EVAL} WHERE actual IS NOT NULL AND pred IS NOT NULL")
def accuracy_from_csv(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation table written as CSV and read with its declared schema."""
    path = shared_path(spark, "evaluation")
    _evaluated(spark, d).select("actual", F.col("pred").cast("double").alias("pred")).write.option("header", "true").csv(path)
    return _rounded(evaluation.accuracy_f1(files.read_evaluation(spark, path)), "accuracy", "f1")


@query(f"""SELECT part, {_ACC} FROM (SELECT user_id % 10 AS part, (event_type = 'purchase')::INT AS actual, (value > 50)::INT AS pred FROM events)
WHERE actual IS NOT NULL AND pred IS NOT NULL GROUP BY ROLLUP (part)""")
def accuracy_f1_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.accuracy_f1(_evaluated(spark, d), ["part"], rollup=True), "accuracy", "f1")


@query(f"""SELECT a AS actual, count(*) FILTER (actual = a AND pred = 0) AS n_pred_0, count(*) FILTER (actual = a AND pred = 1) AS n_pred_1
FROM {_EVAL}, (SELECT unnest([0, 1]) AS a) WHERE actual IS NOT NULL AND pred IS NOT NULL GROUP BY a""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_evaluated(spark, d))


_ROC = f"""WITH s AS (SELECT score, sum(actual) AS pos, sum(1 - actual) AS neg FROM {_EVAL} WHERE score IS NOT NULL AND actual IS NOT NULL GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
 sum(neg) OVER (ORDER BY score) AS below, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s)"""


@query(f"{_ROC} SELECT round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c UNION ALL SELECT 'infinity'::DOUBLE, 0, 0")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.roc_curve(_evaluated(spark, d)), "threshold", "fpr", "tpr")


@query(f"{_ROC} SELECT round(sum(pos * (below - neg / 2)) / (max(p) * max(n)), 6) AS auc FROM c")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.roc_auc(_evaluated(spark, d)), "auc")


@query(f"""WITH s AS (SELECT pred, sum(actual) AS pos, sum(1 - actual) AS neg FROM {_EVAL} WHERE pred IS NOT NULL AND actual IS NOT NULL GROUP BY pred),
c AS (SELECT *, sum(neg) OVER (ORDER BY pred) AS below FROM s)
SELECT round(sum(pos * (below - neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM c""")
def roc_auc_binary(spark: SparkSession, d: str) -> DataFrame:
    """AUC of 0/1 predictions: all ranks tied in two groups."""
    e = _evaluated(spark, d).withColumn("score", F.col("pred").cast("double"))
    return _rounded(evaluation.roc_auc(e), "auc")


# --- training histories ----------------------------------------------------------------------------------------------


_BATCHES = """SELECT event_type AS model, datediff('day', DATE '1970-01-01', ts::DATE) AS epoch, value AS loss, (value > 50)::INT AS acc, 1 + user_id % 4 AS n
FROM events WHERE value IS NOT NULL"""
_HISTORY = f"""b AS ({_BATCHES}), h AS (SELECT model, epoch, sum(loss * n) / sum(n) AS loss, sum(acc * n) / sum(n) AS acc, sum(n)::BIGINT AS n FROM b GROUP BY model, epoch)"""
_MINIMUM = f"""{_HISTORY}, m AS (SELECT *, coalesce(min(loss) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE) AS least_before FROM h),
i AS (SELECT *, loss < least_before AS improved FROM m)"""


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """events as batches of training: the type is the model, the day the epoch."""
    e = table(spark, d, "events", "ts", "user_id", "event_type", "value").where("value is not null")
    return e.select(
        F.col("event_type").alias("model"), F.unix_date(F.to_date("ts")).alias("epoch"), F.col("value").alias("loss"),
        (F.col("value") > 50).cast("int").alias("acc"), (1 + F.col("user_id") % 4).alias("n"),
    )


@query(f"WITH {_HISTORY} SELECT model, epoch, round(loss, 6) AS loss, round(acc, 6) AS acc, n FROM h")
def history_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(history.epoch_means(_batches(spark, d)), "loss", "acc")


@query(f"WITH {_MINIMUM} SELECT model, epoch, round(loss, 6) AS loss, round(least_before, 6) AS least_before, improved FROM i")
def running_min_loss(spark: SparkSession, d: str) -> DataFrame:
    out = history.running_minimum(history.epoch_means(_batches(spark, d)))
    return _rounded(out, "loss", "least_before").select("model", "epoch", "loss", "least_before", "improved")


@query(f"""WITH {_MINIMUM}, k AS (SELECT *, sum(improved::INT) OVER (PARTITION BY model ORDER BY epoch) AS isl FROM i),
s AS (SELECT *, sum((NOT improved)::INT) OVER (PARTITION BY model, isl ORDER BY epoch) AS streak FROM k),
t AS (SELECT *, min(CASE WHEN streak >= 5 THEN epoch END) OVER (PARTITION BY model) AS stop FROM s)
SELECT model, epoch, round(loss, 6) AS loss, streak::BIGINT AS streak, stop FROM t WHERE stop IS NULL OR epoch <= stop""")
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    out = history.early_stopping(history.epoch_means(_batches(spark, d)), 5)
    return _rounded(out, "loss").select("model", "epoch", "loss", "streak", "stop")


@query(f"""WITH {_HISTORY} SELECT model, arg_min(epoch, (loss, epoch)) AS best_epoch, round(min(loss), 6) AS best_loss,
round(arg_min(acc, (loss, epoch)), 6) AS best_acc, round(arg_max(acc, epoch), 6) AS last_acc FROM h GROUP BY model""")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(history.best_epoch(history.epoch_means(_batches(spark, d))), "best_loss", "best_acc", "last_acc")


@query("""SELECT event_type AS model, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS total_s, count(DISTINCT ts::DATE) AS epochs,
round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / count(DISTINCT ts::DATE), 6) AS per_epoch_stopped,
round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / nullif(count(DISTINCT ts::DATE) - 1, 0), 6) AS per_epoch_ended FROM events GROUP BY 1""")
def epoch_timing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "ts", "event_type")
    stamped = e.select(F.col("event_type").alias("model"), F.to_date("ts").alias("epoch"), F.col("ts").cast("timestamp").alias("at"))
    return _rounded(history.epoch_timing(stamped), "total_s", "per_epoch_stopped", "per_epoch_ended")


@query("""SELECT event_id, round(100.0 * row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) / count(*) OVER (PARTITION BY event_type), 6) AS pct
FROM events""")
def progress_pct(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "event_type")
    numbered = files.row_numbers(e, ["ts", "event_id"], "row", ["event_type"])
    sizes = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return numbered.join(sizes, "event_type").select("event_id", _six((F.col("row") + 1) * 100 / F.col("n")).alias("pct"))


# --- robot -----------------------------------------------------------------------------------------------------------


def _pose_lines(spark: SparkSession, d: str) -> DataFrame:
    """A text log per user: a pose block for each of the user's events, with noise lines between."""
    e = table(spark, d, "events", "event_id", "user_id", "value").where("value is not null")
    v, k = F.col("value").cast("string"), F.col("event_id").cast("string")
    block = F.array(
        F.lit("header:"), F.lit(" [position: "), F.concat(F.lit("  x: "), v), F.concat(F.lit("  y: "), k), F.lit("  z: 0.5"),
        F.lit("orientation:"), F.lit("  x: 0.0"), F.lit("  y: bad"), F.lit("  z:  9"), F.concat(F.lit("  w: "), v), F.lit("---"),
    )
    return e.select(F.col("user_id").alias("log"), "event_id", F.posexplode(block).alias("at", "value")).select(
        "log", (F.col("event_id") * 100 + F.col("at")).alias("pos"), "value"
    )


_POSE = """SELECT user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq_no, event_id * 100 + 1 AS pos,
 value AS x, event_id::DOUBLE AS y, 0.5::DOUBLE AS z, 0.0::DOUBLE AS rx, NULL::DOUBLE AS ry, NULL::DOUBLE AS rz, value AS rw
 FROM events WHERE value IS NOT NULL"""


@query(f"SELECT log, seq_no, pos, round(x, 6) AS x, y, z, rx, ry, rz, round(rw, 6) AS rw FROM ({_POSE})")
def pose_parse(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(poses.parse_poses(_pose_lines(spark, d)), "x", "rw")


@query(f"SELECT seq_no % 2 AS odd, count(*) AS n, sum(y) AS total FROM (SELECT event_id::DOUBLE AS y, (event_id % 2 + 2) % 2 AS seq_no FROM events WHERE value IS NOT NULL) GROUP BY 1")
def pose_log_appended(spark: SparkSession, d: str) -> DataFrame:
    """Pose texts appended to logs in two steps, read back line by line and parsed."""
    path = shared_path(spark, "poses")
    e = table(spark, d, "events", "event_id", "value").where("value is not null")
    lines = ["[position:", "  x: {v}", "  y: {k}", "  z: 0.5", "orientation:", "  x: 0.0", "  y: 0.0", "  z: 0.0", "  w: {v}", "---"]
    part = lambda t: F.col("value").cast("string") if t == "{v}" else F.col("event_id").cast("string") if t == "{k}" else F.lit(t)
    pieces = [p for line in lines for p in (*re.split(r"(\{.\})", line), "\n")][:-1]
    text = e.select("event_id", F.concat(*map(part, pieces)).alias("text"))
    for odd in (0, 1):
        files.append_poses(text.where(F.pmod("event_id", F.lit(2)) == odd), path)
    read = poses.parse_poses(files.read_lines(spark, path))
    return read.groupBy(F.pmod(F.col("y").cast("bigint"), F.lit(2)).alias("odd")).agg(F.count("*").alias("n"), F.sum("y").alias("total"))


@query(f"SELECT log, seq_no, round(x, 6) AS x, y, round(rw, 6) AS z FROM ({_POSE})")
def trajectory_remap(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(poses.remap(poses.parse_poses(_pose_lines(spark, d))), "x", "z")


@query(f"SELECT log, seq_no, round(x * 38 + 640, 6) AS px, round(y * -37 + 490, 6) AS py FROM ({_POSE})")
def trajectory_affine(spark: SparkSession, d: str) -> DataFrame:
    scene = poses.to_scene(poses.remap(poses.parse_poses(_pose_lines(spark, d))))
    return _rounded(scene, "px", "py").select("log", "seq_no", "px", "py")


_KEY = "CASE event_type WHEN 'view' THEN 'w' WHEN 'click' THEN 's' WHEN 'purchase' THEN 'a' WHEN 'signup' THEN 'd' ELSE 'q' END"


@query(f"""SELECT event_id, k AS key, CASE WHEN k IN ('w', 's') THEN 'linear' WHEN k IN ('a', 'd') THEN 'angular' END AS axis,
CASE k WHEN 'w' THEN 1.5::DOUBLE WHEN 's' THEN -1.5::DOUBLE WHEN 'a' THEN 1::DOUBLE WHEN 'd' THEN -1::DOUBLE END AS speed,
CASE WHEN k IN ('w', 's') THEN 2 WHEN k IN ('a', 'd') THEN 1 END AS hold_s FROM (SELECT event_id, {_KEY} AS k FROM events)""")
def command_velocity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "event_type").select("event_id", F.expr(_KEY).alias("key"))
    return e.withColumn("v", poses.velocity(F.col("key"))).select("event_id", "key", "v.axis", "v.speed", "v.hold_s")


@query(f"""SELECT event_id, s AS step, CASE WHEN k IN ('w', 's') THEN 'linear' ELSE 'angular' END AS axis,
CASE WHEN s = 1 THEN 0::DOUBLE WHEN k = 'w' THEN 1.5::DOUBLE WHEN k = 's' THEN -1.5::DOUBLE WHEN k = 'a' THEN 1::DOUBLE ELSE -1::DOUBLE END AS speed,
CASE WHEN s = 0 THEN 0 WHEN k IN ('w', 's') THEN 2 ELSE 1 END AS at_s
FROM (SELECT event_id, {_KEY} AS k FROM events), (SELECT unnest([0, 1]) AS s) WHERE k <> 'q'""")
def command_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The messages of each command with the stop that follows."""
    e = table(spark, d, "events", "event_id", "event_type").select("event_id", F.expr(_KEY).alias("key"))
    return poses.messages(e, "event_id")


@query("""SELECT user_id, event_id, round(value, 6) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_odometry(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value")
    return _rounded(poses.latest(e, "user_id", ["ts", "event_id"], "event_id", "value"), "value")


@query("""SELECT seq, event_id, capture_no FROM (SELECT DISTINCT event_id, seq, capture_no, captured_at FROM frame_event WHERE captured_at IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY seq, epoch_us(captured_at) // 4000000 ORDER BY captured_at, event_id) = 1""")
def throttle_4s(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "frame_event", "event_id", "seq", "capture_no", "captured_at").where("captured_at is not null")
    return poses.throttle(f, ["seq"], "captured_at", "event_id", 4).select("seq", "event_id", "capture_no")


@query("""SELECT event_id, seq, row_number() OVER (PARTITION BY seq ORDER BY a, event_id) - 1 AS saved_no FROM (
 SELECT event_id, seq, min(arrived) AS a FROM frame_event WHERE regexp_full_match(image, '(0x)?[0-9a-fA-F]{64}') GROUP BY event_id, seq)""")
def frame_counter(spark: SparkSession, d: str) -> DataFrame:
    """Readable frames numbered by arrival; an unreadable one is skipped and does not advance the counter."""
    f = table(spark, d, "frame_event", "event_id", "seq", "arrived", "image").where(F.col("image").rlike(READABLE))
    first = f.groupBy("event_id", "seq").agg(F.min("arrived").alias("arrived"))
    return files.row_numbers(first, ["arrived", "event_id"], "saved_no", ["seq"]).select("event_id", "seq", "saved_no")


# --- streams and the store --------------------------------------------------------------------------------------------


@query("""SELECT seq, event_id, capture_no FROM (SELECT DISTINCT event_id, seq, capture_no, captured_at FROM frame_event
 WHERE captured_at IS NOT NULL AND regexp_full_match(image, '(0x)?[0-9a-fA-F]{64}'))
QUALIFY row_number() OVER (PARTITION BY seq, epoch_us(captured_at) // 4000000 ORDER BY captured_at, event_id) = 1""")
def stream_throttle(spark: SparkSession, d: str) -> DataFrame:
    """The throttle as a stream with a watermark; the end of the data is flushed by a watermark beyond it."""
    stream = jobs.stream_table(spark, d, "frame_event", "event_id", "seq", "capture_no", "captured_at", "image")
    return jobs.run_once(jobs.throttled_frames(stream), "throttle", "complete").select("seq", "event_id", "capture_no")


@query(_scan_sql(_L2, _LOOPS.replace("vec_id, chunk, i, lp", "vec_id, lp")))
def stream_loop_scan(spark: SparkSession, d: str) -> DataFrame:
    """The suppressed scan as a stateful stream."""
    s = jobs.stream_table(spark, d, "embeddings", "vec_id", "embedding").select(
        F.lit("embeddings").alias("seq"), F.col("vec_id").alias("pos"), F.floor(F.col("vec_id") / 100).alias("chunk"),
        (F.col("vec_id") % 100).alias("i"), F.col("embedding").alias("x"),
    )
    found = jobs.run_once(jobs.detect(s, _L2), "loops")
    return found.where("is_loop").select(F.col("pos").alias("vec_id"), "lp")


_SQL_PATH = """CASE WHEN lower(left(out_path, 5)) = 'file:' THEN url_decode(replace(regexp_replace(substr(out_path, 6), '^//[^/]*', ''), '+', '%2B'))
 ELSE out_path END"""
_UP = "regexp_replace({}, '/[^/]+/\\.\\.(/|$)', '/')"


@query(f"""WITH c AS (SELECT DISTINCT file_id, saved_at, body, '/' || array_to_string(list_filter(string_split({_SQL_PATH}, '/'), lambda x: x <> '' AND x <> '.'), '/') AS p
 FROM chunk_file WHERE strlen(body) = n_bytes AND out_path IS NOT NULL AND length(regexp_replace(body, '[\\r\\n]', '', 'g')) > 0),
b AS (SELECT file_id, body FROM (SELECT *, {_UP.format(_UP.format(_UP.format('p')))} AS path FROM c)
 QUALIFY row_number() OVER (PARTITION BY path ORDER BY saved_at DESC NULLS LAST, file_id DESC) = 1)
SELECT file_id, unnest(range(0, len(list_filter(string_split_regex(body, '\\r\\n|\\r|\\n'), lambda x: x <> '')))) AS item_no FROM b""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    saves = table(spark, d, "chunk_file", "file_id", "out_path", "saved_at", "n_bytes", "body")
    return compact_saves(saves)[1].select("file_id", "item_no")


@query()
def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of the compacted store: bucket, n_records, n_files."""
    saves = table(spark, d, "chunk_file", "file_id", "out_path", "saved_at", "n_bytes", "body")
    store, _ = compact_saves(saves)
    rows = store.read(schema="path string, file_id bigint, item_no bigint, record string")
    return rows.select("bucket", F.input_file_name().alias("file")).groupBy("bucket").agg(
        F.count("*").alias("n_records"), F.count_distinct("file").alias("n_files")
    )


@query(SQL["p3_found"])
def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """The same records through a table of eight buckets of which four are many small files: only these are rewritten, onto version 2."""
    rows = records(valid_saves(table(spark, d, "chunk_file", "file_id", "out_path", "saved_at", "n_bytes", "body")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(8)).cast("int")).select("path", "file_id", "item_no", "record", "bucket")
    store = SnapshotTable(spark, shared_path(spark, "table"))
    base = store.replace(rows.where("bucket < 4").repartition(12), 0)
    base = store.replace(rows.where("bucket >= 4").repartition("bucket"), base)
    version = compact_table(store)
    store.expire()
    return store.read(version, RECORDS).select("file_id", "item_no")
