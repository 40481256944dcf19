"""The suppressed scan on the worked example and against a plain loop."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placetrail.operators import chunks, pairs, scan
from placetrail.plans.presets import PRESETS, Preset

C0 = [0, 0.1, 0.2, 0.15, 5, 0.05, 5.1, 5.2, 5.3, 0.3]
C1 = [5.3, 5.15, 0, 0.1, 5.25, 9]


def plain(frames, p: Preset):
    """(chunk, i, lp) of each reported frame, frame by frame."""
    held, out = [], []
    for chunk, i, x in frames:
        warm = p.warmup != "none" and i < 3 and (p.warmup == "per_chunk" or chunk == 0)
        lp = run = 0
        if not warm:
            for y in held:
                d = np.linalg.norm(np.subtract(x, y)) if p.norm == "l2" else np.abs(np.subtract(x, y)).max()
                ok = d <= p.limit and (p.min_part is None or d > p.min_part * p.limit)
                run = run + 1 if ok else 0
                lp += run >= p.k_run
        if lp > p.more_than:
            out.append((chunk, i, lp))
        else:
            held.append(x)
    return out


def spark_scan(spark, frames, p: Preset):
    df = spark.createDataFrame(
        [("s", n, c, i, [float(v) for v in x]) for n, (c, i, x) in enumerate(frames)],
        "seq string, pos bigint, chunk bigint, i bigint, x array<double>",
    )
    near = pairs.earlier_pairs(df, p.norm, p.limit, None if p.min_part is None else p.min_part * p.limit, block=4)
    out = scan.suppressed_scan(df, near, p).where("is_loop").orderBy("pos").collect()
    runs = pairs.earlier_runs(df, p.norm, p.limit, None if p.min_part is None else p.min_part * p.limit, block=4)
    assert scan.suppressed_scan(df, runs, p).where("is_loop").orderBy("pos").collect() == out
    return [(r.chunk, r.i, r.lp) for r in out]


EXAMPLE = [(c, i, [x]) for c, xs in enumerate((C0, C1)) for i, x in enumerate(xs)]
BASE = Preset(limit=0.5)
CASES = [
    (BASE, [(0, 3, 1), (0, 5, 1), (0, 8, 1), (0, 9, 1), (1, 3, 1), (1, 4, 3)]),
    (BASE.but(warmup="first_chunk"), [(0, 3, 1), (0, 5, 1), (0, 8, 1), (0, 9, 1), *((1, i, 1) for i in range(5))]),
    (BASE.but(warmup="none"), [(0, 3, 1), (0, 5, 1), (0, 8, 1), (0, 9, 1), *((1, i, 1) for i in range(5))]),
    (BASE.but(more_than=1), [(0, 5, 2), (0, 9, 2), (1, 3, 2), (1, 4, 4)]),
    (BASE.but(k_run=2), [(0, 3, 2), (0, 5, 2), (0, 7, 1), (0, 8, 1), (0, 9, 2), (1, 3, 2), (1, 4, 3)]),
    (BASE.but(min_part=1 / 3 / 0.5), []),
]


@pytest.mark.parametrize("preset,want", CASES)
def test_worked_example(spark, preset, want):
    assert plain(EXAMPLE, preset) == want
    assert spark_scan(spark, EXAMPLE, preset) == want


def test_random_sequences_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    frames = [(n // 10, n % 10, rng.integers(0, 3, 2).astype(float)) for n in range(60)]
    for p in (Preset(limit=1.0), Preset(limit=1.0, norm="linf", k_run=2), Preset(limit=1.5, min_part=0.5, warmup="none", more_than=1)):
        assert spark_scan(spark, frames, p) == plain(frames, p)


@pytest.mark.parametrize("preset", [Preset(limit=1.0), Preset(limit=1.0, norm="linf", k_run=2), Preset(limit=1.5, min_part=0.5, warmup="none", more_than=1), Preset(limit=2.0, k_run=9)])
def test_a_scan_of_the_vectors_decides_as_the_scan_of_pairs(spark, preset):
    """Blocks and tiles of a few frames, distances exactly at the limits, widths that differ between sequences."""
    rng = np.random.default_rng(5)
    schema = "seq string, pos bigint, chunk bigint, i bigint, x array<float>"
    rows = [(s, n, n // 10, n % 10, [float(v) for v in rng.integers(0, 3, w)]) for s, w in (("a", 2), ("b", 3), (None, 4)) for n in range(150)]
    df = spark.createDataFrame(rows, schema)
    low = None if preset.min_part is None else preset.min_part * preset.limit
    want = scan.suppressed_scan(df, pairs.earlier_runs(df, preset.norm, preset.limit, low), preset).collect()
    got = scan.vector_scan(df, ["pos"], preset, preset.limit, block=7, tile=5).collect()
    assert sorted(got, key=str) == sorted(want, key=str) and any(r.is_loop for r in got)
    a = [(c, i, x) for s, _, c, i, x in rows if s == "a"]
    assert sorted((r.chunk, r.i, r.lp) for r in got if r.seq == "a" and r.is_loop) == plain(a, preset)


def test_a_scan_of_the_vectors_without_frames_limits_or_run_lengths(spark):
    schema = "seq string, pos bigint, chunk bigint, i bigint, x array<float>, up double, k_run int"
    assert scan.vector_scan(spark.createDataFrame([], schema), ["pos"], BASE, F.col("up")).count() == 0
    rows = [(s, n, 0, n, [1.0], up, k) for s, up, k in (("a", 0.5, 3), ("b", None, 3), ("c", 0.5, None)) for n in range(6)]
    got = scan.vector_scan(spark.createDataFrame(rows, schema), ["pos"], BASE, F.col("up")).where("is_loop").collect()
    assert sorted((r.seq, r.pos, r.lp) for r in got) == [("a", n, 1) for n in (3, 4, 5)]


@given(st.integers(0, 2**32 - 1), st.sampled_from([1e-3, 1.0, 1e18]))
def test_flags_at_the_bound_are_those_of_the_differences(seed, scale):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((9, 64)) * scale + 100 * scale * rng.integers(0, 2)).astype(np.float32).astype(np.float64)
    d = np.array([[np.sqrt(np.cumsum((a - b) ** 2)[-1]) for b in x] for a in x])
    for up in d[0, 1:4]:
        assert (scan.near_flags(x, x, "l2", up, float("-inf")) == (d <= up)).all()
        assert (scan.near_flags(x, x, "l2", up, d[0, 4]) == ((d <= up) & (d > d[0, 4]))).all()


def test_the_shuffle_of_all_sequences_follows_their_frames(spark, tmp_path):
    """Wide limits: nearly all pairs of a sequence match, but nothing is written per pair of blocks."""
    from placetrail.plans.core_queries import QUERIES

    n = 6_000
    x = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.rand(3).cast("float") + (F.hash("id", k) % 100 / 100).cast("float"))
    frames = spark.range(n).select(
        F.col("id").alias("out_id"), F.lit("s").alias("seq"), (F.col("id") / 100).cast("int").alias("chunk"), (F.col("id") % 100).cast("int").alias("i"), x.alias("outputs")
    )
    frames.write.parquet(f"{tmp_path}/descriptor.parquet")
    spark.createDataFrame([("s", 5.0, 3)], "seq string, dist_limit double, k_run int").write.parquet(f"{tmp_path}/seq_info.parquet")
    own = f"{tmp_path}"
    spark.sparkContext.setJobGroup(own, own)
    assert QUERIES["loop_scan_sequences"](spark, own).first().n_frames == n
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, written = spark.sparkContext._jsc.sc().statusStore(), 0
    for job in spark.sparkContext.statusTracker().getJobIdsForGroup(own):
        for stage in spark.sparkContext.statusTracker().getJobInfo(job).stageIds:
            written += store.lastStageAttempt(stage).shuffleWriteBytes()
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert n * 64 * 4 < written < 4 * n * 64 * 4


@given(st.lists(st.booleans(), max_size=40), st.integers(1, 5))
def test_belief_counts_runs(bits, k):
    want = sum(max(0, len(r) - k + 1) for r in "".join("1" if b else "0" for b in bits).split("0"))
    assert scan.belief(np.flatnonzero(bits), k) == want


def test_belief_examples():
    want = {"111": 1, "1101111": 2, "111111": 4, "11011": 0, "0111010111": 2}
    assert {b: scan.belief(np.array([k for k, c in enumerate(b) if c == "1"]), 3) for b in want} == want


def test_null_vectors_and_empty_input(spark):
    schema = "seq string, pos bigint, chunk bigint, i bigint, x array<double>"
    empty = spark.createDataFrame([], schema)
    assert scan.suppressed_scan(empty, pairs.earlier_pairs(empty, "l2", 1.0), BASE).count() == 0
    some = spark.createDataFrame([("s", 0, 0, 0, [1.0]), ("s", 1, 0, 1, None), (None, 0, 0, 0, [1.0]), (None, 1, 0, 1, [1.0])], schema)
    got = pairs.earlier_pairs(some, "l2", 1.0).collect()
    assert [(r.seq, r.i, r.j, r.d) for r in got] == [(None, 1, 0, 0.0)]


def test_a_stretch_ends_at_a_place_without_a_vector(spark):
    schema = "seq string, pos bigint, x array<float>"
    rows = [("s", k, None if k == 2 else [1.0]) for k in range(6)]
    got = pairs.earlier_runs(spark.createDataFrame(rows, schema), "linf", 0.5).where("i = 5").collect()
    assert sorted((r.first, r.last) for r in got) == [(0, 1), (3, 4)]
    extent = pairs.earlier_extent(spark.createDataFrame(rows, schema), "l2", block=2).where("i = 5").first()
    assert (extent.n, extent.nearest, extent.farthest) == (4, 0.0, 0.0)


def test_a_hole_in_the_list_of_chunks(spark):
    frames = spark.range(40).withColumnRenamed("id", "frame_idx")
    p = Preset(chunk_size=5, excluded_chunks=(1, 4))
    got = sorted((r.pos, r.chunk, r.i, r.frame_idx) for r in chunks.scan_order(frames, p).collect())
    ids = [c for c in range(7) if c not in (1, 4)]
    assert got == [(n * 6 + i, n, i, c * 5 + 1 + i) for n, c in enumerate(ids) for i in range(6)]


def test_nineteen_presets():
    assert PRESETS["tum_vit"].excluded_chunks == (153,) and PRESETS["tum_vit"].chunks_scanned == 165
    assert len(PRESETS) == 19
    assert {p.norm for p in PRESETS.values()} == {"l2", "linf"}


def test_chunks(spark):
    frames = spark.range(12).withColumnRenamed("id", "frame_idx")
    got = lambda p: sorted((r.chunk, r.i, r.frame_idx) for r in chunks.assign_chunks(frames, p).collect())
    inclusive = Preset(chunk_size=5)
    assert got(inclusive) == [(c, i, c * 5 + 1 + i) for c in (0, 1) for i in range(6)]
    assert got(inclusive.but(drop_partial=False))[-1] == (2, 0, 11)
    assert got(inclusive.but(chunk_mode="half_open")) == [(c, i, c * 5 + 1 + i) for c in (0, 1, 2) for i in range(5) if c * 5 + 1 + i < 12]


def test_union_of_all_chunks_grows_with_the_table(spark, data):
    from placetrail.plans.core_queries import QUERIES

    ids = {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()}
    got = [r.vec_id for r in QUERIES["chunk_union_all"](spark, data).collect()]
    assert sorted(got) == sorted(v for v in ids if v // 100 != 2) and max(got) >= 400


def test_the_stream_decides_as_the_batch_does(spark, tmp_path):
    """Three micro-batches, two sequences, state in between."""
    from placetrail.streaming import jobs

    rng = np.random.default_rng(6)
    schema = "seq string, pos bigint, chunk bigint, i bigint, x array<float>"
    rows = [(s, n, n // 10, n % 10, [float(v) for v in rng.integers(0, 3, 2)]) for s in "ab" for n in range(60)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    p = Preset(limit=1.0, more_than=1)
    got = {(r.seq, r.pos): (r.lp, r.is_loop) for r in jobs.run_once(jobs.detect(stream, p), "test").collect()}
    df = spark.createDataFrame(rows, schema)
    want = scan.suppressed_scan(df, pairs.earlier_runs(df, "l2", 1.0), p).collect()
    assert got == {(r.seq, r.pos): (r.lp, r.is_loop) for r in want} and any(r.is_loop for r in want)
