"""Image decoding, resizing and embedding; reports and poses as files."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placetrail.functions import arrays
from placetrail.functions.images import close_pixels, decode_images
from placetrail.functions.pixels import crop_resized, decode_pnm, embed, halves, pooled, resize
from placetrail.operators import poses
from placetrail.operators.prefix import row_numbers, running_totals
from placetrail.plans.presets import Preset
from placetrail.sources import files


def pnm(image):
    h, w, c = image.shape
    return b"P%d\n# made here\n%d %d\n255\n" % (6 if c == 3 else 5, w, h) + image.astype(np.uint8).tobytes()


def test_decode_thumbnails():
    good, bad = "0123456789abcdef" * 4, ["", None, "0" * 63, "0" * 65, "0x" + "0" * 63, "g" * 64, "0" * 64 + "\n", "0X" + "0" * 64]
    levels, ok = decode_images(pa.array([good, "0x" + good.upper(), *bad]))
    assert ok.tolist() == [True, True] + [False] * len(bad)
    assert levels[0].tolist() == levels[1].tolist() == list(range(16)) * 4
    assert close_pixels(levels[:1], np.minimum(levels[:1] + 1, 15)).tolist() == [64]


def test_decode_and_resize():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (5, 7, 3))
    assert (decode_pnm(pnm(image)) == image).all()
    assert decode_pnm(b"") is None and decode_pnm(b"P6 9 9 255 short") is None and decode_pnm(pnm(image)[:-1]) is None
    assert np.allclose(resize(image[None], 5, 7), image)
    flat = resize(np.full((1, 3, 3, 1), 9), 64, 64)
    assert np.allclose(flat, 9)
    padded = crop_resized(np.full((1, 8, 8, 1), 9), 256, 256, 4, 124, 224, 224)
    assert padded.shape == (1, 224, 224, 1) and (padded[0, :, :132] == 9).all() and (padded[0, :, 132:] == 0).all()
    right, left = halves(image[None])
    assert right.shape == left.shape == (1, 124, 124, 3)
    whole = resize(image[None], 256, 256)
    assert np.allclose(right, (whole[:, 4:128, 124:248] / 255 - 0.36) / 0.28)


def test_embed_keeps_good_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (8, 8, 1)), rng.integers(0, 256, (6, 9, 3)), rng.integers(0, 256, (8, 8, 1))]
    for k, i in enumerate(images):
        (tmp_path / ("one" if k else "two")).mkdir(exist_ok=True)
        (tmp_path / ("one" if k else "two") / f"{k * 10}.ppm").write_bytes(pnm(i))
    (tmp_path / "one" / "7.ppm").write_bytes(b"broken")
    read = files.read_images(spark, f"file://{tmp_path}", "*.ppm")
    assert {(r.label, r.capture_no) for r in read.collect()} == {(1, 0), (0, 10), (0, 20), (0, 7)}
    indexed = files.frame_index(read, ["label", "path"])
    assert [r.capture_no for r in indexed.orderBy("frame_idx").collect()] == [10, 20, 7, 0]  # names as strings
    out = indexed.select("capture_no", "content").mapInArrow(embed(), "id bigint, x array<double>").collect()
    assert {r.id for r in out} == {0, 10, 20}
    x = {r.id: r.x for r in out}
    want = np.concatenate([pooled(h)[0] for h in halves(images[1][None])])
    assert np.allclose(x[10], want)


def test_running_totals(spark):
    rng = np.random.default_rng(2)
    rows = [(str(rng.choice(["hot", "hot", "b", "c"])), k, float(rng.integers(0, 5))) for k in range(500)] + [(None, 1, 2.0), (None, 2, None)]
    df = spark.createDataFrame(rows, "k string, o bigint, v double").repartition(7)
    got = {(r.k, r.o): r.run_v for r in running_totals(df, ["o"], ["v"], ["k"]).collect()}
    for key in {r[0] for r in rows}:
        total = 0.0
        for _, o, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            total += v or 0
            assert got[key, o] == total
    assert [r.n for r in row_numbers(df, ["o", "k"], "n").orderBy("o", "k").collect()] == list(range(502))
    assert running_totals(df.limit(0), ["o"], ["v"]).count() == 0


def test_reports_round_trip(spark, tmp_path):
    df = spark.range(30).select("id", F.lit(0).alias("chunk"), F.col("id").alias("i"))
    for p in (Preset(report="a", halve=True), Preset(report="b"), Preset(report="c", offsets=(221,))):
        number = arrays.image_number(p, F.col("chunk"), F.col("i"))
        records = df.select("id", number.alias("number"), arrays.report_record(p, number).alias("text"))
        path = f"file://{tmp_path}/{p.report}"
        files.save_report(records.coalesce(1), path, ["id"])
        want = sorted(r.number for r in records.collect())
        assert sorted(r.image_number for r in files.parse_report(spark, path).collect()) == want
    halved = df.select(arrays.image_number(Preset(halve=True), F.col("chunk"), F.col("i")).alias("n")).where("id in (3, 5, 7)")
    assert [r.n for r in halved.collect()] == ["2.0", "2.0", "4.0"]


def test_poses_and_commands(spark, tmp_path):
    text = "noise\n [position: \n  x: 1.5\n  y: -2\n  z: 0\nskip\n  x: 0.1\n  y:  9\n  z: x\n  w: 0.7\n[position:\n  x: 3"
    (tmp_path / "pose.txt").write_text(text)
    got = poses.parse_poses(files.read_lines(spark, f"file://{tmp_path}/pose.txt")).orderBy("seq_no").collect()
    assert [(r.x, r.y, r.z, r.rx, r.ry, r.rz, r.rw) for r in got] == [(1.5, -2, 0, 0.1, None, None, 0.7), (3, *[None] * 6)]
    keys = spark.createDataFrame([(k,) for k in "wsadq"], "k string").select("k", poses.velocity(F.col("k")).alias("v")).select("k", "v.*")
    assert keys.collect() == [("w", "linear", 1.5, 2), ("s", "linear", -1.5, 2), ("a", "angular", 1.0, 1), ("d", "angular", -1.0, 1), ("q", None, None, None)]


def test_csv_splits_and_appended_logs(spark, tmp_path):
    (tmp_path / "e.csv").write_text("actual,pred\n1,0.5\n0,\n")
    assert files.read_evaluation(spark, f"file://{tmp_path}/e.csv").collect() == [(1, 0.5), (0, None)]
    for split, names in (("train", ("a", "b")), ("test", ("b",))):
        for n in names:
            (tmp_path / split / n).mkdir(parents=True)
            (tmp_path / split / n / "1.pgm").write_bytes(pnm(np.zeros((2, 2, 1))))
    both = files.read_splits(spark, {s: f"file://{tmp_path}/{s}" for s in ("train", "test")}, "*.pgm")
    assert sorted((r.split, r.label) for r in both.collect()) == [("test", 0), ("train", 0), ("train", 1)]
    for k in range(2):
        files.append_poses(spark.createDataFrame([(f"[position:\n  x: {k}",)], "text string"), f"file://{tmp_path}/log")
    lines = files.read_lines(spark, f"file://{tmp_path}/log")
    assert sorted(r.value for r in lines.where("value like '  x%'").collect()) == ["  x: 0", "  x: 1"]


def test_presets_number_images_as_published(spark):
    """Chunk 3 and 4 of the deployed setting cover 220 to 440, without a gap."""
    p = Preset(offsets=(None, 221, 441, 661))
    df = spark.range(221).select(F.col("id").alias("i"), F.explode(F.array(F.lit(2), F.lit(3))).alias("chunk"))
    numbers = {int(r[0]) for r in df.select(arrays.image_number(p, F.col("chunk"), F.col("i"))).collect()}
    assert numbers == set(range(220, 441))
