"""Runs of repeated events against a plain loop."""

from datetime import datetime, timedelta, timezone
from itertools import groupby

import numpy as np
import pytest

from placetrail.llm.runs import agglomerate, collapse_runs

SCHEMA = (
    "event_id bigint, seq string, capture_no bigint, captured_at timestamp, arrived timestamp, image string, "
    "image_number double, lp int, block string, run_no int"
)
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def decode(image):
    ok = image is not None and len(image.removeprefix("0x")) == 64 and set(image.removeprefix("0x").lower()) <= set("0123456789abcdef")
    return [int(c, 16) for c in image.removeprefix("0x")] if ok else None


def agrees(a, b):
    x, y, m, n = decode(a[5]), decode(b[5]), a[6], b[6]
    if x and y:
        return sum(abs(p - q) <= 1 for p, q in zip(x, y)) >= 60 and (m is None or n is None or abs(m - n) <= 1)
    return m is not None and n is not None and m == n


def plain(rows):
    seen = {}
    for r in sorted(rows, key=lambda r: r[4]):
        if r[1] is not None and r[2] is not None:
            seen.setdefault(r[0], r)
    out = []
    for seq, g in groupby(sorted(seen.values(), key=lambda r: (r[1], r[2])), key=lambda r: r[1]):
        runs = []
        for r in g:
            if runs and agrees(runs[-1][-1], r):
                runs[-1].append(r)
            else:
                runs.append([r])
        for run in runs:
            at = [r[3] for r in run if r[3] is not None]
            out.append((seq, run[0][2], run[-1][2], len(run), int((max(at) - min(at)).total_seconds() * 1e6) if at else None))
    return sorted(out)


def event(k, seq, no, image, number, late=0):
    return (k, seq, no, T0 + timedelta(seconds=no or 0), T0 + timedelta(seconds=(no or 0) + late), image, number, None, "x", 1)


def got(spark, rows, piece=4):
    out = collapse_runs(spark.createDataFrame(rows, SCHEMA), piece=piece).collect()
    return sorted((r.seq, r.first_capture_no, r.last_capture_no, r.n_frames, r.duration_us) for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_random_events(spark, seed):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("0123456789abcdef"), 64)) for _ in range(3)]
    rows = []
    for k in range(300):
        image = base[rng.integers(3)] if rng.random() < 0.9 else rng.choice(["", "zz", None])
        if image and len(image) == 64 and rng.random() < 0.3:
            image = "0x" + image.upper()
        number = None if rng.random() < 0.2 else float(rng.integers(0, 3))
        rows.append(event(k, str(rng.choice(["a", "a", "a", "b"])), int(k * 2), image, number))
    rows += [event(*r[:3], r[5], r[6], late=50) for r in rows[::9]]
    rng.shuffle(rows)
    assert got(spark, [tuple(r) for r in rows]) == plain(rows)
    assert got(spark, [tuple(r) for r in rows], piece=1) == plain(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several partitions even of so few rows
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 13)
        assert got(spark, [tuple(r) for r in rows], piece=10_000) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_defined_cases(spark):
    same, near, far = "0" * 64, "1" * 60 + "f" * 4, "1" * 59 + "f" * 5
    rows = [
        event(1, "a", 1, same, 1.0), event(2, "a", 9, near, 2.0), event(3, "a", 10, far, 2.0),  # near, then too far
        event(4, "a", 11, None, 5.0), event(5, "a", 12, "", 5.0), event(6, "a", 13, same, 5.0), event(7, "a", 14, None, None),
        event(8, None, 1, same, 1.0), event(9, "a", None, same, 1.0),
    ]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows[:0]) == []


def test_a_long_run_over_many_blocks(spark):
    rows = [event(k, "a", k, "8" * 64, None) for k in range(101)]
    assert got(spark, rows, piece=7) == [("a", 0, 100, 101, 100_000_000)]


def test_sparse_numbers_and_one_hot_sequence(spark):
    """Time stamps as order numbers: pieces are cut by rows, not by the numbers' values."""
    rows = [(k, "a", k * 86_400_000_000, T0, T0, "8" * 64 if k % 5 else "1" * 64, None, None, "x", 1) for k in range(400)]
    assert got(spark, rows, piece=50) == plain(rows)


def test_agglomerate_takes_all_links_that_may_join():
    assert agglomerate(np.array([0.9, -1, 1.0, 0.5, -1])).tolist() == [0, 0, 1, 1, 1, 2]
    assert agglomerate(np.zeros(0)).tolist() == [0]
