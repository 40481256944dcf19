"""Groups, neighbours and batch-wise duplicates against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from placetrail.functions.vectors import readable_vectors
from placetrail.llm import batches, spectral, suffixes
from placetrail.llm.batches import dedupe_batches
from placetrail.llm.graph import Graph
from placetrail.llm.neighbours import brute_force, nearest_neighbours, neighbour_pairs, neighbour_recall
from placetrail.llm.spectral import cover, describe_groups, directions, embedding_kmeans, inner_affinity, power_iteration, similarity_groups
from placetrail.sources.snapshots import ConflictError

VECTORS = "out_id bigint, outputs array<float>, label string, id string, w double"


def bad_vectors(width):
    return [None, [], [1.0] * (width - 1), [0.0] * width, [float("nan")] + [1.0] * (width - 1), [None] + [1.0] * (width - 1),
            [float("inf")] + [1.0] * (width - 1)]


def places(rng, sizes, spread=0.015):
    x = []
    for n in sizes:
        c = rng.standard_normal(64)
        c /= np.linalg.norm(c)
        x += [c + rng.standard_normal(64) * spread for _ in range(n)]
    return np.array(x) * rng.uniform(0.1, 30, (len(x), 1))


def true_groups(ids, x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.sqrt(((u[:, None] - u[None]) ** 2).sum(2)) <= 0.45
    return {(int(ids[near[k]].min()), int(ids[k])) for k in range(len(ids))}


def test_groups_with_a_hot_place(spark):
    rng = np.random.default_rng(2)
    x = places(rng, [200, 40, 7, 2, 2, 1, 1, 1] + [3] * 60).astype(np.float32)
    ids = rng.permutation(len(x)) * 3 + 5
    rows = [(int(i), [float(v) for v in r], "l", "i", 0.0) for i, r in zip(ids, x)]
    rows += rows[:50] + [(10_000 + k, v, "l", "i", 0.0) for k, v in enumerate(bad_vectors(64))] + [(None, [1.0] * 64, "l", "i", 0.0)]
    groups = similarity_groups(spark.createDataFrame(rows, VECTORS).repartition(3))
    got = {(r.first_id, r.id) for r in groups.collect()}
    assert got == true_groups(ids, x.astype(float))
    assert groups.count() == len(x)
    members = inner_affinity(spark.createDataFrame(rows, VECTORS), groups)
    described = {r.first_id: r for r in describe_groups(members, most=3).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for first in {f for f, _ in got}:
        mine = np.array(sorted(i for f, i in got if f == first))
        v = u[[int(np.flatnonzero(ids == i)[0]) for i in mine]]
        inner = ((v @ v.T).sum(1) - 1).round(7)
        assert described[first].typical == mine[np.lexsort((mine, -inner))[:3]].tolist()
    assert sum(r.n_frames for r in described.values()) == len(x)
    assert all(len(r.typical) == min(3, r.n_frames) for r in described.values())
    assert similarity_groups(spark.createDataFrame([], VECTORS)).count() == 0


def test_embedding_alone_separates_components(spark):
    """Iteration and k-means find the components without the checks that follow."""
    rng = np.random.default_rng(3)
    links, comp, start = [], {}, 0
    for c in range(80):
        n = int(rng.integers(2, 12))
        for k in range(1, n):
            links.append((start, start + k, 0.9))
        for k in range(n):
            comp[start + k] = start
        start += n
    df = spark.createDataFrame(links, "a bigint, b bigint, w double")
    both = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    x = directions(power_iteration(both, 8, 20), 8)
    got = {r.a: r.label for r in embedding_kmeans(x, 0.02).collect()}
    assert got == comp


def test_large_groups_stay_apart(spark):
    """Two thousand leaders each: what is iterated shrinks, its direction does not."""
    stars = "explode(array(a % 12 + 12 * pmod(hash(a), 7), a % 12 + 12 * pmod(hash(a, 1), 7), a % 12 + 12 * pmod(hash(a, 2), 7))) as b"
    links = spark.range(24_000).withColumnRenamed("id", "a").selectExpr("a", stars, "0.9D as w").where("a <> b").distinct()
    both = links.unionByName(links.selectExpr("b as a", "a as b", "w"))
    x = directions(power_iteration(both, 8, 20), 8)
    got = embedding_kmeans(x, 0.02).selectExpr("a % 12 as g", "label").distinct().collect()
    assert len(got) == 12 and len({r.label for r in got}) == 12


def test_the_groups_come_from_the_iteration(spark, monkeypatch):
    """Without iteration the groups fall apart: no later step unites what the embedding does not."""
    rng = np.random.default_rng(2)
    x = places(rng, [3] * 30).astype(np.float32)
    rows = [(i, [float(v) for v in r], "l", "i", 0.0) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    assert similarity_groups(df).select("first_id").distinct().count() == 30
    monkeypatch.setattr(spectral, "power_iteration", lambda links, vectors, steps: power_iteration(links, vectors, 0))
    assert similarity_groups(df).select("first_id").distinct().count() > 60


def test_two_groups_of_one_embedding_are_parted(spark):
    rng = np.random.default_rng(2)
    v = places(rng, [3, 4])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    leaders = spark.createDataFrame([(i, r.astype(np.float32).tobytes()) for i, r in enumerate(v)], "id bigint, vec binary")
    pairs = [(a, b) for a in range(7) for b in range(7) if a != b and (a < 3) == (b < 3)]
    both = spark.createDataFrame([(a, b, 0.9) for a, b in pairs], "a bigint, b bigint, w double")
    labels = spark.createDataFrame([(a, 0) for a in range(7)], "a bigint, label bigint")
    got = {r.a: r.label for r in spectral._within_reach(labels, both, leaders, 0.45).collect()}
    assert len({got[a] for a in range(3)}) == 1 == len({got[a] for a in range(3, 7)}) and got[0] != got[3]


def test_cover_links_stars_not_pairs():
    key = np.array([1, 1, 1, 2, 2])
    x = np.array([[1.0, 0], [1, 0], [0, 1], [0, 1], [1, 0]])
    lead, row, dot = cover(key, x, 0.9)
    assert list(zip(lead, row)) == [(0, 1)] and dot.tolist() == [1.0]
    hot = np.zeros(5000, np.int64)
    assert len(cover(hot, np.ones((5000, 2)), 0.9)[0]) == 4999


HALVES = "half_id bigint, outputs array<float>, id string, distance double, rank int, cell int"


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 40))
    x = np.concatenate([c + rng.standard_normal((int(rng.integers(1, 14)), 40)) * 0.02 for c in centres]).astype(np.float32)
    ids = np.arange(len(x)) * 7 + 1
    rows = [(int(i), [float(v) for v in r], "i", 0.0, 0, 0) for i, r in zip(ids, x)]
    rows += rows[:20] + [(9000 + k, v, "i", 0.0, 0, 0) for k, v in enumerate(bad_vectors(40))]
    df = spark.createDataFrame(rows, HALVES)
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    np.fill_diagonal(d, 9)
    want = {(int(ids[k]), int(ids[j])) for k in range(len(x)) for j in np.argsort(d[k])[:5] if d[k, j] <= 0.8}
    for shard_rows in (4096, 60):
        found = nearest_neighbours(df, "outputs", 40, shard_rows=shard_rows)
        got = {(r.id, r.neighbour) for r in found.collect()}
        assert got <= want or len(got & want) >= 0.97 * len(want)
        assert len(got & want) >= 0.97 * len(want)
    true = brute_force(df, "outputs", 40, every=1)
    assert {(r.id, r.neighbour) for r in true.collect()} == want
    recall = neighbour_recall(found, true).first()
    assert recall.n_true == len(want) and recall.recall >= 0.97
    assert all(r.id_lo < r.id_hi for r in neighbour_pairs(found).collect())
    assert nearest_neighbours(df.limit(0), "outputs", 40).count() == 0


def test_equal_vectors_and_one_hot_cell(spark):
    rows = [(k, [1.0] * 40, "i", 0.0, 0, 0) for k in range(300)]
    found = nearest_neighbours(spark.createDataFrame(rows, HALVES), "outputs", 40, shard_rows=100)
    per = found.groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("d")).collect()
    assert len(per) == 300 and all(r.n == 5 and r.d == 0 for r in per)


def test_a_graph_written_and_read():
    x = np.random.default_rng(6).standard_normal((700, 8))
    g = Graph(x, patience=4, reach=1.0)
    h = Graph.restored(g.state(), 8, patience=4, reach=1.0)
    for a, b in zip(g.search(x[:50]), h.search(x[:50])):
        assert (a == b).all()


def test_graph_recall():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((250, 32)), 8, axis=0) + rng.standard_normal((2000, 32)) * 0.02
    g = Graph(x)
    ids, _ = g.search(x, np.arange(2000, dtype=np.int32))
    d = ((x[:, None, :8] - x[None, :, :8]) ** 2).sum(2) if False else (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T
    top = np.argsort(d, axis=1)[:, 1:6]
    assert (top[:, :, None] == ids[:, None, :]).any(2).mean() > 0.97


FRAMES = "out_id bigint, batch_no int, image string, outputs array<float>, id string, kind int, shard int"


def plain_dedupe(rows):
    seen = {}
    for r in rows:
        if r[0] is not None:
            seen.setdefault(r[0], r)

    def image(s):
        ok = s is not None and len(s.removeprefix("0x")) == 64 and set(s.removeprefix("0x").lower()) <= set("0123456789abcdef")
        return np.array([int(c, 16) for c in s.removeprefix("0x")]) if ok else None

    def vector(v):
        ok = v is not None and len(v) == 64 and all(e is not None and np.isfinite(e) for e in v) and any(v)
        return np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None

    kept, out = [], set()
    for k in sorted(seen):
        a, b = image(seen[k][2]), vector(seen[k][3])
        hits = [
            i for i, c, d in kept
            if (a is not None and c is not None and (np.abs(a - c) <= 1).sum() >= 60)
            or (b is not None and d is not None and np.linalg.norm(b - d) <= 0.03)
        ]
        if hits:
            out.add((min(hits), k))
        else:
            kept.append((k, a, b))
    return out


def random_frames(seed, n=500):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        image = "".join(f"{v:x}" for v in rng.integers(0, 14, 64))
        x = (rng.standard_normal(64) * 0.2).astype(np.float32)
        if rows and rng.random() < 0.35:
            old = rows[rng.integers(len(rows))]
            if rng.random() < 0.6 and old[2] and len(old[2]) == 64:
                levels = np.array([int(c, 16) for c in old[2]])
                style = rng.integers(3)
                if style == 0:
                    levels = np.clip(levels + 1, 0, 15)
                elif style == 1:
                    levels = np.clip(levels + rng.choice([-1, 0, 0, 0, 1], 64), 0, 15)
                levels[rng.choice(64, rng.integers(0, 7), replace=False)] = rng.integers(0, 15)
                image = "".join(f"{v:x}" for v in levels)
            if rng.random() < 0.6 and old[3]:
                v = np.array(old[3], float)
                x = ((v + rng.standard_normal(64) * np.linalg.norm(v) * rng.choice([0, 0.001, 0.002, 0.006])) * 3).astype(np.float32)
        rows.append((k + 1, k // 60, image, [float(v) for v in x], "i", 0, 0))
    for k in range(0, n, 40):
        rows[k] = (*rows[k][:2], rng.choice(["", "xyz"]), rows[k][3], *rows[k][4:])
        rows[k + 1] = (*rows[k + 1][:3], bad_vectors(64)[(k // 40) % 7], *rows[k + 1][4:])
    return [tuple(str(v) if isinstance(v, np.str_) else v for v in r) for r in rows]


@pytest.mark.parametrize("seed", range(2))
def test_dedupe_against_a_plain_loop(spark, seed):
    rows = random_frames(seed)
    df = spark.createDataFrame(rows + rows[::7] + [(None, 0, None, None, "i", 0, 0)], FRAMES).repartition(3)
    assert {(r.kept_id, r.out_id) for r in dedupe_batches(df).collect()} == plain_dedupe(rows)


def test_dedupe_hot_copies_nulls_and_empty(spark):
    rows = [(k, k // 50, "a" * 64, [1.0] * 64, "i", 0, 0) for k in range(1, 301)]
    rows += [(k, None, None, None, "i", 0, 0) for k in range(400, 405)]
    df = spark.createDataFrame(rows, FRAMES)
    assert {(r.kept_id, r.out_id) for r in dedupe_batches(df).collect()} == {(1, k) for k in range(2, 301)}
    assert dedupe_batches(df.limit(0)).count() == 0


def plain_image_pairs(x):
    n = len(x)
    return {(i, j) for i in range(n) for j in range(i + 1, n) if (np.abs(x[i].astype(int) - x[j]) <= 1).sum() >= 60}


def test_segments_are_searched_batch_by_batch():
    """All pairs with a long match are found, however the rows are cut into batches."""
    rng = np.random.default_rng(1)
    x = rng.integers(1, 15, (40, 64))[rng.integers(0, 40, 300)]
    x += rng.choice([-1, 0, 0, 0, 1], x.shape)
    x[rng.random(x.shape) < 0.005] = 0
    x, ids = x.astype(np.uint8), np.arange(300)
    depth = batches.STARTS[0][0][1]
    want = {(i, j) for i, j in plain_image_pairs(x) if (np.abs(x[i, :depth].astype(int) - x[j, :depth]) <= 1).all()}
    assert len(want) > 100
    for batch in (np.zeros(300, int), ids // 17, np.arange(300)):
        lo, hi, leader, left = suffixes.replay(x, ids, batch, depth, batches._covers(0), np.zeros(300, bool))
        got = list(zip(lo.tolist(), hi.tolist()))
        assert want <= set(got) <= plain_image_pairs(x) and len(got) == len(set(got)) and not len(left)


def test_five_suffixes_miss_no_near_image():
    rng = np.random.default_rng(8)
    a = rng.integers(1, 15, (400, 64))
    b = a + rng.choice([-1, 1], a.shape)
    b[np.arange(400)[:, None], np.argsort(rng.random(a.shape), axis=1)[:, :4]] = rng.integers(0, 16, (400, 4))
    found = set()
    for start, depth in batches.STARTS[0]:
        one, two = (suffixes.SuffixArray(batches.suffix_of(batches.texts_of(v.astype(np.uint8), 0), start), ids, depth) for v, ids in ((a, np.arange(400)), (b, np.arange(400, 800))))
        lo, hi = suffixes.matches(one, two, batches._covers(0))
        found |= set(zip(lo.tolist(), hi.tolist()))
    assert found == {(k, k + 400) for k in range(400)}


def test_four_suffixes_miss_no_near_vector():
    """Pairs at just the largest distance, in one direction, in one coordinate or spread evenly."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    step = rng.standard_normal((600, 64)) * rng.choice([1, 0.05], (600, 64))
    step[::3] = np.eye(64)[rng.integers(0, 64, 200)]
    step -= (step * a).sum(1, keepdims=True) * a
    angle = 2 * np.arcsin(0.03 / 2) * (1 - 1e-9)
    b = a * np.cos(angle) + step / np.linalg.norm(step, axis=1, keepdims=True) * np.sin(angle)
    found = set()
    for start, depth in batches.STARTS[1]:
        one, two = (suffixes.SuffixArray(batches.suffix_of(batches.texts_of(v, 1), start), ids, depth) for v, ids in ((a, np.arange(600)), (b, np.arange(600, 1200))))
        lo, hi = suffixes.matches(one, two, batches._covers(1))
        found |= set(zip(lo.tolist(), hi.tolist()))
    assert found == {(k, k + 600) for k in range(600)}


def test_routes_part_no_match():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 16, (3000, 64)).astype(np.uint8)
    x[:1500, :13] = 3  # a stretch that can't be split has leaves of parts that meet pair by pair
    routes = batches.Routes.fitted({0: x, 1: np.zeros((0, 96), np.uint8)}, 200)
    rows, leaf = routes.leaves(x, 0, 0)
    y = batches.suffix_of(x, 0)
    together = np.zeros((len(x), len(x)), bool)
    for k in np.unique(leaf):
        m = rows[leaf == k]
        together[np.ix_(m, m)] = True
    depth = batches.STARTS[0][0][1]
    near = (np.abs(y[:, None, :depth].astype(int) - y[None, :, :depth]) <= 1).all(axis=2)
    assert together[near].all() and together.mean() < 0.6 and np.bincount(np.unique(leaf, return_inverse=True)[1]).max() <= 1000


@pytest.mark.parametrize("seed", [0])
def test_batches_one_by_one(spark, seed, tmp_path):
    rows = random_frames(seed, 360)
    index = batches.AcceptedIndex(spark, f"file://{tmp_path}/i", leaf_rows=100, planned_rows=400)
    got = set()
    for b in range(6):
        part = [r for r in rows if r[1] == b]
        got |= {(r.kept_id, r.out_id) for r in index.add(spark.createDataFrame(part, FRAMES)).collect()}
        index = batches.AcceptedIndex(spark, f"file://{tmp_path}/i")  # goes on from the folder
    assert got == plain_dedupe(rows)
    assert len(index.state["live"]) <= 3 and sum(n for _, n in index.state["live"]) == len({r[0] for r in rows}) - len(got)
    assert index.add(spark.createDataFrame([], FRAMES)).count() == 0


def test_two_writers_of_an_index(spark, tmp_path):
    rows = random_frames(5, 60)
    one, two = (batches.AcceptedIndex(spark, f"file://{tmp_path}/i") for _ in range(2))
    one.add(spark.createDataFrame(rows, FRAMES))
    with pytest.raises(ConflictError):
        two.add(spark.createDataFrame(rows, FRAMES))


def test_many_leaves(spark):
    rows = random_frames(3, 240)
    df = spark.createDataFrame(rows, FRAMES).repartition(6)
    assert {(r.kept_id, r.out_id) for r in dedupe_batches(df, leaf_rows=40).collect()} == plain_dedupe(rows)


def noisy_copies(seed, n, changed):
    """Different images of one place: a few pixels of the first are a level off."""
    rng = np.random.default_rng(seed)
    base, seen = rng.integers(1, 15, 64), {}
    seen["".join(f"{v:x}" for v in base)] = None
    while len(seen) < n:
        levels = base.copy()
        levels[rng.choice(64, changed, replace=False)] += rng.choice([-1, 1], changed)
        seen["".join(f"{v:x}" for v in levels)] = None
    return [(k, 1, image, None, "i", 0, 0) for k, image in enumerate(seen, 1)]


def test_a_hot_place_loses_no_suffixes(spark):
    """20,000 different images in one batch, all near-identical to the first: many share each suffix."""
    df = spark.createDataFrame(noisy_copies(4, 20_000, 4), FRAMES).repartition(4)
    assert {(r.kept_id, r.out_id) for r in dedupe_batches(df).collect()} == {(1, k) for k in range(2, 20_001)}


@pytest.mark.parametrize("seed", range(2))
def test_hot_texts_and_frames_left_out(spark, seed, monkeypatch):
    """Left out frames are looked up once their leader is rejected: images and vectors of two hot places, mixed."""
    rng = np.random.default_rng(seed)
    rows = random_frames(seed, 200)
    near = [r[1:] for r in noisy_copies(seed, 60, 12)]
    far = [(*r[:1], "".join(f"{(int(c, 16) + 2 * int(rng.random() < 0.08)) % 16:x}" for c in r[1]), *r[2:]) for r in near]
    hot = [r[1:] for r in noisy_copies(seed + 10, 60, 2)]
    v = rng.standard_normal(64)
    vectors = [[float(e) for e in v + rng.standard_normal(64) * 0.002 * np.linalg.norm(v)] for _ in range(40)]
    hot = [(r[0], r[1], vectors[k % 40] if k % 3 else None, *r[3:]) for k, r in enumerate(hot)]
    ids = iter(rng.permutation(400).tolist())
    rows = [(next(ids), *r) for r in near + far + hot + [r[1:] for r in rows]]
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "SLICE", 50)
    t = pa.table({c: pa.array([r[k] for r in rows], y) for c, k, y in (("id", 0, pa.int64()), ("batch", 1, pa.int64()), ("image", 2, pa.string()), ("outputs", 3, pa.list_(pa.float32())))})
    routes = batches.Routes.fitted({0: np.zeros((0, 64), np.uint8), 1: np.zeros((0, 96), np.uint8)}, 100)
    packed = pa.Table.from_batches(list(batches._pack(routes)(iter(t.to_batches()))))
    packed = packed.append_column("history", pa.array([False] * packed.num_rows))
    leaves = {(r["kind"], r["block"], r["leaf"]) for r in packed.select(["kind", "block", "leaf"]).to_pylist()}
    met = pa.concat_tables(
        batches._replayed(packed.filter((pc.field("kind") == k) & (pc.field("block") == b) & (pc.field("leaf") == f))) for k, b, f in sorted(leaves)
    )
    assert met["left_out"].to_numpy().sum() > 50
    frames = spark.createDataFrame(t.to_pandas(), "id bigint, batch bigint, image string, outputs array<float>")
    got = batches.rejected_of(frames, spark.createDataFrame(met.to_pandas(), batches._MET), frames.mapInArrow(batches._pack(routes), batches._PACKED), routes)
    assert {(r.kept_id, r.out_id) for r in got.collect()} == plain_dedupe(rows)


def test_the_worst_noise_allowed(spark):
    """All pixels a level off and four changed: every such pair is found."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(0, 1600, 2):
        a = rng.integers(1, 15, 64)
        b = a + rng.choice([-1, 1], 64)
        b[rng.choice(64, 4, replace=False)] = rng.integers(0, 16, 4)
        rows += [(k + e, 0, "".join(f"{v:x}" for v in x), None, "i", 0, 0) for e, x in enumerate((a, b))]
    df = spark.createDataFrame(rows, FRAMES).repartition(2)
    assert {(r.kept_id, r.out_id) for r in dedupe_batches(df).collect()} == {(k, k + 1) for k in range(0, 1600, 2)}


def test_readable_vectors():
    x, rows = readable_vectors(pa.array([[1.0, 2.0], *bad_vectors(2), [3.0, 0.0]], pa.list_(pa.float32())), 2)
    assert rows.tolist() == [0, 8] and x.tolist() == [[1, 2], [3, 0]]
