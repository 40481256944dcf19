"""Similarity groups of vectors by power-iteration spectral clustering (problem 1).

1. Within blocks of rows, cross-polytope buckets are covered by leaders: a row within the radius of an earlier row of its
   bucket becomes that row's leaf. A group that holds a third of all rows shrinks here to about one leader per block,
   before anything is shuffled.
2. The leaders meet in the buckets of further tables; within a bucket each is linked to the first one that covers it
   (a star, never all pairs). The links with their affinities, the cosines, are the sparse affinity matrix.
3. Several random vectors are iterated with the lazily normalised matrix: joins and sums by key. On a group's leaders
   they approach one common value each, which differs from group to group. Its direction, and the logarithm of its
   length, are the embedding; so it does not shrink towards the origin where groups are large.
4. The embedding is clustered with k-means: points that agree are one weighted point first, so that a hot group is a
   handful of them; cells of a grid, with a margin of their neighbours, are seeded and refined each on its own, so that
   the number of centres may grow with the data. These clusters are the groups; links don't unite them.
5. Check: leaders farther than the radius from their cluster's most typical leader are a cluster of their own (two groups
   whose embeddings fell together). Leaves follow their leaders. Members are ranked by their affinity inside the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placetrail.functions.vectors import polytope_hashes, readable_vectors, unit
from placetrail.plans.session import cut

BLOCK_ROWS = 16384
_COVER = "leader bigint, id bigint, vec binary"
#: Of two unit vectors in 8-bit steps: no distance is off by more.
_BRIEF_ERROR = 0.035


def cover(key: np.ndarray, x: np.ndarray, min_dot: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows with equal keys, in the order given: (leader, row, dot) of each row that an earlier row covers.

    The first open row of each key leads a round and takes the rows within reach; what it does not reach goes on to the
    next round, so the work is rows times the different groups of a bucket, not all pairs.
    """
    order = np.argsort(key, kind="stable")
    leaders, rows, dots = [], [], []
    while len(order):
        k = key[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        lead = np.repeat(order[first], np.diff(np.r_[first, len(order)]))
        dot = np.einsum("ij,ij->i", x[lead], x[order])
        is_lead = lead == order
        near = (dot >= min_dot) & ~is_lead
        leaders.append(lead[near])
        rows.append(order[near])
        dots.append(dot[near])
        order = order[~near & ~is_lead]
    none = np.zeros(0, np.int64)
    return (
        np.concatenate([none, *leaders]),
        np.concatenate([none, *rows]),
        np.concatenate([np.zeros(0), *dots]),
    )


def _block_cover(width: int, radius: float, tables: int, parts: int):
    """Rows (id, vector) to leaves (leader, id) and leaders (leader = id, with the unit vector)."""
    min_dot = 1 - radius**2 / 2

    def block(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, at = np.unique(ids, return_index=True)  # a repeated row counts once; the smallest id leads
        x = unit(x[at])
        key = polytope_hashes(x, tables, parts, seed=11)
        over = np.arange(len(ids))
        active = np.arange(len(ids))
        for t in range(tables):
            lead, row, _ = cover(key[active, t], x[active], min_dot)
            over[active[row]] = active[lead]
            active = active[over[active] == active]
        root = over
        while (root[root] != root).any():
            root = root[root]
        near = np.einsum("ij,ij->i", x[root], x) >= min_dot
        while not near.all():  # a root out of reach: the row stays with the row that covered it, which then leads
            bad = np.flatnonzero(~near)
            root[bad] = over[bad]
            root[over[bad]] = over[bad]
            near = np.einsum("ij,ij->i", x[root], x) >= min_dot
        vec = pa.array([v.tobytes() if r == k else None for k, (v, r) in enumerate(zip(x.astype(np.float32), root))], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[root]), pa.array(ids), vec], names=["leader", "id", "vec"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held_x, held = [], [], 0
        for batch in batches:
            x, rows = readable_vectors(batch[1], width)
            ids = batch[0].to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            held_ids.append(ids)
            held_x.append(x)
            held += len(ids)
            if held >= BLOCK_ROWS:
                yield from block(np.concatenate(held_ids), np.concatenate(held_x))
                held_ids, held_x, held = [], [], 0
        if held:
            yield from block(np.concatenate(held_ids), np.concatenate(held_x))

    return run


def _bucket_entries(tables: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch["vec"].to_pylist()), np.float32).reshape(n, -1)
            key = polytope_hashes(x, tables, parts, seed=12)
            key += np.arange(tables)[None, :] * (2 * x.shape[1]) ** parts
            scale = np.abs(x).max(axis=1, keepdims=True)
            brief = np.concatenate([scale.astype(np.float32).view(np.int8), np.rint(x / scale * 127).astype(np.int8)], axis=1)
            brief = pa.array([v.tobytes() for v in brief], pa.binary())
            at = pa.array(np.repeat(np.arange(n), tables))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch["id"].take(at), brief.take(at)], names=["key", "id", "vec"])

    return run


def _bucket_links(radius: float):
    """Links of buckets (a, b, w): ``sure`` where the 8-bit steps can tell that the vectors are within the radius."""
    inner, outer = (1 - max(radius + e, 0) ** 2 / 2 for e in (-_BRIEF_ERROR, _BRIEF_ERROR))

    def links(t: pa.Table) -> pa.RecordBatch:
        key, ids = t["key"].to_numpy(), t["id"].to_numpy()
        raw = np.frombuffer(b"".join(t["vec"].to_pylist()), np.int8).reshape(len(ids), -1)
        x = np.ascontiguousarray(raw[:, :4]).view(np.float32) * raw[:, 4:].astype(np.float32)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        lead, row, dot = cover(key, x, outer)
        columns = (ids[lead], ids[row], dot.astype(float), dot >= inner)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "w", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # whole buckets: the last one of a batch may go on in the next
            if not batch.num_rows:
                continue
            key = batch["key"].to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and held[-1]["key"][-1].as_py() != key[0]:
                yield links(pa.Table.from_batches(held))
                held = []
            if len(change):
                yield links(pa.Table.from_batches([*held, batch.slice(0, int(change[-1]))]))
                held = [batch.slice(int(change[-1]))]
            else:
                held.append(batch)
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def power_iteration(links: DataFrame, vectors: int, steps: int, every: int = 4) -> DataFrame:
    """The embedding of the nodes of ``links`` (a, b, w in both directions): columns a, x0, x1, ...

    Steps replace a node's values by the weighted mean of its neighbours', every other time by half of that and half of
    themselves: what belongs to an eigenvalue v shrinks by v (1 + v) / 2 in two steps, also where v is near -1 (stars).
    """
    degree = links.groupBy("a").agg(F.sum("w").alias("degree"))
    step = links.join(degree, "a").select("a", "b", (F.col("w") / F.col("degree")).alias("p"), (F.col("w") / F.col("degree") / 2).alias("lazy"))
    step = cut(step.unionByName(degree.select("a", F.col("a").alias("b"), F.lit(0.0).alias("p"), F.lit(0.5).alias("lazy"))).repartition("b"))
    names = [f"x{k}" for k in range(vectors)]
    x = degree.select(
        F.col("a").alias("b"),
        *((F.pmod(F.xxhash64("a", F.lit(k)), F.lit(1 << 30)) / float(1 << 29) - 1).alias(c) for k, c in enumerate(names)),
    )
    for k in range(steps):
        p = F.col("p" if k % 2 else "lazy")
        x = step.join(x, "b").groupBy("a").agg(*(F.sum(p * F.col(c)).alias(c) for c in names))
        x = x.withColumnRenamed("a", "b")
        if k % every == every - 1:
            x = cut(x)
    return x.withColumnRenamed("b", "a")


def _cell_kmeans(names: list[str], tolerance: float, rounds: int = 3):
    """k-means of weighted points in one cell: seeds farther apart than the tolerance, then assignment and means; label: the least id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        x, ids, weight = pdf[names].to_numpy(), pdf["a"].to_numpy(), pdf["n"].to_numpy()
        open_ = np.arange(len(x))
        seeds = []
        while len(open_):
            seeds.append(x[open_[0]])
            open_ = open_[np.abs(x[open_] - x[open_[0]]).max(axis=1) > tolerance]
        centre = np.array(seeds)
        for _ in range(rounds):
            label = np.empty(len(x), np.int64)
            for s in range(0, len(x), 1024):
                label[s : s + 1024] = ((x[s : s + 1024, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
            used, label = np.unique(label, return_inverse=True)
            size = np.bincount(label, weight)
            centre = np.stack([np.bincount(label, x[:, k] * weight) / size for k in range(len(names))], axis=1)
        least = np.full(len(centre), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        home = pdf["home"].to_numpy()
        return pd.DataFrame({"a": ids[home], "label": least[label[home]]})

    return run


def directions(x: DataFrame, vectors: int) -> DataFrame:
    """The embedding from the iterated values: their direction, and a quarter of the logarithm of their length (a, x0, x1, ...)."""
    values = [F.col(f"x{k}") for k in range(vectors)]
    length = F.greatest(F.sqrt(sum(v * v for v in values)), F.lit(1e-300))
    return x.select("a", *((v / length).alias(f"x{k}") for k, v in enumerate(values)), (F.log(length) / 4).alias(f"x{vectors}"))


def embedding_kmeans(x: DataFrame, tolerance: float) -> DataFrame:
    """Clusters of the embedding (a, x0, x1, ...): a, label (the least id of the cluster).

    Points that agree within an eighth of the tolerance are one weighted point. Cells are a grid over the first coordinates,
    of a side of eight tolerances; points within two tolerances of a side also stand in the cell beyond it, so a cluster
    is seen whole wherever one of its points is at home.
    """
    names = [c for c in x.columns if c != "a"]
    steps = [f"q{k}" for k in range(len(names))]
    fine = cut(x.select("*", *(F.round(F.col(c) / (tolerance / 8)).cast("bigint").alias(q) for c, q in zip(names, steps))))
    points = cut(fine.groupBy(*steps).agg(F.min("a").alias("a"), F.count("*").alias("n"), *(F.avg(c).alias(c) for c in names)))
    side, margin = 8 * tolerance, 2 * tolerance
    # as many axes as give cells of some hundreds of points; a coordinate of a direction has about a dozen cells
    axes = min(len(names) - 1, max(1, math.ceil(math.log(max(points.count(), 2) / 500, 1 / side))))
    out = points.drop(*steps)
    for k, c in enumerate(names[:axes]):
        out = out.withColumn(f"c{k}", F.explode(F.array_distinct(F.array(*(F.floor((F.col(c) + d) / side) for d in (0.0, -margin, margin))))))
    home = F.lit(True)
    for k in range(axes):
        home = home & (F.col(f"c{k}") == F.floor(F.col(names[k]) / side))
    keys = [f"c{k}" for k in range(axes)]
    found = out.withColumn("home", home).groupBy(*keys).applyInPandas(_cell_kmeans(names, tolerance), "a bigint, label bigint")
    labelled = points.select("a", *steps).join(found, "a").drop("a")
    return fine.select("a", *steps).join(labelled, steps).select("a", "label")


def _distance_to(vec: str, other: str):
    """Pandas-free check of two unit vectors: their dot product, computed per Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.float32).reshape(b.num_rows, -1).astype(float) for c in (vec, other))
            yield pa.RecordBatch.from_arrays(
                [b["a"], b["label"], pa.array(np.einsum("ij,ij->i", x, y))], names=["a", "label", "dot"]
            )

    return run


def _near_links(links: DataFrame, leaders: DataFrame, radius: float) -> DataFrame:
    """``links`` (a, b, w, sure) within the radius; those near the limit are compared by the vectors themselves."""
    unsure = links.where("not sure").select("a", F.col("b").alias("label"))
    if unsure.isEmpty():
        return links.select("a", "b", "w")
    of = leaders.select("id", "vec")
    both = unsure.join(of.select(F.col("id").alias("a"), "vec"), "a").join(of.select(F.col("id").alias("label"), F.col("vec").alias("other")), "label")
    exact = both.select("a", "label", "vec", "other").mapInArrow(_distance_to("vec", "other"), "a bigint, label bigint, dot double")
    near = exact.where(F.col("dot") >= 1 - radius**2 / 2).select("a", F.col("label").alias("b"), F.col("dot").alias("w"))
    return cut(links.where("sure").select("a", "b", "w").unionByName(near))


def _within_reach(labels: DataFrame, both: DataFrame, leaders: DataFrame, radius: float) -> DataFrame:
    """``labels`` after the check of each leader's distance to the most typical leader of its cluster.

    Those out of reach are a cluster of their own, which is checked in turn; as a rule there are none.
    """
    seen, done = leaders.select(F.col("id").alias("a"), "vec"), None
    while True:
        inside = (
            both.join(labels, "a")
            .join(labels.select(F.col("a").alias("b"), F.col("label").alias("other")), "b")
            .where("label = other")
            .groupBy("a", "label")
            .agg(F.sum("w").alias("w"))
        )
        typical = inside.groupBy("label").agg(F.max_by("a", F.struct("w", -F.col("a"))).alias("m"))
        centre = typical.join(seen.withColumnRenamed("a", "m"), "m").select("label", "m", F.col("vec").alias("centre"))
        checked = (  # from here a cluster has the name of its most typical leader
            labels.join(seen, "a")
            .join(centre, "label", "left")
            .select("a", F.coalesce("m", "a").alias("label"), "vec", F.coalesce("centre", "vec").alias("centre"))
            .mapInArrow(_distance_to("vec", "centre"), "a bigint, label bigint, dot double")
        )
        checked = cut(checked)
        near = F.col("dot") >= 1 - radius**2 / 2
        now = checked.where(near).select("a", "label")
        done = now if done is None else done.unionByName(now)
        left = checked.where(~near).select("a", "label")
        if left.isEmpty():
            return done
        labels = cut(left.join(left.groupBy("label").agg(F.min("a").alias("least")), "label").select("a", F.col("least").alias("label")))


def similarity_groups(
    frames: DataFrame,
    key: str = "out_id",
    column: str = "outputs",
    width: int = 64,
    radius: float = 0.45,
    block_tables: int = 12,
    tables: int = 20,
    vectors: int = 8,
    steps: int = 20,
    tolerance: float = 0.02,
) -> DataFrame:
    """Groups of mutually similar vectors: first_id and id, one row per readable vector.

    Two vectors are similar if, each divided by its L2 norm, they are at most ``radius`` apart. ``first_id`` is the
    smallest id of the group; a vector without a similar one is a group of its own. Rows that repeat an id count once;
    rows with a null id or an unreadable vector have no group; other columns are ignored.
    """
    parts = 2
    blocks = cut(
        frames.where(F.col(key).isNotNull())
        .select(F.col(key).cast("bigint").alias("id"), column)
        .mapInArrow(_block_cover(width, radius, block_tables, parts), _COVER)
    )
    leaders = blocks.where("vec is not null").groupBy("id").agg(F.first("vec").alias("vec"))
    links = (
        leaders.mapInArrow(_bucket_entries(tables, parts), "key bigint, id bigint, vec binary")
        .repartition("key")
        .sortWithinPartitions("key", "id")
        .mapInArrow(_bucket_links(radius), "a bigint, b bigint, w double, sure boolean")
        .groupBy("a", "b")
        .agg(F.max("w").alias("w"), F.bool_or("sure").alias("sure"))
    )
    links = _near_links(cut(links), leaders, radius)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    labels = embedding_kmeans(directions(power_iteration(both, vectors, steps), vectors), tolerance)
    labels = cut(_within_reach(cut(labels), both, leaders, radius))
    first = labels.groupBy("label").agg(F.min("a").alias("first_id"))
    of = labels.join(first, "label").select(F.col("a").alias("leader"), "first_id")
    return (
        blocks.select("leader", "id")
        .join(of, "leader", "left")
        .groupBy("id")
        .agg(F.min(F.coalesce("first_id", "leader")).alias("first_id"))
        .select("first_id", "id")
    )


def _units(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = readable_vectors(b[1], width)
            flat = pa.array(unit(x).ravel())
            yield pa.RecordBatch.from_arrays([b[0].take(pa.array(rows)), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, flat)], names=["id", "x"])

    return run


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_rows
        x, s = (b[c].values.to_numpy().reshape(n, -1) if n else np.zeros((0, 1)) for c in ("x", "total"))
        size = b["n_frames"].to_numpy()
        inner = np.where(size > 1, (np.einsum("ij,ij->i", x, s) - 1) / np.maximum(size - 1, 1), 1.0)
        yield pa.RecordBatch.from_arrays([b["first_id"], b["id"], b["n_frames"], pa.array(np.round(inner, 9))], names=["first_id", "id", "n_frames", "affinity"])


def inner_affinity(frames: DataFrame, groups: DataFrame, key: str = "out_id", column: str = "outputs", width: int = 64) -> DataFrame:
    """first_id, id, n_frames (of the group) and affinity: the mean cosine of a member with all others of its group.

    The cosines of a unit vector with all of its group add up to that with the group's sum vector, so no pairs are formed;
    rounded to nine digits, and 1 for a group of one.
    """
    rows = frames.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), column)
    vectors = rows.mapInArrow(_units(width), "id bigint, x array<double>")
    members = cut(groups.join(vectors, "id").dropDuplicates(["id"]))
    total = members.groupBy("first_id").agg(
        F.count("*").alias("n_frames"), F.array(*(F.sum(F.col("x")[k]) for k in range(width))).alias("total")
    )
    both = members.join(total, "first_id").select("first_id", "id", "n_frames", "x", "total")
    return both.mapInArrow(_dots, "first_id bigint, id bigint, n_frames bigint, affinity double")


def describe_groups(members: DataFrame, most: int = 5, salts: int = 256) -> DataFrame:
    """Each group with its size and its most typical members: first_id, n_frames, typical (ids, the best first).

    ``members``: first_id, id, affinity. Members are ranked by affinity, ties by id; parts of a group are ranked before
    the group is brought together, so that a hot group is never in one task.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    w = Window.partitionBy("first_id", "salt").orderBy(F.desc("affinity"), "id")
    parts = (
        members.withColumn("salt", salt)
        .withColumn("rank", F.row_number().over(w))
        .groupBy("first_id", "salt")
        .agg(
            F.count("*").alias("n"),
            F.collect_list(F.when(F.col("rank") <= most, F.struct("affinity", (-F.col("id")).alias("minus")))).alias("top"),
        )
    )
    return (
        parts.select("first_id", "n", "top")
        .groupBy("first_id")
        .agg(F.sum("n").alias("n_frames"), F.flatten(F.collect_list("top")).alias("top"))
        .select(
            "first_id",
            "n_frames",
            F.transform(F.slice(F.sort_array("top", asc=False), 1, most), lambda t: -t["minus"]).alias("typical"),
        )
    )
