"""Deduplicating frames batch by batch against everything accepted before (problem 4), with suffix arrays.

Text: an image is 64 symbols, its levels; a vector is 64 symbols, the cells of its turned unit vector. Near-identical
images differ by more than one level in at most four symbols, so one of five suffixes begins with a stretch in which all
symbols are within one. Vectors within the limit have one of four suffixes that begins with 16 cells within one, as the
squared distance is the sum of that of four stretches. A match of that length is looked for in sorted suffixes by
bisection (see ``suffixes``); its coverage is then counted over the whole texts. So no pair is left to chance.

Suffixes go to leaves of a tree that splits them at symbols of that stretch, those at a split going to both sides, so
that no match is parted; the tree is fitted on a bounded sample, all frames are routed. In a leaf the batches are
replayed: each batch's suffix arrays are immutable segments, searched by the batches after it and merged when of like
size. Of exact copies only the first one has suffixes. What a hot text covers gets no place in a segment, so that a hot
place costs accepted times delivered frames; should such a frame be accepted after all, because its leader is rejected,
it is looked up in all leaves by itself, until every accepted frame has met all others.

Acceptance: all frames with the same image, and all with the same vector, form classes; in a class at most one frame is
accepted. Rounds over the few frames whose class has a copy or a match accept every frame that no undecided frame
before it matches, and reject what matches them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrail.functions.images import PIXELS, decode_images
from placetrail.functions.vectors import readable_vectors, rotation, unit
from placetrail.llm.suffixes import SuffixArray, matches, replay
from placetrail.plans.session import cut
from placetrail.sources.snapshots import ConflictError

MIN_CLOSE = 60
MAX_DISTANCE = 0.03
BLOCK_ROWS = 32768
IMAGE, VECTOR = 0, 1
_ORDER = np.random.default_rng(0).permutation(PIXELS)
#: kind: (start, length of the match) of each suffix that a match may begin with
STARTS = {
    IMAGE: [(int(p[0]), len(p)) for p in np.array_split(np.arange(PIXELS), PIXELS - MIN_CLOSE + 1)],
    VECTOR: [(s, 16) for s in range(0, PIXELS, 16)],
}
#: Side of a vector's cell: of four stretches one has at most a quarter of the squared distance; a little more for rounding.
_CELL = MAX_DISTANCE / 2 + 1e-6
#: Behind the symbols of a vector the place within its cells in 16 steps, two a byte; distances are off by no more than this.
_STEPS, _BRIEF_ERROR = 16, 8 * _CELL / 16
#: Bound of the sample that the routes are fitted on.
MAX_SAMPLE = 65536
_PACKED = "kind int, block int, leaf int, batch bigint, n bigint, ids binary, texts binary"
_MET = "kind int, lo bigint, hi bigint, left_out boolean"
#: Of each hot text, frames that may be looked up by themselves in one round.
ASKED_A_LEADER = 16


def texts_of(values: np.ndarray, kind: int) -> np.ndarray:
    """The text of each image (levels) or vector (cells, and the place within them), uint8."""
    if kind == IMAGE:
        return values[:, _ORDER]
    cell = unit(values) @ rotation(PIXELS, 21) / _CELL + 128
    whole = np.floor(cell)
    fine = np.minimum((cell - whole) * _STEPS, _STEPS - 1).astype(np.uint8)
    return np.concatenate([np.clip(whole, 1, 254).astype(np.uint8), fine[:, ::2] << 4 | fine[:, 1::2]], axis=1)


def suffix_of(texts: np.ndarray, start: int) -> np.ndarray:
    """The texts read around from ``start`` (even for vectors, whose places within cells are two a byte)."""
    return np.concatenate([np.roll(texts[:, :PIXELS], -start, axis=1), np.roll(texts[:, PIXELS:], -start // 2, axis=1)], axis=1)


def _covers(kind: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def images(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a - b + np.uint8(1) <= 2).sum(axis=1) >= MIN_CLOSE  # modulo 256

    def vectors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = a[:, :PIXELS].astype(np.int16) - b[:, :PIXELS]
        apart = np.maximum(np.abs(step) - 1, 0)
        good = (apart * apart).sum(axis=1) <= (MAX_DISTANCE / _CELL) ** 2
        at = np.flatnonzero(good)
        fine = np.empty((len(at), PIXELS), np.int16)
        x, y = a[at, PIXELS:], b[at, PIXELS:]
        fine[:, ::2] = (x >> 4).astype(np.int16) - (y >> 4)
        fine[:, 1::2] = (x & 15).astype(np.int16) - (y & 15)
        d = (step[at] * _STEPS + fine) * (_CELL / _STEPS)
        good[at] = np.sqrt((d * d).sum(axis=1)) <= MAX_DISTANCE + _BRIEF_ERROR
        return good

    return images if kind == IMAGE else vectors


def _unique_rows(x: np.ndarray) -> np.ndarray:
    """The place of the first row of each content."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    return np.unique(raw, return_index=True)[1]


def _squeeze(values: np.ndarray) -> bytes:
    """Compressed, column by column."""
    return pa.compress(np.ascontiguousarray(values.T).tobytes(), "zstd", asbytes=True)


def _expand(raw: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T


def _contents_of(t: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """kind, rows and texts of the readable images and of the readable vectors, copies once (the smallest id)."""
    image, ok = decode_images(t["image"])
    x, x_rows = readable_vectors(t["outputs"], PIXELS)
    ids = t["id"].to_numpy()
    for kind, values, rows in ((IMAGE, image[ok], np.flatnonzero(ok)), (VECTOR, x, x_rows)):
        if len(rows):
            order = np.argsort(ids[rows], kind="stable")
            at = order[_unique_rows(values[order])]
            yield kind, rows[at], texts_of(values[at], kind)


class Routes:
    """For each suffix a tree of splits (symbol, level, where to go below and above) down to numbered leaves."""

    def __init__(self, trees: dict[str, list[list[int]]]):
        self.trees = trees

    @staticmethod
    def fitted(texts: dict[int, np.ndarray], most: float) -> Routes:
        """From a sample of texts: leaves of at most ``most`` of them, as far as their symbols tell them apart."""
        trees = {}
        for kind, starts in STARTS.items():
            for block, (start, length) in enumerate(starts):
                x = suffix_of(texts[kind], start)[:, :length].astype(np.int64)
                nodes: list[list[int]] = [[-1, 0, 1, 0]]
                stack, leaves = [(0, np.arange(len(x)))], 0
                while stack:
                    node, rows = stack.pop()
                    m, v = len(rows), x[rows]
                    low = high = rows
                    if m > most:
                        below = np.bincount((v + 256 * np.arange(length)).ravel(), minlength=256 * length).reshape(-1, 256).cumsum(axis=1)
                        cost = below[:, 1:].astype(float) ** 2 + (m - below[:, :-1]).astype(float) ** 2
                        p, level = divmod(int(cost.argmin()), 255)
                        if cost[p, level] <= 0.8 * m * m:
                            level += 1
                            low, high = rows[v[:, p] <= level], rows[v[:, p] >= level]
                            nodes[node] = [p, level, len(nodes), len(nodes) + 1]
                            stack += [(len(nodes), low), (len(nodes) + 1, high)]
                            nodes += [[-1, 0, 1, 0], [-1, 0, 1, 0]]
                            continue
                    nodes[node] = [-1, leaves, max(1, min(1000, round(m / most))), 0]
                    leaves += 1
                trees[f"{kind}/{block}"] = nodes
        return Routes(trees)

    def leaves(self, suffixes: np.ndarray, kind: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf of each place that a suffix has. A leaf of many parts is one for each pair of its parts."""
        nodes = self.trees[f"{kind}/{block}"]
        rows_out, leaf_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stack = [(0, np.arange(len(suffixes)))]
        while stack:
            node, rows = stack.pop()
            p, a, b, c = nodes[node]
            if not len(rows):
                continue
            if p >= 0:
                v = suffixes[rows, p]
                stack += [(b, rows[v <= a]), (c, rows[v >= a])]
                continue
            mix = np.random.default_rng(5).integers(1, 1 << 62, suffixes.shape[1]).astype(np.uint64)
            own = ((suffixes[rows].astype(np.uint64) @ mix) >> np.uint64(33)).astype(np.int64) % b
            for other in range(b):
                rows_out.append(rows)
                leaf_out.append(a << 20 | np.minimum(own, other) << 10 | np.maximum(own, other))
        return np.concatenate(rows_out), np.concatenate(leaf_out)


def fit_routes(rows: DataFrame, leaf_rows: int, planned_rows: int = 0) -> Routes:
    """Routes to leaves of about ``leaf_rows`` suffixes of ``planned_rows`` frames (those there are, if these are more).

    They are fitted on a sample by hash of at most about MAX_SAMPLE frames.
    """
    n = rows.count()
    planned = max(n, planned_rows, 1)
    wanted = min(MAX_SAMPLE, max(4096, 64 * -(-planned // leaf_rows)))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, _, texts in _contents_of(b):
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([texts.tobytes()])], names=["kind", "texts"])

    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // wanted))) == 0)
    got = some.select("id", "image", "outputs").mapInArrow(sample, "kind int, texts binary").collect()  # bounded
    widths = {IMAGE: PIXELS, VECTOR: PIXELS + PIXELS // 2}
    texts = {k: np.frombuffer(b"".join(r.texts for r in got if r.kind == k), np.uint8).reshape(-1, w) for k, w in widths.items()}
    return Routes.fitted(texts, max(8.0, leaf_rows * min(n, wanted) / planned))


def _pack(routes: Routes):
    """Frames (id, batch, image, outputs) to packed suffixes, copies within a block of rows once."""

    def block_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, batch = t["id"].to_numpy(), t["batch"].to_numpy()
        for kind, rows, texts in _contents_of(t):
            out: list[list] = [[] for _ in _PACKED.split(", ")]
            for block, (start, _) in enumerate(STARTS[kind]):
                suffixes = suffix_of(texts, start)
                at, leaf = routes.leaves(suffixes, kind, block)
                who = rows[at]
                by = np.lexsort((suffixes[at, 1], suffixes[at, 0], batch[who], leaf))
                at, leaf, who = at[by], leaf[by], who[by]
                new = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (batch[who[1:]] != batch[who[:-1]])])
                for s, e in zip(new, np.r_[new[1:], len(at)]):
                    x = suffixes[at[s:e]]
                    if kind == IMAGE:
                        x = x[:, ::2] << 4 | x[:, 1::2]
                    own = np.ascontiguousarray(ids[who[s:e]]).view(np.uint8).reshape(-1, 8)
                    for column, v in zip(out, (kind, block, int(leaf[s]), int(batch[who[s]]), int(e - s), _squeeze(own), _squeeze(x))):
                        column.append(v)
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, c) for v, c in zip(out, types)], names=[c.split()[0] for c in _PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= BLOCK_ROWS:
                yield from block_of(pa.Table.from_batches(held))
                held = []
        if held:
            yield from block_of(pa.Table.from_batches(held))

    return run


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes, ids and row numbers of ``t``; of equal images the smallest id (equal texts of vectors may be two vectors)."""
    kind = t["kind"][0].as_py()
    width = PIXELS // 2 if kind == IMAGE else PIXELS + PIXELS // 2
    n = t["n"].to_pylist()
    ids = np.concatenate([np.ascontiguousarray(_expand(i, m, 8)).view(np.int64).ravel() for i, m in zip(t["ids"].to_pylist(), n)])
    row = np.repeat(np.arange(len(n)), n)
    raw = np.concatenate([_expand(x, m, width) for x, m in zip(t["texts"].to_pylist(), n)])
    order = np.argsort(ids, kind="stable")
    at = order[_unique_rows(raw[order])] if kind == IMAGE else np.unique(ids, return_index=True)[1]
    x = raw[at]
    if kind == IMAGE:
        x = np.stack([x >> 4, x & 15], axis=2).reshape(-1, PIXELS)
    return x, ids[at], row[at]


def _replayed(t: pa.Table) -> pa.Table:
    """One leaf: pairs of texts alike (lo, hi), and texts left out with their hot leader (left_out)."""
    kind, block = t["kind"][0].as_py(), t["block"][0].as_py()
    flag = t["history"].to_numpy().astype(bool)
    sides = []
    for old in (False, True):  # a copy of a frame of history is a text of its own
        of = np.flatnonzero(flag == old)
        if len(of):
            x, ids, row = _unpack(t.take(pa.array(of)))
            sides.append((x, ids, t["batch"].to_numpy()[of[row]], np.full(len(ids), old)))
    x, ids, batch, history = (np.concatenate(c) for c in zip(*sides))
    lo, hi, leader, left = replay(x, ids, batch, STARTS[kind][block][1], _covers(kind), history)
    flag = np.r_[np.zeros(len(lo), bool), np.ones(len(left), bool)]
    return pa.table({"kind": np.full(len(flag), kind, np.int32), "lo": np.r_[lo, leader], "hi": np.r_[hi, left], "left_out": flag})


def _looked_up(t: pa.Table) -> pa.Table:
    """One leaf: pairs of the texts asked for with all others."""
    kind, depth = t["kind"][0].as_py(), STARTS[t["kind"][0].as_py()][t["block"][0].as_py()][1]
    asked = t["asked"].to_numpy(zero_copy_only=False).astype(bool)
    lo, hi = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if asked.any() and not asked.all():
        sides = []
        for s in (asked, ~asked):
            x, ids, _ = _unpack(t.take(pa.array(np.flatnonzero(s))))
            sides.append(SuffixArray(x, ids, depth))
        lo, hi = matches(*sides, _covers(kind))
    return pa.table({"kind": np.full(len(lo), kind, np.int32), "lo": lo, "hi": hi, "left_out": np.zeros(len(lo), bool)})


def meet(packed: DataFrame) -> DataFrame:
    """All pairs of texts alike, of packed suffixes with a column ``history``; see ``_replayed``."""
    return packed.groupBy("kind", "block", "leaf").applyInArrow(_replayed, _MET).distinct()


def look_up(asked: DataFrame, packed: DataFrame) -> DataFrame:
    """All pairs of the texts of ``asked`` with those of ``packed``."""
    columns = [c.split()[0] for c in _PACKED.split(", ")]
    both = asked.select(*columns, F.lit(True).alias("asked")).unionByName(packed.select(*columns, F.lit(False).alias("asked")))
    return both.groupBy("kind", "block", "leaf").applyInArrow(_looked_up, _MET).distinct()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, kind and digest of each readable image and vector."""
    for b in batches:
        image, ok = decode_images(b["image"])
        x, rows = readable_vectors(b["outputs"], PIXELS)
        for kind, values, at in ((IMAGE, image[ok], np.flatnonzero(ok)), (VECTOR, x + 0.0, rows)):
            digest = [hashlib.blake2b(v, digest_size=16).digest() for v in np.ascontiguousarray(values)]
            yield pa.RecordBatch.from_arrays(
                [b["id"].take(pa.array(at)), pa.array(np.full(len(at), kind, np.int32)), pa.array(digest, pa.binary())], names=["id", "kind", "digest"]
            )


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` (cut before), broadcast if its number of rows has been seen to be small."""
    return F.broadcast(df) if df.count() <= rows else df


def shared_contents(frames: DataFrame) -> DataFrame:
    """id and node of each frame whose image or vector another one has too; a node is twice the smallest id, plus kind."""
    contents = cut(frames.select("id", "image", "outputs").mapInArrow(_digests, "id bigint, kind int, digest binary"))
    least = contents.groupBy("kind", "digest").agg(F.min("id").alias("least"), F.max("id").alias("last"))
    shared = cut(least.where("last > least").select("kind", "digest", (F.col("least") * 2 + F.col("kind")).alias("node")))
    return cut(contents.join(small(shared), ["kind", "digest"]).select("id", "node").distinct())


def _exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (unit(readable_vectors(b[c], PIXELS)[0]) for c in ("of_a", "of_b"))
        keep = pa.array(np.flatnonzero(np.sqrt(((x - y) ** 2).sum(axis=1)) <= MAX_DISTANCE))
        yield pa.RecordBatch.from_arrays([b[c].take(keep) for c in ("a", "b")], names=["a", "b"])


def exact_links(frames: DataFrame, met: DataFrame) -> DataFrame:
    """Of pairs (kind, lo, hi), those that match, as pairs of nodes a < b; vectors are compared in double precision."""
    pairs = met.where("not left_out")
    vectors = cut(pairs.where(F.col("kind") == VECTOR).select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    ends = cut(vectors.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    of = frames.join(small(ends), "id", "left_semi").groupBy("id").agg(F.first("outputs").alias("outputs"))
    of = cut(of)
    both = vectors.join(of.select(F.col("id").alias("a"), F.col("outputs").alias("of_a")), "a")
    both = both.join(of.select(F.col("id").alias("b"), F.col("outputs").alias("of_b")), "b")
    exact = both.select("a", "b", "of_a", "of_b").mapInArrow(_exactly, "a bigint, b bigint")
    node = lambda c, kind: (F.col(c) * 2 + kind).alias(c)
    images = pairs.where(F.col("kind") == IMAGE).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    return images.select(node("a", IMAGE), node("b", IMAGE)).unionByName(exact.select(node("a", VECTOR), node("b", VECTOR)))


def settle(members: DataFrame, near: DataFrame) -> DataFrame:
    """The accepted frames (id, node), of ``members`` (id, node) taken in order of id; ``near``: node, other (also itself)."""
    open_, taken = members, members.limit(0)
    while True:
        least = open_.groupBy(F.col("node").alias("other")).agg(F.min("id").alias("least"))
        before = near.join(least, "other").groupBy("node").agg(F.min("least").alias("least"))
        ready = open_.join(before, "node").groupBy("id").agg(F.min("least").alias("least")).where("least >= id").select("id")
        now = cut(open_.join(ready, "id", "left_semi"))
        taken = taken.unionByName(now)
        shut = near.join(now.select(F.col("node").alias("other")), "other").select("node").distinct()
        gone = open_.join(shut, "node", "left_semi").select("id").distinct()
        open_ = cut(open_.join(gone, "id", "left_anti"))
        if open_.isEmpty():
            return cut(taken)


def reject_repeats(shared: DataFrame, links: DataFrame, left_out: DataFrame, look: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Take frames in order of id; give out_id and kept_id of each frame that matches an accepted one before it.

    ``shared``: id and node of frames with copies; ``links``: pairs of nodes that match; ``left_out``: nodes that met
    smaller ids only, each with its leader. Those of them that turn out accepted are looked up (``look`` gives links of
    nodes), some of each leader at a time, and all is settled again, until no accepted one is left that was not looked up.
    """
    links, asked = cut(links), None
    if links.isEmpty() and shared.isEmpty() and left_out.isEmpty():
        return links.select(F.col("a").alias("kept_id"), F.col("b").alias("out_id"))
    while True:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nodes = ends.select(F.col("a").alias("node")).unionByName(shared.select("node")).unionByName(left_out.select("node")).distinct()
        near = cut(ends.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(nodes.select("node", F.col("node").alias("other"))).distinct())
        # the first member of a node is the id in its name
        members = cut(nodes.select(F.shiftright("node", 1).alias("id"), "node").unionByName(shared).distinct())
        taken = settle(members, near)
        open_ = left_out.join(taken.select("node"), "node", "left_semi")
        if asked is not None:
            open_ = open_.join(asked, "node", "left_anti")
        salt = F.pmod(F.xxhash64("node"), F.lit(ASKED_A_LEADER))
        next_ = cut(open_.groupBy("leader", salt).agg(F.min("node").alias("node")).select("node").distinct())
        if next_.isEmpty():
            break
        asked = cut(next_ if asked is None else asked.unionByName(next_))
        links = cut(links.unionByName(look(next_)).distinct())
    kept = near.join(taken.select(F.col("node").alias("other"), F.col("id").alias("kept")), "other")
    kept = kept.groupBy("node").agg(F.min("kept").alias("kept"))
    rejected = members.join(kept, "node").groupBy("id").agg(F.min("kept").alias("kept_id")).where("kept_id < id")
    return rejected.select("kept_id", F.col("id").alias("out_id"))


def rejected_of(rows: DataFrame, met: DataFrame, packed: DataFrame, routes: Routes) -> DataFrame:
    """kept_id and out_id of the rejected frames of ``rows``, from what ``meet`` gave."""

    def look(nodes: DataFrame) -> DataFrame:
        ids = nodes.select(F.shiftright("node", 1).alias("id")).distinct()
        asked = rows.join(ids, "id", "left_semi").mapInArrow(_pack(routes), _PACKED)
        return exact_links(rows, cut(look_up(asked, packed)))

    left = met.where("left_out").select((F.col("lo") * 2 + F.col("kind")).alias("leader"), (F.col("hi") * 2 + F.col("kind")).alias("node"))
    return reject_repeats(shared_contents(rows), exact_links(rows, met), cut(left), look)


def _rows(frames: DataFrame, key: str) -> DataFrame:
    return frames.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.coalesce(F.col("batch_no").cast("bigint"), F.lit(-1)).alias("batch"), "image", "outputs"
    )


def dedupe_batches(frames: DataFrame, key: str = "out_id", leaf_rows: int = 50_000) -> DataFrame:
    """One row per rejected frame: kept_id (the smallest accepted frame that it matches) and out_id.

    Frames (columns ``key``, batch_no, image, outputs) are taken in order of ``key``. Two match if both images are
    readable and near-identical, or both outputs readable and, at unit length, at most 0.03 apart. A frame that matches
    an accepted one before it is rejected. Rows that repeat a key count once; rows with a null key are left out; a null
    batch_no comes before all; a frame with neither readable is always accepted; other columns are ignored.
    """
    rows = _rows(frames, key)
    routes = fit_routes(rows, leaf_rows)
    packed = rows.mapInArrow(_pack(routes), _PACKED)
    return rejected_of(rows, cut(meet(packed.withColumn("history", F.lit(False)))), packed, routes)


class AcceptedIndex:
    """The accepted frames of all batches so far, kept in a folder, for batches that arrive one by one.

    ``segments/s=<n>`` holds the packed suffixes of the frames that one batch added, by leaf, and ``frames/s=<n>`` their
    contents; both are written once and never changed. Segments of like size are merged into a new one, so that there are
    never more than a logarithm of them. ``versions/<n>.json`` names the live segments and the routes; it can be created
    only once, so the second of two writers from one version fails with ConflictError. A batch computes suffixes of its
    own frames only; of history it reads the leaves that these lie in, and contents of frames that they may match.
    """

    def __init__(self, spark: SparkSession, root: str, leaf_rows: int = 50_000, planned_rows: int = 10_000_000):
        self.spark, self.root = spark, root.rstrip("/")
        self.leaf_rows, self.planned_rows = leaf_rows, planned_rows
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        folder = self._path(f"{self.root}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        self.version = max((int(n[:-5]) for n in names if n[:-5].isdigit()), default=0)
        self.state: dict = {"routes": None, "live": []}
        if self.version:
            self.state = json.loads(spark.read.text(f"{self.root}/versions/{self.version:09d}.json", wholetext=True).first()[0])

    def _commit(self) -> None:
        name = self._path(f"{self.root}/versions/{self.version + 1:09d}.json")
        try:
            out = self._fs.create(name, False)
        except Exception as e:
            raise ConflictError(f"another writer made version {self.version + 1}") if self._fs.exists(name) else e
        try:
            out.write(bytearray(json.dumps(self.state).encode()))
        finally:
            out.close()
        self.version += 1

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{what}/s={s}" for s, _ in self.state["live"]]
        return self.spark.read.option("basePath", f"{self.root}/{what}").schema(schema).parquet(*paths).drop("s") if paths else self.spark.createDataFrame([], schema)

    def _write(self, name: str, n: int, frames: DataFrame, segments: DataFrame) -> None:
        frames.write.mode("overwrite").parquet(f"{self.root}/frames/s={name}")
        segments.repartition("kind", "block", "leaf").write.partitionBy("kind", "block", "leaf").mode("overwrite").parquet(f"{self.root}/segments/s={name}")
        self.state["live"].append([name, n])

    def add(self, frames: DataFrame, key: str = "out_id") -> DataFrame:
        """Take a batch: gives its rejected frames (kept_id, out_id) and adds the accepted ones.

        Keys must be larger than those of the batches before, in which case the result is that of ``dedupe_batches``
        over all batches together.
        """
        rows = cut(_rows(frames, key).dropDuplicates(["id"]))
        if self.state["routes"] is None:
            self.state["routes"] = fit_routes(rows, self.leaf_rows, self.planned_rows).trees
        routes = Routes(self.state["routes"])
        packed = cut(rows.mapInArrow(_pack(routes), _PACKED))
        touched = packed.groupBy("kind", "block").agg(F.collect_set("leaf").alias("leaves")).collect()  # no more than there are leaves
        there = F.lit(False)
        for r in touched:
            there = there | ((F.col("kind") == r.kind) & (F.col("block") == r.block) & F.col("leaf").isin(r.leaves))
        known = self._read("segments", _PACKED).where(there)
        every = packed.withColumn("history", F.lit(False)).unionByName(known.withColumn("history", F.lit(True)))
        met = cut(meet(every))
        ends = cut(met.where(F.col("kind") == VECTOR).select(F.col("lo").alias("id")).distinct())
        old = self._read("frames", "id bigint, image string, outputs array<float>").join(small(ends), "id", "left_semi")
        seen = cut(old.unionByName(rows.select("id", "image", "outputs")))
        rejected = cut(rejected_of(seen, met, packed.unionByName(known), routes))
        kept = cut(rows.join(rejected.select(F.col("out_id").alias("id")), "id", "left_anti"))
        n = kept.count()
        if n:
            self._write(uuid.uuid4().hex, n, kept.select("id", "image", "outputs"), kept.mapInArrow(_pack(routes), _PACKED))
            while len(self.state["live"]) > 1 and self.state["live"][-2][1] <= 2 * self.state["live"][-1][1]:
                two, self.state["live"] = self.state["live"][-2:], self.state["live"][:-2]
                of = lambda what: self.spark.read.option("basePath", f"{self.root}/{what}").parquet(*(f"{self.root}/{what}/s={s}" for s, _ in two)).drop("s")
                self._write(uuid.uuid4().hex, two[0][1] + two[1][1], of("frames"), of("segments").select(*(c.split()[0] for c in _PACKED.split(", "))))
        self._commit()
        return rejected
