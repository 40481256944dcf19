"""The k most similar vectors of every vector (problem 5): graph search in shards.

Pivots, fitted on a bounded sample, cut the space into cells. A vector is indexed in its nearest cell alone, and asks
there and in every other cell that is hardly farther. A cell is one shard, or, above ``shard_rows``, as many as it takes.
Over each shard a robust-pruned graph (see ``graph``) is built, once; the queries of the cell walk it with a beam. Graphs
of a cell of one shard are searched where they are built, those of a larger cell are written and met by the cell's
queries in slices. What the shards found is brought together per vector, ranked by the exact distance. All rows are
indexed and all are queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placetrail.functions.vectors import readable_vectors
from placetrail.llm.graph import Graph
from placetrail.plans.session import cut

SHARD_ROWS = 16384
#: Settings of the graphs; walks go on from vectors within REACH limits only, after the first steps.
REACH, SETTINGS = 1.6, {"degree": 24, "beam": 32, "entry_part": 4, "patience": 32}
#: Bound of the sample that the pivots are taken from.
MAX_PIVOTS = 4096


def _floats(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _readable(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = readable_vectors(b[1], width)
            vec = pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_arrays([b[0].take(pa.array(rows)), vec], names=["id", "vec"])

    return run


def _cells(x: np.ndarray, pivots: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and cell of each membership, and whether it is the row's nearest cell."""
    p2 = np.einsum("ij,ij->i", pivots, pivots)
    rows, cells, home = [], [], []
    for s in range(0, len(x), 2048):
        q = x[s : s + 2048].astype(np.float64)
        d = np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q)[:, None] + p2[None] - 2 * q @ pivots.T, 0))
        nearest = d.argmin(axis=1)
        r, c = np.nonzero(d <= d.min(axis=1, keepdims=True) + margin)
        rows.append(r + s)
        cells.append(c)
        home.append(c == nearest[r])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *cells]), np.concatenate([none.astype(bool), *home])


def _ask(graph: Graph, ids: np.ndarray, asked: np.ndarray, x: np.ndarray, place: np.ndarray, k: int, limit: float) -> pa.Table:
    """The nearest of ``ids``, the vectors of the graph, for each asked id with its vector (``place``: where it is in the graph, or -1)."""
    out_q, out_n, out_d = [], [], []
    for s in range(0, len(asked) if graph.n else 0, 512):
        q = slice(s, s + 512)
        seen, _ = graph.search(x[q], place[q])
        other = np.where(seen >= 0, ids[seen], -1)
        diff = x[q].astype(np.float64)[:, None] - graph.x[np.maximum(seen, 0)].astype(np.float64)
        d = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
        d[(seen < 0) | (other == asked[q, None]) | (d > limit)] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        d = np.take_along_axis(d, best, axis=1)
        r, c = np.nonzero(np.isfinite(d))
        out_q.append(asked[q][r])
        out_n.append(np.take_along_axis(other, best, axis=1)[r, c])
        out_d.append(d[r, c])
    none = np.zeros(0, np.int64)
    columns = (np.concatenate([none, *out_q]), np.concatenate([none, *out_n]), np.concatenate([np.zeros(0), *out_d]))
    return pa.table({c: pa.array(v) for c, v in zip(("id", "neighbour", "distance"), columns)})


def _whole_cell(width: int, k: int, limit: float):
    """A cell of one shard: the graph of those at home, asked by all."""

    def run(t: pa.Table) -> pa.Table:
        ids, at = np.unique(t["id"].to_numpy(), return_index=True)  # a repeated row counts once
        x, home = _floats(t["vec"], width)[at], t["home"].to_numpy(zero_copy_only=False)[at].astype(bool)
        place = np.where(home, np.cumsum(home) - 1, -1).astype(np.int32)
        graph = Graph(x[home], reach=REACH * limit, **SETTINGS)
        return _ask(graph, ids[home], ids, x, place, k, limit)

    return run


def _build(width: int, limit: float):
    """One shard of a larger cell: its graph."""

    def run(t: pa.Table) -> pa.Table:
        ids, at = np.unique(t["id"].to_numpy(), return_index=True)
        graph = Graph(_floats(t["vec"], width)[at], reach=REACH * limit, **SETTINGS)
        row = {"cell": t["cell"][0].as_py(), "i": t["i"][0].as_py(), "ids": ids.tobytes(), **graph.state()}
        return pa.table({c: pa.array([v], pa.int64() if c == "cell" else pa.int32() if c == "i" else pa.binary()) for c, v in row.items()})

    return run


def _met(width: int, k: int, limit: float):
    """One graph and one slice of queries of its cell."""

    def run(graphs: pa.Table, queries: pa.Table) -> pa.Table:
        if not graphs.num_rows or not queries.num_rows:
            return _ask(Graph(np.zeros((0, width), np.float32), **SETTINGS), *(np.zeros(0, np.int64),) * 4, k, limit)
        row = graphs.slice(0, 1).to_pylist()[0]
        graph, ids = Graph.restored(row, width, reach=REACH * limit, **SETTINGS), np.frombuffer(row["ids"], np.int64)
        asked, at = np.unique(queries["id"].to_numpy(), return_index=True)
        place = np.searchsorted(ids, asked)
        place = np.where(ids[np.minimum(place, len(ids) - 1)] == asked, place, -1).astype(np.int32)
        return _ask(graph, ids, asked, _floats(queries["vec"], width)[at], place, k, limit)

    return run


def nearest_neighbours(
    halves: DataFrame,
    column: str,
    width: int,
    key: str = "half_id",
    k: int = 5,
    limit: float = 0.8,
    shard_rows: int = SHARD_ROWS,
    margin: float = 0.2,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """The ``k`` nearest vectors of every readable vector: id, neighbour, distance, rank (1 is the nearest).

    Distances are L2 without scaling, in double precision; vectors more than ``limit`` away are no neighbours, nor is a
    vector its own. Of equally near ones the smaller id comes first. Rows that repeat an id count once; rows with a null
    id or an unreadable vector are left out; other columns are ignored. The search is approximate: see
    ``neighbour_recall``.
    """
    rows = halves.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("bigint").alias("id"), column)
    vectors = cut(rows.mapInArrow(_readable(width), "id bigint, vec binary"))
    n = vectors.count()
    found_type = "id bigint, neighbour bigint, distance double"
    if n == 0:
        return vectors.sparkSession.createDataFrame([], found_type + ", rank int")
    count = int(min(max_pivots, max(1, -(-n // (shard_rows // 2)))))
    sample = vectors.orderBy(F.xxhash64("id"), "id").select("vec").limit(count).collect()  # bounded by max_pivots
    pivots = np.unique(np.stack([np.frombuffer(r.vec, np.float32) for r in sample]), axis=0).astype(np.float64)

    def belong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, c, home = _cells(_floats(b["vec"], width), pivots, margin)
            columns = [b["id"].take(pa.array(r)), b["vec"].take(pa.array(r)), pa.array(c), pa.array(home)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vec", "cell", "home"])

    members = vectors.mapInArrow(belong, "id bigint, vec binary, cell bigint, home boolean")
    sizes = members.groupBy("cell").agg(F.count_if("home").alias("n"), F.count("*").alias("asks")).collect()  # one row per pivot
    large = {r.cell: (-(-r.n // shard_rows), -(-r.asks // (4 * shard_rows))) for r in sizes if r.n > shard_rows}
    one = members.where(~F.col("cell").isin(list(large))) if large else members
    found = one.groupBy("cell").applyInArrow(_whole_cell(width, k, limit), found_type)
    if large:
        of = lambda at: F.element_at(F.create_map(*(F.lit(v) for c, ns in large.items() for v in (int(c), ns[at]))), F.col("cell"))
        many = members.where(F.col("cell").isin(list(large)))
        part = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
        others = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        shards = many.where("home").withColumn("i", part(3, of(0))).groupBy("cell", "i")
        graphs = cut(shards.applyInArrow(_build(width, limit), "cell bigint, i int, ids binary, x binary, out binary, entry binary"))
        graphs = graphs.withColumn("j", others(of(1)))
        queries = many.select("id", "vec", "cell", part(4, of(1)).alias("j"), others(of(0)).alias("i"))
        met = graphs.groupBy("cell", "i", "j").cogroup(queries.groupBy("cell", "i", "j")).applyInArrow(_met(width, k, limit), found_type)
        found = found.unionByName(met)
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return (
        found.groupBy("id", "neighbour")
        .agg(F.min("distance").alias("distance"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """Each pair of which at least one is a neighbour of the other, once: id_lo, id_hi."""
    return neighbours.select(
        F.least("id", "neighbour").alias("id_lo"), F.greatest("id", "neighbour").alias("id_hi")
    ).distinct()


def brute_force(halves: DataFrame, column: str, width: int, key: str = "half_id", every: int = 100, k: int = 5, limit: float = 0.8) -> DataFrame:
    """The true neighbours of the rows whose id ``every`` divides: blocks of these queries against blocks of all rows."""
    rows = halves.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("bigint").alias("id"), column)
    vectors = cut(rows.mapInArrow(_readable(width), "id bigint, vec binary"))

    def blocks(*names: str):
        return lambda batches: (made for b in batches for made in blocks_of(b, list(names)))

    def blocks_of(b: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
        for s in range(0, b.num_rows, 4096):
            part = b.slice(s, 4096)
            ids = part["id"].to_numpy().tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([b"".join(part["vec"].to_pylist())])], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, vecs, qids, qvecs in zip(*(b[c].to_pylist() for c in ("ids", "vecs", "qids", "qvecs"))):
                i, q = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                x = np.frombuffer(vecs, np.float32).reshape(-1, width).astype(float)
                y = np.frombuffer(qvecs, np.float32).reshape(-1, width).astype(float)
                d = np.sqrt(np.maximum((y * y).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * y @ x.T, 0))
                d[q[:, None] == i[None]] = np.inf
                d[d > limit] = np.inf
                best = np.argpartition(d, k, axis=1)[:, : k + 1] if d.shape[1] > k + 1 else np.argsort(d, axis=1)  # more than k: ties go by id later
                at_k = np.sort(np.take_along_axis(d, best, axis=1), axis=1)[:, min(k, d.shape[1]) - 1]
                r, c = np.nonzero((d <= at_k[:, None]) & np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(i[c]), pa.array(d[r, c])], names=["id", "neighbour", "distance"])

    asked = vectors.where(F.col("id") % every == 0).repartition(max(1, -(-vectors.count() // (4096 * every))))
    asked = cut(asked.mapInArrow(blocks("qids", "qvecs"), "qids binary, qvecs binary"))
    few = asked.count() <= 64  # of at most 4,096 vectors each; more are met block by block without a broadcast
    pairs = (
        cut(vectors.mapInArrow(blocks("ids", "vecs"), "ids binary, vecs binary"))
        .crossJoin(F.broadcast(asked) if few else asked)
        .mapInArrow(compare, "id bigint, neighbour bigint, distance double")
    )
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return (
        pairs.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    )


def neighbour_recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """How many of the true neighbours were found: n_true, n_found, recall (null where there are none)."""
    hit = found.select("id", "neighbour", F.lit(1).alias("hit"))
    return true.join(hit, ["id", "neighbour"], "left").agg(
        F.count("*").alias("n_true"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found")
    ).withColumn("recall", F.try_divide("n_found", "n_true"))
