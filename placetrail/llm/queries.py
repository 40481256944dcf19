"""Registered queries of the operators for training data, and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrail.llm.batches import AcceptedIndex, dedupe_batches
from placetrail.llm.encoding import encode_corpus, word_counts
from placetrail.llm.mixing import mix
from placetrail.llm.neighbours import brute_force, nearest_neighbours, neighbour_pairs, neighbour_recall
from placetrail.llm.runs import collapse_runs
from placetrail.llm.spectral import describe_groups, inner_affinity, similarity_groups
from placetrail.llm.truncation import truncated, truncation_by_source
from placetrail.plans.session import shared_path
from placetrail.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "descriptor", "out_id", "outputs")
    described = describe_groups(inner_affinity(frames, similarity_groups(frames)))
    return described.withColumn("typical", F.concat_ws(",", F.col("typical").cast("array<string>")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    groups = similarity_groups(table(spark, d, "descriptor", "out_id", "outputs"))
    shared = groups.groupBy("first_id").agg(F.count("*").alias("n")).where("n > 1").select("first_id")
    return groups.join(shared, "first_id", "left_semi").select("first_id", F.col("id").alias("out_id"))


def p2_events(spark: SparkSession, d: str) -> DataFrame:
    runs = collapse_runs(table(spark, d, "frame_event"))
    return runs.withColumn("started_us", F.unix_micros("started_at")).drop("started_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(table(spark, d, "frame_event")).where("n_frames >= 2").select("seq", "first_capture_no", "last_capture_no")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return dedupe_batches(table(spark, d, "descriptor", "out_id", "batch_no", "image", "outputs"))


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same frames through an index of accepted ones: all batches but the last one, then the last one as it arrives."""
    frames = table(spark, d, "descriptor", "out_id", "batch_no", "image", "outputs")
    index = AcceptedIndex(spark, shared_path(spark, "accepted"), planned_rows=frames.count())
    last = F.lit(frames.agg(F.max("batch_no")).first()[0])
    before = index.add(frames.where(F.col("batch_no").isNull() | (F.col("batch_no") < last)))
    return before.unionByName(index.add(frames.where(F.col("batch_no") == last)))


#: Vector fields of half_descriptor and their widths.
FIELDS = {"outputs": 40, "output8": 32}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    halves = table(spark, d, "half_descriptor", "half_id", *FIELDS)
    a, b = (neighbour_pairs(nearest_neighbours(halves, c, w)) for c, w in FIELDS.items())
    return a.unionByName(b).distinct()


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    halves = table(spark, d, "half_descriptor", "half_id", *FIELDS)
    a, b = (
        neighbour_recall(nearest_neighbours(halves, c, w), brute_force(halves, c, w)).withColumn("field", F.lit(c))
        for c, w in FIELDS.items()
    )
    return a.unionByName(b)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p6_words(spark: SparkSession, d: str) -> DataFrame:
    return word_counts(table(spark, d, "documents", "text")).selectExpr("hex(word) as word_hex", "n")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_target"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_target"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "documents", "doc_id", "text", "source")).select("doc_id")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents", "doc_id", "text", "source")
    return truncation_by_source(documents, truncated(documents))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_events": p2_events,
    "p4_found": p4_found,
    "p4_batches": p4_batches,
    "p5_found": p5_found,
    "p5_recall": p5_recall,
    "p6_ids": p6_ids,
    "p6_words": p6_words,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_sources": p8_sources,
}
_READABLE = "{c} IS NOT NULL AND len({c}) = {w} AND list_aggregate(list_transform({c}, lambda v: (v IS NOT NULL AND isfinite(v))::INT), 'min') = 1 AND list_aggregate(list_transform({c}, lambda v: (v <> 0)::INT), 'max') = 1"
_UNIT = "list_transform({c}, lambda v: v::DOUBLE / sqrt(list_sum(list_transform({c}, lambda u: u::DOUBLE * u::DOUBLE))))"
_LEVELS = "list_transform(range(1, 65), lambda k: instr('0123456789abcdef', lower(right(image, 64))[k]))"
_IMAGE = f"CASE WHEN regexp_full_match(image, '(0x)?[0-9a-fA-F]{{64}}') THEN {_LEVELS} END"
_CLOSE = "len(list_filter(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]) <= 1)) >= 60"


def _neighbours_sql(column: str, width: int) -> str:
    return f"""(WITH r AS (SELECT DISTINCT half_id, {column} AS v FROM half_descriptor WHERE {_READABLE.format(c=column, w=width)}),
 x AS (SELECT half_id, list_transform(v, lambda t: t::DOUBLE) AS x FROM r),
 d AS (SELECT a.half_id AS i, b.half_id AS j, list_distance(a.x, b.x) AS d FROM x a JOIN x b ON a.half_id <> b.half_id),
 k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d WHERE d <= 0.8)
 SELECT least(i, j) AS id_lo, greatest(i, j) AS id_hi FROM k WHERE rank <= 5)"""


_STRETCHES = f"""WITH e AS (SELECT DISTINCT event_id, seq, capture_no, captured_at, image, image_number FROM frame_event WHERE seq IS NOT NULL AND capture_no IS NOT NULL),
g AS (SELECT seq, capture_no, captured_at, image_number, {_IMAGE} AS im FROM e),
l AS (SELECT *, lag(im) OVER w AS pm, lag(image_number) OVER w AS pn, lag(capture_no) OVER w AS pc FROM g WINDOW w AS (PARTITION BY seq ORDER BY capture_no)),
a AS (SELECT *, CASE WHEN pc IS NULL THEN false
  WHEN im IS NOT NULL AND pm IS NOT NULL THEN {_CLOSE.format(a="im", b="pm")} AND coalesce(abs(image_number - pn) <= 1, true)
  ELSE coalesce(image_number = pn, false) END AS ok FROM l),
s AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY seq ORDER BY capture_no) AS run FROM a)"""
SQL: dict[str, str] = {
    "p1_found": f"""WITH r AS (SELECT DISTINCT out_id, outputs FROM descriptor WHERE {_READABLE.format(c="outputs", w=64)}),
u AS (SELECT out_id, {_UNIT.format(c="outputs")} AS x FROM r)
SELECT min(b.out_id) AS first_id, a.out_id FROM u a JOIN u b ON list_distance(a.x, b.x) <= 0.45 GROUP BY a.out_id HAVING count(*) > 1""",
    "p1_groups": f"""WITH r AS (SELECT DISTINCT out_id, outputs FROM descriptor WHERE {_READABLE.format(c="outputs", w=64)}),
u AS MATERIALIZED (SELECT out_id, {_UNIT.format(c="outputs")} AS x FROM r),
g AS MATERIALIZED (SELECT min(b.out_id) AS first_id, a.out_id, any_value(a.x) AS x FROM u a JOIN u b ON list_distance(a.x, b.x) <= 0.45 GROUP BY a.out_id),
e AS (SELECT first_id, unnest(x) AS v, unnest(range(64)) AS k FROM g),
c AS (SELECT first_id, k, sum(v) AS v FROM e GROUP BY first_id, k),
t AS (SELECT first_id, list(v ORDER BY k) AS total FROM c GROUP BY first_id),
n AS (SELECT first_id, count(*) AS n_frames FROM g GROUP BY first_id),
m AS (SELECT first_id, out_id, n_frames, CASE WHEN n_frames > 1 THEN round((list_dot_product(x, total) - 1) / (n_frames - 1), 9) ELSE 1.0 END AS affinity
  FROM g JOIN t USING (first_id) JOIN n USING (first_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY first_id ORDER BY affinity DESC, out_id) AS rank FROM m)
SELECT first_id, n_frames::BIGINT AS n_frames, string_agg(out_id::VARCHAR, ',' ORDER BY rank) AS typical FROM k WHERE rank <= 5 GROUP BY first_id, n_frames""",
    "p2_found": f"{_STRETCHES} SELECT seq, min(capture_no) AS first_capture_no, max(capture_no) AS last_capture_no FROM s GROUP BY seq, run HAVING count(*) > 1",
    "p2_events": f"""{_STRETCHES} SELECT seq, min(capture_no) AS first_capture_no, max(capture_no) AS last_capture_no, count(*) AS n_frames,
epoch_us(min(captured_at)) AS started_us, epoch_us(max(captured_at)) - epoch_us(min(captured_at)) AS duration_us FROM s GROUP BY seq, run""",
    "p4_found": f"""WITH RECURSIVE r AS MATERIALIZED (SELECT DISTINCT out_id, {_IMAGE} AS im,
  CASE WHEN {_READABLE.format(c="outputs", w=64)} THEN {_UNIT.format(c="outputs")} END AS x FROM descriptor),
p AS MATERIALIZED (SELECT a.out_id AS i, b.out_id AS j FROM r a JOIN r b ON b.out_id < a.out_id
  AND (coalesce(list_distance(a.x, b.x) <= 0.03, false) OR (a.im IS NOT NULL AND b.im IS NOT NULL AND {_CLOSE.format(a="a.im", b="b.im")}))),
m AS MATERIALIZED (SELECT i, js, row_number() OVER (ORDER BY i) AS n FROM (SELECT i, list(j ORDER BY j) AS js FROM p GROUP BY i)),
t(n, gone, kept_id, out_id) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT n, CASE WHEN k IS NULL THEN gone ELSE list_append(gone, i) END, k, CASE WHEN k IS NOT NULL THEN i END FROM (
    SELECT m.n, m.i, t.gone, list_min(list_filter(m.js, lambda j: NOT list_contains(t.gone, j))) AS k FROM t JOIN m ON m.n = t.n + 1))
SELECT kept_id, out_id FROM t WHERE kept_id IS NOT NULL""",
    "p5_found": f"{_neighbours_sql('outputs', 40)} UNION {_neighbours_sql('output8', 32)}",
}
SQL["p4_batches"] = SQL["p4_found"]
