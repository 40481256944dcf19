"""Mixing sources to target weights (problem 7): pivotal dependent rounding of copy numbers.

A source with rate r gives each of its documents floor(r) copies and a further one with probability r - floor(r). The
further copies are not drawn one by one: documents of neighbouring size pass their probability to each other at random
until one of the two is 0 or 1, so that the sum, and nearly the number of tokens, stays what it should be. This runs in
blocks of bounded size; each block leaves at most one document undecided, and these few are combined block by block in
a reduction tree until one is left per source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrail.llm.encoding import encode_corpus
from placetrail.plans.session import cut

BLOCK_DOCS = 4096
FAN_IN = 64
_EPS = 1e-9


def token_counts(documents: DataFrame, key: str = "doc_id", column: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``key``, source and n_tokens of each row, in tokens of a byte-level rank file; 0 for an empty or null text."""
    return encode_corpus(documents, key, column, ranks_path, keep=("source",), count_only=True)


def copy_rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target source: its share, its tokens and the rate at which its documents are used.

    Weights of a source that stands twice add up, its least ``max_repeats`` holds; a weight that is null, not positive
    or not finite, a null source and a max_repeats below 1 count as no target. Shares are those among the sources that
    have tokens. Without ``total_tokens`` the mixture is the largest one in which every source reaches its share; with
    it, a source that cannot fill its part stays at ``max_repeats`` and the others keep their parts.
    """
    wanted = (
        targets.where("source is not null and target_weight > 0 and target_weight < double('infinity') and max_repeats >= 1")
        .groupBy("source")
        .agg(F.sum("target_weight").alias("target_weight"), F.min("max_repeats").alias("max_repeats"))
    )
    held = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    both = wanted.join(held, "source", "left").na.fill(0, ["tokens", "n_docs"])
    there = F.when(F.col("tokens") > 0, F.col("target_weight"))
    sums = both.agg(F.sum(there).alias("all_weight"), F.min(F.col("max_repeats") * F.col("tokens") / there).alias("largest"))
    size = F.col("largest") * F.col("all_weight") if total_tokens is None else F.lit(float(total_tokens))
    rate = F.least(F.col("max_repeats").cast("double"), F.col("target_share") * size / F.col("tokens"))
    return (
        both.crossJoin(F.broadcast(sums))  # one row
        .withColumn("target_share", F.coalesce(there / F.col("all_weight"), F.lit(0.0)))
        .withColumn("rate", F.when(F.col("tokens") > 0, rate).otherwise(0.0))
        .withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < _EPS, F.round("rate")).otherwise(F.col("rate")))
        .drop("all_weight", "largest")
    )


def pivot(p: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Round probabilities by the pivotal method in the order given; at most one stays between 0 and 1.

    ``chance`` has one uniform number per unit. Sums are kept exactly up to rounding, and each unit's expected value
    is its probability.
    """
    p = p.astype(float).copy()
    open_ = -1
    for k in range(len(p)):
        if p[k] < _EPS or p[k] > 1 - _EPS:
            p[k] = round(p[k])
            continue
        if open_ < 0:
            open_ = k
            continue
        a, b = p[open_], p[k]
        s = a + b
        if s < 1:
            if chance[k] * s < a:
                p[open_], p[k] = s, 0.0
            else:
                p[open_], p[k], open_ = 0.0, s, k
        elif chance[k] * (2 - s) < 1 - b:
            p[open_], p[k], open_ = 1.0, s - 1, k
        else:
            p[open_], p[k] = s - 1, 1.0
        if p[open_] < _EPS or p[open_] > 1 - _EPS:
            p[open_] = round(p[open_])
            open_ = -1
    return p


def _pivot_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "chance", "row_key"], kind="stable")
    return pdf.assign(p=pivot(pdf["p"].to_numpy(), pdf["chance"].to_numpy()))


def mix(
    documents: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    ranks_path: str | None = None,
    total_tokens: int | None = None,
    seed: int = 17,
    block_docs: int = BLOCK_DOCS,
    fan_in: int = FAN_IN,
    heavy_part: float = 0.005,
) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, n_tokens, copies of each document used) and the shares it reaches.

    Shares: source, target_weight, target_share, max_repeats, available_tokens, mixed_tokens, actual_share, most_copies;
    one row per target source, also for one that has no documents. Documents without a source, of a source without a
    target, or with an empty or null text are not used. Every row is a document of its own. The draw depends on
    ``seed``, the key and the size only, not on how the rows are partitioned.
    """
    # a hash collision of two keys only makes two draws depend on each other
    sized = token_counts(documents, key, ranks_path=ranks_path).withColumnRenamed(key, "row_key")
    sizes = cut(sized.where("source is not null and n_tokens > 0"))
    rates = cut(copy_rates(sizes, targets, total_tokens))
    kind = sizes.schema["row_key"].dataType.simpleString()
    schema = f"row_key {kind}, source string, n_tokens bigint, whole bigint, p double, chance double, block bigint"
    def rounded(docs: DataFrame, rate: DataFrame) -> DataFrame:
        """``docs`` with their copies; ``rate`` has source, rate and n_docs (one row per target, so it is broadcast)."""
        most = rate.agg(F.max("n_docs")).first()[0] or 0
        rest = docs.join(F.broadcast(rate), "source").select(
            "row_key",
            "source",
            "n_tokens",
            F.floor("rate").alias("whole"),
            (F.col("rate") - F.floor("rate")).alias("p"),
            (F.pmod(F.xxhash64(F.lit(seed), "row_key", "n_tokens"), F.lit(1 << 30)) / float(1 << 30)).alias("chance"),
            F.pmod(F.xxhash64("row_key", F.lit(seed + 1)), F.ceil(F.col("n_docs") / block_docs)).alias("block"),
        )
        done = []
        for level in range(1 + math.ceil(math.log(max(most / block_docs, 1), fan_in)) if most else 0):
            if level:
                rest = rest.withColumn("block", F.floor(F.col("block") / fan_in))
            level_out = cut(rest.groupBy("source", "block").applyInPandas(_pivot_block, schema))
            done.append(level_out.where("p = 0 or p = 1"))
            rest = level_out.where("p > 0 and p < 1")
        last = rest.withColumn("p", F.when(F.col("chance") < F.col("p"), 1.0).otherwise(0.0))
        for part in done:
            last = last.unionByName(part)
        return last.withColumn("copies", (F.col("whole") + F.col("p")).cast("bigint")).drop("whole", "p", "chance", "block")

    # Documents above a small part of their source's target are drawn first; the rate of the others then makes up for
    # what came out, so that a few very long documents don't move the shares.
    want = rates.select("source", "max_repeats", "rate", (F.col("rate") * F.col("tokens")).alias("want"))
    parted = sizes.join(F.broadcast(want), "source").withColumn("heavy", F.col("n_tokens") > heavy_part * F.col("want"))
    parted = parted.drop("max_repeats", "rate", "want")
    counted = parted.groupBy("source", "heavy").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("light_tokens"))
    heavy_rate = counted.where("heavy").join(want, "source").select("source", "rate", "n_docs")
    heavy = rounded(parted.where("heavy").drop("heavy"), heavy_rate)
    drawn = heavy.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn"))
    left = (F.col("want") - F.coalesce("drawn", F.lit(0))) / F.col("light_tokens")
    left = F.least(F.col("max_repeats").cast("double"), F.greatest(left, F.lit(0.0)))
    left = F.when(F.abs(left - F.round(left)) < _EPS, F.round(left)).otherwise(left)
    light_rate = counted.where("not heavy").join(want, "source").join(drawn, "source", "left")
    light = rounded(parted.where("not heavy").drop("heavy"), light_rate.select("source", left.alias("rate"), "n_docs"))
    mixture = (
        heavy.unionByName(light)
        .where("copies > 0")
        .select(F.col("row_key").alias(key), "source", "n_tokens", "copies")
    )
    reached = mixture.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies")
    )
    total = reached.agg(F.sum("mixed_tokens").alias("all_tokens"))
    shares = (
        rates.join(reached, "source", "left")
        .crossJoin(F.broadcast(total))  # one row
        .select(
            "source",
            "target_weight",
            "target_share",
            "max_repeats",
            F.col("tokens").alias("available_tokens"),
            F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
            F.coalesce(F.try_divide("mixed_tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
    )
    return mixture, shares
