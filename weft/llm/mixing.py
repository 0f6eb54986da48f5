"""Mixing sources to target weights by cube-method balanced sampling.

A source's target is its weight's share of all words, at most ``cap`` times what
the source holds; what exceeds the cap is shared out again by weight.  With
r = target / size of the source, a document is taken floor(r) times for certain
and once more with probability r - floor(r).  The cube method moves these
fractional probabilities through the null space of two balancing constraints
(words and documents of the block) until at most two documents of a block are
undecided (flight).  The undecided of all blocks meet in blocks again, round by
round; a source's last block keeps ten documents back, and the landing picks,
of all samples of those still undecided, one nearest to the balance.

Blocks are dealt within a source by a hash of the whole row, and of its number among
equal rows, so a hot source or key is many blocks and no task holds more than a block.
The seed and the rows decide every draw, so reruns agree.

Defined cases: null or empty text has size 0 and is taken 0 times; a null source
is a source of its own, last in order; repeated rows are decided one by one; a
source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.stages import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BLOCK = 4096
LANDING = 10
_EPS = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size) -> the same with ``target``.

    target = min(cap * size, level * weight) for the one level at which targets
    sum to all words (or the caps, if those are less): what repeated resharing of
    the excess comes to.  Sources are visited by cap / weight, so every capped one
    comes before every free one.  One row a source stands in this window.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("_i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("_level", level)
    # the first source, in this order, whose cap is not below its own level sets the level for itself and all after it
    free = F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_i").alias("i"), F.col("_level").alias("l")))).over(everything)
    return levelled.withColumn("_free", free).select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_free.l") * F.col("_w"), F.col("_cap"))).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Fast flight phase: two balancing variables, probabilities and words.

    Three undecided units at a time move along the direction u that keeps both
    sum(u) and sum(u * size) at zero, until one of them reaches 0 or 1; at most
    two stay undecided.
    """
    p = p.astype(float).copy()
    hand: list[int] = []
    draws = iter(rng.random(len(p) + 3).tolist())
    for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist():
        hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = (float(size[j]) for j in hand)
        u = (b - c, c - a, a - b)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[j]) / v if v > 0 else -p[j] / v for j, v in zip(hand, u) if v)
        down = min(p[j] / v if v > 0 else (p[j] - 1) / v for j, v in zip(hand, u) if v)
        step = up if next(draws) * (up + down) < down else -down
        for j, v in zip(hand, u):
            p[j] = min(1.0, max(0.0, p[j] + step * v))
        hand = [j for j in hand if _EPS < p[j] < 1 - _EPS]
    return p


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The small landing problem: of all samples of the last few undecided units,
    one whose words, and then whose count, come nearest to what is expected."""
    p = p.astype(float).copy()
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if len(left):
        samples = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
        words, count = size[left].astype(float), p[left].sum()
        cost = np.abs(samples @ words - p[left] @ words) / max(1.0, words.mean()) + 0.1 * np.abs(samples.sum(1) - count)
        best = np.flatnonzero(cost <= cost.min() + 1e-12)
        p[left] = samples[rng.choice(best)]
    return np.where(p >= 0.5, 1.0, 0.0)


def decide(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Flight over a block; the last block of a source keeps a few units back for its landing."""
    if not last:
        return flight(p, size, rng)
    held = rng.permutation(np.flatnonzero((p > _EPS) & (p < 1 - _EPS)))[:LANDING]
    first = p.astype(float).copy()
    first[held] = 0.0
    first = flight(first, size, rng)
    first[held] = p[held]
    return landing(first, size, rng)


def _fly(last: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "size", "_tie", "_tie2", "_turn"], kind="stable")
        rng = np.random.default_rng([seed, int(pdf["_block"].iloc[0]) & 0xFFFFFFFF, int(pdf["_round"].iloc[0])])
        pdf["_p"] = decide(pdf["_p"].to_numpy(), pdf["size"].to_numpy(), rng, last)
        return pdf

    return run


def _row_id(docs: DataFrame) -> list[Column]:
    """128 bits of hash over all columns, nulls told from values: equal for equal rows only."""
    every = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(F.lit(salt), *every).alias(name) for salt, name in ((1, "_tie"), (2, "_tie2"))]


def _decided(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, block: int = BLOCK) -> DataFrame:
    """One row a document: _tie, _tie2 (its row id), _key, source, size, source_size, target, copies."""
    sized = stage(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *_row_id(docs)), "mix-sizes")
    # equal rows get a number each, so that no block holds all rows of a hot key, or all equal rows
    numbered = sized.groupBy("_tie", "_tie2", "_key", "source", "size").count().withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count")))).drop("count")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    targets = stage(source_targets(sizes.drop("_rows"), weights, cap), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # the number of blocks of a source follows its rows; the join side is one row a source
    plan = targets.join(sizes.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_s"), "source_size", "target", ratio.alias("_ratio"), F.greatest(F.lit(1), F.ceil(F.col("_rows") / block)).cast("long").alias("_blocks")
    )
    plan = plan.withColumn("_sid", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "_s"), F.lit("n"))))
    units = numbered.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select(
        "_key", "_tie", "_tie2", "_turn", "source", "size", "source_size", "target", "_sid", "_blocks", F.floor("_ratio").cast("long").alias("_whole"), F.when(F.col("size") > 0, F.col("_ratio") - F.floor("_ratio")).otherwise(F.lit(0.0)).alias("_p")
    )
    units = units.withColumn("_block", F.xxhash64("_sid", F.pmod(F.xxhash64(F.lit(seed), "_tie", "_tie2", "_turn"), F.col("_blocks")))).withColumn("_round", F.lit(0))
    done: list[DataFrame] = []
    open_p = (F.col("_p") > _EPS) & (F.col("_p") < 1 - _EPS)
    most = plan.agg(F.max("_blocks")).first()[0] or 1
    turn = 0
    while True:
        last = most <= 1
        flown = stage(units.groupBy("_block").applyInPandas(_fly(last, seed), units.schema), f"mix-flight{turn}")
        done.append(flown if last else flown.where(~open_p))
        if last:
            break
        turn += 1
        most = -(-2 * most // block)  # two undecided a block at most
        units = flown.where(open_p).withColumn("_round", F.lit(turn)).withColumn("_block", F.xxhash64("_sid", F.pmod(F.xxhash64(F.lit(seed + turn), "_tie", "_tie2", "_turn"), F.lit(most))))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.round("_p").cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select("_tie", "_tie2", "_key", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, block: int = BLOCK) -> DataFrame:
    """One row a document: key, source, size, source_size, target, copies, taken."""
    out = _decided(docs, weights, cap, key, text, source, seed, block)
    return out.select(F.col("_key").alias(key), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns only.

    Rows are decided one by one, whatever their keys; rows equal in all columns stand
    as often as they are taken together.
    """
    a, b = _row_id(docs)
    total = _decided(docs, **options).groupBy(F.col("_tie").alias("_a"), F.col("_tie2").alias("_b")).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    # equal rows become one, in each task first; the join deals by the same id
    rows = docs.select("*", a, b).dropDuplicates(["_tie", "_tie2"])
    taken = rows.join(total, (F.col("_tie") == F.col("_a")) & (F.col("_tie2") == F.col("_b")))
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
