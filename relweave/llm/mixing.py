"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from relweave.llm.scratch import Scratch, clean

WORD = r"[^\x20\x09-\x0D]+"
#: rows of one source that share a range of the random key, on average
RANGE_ROWS = 50_000
#: sources whose targets are broadcast to the rows; more of them are joined
MOST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words of each source: ``(source, source_size, target)``.

    Sources take the weights in turn by code point, null last. Together they get ``share`` of
    all words by weight; a source stops at ``most`` times its size and what is left over is
    shared again by weight. The fixed point is ``min(most * size, level * weight)``: with
    sources in order of ``most * size / weight``, the level is the smallest one at which the
    sources after it stay below their cap. One row per source, so the tables here are small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.lit(None).cast("double")
    for i, w in enumerate(weights):
        pick = F.when(F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) == i, F.lit(float(w))).otherwise(pick)
    cap = F.lit(float(most)) * F.col("source_size")
    rows = per.select("*", pick.alias("weight"), cap.alias("cap")).withColumn("turn", F.col("cap") / F.col("weight"))
    up = W.orderBy("turn", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    down = W.orderBy("turn", F.col("source").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy(F.lit(1))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(down)
    rows = rows.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", F.col("source").isNull().alias("z"), "source", "level"))).over(every)
    rows = rows.withColumn("found", found["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("found") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", "n", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 20240607) -> DataFrame:
    """Words the mix takes of each document: ``(doc_id, size, source, source_size, target, taken)``.

    Every document gets a random key from a hash of its id and text. A source's documents are
    cut into ranges of that key, as many as its rows ask for; the sources' targets come to the rows
    and not the rows to their source. Range totals give each range its offset, and a running sum inside the range finishes the prefix sum, so a source with a
    third of all rows is spread over many tasks. With a target of ``e`` whole epochs and a
    rest, every document is taken ``e`` times and the rest goes to the head of the order; the
    document at the cut is taken in part, so a source's words are exactly its target rounded down.

    Null or empty texts have size 0 and are taken with 0 words. Null sources form one source.
    Repeated rows count each; equal keys are ordered by id and then by text hash, and rows equal
    in both are interchangeable. An empty table gives no rows.
    """
    rows = clean(docs, doc_id="long", source="string", text="string").select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("body"),
    )
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "body")
    # 52 random bits: exact as a double, and any SQL engine can derive them
    rows = rows.withColumn("key", F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long"))
    # null-safe key: the flag keeps the null source apart from every text
    rows = rows.withColumn("s", F.struct(F.col("source").isNull().alias("z"), F.coalesce("source", F.lit("")).alias("v")))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(rows)  # texts are read and hashed once
    goal = source_targets(rows, weights, share, most)
    goal = scratch.save(goal.select(F.struct(F.col("source").isNull().alias("z"), F.coalesce("source", F.lit("")).alias("v")).alias("s"), "source_size", "target", "n"))
    rows = rows.join(F.broadcast(goal) if goal.count() <= MOST_SOURCES else goal, "s")
    ranges = F.ceil(F.col("n") / RANGE_ROWS)
    at = F.floor(F.col("key") / F.lit(float(2**52)) * ranges).cast("long")
    rows = rows.withColumn("r", at)
    before = W.partitionBy("s").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("s", "r").agg(F.sum("size").alias("words")).select(
        "s", "r", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("s", "r").orderBy("key", "doc_id", "body").rowsBetween(W.unboundedPreceding, 0)
    # without its own exchange the window would keep the join's partitions by source alone
    rows = rows.repartition("s", "r").withColumn("upto", F.sum("size").over(inside)).join(offsets, ["s", "r"])
    start = F.col("offset") + F.col("upto") - F.col("size")
    whole = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    rest = whole - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return rows.select("doc_id", "size", "source", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))
