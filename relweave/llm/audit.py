"""Audit of filter interactions: what every order of the filters keeps and removes, at every step."""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from relweave.llm.scratch import Scratch, clean

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: bits of a counter; a count of rows fits a long, so a field never runs into the next
FIELD = 64
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(text: Column) -> list[Column]:
    """Failure of filters A to D on a text, in this order: short, repetitive, capitals, markup."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic)`` of every document; bit i of the mask is the i-th filter's failure.

    Texts are read once; what meets other rows is an id, a part, a mask and a SHA-256 of the
    text. Copies of a text are counted before they meet, and the join that brings the least id
    back runs between written tables, so a text that fills a third of all rows can be split.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    short = clean(docs, doc_id="long", source="string", text="string").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"),
        sum((f.cast("int") * (1 << i) for i, f in enumerate(failures(text))), F.lit(0)).alias("mask"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    short = scratch.save(short)
    # only texts of two ids at least can fail, so the table that meets the rows holds no single text
    least = scratch.save(short.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).filter("least < last").drop("last"))
    rows = short.join(least, "key", "left").select(
        "doc_id", "part", (F.col("mask") + F.when(F.col("least") < F.col("doc_id"), 1 << 4).otherwise(0)).alias("mask"))
    marks = clean(labels, doc_id="long", quality="long", toxic="long").filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # null ids have no label: they would only meet in one task
    known = rows.filter("doc_id is not null").join(marks, "doc_id", "left")
    unknown = rows.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return known.unionByName(unknown).select(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def step_counters(filters: str = FILTERS) -> tuple[list[tuple[str, int]], list[dict[str, int]]]:
    """The fields ``(order, step)``, and for each mask its big integers ``kept``, ``removed``, ``redundant``.

    Field f of such an integer is 1 if a document with the mask has that outcome there.
    """
    fields = [("".join(p), s) for p in permutations(filters) for s in range(len(filters))]
    out = []
    for mask in range(1 << len(filters)):
        wide = {"kept": 0, "removed": 0, "redundant": 0}
        for at, (order, step) in enumerate(fields):
            fails = [mask >> filters.index(f) & 1 for f in order]
            if not any(fails[:step + 1]):
                wide["kept"] |= 1 << FIELD * at
            elif fails[step]:
                wide["redundant" if any(fails[:step]) else "removed"] |= 1 << FIELD * at
        out.append(wide)
    return fields, out


def unpack(wide: int, fields: int) -> list[int]:
    """The counters of a big integer, lowest field first."""
    data = wide.to_bytes(fields * FIELD // 8, "little")
    return [int.from_bytes(data[i:i + FIELD // 8], "little") for i in range(0, len(data), FIELD // 8)]


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every part, filter order and step: ``(part, filter_order, step, kept, removed, ...)``.

    Documents are first counted by part, mask and label, at most 128 rows a part whatever its
    size. A mask stands for three big integers with a 64-bit field for each of the 600 steps;
    a part's integers are summed with those counts as weights and unpacked once. No field can
    overflow, as a part has fewer rows than a field can count.

    Null texts are empty, null sources the part ``''`` (which an empty source shares). A null
    id has no label, is no smaller id and has none. A repeated row counts again; rows of one id
    and text don't fail E by each other. An id labelled twice is good, or toxic, if any of its
    labels says so. An empty table gives no rows, empty labels no losses; extra columns are ignored.
    """
    counts = failure_masks(docs, labels).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("c"))
    names = ["part", "filter_order", "step", *_COUNTS]

    def unfold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fields, wide = step_counters()
        total = dict.fromkeys(["kept", "removed", "redundant", "good_lost", "toxic_lost"], 0)
        alone = dict.fromkeys(FILTERS, 0)
        for mask, good, toxic, c in zip(rows["mask"].tolist(), rows["good"].tolist(), rows["toxic"].tolist(), rows["c"].tolist()):
            for what in ("kept", "removed", "redundant"):
                total[what] += c * wide[mask][what]
            total["good_lost"] += c * good * wide[mask]["removed"]
            total["toxic_lost"] += c * toxic * wide[mask]["removed"]
            for i, f in enumerate(FILTERS):
                alone[f] += c * (mask == 1 << i)
        seen = {what: unpack(v, len(fields)) for what, v in total.items()}
        shapley = dict.fromkeys(FILTERS, 0)
        for (order, step), n in zip(fields, seen["removed"]):
            shapley[order[step]] += n
        return pd.DataFrame([
            (key[0], order, step + 1, seen["kept"][i], seen["removed"][i], seen["redundant"][i], alone[order[step]],
             seen["good_lost"][i], seen["toxic_lost"][i], shapley[order[step]])
            for i, (order, step) in enumerate(fields)], columns=names)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)
    return counts.groupBy("part").applyInPandas(unfold, schema)
