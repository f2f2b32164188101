"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from relweave.llm.kernel import distinct_per_doc, slices, words
from relweave.llm.scratch import Scratch, add_blocks, arrow, clean, rows_per_task, share_of

#: token identifiers are folded into so many counters, which bounds the model at 4 MB
BUCKETS = 1 << 20
_BLOCK = 1 << 16
#: labelled rows the classifier is fitted on, about; more are thinned by a hash of the id
MOST_TRAINING_ROWS = 200_000
#: tokens of the corpus-shaped Dirichlet prior, and its flat part for each token
PRIOR_TOKENS = 1000.0
FLAT_PRIOR = 0.5
#: a token's log-odds count as far as they exceed so many standard deviations
DEVIATIONS = 1.64
#: segments are modelled above this score
FLOOR = 1.0
PREDICT_AT = 0.7


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def token_buckets(w) -> np.ndarray:
    return (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64)


def maximal_segments(score: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, first, end)`` of one sequence, in linear time.

    Runs of positive scores enter one by one with the cumulative score on their left and right.
    A run joins the nearest earlier segment that starts lower if that one also ends lower;
    otherwise it stands. Each segment remembers the nearest one that starts lower, so that a
    search never passes the same segment twice.
    """
    up = score > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(up.astype(np.int8), prepend=0, append=0))
    total = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
    stack: list[list] = []  # left, right, first, end, index of the nearest that starts lower
    for a, b, left, right in zip(edge[::2].tolist(), edge[1::2].tolist(), total[edge[::2]].tolist(), total[edge[1::2]].tolist()):
        first = a
        at = len(stack) - 1
        while True:
            while at >= 0 and stack[at][0] >= left:
                at = stack[at][4]
            if at < 0 or stack[at][1] >= right:
                stack.append([left, right, first, b, at])
                break
            left, first = stack[at][0], stack[at][2]
            del stack[at:]
            at -= 1
    return [(r - l, f, e) for l, r, f, e, _ in stack]


@dataclass
class Model:
    """Token scores by bucket, the tail of clean segments, and the final logistic curve."""

    score: np.ndarray
    rate: float = 1.0
    scale: float = 1.0
    intercept: float = -2.0
    slope: float = 1.0


def _log_odds(toxic: np.ndarray, plain: np.ndarray, prior: np.ndarray, n_toxic: float, n_plain: float) -> np.ndarray:
    """Log-odds of each bucket under Dirichlet priors, shrunk by their uncertainty."""
    a, b = toxic + prior, plain + prior
    total = prior.sum()
    delta = np.log(a / (n_toxic + total)) - np.log(b / (n_plain + total))
    return (delta - DEVIATIONS * np.sqrt(1 / a + 1 / b)).astype(np.float32)


def _train_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``(doc_id, y)`` of labelled rows outside the held-out part, about ``most`` at most."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter("doc_id is not null and y in (0, 1)").filter(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return rows


def _count_tokens(rows: DataFrame) -> np.ndarray:
    """Documents that hold each token bucket: all, toxic training rows, clean training rows."""

    def count(batches):
        held = np.zeros((3, BUCKETS), np.uint64)
        for b in batches:
            texts, ys = b.column("text").to_pylist(), b.column("y").to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts):
                w = words(texts[lo:hi])
                d, t, _ = distinct_per_doc(w.doc, token_buckets(w), BUCKETS.bit_length() - 1)
                t = t.astype(np.int64)
                y = ys[lo:hi][d] if len(d) else d
                held[0] += np.bincount(t, minlength=BUCKETS).astype(np.uint64)
                for k, v in ((1, 1), (2, 0)):
                    held[k] += np.bincount(t[y == v], minlength=BUCKETS).astype(np.uint64)
        for i in range(0, BUCKETS, _BLOCK):
            if held[0, i:i + _BLOCK].any():
                yield arrow("block int, data binary", block=[i // _BLOCK], data=[zlib.compress(held[:, i:i + _BLOCK].tobytes(), 1)])

    n = max(1, rows_per_task(rows) // (BUCKETS // _BLOCK))
    partial = rows.select("text", "y").mapInArrow(count, "block int, data binary").withColumn("share", share_of(n))
    out = np.zeros((3, BUCKETS), np.uint64)
    for r in add_blocks(partial, _BLOCK, "uint64").collect():
        i = r["block"] * _BLOCK
        out[:, i:i + _BLOCK] = np.frombuffer(zlib.decompress(r["data"]), np.uint64).reshape(3, -1)
    return out.astype(np.float64)


_FOUND = "n int, scores array<float>, firsts array<int>, ends array<int>"


def _find_segments(rows: DataFrame, tables) -> DataFrame:
    """Segments above the floor of every ``text``; ``tables`` holds scores by ``y`` (null, 0, 1).

    All columns but the text come along.
    """
    carried = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType(carried + T.StructType.fromDDL(_FOUND).fields)

    def find(batches):
        for b in batches:
            place = {n: i for i, n in enumerate(b.schema.names)}
            texts, ys = b.column(place["text"]).to_pylist(), b.column(place["y"]).to_pylist()
            for lo, hi in slices(texts):
                w = words(texts[lo:hi])
                t = token_buckets(w)
                n, scores, firsts, ends = [], [], [], []
                for i in range(hi - lo):
                    a, z = int(w.first[i]), int(w.first[i + 1])
                    found = [s for s in maximal_segments(tables.value[ys[lo + i]][t[a:z]]) if s[0] >= FLOOR]
                    n.append(z - a)
                    scores.append([s[0] for s in found])
                    firsts.append([s[1] for s in found])
                    ends.append([s[2] for s in found])
                made = arrow(_FOUND, n=n, scores=scores, firsts=firsts, ends=ends)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(place[f.name]) for f in carried] + made.columns, names=[f.name for f in carried] + made.schema.names)

    return rows.mapInArrow(find, schema)


def _surprise(rate: float, scale: float) -> Column:
    """Sum over segments of -ln E, where E = n * rate * exp(-(score - floor) / scale) is the number
    of clean segments as good that a text of n words is expected to have; E above 1 adds nothing."""
    base = F.log(F.greatest(F.col("n"), F.lit(1)) * F.lit(rate))
    return F.aggregate("scores", F.lit(0.0), lambda t, s: t + F.greatest(F.lit(0.0), (s.cast("double") - FLOOR) / scale - base))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a little shrinkage; the slope is not negative."""
    w = np.zeros(2)
    a = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 1e-2])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([1e-6, 1e-2]) * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = MOST_TRAINING_ROWS) -> Model:
    """Learn token scores and their calibration from labelled rows outside the held-out part.

    The prior of every token is its document share over *all* documents; class counts come from
    about ``most_rows`` labelled rows at most, which also bounds the broadcast of their labels.
    Scores used for calibration leave the row's own contribution out. Labels other than 0 and 1
    say nothing and are left out. Without any row of one class every score is the share of
    label 1 (0 without labels).
    """
    docs = clean(docs, doc_id="long", text="string")
    scratch = Scratch(docs.sparkSession)
    train = scratch.save(_train_rows(docs, labels, label, most_rows))
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        base = 0.0 if not sizes.get(1) else 1.0
        return Model(np.zeros(BUCKETS, np.float32), intercept=30.0 * (2 * base - 1), slope=0.0)
    every, toxic, plain = _count_tokens(docs.join(F.broadcast(train), "doc_id", "left"))
    prior = FLAT_PRIOR + PRIOR_TOKENS * every / max(every.sum(), 1.0)
    n1, n0 = toxic.sum(), plain.sum()
    score = _log_odds(toxic, plain, prior, n1, n0)
    without = {1: _log_odds(np.maximum(toxic - 1, 0), plain, prior, n1, n0), 0: _log_odds(toxic, np.maximum(plain - 1, 0), prior, n1, n0)}
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(without)
    known = scratch.save(_find_segments(docs.join(F.broadcast(train), "doc_id"), tables).drop("firsts", "ends"))
    tail = known.filter("y = 0").select(
        F.sum("n").alias("n"), F.sum(F.size("scores")).alias("k"),
        F.sum(F.aggregate("scores", F.lit(0.0), lambda t, s: t + s.cast("double") - FLOOR)).alias("over")).first()
    rate = (tail["k"] or 0) / max(tail["n"] or 1, 1)
    m = Model(score, max(rate, 1e-9), max((tail["over"] or 0.0) / max(tail["k"] or 1, 1), 0.05))
    points = known.select("y", F.log1p(_surprise(m.rate, m.scale)).alias("x")).toPandas()
    m.intercept, m.slope = _logistic(points["x"].to_numpy(float), points["y"].to_numpy(float))
    scratch.drop(train, known)
    return m


def _probability(model: Model) -> Column:
    x = F.log1p(_surprise(model.rate, model.scale))
    return 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * x)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, n_words, n_passages, passages)`` for every row of ``docs``.

    A passage is a maximal segment less than one of which is expected in a clean text of that
    length, as ``(first word, end word, score)``. Null and empty texts have no passages and get
    the base score. Repeated rows are scored each, a null id is carried along; whole texts of
    any length are read.
    """
    docs = clean(docs, doc_id="long", text="string")
    tables = docs.sparkSession.sparkContext.broadcast({None: model.score})
    found = _find_segments(docs.withColumn("y", F.lit(None).cast("int")), tables)
    base = F.log(F.greatest(F.col("n"), F.lit(1)) * F.lit(model.rate))
    passages = F.filter(
        F.arrays_zip(F.col("firsts").alias("first"), F.col("ends").alias("end"), F.col("scores").alias("score")),
        lambda p: (p["score"].cast("double") - FLOOR) / model.scale > base)
    return found.select(
        "doc_id", _probability(model).alias("score"), F.col("n").alias("n_words"), passages.alias("passages")).withColumn("n_passages", F.size("passages"))


def drop_toxic(docs: DataFrame, model: Model, at: float = PREDICT_AT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``at``."""
    tables = docs.sparkSession.sparkContext.broadcast({None: model.score})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    found = _find_segments(rows.withColumn("y", F.lit(None).cast("int")), tables)
    return found.filter(_probability(model) < at).select("row.*")
