"""Aggregates as of many instants, without pairing rows and instants.

A key with n rows and m cutoffs costs n + m rows here, not n x m.  Rows that stay visible once
they are seen go through one merged stream of rows and cutoffs with running states.  Values
that change meanwhile (an inner aggregate moves with the cutoff) hold over a range of a key's
cutoffs; such a range is cut into dyadic nodes, states are aggregated per node, and a cutoff
reads the few nodes above it.  Hot keys are cut into time buckets by the running sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from relweave.functions.scalar import col
from relweave.plans.ordering import FOLDS, numbered, running

# a key of so many cutoffs at most may join its rows with them; beyond, rows and cutoffs are merged
MANY_CUTOFFS = 32
STATIC_PRIMITIVES = ("count", "max", "min", "mean", "mode", "arraymax", "arraymin", "arraymean")
CHANGING_PRIMITIVES = ("max", "min", "mean")


def clock(kinds: Sequence[T.DataType]) -> str:
    """How instants of these column types are compared: as ``time``, ``long`` or ``double``."""
    if any(isinstance(k, (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)) for k in kinds):
        return "time"
    return "long" if all(isinstance(k, T.IntegralType) for k in kinds) else "double"


def instant(c: Column, how: str) -> Column:
    """A time as microseconds, a number as it is."""
    return F.unix_micros(c.cast("timestamp")) if how == "time" else c.cast(how)


def always(how: str) -> Column:
    """Before every instant: rows that no time column limits."""
    return F.lit(float("-inf")) if how == "double" else F.lit(-(1 << 62)).cast("long")


@dataclass(frozen=True)
class Spec:
    """One aggregate: output name, primitive, the event column it reads, and that column's width."""

    out: str
    prim: str
    source: str | None = None
    size: int = 1


@dataclass(frozen=True)
class _State:
    columns: dict[str, tuple[Column, str]]  # name -> (value of an event, how values fold)
    result: Column


def _sum_type(kind: T.DataType) -> str:
    return f"decimal(38,{kind.scale})" if isinstance(kind, T.DecimalType) else "double"


def _state(i: int, spec: Spec, kind: T.DataType | None, weight: Column) -> _State:
    a, n = f"__a{i}", f"__n{i}"
    c = col(spec.source) if spec.source else F.lit(1)
    here = F.when(c.isNotNull(), weight)
    if spec.prim == "count":
        return _State({n: (here, "sum")}, F.coalesce(F.col(n), F.lit(0)).cast("long"))
    if spec.prim in ("max", "min"):
        return _State({a: (c, spec.prim)}, F.col(a))
    if spec.prim == "mean":
        mean = F.col(a) / F.col(n)
        if isinstance(kind, T.DecimalType):
            mean = mean.cast(T.DecimalType(min(38, kind.precision + 4), min(37, kind.scale + 4)))
        return _State({a: ((c.cast(_sum_type(kind)) * weight).cast(_sum_type(kind)), "sum"), n: (here, "sum")},
                      F.when(F.col(n) > 0, mean))
    if spec.prim in ("arraymax", "arraymin", "arraymean"):
        fold = {"arraymax": "max", "arraymin": "min", "arraymean": "sum"}[spec.prim]
        columns = {n: (here, "sum")}
        for j in range(spec.size):
            # a null vector counts as zeros if its group has any vector
            at = F.coalesce(F.get(c, F.lit(j)).cast("double"), F.lit(0.0))
            columns[f"{a}_{j}"] = (at if fold != "sum" else at * weight, fold)
        every = f"__r{i}"
        columns[every] = (weight, "sum")
        parts = [F.col(f"{a}_{j}") / (F.col(every) if fold == "sum" else F.lit(1)) for j in range(spec.size)]
        return _State(columns, F.when(F.col(n) > 0, F.array(*parts)))
    raise ValueError(f"no running form of {spec.prim!r}")


def before(probes: DataFrame, events: DataFrame, specs: Sequence[Spec], inclusive: bool = False,
           seen: str | None = None) -> DataFrame:
    """Aggregates of each probe's key over the events before its instant.

    ``probes``: ``__key``, ``__at`` (an instant) and columns to carry; ``events``: ``__key``, ``__at`` and the
    columns that the specs read.  Probes without an earlier event of their key give no row.
    ``seen`` names a boolean event column: only such events make a probe's group exist.
    """
    kinds = {f.name: f.dataType for f in events.schema.fields}
    one = F.lit(1).cast("long")
    plain = [(i, s) for i, s in enumerate(specs) if s.prim != "mode"]
    states = {i: _state(i, s, kinds.get(s.source), one) for i, s in plain}
    folds = {n: how for st in states.values() for n, (_, how) in st.columns.items()} | {"__seen": "sum"}
    mark = F.when(F.col(seen), one).otherwise(F.lit(0).cast("long")) if seen else one
    base = events.filter("__key IS NOT NULL AND __at IS NOT NULL")
    stream = base.select("__key", "__at", mark.alias("__seen"),
                         *[c.alias(n) for st in states.values() for n, (c, _) in st.columns.items()])
    for i, s in enumerate(specs):
        if s.prim == "mode":
            # the count of a value only grows, so the largest count ever reached is the current one
            per = base.filter(col(s.source).isNotNull()).groupBy("__key", "__at", col(s.source).alias("__v")).agg(F.count("*").alias("__c"))
            per = running(per, ["__at"], ["__key", "__v"], {"__c": "sum"})
            per = per.select("__key", "__at", F.lit(0).cast("long").alias("__seen"),
                             F.struct((-F.col("__c")).alias("c"), F.col("__v").alias("v")).alias(f"__a{i}"))
            stream = stream.unionByName(per, allowMissingColumns=True)
            states[i] = _State({}, F.col(f"__a{i}")["v"])
            folds[f"__a{i}"] = "min"
    carried = [c for c in probes.columns if c not in ("__key", "__at")]
    late, early = F.lit(1), F.lit(0)
    stream = stream.withColumn("__turn", early if inclusive else late)
    asked = probes.filter("__key IS NOT NULL AND __at IS NOT NULL").withColumns(
        {"__turn": late if inclusive else early, "__probe": F.lit(True)})
    merged = stream.unionByName(asked, allowMissingColumns=True)
    out = running(merged, ["__at", "__turn"], ["__key"], folds).filter("__probe AND __seen > 0")
    return out.select("__key", "__at", *[col(c) for c in carried], *[states[i].result.alias(s.out) for i, s in enumerate(specs)])


_NODES = """
explode(flatten(transform(sequence(0, cast(floor(log2(__r - __l)) AS int)), j -> filter(array(
  CASE WHEN shiftright(__l + shiftleft(1L, j) - 1, j) < shiftright(__r, j) AND shiftright(__l + shiftleft(1L, j) - 1, j) % 2 = 1
       THEN struct(j AS j, shiftright(__l + shiftleft(1L, j) - 1, j) AS i) END,
  CASE WHEN shiftright(__l + shiftleft(1L, j) - 1, j) < shiftright(__r, j) AND shiftright(__r, j) % 2 = 1
       THEN struct(j AS j, shiftright(__r, j) - 1 AS i) END), x -> x IS NOT NULL))))
"""


def during(probes: DataFrame, steps: DataFrame, specs: Sequence[Spec], inclusive: bool = False) -> DataFrame:
    """Aggregates over the values that hold at each probe's instant.

    ``steps``: ``__key``, ``__row`` (columns that tell one source row from another, as a struct),
    ``__from`` (the row's value from here until its next step), ``__tau`` (orders steps of equal
    ``__from``; the last one holds), ``__w`` (how many rows it stands for) and the values.  A
    step covers a range of the key's probes, counted from the latest.  The range is cut into
    at most two dyadic nodes per level; states fold per node, and a probe folds the nodes above it.
    """
    kinds = {f.name: f.dataType for f in steps.schema.fields}
    states = {i: _state(i, s, kinds.get(s.source), F.col("__w")) for i, s in enumerate(specs)}
    folds = {n: how for st in states.values() for n, (_, how) in st.columns.items()}
    values = sorted({s.source for s in specs if s.source})
    carried = [c for c in probes.columns if c not in ("__key", "__at")]
    asked = probes.filter("__key IS NOT NULL AND __at IS NOT NULL")
    ticks = asked.select("__key", (-F.col("__at")).alias("__neg"), F.lit(0 if inclusive else 1).alias("__turn"), F.lit(1).cast("long").alias("__r"))
    starts = steps.filter("__key IS NOT NULL AND __from IS NOT NULL").select(
        "__key", (-F.col("__from")).alias("__neg"), F.lit(1 if inclusive else 0).alias("__turn"), F.lit(0).cast("long").alias("__r"),
        "__row", (-F.col("__tau")).alias("__ntau"), "__w", *[col(v) for v in values], F.lit(True).alias("__step"))
    ranked = running(starts.unionByName(ticks, allowMissingColumns=True), ["__neg", "__turn"], ["__key"], {"__r": "sum"}).filter("__step")
    # later steps of the row take the latest probes away; what is left is this step's range
    spans = running(ranked.withColumn("__l", F.col("__r")), ["__neg", "__ntau"], ["__key", "__row"], {"__l": "max"}, exclusive=True)
    spans = spans.withColumn("__l", F.coalesce("__l", F.lit(0).cast("long"))).filter("__l < __r")
    nodes = spans.select("__key", F.expr(_NODES).alias("__node"), "__w", *[col(v) for v in values])
    nodes = nodes.groupBy("__key", "__node").agg(*[FOLDS[how](c).alias(n) for st in states.values() for n, (c, how) in st.columns.items()])
    order = numbered(asked.withColumn("__neg", -F.col("__at")), ["__neg"], ["__key"], "__i", total="__m").drop("__neg")
    above = order.select("__key", "__at", *[col(c) for c in carried], F.explode(F.expr(
        "transform(sequence(0, cast(floor(log2(__m)) AS int)), j -> struct(j AS j, shiftright(__i - 1, j) AS i))")).alias("__node"))
    met = above.join(nodes, ["__key", "__node"])
    out = met.groupBy("__key", "__at", *[col(c) for c in carried]).agg(*[FOLDS[how](F.col(n)).alias(n) for n, how in folds.items()])
    return out.select("__key", "__at", *[col(c) for c in carried], *[states[i].result.alias(s.out) for i, s in enumerate(specs)])
