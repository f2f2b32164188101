"""Scalar, date, string, array and math functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.catalog.base import ORACLE, Tables, query
from relweave.functions import scalar as S
from relweave.operators import aggregates as agg, features as X


def _date_part(name: str, fn, sql: str):
    @query(name, f"SELECT event_id, {sql} AS part FROM events")
    def run(t: Tables):
        return t.events.select("event_id", fn("ts").alias("part"))


_date_part("dt_year", S.year, "year(ts)::INTEGER")
_date_part("dt_month", S.month, "month(ts)::INTEGER")
_date_part("dt_day", S.day, "day(ts)::INTEGER")
_date_part("dt_dayofweek", S.dayofweek, "(isodow(ts) - 1)::INTEGER")
_date_part("dt_timestamp", S.epoch_nanos, "epoch_us(ts) * 1000")


@query("ts_dt", "SELECT event_id, ts AS back FROM events")
def ts_dt(t: Tables):
    nanos = t.events.select("event_id", S.epoch_nanos("ts").alias("ns"))
    return nanos.select("event_id", S.from_epoch_nanos("ns").alias("back"))


@query(
    "canon_numeric",
    """SELECT event_id, value::FLOAT AS value, try_cast(json_extract_string(props, '$.k') AS FLOAT) AS k,
              try_cast(event_type AS FLOAT) AS bad FROM events""",
)
def canon_numeric(t: Tables):
    raw = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    return raw.select("event_id", *[S.canon_numeric(c).alias(a) for c, a in
                                    (("value", "value"), ("k", "k"), ("event_type", "bad"))])


@query(
    "canon_datetime",
    """SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS day, NULL::TIMESTAMP AS bad FROM orders""",
)
def canon_datetime(t: Tables):
    text = t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return text.select("o_orderkey", S.canon_datetime("day").alias("day"), S.canon_datetime("o_orderstatus").alias("bad"))


@query(
    "cast_feature",
    """SELECT doc_id, n_chars::FLOAT AS n_chars, CASE WHEN lang = 'en' THEN '' ELSE lang END AS lang_text,
              CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang_cat, strlen(text) AS bytes FROM documents""",
)
def cast_feature(t: Tables):
    d = t.documents.withColumn("l", F.when(F.col("lang") != "en", F.col("lang")))
    return d.select("doc_id", S.cast_feature("n_chars", "float").alias("n_chars"),
                    S.cast_feature("l", "text").alias("lang_text"), S.cast_feature("l", "category").alias("lang_cat"),
                    S.cast_feature(F.octet_length("text"), "timestamp").alias("bytes"))


@query(
    "text_join",
    """SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY ALL""",
)
def text_join(t: Tables):
    joined = agg.join_text(t.conversations, ["conv_id", "role"], "text", ["turn"]).withColumnsRenamed({"conv_id": "c", "role": "r"})
    n = t.conversations.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    # a group without any text has its row too
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("role").eqNullSafe(F.col("r"))
    return n.join(joined, same, "left").select("conv_id", "role", "text", "n")


@query(
    "text_join_parts",
    """WITH r AS (SELECT conv_id, role, turn, text, (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) - 1) // 2 AS part
                  FROM conversations WHERE text IS NOT NULL)
       SELECT conv_id, role, part::BIGINT AS part, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM r GROUP BY ALL""",
)
def text_join_parts(t: Tables):
    """Numbered chunks of two rows: no cell grows with its group."""
    return agg.join_text(t.conversations, ["conv_id", "role"], "text", ["turn", "text"], chunk=2, parts=True)


@query("text_join_whole", ORACLE["text_join"])
def text_join_whole(t: Tables):
    return text_join(t)


def _role_tokens(t: Tables):
    return t.conversations.select("conv_id", "turn", F.split(F.concat_ws(" ", "role", F.col("turn").cast("string")), " ").alias("tokens"))


@query(
    "array_flatten",
    """SELECT conv_id, flatten(list(string_split(role || ' ' || turn::VARCHAR, ' ') ORDER BY turn)) AS tokens
       FROM conversations GROUP BY 1""",
)
def array_flatten(t: Tables):
    return agg.concat_tokens(_role_tokens(t), ["conv_id"], "tokens", ["turn"])


@query(
    "array_flatten_parts",
    """WITH r AS (SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1) // 4 AS part FROM conversations)
       SELECT conv_id, part::BIGINT AS part, flatten(list(string_split(role || ' ' || turn::VARCHAR, ' ') ORDER BY turn, role)) AS tokens
       FROM r GROUP BY ALL""",
)
def array_flatten_parts(t: Tables):
    """Numbered chunks of four lists: no cell grows with its group."""
    return agg.concat_tokens(_role_tokens(t), ["conv_id"], "tokens", ["turn", "tokens"], chunk=4, parts=True)


@query("array_flatten_whole", ORACLE["array_flatten"])
def array_flatten_whole(t: Tables):
    return array_flatten(t)


_MAYBE = "CASE WHEN embedding[2] > 0.1 THEN NULL ELSE embedding END"


@query(
    "nan_stack",
    f"""SELECT vec_id, CASE WHEN {_MAYBE} IS NULL THEN list_transform(range(64), lambda x: 0.0::DOUBLE)
               ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS v FROM embeddings""",
)
def nan_stack(t: Tables):
    e = t.embeddings.select("vec_id", F.when(F.col("embedding")[1] > 0.1, None).otherwise(F.col("embedding")).alias("e"))
    return e.select("vec_id", S.nan_stack(F.col("e").cast("array<double>"), 64).alias("v"))


_DIMS = ", ".join(f"embedding[{i + 1}] AS embedding_{i}" for i in range(64))


@query("array_explode_cols", f"SELECT vec_id, {_DIMS} FROM embeddings")
def array_explode_cols(t: Tables):
    return t.embeddings.select("vec_id", *S.explode_vector("embedding", 64))


@query(
    "flatten_feature_frame",
    f"""SELECT vec_id, label AS "label_class", {', '.join(f'embedding[{i + 1}] AS e_{i}' for i in range(64))} FROM embeddings""",
)
def flatten_feature_frame(t: Tables):
    e = t.embeddings.select("vec_id", F.col("label").alias("label(class)"), F.col("embedding").alias("e"),
                            F.lit("note").alias("note"))
    return X.flatten_features(e, keys=["vec_id"], categories=["label(class)"], vectors={"e": 64})


@query(
    "row_fingerprint",
    """WITH r AS (SELECT event_id, event_type, floor(value)::BIGINT AS v FROM events),
       d AS (SELECT *, row_number() OVER (PARTITION BY event_type, v ORDER BY event_id) - 1 AS k FROM r),
       f AS (SELECT *, sha256(coalesce(event_type, '') || '|' || coalesce(v::VARCHAR, '') || '|' || (7 + k)) AS own,
                    sha256(coalesce(event_type, '') || '|' || coalesce(v::VARCHAR, '') || '|7') AS plain FROM d)
       SELECT event_id, ('0x' || substr(own, 52, 13))::BIGINT / 4503599627370496.0 AS fingerprint,
              ('0x' || substr(plain, 52, 13))::BIGINT / 4503599627370496.0 AS plain FROM f""",
)
def row_fingerprint(t: Tables):
    rows = t.events.select("event_id", "event_type", F.floor("value").alias("v"))
    fp = X.row_fingerprint(rows, ["event_type", "v"], "event_id", salt=7)
    return X.row_fingerprint(fp, ["event_type", "v"], "event_id", salt=7, training=False, out="plain").select("event_id", "fingerprint", "plain")


@query(
    "poly_interactions",
    """WITH s AS (SELECT stddev_pop(l_quantity) AS a, stddev_pop(l_discount) AS b, stddev_pop(l_tax) AS c FROM lineitem)
       SELECT l_orderkey, l_linenumber, round(l_quantity / a, 8) AS l_quantity, round(l_discount / b, 8) AS l_discount,
              round(l_tax / c, 8) AS l_tax, round(l_quantity / a * l_discount / b, 8) AS "l_quantity*l_discount",
              round(l_tax / c * l_tax / c, 8) AS "l_tax*l_tax" FROM lineitem, s""",
)
def poly_interactions(t: Tables):
    cols = ["l_quantity", "l_discount", "l_tax"]
    out = X.poly_interactions(t.lineitem.select("l_orderkey", "l_linenumber", *cols), cols,
                              [("l_quantity", "l_discount"), ("l_tax", "l_tax")])
    made = [*cols, "l_quantity*l_discount", "l_tax*l_tax"]
    return out.select("l_orderkey", "l_linenumber", *[F.round(S.col(c), 8).alias(c) for c in made])


@query("stable_seed", "SELECT p_partkey, ('0x' || substr(sha256(p_name || ':' || p_brand), 1, 8))::BIGINT AS seed FROM part")
def stable_seed(t: Tables):
    return t.part.select("p_partkey", S.stable_seed(F.concat_ws(":", "p_name", "p_brand")).alias("seed"))
