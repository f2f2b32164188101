"""One query per operator over the given tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relweave.llm.audit import audit_filters
from relweave.llm.decontaminate import find_contamination
from relweave.llm.licenses import scan_licenses, scan_sql
from relweave.llm.lines import dedup_lines
from relweave.llm.mixing import mix_sources
from relweave.llm.nearcopies import near_copies
from relweave.llm.neighbours import nearest_products
from relweave.llm.packing import pack_documents
from relweave.llm.pages import extract_pages
from relweave.llm.scratch import Scratch
from relweave.llm.substrings import remove_repeats
from relweave.llm.toxicity import PREDICT_AT, fit, held_out, score_documents
from relweave.llm.warc import mark_revisits, read_archives, resolve_revisits, write_archives
from relweave.llm.whitening import whiten
from relweave.session import shared_dir, tune

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            base = sf_dir.rstrip("/")
            return fn(tune(spark), lambda table: spark.read.parquet(f"{base}/{table}.parquet"))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op3_near_copies")
def near_copy_classes(spark, table):
    """Class of near copies of every document."""
    return near_copies(table("documents"))


@query("op4_nearest_products")
def nearest(spark, table):
    """The 20 largest inner products of every twentieth vector."""
    return nearest_products(table("embeddings"), F.col("vec_id") % 20 == 0, 20)


_REPEATS_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
e AS (SELECT doc_id, unnest(b) AS x, unnest(range(len(b))) AS p FROM d),
a AS (SELECT doc_id, x, p, count(*) OVER f = 50 AS whole, md5(string_agg(x, '') OVER f) AS w FROM e
      WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT w, min(doc_id) AS least FROM a WHERE whole GROUP BY w),
h AS (SELECT a.doc_id, x, p, whole AND least < a.doc_id AS hit FROM a LEFT JOIN m USING (w)),
g AS (SELECT doc_id, x, p, coalesce(p - max(CASE WHEN hit THEN p END) OVER (PARTITION BY doc_id ORDER BY p) < 50, false) AS gone FROM h),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM g),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans,
             string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, len(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query("op5_repeated_strings", _REPEATS_SQL)
def repeated_strings(spark, table):
    """Bytes left of every document without 50-byte strings of smaller documents."""
    out = remove_repeats(table("documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_html_text")
def html_text(spark, table):
    """Main text of every page."""
    return extract_pages(table("pages"))


_LINES_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.i, k.line, g.key IS NOT NULL AND k.doc_id < g.keep AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op1_toxicity")
def toxicity(spark, table):
    """Toxicity score of every document, learnt from the rows that are not held out."""
    docs = table("documents")
    out = score_documents(docs, fit(docs, table("labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "n_words", "n_passages")


@query("op2_license_scan", scan_sql())
def license_scan(spark, table):
    """Every line, paragraph or text that is a known licence notice."""
    return scan_licenses(table("documents"))


@query("op7_line_dedup", _LINES_SQL)
def line_dedup(spark, table):
    """Lines that repeat across documents, dropped from all but the largest id."""
    out = dedup_lines(table("documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


@query("op8_warc_revisits", _WARC_SQL)
def warc_revisits(spark, table):
    """Pages written as deduplicated archives, read back, with every revisit resolved."""
    path = shared_dir(spark)
    write_archives(mark_revisits(table("pages")), path)
    out = resolve_revisits(read_archives(spark, path))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  coalesce(md5(text), '') AS body FROM documents),
k AS (SELECT *, md5('20240607:' || coalesce(doc_id::VARCHAR, '') || ':' || body)[1:13] AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS i FROM k GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((i - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / weight AS turn FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
        - coalesce(sum(cap) OVER (ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY turn, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= turn ORDER BY turn, i LIMIT 1) * weight, cap)) AS target FROM l),
r AS (SELECT doc_id, size, k.source, source_size, target, floor(target) AS whole,
        coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(whole / source_size) ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target, source,
       (epochs * size + greatest(0, least(size, whole - epochs * source_size - start)))::BIGINT AS taken FROM e
"""


@query("op9_source_mixing", _MIX_SQL)
def source_mixing(spark, table):
    """Words of each document that the mix of all sources takes."""
    return mix_sources(table("documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op10_decontamination")
def decontamination(spark, table):
    """Benchmark items that documents hold, exactly or nearly."""
    return find_contamination(table("documents"), table("benchmark"))


@query("op11_whitening")
def whitening(spark, table):
    """The first 32 whitened components of every vector."""
    out = whiten(table("embeddings"), 32)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op12_packing")
def packing(spark, table):
    """Every document's tokens in sequences of power-of-two length."""
    import public_tokenizers

    out = pack_documents(table("documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, 1)
    return out.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


_AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part, (len(words) < 50)::INT AS a, (100 * len(list_distinct(words)) < 65 * len(words))::INT AS b,
             (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT AS c,
             regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e FROM w),
m AS (SELECT part, [a, b, c, d, e] AS fails, sum(1)::BIGINT AS n, coalesce(sum(good), 0)::BIGINT AS good, coalesce(sum(toxic), 0)::BIGINT AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
p AS (SELECT [p1.i, p2.i, p3.i, p4.i, p5.i] AS o FROM x p1, x p2, x p3, x p4, x p5
      WHERE len(list_distinct([p1.i, p2.i, p3.i, p4.i, p5.i])) = 5),
s AS (SELECT part, n, good, toxic, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, step,
             fails[o[step]] AS fail, coalesce(list_sum(list_transform(o[1:step - 1], lambda i: fails[i])), 0) AS earlier, list_sum(fails) AS all_fails
      FROM m, p, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
g AS (SELECT part, filter_order, step, sum(n) FILTER (fail + earlier = 0) AS kept, sum(n) FILTER (fail = 1 AND earlier = 0) AS removed,
             sum(n) FILTER (fail = 1 AND earlier > 0) AS redundant, sum(n) FILTER (fail = 1 AND all_fails = 1) AS unique_fails,
             sum(good) FILTER (fail = 1 AND earlier = 0) AS good_lost, sum(toxic) FILTER (fail = 1 AND earlier = 0) AS toxic_lost
      FROM s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, filter_order[step]), 0)::BIGINT AS shapley
FROM g
"""


@query("op13_filter_audit", _AUDIT_SQL)
def filter_audit(spark, table):
    """What each of five filters removes at each step of each of their orders, per source."""
    return audit_filters(table("documents"), table("labels"))
