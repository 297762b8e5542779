"""The operators applied to their whole tables, and the SQL that some must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    decontaminate, divergence, html, jaccard, mixing, neardup, quality, sharding, tokens, topk, toxicity, urls, whitening,
)
from ledgerline.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


@query(
    "op1_extendible_shards",
    f"""
    WITH rows AS (
      SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h,
        CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents
    ), sums AS (
      SELECT d.depth, h >> (60 - d.depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes
      FROM rows, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 61)) d GROUP BY 1, 2
    ), ends AS (
      SELECT r.doc_id, r.n_bytes, s.depth, s.prefix, s.shard_bytes,
        row_number() OVER (PARTITION BY r.doc_id ORDER BY s.depth) AS k
      FROM rows r JOIN sums s ON s.prefix = r.h >> (60 - s.depth)
      WHERE s.shard_bytes <= {sharding.SHARD_BYTES} OR s.depth = 60
    )
    SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, n_bytes,
      shard_bytes
    FROM ends WHERE k = 1
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(sharding.shards(read(spark, sf_dir, "documents")))


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "n_scored", "perplexity", "threshold", "accepted")


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return tokens.token_counts(read(spark, sf_dir, "documents"), model)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query(
    "op5_nearest_vectors",
    """
    WITH rows AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scores AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
    ) WHERE rank <= 20
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return topk.top_k(table.where("vec_id % 20 = 0"), table)


@query(
    "op6_source_mix",
    """
    WITH docs AS (
      SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
        md5(CAST(doc_id AS VARCHAR)) AS h FROM documents
    ), sizes AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
      FROM docs GROUP BY source
    ), shares AS (
      SELECT *, source_size * 200 AS most,
        CAST(sum(source_size) OVER () * 150 - coalesce(sum(source_size * 200) OVER (
          ORDER BY CAST(source_size * 200 AS DOUBLE) / w, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
        CAST(sum(w) OVER (ORDER BY CAST(source_size * 200 AS DOUBLE) / w, source NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left
      FROM sizes
    ), level AS (
      SELECT rest AS l_rest, w_left AS l_w FROM shares WHERE most * w_left > rest * w ORDER BY w_left DESC LIMIT 1
    ), targets AS (
      SELECT source, source_size, CASE WHEN most * w_left <= rest * w THEN most / 100.0::DOUBLE
        ELSE CAST(l_rest * w AS DOUBLE) / CAST(100 * l_w AS DOUBLE) END AS target
      FROM shares LEFT JOIN level ON true
    ), placed AS (
      SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(d.h, 1, 15), d.doc_id) AS BIGINT) - d.size AS start
      FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
      CAST(CASE WHEN size = 0 THEN 0 ELSE size * (quota // source_size)
        + greatest(0, least(start + size, quota % source_size) - start) END AS BIGINT) AS taken
    FROM placed
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(read(spark, sf_dir, "documents")))


_SPLIT = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(
    "op7_benchmark_passages",
    f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_SPLIT}, []) AS w FROM documents),
    b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark WHERE text IS NOT NULL),
    patterns AS (
      SELECT DISTINCT item_id, least(10, len(w)) AS size, list_slice(w, i, i + least(10, len(w)) - 1) AS words
      FROM b, unnest(range(1, greatest(1, len(w) - least(10, len(w)) + 1) + 1)) AS t(i) WHERE len(w) > 0
    ),
    windows AS (
      SELECT d.row, s.size, t.i, list_slice(d.w, t.i, t.i + s.size - 1) AS words
      FROM d, (SELECT DISTINCT size FROM patterns) s, unnest(range(1, len(d.w) - s.size + 2)) AS t(i)
    ),
    found AS (SELECT w.row, w.i, w.size, p.item_id FROM windows w JOIN patterns p ON w.size = p.size AND w.words = p.words),
    hits AS (
      SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS place FROM found) GROUP BY row
    ),
    items AS (
      SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY row
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hits USING (row) LEFT JOIN items USING (row)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontaminate.hits(found)


@query(
    "op10_near_duplicates",
    """
    WITH RECURSIVE docs AS (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), sets AS (
      SELECT DISTINCT doc_id, list_slice(w, i, i + least(3, len(w)) - 1) AS shingle
      FROM docs, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS t(i) WHERE len(w) > 0
    ), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
      GROUP BY 1, 2
    ), links AS (
      SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * common >= 85 * (x.n + y.n - common)
    ), reach AS (
      SELECT doc_id, doc_id AS other FROM docs
      UNION
      SELECT r.doc_id, l.other FROM reach r JOIN (SELECT a AS one, b AS other FROM links UNION ALL SELECT b, a FROM links) l
        ON r.other = l.one
    )
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM docs d JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
      LEFT JOIN sizes USING (doc_id)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"),
    )


@query("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read(spark, sf_dir, "pages"))


@query("op9_url_verdicts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"))


@query(
    "op11_source_divergence",
    """
    WITH docs AS (
      SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
    ), terms AS (SELECT row, lang, source, unnest(w) AS term FROM docs),
    kept AS (
      SELECT lang, term, count(*)::BIGINT AS n_lang FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 3
    ), counts AS (
      SELECT lang, source, term, count(*)::BIGINT AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL
    ), sizes AS (SELECT lang, count(*) AS v, sum(n_lang)::BIGINT AS n_total FROM kept GROUP BY lang),
    totals AS (SELECT lang, source, sum(n)::BIGINT AS n_all FROM counts GROUP BY lang, source),
    sources AS (
      SELECT DISTINCT lang, source, coalesce(n_all, 0)::HUGEINT AS n_all
      FROM docs LEFT JOIN totals USING (lang, source)
    ), p AS (
      SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n_all + z.v) AS p,
        1 + (1000000000::HUGEINT * (k.n_lang + 1)) // (z.n_total + z.v) AS q
      FROM sources s JOIN kept k USING (lang) JOIN sizes z USING (lang) LEFT JOIN counts c USING (lang, source, term)
    ), sums AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), parts AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
    )
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
    ) WHERE part = 'pair' OR rank <= 200
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


@query(
    "op12_ngram_jaccard",
    """
    WITH RECURSIVE docs AS (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), sets AS (
      SELECT DISTINCT doc_id, list_slice(w, i, i + least(4, len(w)) - 1) AS gram
      FROM docs, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS t(i) WHERE len(w) > 0
    ), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id < b.doc_id
      GROUP BY 1, 2
    ), links AS (
      SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * common >= 85 * (x.n + y.n - common)
    ), reach AS (
      SELECT doc_id, doc_id AS other FROM docs
      UNION
      SELECT r.doc_id, l.other FROM reach r JOIN (SELECT a AS one, b AS other FROM links UNION ALL SELECT b, a FROM links) l
        ON r.other = l.one
    )
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM docs d JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
      LEFT JOIN sizes USING (doc_id)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_join(read(spark, sf_dir, "documents"), words=4, percent=85)
    return found.withColumnRenamed("component", "component_id")


@query("op13_whitened_vectors")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))
