"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, divergence, exact_dedup, fim, language_id, lm_scoring, mixing, ngram_join, packing, pii, token_counts, topk, warc
from tablewright.llm.common import importable, small_batches
from tablewright.plans.inputs import table
from tablewright.plans.registry import Query, Runner

LLM_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Runner) -> Runner:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            small_batches(spark)
            return fn(spark, sf_dir)

        LLM_QUERIES[name] = Query(run, sql)
        return fn

    return register


UPPER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op2_warc_salvage")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back by the salvage reader."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query(
    "op7_exact_dedup",
    f"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {UPPER_SQL}) AS x FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_dedup.exact_duplicates(docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", exact_dedup.full_hash("text").alias("text_sha256"))


@query("op3_bpe_chunks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with chunk reuse and decoded again."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of encoded lengths with its running sums, one row per context limit that makes a difference."""
    return token_counts.length_histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents")))


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return lm_scoring.score_documents(table(spark, sf_dir, "documents")).select(*columns)


@query(
    "op4_topk_products",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
      (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_of_embeddings(table(spark, sf_dir, "embeddings"))


@query("op1_pii_semi_markov")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans"]
    return pii.personal_data(table(spark, sf_dir, "documents")).select(*columns)


@query("op5_soft_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_ngram_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


@query(
    "op11_fim_sparse_index",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
    h AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
      ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM d),
    c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    o AS (SELECT *, CASE form WHEN 'plain' THEN t
      WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
      ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END AS output FROM c),
    p AS (SELECT *, strpos(output, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS x, strpos(output, '<M>') AS y FROM o)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output
      WHEN 'psm' THEN substring(output, 4, x - 4) || substring(output, y + 3) || substring(output, x + 3, y - x - 3)
      ELSE substring(output, x + 3, y - x - 3) || substring(output, y + 3) || substring(output, 4, x - 4) END) AS restored_sha256 FROM p""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.round_trip_digests(table(spark, sf_dir, "documents"))


@query(
    "op12_divergence_quadtree",
    f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      translate(coalesce(text, ''), {UPPER_SQL}) AS t FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
    l AS (SELECT lang, sum(n)::HUGEINT AS total, count(*) AS v FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
    s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    m AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
      (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.total + 2 * l.v))::HUGEINT AS p,
      (1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v))::HUGEINT AS q
      FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
      ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM m WHERE n > 0 AND p > q),
    e AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
      UNION ALL SELECT lang, source, 'term' AS part, item, value::BIGINT AS value FROM terms),
    f AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e)
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM f WHERE part = 'pair' OR rank <= 10""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_slack_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences; the digest of each piece is taken from its ids."""
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
