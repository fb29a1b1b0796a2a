"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.collocations import mine_phrases
from annalist.llm.embedding_dedup import near_duplicate_vectors
from annalist.llm.exact_dedup import DigestIndex
from annalist.llm.hmm import score_texts
from annalist.llm.html_text import extract_text
from annalist.llm.minhash import near_duplicates
from annalist.llm.mixing import mix_sources
from annalist.llm.packing import pack
from annalist.llm.quality import score_quality
from annalist.llm.secrets import find_secrets
from annalist.llm.shared import table
from annalist.llm.tiers import pack_tiers
from annalist.llm.vector_codes import encode_vectors
from annalist.llm.warc import archive_pages


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DigestIndex(spark).ingest(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured_at", "segment", "place"
    )


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=85)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"), max_repetition=2.0)
    return mix.select(
        "doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 6).alias("weight"),
        F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_place").alias("place"),
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op12_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tiers(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds over all components, one pair of steps for each round."""
    steps = [
        f"""
        kept AS (SELECT vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (
            SELECT vec_id, (spot - 1) // (n // {parts}) AS p, (spot - 1) % (n // {parts}) AS i, floor(4096 * x::DOUBLE)::BIGINT AS x
            FROM (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS spot FROM kept)),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
        book0 AS MATERIALIZED (SELECT p, e, i, x AS z FROM parts JOIN first USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
        near{r} AS MATERIALIZED (
            SELECT vec_id, p, min((d::HUGEINT, e)) AS best
            FROM (SELECT vec_id, p, e, sum((x - z) * (x - z)) AS d FROM parts JOIN book{r} USING (p, i) GROUP BY vec_id, p, e)
            GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
        mean{r} AS (
            SELECT p, e, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS z
            FROM (
                SELECT p, e, i, sum(x)::HUGEINT AS s, count(*) AS n
                FROM (SELECT vec_id, p, best[2] AS e FROM near{r}) JOIN parts USING (vec_id, p) GROUP BY p, e, i)),
        book{r + 1} AS MATERIALIZED (SELECT p, e, i, coalesce(mean{r}.z, book{r}.z) AS z FROM book{r} LEFT JOIN mean{r} USING (p, e, i))""")
    return "WITH" + ",".join(steps) + f""",
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(z::VARCHAR, ',' ORDER BY p, e, i)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_exact_dedup,
        op3_best_fit_packing,
        op4_warc,
        op5_minhash_near_dedup,
        op6_html_extraction,
        op7_embedding_near_dedup,
        op8_source_mixing,
        op9_quality_classifier,
        op10_secret_scans,
        op11_collocations,
        op12_tiered_packing,
        op13_vector_codes,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM (
            SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
            FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        )
    """,
    "op8_source_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS s,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n,
                ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17:doc'), 1, 15))::BIGINT AS k
            FROM documents
        ), totals AS (SELECT s, count(*) AS r, sum(n)::BIGINT AS t FROM docs GROUP BY s
        ), exponent AS (
            SELECT sum(t)::DOUBLE AS w, CASE
                WHEN count(*) < 2 OR max(t) = min(t) THEN 1.0::DOUBLE
                WHEN max(t) / min(t) > 2.0 THEN least(1.0, ceil(round((1 - ln(2.0) / ln(max(t) / min(t))) * 1e6, 3)) / 1e6)::DOUBLE
                ELSE 0.0::DOUBLE END AS x
            FROM totals
        ), powers AS (SELECT s, r, t, w, pow(t / w, x) AS p, (t / w) / pow(t / w, x) AS q FROM totals, exponent
        ), plan AS (
            SELECT s, p / sum(p) OVER () AS weight, greatest(ceil(r / 1024), 1)::BIGINT AS blocks, t,
                round(p / sum(p) OVER () * (w * sum(p) OVER () * max(q) OVER ()))::BIGINT AS quota
            FROM powers
        ), placed AS (
            SELECT doc_id, source, docs.s, n, weight, blocks, quota // t AS epochs, quota % t AS rest, k % blocks AS block
            FROM docs JOIN plan ON docs.s = plan.s
        ), sums AS (
            SELECT s, block, epochs, rest, sum(n) AS n,
                ('0x' || substr(md5(s || ':' || block || ':' || (epochs + 1) || ':17'), 1, 15))::BIGINT AS place
            FROM placed GROUP BY s, block, epochs, rest
        ), along AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY place, block ROWS UNBOUNDED PRECEDING) AS until FROM sums
        ), cuts AS (SELECT s, block AS cut_block, place AS cut_place, rest - until + n AS room FROM along WHERE until > rest AND until - n <= rest
        ), inside AS (
            SELECT placed.s, n, room, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || (epochs + 1) || ':17'), 1, 15))::BIGINT AS place
            FROM placed JOIN cuts ON placed.s = cuts.s AND block = cut_block
        ), fits AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY place RANGE UNBOUNDED PRECEDING) AS until FROM inside
        ), lasts AS (SELECT s, max(place) AS last_place FROM fits WHERE until <= room GROUP BY s
        ), decided AS (
            SELECT placed.*, epochs + CASE WHEN
                coalesce((own_block, block) < (cut_place, cut_block), false) OR coalesce(block = cut_block AND own_place <= last_place, false)
                THEN 1 ELSE 0 END AS copies
            FROM (
                SELECT *, ('0x' || substr(md5(s || ':' || block || ':' || (epochs + 1) || ':17'), 1, 15))::BIGINT AS own_block,
                    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || (epochs + 1) || ':17'), 1, 15))::BIGINT AS own_place
                FROM placed
            ) AS placed LEFT JOIN cuts ON placed.s = cuts.s LEFT JOIN lasts ON placed.s = lasts.s
        ), copies AS (SELECT *, unnest(range(1, copies + 1)) AS epoch FROM decided)
        SELECT doc_id, source, n::BIGINT AS n_tokens, round(weight, 6) AS weight, epoch, block,
            lpad((('0x' || substr(md5(s || ':' || block || ':' || epoch || ':17'), 1, 15))::BIGINT)::VARCHAR, 19, '0') || '-' ||
            lpad((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || epoch || ':17'), 1, 15))::BIGINT)::VARCHAR, 19, '0') AS place
        FROM copies
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), grams AS (
            SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])))) AS g FROM listed
        ), counts AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g
        ), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang
        ), candidates AS MATERIALIZED (SELECT lang, g, f AS a FROM counts WHERE len(g) > 1 AND f >= 30
        ), cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM candidates
        ), scored AS (
            SELECT c.lang, c.g, c.a, min((((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT, c.k, x.f, y.f)) AS cut
            FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]
            GROUP BY c.lang, c.g, c.a
        ), inner_parts AS (
            SELECT lang, a, unnest(flatten(list_transform(range(2, len(g)), lambda n: list_transform(range(1, len(g) - n + 2), lambda i: g[i:i + n - 1])))) AS g FROM candidates
        ), over AS (SELECT lang, g, max(a) AS over FROM inner_parts GROUP BY lang, g
        ), ranked AS (
            SELECT s.lang, array_to_string(s.g, ' ') AS phrase, s.a, s.cut[3] AS l, s.cut[4] AS r, s.cut[1] AS score,
                row_number() OVER (PARTITION BY s.lang ORDER BY s.cut[1] DESC, s.a DESC, array_to_string(s.g, ' ')) AS rank
            FROM scored s LEFT JOIN over o ON o.lang = s.lang AND o.g = s.g
            WHERE o.over IS NULL OR 100 * o.over::HUGEINT < 80 * s.a::HUGEINT
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op13_vector_codes": _lloyd_sql(),
}
