"""Stems and ranked full text over the tables, each with SQL that states the rules in another way: step by step over a table of words, places as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import stem as st
from annalist.functions.text import STOPWORDS, tokenize
from annalist.operators.fulltext import ALL_REPEATS, BODY_WEIGHT, TITLE_WEIGHT
from annalist.plans import index_queries as held
from annalist.plans.queries import _benchmark, _tokens_sql, search_index
from annalist.plans.tables import ctes

#: A syllable that counts as short, at the end of a word.
_SHORT = "regexp_matches({0}, '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$')"


def _cases(rules: dict[str, str]) -> str:
    return "base || CASE cut " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + " END"


def _stems_sql(words: str) -> str:
    """CTEs up to `stems(token, stem)` of the table `words(token)`."""
    region = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
    steps = [
        (["sses", "ied", "ies", "us", "ss", "s"], "CASE WHEN cut = 'sses' THEN base || 'ss' WHEN cut IN ('ied', 'ies') THEN base || CASE WHEN length(base) > 1 THEN 'i' ELSE 'ie' END WHEN cut = 's' AND regexp_matches(base, '[aeiouy].') THEN base ELSE w END"),
        (["eed", "eedly", "ed", "edly", "ing", "ingly"], f"""CASE WHEN w IN ({", ".join(f"'{x}'" for x in st.INVARIANT_SINGULARS)}) THEN w WHEN cut IN ('eed', 'eedly') THEN CASE WHEN length(base) >= r1 THEN base || 'ee' ELSE w END
            WHEN cut = '' OR NOT regexp_matches(base, '[aeiouy]') THEN w WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e' WHEN regexp_matches(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(base, -1)
            WHEN r1 >= length(base) AND {_SHORT.format('base')} THEN base || 'e' ELSE base END"""),
        (["y", "Y"], "CASE WHEN cut <> '' AND regexp_matches(base, '.[^aeiouy]$') THEN base || 'i' ELSE w END"),
        (list(st.STEP_2), f"CASE WHEN cut = '' OR length(base) < r1 OR (cut = 'ogi' AND base NOT LIKE '%l') OR (cut = 'li' AND NOT regexp_matches(base, '[cdeghkmnrt]$')) THEN w ELSE {_cases(st.STEP_2)} END"),
        (list(st.STEP_3), f"CASE WHEN cut = '' OR length(base) < r1 OR (cut = 'ative' AND length(base) < r2) THEN w ELSE {_cases(st.STEP_3)} END"),
        (st.STEP_4, "CASE WHEN cut = '' OR length(base) < r2 OR (cut = 'ion' AND NOT regexp_matches(base, '[st]$')) THEN w ELSE base END"),
        (["e", "l"], f"CASE WHEN cut = 'e' AND (length(base) >= r2 OR (length(base) >= r1 AND NOT {_SHORT.format('base')})) THEN base WHEN cut = 'l' AND length(base) >= r2 AND base LIKE '%l' THEN base ELSE w END"),
    ]
    sql = [
        f"w0 AS (SELECT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {words} WHERE regexp_full_match(token, '[a-z]{{3,}}'))",
        f"w1 AS (SELECT token, w, length(regexp_extract(w, '^(gener|commun|arsen)|{region}')) AS n, CASE WHEN n = 0 THEN length(w) ELSE n END AS r1 FROM w0)",
        f"w2 AS (SELECT token, w, r1, length(regexp_extract(substring(w, r1 + 1), '{region}')) AS m, CASE WHEN m = 0 THEN length(w) ELSE r1 + m END AS r2 FROM w1)",
    ]
    for i, (suffixes, then) in enumerate(steps, 3):
        sql.append(f"c{i} AS (SELECT *, regexp_extract(w, '({'|'.join(suffixes)})$', 1) AS cut, left(w, length(w) - length(cut)) AS base FROM w{i - 1})")
        sql.append(f"w{i} AS (SELECT token, r1, r2, {then} AS w FROM c{i})")
    # what stays after the first step ends there; the words of the other lists have their stems given
    once = " ".join(f"WHEN w3.w = '{x}' THEN '{x}'" for x in st.INVARIANT_SINGULARS)
    given = " ".join(f"WHEN token = '{a}' THEN '{b}'" for a, b in [*st.IRREGULAR.items(), *((x, x) for x in st.INVARIANT)])
    sql.append(f"stems AS (SELECT token, CASE {given} {once} ELSE lower(coalesce(w{i}.w, token)) END AS stem FROM {words} LEFT JOIN w{i} USING (token) LEFT JOIN w3 USING (token))")
    return ",\n".join(sql)


def c33_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents, each with its stem and how often it stands there."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = documents.select(F.explode(tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return st.stemmed(words, "token")


def r6_ranked_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best entries of each benchmark text by ranked full text, from the stored index."""
    found = search_index(spark, sf_dir).ranked_search(_benchmark(spark, sf_dir), 20)
    return found.select("query_id", "entry_id", F.round("score", 6).alias("score"), "matched", F.col("near").cast("long").alias("near"), "rank")


def o8_ranked_in_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of documentation alone: the filter holds before ranking."""
    found = search_index(spark, sf_dir).ranked_search(_benchmark(spark, sf_dir), 20, F.col("source_type") == "doc")
    return found.select("query_id", "entry_id", F.round("score", 6).alias("score"), "matched", F.col("near").cast("long").alias("near"), "rank")


def _ranked_sql(where: str = "true") -> str:
    return f"""{ctes('entries')},
    e0 AS (SELECT id AS entry_id, {_tokens_sql("title || ' ' || body")} AS t, length({_tokens_sql('title')}) AS titled FROM entries WHERE {where}),
    e1 AS (SELECT entry_id, titled, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS place FROM e0),
    q0 AS (SELECT item_id AS query_id, {_tokens_sql('text')} AS t FROM benchmark),
    q1 AS (SELECT query_id, unnest(t) AS token, generate_subscripts(t, 1) AS nth FROM q0),
    tokens AS (SELECT token FROM e1 UNION SELECT token FROM q1),
    {_stems_sql('tokens')},
    e AS (SELECT entry_id, stem, place, place < titled AS t FROM e1 JOIN stems USING (token)),
    q AS (SELECT query_id, stem, lead(stem) OVER (PARTITION BY query_id ORDER BY nth) AS behind FROM q1 JOIN stems USING (token)),
    asked AS (SELECT DISTINCT query_id, stem FROM q),
    pairs AS (SELECT DISTINCT query_id, stem, behind FROM q WHERE behind IS NOT NULL),
    sizes AS (SELECT query_id, count(*) AS asked, (SELECT count(*) FROM pairs p WHERE p.query_id = a.query_id) AS pairs FROM asked a GROUP BY query_id),
    numbered AS (SELECT entry_id, stem, t, row_number() OVER (PARTITION BY entry_id, stem ORDER BY place) AS j FROM e WHERE stem IN (SELECT stem FROM asked)),
    weights AS (SELECT entry_id, stem, round(sum((CASE WHEN t THEN {TITLE_WEIGHT}::DOUBLE ELSE {BODY_WEIGHT}::DOUBLE END) / (j * j)) / {ALL_REPEATS}::DOUBLE, 12) AS weight FROM numbered GROUP BY ALL),
    matches AS (SELECT query_id, entry_id, count(*) AS matched, sum(weight) AS weight FROM weights JOIN asked USING (stem) GROUP BY ALL),
    beside AS (SELECT DISTINCT x.entry_id, x.stem, y.stem AS behind FROM e x JOIN e y ON x.entry_id = y.entry_id AND y.place = x.place + 1),
    neighbours AS (SELECT query_id, entry_id, count(*) AS near FROM pairs JOIN beside USING (stem, behind) GROUP BY ALL),
    scored AS (SELECT query_id, entry_id, matched, coalesce(near, 0) AS near,
        round(matched + (weight / asked + CASE WHEN pairs > 0 THEN coalesce(near, 0)::DOUBLE / pairs ELSE 0 END) / 2, 9) AS score
        FROM matches JOIN sizes USING (query_id) LEFT JOIN neighbours USING (query_id, entry_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) - 1 AS place FROM scored)
    SELECT query_id, entry_id, round(score, 6) AS score, matched, near, place::INT AS rank FROM placed WHERE place < 20"""


QUERIES = held.QUERIES | {f.__name__: f for f in (c33_stems, r6_ranked_fts, o8_ranked_in_docs)}
ORACLE_SQL = held.ORACLE_SQL | {
    "c33_stems": f"""WITH whole AS (SELECT unnest({_tokens_sql('text')}) AS token FROM documents),
    parts AS (SELECT list_filter(string_split(token, '.'), lambda p: p <> '') AS p FROM whole WHERE token LIKE '%.%'),
    counted AS (SELECT token, count(*) AS n FROM (SELECT token FROM whole UNION ALL SELECT unnest(p) FROM parts WHERE len(list_filter(p, lambda x: NOT regexp_matches(x, '^[a-z]'))) = 0)
        WHERE length(token) BETWEEN 2 AND 40 AND NOT list_contains(string_split('{" ".join(STOPWORDS)}', ' '), token) GROUP BY token),
    {_stems_sql('counted')} SELECT token, n, stem FROM counted JOIN stems USING (token)""",
    "r6_ranked_fts": _ranked_sql(),
    "o8_ranked_in_docs": _ranked_sql("source_type = 'doc'"),
}
