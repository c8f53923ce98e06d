"""The registered queries of this folder, with production parameters over
whole tables, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from flowsentry.llm import (chat_format, chosen_path, collocations, decontaminate, embedding_dedup, lang_id,
                            lexical_search, line_dedup, pii, quality_rules, sentence_pieces, token_counts, url_filter)

PII_KEY = "set-a-secret-of-your-own"
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages removed as repeats: document, offsets, and who keeps them."""
    return line_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("row")


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item, one row per pair."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_embeddings(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(lang_id.may_learn()))
    return (lang_id.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chosen_path.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an entity: rewritten text, places and surrogates."""
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, keep_entities=True)
    return out.where(F.size("entities") > 0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents")).drop("words")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), group_col="lang")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_template_decontamination, op3_embedding_dedup, op4_token_counts, op5_language_id,
           op6_sentencepiece, op7_chat_format, op8_minhash_dedup, op9_pii_surrogates, op10_url_filter, op11_collocations, op12_lexical_search,
           op13_quality_rules)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_COMPONENTS = """
reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"""

OP3 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, len(embedding) AS d, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.d = q.d AND p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.e, q.e) >= 0.98
), {_COMPONENTS}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

OP7 = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS s,
         md5(coalesce('r' || md5(role), 'null') || coalesce('t' || md5(text), 'null')) AS h
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, pos, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix FROM t
), whole AS (
  SELECT conv_id, max(pos) AS n, max_by(prefix, pos) AS prefix FROM p GROUP BY conv_id
), proper AS (
  SELECT DISTINCT p.prefix FROM p JOIN whole w ON p.conv_id = w.conv_id AND p.pos < w.n
), stay AS (
  SELECT min(conv_id) AS conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM proper) GROUP BY prefix
)
SELECT t.conv_id, count(*)::BIGINT AS n_turns, string_agg(s, '' ORDER BY pos) AS text
FROM t JOIN stay ON stay.conv_id = t.conv_id GROUP BY t.conv_id
"""

OP8 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS x FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(x[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, x, unnest(range(1, greatest(2, len(x) - 3))) AS i FROM w WHERE len(x) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
pairs AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), {_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP10 = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^?#]*') AS r FROM u),
parsed AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(r, length(regexp_extract(r, '^[^/]*')) + 1) AS path FROM cut
), rules(rh, rp, v) AS (VALUES {_RULES}),
best AS (
  SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS k
  FROM parsed JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.v, 'allow') AS verdict
FROM parsed p LEFT JOIN best b ON b.page_id = p.page_id AND b.k = 1
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS x FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(x[i:i + k - 1], ' ') AS g FROM (
    SELECT lang, x, k, unnest(range(1, len(x) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS t(k) WHERE len(x) >= k)
), f AS MATERIALIZED (SELECT lang, k, g, g || chr(10) || lang AS key, count(*)::HUGEINT AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, g AS phrase, n AS a, string_split(g, ' ') AS x FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, p.n AS l, q.n AS r, (1000000 * c.a * c.a) // (p.n * q.n) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN f p ON p.key = array_to_string(c.x[:j], ' ') || chr(10) || c.lang
  JOIN f q ON q.key = array_to_string(c.x[j + 1:], ' ') || chr(10) || c.lang
), lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts),
parts AS (
  SELECT lang, max(a) AS a, part FROM (
    SELECT lang, a, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) AS part FROM cand WHERE k = 3)
  GROUP BY lang, part
), stay AS (
  SELECT l.* FROM lowest l LEFT JOIN parts t ON t.lang = l.lang AND t.part = l.phrase
  WHERE l.o = 1 AND (t.part IS NULL OR 100 * t.a < 50 * l.a)
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM stay
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS x FROM documents),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
c AS (SELECT doc_id, t, len(x) AS n, count(*) AS tf FROM (SELECT doc_id, x, unnest(x) AS t FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(len(x))::BIGINT AS terms FROM d WHERE len(x) > 0),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM c, s GROUP BY t, docs),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN c USING (t) JOIN w USING (t), s GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    out = {"op3_embedding_dedup": OP3, "op7_chat_format": OP7, "op8_minhash_dedup": OP8, "op10_url_filter": OP10,
           "op11_collocations": OP11, "op12_lexical_search": OP12}
    if corpus_pipeline.ORACLE_SQL is not None:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
