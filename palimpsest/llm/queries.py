"""The queries of the training-data operators: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.collocations import collocations
from palimpsest.llm.common import table
from palimpsest.llm.decontamination import contamination
from palimpsest.llm.divergence import source_divergence
from palimpsest.llm.fingerprints import fingerprints
from palimpsest.llm.language_id import identify
from palimpsest.llm.lm_scoring import lm_scores
from palimpsest.llm.mixing import mixture
from palimpsest.llm.near_dedup import near_duplicates
from palimpsest.llm.substring_dedup import repeated_passages
from palimpsest.llm.token_counts import count_tokens
from palimpsest.llm.token_files import token_files
from palimpsest.llm.toxicity import toxicity
from palimpsest.llm.vector_join import near_vectors


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


#: Shares of the tokens by language, in any domain.
MIX = {(None, "en"): 0.4, (None, "fr"): 0.2, (None, "de"): 0.2, (None, "es"): 0.2}


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixture(table(spark, sf_dir, "documents"), MIX)
    return found.select("doc_id", "domain", "lang", "source", "tokens", "copies", "leaf_budget")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
said AS (SELECT row_number() OVER () AS doc, lang, source, regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM d),
t AS MATERIALIZED (SELECT doc, lang, source, unnest(w) AS term FROM said),
kept AS MATERIALIZED (SELECT lang, term, count(*)::BIGINT AS nl FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*)::BIGINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
size AS (SELECT g.lang, g.source, coalesce((SELECT count(*) FROM kept k WHERE k.lang = g.lang), 0)::BIGINT AS v, coalesce((SELECT sum(nl) FROM kept k WHERE k.lang = g.lang), 0)::BIGINT AS tl, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS tg FROM g),
p AS MATERIALIZED (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.tg + s.v) AS p, 1 + (1000000000::HUGEINT * (k.nl + 1)) // (s.tl + s.v) AS q FROM size s JOIN kept k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM every
  UNION ALL
  SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term QUALIFY rank <= 200
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
piece AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
run AS MATERIALIZED (SELECT lang, w, len(w) AS m FROM said WHERE len(w) > 0),
total AS (SELECT lang, sum(m)::BIGINT AS n FROM run GROUP BY lang),
size AS (SELECT unnest(range(1, 6)) AS k),
said_at AS (SELECT lang, k, w, unnest(range(1, m - k + 2)) AS i FROM run JOIN size ON k <= m),
f AS MATERIALIZED (SELECT lang, p, len(p) AS k, count(*) AS n FROM (SELECT lang, w[i:i + k - 1] AS p FROM said_at) GROUP BY lang, p HAVING count(*) >= 100),
cand AS MATERIALIZED (SELECT lang, p, k, n AS a FROM f WHERE k >= 2),
longer AS (SELECT lang, a, k, p, unnest(range(2, k)) AS j FROM cand WHERE k > 2),
inside AS (SELECT lang, a, p[i:i + j - 1] AS q FROM (SELECT lang, a, p, j, unnest(range(1, k - j + 2)) AS i FROM longer)),
dropped AS (SELECT DISTINCT c.lang, c.p FROM cand c JOIN inside x ON x.lang = c.lang AND x.q = c.p AND 100 * x.a >= 100 * c.a),
cut AS (SELECT lang, p, a, k, unnest(range(1, k)) AS c FROM cand),
scored AS (
  SELECT cut.lang, cut.p, a, c, l.n AS l, r.n AS r, total.n AS n, (1000::HUGEINT * a * total.n) // (l.n::HUGEINT * r.n) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.p = cut.p[1:c] JOIN f r ON r.lang = cut.lang AND r.p = cut.p[c + 1:] JOIN total ON total.lang = cut.lang
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
ranked AS (
  SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.p, ' ')) AS rank
  FROM best b ANTI JOIN dropped x ON x.lang = b.lang AND x.p = b.p
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_fingerprints": op4_fingerprints,
    "op5_token_counts": op5_token_counts,
    "op6_lm_scores": op6_lm_scores,
    "op7_mixture": op7_mixture,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_collocations": op12_collocations,
    "op13_near_vectors": op13_near_vectors,
}

ORACLE_SQL: dict[str, str] = {
    "op11_source_divergence": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_near_vectors": OP13_SQL,
}
