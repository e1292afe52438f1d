"""Corpus noise: observations and their statistics, candidates, decisions, families, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import chunking as C
from palimpsest.operators import noise as N
from palimpsest.plans.registry import day_sql, folded_sql, form_sql, query, quoted, single_sql, words_sql
from palimpsest.plans.scalars import RUNS_SQL, flags_sql
from palimpsest.sources.exports import csv_sink, staged
from palimpsest.sources.views import ARCHIVE_SQL, derived, messages, table

KEY = ["chat_id", "message_id"]
SEEDS, APPROVED, SALT = C.FILLER, ("good morning team",), "salt"
SEEDS_SQL = ", ".join(map(quoted, SEEDS))
_COMPOUNDS = f"regexp_extract_all({folded_sql('text')}, {quoted(T.COMPOUND)})"
ROWS_SQL = f"""source AS (SELECT m.chat_id, m.message_id, CASE WHEN length(m.text) <= 16384 THEN m.text END AS text, length(m.text) > 16384 AS limited, m.has_photo, m.protected, m.bot_command, coalesce(contains(p.text, '?'), false) AS parent_question,
 m.author_id, {day_sql("m.timestamp")} AS day FROM messages m LEFT JOIN messages p ON p.chat_id = m.chat_id AND p.message_id = m.reply_to AND p.deleted = 0 WHERE m.kind = 'message' AND m.deleted = 0)"""
SEEN_SQL = f"""formed AS (SELECT *, {form_sql("text")} AS form, ({single_sql("text")}) IS NOT NULL AS is_word FROM source WHERE NOT limited AND len(list_distinct({_COMPOUNDS})) <= 4),
seen AS (SELECT *, list_concat(list_filter([CASE WHEN has_photo = 1 THEN 'attachment' END, CASE WHEN protected = 1 THEN 'structured_entity' END, CASE WHEN parent_question THEN 'question_reply' END], lambda x: x IS NOT NULL),
 CASE WHEN is_word AND form NOT IN ({SEEDS_SQL}) THEN list_concat({flags_sql("text", "form")}, CASE WHEN regexp_matches(form, '[-''’]') THEN ['compound_term'] ELSE [] END) ELSE [] END) AS protections FROM formed WHERE form IS NOT NULL)"""
STATS_SQL = f"""stats AS (SELECT form, bool_or(is_word) AS is_word, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (len(protections) = 0) AS BIGINT) AS n_eligible, CAST(count(DISTINCT day) AS BIGINT) AS n_days,
 CAST(count(DISTINCT day) FILTER (len(protections) = 0) AS BIGINT) AS n_eligible_days, CAST(count(DISTINCT coalesce(author_id, '')) AS BIGINT) AS n_authors, CAST(count(*) FILTER (bot_command = 1) AS BIGINT) AS n_bot FROM seen GROUP BY form)"""
NOISE_SQL = f"WITH {ARCHIVE_SQL}, {ROWS_SQL}, {SEEN_SQL}, {STATS_SQL}"


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.observations(N.source_rows(messages(spark, sf_dir)), SEEDS, SALT)


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each form. What follows reads it several times, so it is written once."""
    return staged(N.form_statistics(seen(spark, sf_dir)), "statistics")


@query(f"{NOISE_SQL} SELECT chat_id, message_id, md5(text) AS text_md5, limited, parent_question, day FROM source")
def noi01_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.source_rows(messages(spark, sf_dir)).select(*KEY, F.md5(F.col("text").cast("binary")).alias("text_md5"), "limited", "parent_question", "day")


@query(f"{NOISE_SQL} SELECT chat_id, message_id, form, is_word, len(protections) = 0 AS eligible, array_to_string(protections, ',') AS protections, sha256('salt' || chr(0) || coalesce(author_id, '')) AS author_key, bot_command = 1 AS bot FROM seen")
def noi02_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen(spark, sf_dir).select(*KEY, "form", "is_word", "eligible", F.array_join("protections", ",").alias("protections"), "author_key", "bot")


@query(f"{NOISE_SQL} SELECT * FROM stats")
def noi03_form_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.form_statistics(seen(spark, sf_dir))


@query(f"{NOISE_SQL}, p AS (SELECT form, unnest(protections) AS protection FROM seen) SELECT form, protection, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2")
def agg13_protections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.protections(seen(spark, sf_dir))


@query(f"""{NOISE_SQL}, p AS (SELECT unnest({_COMPOUNDS}) AS word FROM source WHERE NOT limited AND protected = 0 AND regexp_matches(trim(text, ' '), '\\s') AND ({single_sql("text")}) IS NULL AND len(list_distinct({_COMPOUNDS})) <= 4)
SELECT word, CAST(count(*) AS BIGINT) AS n FROM p WHERE length(word) <= 64 GROUP BY word""")
def agg13_phrase_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.phrase_words(N.source_rows(messages(spark, sf_dir)))


@query(f"""WITH w AS (SELECT doc_id, unnest({words_sql("text")}) AS word FROM documents) SELECT word, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM w GROUP BY word""")
def agg13_word_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.word_statistics(table(spark, sf_dir, "documents"))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the benchmark: each is a form and a seed."""
    return table(spark, sf_dir, "benchmark").select(F.explode(N.words(F.col("text"))).alias("form")).distinct()


FORMS_SQL = f"forms AS (SELECT DISTINCT unnest({words_sql('text')}) AS form FROM benchmark), seeds AS (SELECT form AS seed FROM forms)"
#: DuckDB's levenshtein counts bytes, so single edits of characters are spelled out.
_LEFT_OUT = "list_transform(range(1, length({0}) + 1), lambda i: concat({0}[1:i - 1], {0}[i + 1:length({0})]))"
_LETTERS = "list_transform(" + RUNS_SQL + ", lambda i: {0}[i])"
_COUNTS = "list_transform(range(1, len(" + RUNS_SQL + ") + 1), lambda k: coalesce(" + RUNS_SQL + "[k + 1], length({0}) + 1) - " + RUNS_SQL + "[k])"
LONGER_SQL = f"({_LETTERS.format('form')} = {_LETTERS.format('seed')} AND len(list_filter(list_zip({_COUNTS.format('form')}, {_COUNTS.format('seed')}), lambda x: x[1] < x[2])) = 0)"
EDIT_SQL = f"""CASE WHEN form = seed THEN 'exact'
  WHEN length(form) = length(seed) AND len(list_filter(range(1, length(form) + 1), lambda i: form[i] <> seed[i])) = 1 THEN 'substitution'
  WHEN length(form) = length(seed) + 1 AND list_contains({_LEFT_OUT.format("form")}, seed) THEN 'insertion'
  WHEN length(seed) = length(form) + 1 AND list_contains({_LEFT_OUT.format("seed")}, form) THEN 'deletion'
  WHEN length(form) = length(seed) AND list_contains(list_transform(range(1, length(seed)), lambda i: concat(seed[1:i - 1], seed[i + 1], seed[i], seed[i + 2:length(seed)])), form) THEN 'transposition'
  WHEN {LONGER_SQL} THEN 'lengthening' END"""
#: Pairs that could match at all, so that not every pair is spelled out.
NEAR_SQL = "abs(length(form) - length(seed)) <= 1 OR (form[1] = seed[1] AND length(form) > length(seed))"


@query(f"WITH {FORMS_SQL}, edits AS (SELECT form, seed, {EDIT_SQL} AS edit FROM forms, seeds WHERE {NEAR_SQL}) SELECT form, seed, edit, false AS incomplete FROM edits WHERE edit IS NOT NULL")
def noi04_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word against every word: the seeds one edit away, met by shared deletion signatures and run keys."""
    f = forms(spark, sf_dir)
    return N.candidates(f, f)


@query(f"WITH {FORMS_SQL} SELECT form, seed FROM forms, seeds WHERE form <> seed AND form[1] = seed[1] AND length(form) > length(seed) AND {LONGER_SQL}")
def noi04_lengthened(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forms(spark, sf_dir)
    return N.lengthened(f, f)


HYPOTHESES_SQL = f"""noise_seeds AS (SELECT unnest([{SEEDS_SQL}]) AS seed), words AS (SELECT form, n, n_eligible FROM stats WHERE is_word),
lexicon AS (SELECT DISTINCT unnest({words_sql("text")}) AS seed FROM benchmark),
near AS (SELECT form, seed, {EDIT_SQL} AS edit FROM words, noise_seeds WHERE {NEAR_SQL}),
more AS (SELECT form, CASE WHEN length(form) >= 2 AND repeat(form[1:1], length(form)) = form THEN form[1:1] WHEN length(form) >= 4 AND length(form) % 2 = 0 AND repeat(form[1:2], length(form) // 2) = form THEN form[1:2]
  WHEN length(form) >= 6 AND length(form) % 3 = 0 AND repeat(form[1:3], length(form) // 3) = form THEN form[1:3] WHEN length(form) >= 8 AND length(form) % 4 = 0 AND repeat(form[1:4], length(form) // 4) = form THEN form[1:4] END AS seed, 'repeated_block' AS edit FROM words
 UNION ALL SELECT form, CASE WHEN length(form) >= 4 AND regexp_full_match(form, '[ах]+') AND len(list_filter(range(2, length(form) + 1), lambda i: form[i] = form[i - 1])) = 0 THEN 'хаха' END, 'laughter_pattern' FROM words),
hypotheses AS (SELECT * FROM near WHERE edit IS NOT NULL UNION ALL SELECT * FROM more m WHERE m.seed IN ({SEEDS_SQL}) AND NOT EXISTS (SELECT 1 FROM near n WHERE n.form = m.form AND n.seed = m.seed AND n.edit IS NOT NULL))"""


@query(f"{NOISE_SQL}, {HYPOTHESES_SQL} SELECT form, seed, edit, false AS incomplete FROM hypotheses")
def noi04_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What noise the archive's words may stand for."""
    return N.hypotheses(statistics(spark, sf_dir).where("is_word"), SEEDS)


@query(f"""{NOISE_SQL}, {HYPOTHESES_SQL}, f AS (SELECT form AS seed, n AS uses FROM words),
a AS (SELECT h.form, arg_min(h.seed, (-ln(1 + coalesce(uses, 0)), h.seed)) AS best_seed, max(ln(1 + coalesce(uses, 0))) AS noise_score FROM hypotheses h LEFT JOIN f USING (seed) GROUP BY 1),
u AS (SELECT e.form, max(ln(1 + coalesce(uses, 0))) AS useful_score, bool_or(edit = 'exact') AS known FROM (SELECT form, seed, {EDIT_SQL} AS edit FROM words, lexicon WHERE {NEAR_SQL}) e LEFT JOIN f USING (seed) WHERE edit IS NOT NULL GROUP BY 1),
r AS (SELECT w.*, a.best_seed, a.noise_score - greatest(ln(1 + w.n), coalesce(u.useful_score, 0)) AS margin, CASE WHEN n_eligible = 0 THEN 'protected_only' WHEN w.form IN ({SEEDS_SQL}) THEN 'approved_seed' WHEN u.known THEN 'lexicon_form'
 WHEN length(w.form) < 3 THEN 'short_new_form' WHEN a.form IS NULL THEN 'no_noise_hypothesis' ELSE 'uncalibrated' END AS reason FROM words w LEFT JOIN a USING (form) LEFT JOIN u USING (form))
SELECT form, n, CASE reason WHEN 'approved_seed' THEN 'omit' WHEN 'uncalibrated' THEN 'review' ELSE 'keep' END AS decision, reason, best_seed, round(margin, 6) AS margin FROM r""")
def noi05_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.decisions(statistics(spark, sf_dir).where("is_word").select("form", "n", "n_eligible"), SEEDS, forms(spark, sf_dir))


def key_sql(form: str) -> str:
    bare = f"trim({form}, {quoted(T.EDGE)})"
    return f"CASE WHEN ({form_sql(bare)}) = {bare} THEN {bare} ELSE {form} END"


FAMILY_SQL = f"""approved AS (SELECT unnest([{", ".join(map(quoted, APPROVED))}]) AS seed), phrases AS (SELECT form, n, {key_sql("form")} AS p FROM stats WHERE NOT is_word),
lead AS (SELECT seed, n, {key_sql("seed")} AS p FROM (SELECT form AS seed, n FROM stats WHERE NOT is_word AND n >= 3 AND form NOT IN (FROM approved) ORDER BY n DESC, form LIMIT 2000) UNION ALL SELECT seed, 0, {key_sql("seed")} FROM approved),
anchors AS (SELECT p, arg_min(seed, (seed <> p, -n, seed)) AS anchor, count(*) AS size FROM lead GROUP BY p),
sides AS (SELECT f.form, f.n, f.p, l.seed, l.n AS lead_n, l.p AS lead_p FROM phrases f, lead l), pairs AS (SELECT *, coalesce(({EDIT_SQL}), CASE WHEN p = lead_p THEN 'edge_punctuation' END) AS operation FROM sides),
fits AS (SELECT q.*, CASE WHEN a.size > 1 OR q.p <> q.form THEN a.anchor END AS anchor, s.n AS uses FROM pairs q LEFT JOIN anchors a ON a.p = q.p LEFT JOIN stats s ON s.form = q.seed
 WHERE operation IS NOT NULL AND (q.seed = q.form OR q.seed IN (FROM approved) OR q.p = lead_p OR lead_n >= 3 * q.n)),
families AS (SELECT form, arg_min({{'seed': seed, 'operation': operation}}, (seed NOT IN (FROM approved), coalesce(seed <> anchor, true), -coalesce(uses, 0), seed)) AS x FROM fits GROUP BY form)"""


@query(f"{NOISE_SQL}, {FAMILY_SQL} SELECT form, x.seed AS seed, x.operation AS operation FROM families")
def noi06_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.families(statistics(spark, sf_dir), APPROVED)


AUTO_SQL = f"""lexicon_words AS (SELECT DISTINCT unnest({words_sql("text")}) AS w FROM benchmark),
pieces AS (SELECT s.form, s.n, s.n_eligible, s.n_eligible_days, s.n_bot, f.x.seed AS seed, f.x.operation AS operation, string_split(s.form, ' ') AS a, string_split(f.x.seed, ' ') AS b FROM stats s LEFT JOIN families f USING (form) WHERE NOT s.is_word),
changes AS (SELECT *, list_filter(list_zip(a, b), lambda x: x[1] IS DISTINCT FROM x[2]) AS c FROM pieces),
auto AS (SELECT form, n, n_eligible, seed, operation, CASE WHEN n_eligible <= 0 THEN NULL WHEN form IN (FROM approved) THEN 'approved_message_seed'
 WHEN seed IN (FROM approved) AND len(a) = len(b) AND len(c) = 1 AND regexp_full_match(c[1][1], '\\p{{L}}{{4,}}') AND regexp_full_match(c[1][2], '\\p{{L}}{{4,}}') AND c[1][1][1] = c[1][2][1] AND c[1][1][-1] = c[1][2][-1]
  AND c[1][1] NOT IN (FROM lexicon_words) AND operation IN ('transposition', 'lengthening') AND n_eligible >= 3 AND n_eligible_days >= 2 THEN 'confirmed_message_family'
 WHEN regexp_matches(form, '{N.COMMAND}') AND n_eligible >= 10 AND n_eligible_days >= 2 AND n_bot = n THEN 'structured_bot_command' END AS reason FROM changes)"""


def automatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics(spark, sf_dir)
    return N.automatic(s, staged(N.families(s, APPROVED), "families"), APPROVED, forms(spark, sf_dir))


@query(f"{NOISE_SQL}, {FAMILY_SQL}, {AUTO_SQL} SELECT form, n, n_eligible, seed, operation, reason FROM auto")
def noi07_automatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automatic(spark, sf_dir)


def run_key_sql(x: str) -> str:
    return f"array_to_string({_LETTERS.format(x)}, '')"


DEFAULT_SQL = f"""keyed AS (SELECT form, x.seed AS seed, {key_sql("form")} AS k1, {key_sql("x.seed")} AS k2 FROM families),
defaults AS (SELECT form, seed, CASE WHEN seed IS NULL THEN NULL WHEN {run_key_sql("k1")} IN ('да', 'нет', 'ага') OR {run_key_sql("k2")} IN ('да', 'нет', 'ага') THEN 'keep' ELSE 'omit' END AS decision FROM keyed)"""


@query(f"{NOISE_SQL}, {FAMILY_SQL}, {DEFAULT_SQL} SELECT form, seed, decision FROM defaults")
def noi08_family_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.families(statistics(spark, sf_dir), APPROVED)
    return found.select("form", "seed", N.family_default(F.col("form"), F.col("seed")).alias("decision"))


ROLLED_SQL = "judged AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'omit' WHEN n_eligible > 0 THEN 'review' ELSE 'keep' END AS decision FROM auto)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automatic(spark, sf_dir).withColumn("decision", F.when(F.col("reason").isNotNull(), "omit").when(F.col("n_eligible") > 0, "review").otherwise("keep"))


@query(f"""{NOISE_SQL}, {FAMILY_SQL}, {AUTO_SQL}, {ROLLED_SQL} SELECT seed, CAST(count(*) AS BIGINT) AS forms, CAST(sum(n) AS BIGINT) AS observed, CAST(sum(n_eligible) AS BIGINT) AS eligible, CAST(coalesce(sum(n) FILTER (decision = 'omit'), 0) AS BIGINT) AS omit,
CAST(coalesce(sum(n) FILTER (decision = 'review'), 0) AS BIGINT) AS review, CAST(coalesce(sum(n) FILTER (decision = 'keep'), 0) AS BIGINT) AS keep FROM judged WHERE seed IS NOT NULL GROUP BY seed""")
def agg14_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.roll_up(judged(spark, sf_dir))


@query(f"{NOISE_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY n DESC, form) AS rn, count(*) OVER () AS total FROM stats) SELECT form, n, n_eligible, total > 8 AS has_more FROM p WHERE rn > 3 AND rn <= 8")
def noi10_form_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the report: five forms behind the first three."""
    return N.page(statistics(spark, sf_dir).select("form", "n", "n_eligible"), F.col("n").desc(), F.col("form"), offset=3, limit=5)


@query(f"{NOISE_SQL} SELECT form, n FROM stats ORDER BY n DESC, form LIMIT 10")
def topk09_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(spark, sf_dir).select("form", "n").orderBy(F.col("n").desc(), "form").limit(10)


@query(f"""{NOISE_SQL}, {FAMILY_SQL}, {AUTO_SQL}, {ROLLED_SQL}, {DEFAULT_SQL},
explicit AS (SELECT form, 'keep' AS decision FROM stats WHERE starts_with(form, '/st')), inherited AS (SELECT form, 'omit' AS decision FROM stats WHERE length(form) = 2),
all_four AS (SELECT s.form, e.decision AS e, i.decision AS i, CASE WHEN d.form <> d.seed THEN d.decision END AS f, j.decision AS a FROM stats s LEFT JOIN explicit e USING (form) LEFT JOIN inherited i USING (form) LEFT JOIN defaults d USING (form) LEFT JOIN judged j USING (form))
SELECT form, coalesce(e, i, f, CASE WHEN a <> 'review' THEN a END, 'keep') AS decision, CASE WHEN e IS NOT NULL THEN 'explicit' WHEN i IS NOT NULL THEN 'inherited' WHEN f IS NOT NULL THEN 'family' WHEN a <> 'review' THEN 'analysis' ELSE 'default' END AS source FROM all_four""")
def noi11_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy that a draft compiles to."""
    s = statistics(spark, sf_dir)
    family = staged(N.families(s, APPROVED), "families").where("form <> seed").select("form", N.family_default(F.col("form"), F.col("seed")).alias("decision"))
    explicit, inherited = s.where("startswith(form, '/st')").select("form", F.lit("keep").alias("decision")), s.where("length(form) = 2").select("form", F.lit("omit").alias("decision"))
    return N.compiled(s, explicit, inherited, family, staged(judged(spark, sf_dir).select("form", "decision"), "judged"))


@query(f"{NOISE_SQL}, c AS (SELECT form, chat_id % 2 AS split FROM seen) SELECT form, CAST(count(DISTINCT split) AS BIGINT) AS splits, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY form HAVING count(DISTINCT split) > 1")
def noi13_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of the evaluation that stand in both its splits."""
    return N.leaks(seen(spark, sf_dir).withColumn("split", F.col("chat_id") % 2), "form", "split")


@query(f"""WITH {ARCHIVE_SQL}, s AS (SELECT chat_id, CAST(count(*) AS BIGINT) AS revision, max(timestamp) AS epoch, CAST(sum(deleted) AS BIGINT) AS exclusions FROM messages GROUP BY chat_id),
r AS (SELECT chat_id, CAST(count(*) AS BIGINT) AS revision, max(timestamp) AS epoch, CAST(sum(deleted) AS BIGINT) AS exclusions FROM messages WHERE NOT (chat_id % 2 = 0 AND has_photo = 1) GROUP BY chat_id)
SELECT s.chat_id, sha256(concat_ws('|', s.revision, s.epoch, s.exclusions)) AS fence, s IS DISTINCT FROM r AS stale FROM s LEFT JOIN r USING (chat_id)""")
def noi14_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chats' reports are stale: those that were made before their photos came."""
    m = messages(spark, sf_dir)
    state = lambda df: df.groupBy("chat_id").agg(F.count(F.lit(1)).alias("revision"), F.max("timestamp").alias("epoch"), F.sum("deleted").alias("exclusions"))
    held = lambda df, name: state(df).withColumn(name, N.fence(df, "revision", "epoch", "exclusions")).select("chat_id", name)
    both = held(m, "fence").join(held(m.where("not (chat_id % 2 = 0 and has_photo = 1)"), "then"), "chat_id", "left")
    return both.select("chat_id", "fence", (~F.col("fence").eqNullSafe(F.col("then"))).alias("stale"))


@query(f"""WITH {ARCHIVE_SQL}, twice AS (FROM messages UNION ALL FROM messages WHERE has_photo = 1), one AS (SELECT DISTINCT * FROM twice), f AS (SELECT *, {single_sql("text")} AS form FROM one WHERE kind = 'message')
SELECT form, CAST(count(*) AS BIGINT) AS n, CAST(count(reply_to) AS BIGINT) AS n_replies, CAST(sum(has_photo) AS BIGINT) AS n_photos FROM f WHERE form IS NOT NULL GROUP BY form""")
def agg23_single_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return N.single_words(m.union(m.where("has_photo = 1")))


@query(f"""WITH {ARCHIVE_SQL}, f AS (SELECT {single_sql("text")} AS form FROM messages WHERE kind = 'message') SELECT form, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, form) AS BIGINT) AS line FROM f WHERE form IS NOT NULL GROUP BY form""")
def src16_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single words written as CSV, the most frequent first, and read back with their line."""
    return csv_sink(N.single_words(messages(spark, sf_dir)).select("form", "n"), F.col("n").desc(), F.col("form"))


@query(f"""WITH {ARCHIVE_SQL}, b AS (SELECT chat_id, day, (row_number() OVER (PARTITION BY chat_id, day ORDER BY number) - 1) // 2 AS batch, n_tokens FROM chunks),
s AS (SELECT chat_id, day, batch, count(*) AS n, sum(n_tokens) AS t, max(n_tokens) AS most FROM b GROUP BY 1, 2, 3)
SELECT chat_id, day, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(t) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS batches, CAST(sum(n * most) AS BIGINT) AS slots, CAST(sum(n * most) - sum(t) AS BIGINT) AS padding FROM s GROUP BY 1, 2""")
def agg24_chunk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.chunk_metrics(derived(spark, sf_dir, "chunks"), 2)


@query(f"""WITH {ARCHIVE_SQL}, a AS (SELECT DISTINCT chat_id, author_id FROM messages WHERE has_photo = 1 AND author_id IS NOT NULL), b AS (SELECT DISTINCT chat_id, author_id FROM messages WHERE deleted = 1 AND author_id IS NOT NULL)
SELECT *, 'removed' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'added' FROM (FROM b EXCEPT FROM a)""")
def set04_exclusion_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded authors before and after: which were added and which removed."""
    m = messages(spark, sf_dir).where("author_id is not null")
    before, after = (m.where(x).select("chat_id", "author_id") for x in ("has_photo = 1", "deleted = 1"))
    return N.both_differences(before, after, "removed", "added")


CLASS_SQL = f"""asked AS (SELECT m.*, p.text AS parent_text FROM messages m LEFT JOIN messages p ON p.chat_id = m.chat_id AND p.message_id = m.reply_to), worded AS (SELECT *, {single_sql("text")} AS form FROM asked),
roled AS (SELECT *, CASE WHEN kind <> 'message' THEN 'service' WHEN trim(text, ' ') = '' THEN 'attachment' WHEN form IN ({SEEDS_SQL}) AND has_photo = 0 AND protected = 0 AND NOT coalesce(contains(parent_text, '?'), false) THEN 'filler'
 WHEN form IN ({", ".join(map(quoted, C.SUPPORT))}) THEN 'support' ELSE 'core' END AS role FROM worded)"""


@query(f"""WITH {ARCHIVE_SQL}, {CLASS_SQL} SELECT chat_id, message_id, role, role IN ('support', 'core') AS include, role = 'core' AND CASE WHEN has_photo = 1 THEN len(regexp_extract_all(text, {quoted(T.COMPOUND)})) > 1
 ELSE form IS NULL AND regexp_matches(trim(text, ' '), '\\s') AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]') END AS counts FROM roled""")
def chk01_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    parents = m.select("chat_id", F.col("message_id").alias("reply_to"), F.col("text").alias("parent_text"))
    return C.classified(m.join(parents, ["chat_id", "reply_to"], "left")).select(*KEY, "role", "include", "counts")


@query(f"""WITH {ARCHIVE_SQL}, {CLASS_SQL}, omitted AS (SELECT DISTINCT form FROM worded WHERE form IN ('12345', 'zzyzx'))
SELECT chat_id, message_id, form, form IN ({SEEDS_SQL}) OR form IN (FROM omitted) AS listed, (form IN ({SEEDS_SQL}) OR form = 'zzyzx') AND has_photo = 0 AND protected = 0 AND NOT coalesce(contains(parent_text, '?'), false) AS omitted FROM worded WHERE form IS NOT NULL""")
def chk07_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which whole words a policy names, and which of them it omits: not those with an attachment, entities or a question before them, nor a number."""
    m = messages(spark, sf_dir)
    policy = C.ChunkPolicy(omitted=("12345", "zzyzx"))
    parents = m.select("chat_id", F.col("message_id").alias("reply_to"), F.col("text").alias("parent_text"))
    w = m.join(parents, ["chat_id", "reply_to"], "left").withColumn("form", T.whole_word(F.col("text"))).where("form is not null")
    guarded = (F.col("has_photo") == 1) | (F.col("protected") == 1)
    return w.select(*KEY, "form", F.col("form").isin(*policy.filler, *policy.omitted).alias("listed"), C.omits(F.col("text"), guarded, F.col("parent_text"), policy).alias("omitted"))


@query(f"""WITH {ARCHIVE_SQL}, own AS (SELECT DISTINCT chat_id, 'policy-b' AS policy FROM messages WHERE chat_id % 2 = 1) SELECT s.chat_id, s.day, coalesce(o.policy, 'policy-a') AS policy, coalesce(o.policy, 'policy-a') <> 'policy-a' AS rebuild FROM segments s LEFT JOIN own o USING (chat_id)""")
def chk08_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy of each segment, its chat's own or the default, and whether it was built by another."""
    segments = derived(spark, sf_dir, "segments").withColumn("built", F.lit("policy-a"))
    own = messages(spark, sf_dir).where("chat_id % 2 = 1").select("chat_id", F.lit("policy-b").alias("policy")).distinct()
    return C.resolved(segments, own, "policy-a").select("chat_id", "day", "policy", "rebuild")


OTHER = C.ChunkPolicy(omitted=("zzyzx", "good morning team"))


@query(f"""WITH {ARCHIVE_SQL}, {CLASS_SQL}, phrased AS (SELECT *, {form_sql("text")} AS phrase FROM roled)
SELECT chat_id, message_id, 'removed' AS change FROM phrased WHERE role = 'core' AND phrase IN ('zzyzx', 'good morning team') AND has_photo = 0 AND protected = 0 AND NOT coalesce(contains(parent_text, '?'), false)""")
def noi12_owned_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy that leaves out a word and a phrase would take from the chunks, and what it would bring back: both built in one pass."""
    m = messages(spark, sf_dir).withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    return N.dry_run(C.built(m, [C.ChunkPolicy(), OTHER]), "core").select("chat_id", "message_id", "change")


@query(f"""WITH {ARCHIVE_SQL}, {CLASS_SQL}, phrased AS (SELECT *, {form_sql("text")} AS phrase FROM roled),
gone AS (SELECT *, coalesce(phrase IN ('zzyzx', 'good morning team') AND has_photo = 0 AND protected = 0 AND NOT coalesce(contains(parent_text, '?'), false), false) AS omitted FROM phrased WHERE role = 'core')
SELECT chat_id, CAST(count(*) AS BIGINT) AS owned_a, CAST(count(*) FILTER (NOT omitted) AS BIGINT) AS owned_b FROM gone GROUP BY 1""")
def noi12_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By chat the core messages that the chunks of either policy own."""
    m = messages(spark, sf_dir).withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    return N.dry_run_totals(C.built(m, [C.ChunkPolicy(), OTHER])).select("chat_id", "owned_a", "owned_b")


@query("""WITH r AS (SELECT doc_id, list_filter([CASE WHEN n_chars > 2000 THEN 'text_limit' END, CASE WHEN doc_id % 3 = 0 THEN 'candidate_limit' END, CASE WHEN doc_id % 7 = 0 THEN 'odd_limit' END], lambda x: x IS NOT NULL) AS l FROM documents)
SELECT doc_id, NOT list_contains(l, 'text_limit') AND NOT list_contains(l, 'odd_limit') AS source_complete, NOT list_contains(l, 'candidate_limit') AS evidence_complete, NOT list_contains(l, 'odd_limit') AS applicable FROM r""")
def noi09_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether reports that met limits may still be applied."""
    limits = F.array_compact(F.array(F.when(F.col("n_chars") > 2000, "text_limit"), F.when(F.col("doc_id") % 3 == 0, "candidate_limit"), F.when(F.col("doc_id") % 7 == 0, "odd_limit")))
    return N.applicable(table(spark, sf_dir, "documents").select("doc_id", limits.alias("limits"))).drop("limits")
