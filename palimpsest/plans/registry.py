"""Where queries are registered, and SQL text that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.functions.text import COMPOUND, ENCLOSING, STOP_WORDS, TOKEN, WORD
from palimpsest.sources.views import MESSAGES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WITH = f"WITH {MESSAGES_SQL}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name, with the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def folded_sql(text: str) -> str:
    """The normal form, for the characters outside plain lower case that the tables and the special messages have."""
    return f"replace(replace(replace(lower(translate(nfc_normalize({text}), 'ＡＢＣ', 'abc')), 'ß', 'ss'), 'ﬁ', 'fi'), 'ё', 'е')"


def words_sql(text: str) -> str:
    return f"regexp_extract_all({folded_sql(text)}, '[\\p{{L}}\\p{{N}}]+')"


#: The stop words, for SQL.
STOPS = ", ".join("'" + x.replace("'", "''") + "'" for x in STOP_WORDS)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def keywords_sql(text: str) -> str:
    kept = f"list_filter(regexp_extract_all({folded_sql(text)}, {quoted(TOKEN)}), lambda x: replace(x, '’', chr(39)) NOT IN ({STOPS}))"
    return f"flatten(list_transform({kept}, lambda x: regexp_extract_all(x, '{WORD}')))"


def single_sql(text: str) -> str:
    """The whole word of a text, or null."""
    bare = f"trim({folded_sql(text)}, {quoted(ENCLOSING)})"
    return f"CASE WHEN regexp_full_match({bare}, {quoted(COMPOUND)}) THEN {bare} END"


def phrase_sql(text: str) -> str:
    return f"trim(regexp_replace({folded_sql(text)}, '\\s+', ' ', 'g'), ' ')"


def form_sql(text: str) -> str:
    """The form of a short message, or null."""
    single, value = single_sql(text), phrase_sql(text)
    found = f"regexp_extract_all({value}, {quoted(COMPOUND)})"
    fits = f"length({value}) BETWEEN 1 AND 256 AND len({found}) BETWEEN 1 AND 32 AND len(list_distinct({found})) < 5 AND NOT contains({value}, '://') AND NOT starts_with({value}, 'www.') AND NOT regexp_matches({value}, '[\\x00-\\x1f]')"
    return f"""CASE WHEN length({text}) > 512 THEN NULL WHEN ({single}) IS NOT NULL THEN CASE WHEN length({single}) <= 64 THEN {single} END
 WHEN {fits} AND (len({found}) > 1 OR starts_with({value}, '/')) THEN {value} END"""


def day_sql(seconds: str) -> str:
    return f"strftime(make_timestamp(CAST({seconds} AS BIGINT) * 1000000), '%Y-%m-%d')"


def bm25_sql(terms: list[str], source: str = "messages", keys: str = "chat_id, message_id, timestamp", name: str = "scored") -> str:
    """CTEs that end in `name`: keys and score of the rows of source with all terms."""
    distinct = list(dict.fromkeys(terms))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(distinct))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(distinct)))
    parts = " + ".join(
        f"{terms.count(t)} * greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i, t in enumerate(distinct)
    )
    every = " AND ".join(f"tf{i} > 0" for i in range(len(distinct)))
    return f"""{name}_w AS (SELECT *, {words_sql("text")} AS w FROM {source}),
{name}_t AS (SELECT * EXCLUDE (w), len(w) AS dl, {tf} FROM {name}_w),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM {name}_t),
{name} AS (SELECT {keys}, -({parts}) AS score FROM {name}_t, {name}_s WHERE {every})"""
