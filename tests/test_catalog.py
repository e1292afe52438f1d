"""Every query that has SQL gives the rows that DuckDB gives for it; the others give rows."""

import os

import duckdb
import pytest

from palimpsest.catalog import FLAGSHIP, ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Values that a query must show somewhere, so that each of its rules is tested.
REACHED = {
    "chk01_roles": ("role", {"service", "attachment", "filler", "support", "core"}),
    "ing01_classify": ("outcome", {"remote_deleted", "added", "unchanged", "updated", "older_revision", "uncertain_revision"}),
    "ing06_preview": ("outcome", {"stale", "added", "updated"}),
    "noi05_decisions": ("reason", {"protected_only", "approved_seed", "lexicon_form", "short_new_form", "no_noise_hypothesis", "uncalibrated"}),
    "noi11_policy": ("source", {"explicit", "inherited", "analysis", "family"}),
    "src19_probe": ("status", {"unsafe", "missing", "corrupt", "unverified", "ready", "changed"}),
    "str03_late_data": ("fate", {"accepted", "repeated", "late", "rejected"}),
    "join06_reply_ancestors": ("grandparent_id", {0, None}),
    "fn14_whole_word": ("word", {"lol", "да", "x2y", "with"}),
    "fn15_message_form": ("form", {"/start", "good morning team", "gg gg", "lool", None}),
    "fn18_laughter": ("seed", {"хаха", None}),
    "fil11_bounds": ("n", set()),  # several chats: no chat_id
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def rows(records):
    plain = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    mine = rows(tuple(r) for r in found.select(*columns).collect())
    assert mine, "no rows: nothing was tested"
    if name in REACHED:
        column, values = REACHED[name]
        assert {r[columns.index(column)] for r in mine} >= values, "a branch was not reached"
    else:
        empty = [c for i, c in enumerate(columns) if all(r[i] is None for r in mine)]
        assert not empty, f"always null: {empty}"
    if name not in ORACLE_SQL:
        return
    said = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = rows(tuple(r[i] for i in order) for r in said.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES
