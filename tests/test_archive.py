"""Archive operators against models in Python, fixed vectors and repeated runs, where SQL has no say."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from palimpsest.functions.text import chat_id, folded, query_terms, serialize
from palimpsest.operators import chunking as C
from palimpsest.operators import encode as E
from palimpsest.operators import exports as X
from palimpsest.operators import hybrid as H
from palimpsest.operators import ingest as I
from palimpsest.operators import noise as N
from palimpsest.operators import postings as P
from palimpsest.operators import vectors as V
from palimpsest.operators.store import Store
from palimpsest.plans.segments import SPEC, archive
from palimpsest.plans.spec import SearchSpec, read_cursor, write_cursor
from palimpsest.sources.exports import scratch
from palimpsest.sources.views import messages
from palimpsest.streaming import feed

SMALL = "/root/testdata/sf0.001"
MESSAGE = "chat_id long, message_id long, timestamp long, author_id string, author string, kind string, text string, has_photo int, protected int, deleted int, reply_to long, content_hash string"


def made(spark, rows):
    """Messages of chat 1: (message_id, timestamp, author, text) and changes to a plain message."""
    base = {"chat_id": 1, "kind": "message", "has_photo": 0, "protected": 0, "deleted": 0, "reply_to": None}
    full = [base | {"message_id": i, "timestamp": t, "author_id": a, "author": a, "text": x, "content_hash": x[:5]} | more for i, t, a, x, more in rows]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in MESSAGE.split(", ")) for r in full], MESSAGE)


def test_query_terms():
    assert query_terms("It's the BOOK, don’t he’s O'Reilly") == ["book", "don", "t", "o", "reilly"]
    assert query_terms("не нет без и или") == ["не", "нет", "без"]


def test_normal_forms(spark):
    rows = spark.createDataFrame([("Straße ﬁ Ёлка", "a"), (None, "b")], "text string, k string")
    assert {r.k: r.n for r in rows.select("k", folded(F.col("text")).alias("n")).collect()} == {"a": "strasse fi елка", "b": None}
    one = rows.select(chat_id(F.lit("s"), F.lit("7")).alias("x")).first().x
    assert len(one) == 36 and one[14] == "5"
    assert serialize({"b": 1, "a": ["é", None]}) == '{"a":["é",null],"b":1}'


def test_content_of_messages(spark):
    marked = {"type": "message", "from_id": "u1", "text": ["a😀", {"type": "bold", "text": "bc"}, {"type": "text_url", "text": "d", "href": "h"}, " e"]}
    assert X.entities(marked) == [{"type": "bold", "offset": 3, "length": 2}, {"type": "text_link", "offset": 5, "length": 1, "href": "h"}]
    listed = marked | {"text": "a😀bcd e", "text_entities": [{"type": "text_link", "text": "d", "href": "h", "offset": 5, "length": 1}, {"type": "bold", "text": "bc", "offset": 3, "length": 2}]}
    media = [{"kind": "photo", "sha256": None, "relative_path": "p"}]
    assert X.digest(X.content(marked, 5, media)) == X.digest(X.content(listed, 5, media))
    assert X.digest(X.content(marked | {"from": "Name"}, 5, [])) == X.digest(X.content(marked, 5, []))
    assert X.digest(X.content(marked, 6, [])) != X.digest(X.content(marked, 5, []))
    rows = spark.createDataFrame([(serialize(marked), 5, serialize(media)), (serialize(listed), 5, serialize(media))], "message string, sent long, media string")
    found = {r.h for r in rows.select(X.content_hash("message", "sent", "media").alias("h")).collect()}
    assert found == {X.digest(X.content(marked, 5, media))}


def test_exports(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 5, "name": "N", "type": "t", "messages": [{"id": 1, "date_unixtime": "7", "text": "x"}]}')
    files = X.read_exports(spark, str(tmp_path))
    r = X.summaries(files).first()
    assert (r.external_id, r.name, r.n_messages) == (5, "N", 1) and r.digest == hashlib.sha256((tmp_path / "a.json").read_bytes()).hexdigest()
    with pytest.raises(PySparkException):
        X.summaries(spark.createDataFrame([('{"id": 1}',)], "raw string")).collect()


def test_chunks_keep_budgets_and_lose_nothing(spark):
    """Whole archive: budgets hold, every core message is in a chunk, parts of long texts cover them, ids are stable."""
    m = messages(spark, SMALL).withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    for policy in (C.ChunkPolicy(), C.ChunkPolicy(max_messages=3, overlap_messages=1, max_source_messages=8, max_tokens=40)):
        found = C.chunks(m, policy).collect()
        assert sorted(c.chunk_id for c in found) == sorted(c.chunk_id for c in C.chunks(m.repartition(3), policy).collect())
        assert all(c.n_tokens <= policy.max_tokens and len(c.sources) <= policy.max_source_messages for c in found)
        assert all(any(p.role in ("core", "borrowed_context") for p in c.parts) for c in found)
        held = {}
        for c in found:
            for p in c.parts:
                if p.role == "core":
                    held.setdefault((c.chat_id, p.message_id), set()).update(range(p.start, p.end))
        parents = m.select("chat_id", F.col("message_id").alias("reply_to"), F.col("text").alias("parent_text"))
        core = [r for r in C.classified(m.join(parents, ["chat_id", "reply_to"], "left"), policy).collect() if r.role == "core"]
        assert core and all(held.get((r.chat_id, r.message_id)) == set(range(len(r.text))) for r in core)
    assert C.ChunkPolicy().identity != C.ChunkPolicy(max_tokens=479).identity
    with pytest.raises(ValueError):
        C.ChunkPolicy(max_messages=9)


def test_chunk_windows_context_and_turns(spark):
    day = 1704067200
    rows = [(1, day, "a", "first words here", {}), (2, day + 30, "a", "same turn again", {}), (3, day + 40, "b", "да", {"reply_to": 1}), (4, day + 4000, "b", "да", {"reply_to": 1}), (5, day + 4010, "b", "", {}), (6, day + 86400, "a", "next day it is", {}), (7, day + 86410, "a", "gone by now", {"deleted": 1}), (8, day + 86420, "s", "joined", {"kind": "service"})]
    found = {c.ordinal if c.day == "2024-01-01" else c.day + str(c.ordinal): c for c in C.chunks(made(spark, rows)).collect()}
    assert found[0].text == "a: first words here\nsame turn again\nb: да"
    # an answer alone borrows what it replies to
    assert found[1].text == "In reply to (a): first words here\nb: да" and [p.role for p in found[1].parts] == ["borrowed_context", "support"]
    assert [(d.message_id, d.content_hash) for d in found[1].dependencies] == [(1, "first")]
    assert found["2024-01-020"].text == "a: next day it is" and found["2024-01-021"].text == "a: gone by now" and len(found) == 4
    # a long text in parts that overlap
    long = " ".join(f"word{k}" for k in range(300))
    parts = [c.parts[0] for c in sorted(C.chunks(made(spark, [(1, day, "a", long, {})]), C.ChunkPolicy(max_tokens=64)).collect(), key=lambda c: c.ordinal)]
    assert parts[0].start == 0 and parts[-1].end == len(long) and all(a.start < b.start <= a.end for a, b in zip(parts, parts[1:], strict=False))


def test_two_policies_side_by_side(spark):
    """A policy that omits more makes fewer or equal chunks; what is owned differs by the omitted messages alone."""
    m = messages(spark, SMALL).withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    owned = lambda p: {(c.chat_id, x.message_id) for c in C.chunks(m, p).collect() for x in c.parts if x.role != "borrowed_context"}
    a, b = owned(C.ChunkPolicy()), owned(C.ChunkPolicy(omitted=("zzyzx", "12345")))
    texts = {(r.chat_id, r.message_id): r.text for r in m.collect()}
    assert a - b and all(texts[k] == "zzyzx" for k in a - b) and not b - a  # a number's looks protect it


def test_approximate_vectors(spark):
    """Recall of the probed cells, the tail, exact answers for small scopes and wrong dimensions."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).astype(float).tolist()) for i in range(3000)] + [(9001, None), (9002, [0.0] * 16)]
    given = spark.createDataFrame(rows, "id long, vector array<float>")
    store = Store(spark, scratch(spark, "ann-test"))
    centres = V.built(store, given, 16)
    hits = 0
    for _ in range(3):
        goal = rng.standard_normal(16).tolist()
        exact = {r.id for r in V.R.nearest(given, goal, 10).collect()}
        found, strategy, reasons = V.search(store.read(), centres, goal, 10, probes=10)
        assert (strategy, reasons) == ("ann", [])
        hits += len(exact & {r.id for r in found.collect()})
    assert hits / 30 >= 0.9
    tail = store.read().unionByName(spark.createDataFrame([(7777, goal)], "id long, vector array<float>").withColumn("cell", F.lit(None).cast("int")))
    assert V.nearest(tail, centres, goal, 1, probes=1).first().id == 7777
    few = given.where("id < 50").select("id")
    assert V.search(store.read(), centres, goal, 5, few)[1:] == ("exact", ["small_scope"])
    assert V.search(store.read(), None, goal, 5)[1:] == ("exact", ["no_index"])
    assert V.search(store.read(), np.ones((4, 8)), goal, 5)[1:] == ("exact", ["incompatible"])
    with pytest.raises(PySparkException):
        store.checked(17).where("vector is not null").collect()


def test_small_shares_are_scanned_and_copies_tie(spark):
    """A tenth of the rows is a small scope however large the table; equal vectors stand by id wherever they are."""
    rng = np.random.default_rng(6)
    same = rng.standard_normal(48).astype(np.float32)
    rows = [(i, (same if i % 3 == 0 else rng.standard_normal(48)).astype(float).tolist()) for i in range(12_000)]
    given = spark.createDataFrame(rows, "id long, vector array<float>")
    goal = same.astype(float).tolist()
    assert [r.id for r in V.R.nearest(given, goal, 50).collect()] == [i for i in range(11_999, 0, -1) if i % 3 == 0][:50]
    index, centres = given.withColumn("cell", F.lit(0)), np.array([goal])
    assert V.search(index, centres, goal, 5, given.where("id % 10 = 0").select("id"))[1:] == ("exact", ["small_scope"])
    assert V.search(index, centres, goal, 5, given.where("id % 2 = 0").select("id"))[1:] == ("ann", [])


def test_candidate_limit_is_told(spark):
    """More seeds than the limit share a signature: the rest is cut, and said to be."""
    seeds = spark.createDataFrame([(f"ab{c}",) for c in "cdefgh"], "form string")
    found = N.candidates(spark.createDataFrame([("ab",)], "form string"), seeds, most=4).collect()
    assert len(found) == 4 and all(r.incomplete for r in found)
    stats = spark.createDataFrame([("abz", 2, 2), ("lool", 3, 3)], "form string, n long, n_eligible long")
    reasons = {r.form: r.reason for r in N.decisions(stats, ("abc", "abd", "abe", "lol"), spark.createDataFrame([("word",)], "form string"), most=2).collect()}
    assert reasons == {"abz": "candidate_limit", "lool": "uncalibrated"}


def test_modes_of_search(spark):
    m, chunks, parts, segments = archive(spark, SMALL, "messages", "chunks", "parts", "segments")
    blank = H.hybrid(m, chunks, parts, segments, None, SearchSpec(query=" ", mode="hybrid"), [0.0])
    assert blank.count() == 0
    exact = SearchSpec(**(vars(SPEC) | {"exact_phrase": True}))
    assert {r.mode for r in H.hybrid(m, chunks, parts, segments, None, exact, [0.0] * 64).collect()} <= {"words"}
    assert H.hybrid(m, chunks, parts, segments.limit(0), None, SPEC, [0.0] * 64).select("mode").distinct().collect()[0].mode == "words"


def test_cursors_belong_to_their_query():
    spec = SearchSpec(content_type="text")
    cursor = write_cursor(spec, 3, (5, 1, 2))
    assert read_cursor(SearchSpec(content_type="text"), 3, cursor) == (5, 1, 2)
    for other, epoch in ((SearchSpec(), 3), (spec, 4)):
        with pytest.raises(ValueError):
            read_cursor(other, epoch, cursor)


def test_empty_scope_and_query_find_nothing(spark):
    m = messages(spark, SMALL)
    assert m.where(SearchSpec(scope="selected").filters()).count() == 0
    assert H.R.phrase(m, "").count() == 0 and H.R.bm25(m, "the of").count() == 0


def test_feed_goes_on_where_it_ended(spark, tmp_path):
    """A second start on the same folders counts each event once."""
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    first, second = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    source, root = f"{tmp_path}/source", f"file://{tmp_path}/root"
    first.repartition(3).write.parquet(source)
    feed.run(spark, source, events.schema, root)
    again = feed.run(spark, source, events.schema, root)
    assert again.read().agg(F.sum("n")).first()[0] == first.count()
    second.repartition(2).write.mode("append").parquet(source)
    state = feed.run(spark, source, events.schema, root).read()
    rows = lambda df: sorted(map(tuple, df.select("user_id", "event_id", "ts", "op", "n").collect()))
    assert rows(state) == rows(feed.folded(feed.received(events)))


def test_encoders():
    states = np.arange(12, dtype=float).reshape(1, 4, 3)
    mask = np.array([[1, 1, 0, 0]])
    assert np.allclose(E.mean_pooled(states, mask), E.unit(states[:, :2].mean(1)))
    assert E.best_path(np.eye(4)[[0, 1, 1, 0, 1, 3, 3]], "abc") == ("aac", 1.0)
    assert E.tried(lambda x: [1 / v for v in x], [[1, 0, 2]]) == ([1.0, None, 0.5], [None, "division by zero", None])


def test_reconcile_bounds(spark):
    with pytest.raises(ValueError):
        I.reconcilable(spark.range(1), 31)


def test_dry_runs_make_chunks_once(spark):
    """Both sides of a comparison come from one pass, with the rows that two passes give."""
    m = messages(spark, SMALL).withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    made_ = C.built(m, [C.ChunkPolicy(), C.ChunkPolicy(omitted=("zzyzx", "good morning team"))])
    changes, totals = N.dry_run(made_, "core"), N.dry_run_totals(made_)
    for found in (changes, totals):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    chunks = made_.collect()
    held = {(c.policy, c.chat_id, p.message_id) for c in chunks for p in c.parts if p.role == "core"}
    one, two = ({x[1:] for x in held if x[0] == k} for k in (0, 1))
    assert sorted(map(tuple, changes.collect())) == sorted([(*x, "removed") for x in one - two] + [(*x, "restored") for x in two - one]) != []
    sums = lambda k, chat: (sum(c.policy == k and c.chat_id == chat for c in chunks), sum(c.n_tokens for c in chunks if c.policy == k and c.chat_id == chat), sum(x[:2] == (k, chat) for x in held))
    for r in totals.collect():
        assert ((r.chunks_a, r.tokens_a, r.owned_a), (r.chunks_b, r.tokens_b, r.owned_b)) == (sums(0, r.chat_id), sums(1, r.chat_id))
