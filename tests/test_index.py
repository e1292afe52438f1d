"""Stored versions and indexes: racing writers, pinned readers, untouched partitions, merged segments, letter grams, and the normal form that search goes by."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import STABLE, folded, normal, substring_edits
from palimpsest.operators import postings as P
from palimpsest.operators import retrieval as R
from palimpsest.operators.store import PartitionedStore, Store, Superseded, retried
from palimpsest.sources.exports import scratch


def numbers(df):
    return sorted(r[0] for r in df.collect())


def test_versions_one_after_the_other(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/table")
    with pytest.raises(ValueError):
        store.read()
    store.publish(spark.range(5))
    before = store.read()
    store.publish(spark.range(9).repartition(4))
    store.compact(1 << 20)
    assert (before.count(), store.read().count(), store.current()[0]) == (5, 9, 2)
    assert store.clean(1) == [0, 1]
    assert store.read().count() == 9
    store.publish(spark.range(0))
    assert store.read().count() == 0


def test_a_racing_writer_loses_cleanly(spark, tmp_path):
    """Two writers go from the same version: one is told so, its folder is gone, and its retry builds on the winner."""
    a, b = (Store(spark, f"file://{tmp_path}/table") for _ in range(2))
    a.publish(spark.range(3))
    number = b._next(None)
    a.publish(a.read().union(spark.range(10, 12)))
    with pytest.raises(Superseded):
        b.publish(spark.range(100), number)
    assert numbers(b.read()) == [0, 1, 2, 10, 11]
    assert len(b.files.names("data")) == 2
    assert retried(lambda: b.publish(b.read().union(spark.range(20, 21)))) == 2
    assert numbers(a.read()) == [0, 1, 2, 10, 11, 20]


def test_pinned_versions_outlast_cleaning(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/table")
    store.publish(spark.range(4))
    with store.pin() as kept:
        rows = kept.read()
        store.publish(spark.range(5))
        store.publish(spark.range(6))
        assert store.clean(1) == [1]
        assert rows.count() == 4 and kept.read().count() == 4 and kept.moved()
        # a writer whose version was already taken away from the list keeps its folders while it is read
        assert store.numbers() == [2]
    assert store.clean(1) == [0]
    assert len(store.files.names("data")) == 1


def test_outbox_is_part_of_its_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/table")
    said = lambda *x: spark.createDataFrame([(i,) for i in x], "day long")
    store.publish(spark.range(1), outbox=said(1))
    store.publish(spark.range(2), outbox=said(2, 3))
    store.publish(spark.range(3))
    with pytest.raises(Superseded):
        store.publish(spark.range(9), 2, outbox=said(99))
    assert sorted((r.version, r.day) for r in store.told().collect()) == [(0, 1), (1, 2), (1, 3)]
    assert numbers(store.told(0).select("day")) == [2, 3] and store.told(1) is None
    store.acknowledge("index", 0)
    assert store.clean(1) == [0]  # version 1 has told something that nobody dealt with yet
    store.acknowledge("index", 2)
    assert store.clean(1) == [1]


def test_changes_write_only_the_partitions_they_touch(spark, tmp_path):
    rows = [(c, m, f"2024-01-0{1 + m % 3}", f"t{c}-{m}") for c in range(3) for m in range(9)]
    schema = "chat_id long, message_id long, day string, text string"
    store = PartitionedStore(spark, f"file://{tmp_path}/messages", ["chat_id", "day"])
    store.publish(spark.createDataFrame(rows, schema))
    before = store.at().parts
    assert len(before) == 9
    # one message is edited, one moves to another day, one is gone
    changed = spark.createDataFrame([(0, 0, "2024-01-01", "new"), (1, 1, "2024-01-09", "moved")], schema)
    gone = spark.createDataFrame([(2, 2)], "chat_id long, message_id long")
    touched = store.upsert(changed, gone, ["chat_id", "message_id"])
    assert touched == {(0, "2024-01-01"), (1, "2024-01-02"), (1, "2024-01-09"), (2, "2024-01-03")}
    after = store.at().parts
    assert {k for k in before if after.get(k) == before[k]} == {k for k in before if store.values(k) not in {tuple(map(str, x)) for x in touched}}
    want = {(c, m): t for c, m, _, t in rows} | {(0, 0): "new", (1, 1): "moved"}
    want.pop((2, 2))
    assert {(r.chat_id, r.message_id): r.text for r in store.read().collect()} == want
    # a partition whose last row is gone is no longer listed
    store.upsert(changed.limit(0), spark.createDataFrame([(1, 1)], "chat_id long, message_id long"), ["chat_id", "message_id"])
    assert (1, "2024-01-09") not in {(int(a), b) for a, b in map(store.values, store.at().parts)}
    base = store.at()
    store.upsert(changed.limit(1), gone, ["chat_id", "message_id"])
    with pytest.raises(Superseded):
        store.replace(changed, [(0, "2024-01-01")], base)


def test_small_partitions_share_folders(spark, tmp_path):
    """Many days in few folders: what a change doesn't touch keeps its folder, and other days of the touched ones their rows."""
    rows = [(c, m, f"2024-01-{1 + m % 28:02}", f"t{c}-{m}") for c in range(20) for m in range(28)]
    schema = "chat_id long, message_id long, day string, text string"
    store = PartitionedStore(spark, f"file://{tmp_path}/messages", ["chat_id", "day"], 8)
    store.publish(spark.createDataFrame(rows, schema))
    before = store.at().parts
    assert len(before) == 8
    changed = spark.createDataFrame([(0, 0, "2024-01-01", "new")], schema)
    touched = store.upsert(changed, spark.createDataFrame([(2, 2)], "chat_id long, message_id long"), ["chat_id", "message_id"])
    assert 1 <= len(touched) <= 2
    after = store.at().parts
    assert {k for k in before if after[k] != before[k]} == {f"_bucket={x}" for (x,) in touched}
    want = {(c, m): t for c, m, _, t in rows} | {(0, 0): "new"}
    want.pop((2, 2))
    assert {(r.chat_id, r.message_id): r.text for r in store.read().collect()} == want


def test_null_and_odd_partition_values(spark, tmp_path):
    rows = [(1, None, "a"), (2, "a/b=c %", "b"), (3, "", "c")]
    store = PartitionedStore(spark, f"file://{tmp_path}/t", ["day"])
    store.publish(spark.createDataFrame(rows, "k long, day string, text string"))
    store.upsert(spark.createDataFrame([(2, "a/b=c %", "new")], "k long, day string, text string"), spark.createDataFrame([(1,)], "k long"), ["k"])
    assert sorted(tuple(r) for r in store.read().select("k", "text").collect()) == [(2, "new"), (3, "c")]


TEXTS = ["red fox", "the red red dog", "blue fox", "", "a fox in the red box", None, "red", "dog dog dog"]


def scored(df):
    return {r.k: round(r.score, 9) for r in df.collect()}


def test_segments_score_as_one_index(spark):
    """Updates write segments of their own size, merge by size classes, and never change a score."""
    texts = {k: TEXTS[k % len(TEXTS)] for k in range(64)}
    frame = lambda some: spark.createDataFrame(sorted(some.items()), "k long, text string")
    store = Store(spark, scratch(spark, "lsm"))
    index = P.WordIndex(store, ["k"]).build(frame(texts))
    rng = random.Random(3)
    sizes = []
    for step in range(9):
        changed = {rng.randrange(70): rng.choice(TEXTS) for _ in range(2)}
        gone = [k for k in rng.sample(sorted(texts), 1) if k not in changed]
        before = set(store.at().parts)
        index.update(frame(changed), spark.createDataFrame([(k,) for k in gone], "k long"))
        texts |= changed
        for k in gone:
            texts.pop(k)
        sizes.append([int(x.split(":")[1]) for x in store.at().parts if x not in before])
        if step in (2, 8):
            want = scored(R.bm25(frame({k: v for k, v in texts.items()}).select("k", F.coalesce("text", F.lit("")).alias("text")), "red fox red"))
            assert want and scored(index.bm25("red fox red")) == pytest.approx(want)
    assert max(map(sum, sizes)) <= 4 * 3  # never near the 64 texts of the first segment
    assert len(store.at().parts) < 9
    before = scored(index.bm25("red")), {tuple(r) for r in index.phrase("red red").collect()}
    index.merge(all_=True)
    assert len(store.at().parts) == 1
    assert (scored(index.bm25("red")), {tuple(r) for r in index.phrase("red red").collect()}) == before
    assert store.at().facts["texts"] == len(texts)
    assert index.bm25("the of").count() == 0


def grams(spark, texts):
    root = scratch(spark, "grams")
    return P.GramIndex(Store(spark, f"{root}/g"), Store(spark, f"{root}/t"), "k").build(spark.createDataFrame(list(enumerate(texts)), "k long, text string"))


def test_gram_lists_are_whole_and_bounded():
    """Each gram's texts, as brute force finds them, listed for so many texts or words at a time; the shuffle gets lists, not a row for each text and gram."""
    rng = random.Random(1)
    texts = [list(dict.fromkeys("".join(rng.choice("abcé𝄞я1") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    texts[5] = texts[6] = []
    given = pa.RecordBatch.from_arrays([pa.array(range(100, 400)), pa.array(texts, pa.list_(pa.string()))], names=["k", "words"])
    want: dict[str, set[int]] = {}
    for k, own in enumerate(texts, 100):
        for x in own:
            for gram in {f"={x}", *(f"{n}{y}" for n in (1, 2, 3) for y in P.pieces(x, n))}:
                want.setdefault(gram, set()).add(k)
    for most, words in ((1 << 14, 1 << 18), (7, 1 << 18), (1000, 50), (1, 1)):
        for batches in ([given], [given.slice(0, 10), given.slice(10, 0), given.slice(10, 150), given.slice(160)]):
            got: dict[str, set[int]] = {}
            for part in P.gram_lists(iter(batches), most, words):
                assert len(set(part.column(0).to_pylist())) == part.num_rows
                for gram, keys in zip(*part.to_pydict().values(), strict=True):
                    assert 0 < len(keys) <= most and len(set(keys)) == len(keys) and not got.setdefault(gram, set()) & set(keys)
                    got[gram] |= set(keys)
            assert got == want
    assert sum(x.num_rows for x in P.gram_lists(iter([given]), 1 << 14, 1 << 18)) == len(want)
    assert sum(x.num_rows for x in P.gram_lists(iter([given.slice(5, 2)]), 5, 5)) == 0


def found(df):
    return {r.k: (r.kind, r.edits) for r in df.collect()}


def test_words_parts_and_typos(spark):
    index = grams(spark, ["the red fox jumps", "redfoxes", "rde fox", "a fxo is redd", "blue fox", "abdc", "reed fix", None, ""])
    assert found(index.search("fox red")) == {0: ("exact", 0), 1: ("substring", 0)}
    assert found(index.search("abcd")) == {5: ("fuzzy", 1)}
    assert found(index.search("jumpz")) == {0: ("fuzzy", 1)}
    assert found(index.search("x")) == {0: ("substring", 0), 1: ("substring", 0), 2: ("substring", 0), 3: ("substring", 0), 4: ("substring", 0), 6: ("substring", 0)}
    assert index.search("the of").count() == 0 and index.search("").count() == 0


def edits(pattern: str, text: str) -> int:
    """The distance table of a pattern against all substrings of a text, adjacent swaps included."""
    rows = [[0] * (len(text) + 1)]
    for i, a in enumerate(pattern, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a != b))
            if i > 1 and j > 1 and a == text[j - 2] and pattern[i - 2] == b:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return min(rows[-1])


def test_substring_edits_are_those_of_the_distance_table():
    rng = random.Random(11)
    for _ in range(150):
        pattern = "".join(rng.choice("abc𝄞") for _ in range(rng.choice([1, 2, 5, 8, 63, 64])))
        texts = ["".join(rng.choice("abcd 𝄞") for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(4)]
        texts.append("d" * 505 + pattern[: len(pattern) // 2] + "d" + pattern[len(pattern) // 2 :] + "d" * 700)  # across two pieces
        most = rng.choice([0, 1, 2])
        want = [d if (d := edits(pattern, t)) <= most else -1 for t in texts]
        assert substring_edits(pattern, texts, most).tolist() == want


def test_grams_lose_no_typo(spark):
    """Every text with a typo within the limit is found, within words and across them."""
    rng = random.Random(5)
    terms = ["abcd", "abab", "banana", "seashell", "mississippi"]
    texts = []
    for _ in range(300):
        t = list(rng.choice(terms))
        for _ in range(rng.choice([1, 1, 2])):
            at, kind = rng.randrange(len(t)), rng.randrange(4)
            if kind == 0:
                t[at] = rng.choice("xyz -")
            elif kind == 1:
                t.insert(at, rng.choice("xyz -"))
            elif kind == 2 and len(t) > 1:
                t.pop(at)
            elif at + 1 < len(t):
                t[at], t[at + 1] = t[at + 1], t[at]
        texts.append(f"qq{''.join(t)}ww " * rng.choice([1, 3]))
    index = grams(spark, texts)
    for term in terms:
        want = {k: d for k, t in enumerate(texts) if (d := edits(term, t)) <= P.edits_of(term)}
        assert {k: n for k, (_, n) in found(index.search(term, most=None, budget=None)).items()} == want


def test_the_shared_budget_is_told(spark):
    index = grams(spark, ["seashelk " * 4] * 6 + ["seashell"])
    all_ = index.search("seashell", budget=1000).collect()
    assert len(all_) == 7 and not any(r.incomplete for r in all_)
    few = index.search("seashell", budget=100).collect()
    assert {r.kind for r in few} == {"exact", "fuzzy"} and len(few) == 3 and all(r.incomplete for r in few)
    assert [r.kind for r in index.search("seashell", most=1, budget=100).collect()] == ["exact"]


def test_stored_text_is_searched_in_its_normal_form(spark):
    texts = ["Straße nach Bonn", "ＡＢＣ price", "ﬁnal report", "café au lait", "Ёлка и ель", "plain ABC price", "İstanbul", "ΟΔΟΣ", "x² ½"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    assert [r[0] for r in rows.orderBy("k").select(folded(F.col("text"))).collect()] == [normal(t) for t in texts]
    index = P.WordIndex(Store(spark, scratch(spark, "normal")), ["k"]).build(rows)
    for query, want in (("straße", {0}), ("STRASSE", {0}), ("ABC price", {1, 5}), ("ﬁnal", {2}), ("final", {2}), ("café", {3}), ("café", {3}), ("елка", {4}), ("οδος", {7}), ("x2", {8})):
        assert {r.k for r in R.bm25(rows, query).collect()} == want, query
        assert {r.k for r in index.bm25(query).collect()} == want, query
        assert {r.k for r in R.phrase(rows, query).collect()} == want, query


def test_texts_that_count_as_stable_are(spark):
    import re

    inside = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and re.match(STABLE.replace("\\u", "\\u"), chr(c))]
    assert len(inside) > 500
    rows = spark.createDataFrame([(x + "a" + x,) for x in inside], "text string")
    assert all(r.f == normal(r.text) for r in rows.select("text", F.translate(F.lower("text"), "ё", "е").alias("f")).collect())


def test_streams_of_revisions_and_bursts_resume(spark, tmp_path):
    """Events in several files and two runs, against one pass over all of them."""
    from palimpsest.streaming import keyed

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id").limit(240)
    rows = events.collect()
    source, schema = f"{tmp_path}/source", events.schema
    write = lambda a, b: spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(source)
    held, want = {}, {}
    for r in rows:
        when, gone = held.get(r.user_id, (None, False))
        fate = "rejected" if gone else "accepted" if when is None or r.ts > when else "repeated" if r.ts == when else "late"
        if fate == "accepted":
            held[r.user_id] = (r.ts, r.event_type == "error")
        want[r.event_id] = fate
    write(0, 80)
    keyed.fates(spark, source, schema, f"file://{tmp_path}/fates")
    write(80, 160)
    write(160, 240)
    found = keyed.fates(spark, source, schema, f"file://{tmp_path}/fates")
    assert {r.arrival: r.fate for r in found.collect()} == want
    hour = 3_600_000
    once = keyed.bursts(spark, source, schema, f"file://{tmp_path}/once", hour, 10 * hour, files_per_batch=9)
    split = keyed.bursts(spark, source, schema, f"file://{tmp_path}/split", hour, 10 * hour, delay="40 days")
    # a late watermark closes bursts by later changes alone; the timers only add the last ones
    assert {tuple(r) for r in split.collect()} <= {tuple(r) for r in once.collect()}
    assert sum(r.n for r in once.collect()) <= len(rows)


def test_publication_is_fenced(spark, tmp_path):
    from palimpsest.operators import publish as B

    targets, chunks = Store(spark, f"file://{tmp_path}/t"), PartitionedStore(spark, f"file://{tmp_path}/c", ["chat_id", "day"])
    aims = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1)], "chat_id long, day string, target_generation int")
    targets.publish(aims)
    chunks.publish(spark.createDataFrame([], "chat_id long, day string, text string, generation int"))
    made = lambda due: due.withColumn("text", F.lit("x"))

    def racing(due):
        # another builder publishes chat 3 in the next generation, and chat 2 changes
        targets.publish(spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 2)], aims.schema))
        if chunks.at().number == 0:
            chunks.replace(spark.createDataFrame([(3, "b", "y", 2)], "chat_id long, day string, text string, generation int"), [(3, "b")], chunks.at())
        return made(due)

    state = {(r.chat_id, r.generation): r.state for r in B.build(targets, chunks, racing).collect()}
    assert state == {(1, 1): "published", (2, 1): "superseded", (3, 1): "superseded"}
    assert sorted((r.chat_id, r.text, r.generation) for r in chunks.read().collect()) == [(1, "x", 1), (3, "y", 2)]
    assert [tuple(r) for r in chunks.told().select("chat_id", "generation").collect()] == [(1, 1)]
    again = {(r.chat_id, r.generation): r.state for r in B.build(targets, chunks, made).collect()}
    assert again == {(2, 2): "published"} and B.build(targets, chunks, made).count() == 0


def test_publication_keeps_other_segments_of_a_folder(spark, tmp_path):
    from palimpsest.operators import publish as B

    targets, chunks = Store(spark, f"file://{tmp_path}/t"), PartitionedStore(spark, f"file://{tmp_path}/c", ["chat_id", "day"], 2)
    held = [(k, "a", "old", 1) for k in range(9)]
    chunks.publish(spark.createDataFrame(held, "chat_id long, day string, text string, generation int"))
    targets.publish(spark.createDataFrame([(k, "a", 2 if k < 3 else 1) for k in range(9)], "chat_id long, day string, target_generation int"))
    state = {r.chat_id: r.state for r in B.build(targets, chunks, lambda due: due.withColumn("text", F.lit("new"))).collect()}
    assert state == dict.fromkeys(range(3), "published")
    assert sorted((r.chat_id, r.text) for r in chunks.read().collect()) == [(k, "new" if k < 3 else "old") for k in range(9)]


def test_pinned_search_of_an_empty_scope(spark, tmp_path):
    from palimpsest.operators import publish as B

    store = Store(spark, f"file://{tmp_path}/t")
    store.publish(spark.range(5))
    found = B.pinned_search({"t": store}, lambda f: f["t"].where("id > 9"), lambda f, rows: rows)
    assert (found.scope, found.rows.count(), found.changed, found.revisions) == (0, 0, [], {"t": 0})
    found = B.pinned_search({"t": store}, lambda f: f["t"], lambda f, rows: (store.publish(spark.range(9)), rows)[1])
    assert (found.scope, found.rows.count(), found.changed) == (5, 5, ["t"])


def test_bursts_cost_few_state_calls():
    """What a key costs is its state calls: three for a new one, and no timer is set anew that stays as it is."""
    from pyspark.sql import Row

    from palimpsest.streaming import keyed

    calls, held = [], [None]

    class Value:
        def get(self):
            calls.append("get")
            return held[0]

        def update(self, value):
            calls.append("update")
            held[0] = value

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            calls.append(("set", at))

        def deleteTimer(self, at):
            calls.append(("unset", at))

    bursts = keyed.Bursts(1000, 1500)
    bursts.init(Handle())
    assert list(bursts.handleInputRows((7,), iter([Row(at=900_001), Row(at=1)]), None)) == []
    assert calls == ["get", "update", ("set", 1501)] and held[0] == (1, 900_001, 2)
    calls.clear()
    found = list(bursts.handleInputRows((7,), iter([Row(at=1_000_000)]), None))
    assert (found, calls) == ([], ["get", "update"])
    calls.clear()
    assert [tuple(r) for r in bursts.handleInputRows((7,), iter([Row(at=9_000_000)]), None)] == [(7, 1, 1_500_001, 3)]
    assert calls == ["get", "update", ("unset", 1501), ("set", 10_000)]
