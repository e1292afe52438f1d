"""Token offsets, windows and policies of chunks against plain models."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chunking as C
from palimpsest.operators.tokens import Offsets, counted, pair_truncated, shared_budget
from palimpsest.sources.views import messages
from tests.test_archive import SMALL, made

WORDS = ["a", "bb", "c.", "dd!", "e\n\n", "f"]


def text_of(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "\n\n"]) for _ in range(n))


def test_offsets_count_and_cut_as_splitting_does():
    rng = random.Random(1)
    for _ in range(60):
        t = text_of(rng, rng.randrange(12))
        own = Offsets(t)
        for a in range(len(t) + 1):
            for b in range(a, len(t) + 1):
                assert own.count(a, b) == len(t[a:b].split())
            for k in range(4):
                assert own.reach(a, k) == max(x for x in range(a, len(t) + 1) if len(t[a:x].split()) <= k)
                assert own.back(a, k) == min(x for x in range(a + 1) if len(t[x:a].split()) <= k)
    assert counted(["a b", None, "", "a b"]) == [2, 0, 0, 2]


def test_slices_cover_fit_and_overlap():
    rng = random.Random(2)
    for _ in range(200):
        t = text_of(rng, rng.randrange(1, 60))
        own, budget, overlap = Offsets(t), rng.randrange(1, 9), rng.randrange(3)
        parts = own.slices(budget, overlap)
        assert parts[0][0] == 0 and parts[-1][1] == len(t)
        assert all(own.count(a, b) <= budget for a, b in parts)
        for (a, b), (c, d) in zip(parts, parts[1:], strict=False):
            assert a < c <= b < d and (own.count(c, b) <= overlap if overlap else c == b)
        if not overlap:
            assert "".join(t[a:b] for a, b in parts) == t
    first = Offsets("one two. three four five\n\nsix seven eight nine ten").slices(8, 0)
    assert first[0] == (0, 26)  # behind the paragraph, which is in the second half
    with pytest.raises(ValueError):
        Offsets("x").slices(0)


def test_pairs_share_a_budget():
    def one_by_one(a, b, budget):
        while a + b > budget:
            a, b = (a - 1, b) if a > b else (a, b - 1)
        return a, b

    for a in range(9):
        for b in range(9):
            for n in range(18):
                assert shared_budget(a, b, n) == one_by_one(a, b, n)
    assert pair_truncated(Offsets("a b c d"), Offsets("x  y"), 4) == ("a b", "x  y")
    assert pair_truncated(Offsets("a b"), Offsets(""), 0) == ("", "")


def rows_of(rng, n):
    out, t = [], 0
    for i in range(n):
        t += rng.choice([1, 30, 100])
        role = rng.choice(["core", "core", "core", "support", "filler"])
        text = " ".join("w" for _ in range(rng.choice([1, 1, 2, 5, 40])))
        out.append(C.Row(i, t, rng.choice(["x", "y", None]), rng.choice(["Ann", "Bo Li"]), text, 0, rng.choice([None, None, 0]), [role], [role == "core" and len(text) > 1], [role != "filler"], (), Offsets(text)))
    return out


def naive(rows, policy, prefix):
    """Windows entry by entry, each rendered and counted anew."""

    def tokens(some):
        n, last = prefix, None
        for r in some:
            if r.includes[0]:
                same = last is not None and last.author_id is not None and last.author_id == r.author_id and r.timestamp - last.timestamp <= policy.turn_seconds and r.reply is None
                n += len(r.text.split()) + (0 if same else len(f"{r.author}:".split()))
                last = r
        return n

    fits = lambda some: tokens(some) <= policy.max_tokens and sum(r.counts[0] for r in some) <= policy.max_messages and len(some) <= policy.max_source_messages
    found, window, fresh = [], [], False
    for r in rows:
        if r.includes[0] and tokens([r]) > policy.max_tokens:
            if fresh:
                found.append([x.message_id for x in window])
            found.append([r.message_id])
            window, fresh = [], False
            continue
        if window and not fits([*window, r]):
            if fresh:
                found.append([x.message_id for x in window])
            kept = []
            for x in reversed(window):
                if not policy.overlap_messages or (x.counts[0] and sum(y.counts[0] for y in kept) == policy.overlap_messages) or len(kept) == policy.max_source_messages // 2:
                    break
                kept.insert(0, x)
            while kept and not (tokens([*kept, r]) <= policy.max_tokens and sum(y.counts[0] for y in [*kept, r]) <= policy.max_messages):
                kept.pop(0)
            window, fresh = kept, False
        window.append(r)
        fresh = True
    if fresh:
        found.append([x.message_id for x in window])
    return found


def test_windows_by_prefix_sums_are_those_of_a_greedy_pass(monkeypatch):
    rng = random.Random(4)
    for trial in range(150):
        policy = C.ChunkPolicy(max_messages=rng.choice([1, 2, 4, 8]), overlap_messages=0, max_source_messages=rng.choice([8, 12, 32]), max_tokens=rng.choice([32, 40, 60]))
        policy = C.ChunkPolicy(**(vars(policy) | {"overlap_messages": rng.randrange(policy.max_messages)}))
        rows = rows_of(rng, rng.choice([0, 1, 7, 60]))
        monkeypatch.setattr(C, "HELD", rng.choice([5, 40, 4096]))
        day = C.Day(0, policy, C.Costs(C.runs, "passage: ", policy.max_tokens))
        got = []
        for kept in (x for r in rows for x in day.add(r, False)):
            got.append(kept)
        got += day.take(True)
        want = naive(rows, policy, 1)
        merged = []
        for w in got:
            ids = [x.message_id for x in w.sources]
            if not (merged and len(ids) == 1 and merged[-1] == ids and w.sources[0].start > 0):
                merged.append(ids)
            assert w.tokens <= policy.max_tokens
            assert w.tokens == 1 + len(w.text.split())
        # windows of support alone are not published
        alone = {tuple(x) for x in want if not any(rows[i].roles[0] == "core" for i in x)}
        assert merged == [x for x in want if tuple(x) not in alone], trial


def test_first_policy_fixed_vector(spark):
    day = 1704067200
    rows = [(i, day + i * 60, "ann", f"m{i}", {}) for i in range(1, 11)]
    rows += [(11, day + 700, "bob", "", {"has_photo": 1}), (12, day + 701, "s", "joined", {"kind": "service"}), (13, day + 4200, "bob", "", {}), (14, day + 4290, "bob", "still here", {}), (15, day + 9000, "bob", " ".join(f"w{k}" for k in range(70)), {})]
    policy = C.ChunkPolicy(version=C.WINDOWS, max_messages=4, overlap_messages=2, max_tokens=32)
    found = sorted(C.chunks(made(spark, rows), policy).collect(), key=lambda c: c.ordinal)
    ids = [[p.message_id for p in c.parts] for c in found]
    # neither the service row nor the empty one moves the clock, so that 14 goes on from 11, 59 minutes before
    assert ids == [[1, 2, 3, 4], [3, 4, 5, 6], [5, 6, 7, 8], [7, 8, 9, 10], [9, 10, 11, 14], [15], [15], [15]]
    assert found[4].text == "ann: m9\nann: m10\nbob:  [photo]\nbob: still here"
    assert [c.n_tokens for c in found[5:]] == [32, 32, 12] and not any(c.dependencies for c in found)


def test_policies_are_what_they_do():
    base = C.ChunkPolicy()
    assert C.ChunkPolicy(omitted=("b", "a", "lol")).identity == C.ChunkPolicy(omitted=("a", "b", "a")).identity != base.identity
    assert C.ChunkPolicy(omitted=("a",), kept=("a",)).omitted == ()
    assert [p.version for p in (base, C.ChunkPolicy(omitted=("word",)), C.ChunkPolicy(kept=("two words",)), C.ChunkPolicy(version=C.WINDOWS))] == [C.EPISODES, C.WORDS, C.PHRASES, C.WINDOWS]
    for wrong in ({"version": "v9"}, {"max_tokens": 31}, {"overlap_messages": 8}, {"max_source_messages": 33}, {"context_tokens": 129}, {"omitted": ("Upper",)}, {"omitted": ("",)}, {"version": C.WINDOWS, "omitted": ("a",)}, {"omitted": tuple(map(str, range(10_001)))}):
        with pytest.raises(ValueError):
            C.ChunkPolicy(**wrong)


def test_what_is_left_out_is_not_borrowed_either(spark):
    day = 1704067200
    rows = [(1, day, "a", "zzyzx", {}), (2, day + 4000, "b", "да", {"reply_to": 1}), (3, day + 9000, "a", "why zzyzx?", {}), (4, day + 9010, "a", "zzyzx", {"reply_to": 3}), (5, day + 14000, "b", "да", {"reply_to": 4})]
    plain, filtered = C.ChunkPolicy(), C.ChunkPolicy(omitted=("zzyzx",))
    said = lambda p: [c.text for c in sorted(C.chunks(made(spark, rows), p).collect(), key=lambda c: c.ordinal)]
    assert "In reply to (a): zzyzx\nb: да" in said(plain)
    # an answer to a question stays, and may be borrowed; what is left out takes the answer to it along
    assert said(filtered) == ["a: why zzyzx?\na: zzyzx", "In reply to (a): zzyzx\nIn reply to (a): why zzyzx?\nb: да"]
    needs = [sorted((d.message_id, d.content_hash) for d in c.dependencies) for c in C.chunks(made(spark, rows), filtered).orderBy("ordinal").collect()]
    assert needs[-1] == [(3, "why z"), (4, "zzyzx")]


def test_policies_side_by_side_are_as_each_alone(spark):
    m = messages(spark, SMALL).withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    policies = [C.ChunkPolicy(), C.ChunkPolicy(version=C.WINDOWS), C.ChunkPolicy(omitted=("good morning team",), max_messages=3, overlap_messages=1)]
    both = C.built(m, policies).collect()
    for k, p in enumerate(policies):
        alone = {c.chunk_id for c in C.chunks(m, p).collect()}
        assert alone and alone == {c.chunk_id for c in both if c.policy == k}


def test_text_chunks_are_whole_or_absent(spark):
    texts = ["", None, "  \n", "one", " ".join("w" for _ in range(70)), "x" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    found = C.text_chunks(rows, "k", policy=C.ChunkPolicy(version=C.WINDOWS, max_tokens=32)).orderBy("k", "ordinal").collect()
    assert [(r.k, r.ordinal, r.start, r.end, r.n_tokens) for r in found] == [(3, 0, 0, 3, 2), (4, 0, 0, 62, 32), (4, 1, 62, 124, 32), (4, 2, 124, 139, 9), (5, 0, 0, 5000, 2)]
