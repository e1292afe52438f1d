"""Source divergence, collocations and near-duplicate vectors against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from palimpsest.llm import vector_join
from palimpsest.llm.collocations import collocations
from palimpsest.llm.divergence import source_divergence
from palimpsest.llm.substring_dedup import repeated_passages
from palimpsest.llm.vector_join import near_vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(n, seed, words=40):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "B", "b", "É", "é", "O'Neil", "x-y", "…", "数据", "_", "3rd"] + [f"w{i}" for i in range(words)]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(vocabulary, rng.integers(0, 60), p=weights / weights.sum()))
        text = re.sub(" ", lambda m: rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "! "]), text)
        rows.append((k, text, (None, "", "en", "fr", "und")[rng.integers(5)], (None, "", "s1", "s2", "S2", "ß")[rng.integers(6)], None))
    rows += [(None, None, "en", "s1", None), (None, None, None, None, None), (3, "", "lonely", "s9", None), (3, "", "lonely", "s8", None), (5, "one two\x0bthree", "odd", None, None)]
    return rows + rows[:7]


def divergence(rows, least=3, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    docs, said, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(terms(text)))
        said[lang, source].update(terms(text))
    out = []
    kept = {x: sorted(t for t, n in docs[x].items() if n >= least) for x in {g[0] for g in groups}}

    def p(counts, lang):
        v, n = len(kept[lang]), sum(counts[t] for t in kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 1) // (n + v) for t in kept[lang]}

    for lang, source in groups:
        whole = sum((c for (x, _), c in said.items() if x == lang), Counter())
        own, q = p(said[lang, source], lang), p(whole, lang)
        pairs = []
        for other, name in groups:
            if other == lang and name != source:
                theirs = p(said[lang, name], lang)
                pairs.append((name, sum((own[t] - theirs[t]) ** 2 // theirs[t] for t in kept[lang])))
        found = [(t, (own[t] - q[t]) ** 2 // q[t]) for t in kept[lang] if said[lang, source][t] and own[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", found, top)):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [1, 3, 200])
def test_divergence_is_that_of_brute_force(spark, top, monkeypatch):
    rows = corpus(160, 3)
    given = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], SCHEMA + ", item string, value double, `group` int").repartition(5)
    found = source_divergence(given, top=top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == divergence(rows, top=top)


def test_divergence_over_many_shards(spark, monkeypatch):
    """A language that holds most rows, a term in every one, more terms than are asked for."""
    rows = [(k, f"the t{k % 300} t{k % 7} t{k % 300}", "en", f"s{k % 3}" if k % 2 else "hot", None) for k in range(1500)] + [(k, "le la les", "fr", "hot", None) for k in range(9)]
    found = source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(8), top=20)
    assert sorted(tuple(r) for r in found.collect()) == divergence(rows, top=20)


def phrases(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, _, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts[lang][words[i : i + n]] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        gone = {q for p, a in often.items() for n in range(2, len(p)) for i in range(len(p) - n + 1) if (q := p[i : i + n]) in often and a >= often[q]}
        found = []
        for p, a in often.items():
            if p not in gone:
                score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, top", [(2, 2000), (5, 7), (300, 10)])
def test_collocations_are_those_of_brute_force(spark, least, top):
    """least may pass what a shard's table of pairs counts to."""
    rows = corpus(200, 9, words=6) + [(k, "new york city. New York City new york", "en", "s", None) for k in range(310)]
    given = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA + ", rank int, phrase string, n int").repartition(6)
    found = collocations(given, least=least, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == phrases(rows, least, top)


def test_collocations_of_one_very_long_text(spark):
    """More words than a shard holds in one row; a phrase across pieces is none."""
    text = "b a c, " * 40 + "a b " * 1_200_000
    rows = [(1, text, None, None, None), (2, "a. b" * 50, None, None, None)]
    found = {r.phrase: (r.a, r.n) for r in collocations(spark.createDataFrame(rows, SCHEMA), least=30).collect()}
    total = len(re.findall(r"[^ ,.]+", text)) + len(re.findall(r"[^ .]+", rows[1][1]))
    assert found["b a c"] == (40, total)
    assert found["a b a b a"] == found["b a b a b"] == (1_199_998, total)


def nearest(rows, least=0.9):
    fine = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, label = np.zeros(len(rows), int), list(range(len(rows)))
    joined = []
    for n, i in enumerate(fine):
        for j in fine[n + 1 :]:
            a, b = (np.array(rows[k][1], float) for k in (i, j))
            if len(a) == len(b):
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[[i, j]] += 1
                    joined.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in joined:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    ids = defaultdict(list)
    for k, x in enumerate(label):
        if rows[k][0] is not None:
            ids[x].append(rows[k][0])
    return Counter((r[0], int(n), min(ids[x], default=None), r[0] is not None and r[0] == min(ids[x], default=None)) for r, n, x in zip(rows, links, label, strict=True))


def vectors(seed, n=260, length=24):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, length))
    made = []
    for k in range(n):
        kind = k % 5
        v = rng.standard_normal(length) if kind < 2 else centre[k % 6] + rng.standard_normal(length) * (0.1, 0.35, 0.6)[kind - 2]
        made.append((int(rng.integers(0, n)), (v * 10.0 ** rng.integers(-3, 4)).tolist()))
    made += [(x, made[10][1]) for x in (500, 501, None, None)] + [(600, None), (601, []), (602, [0.0] * length), (603, [1.0, None] * (length // 2)), (604, [float("nan")] * length), (605, [float("inf")] * length)]
    made += [(700, [1.0, 2.0]), (701, [2.0, 4.0]), (702, [-1.0, -2.0]), (703, [3.0]), (None, [5.0]), (704, [1e300] * length), (705, [1e-300] * length), (706, [-1e300] * length)]
    return made


@pytest.mark.parametrize("leaf_rows", [None, 24])
def test_vectors_are_linked_as_by_brute_force(spark, leaf_rows, monkeypatch):
    """In one tile, and in many."""
    if leaf_rows:
        monkeypatch.setattr(vector_join, "TILE_BYTES", leaf_rows * 24 * 8)
        monkeypatch.setattr(vector_join, "LEAF", leaf_rows)
    rows = vectors(1)
    given = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<double>, node int, links string").repartition(5)
    found = near_vectors(given)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(tuple(r) for r in found.collect()) == nearest(rows)


def test_vectors_far_apart_are_never_compared(spark, monkeypatch):
    """Tiles of vectors in distant directions are told apart by their bounds, and no link is lost."""
    monkeypatch.setattr(vector_join, "TILE_BYTES", 64 * 8 * 8)
    monkeypatch.setattr(vector_join, "LEAF", 64)
    rng = np.random.default_rng(2)
    rows = [(k, (np.eye(8)[k % 8] * 5 + rng.standard_normal(8) * 0.3).tolist()) for k in range(640)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    plain = vector_join.near_tiles
    monkeypatch.setattr(vector_join, "near_tiles", lambda tiles, n, eps: seen.append((n, found := plain(tiles, n, eps))) or found)
    assert Counter(tuple(r) for r in near_vectors(given).collect()) == nearest(rows)
    n, pairs = seen[0]
    assert n == 10 and pairs.count() < n * (n + 1) / 2


@pytest.mark.parametrize("name", ["11", "12", "13"])
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    run = {"11": lambda: source_divergence(docs), "12": lambda: collocations(docs), "13": lambda: near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))}
    assert run[name]().count() == 0


@pytest.mark.parametrize("length", [50, 400])
def test_repeated_passages_of_other_lengths(spark, length):
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice(list("abcdefgh"), 900))
    rows = [(1, "start " + passage + " end"), (2, passage + "tail"), (3, "x" + passage[:length]), (4, passage[: length - 1])]
    seen, want = set(), {}
    for k, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        want[k] = int(gone.sum())
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()
    assert {r.doc_id: r.n_removed for r in found} == want and want[2] == 900
