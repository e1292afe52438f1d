"""Stages of the corpus pipeline against brute force, on null and repeated ids."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def given():
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9000, n))
    clean, copied, item, other = [say(80) for _ in range(8)], say(80), say(40), say(80)
    near = copied.rsplit(" ", 1)[0] + " changed"
    rows = [(None, copied), (None, copied), (4, copied), (4, clean[0]), (4, clean[1]), (4, near), (2, clean[2]), (2, clean[2]), (None, clean[3]), (None, clean[4])]
    rows += [(None, item), (None, f"{say(20)} {item}"), (7, f"{item} {say(10)}"), (7, clean[5]), (8, None), (8, None), (None, ""), (9, clean[6]), (None, clean[6]), (3, other), (3, near), (None, other), (2**63 - 1, clean[7])]
    return [(i, t, "en", f"src{k}", None) for k, (i, t) in enumerate(rows)], [(1, item)]


def place(row):
    return (row[0] is None, row[0] or 0, row[1] or "")


def test_near_dedup_of_null_and_repeated_ids(spark, given):
    def shingles(text):
        w = (text or "").split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    rows = sorted(given[0], key=place)
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    expected = Counter((rows[k][0], rows[k][1]) for k in set(label))
    found = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), "")
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, r.text) for r in found.collect()) == expected


def test_decontamination_of_null_and_repeated_ids(spark, given, tmp_path):
    rows, items = given
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path))
    assert Counter(map(tuple, found.collect())) == Counter(r for r in rows if items[0][1] not in (r[1] or ""))


def test_pipeline_of_null_and_repeated_ids(spark, given, tmp_path):
    """All stages run over such rows; what comes out went in and was not contaminated."""
    rows, items = given
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found <= {r[0] for r in rows}


#: Names that stages and operators use for what they add, and names of their helpers.
CLASHING = ("score", "lang_pred", "held_out", "domain", "tokens", "copies", "leaf_budget", "_copy", "row", "given", "given_3", "kept", "component_id", "contaminated", "n_shingles", "a.b")


def widened(spark, rows):
    schema = ", ".join([SCHEMA, *(f"`{c}` string" for c in CLASHING)])
    return spark.createDataFrame([(*r, *(f"{c} of {k}" for c in CLASHING)) for k, r in enumerate(rows)], schema)


def speech(n):
    rng = np.random.default_rng(n)
    return {lang: [" ".join(rng.choice(words.split(), 40)) for _ in range(n)] for lang, words in (("en", "the of and house street water which when there people"), ("de", "der die und Straße Wasser welche wenn dort Leute nicht"))}


def test_language_keeps_values_of_all_columns(spark):
    said = speech(30)
    rows = [(k, t, lang, "src", None) for k, (lang, t) in enumerate((x, t) for x, texts in said.items() for t in texts)]
    odd = [(1000, None, "en", "src", 1), (1001, "", "en", "src", 1), (1002, " 42 ... ", "de", None, 1), (None, said["en"][0], None, None, None), (5, said["de"][1], "de", "src", 2)]
    given = widened(spark, rows + odd)
    found = corpus_pipeline.language(spark, given, "")
    assert found.columns == given.columns
    # what has no letter goes, all else stays with all of its values
    want = Counter(tuple(r) for r in given.collect() if r.text and any(map(str.isalpha, r.text)))
    assert Counter(map(tuple, found.collect())) == want


def test_mix_keeps_values_and_repeats_what_is_taken_twice(spark):
    rows = [(k, "w " * 10, "en", "src1", None) for k in range(4)] + [(10 + k, "w " * 10, "fr", "src1", None) for k in range(12)] + [(None, None, None, None, None)]
    given = widened(spark, rows)
    found = corpus_pipeline.mix(spark, given, "")
    assert found.columns == given.columns
    got, known = Counter(map(tuple, found.collect())), {tuple(r) for r in given.collect()}
    assert set(got) <= known
    # two thirds of the weight want more than two epochs of the little English: it is taken twice, what is short goes to the rest
    assert all(n == 2 for r, n in got.items() if r[2] == "en") and sum(1 for r in got if r[2] == "en") == 4
    assert sum(n for r, n in got.items() if r[2] == "fr") == 8


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table_and_on_clashing_names(spark, name, stage, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    said = speech(3)
    rows = [(k, t, lang, "src1", None) for k, (lang, t) in enumerate((x, t) for x, texts in said.items() for t in texts)]
    given = widened(spark, rows)
    assert stage(spark, given.limit(0), str(tmp_path)).count() == 0
    found = stage(spark, given, str(tmp_path))
    if name == "token-ID output":
        assert [r.doc_id for r in found.orderBy("start").collect()] == list(range(6))
        return
    assert found.columns == given.columns
    assert {tuple(r) for r in found.collect()} <= {tuple(r) for r in given.collect()}
    assert found.count() > 0


def test_tokens_stage_counts_what_is_written(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(3, "Good morning, team!", "en", "s", 1), (1, None, None, None, None), (None, "first of all", "en", "s", 1), (3, "A text before it", "en", "s", 1)]
    found = corpus_pipeline.tokens(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").orderBy("start").collect()
    want = [(None, "first of all"), (1, ""), (3, "A text before it"), (3, "Good morning, team!")]
    assert [(r.doc_id, r.n_tokens) for r in found] == [(i, len(own.encode(t, add_special_tokens=False).ids) + 1) for i, t in want]
