"""Word errors, reading order, pooling and live pages against plain models and fixed vectors."""

from __future__ import annotations

import json
import random
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException

from palimpsest.operators import encode as E
from palimpsest.operators import media as M
from palimpsest.sources import live as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_errors_are_those_of_the_whole_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 7, 30]))] for _ in range(2))
        assert E.word_errors(a, b) == distance(a, b)
    a = [str(rng.randrange(50)) for _ in range(400)]
    b = ["x"] * 40 + [w for i, w in enumerate(a) if i % 9] + ["y"]
    assert E.word_errors(a, b) == distance(a, b)


def test_word_errors_of_long_texts_take_rounds_by_errors():
    """A band that is doubled and filled row by row took a second and more for a text of these."""
    rng = random.Random(9)
    said = [str(rng.randrange(3000)) for _ in range(20_000)]
    heard = ["" if i % 101 == 3 else w for i, w in enumerate(said, 1) if i % 127 != 5]
    wrong = sum(i % 101 == 3 or i % 127 == 5 for i in range(1, 20_001))
    began = time.process_time()
    assert [E.word_errors(said, heard) for _ in range(5)] == [wrong] * 5
    assert time.process_time() - began < 5


def test_words_of_a_batch_by_number(spark):
    """Nulls, words that truth lacks and lists without words, many rows in a batch."""
    rng = random.Random(4)
    rows = [tuple([rng.choice(["a", "b", "1", None, "ж"]) for _ in range(rng.choice([0, 1, 5, 40]))] for _ in range(2)) for _ in range(200)]
    pairs = spark.createDataFrame(rows, "truth array<string>, said array<string>").coalesce(1)
    assert [r.n for r in pairs.select(E.word_error_count("truth", "said").alias("n")).collect()] == [distance(a, b) for a, b in rows]


def test_recognition_by_group(spark):
    rows = [("a", ["x", "1", "1", "2"], ["x", "1", "z"]), ("a", ["y"], None), ("b", [], []), ("c", None, ["q"])]
    found = {r.g: (r.words, r.errors, r.wer, r.controls, r.recall) for r in E.recognition(spark.createDataFrame(rows, "g string, truth array<string>, said array<string>"), "g", "[0-9]").collect()}
    assert found == {"a": (5, 3, 0.6, 3, 0.333333), "b": (0, 0, None, 0, None), "c": (0, 1, None, 0, None)}


def test_boxes_are_read_by_lines(spark):
    rows = [(1, 1, 50, 0, 60, 10), (1, 2, 0, 8, 40, 18), (1, 3, 20, 17, 30, 25), (1, 4, 0, 25, 9, 30), (1, 5, 0, 25, 9, 30), (2, 1, 0, 0, 1, 1)]
    found = M.reading_order(spark.createDataFrame(rows, "page int, box int, x0 int, y0 int, x1 int, y1 int")).collect()
    # the second box overlaps the first and the third: all are one line
    assert {(r.page, r.box): (r.line, r.place) for r in found} == {(1, 2): (1, 1), (1, 3): (1, 2), (1, 1): (1, 3), (1, 4): (2, 1), (1, 5): (2, 2), (2, 1): (1, 1)}


def test_pooling_and_probabilities():
    states = np.arange(24, dtype=float).reshape(2, 4, 3)
    assert np.allclose(E.first_pooled(states), E.unit(states[:, 0]))
    with np.errstate(over="raise"):
        assert np.allclose(E.sigmoid(np.array([-1000.0, 0.0, 1000.0])), [0, 0.5, 1])


def page(cursor, upper, *messages):
    return json.dumps({"peer": {"kind": "channel", "id": 7}, "cursor": cursor, "upper": upper, "messages": list(messages)})


def test_live_messages_in_the_archives_terms(spark):
    one = {"id": 5, "date": 100, "from": {"kind": "user", "id": 3}, "forward": {"peer": {"kind": "channel", "id": 9}}, "text": "hi", "entities": [{"type": "Bold", "offset": 0, "length": 2}, {"type": "New", "offset": 1, "length": 1}], "media": {"kind": "photo", "id": 11, "access_hash": 1}}
    two = {"id": 6, "date": 101, "edited": 110, "forward": {"name": "Someone"}, "media": {"kind": "photo", "id": 11, "access_hash": 2}}
    rows = L.normalised(spark.createDataFrame([(page(4, 9, one, two),), (page(0, 9),)], "page string")).orderBy("message_id").collect()
    assert [(r.peer_kind, r.peer_id, r.message_id, r.sent, r.edited, r.sender, r.forwarded_from, r.text) for r in rows] == [("channel", 7, 5, 100, None, "user:3", "channel:9", "hi"), ("channel", 7, 6, 101, 110, None, "Someone", "")]
    assert [(e.type, e.start, e.length) for e in rows[0].entities] == [("bold", 0, 2), ("New", 1, 1)] and rows[1].entities == []
    assert rows[0].media_id == rows[1].media_id is not None


@pytest.mark.parametrize("messages", [({"id": 6}, {"id": 5}), ({"id": 5}, {"id": 5}), ({"id": 10},), ({"id": -30},), ({"date": 1},)])
def test_pages_that_are_not_to_be_trusted(spark, messages):
    with pytest.raises(PySparkException):
        L.normalised(spark.createDataFrame([(page(4, 9, *messages),)], "page string")).collect()


def test_live_pages_go_on_where_they_ended(spark, tmp_path):
    """Pages that overlap, and a second run with an edit and a page it has seen."""
    said = lambda i, **more: {"id": i, "date": i, "text": f"t{i}"} | more
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "a.json").write_text(page(0, 30, *map(said, range(1, 31))))
    (folder / "b.json").write_text(page(30, 60, *map(said, range(11, 41))))
    first = L.received(spark, f"file://{folder}", f"file://{tmp_path}/state")
    assert sorted(r.message_id for r in first.collect()) == list(range(1, 41))
    (folder / "c.json").write_text(page(40, 60, *map(said, range(21, 45)), said(46, edited=99)))
    again = L.received(spark, f"file://{folder}", f"file://{tmp_path}/state").collect()
    assert sorted(r.message_id for r in again) == [*range(1, 45), 46]


def test_pages_in_lines_of_few_files(spark, tmp_path):
    """Many pages in a file: they are taken in as pages in files of their own are."""
    said = lambda i, **more: {"id": i, "date": i, "text": f"t{i}\n\u2028"} | more
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(page(30 * k, 30 * k + 30, *map(said, range(max(1, 30 * k - 10), 30 * k + 31))) for k in range(5)) + "\n")
    found = L.received(spark, f"file://{folder}", f"file://{tmp_path}/state", lines=True).collect()
    assert sorted(r.message_id for r in found) == list(range(1, 151)) and found[0].text.endswith("\n\u2028")
