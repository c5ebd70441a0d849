import random
import re
import time

import pyarrow as pa
import pytest

from inkstone.functions import lines, reflow
from plain_reflow import collapse, is_heading, is_metadata, reflow as plain
from test_reflow import random_text


def test_reflow_keeps_texts_in_their_tasks(spark):
    plan = reflow.reflow_texts(spark.createDataFrame([(1, "a\nb")], "k int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_reflow_takes_less_time_than_the_plain_rules(spark):
    r = random.Random(3)
    line = lambda: "".join(r.choice("他走進了房間看見桌上，。 ") for _ in range(40))
    texts = ["\n".join(line() for _ in range(600)) for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    reflow.reflow_texts(df.limit(1)).collect()
    began = time.time()
    got = [row.text for row in reflow.reflow_texts(df).collect()]
    took, began = time.time() - began, time.time()
    assert got == [plain(t) for t in texts]
    assert took < time.time() - began


@pytest.mark.parametrize("size", [1, 30, 100])
@pytest.mark.parametrize("headers", [False, True])
def test_texts_in_pieces(monkeypatch, size, headers):
    monkeypatch.setattr(reflow, "PIECE_BYTES", size)
    r = random.Random(size)
    texts = [random_text(r) for _ in range(150)] + ["", None, "\r\n", "甲\r\n\r\n", " \x01\n"]
    assert reflow._texts(pa.array(texts), headers, "\n").to_pylist() == [None if t is None else plain(t, headers, True) for t in texts]
    sliced = pa.array(["x", *texts])[1:]
    assert reflow._texts(sliced, headers, "\n").to_pylist()[:3] == [plain(t, headers, True) for t in texts[:3]]


@pytest.mark.parametrize(("size", "rows"), [(1 << 18, 3), (1 << 18, 1000), (50, 40), (1, 1)])
def test_lines_in_batches(monkeypatch, size, rows):
    monkeypatch.setattr(reflow, "PIECE_BYTES", size)
    r = random.Random(rows)
    texts = [random_text(r) for _ in range(80)]
    cut = [(d, line) for d, text in enumerate(texts) for line in re.split("\r\n|\r|\n", text)]
    batches = [pa.RecordBatch.from_pylist([{"doc": d, "raw": t} for d, t in cut[k : k + rows]]) for k in range(0, len(cut), rows)]
    found = [p for b in reflow._paragraphs(iter(batches), False) for p in b.to_pylist()]
    for d, text in enumerate(texts):
        own = [p for p in found if p["doc"] == d]
        assert [p["paragraph"] for p in own] == list(range(len(own)))
        assert "\n".join(p["text"] for p in own) == plain(text, compact=True)


def test_a_piece_ends_at_a_line_end(monkeypatch):
    for size in range(1, 9):
        monkeypatch.setattr(reflow, "PIECE_BYTES", size)
        for text in ("ab\r\ncd\r\nef", "a\r\r\n\nb\n", "\r\n", "abcdef"):
            pieces = [bytes(p).decode() for p in reflow._pieces(memoryview(text.encode()))]
            assert [x for p in pieces for x in re.split("\r\n|\r|\n", p)] == re.split("\r\n|\r|\n", text)


def test_lines_by_themselves_against_the_plain_rules():
    r = random.Random(9)
    for line in (x for _ in range(400) for x in re.split("[\r\n]+", random_text(r))):
        made = collapse(line)
        assert (lines.collapse(line), lines.is_heading(made), lines.is_metadata(made)) == (made, is_heading(made), is_metadata(made))


def test_next_line_is_no_end():
    """U+0085 is a character as others are, as in the reference; a dollar sign of Java patterns matches before it."""
    assert lines.collapse("漢字" * 6 + "\x85") == "漢字" * 6 + "\x85"
    assert reflow._texts(pa.array(["甲乙丙丁，戊己庚\n漢字\x85"]), False, "\n").to_pylist() == [plain("甲乙丙丁，戊己庚\n漢字\x85", compact=True)]
