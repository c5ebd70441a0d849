"""Repair of dialog quotes against a plain loop, and open marks of a text."""

import random

import pytest
from pyspark.sql import functions as F

from inkstone.functions import quotes
from inkstone.functions.reflow import open_bracket, open_quote
from plain_reflow import _Nesting, open_quote as plain_open_quote

CASES = {
    '"Hello"': "“Hello”", "'Hello'": "‘Hello’", '“Hello"': "“Hello”", "‘Hello'": "‘Hello’", '「Hello"': "「Hello」", "『Hello'": "『Hello』",
    "「你好」與『世界』": "「你好」與『世界』", "沒有引號。": "沒有引號。", "": "",
    "I'm reading O'Brien's book. don't rock'n'roll I’m rock‘n’roll": "I'm reading O'Brien's book. don't rock'n'roll I’m rock‘n’roll",
    "「He said 'hello'\"\n\"Next\"": "「He said ‘hello’」\n“Next”",
}


def plain(text, keep):
    due, out = {'"': "", "'": ""}, []
    pairs = {"“": "”", "「": "」", "‘": "’", "『": "』"}
    letter = lambda c: c.isascii() and c.isalpha()
    for k, c in enumerate(text):
        if c in "\"'“”「」‘’『』" and not (keep and c in "'‘’" and k and letter(text[k - 1]) and letter(text[k + 1 : k + 2])):
            level = '"' if c in '"“”「」' else "'"
            if c in due:
                c = due[c] or ("“" if c == '"' else "‘")
            due[level] = pairs.get(c, "")
        out.append(c)
    return "".join(out)


@pytest.mark.parametrize("run", [3, 256])
def test_repair(spark, monkeypatch, run):
    monkeypatch.setattr(quotes, "RUN", run)
    r = random.Random(run)
    texts = [*CASES, *("".join(r.choice("\"\"''“”「」‘’『』ab 漢\n") for _ in range(r.randrange(60))) for _ in range(400)), "\"'" * 900]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quotes.repair_quotes(F.col("t")).alias("kept"), quotes.repair_quotes(F.col("t"), False).alias("all"))
    for row in df.collect():
        assert (row.kept, row.all) == (plain(row.t, True), plain(row.t, False))
        assert row.t not in CASES or row.kept == CASES[row.t]


def test_open_marks(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("（）()[]【】“”「」『』﹁﹂‘’a漢") for _ in range(r.randrange(12))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", open_bracket(F.col("t")).alias("b"), open_quote(F.col("t")).alias("q"))
    for row in df.collect():
        assert (row.b, row.q) == (_Nesting().see(row.t).open, plain_open_quote(row.t))
