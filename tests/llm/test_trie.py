"""The prefix trie against brute force, and the registered query's rebuilding against it."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from inkstone.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, key string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns_of(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            said[c].append(((turn is not None, turn or 0, key), role, text))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in said.items()}


def rebuilt(said):
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = said.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(said):
    members = defaultdict(list)
    for c, own in said.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    out = set()
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = ",".join(str(c) for c in sorted(convs) if len(said[c]) == len(node))
        out.add((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(x) == len(node) + 1 for x in below),
            sum(map(leaf, below)), sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def made(seed):
    r, rows = random.Random(seed), []
    for c in range(70):
        for turn in range(r.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, turn, r.choice(["user", "user", None]), r.choice(["a b", "a  b c", "", None, "d"])))
    rows += [(100 + k, t, "user", "same words here") for k in range(25) for t in range(3)]  # copies
    rows += [(300 + k, t, "user", f"long {t}") for k in range(3) for t in range(12 + 9 * k)]
    rows += [(200, None, "system", "first"), (200, 1, "user", "x"), (200, 1, "user", "x"), (200, 1, "assistant", None), (None, 1, "user", "no id")]
    r.shuffle(rows)
    return rows


def got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block, run", [(2, 2), (1024, 1000)])
def test_against_brute_force(spark, monkeypatch, block, run):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "RUN_IDS", run)
    rows = made(block)
    table = spark.createDataFrame([(*r, 3, "clash") for r in rows], SCHEMA)
    assert got(trie.prefix_trie(table, with_text=False, rebuild=trie.with_shared_heads)) == brute(rebuilt(turns_of(rows)))


def test_without_rebuilding(spark):
    rows = made(7)
    found = trie.prefix_trie(spark.createDataFrame([(*r, 3, "clash") for r in rows], SCHEMA).repartition(5))
    said = turns_of(rows)
    assert got(found) == brute(said)
    for r in found.collect():
        assert (r.role, r.text) == (said[r.conv_id][r.depth - 1] if r.depth else (None, None))


def test_turnless_conversations_are_members_of_the_root(spark):
    # Of conversation 5 nothing is left: crc32("5") % 4 is 2, and conversation 0 isn't there.
    assert zlib.crc32(b"5") % 4 == 2
    rows = [(5, 0, "user", "gone")]
    found = got(trie.prefix_trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), False, trie.with_shared_heads))
    assert found == {(5, 0, None, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert trie.prefix_trie(empty).collect() == []
    assert trie.prefix_trie(empty, False, trie.with_shared_heads).collect() == []
