"""The prefix trie of conversations: one node for each distinct sequence of first turns, with totals of its subtree.

A turn is known by the SHA-256 digest of its role and text, a node by its depth and three 64-bit lanes: the exclusive or
of a hash of (lane, digest, place) over its turns, so that a prefix is a running aggregate, which blocks of a long
conversation compute apart. The members of a node below another are among that one's, so the nodes whose smallest member
is one conversation are a run of places of it, a *path*; (smallest member, depth) names a node from then on.

Subtree totals come from peeling leaves: each path holds a counter of the paths that hang on its nodes and aren't complete.
Those at zero send the totals of their top node to the path above, which counts down, until only the root's path is left
and ends too. A path is peeled as one node, so a long conversation takes a round, not one a turn; the rounds are as many as
paths hang below each other. Then running sums along the paths give each node's totals.

Memory: no conversation, node or group of copies is in one task as a whole. A list of conversations that end at a node is
joined in runs of `RUN_IDS`; only these strings go through one task, one by one, as SHA-256 has to be fed in order.

Edge cases: a row without conv_id belongs to no conversation and is left out; a null turn comes first; null roles and texts
are empty; rows of equal turn follow the order of their digests, and repeated rows are turns of their own; a conversation
without turns is a member of the root alone; an empty table has no nodes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

#: Places of a conversation that are aggregated together.
BLOCK = 1024
#: Ids of ended conversations that are one string.
RUN_IDS = 1000
LANES = ("x1", "x2", "x3")
UP = ("up1", "up2", "up3")


def ordered(conversations: DataFrame, scratch: Scratch, with_text: bool = False) -> DataFrame:
    """(conv_id, place from 1, key, n_words[, role, text]) of each turn.

    Rows are sorted over all partitions, so a conversation may lie in several; places are counted in each, and then moved by
    what the conversation has in the partitions before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    said = [role.alias("role"), text.alias("text")] if with_text else []
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", key.alias("key"), words.alias("n_words"), *said, F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), "key", "row"]
    dealt = scratch.table("dealt", rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counted = dealt.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    placed = counted.join(moved, ["conv_id", "part"]).withColumn("place", F.col("before") + F.col("k"))
    return scratch.table("turns", placed.select("conv_id", "place", "key", "n_words", *["role", "text"] * with_text))


def with_shared_heads(turns: DataFrame, step: int = 20, heads: int = 4) -> DataFrame:
    """`turns` of `ordered` with each conversation c rebuilt: the first h turns of conversation c - c % step, then c's own
    after its first h, where h = crc32(c in decimal) % heads. The ids of conversations are integers."""
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    base = F.col("conv_id") - F.col("conv_id") % step
    ids = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), base.alias("base"))
    extra = [c for c in turns.columns if c not in ("conv_id", "place")]
    first = turns.where((F.col("place") < heads) & (F.col("conv_id") % step == 0)).withColumnRenamed("conv_id", "base")
    head = ids.join(first, "base").where("place <= h").select("conv_id", "place", *extra)
    given = head.groupBy("conv_id").agg(F.count("*").alias("given"))
    # A conversation's number goes to its blocks, so that its rows aren't joined by its id alone.
    block = F.floor(F.col("place") / BLOCK)
    own = turns.withColumn("block", block).where(F.col("place") > h)
    blocks = own.select("conv_id", "block").distinct().join(given, "conv_id", "left")
    moved = own.join(blocks, ["conv_id", "block"]).withColumn("place", F.col("place") - h + F.coalesce("given", F.lit(0)))
    return head.unionByName(moved.select("conv_id", "place", *extra))


def _running(rows: DataFrame, values: dict[str, Column], by, up: bool) -> DataFrame:
    """`rows` (conv_id, depth, …) with a running aggregate `by` of each value along a conversation, up to or from each depth.

    Blocks of depths are aggregated apart; each row then takes up its block's total of the blocks before."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK)).withColumns({f"_{n}": v for n, v in values.items()})
    order = lambda c: F.col(c).asc() if up else F.col(c).desc()
    within = Window.partitionBy("conv_id", "block").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "block").agg(*(by(f"_{n}").alias(f"_{n}") for n in values))
    totals = totals.select("conv_id", "block", *(F.coalesce(by(f"_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in values))
    out = rows.withColumns({n: by(f"_{n}").over(within) for n in values}).join(totals, ["conv_id", "block"])
    both = lambda n: F.col(n).bitwiseXOR(F.col(f"before_{n}")) if by is F.bit_xor else F.col(n) + F.col(f"before_{n}")
    return out.withColumns({n: both(n) for n in values}).drop("block", *(f"before_{n}" for n in values))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (node, conv_id) as (node, first conv_id, ids joined by commas)."""
    node, ids = None, []

    def run():
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array(ids[:1], kind), pa.array([",".join(map(str, ids))])], [*LANES, "first", "ids"])

    for batch in batches:
        kind = batch.column(3).type
        for *at, conv in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if at != node or len(ids) == RUN_IDS:
                if ids:
                    yield run()
                node, ids = at, []
            ids.append(conv)
    if ids:
        yield run()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of all runs of each node, fed one after another."""
    node, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([digest.hexdigest()])], [*LANES, "ends_sha256"])

    for batch in batches:
        for *at, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if at == node:
                digest.update(b",")
            else:
                if node is not None:
                    yield row()
                node, digest = at, hashlib.sha256()
            digest.update(ids.encode())
    if node is not None:
        yield row()


def _ends(ended: DataFrame, scratch: Scratch) -> DataFrame:
    """(lanes, ends_sha256) of each node where conversations end."""
    kind = ended.schema["conv_id"].dataType.simpleString()
    lanes = "x1 bigint, x2 bigint, x3 bigint"
    by_node = ended.select(*LANES, "conv_id").repartitionByRange(*LANES, "conv_id").sortWithinPartitions(*LANES, "conv_id")
    runs = scratch.table("runs", by_node.mapInArrow(_joined_ids, f"{lanes}, first {kind}, ids string"))
    fed = runs.repartition(*LANES).sortWithinPartitions(*LANES, "first").select(*LANES, "ids")
    return fed.mapInArrow(_digests, f"{lanes}, ends_sha256 string")


def _nodes(turns: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, words, ends_sha256) of each node."""
    lane = {x: F.xxhash64(F.lit(x), "key", "depth") for x in LANES}
    rows = _running(turns.select("conv_id", F.col("place").alias("depth"), "key", "n_words"), lane, F.bit_xor, True)
    # What one turn adds is taken off again for the node above.
    above = [F.col(x).bitwiseXOR(F.col(f"_{x}")).alias(u) for x, u in zip(LANES, UP, strict=True)]
    rows = scratch.table("prefixes", rows.select("conv_id", "depth", *LANES, *above, "n_words"))
    found = rows.groupBy("depth", *LANES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_words").alias("words"), *(F.max(u).alias(u) for u in UP))
    zero = [F.lit(0).cast("long").alias(x) for x in (*LANES, *UP)]
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    found = scratch.table("found", found.select("conv_id", "depth", "n_convs", "words", *LANES, *UP).unionByName(root.select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"), *zero)))
    lengths = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    # The conversations' last rows, by (conv_id, depth); those without turns end at the root.
    ended = rows.join(lengths, ["conv_id", "depth"], "left_semi").select("conv_id", *LANES)
    turnless = ids.join(lengths, "conv_id", "left_anti").select("conv_id", *zero[:3])
    ends = _ends(ended.unionByName(turnless), scratch)
    below = found.where("depth > 0")
    kids = below.groupBy(*(F.col(u).alias(x) for x, u in zip(LANES, UP, strict=True))).agg(F.count("*").alias("n_children"))
    empty = hashlib.sha256().hexdigest()
    whole = found.join(kids, list(LANES), "left").join(ends, list(LANES), "left")
    whole = whole.select("conv_id", "depth", "n_convs", "words", *LANES, *UP, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    over = found.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("parent_depth"), *(F.col(x).alias(u) for x, u in zip(LANES, UP, strict=True)))
    # Many children of one parent are what the adaptive skew join splits.
    named = whole.join(over, (whole["depth"] == over["parent_depth"] + 1) & reduce(lambda a, b: a & b, (whole[u] == over[u] for u in UP)), "left")
    return scratch.table("nodes", named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "words", "ends_sha256"))


def _peel(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """(up_conv, up_depth, leaves, saved): what complete paths have sent to the nodes that they hang on, by round."""
    top = F.struct("depth", "parent_conv_id")
    paths = nodes.groupBy("conv_id").agg(F.min(top).alias("top"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    paths = scratch.table("paths", paths.select("conv_id", F.col("top.parent_conv_id").alias("up_conv"), (F.col("top.depth") - 1).alias("up_depth"), "leaves", "saved"))
    waiting = paths.where("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id")).agg(F.count("*").alias("remaining"))
    now = scratch.table("peel0", paths.join(waiting, "conv_id", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0))))
    sent: list[DataFrame] = []
    while not now.isEmpty():
        done = now.where("remaining = 0 and up_conv is not null").select("up_conv", "up_depth", "leaves", "saved")
        sent.append(done)
        got = done.groupBy(F.col("up_conv").alias("conv_id")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        rest = now.where("remaining > 0").join(got, "conv_id", "left")
        more = lambda c, by: F.col(c) + F.coalesce(by, F.lit(0))
        now = scratch.table(f"peel{len(sent)}", rest.select("conv_id", "up_conv", "up_depth", more("leaves", "more_leaves").alias("leaves"), more("saved", "more_saved").alias("saved"), (F.col("remaining") - F.coalesce("n", F.lit(0))).alias("remaining")))
    return sent


def trie(turns: DataFrame, ids: DataFrame, scratch: Scratch, with_text: bool = False) -> DataFrame:
    """The nodes of `turns` (as of `ordered`); `ids` has the conv_id of each conversation, those without turns too."""
    nodes = _nodes(turns, ids, scratch)
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    sent = _peel(nodes, scratch)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256"]
    if sent:
        got = reduce(DataFrame.union, sent).groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        nodes = nodes.join(got, ["conv_id", "depth"], "left")
    else:  # no conversations
        nodes = nodes.withColumns({"more_leaves": F.lit(0), "more_saved": F.lit(0)})
    more = lambda c: F.col(c) + F.coalesce(f"more_{c if c == 'saved' else 'leaves'}", F.lit(0))
    totals = _running(nodes, {"n_leaves": more("leaf"), "saved_tokens": more("saved")}, F.sum, False)
    out = totals.select(*columns[:-1], "n_leaves", "saved_tokens", "ends_sha256")
    if with_text:
        last = turns.select("conv_id", F.col("place").alias("depth"), "role", "text")
        out = out.join(last, ["conv_id", "depth"], "left")
    return out


def prefix_trie(conversations: DataFrame, with_text: bool = True, rebuild=None) -> DataFrame:
    """A row for each node of the trie of `conversations` (conv_id, turn, role, text).

    conv_id: the smallest conversation that begins so; depth: how many turns, 0 for the root; parent_conv_id; n_convs: the
    conversations that begin so; n_children; n_leaves: nodes without children in its subtree, which includes it;
    saved_tokens: over its subtree, the words of a node's last text times the conversations that needn't repeat it;
    ends_sha256: the digest of the ids of the conversations that end here, in order and joined by commas; role and text of
    the last turn if `with_text`. `rebuild` is a function on the ordered turns that runs first, such as `with_shared_heads`.
    """
    scratch = Scratch(conversations.sparkSession)
    turns = ordered(conversations, scratch, with_text)
    ids = turns.select("conv_id").distinct()
    if rebuild is not None:
        turns = scratch.table("rebuilt", rebuild(turns))
    return trie(turns, ids, scratch, with_text)
