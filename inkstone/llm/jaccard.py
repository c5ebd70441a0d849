"""Exact Jaccard join of shingle sets, by an inverted index over prefixes with skipping.

A document's set has its distinct 5-word shingles as 64-bit hashes. Documents with equal sets are one class, told by a
128-bit hash of the set, and only classes are compared.

1. Order. Every shingle falls on one of COUNTERS counters, which count over all documents; sets are ordered by their
   shingles' counters, rarest first, and then by hash. Counters are summed by Spark and have a fixed size, so what is
   broadcast doesn't grow; any order gives the same links, a good one gives short lists.
2. Index. Two sets that link share a shingle of their prefixes, so lists hold prefixes only, and only shingles that
   several classes have. A posting is a shingle, half of its class's hash, a size and a position, nothing else: sketches are
   fetched for the few pairs and lists that need them. That half must tell all classes, or the other half is taken. Lists
   are sorted by size and cut where the next size is more than any entry so far can link with, by its size and position.
3. Answers from similar sets. Each class is compared with the first class of its lists, if it meets it in TOGETHER of them;
   the sorted lists name it as they are made. Classes that are linked so form components, whose members need no comparison with
   each other: they follow from the leader's. The lists that still reach several components are compared up to ROUNDS times
   more, with the class at the earliest position, which has the fewest shingles of its own, and with some chosen by hash.
   All of this is linear in the list; pairs that meet in fewer lists are left to step 4.
4. Skipping. What is left, the classes outside the component of a list's first leader, looks for its partners. An
   entry at position p of a set of size n can only link with sets of sizes in a range that narrows with p, so it is brought
   together with the blocks of that range only; later positions are skipped. Lists within one component are skipped whole.
5. Whatever pairs come out are compared exactly, and the components are joined.

A pair comes out of steps 3 and 4 only if its parity sketches allow a link: bit i of a sketch tells whether an odd number
of the set's shingles falls on it. The bits in which two sketches differ are at most the shingles in which the sets
differ, and a link allows (a + b) / 9 of those, so more differing bits rule a link out for certain. It is the condition of
the list joins of step 4, so such pairs are never rows. Those lists have sketches of 512 bits, which tell little for sets of
over a thousand shingles; pairs that come out are told by longer ones, of 2 to 4 bits a shingle, before their sets are
brought together.

`link` therefore finds the links that join the components, not every link. `class_links` and `link_counts` give the
whole join, from the same index with no pair left out as known.

No list, component or group is gathered in one task: frequent shingles' postings are dealt by class too, minima are combined
before the shuffle, and lists are joined by Spark, which can split a large one. Edge cases: null and empty texts have the
empty set and are linked with nothing; a text of fewer words is one shingle; repeated rows and ids are documents of their
own, and count once each; null ids take part in links, but are no component's id while another id is there; an empty table
gives no rows. Of the columns of `docs`, only id and text are read, so others may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .graph import components
from .scan import SPACED, U, chunks, mix, scan, shingle_sets, slices, tidy
from .scratch import Scratch

WORDS = 5
#: Rounds of leaders after the first.
ROUNDS = 1
#: Leaders of a list that are chosen by hash, besides the first.
LEADERS = 2
#: Lists in which a class and a leader meet to be compared as such.
TOGETHER = 2
COUNTERS = 1 << 19
#: Counters in a row of counts, and so the most that a task sums at a time.
PART = 1 << 11
SKETCH = 8
#: Postings of shingles whose counter is higher than this and twice the mean counter are dealt by class too. The mean is what
#: rare shingles add up to on a counter, which grows with the input.
FREQUENT = 500
SALTS = 64
#: Bits of a position in a posting, beside the size.
PLACE = 24
#: Classes that a task remembers as sent; what it forgets is sent again and dropped later.
REMEMBERED = 1 << 17
#: Rows of ids that may be broadcast: about 40 bytes each. Larger tables are joined by shuffling.
SMALL_ROWS = 1_000_000

SKETCHES = [f"s{k}" for k in range(SKETCH)]
LED = ["leader", *(f"leader{k}" for k in range(LEADERS))]


def _class(s: np.ndarray) -> bytes:
    """128 bits that tell a set."""
    return int(mix(s, 101).sum(dtype=np.uint64)).to_bytes(8, "big") + int((mix(s, 202) ^ (s >> U(7))).sum(dtype=np.uint64)).to_bytes(8, "big")


def _key(cid: bytes, half: int) -> int:
    return int.from_bytes(cid[8 * half : 8 * half + 8], "big", signed=True)


def _keys(half: int) -> Column:
    """`_key` of the column cid."""
    return F.conv(F.hex(F.substring("cid", 1 + 8 * half, 8)), 16, -10).cast("bigint")


def _telling_half(classes: DataFrame) -> int:
    """The half of the class ids, 0 or 1, that no two classes share."""
    for half in (0, 1):
        if classes.groupBy(_keys(half).alias("key")).count().where("count > 1").isEmpty():
            return half
    raise ValueError("neither half of the class ids tells all classes")


def _parity(s: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((mix(s, 303) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketch(s: np.ndarray) -> list[int]:
    """The parity of the shingles on each of 2 to 4 bits a shingle, as 64-bit words; halves folded by xor make the shorter sketch."""
    return _parity(s, 1 << max(6, (2 * len(s) - 1).bit_length())).tolist()


def _sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in chunks(texts):
        yield from shingle_sets(scan(data, offsets, SPACED), words)


def _new(cid: bytes, seen: set[bytes]) -> bool:
    if cid in seen:
        return False
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add(cid)
    return True


@tidy
def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, with the sketch of a class that is new to this task; and at the end, with a part, the task's counters."""
    seen: set[bytes] = set()
    counts = np.zeros(COUNTERS, np.int64)
    names, kind = ["part", "counts", "doc_id", "n", "cid", "sketch", *SKETCHES], None
    for batch in slices(batches):
        sizes, ids, sketches, short, held = [], [], [], [], []
        for s in _sets(batch.column("text"), words):
            sizes.append(len(s))
            ids.append(cid := _class(s) if len(s) else None)
            if cid is not None and _new(cid, seen):
                sketches.append(_sketch(s))
                short.append(_parity(s, 64 * SKETCH))
                held.append(s)
            else:
                sketches.append(None)
                short.append(np.zeros(SKETCH, np.int64))
        if held:
            counts += np.bincount((np.concatenate(held) & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        kind, n = batch.column("doc_id").type, len(sizes)
        blank = np.array([x is None for x in sketches], bool)
        grid = np.array(short, np.int64).reshape(n, SKETCH)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), *(pa.array(grid[:, k].copy(), mask=blank) for k in range(SKETCH))], names)
    if kind is not None and counts.any():
        parts = [p for p in range(COUNTERS // PART) if counts[p * PART : (p + 1) * PART].any()]
        # As short a type as holds a part's counts; its width tells the type.
        short = [own.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if own.max() <= np.iinfo(t).max)).tobytes() for own in (counts[p * PART : (p + 1) * PART] for p in parts)]
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(short, pa.binary()), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), *(pa.nulls(n, pa.int64()) for _ in SKETCHES)], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each part's counts; all rows of a part are in this task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            own = total.setdefault(part, np.zeros(PART, np.int64))
            own += np.frombuffer(counts, f"<u{len(counts) // PART}").astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])


@tidy
def _postings(batches: Iterator[pa.RecordBatch], words: int, half: int, counters: np.ndarray, frequent: float) -> Iterator[pa.RecordBatch]:
    """The prefix of each set that is new to this task: (salt, shingle, size and position, class)."""
    seen: set[bytes] = set()
    for batch in slices(batches):
        out: list[tuple] = []
        for s in _sets(batch.column("text"), words):
            if not len(s) or not _new(cid := _class(s), seen):
                continue
            count = counters[(s & U(COUNTERS - 1)).astype(np.int64)]
            # A set of size n links only with sets that hold at least 4/5 of it.
            order = np.argsort(count, kind="stable")[: len(s) - (4 * len(s) + 4) // 5 + 1]
            salt = np.where(count[order] > frequent, 1 + cid[0] % SALTS, 0)
            # A lower position than the true one skips less, so the bound on it loses nothing.
            place = (len(s) << PLACE) + np.minimum(np.arange(len(order)), (1 << PLACE) - 1)
            out.append((salt, s[order], place, np.full(len(order), _key(cid, half), np.int64)))
        if not out:
            continue
        kinds = {"salt": np.int32, "token": np.int64, "place": np.int64, "key": np.int64}
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(zip(*out), kinds.values(), strict=True)], list(kinds))


@tidy
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, salt, size and position, and class, those of lists with more than one class, or with a salt,
    each with the first class of its list as `lead`; repeated rows once. A list ends where the next size is too large for a
    link with any row so far (as in `_candidates`); it is told by its token and lead, by its token alone if it was dealt by class.

    Only the last row is held back from one batch to the next, however long the list."""
    names = ["salt", "token", "place", "key"]
    held: list[np.ndarray] | None = None  # the last row so far
    # Whether its list has more than one class, so that it went out; its list's first class; and the largest size in reach.
    told, lead, far = False, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in names]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        salt, token, _, key = rows
        again = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & (key[1:] == key[:-1])
        keep = np.concatenate([[True], ~again])
        salt, token, place, key = rows = [x[keep] for x in rows]
        n, pos = place >> PLACE, place & ((1 << PLACE) - 1)
        same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        reach = np.minimum(5 * n // 4, 9 * (n - pos) // 4 - n)
        reach[0] = max(reach[0], far) if held is not None else reach[0]
        # The running maximum within a token: each starts above all that the tokens before it reach.
        step = np.concatenate([[0], np.cumsum(~same)]) * (int(reach.max()) + int(abs(reach.min())) + 1)
        reach = np.maximum.accumulate(reach + step) - step
        same &= reach[:-1] >= n[1:]
        opens = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(token)), 0))
        leads = key[opens]
        if held is not None:
            leads[opens == 0] = lead
        twin = salt > 0
        twin[1:] |= same
        twin[:-1] |= same
        last = bool(twin[-1]) or (told and len(token) == 1)
        if told and held is not None:
            twin[0] = False
        if twin.any():
            lists = np.where(salt > 0, token, mix(token.view(U) ^ mix(leads.view(U), 1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x[twin]) for x in (lists, key, n, pos, leads)], ["token", "key", "n", "pos", "lead"])
        told, lead, far, held = last, leads[-1], reach[-1], [x[-1:] for x in rows]


@tidy
def _with_sets(batches: Iterator[pa.RecordBatch], words: int, half: int) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in slices(batches):
        keys, sets = [], []
        for s in _sets(batch.column("text"), words):
            if len(s) and _new(cid := _class(s), seen):
                keys.append(_key(cid, half))
                sets.append(s.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "set"])


def _small(df: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _may_link(a: Column, b: Column, n: Column) -> Column:
    """Whether the sketches a and b leave a link possible between sets of n shingles together."""

    def fold(x: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    # Sets that can link differ by a quarter in size at most, so one sketch has at most twice the words of the other.
    x, y = F.when(F.size(a) > F.size(b), fold(a)).otherwise(a), F.when(F.size(b) > F.size(a), fold(b)).otherwise(b)
    differing = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, d: t + d)
    return 9 * differing <= n


def _allows(a: str, b: str) -> Column:
    """Whether sizes and sketches of the sides a and b (name endings) allow a link."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    differing = sum((F.bit_count(F.col(f"{s}{a}").bitwiseXOR(F.col(f"{s}{b}"))) for s in SKETCHES), F.lit(0))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * differing <= n + m)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, half: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (u, v) of classes whose sets have a Jaccard similarity of 0.8 or more, exactly."""
    pairs = scratch.table(f"{name}-pairs", pairs)
    ends = lambda df: df.select(F.col("u").alias("key")).union(df.select(F.col("v").alias("key"))).distinct()
    told = scratch.table(f"{name}-told", classes.join(_small(scratch.table(f"{name}-ends", ends(pairs))), "key", "left_semi").select("key", "n", "sketch", "first_id"))
    for k in "uv":
        pairs = pairs.join(told.select(F.col("key").alias(k), F.col("n").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}")), k)
    n, m = F.col("size_u"), F.col("size_v")
    pairs = pairs.where((5 * F.least(n, m) >= 4 * F.greatest(n, m)) & _may_link(F.col("sketch_u"), F.col("sketch_v"), n + m)).select("u", "v")
    pairs = scratch.table(f"{name}-likely", pairs)
    first = scratch.table(f"{name}-first", told.join(ends(pairs), "key", "left_semi").select("key", F.col("first_id").alias("_j_id")))
    texts = docs.join(_small(first).select("_j_id"), docs["doc_id"].eqNullSafe(F.col("_j_id")), "left_semi")
    sets = texts.select("text").mapInArrow(lambda b: _with_sets(b, words, half), "key bigint, set array<bigint>")
    sets = scratch.table(f"{name}-sets", sets.join(_small(first).select("key"), "key", "left_semi"))
    # The sets of u go to those of v, which are the fewer where they lead lists.
    left = sets.select(F.col("key").alias("u"), F.col("set").alias("set_u")).join(_small(pairs), "u")
    heads = _small(scratch.table(f"{name}-heads", pairs.select(F.col("v").alias("key")).distinct()))
    right = sets.join(heads, "key", "left_semi").select(F.col("key").alias("v"), F.col("set").alias("set_v"))
    common = F.size(F.array_intersect("set_u", "set_v"))
    linked = left.join(right, "v").where(100 * common >= 80 * (F.size("set_u") + F.size("set_v") - common)).select("u", "v").distinct()
    out = scratch.table(f"{name}-links", linked)
    scratch.drop(*(f"{name}-{x}" for x in ("pairs", "ends", "told", "likely", "first", "heads", "sets")))
    return out


def _open(lists: DataFrame, clusters: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The lists (token, key, n, pos) that reach more than one component, with each class's component and the list's leaders.

    `leader` is the class at the earliest position; as a row it costs each list one minimum, combined before the shuffle."""
    known = _small(clusters.select(F.col("node").alias("key"), F.col("component").alias("known")))
    lists = lists.select("token", "key", "n", "pos").join(known, "key", "left").select("token", "key", "n", "pos", F.coalesce("known", "key").alias("comp"))
    wide = lists.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("token")
    lists = scratch.table(f"{name}-rows", lists.join(_small(scratch.table(f"{name}-wide", wide)), "token", "left_semi"))
    leader = [F.min(F.struct("pos", "key", "comp")).alias("leader")]
    leader += [F.min(F.struct(F.xxhash64("key", F.lit(f"{name}{k}")), "key", "comp")).alias(f"leader{k}") for k in range(LEADERS)]
    led = lists.groupBy("token").agg(*leader).select("token", *(F.struct(f"{x}.key", f"{x}.comp").alias(x) for x in LED))
    out = scratch.table(name, lists.join(led, "token"))
    scratch.drop(f"{name}-rows", f"{name}-wide")
    return out


def _together(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u", "v").count().where(F.col("count") >= TOGETHER).select("u", "v")


def _first_followers(lists: DataFrame) -> DataFrame:
    """Pairs (u, v) of a class and the first class of TOGETHER of its lists."""
    return _together(lists.where("key <> lead").select(F.col("key").alias("u"), F.col("lead").alias("v")))


def _followers(lists: DataFrame) -> DataFrame:
    """Pairs (u, v) of a class and a leader of TOGETHER of its lists in another component."""
    rows = lists.select("key", "comp", F.explode(F.array(*LED)).alias("l"))
    return _together(rows.where("comp <> l.comp").select(F.col("key").alias("u"), F.col("l.key").alias("v")))


def _candidates(lists: DataFrame, classes: DataFrame, every: bool) -> DataFrame:
    """Pairs of classes of different components that share a prefix shingle, where sizes, positions and sketches allow a link.

    Classes of the component of a list's first leader don't look for partners, unless `every` pair is asked for; the others find them."""
    block = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25))).cast("int")
    n, left = F.col("n"), F.col("n") - F.col("pos")
    main = F.lit(False) if every else F.col("comp") == F.col("leader.comp")
    lists = lists.select("token", "key", "n", "pos", (F.col("key") if every else F.col("comp")).alias("comp"), main.alias("main"))
    lists = lists.join(classes.select("key", *SKETCHES), "key")
    row = ["token", "key", "comp", "n", left.alias("left"), "main", *SKETCHES]
    side = lambda df, end: df.withColumnsRenamed({c: f"{c}{end}" for c in ["key", "comp", "n", "left", "main", *SKETCHES]})
    index = side(lists.select(*row, block(n).alias("block")), "_v")
    # 4 n <= 5 m, 4 m <= 5 n, and 4 (n + m) <= 9 left, as what is common to both lies at its place or later.
    low, high = F.ceil(4 * n / 5), F.least(F.floor(5 * n / 4), F.floor(9 * left / 4) - n)
    probe = side(lists.where((high >= low) & ~F.col("main")).select(*row, F.explode(F.sequence(block(low), block(high))).alias("block")), "_u")
    once = F.col("main_v") | (F.struct("n_u", "key_u") > F.struct("n_v", "key_v"))
    fits = 9 * F.least("left_u", "left_v") >= 4 * (F.col("n_u") + F.col("n_v"))
    return probe.join(index, ["token", "block"]).where(once & fits & (F.col("comp_u") != F.col("comp_v")) & _allows("_u", "_v")).select(F.col("key_u").alias("u"), F.col("key_v").alias("v")).distinct()


def _read(docs: DataFrame, doc_id: str, text: str, words: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """The documents' (doc_id, text), the written signatures, those of documents alone, the classes, and the half of their ids that is their key."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = ", ".join(f"{s} bigint" for s in SKETCHES)
    made = scratch.table("signatures", docs.mapInArrow(lambda b: _signatures(b, words), f"part int, counts binary, doc_id {kind}, n bigint, cid binary, sketch array<bigint>, {sketches}"))
    signed = made.where("part is null").select("doc_id", "n", "cid")
    first_of = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "sketch", *SKETCHES)]
    classes = made.where("part is null and n > 0").groupBy("cid").agg(F.min("doc_id").alias("first_id"), *first_of)
    classes = scratch.table("classes", classes)
    half = _telling_half(classes)
    return docs, made, signed, classes.withColumn("key", _keys(half)), half


def _lists(docs: DataFrame, made: DataFrame, words: int, half: int, scratch: Scratch) -> DataFrame:
    """The lists of the prefixes' shingles that several classes have: (token, key, n, pos, lead), with a token for each list."""
    spark = docs.sparkSession
    # COUNTERS / PART rows of 8 * PART bytes come to the driver, and 4 * COUNTERS bytes are broadcast, whatever the input.
    parts = made.where("part is not null").select("part", "counts").repartition("part").mapInArrow(_summed, "part int, counts binary").toArrow()
    counters = np.zeros(COUNTERS, np.int64)
    for part, counts in zip(parts["part"].to_pylist(), parts["counts"].to_pylist(), strict=True):
        counters[part * PART : (part + 1) * PART] = np.frombuffer(counts, "<i8")
    frequent = FREQUENT + 2 * float(counters.mean())
    order = spark.sparkContext.broadcast(np.minimum(counters, 2**31 - 1).astype(np.int32))
    lists = docs.select("text").mapInArrow(lambda b: _postings(b, words, half, order.value, frequent), "salt int, token bigint, place bigint, key bigint")
    lists = lists.repartition("token", "salt").sortWithinPartitions("token", "salt", "place", "key").mapInArrow(_shared, "token bigint, key bigint, n bigint, pos bigint, lead bigint")
    return scratch.table("lists", lists)


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of each document.

    class_id tells documents with equal sets (null without words). component_id is the smallest id that can be reached
    by links, the document's own included.
    """
    scratch = Scratch(docs.sparkSession)
    docs, made, signed, classes, half = _read(docs, doc_id, text, words, scratch)
    lists = _lists(docs, made, words, half, scratch)
    links = _verified(_first_followers(lists), docs, classes, words, half, scratch, "first")
    joined, now = scratch.table("clusters", components(links, scratch, "steps")), "lists"
    for k in range(ROUNDS + 1):
        lists = _open(lists, joined, scratch, f"open{k}")
        scratch.drop(now)
        now = f"open{k}"
        if k == ROUNDS:
            break
        found = _verified(_followers(lists), docs, classes, words, half, scratch, f"round{k}")
        if found.isEmpty():
            break
        links = links.union(found)
        joined = scratch.table(f"clusters{k}", components(links, scratch, f"steps{k}"))
    far = _verified(_candidates(lists, classes, every=False), docs, classes, words, half, scratch, "far")
    scratch.drop(now)
    if not far.isEmpty():
        joined = components(links.union(far), scratch, "all-steps")
    least = classes.select("cid", "key", "first_id").join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    roots = least.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = least.join(roots, "component").select("cid", "component_id")
    out = signed.join(named, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.hex("cid").alias("class_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _all_links(docs: DataFrame, doc_id: str, text: str, words: int) -> tuple[DataFrame, DataFrame]:
    """Every link (u, v) between two classes, once, by their ids; and (doc_id, n, cid) of each document."""
    scratch = Scratch(docs.sparkSession)
    docs, made, signed, classes, half = _read(docs, doc_id, text, words, scratch)
    lists = _lists(docs, made, words, half, scratch)
    # Each class as a component of its own, so that no pair counts as known.
    links = _verified(_candidates(lists, classes, every=True), docs, classes, words, half, scratch, "every")
    for k in "uv":
        links = links.join(classes.select(F.col("key").alias(k), F.col("cid").alias(f"cid_{k}")), k)
    return links.select(F.col("cid_u").alias("u"), F.col("cid_v").alias("v")), signed


def class_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(class_u, class_v) of every two classes that are linked, each pair once, with class ids as in `link`.

    Unlike `link`, which needs no more links than join the components, this gives the whole join. Documents of equal
    sets share a class and have no row here. The rows, and the work for them, grow with the square of a group of near copies.
    """
    links, _ = _all_links(docs, doc_id, text, words)
    return links.select(F.hex(F.least("u", "v")).alias("class_u"), F.hex(F.greatest("u", "v")).alias("class_v"))


def link_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, class_id, n_links) of each document: how many other documents it is linked with, equal sets included."""
    links, signed = _all_links(docs, doc_id, text, words)
    sizes = signed.where("cid is not null").groupBy("cid").agg(F.count("*").alias("size"))
    both = links.select(F.col("u").alias("cid"), F.col("v").alias("other")).union(links.select(F.col("v").alias("cid"), F.col("u").alias("other")))
    partners = both.join(sizes.withColumnRenamed("cid", "other"), "other").groupBy("cid").agg(F.sum("size").alias("partners"))
    found = sizes.join(partners, "cid", "left").select("cid", (F.col("size") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"))
    return signed.join(found, "cid", "left").select("doc_id", F.hex("cid").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """`docs` with one row of each component: the one with the smallest id, rows without an id last.

    Rows without words all stay. Each row is a document of its own, whatever ids repeat or are missing; of rows alike in
    id and component the first stays.
    """
    rows = Scratch(docs.sparkSession).table("rows", docs.withColumn("_j_row", F.monotonically_increasing_id()))
    ids = rows.select(F.col("_j_row").alias("doc_id"), F.struct(F.col(doc_id).isNull(), doc_id, "_j_row").alias("place"))
    found = link(rows, "_j_row", text, words).where("n_shingles > 0").select("doc_id", "component_id").join(ids, "doc_id")
    kept = found.groupBy("component_id").agg(F.min("place")["_j_row"].alias("_j_row")).select("_j_row")
    open_rows = F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return rows.where(open_rows).join(kept, "_j_row", "left_semi").unionByName(rows.where(~open_rows)).drop("_j_row")
