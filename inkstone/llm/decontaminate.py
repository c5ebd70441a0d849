"""Benchmark decontamination with suffix arrays.

Each shard, a bounded run of the documents of a Spark partition, gets a suffix array: all its word suffixes, sorted by as
many words as a window has, with doubled ranks. Every suffix of every test text is looked up in it by binary search, one
search a doubling; the range found is every place where it occurs verbatim. Following such places back through the test
text gives the longest match at each.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z. They are sorted by 64-bit hashes, and the bytes of
all words that are hit are compared. A window has `size` consecutive words of an item; an item of fewer, but not none, is
one window. A word of a document inside an occurrence of a window is hit.

Edge cases: a null or empty text has no words and is clean; an item without words has no window; items with equal
texts all count; null item ids are left out of the list; repeated rows and null document ids pass through; with an
empty benchmark nothing is hit. A document longer than a shard is a shard of its own. Extra columns stay, columns of the
result replace those of the same name. Two words of a benchmark with one hash are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .scan import ALNUM, LOWER, Words, chunks, scan, slices, tidy
from .scratch import Scratch

SIZE = 10
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 4 << 20

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("longest_match", T.LongType()),
])


@dataclass
class TestSet:
    """The words of the test texts, text after text, as flat arrays: some 17 bytes a word besides the distinct words."""

    hash: np.ndarray
    left: np.ndarray  # words from here to the end of the text
    row: np.ndarray  # the text
    opens: np.ndarray  # whether a window begins here
    known: np.ndarray  # sorted distinct hashes
    letters: np.ndarray  # the bytes of those words, one after the other
    edges: np.ndarray  # where each begins, and the end
    ids: list[list[str]]  # items of each text
    size: int


def _letters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of some words, one after the other."""
    n = end - start
    return data[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _strange(data: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray, letters: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which of some words of `data` don't have the bytes of the known words of these numbers."""
    n = end - start
    out = n != edges[number + 1] - edges[number]
    same = np.flatnonzero(~out)
    n = n[same]
    if n.sum():
        differs = _letters(data, start[same], end[same]) != _letters(letters, edges[number[same]], edges[number[same] + 1])
        out[same] = np.add.reduceat(differs, np.cumsum(n) - n) > 0
    return out


def prepare(ids: list[str | None], texts: list[str], size: int = SIZE) -> TestSet:
    """The test texts made ready for the search; equal texts are one."""
    owners: dict[str, list[str]] = {}
    for i, t in zip(ids, texts, strict=True):
        own = owners.setdefault(t, [])
        if i is not None:
            own.append(i)
    hashes, lefts, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    known, letters, edges = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    for a, _, data, offsets in chunks(pa.array(list(owners), pa.large_string())):
        w, data = scan(data, offsets, ALNUM), LOWER[data]
        hashes.append(w.hash)
        lefts.append((w.bounds()[1:][w.doc] - np.arange(len(w.hash))).astype(np.int32))
        rows.append((w.doc + a).astype(np.int32))
        fresh, first = np.unique(w.hash, return_index=True)
        new = ~np.isin(fresh, known)
        letters = np.concatenate([letters, _letters(data, w.start[first[new]], w.end[first[new]])])
        sizes = np.concatenate([np.diff(edges), (w.end - w.start)[first[new]]])
        known = np.concatenate([known, fresh[new]])
        order, edges = np.argsort(known), np.concatenate([[0], np.cumsum(sizes)])
        letters = _letters(letters, edges[:-1][order], edges[1:][order])
        known, edges = known[order], np.concatenate([[0], np.cumsum(sizes[order])])
        if _strange(data, w.start, w.end, np.searchsorted(known, w.hash), letters, edges).any():
            raise ValueError("two words of the benchmark have the same hash")
    left, row = np.concatenate(lefts), np.concatenate(rows)
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    return TestSet(np.concatenate(hashes), left, row, first | (left >= size), known, letters, edges, list(owners.values()), size)


@dataclass
class SuffixArray:
    """The word suffixes of a shard in the order of their first `size` words."""

    words: np.ndarray  # sorted distinct hashes; the rank of a word is its place here and 1, 0 is the end of a document
    levels: list[tuple[list[int], int, np.ndarray]]  # (shifts, bits, keys): ranks at these shifts make a key of the next ranks
    order: np.ndarray  # where the suffixes begin
    heads: np.ndarray  # first place in `order` of each last rank, and the end


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, rank of each key from 1, order of the keys, first place in it of each distinct one)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    heads = np.flatnonzero(new)
    distinct = ordered[heads]
    del ordered
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return distinct, rank, order, np.append(heads, len(keys))


def suffix_array(w: Words, size: int = SIZE) -> SuffixArray:
    words, rank, order, heads = _ranks(w.hash)
    levels, depth = [], 1
    while depth < size and len(rank):
        bits = len(heads).bit_length()
        deeper = min(63 // bits * depth, size)
        shifts = [*range(0, deeper - depth, depth), deeper - depth]
        key = rank
        for s in shifts[1:]:
            further = np.zeros_like(rank)
            if s < len(rank):
                further[:-s] = np.where(w.doc[s:] == w.doc[:-s], rank[s:], 0)
            key = key << bits | further
        rank = order = heads = further = None  # not held while the next ones are made
        keys, rank, order, heads = _ranks(key)
        levels.append((shifts, bits, keys))
        depth = deeper
    return SuffixArray(words, levels, order, heads)


def search(test: TestSet, array: SuffixArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the test texts, from, to) of all windows that occur: their places in a shard are `array.order[from:to]`."""
    none = np.zeros(0, np.int64)
    if not len(array.words) or not len(test.hash):
        return none, none, none
    low = np.minimum(np.searchsorted(array.words, test.hash), len(array.words) - 1)
    there = array.words[low] == test.hash
    low = high = low + 1
    for shifts, bits, keys in array.levels:
        # Words beyond the end of a text may be any: the lowest below, the highest above.
        below, above, all_there = np.zeros_like(low), np.zeros_like(low), np.ones_like(there)
        for s in shifts:
            inside = s < test.left
            at = np.minimum(np.arange(len(low)) + s, len(low) - 1)
            all_there &= there[at] | ~inside
            below = below << bits | np.where(inside, low[at], 0)
            above = above << bits | np.where(inside, high[at], (1 << bits) - 1)
        low, high, there = np.ones_like(low), np.zeros_like(high), all_there
        live = np.flatnonzero(all_there)
        low[live] = np.searchsorted(keys, below[live]) + 1
        high[live] = np.searchsorted(keys, above[live], side="right")
        there &= low <= high
    found = np.flatnonzero(there & test.opens)
    return found, array.heads[low[found] - 1], array.heads[high[found]]


@dataclass
class Matches:
    hit: np.ndarray  # words inside an occurrence of a window
    longest: np.ndarray  # words of the longest verbatim match of each document
    pairs: np.ndarray  # sorted document * texts + text: which test texts have windows in which documents


def find(w: Words, data: np.ndarray, test: TestSet) -> Matches:
    """What of the test texts occurs in a shard, whose lower-cased bytes are `data`."""
    array = suffix_array(w, test.size)
    places, starts, ends = search(test, array)
    n = len(w.hash)
    cover, run, longest = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(w.n_docs, np.int64)
    pairs, docs, texts = [np.zeros(0, np.int64)], np.zeros(w.n_docs, bool), len(test.ids)
    last, row, before = -1, -1, np.zeros(0, np.int64)
    # From the end of each text: a match that begins a word before another of the same text takes that one up.
    for t, a, b in zip(places[::-1].tolist(), starts[::-1].tolist(), ends[::-1].tolist(), strict=True):
        at, own, words = array.order[a:b], int(test.row[t]), min(test.size, int(test.left[t]))
        if own != row:
            pairs.append(np.flatnonzero(docs) * texts + row)
            docs[:] = False
        here = np.ones(len(at), np.int64)
        if own == row and t + 1 == last:
            here += np.where(w.doc[np.minimum(at + 1, n - 1)] == w.doc[at], run[at + 1], 0)
        run[before] = 0
        run[at] = here
        cover[at] += 1
        cover[at + words] -= 1
        docs[w.doc[at]] = True
        np.maximum.at(longest, w.doc[at], here + words - 1)
        last, row, before = t, own, at
    pairs.append(np.flatnonzero(docs) * texts + row)
    hit = np.cumsum(cover[:n]) > 0
    at = np.flatnonzero(hit)
    strange = at[_strange(data, w.start[at], w.end[at], np.searchsorted(test.known, w.hash[at]), test.letters, test.edges)]
    if len(strange):  # other words with the hash of a test word: they get another, and the search is repeated
        w.hash[strange] = ~w.hash[strange]
        return find(w, data, test)
    return Matches(hit, longest, np.sort(np.concatenate(pairs)))


def _spans(hit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of the runs of hit words of one document."""
    at = np.flatnonzero(hit)
    new = (np.diff(at) > 1) | (np.diff(doc[at]) > 0)
    return at[np.concatenate([[True], new])] if len(at) else at, at[np.concatenate([new, [True]])] + 1 if len(at) else at


@tidy
def _annotate(batches: Iterator[pa.RecordBatch], test: TestSet, text: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text, SHARD_BYTES):
        n_words, n_hit, items, spans, longest = [], [], [], [], []
        for _, _, data, offsets in chunks(batch.column(text), SHARD_BYTES):
            w = scan(data, offsets, ALNUM)
            found, bounds = find(w, LOWER[data], test), w.bounds()
            n_words += np.diff(bounds).tolist()
            n_hit += np.diff(np.concatenate([[0], np.cumsum(found.hit)])[bounds]).tolist()
            longest += found.longest.tolist()
            first, end = _spans(found.hit, w.doc)
            cut = np.searchsorted(first, bounds)
            pairs = np.searchsorted(found.pairs, np.arange(w.n_docs + 1) * len(test.ids))
            for d in range(w.n_docs):
                a, b = cut[d], cut[d + 1]
                spans.append([{"start": x, "length": y} for x, y in zip((first[a:b] - bounds[d]).tolist(), (end[a:b] - first[a:b]).tolist(), strict=True)])
                rows = found.pairs[pairs[d] : pairs[d + 1]] - d * len(test.ids)
                items.append(sorted({i for r in rows.tolist() for i in test.ids[r]}))
        fields = [("n_words", n_words, pa.int64()), ("n_hit", n_hit, pa.int64()), ("item_ids", items, pa.list_(pa.string())), ("spans", spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), ("longest_match", longest, pa.int64())]
        kept = [c for c in batch.schema.names if c not in RESULT.names]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(v, t) for _, v, t in fields], [*kept, *(n for n, _, _ in fields)])


def _blocks(items: DataFrame, size: int, block_bytes: int) -> Iterator[TestSet]:
    """Blocks of the items, at least one; the driver holds one block and a partition of the benchmark at a time."""
    ids, texts, held = [], [], 0
    for i, t in items.toLocalIterator():
        n = len(t.encode())
        if ids and held + n > block_bytes:
            yield prepare(ids, texts, size)
            ids, texts, held = [], [], 0
        ids.append(i), texts.append(t)
        held += n
    yield prepare(ids, texts, size)


def find_matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text", keep_text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, n_hit, item_ids (items with a window in the text), spans (the words that are hit) and
    longest_match (words of the longest verbatim match). The text stays if `keep_text`.

    The documents aren't shuffled. The test texts go to each task as a broadcast, made of at most `block_bytes` of texts
    (one longer item alone may be more) and about four times that in memory; a larger benchmark is cut into blocks,
    each a pass over the documents, whose results are joined by row.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = [spark.sparkContext.broadcast(t) for t in _blocks(items, size, block_bytes)]

    def one(test, to: DataFrame) -> DataFrame:
        names = [c for c in to.columns if c not in RESULT.names]
        schema = T.StructType([to.schema[c] for c in names] + RESULT.fields)
        return to.mapInArrow(lambda batches: _annotate(batches, test.value, text), schema)

    if len(blocks) == 1:
        out = one(blocks[0], docs)
    else:
        scratch = Scratch(spark)
        numbered = scratch.table("documents", docs.drop(*RESULT.names).withColumn("_d_row", F.monotonically_increasing_id()))
        parts = [one(b, numbered.select("_d_row", text)).drop(text) for b in blocks]
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        every = every.groupBy("_d_row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.max("longest_match").alias("longest_match"))
        merge = "aggregate(spans, cast(array() as array<struct<start:int,length:int>>), (a, s) -> if(size(a) > 0 and s.start <= a[size(a) - 1].start + a[size(a) - 1].length, concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'length', greatest(a[size(a) - 1].length, s.start + s.length - a[size(a) - 1].start)))), concat(a, array(s))))"
        every = every.withColumn("spans", F.expr(merge)).withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.length)"))
        out = numbered.join(every, "_d_row").drop("_d_row").select(*(c for c in docs.columns if c not in RESULT.names), *RESULT.names)
    return out if keep_text else out.drop(text)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in which no test window occurs, with their own columns."""
    marks = {c: f"_d_{c}" for c in docs.columns if c in RESULT.names}
    found = find_matches(docs.withColumnsRenamed(marks), benchmark, **options).where("n_hit = 0").drop(*RESULT.names)
    return found.withColumnsRenamed({v: k for k, v in marks.items()}).select(*docs.columns)
