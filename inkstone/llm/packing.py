"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length, one packing of the whole table.

Documents become pieces of at most `size` tokens; only longer documents are cut, with any shorter piece first. The longest
come first, and each goes to the tightest open sequence that holds it. Where pieces go depends on their lengths alone, so the
packing is made from how many pieces have each length, at most `size` numbers: equal pieces are placed in runs, into ranges
of sequences that have the same capacity left, and a segment tree over the capacities finds the tightest in logarithmic
time. A piece finds its run by its rank among the pieces of its length. Ranks are counted in each partition, and moved by what
the partitions before have.

Memory: the driver has the lengths' counts and the runs, whose number depends on `size` and not on the table; the runs are
broadcast. No pieces are brought together.

Edge cases: a null or empty text is the end token alone; repeated rows and null ids are documents of their own, and ids of any
type go through unchanged; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .encode import encoder
from .scan import slices, tidy
from .scratch import Scratch

SIZE = 1024
END = 2


class Capacities:
    """How many open sequences, or ranges of them, have each remaining capacity from 0 to `size`: a segment tree of counts,
    with a stack at each leaf."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        k = self.leaves + capacity
        while k:
            self.count[k] += by
            k >>= 1

    def push(self, capacity: int, sequence) -> None:
        self.stacks[capacity].append(sequence)
        self._add(capacity, 1)

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that an open sequence has."""
        k = self.leaves + least
        if self.count[k]:
            return least
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None

    def pop(self, capacity: int):
        self._add(capacity, -1)
        return self.stacks[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences, piece by piece."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, n = Capacities(size), 0
    order = np.argsort(-lengths, kind="stable")
    for k, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        capacity = free.tightest(length)
        if capacity is None:
            own, capacity, n = n, size, n + 1
        else:
            own = free.pop(capacity)
        sequence[k], offset[k] = own, size - capacity
        if capacity > length:
            free.push(capacity - length, own)
    return sequence, offset, n


def best_fit_runs(counts: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first sequence, pieces a sequence, offset of its first one) of the best-fit decreasing packing
    of `counts[length]` pieces of each length, by length and rank; and the number of sequences.

    A sequence that takes a piece stays the tightest one for the next equal piece as long as that fits, so each sequence of a
    range takes as many as it holds before the next one gets any."""
    free, n, runs = Capacities(size), 0, []
    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            capacity = free.tightest(length)
            if capacity is None:  # as many new ones as the rest needs
                capacity, first = size, n
                many = -(-(total - rank) // (size // length))
                n += many
            else:
                first, many = free.pop(capacity)
            each = capacity // length
            used, left = divmod(total - rank, each)
            runs.append((length, rank, first, each, size - capacity))
            if used >= many:
                used, left = many, 0
            for begin, count, taken in ((first, used, each), (first + used, left > 0, left), (first + used + (left > 0), many - used - (left > 0), 0)):
                if count and capacity - taken * length:
                    free.push(capacity - taken * length, (begin, int(count)))
            rank += used * each + left
    return np.array(sorted(runs), np.int64).reshape(-1, 5), n


RANKS = "_p_part int, _p_rank bigint"


class Ranks:
    """Numbers the pieces of each length in a task."""

    def __init__(self, size: int):
        self.seen, self.part = np.zeros(size + 1, np.int64), TaskContext.get().partitionId()

    def added(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The batch with its partition and the rank of each piece among those of its length in it."""
        length = batch.column("length").to_numpy().astype(np.int64)
        order = np.argsort(length, kind="stable")
        place = np.empty(len(length), np.int64)
        place[order] = np.arange(len(length))
        rank = self.seen[length] + place - np.searchsorted(length[order], length, side="left")
        self.seen += np.bincount(length, minlength=len(self.seen))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), self.part, np.int32)), pa.array(rank)], [*batch.schema.names, "_p_part", "_p_rank"])


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True, with_ranks: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each piece; `tokenizer` is a file of a byte-level BPE tokenizer
    that every executor has. `with_ranks` adds what `pack` would add itself, in the same Python workers."""

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, ranks = encoder(tokenizer), Ranks(size) if with_ranks else None
        for batch in slices(batches, text):
            rows: list[tuple] = []
            of, kept = [], []
            for k, body in enumerate(own_encoder.encode(batch.column(text))):
                ids = np.append(body, np.uint32(end)).astype("<u4")
                first = len(ids) % size or size
                for p, a in enumerate((0, *range(first, len(ids), size))):
                    own = ids[a : first if not p else a + size]
                    of.append(k)
                    rows.append((p, a, len(own), zlib.crc32(own.tobytes())))
                    if with_ids:
                        kept.append(own.astype(np.int32))
            columns = [batch.column(doc_id).take(pa.array(of, pa.int64()))]
            columns += [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            out = pa.RecordBatch.from_arrays(columns, names)
            yield out if ranks is None else ranks.added(out)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids + f", {RANKS}" * with_ranks
    return docs.select(doc_id, F.col(text).cast("string").alias(text)).mapInArrow(cut, schema)


def pack(pieced: DataFrame, size: int = SIZE) -> DataFrame:
    """`pieced` (with a column `length` of 1 to `size`) with sequence_id and offset.

    The pieces are written once to the shared folder with their partition and their rank in it, so that ranks come out the
    same after a lost executor.
    """
    spark, names = pieced.sparkSession, pieced.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieced.schema.fields if f.name not in ("_p_part", "_p_rank"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(size)
        for batch in batches:
            yield ranks.added(batch)

    if "_p_rank" not in names:
        pieced = pieced.mapInArrow(ranked, f"{fields}, {RANKS}")
    names = [c for c in names if c not in ("_p_part", "_p_rank")]
    numbered = Scratch(spark).table("pieces", pieced)
    parts = numbered.groupBy("length", "_p_part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(best_fit_runs(counts, size)[0])
    before = Window.partitionBy("length").orderBy("_p_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.select("length", "_p_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_p_before"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_length, run_rank, first, each, offset = runs.value.T
        # A key for (length, rank): ranks are below 2^52.
        keys = (run_length << 52) | run_rank
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_p_rank"))
            rank = rank + batch.column("_p_before").to_numpy()
            k = np.searchsorted(keys, (length << 52) | rank, side="right") - 1
            within = rank - run_rank[k]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[k] + within // each[k]), pa.array(offset[k] + within % each[k] * length)], [*names, "sequence_id", "offset"])

    return numbered.join(moved, ["length", "_p_part"]).select(*(f"`{c}`" for c in names), "_p_rank", "_p_before").mapInArrow(placed, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """Documents tokenised, cut and packed; `pack` writes the pieces, with their ids if `with_ids`."""
    return pack(pieces(docs, tokenizer, size, end, with_ids=with_ids, with_ranks=True), size)
