"""What Python workers hold doesn't grow with the rows that Spark sends at once, and goes back at the end of a task."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from inkstone.llm import decontaminate, encode, jaccard, scan


def _texts(n: int) -> pa.RecordBatch:
    rng = np.random.default_rng(7)
    texts = [" ".join(map(str, rng.integers(0, 1 << 20, 150).tolist())) for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], ["doc_id", "text"])


def _peak(make, batch: pa.RecordBatch) -> tuple[int, int]:
    """(bytes held at most, rows out) of a generator function over a batch, given the rest is warm."""
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in make(iter([batch])))
        return tracemalloc.get_traced_memory()[1], rows
    finally:
        tracemalloc.stop()


MAKERS = {
    "signatures": lambda b: jaccard._signatures(b, 5),
    "postings": lambda b: jaccard._postings(b, 5, 0, np.ones(jaccard.COUNTERS, np.int32), 500.0),
    "with_sets": lambda b: jaccard._with_sets(b, 5, 0),
}


@pytest.mark.parametrize("name", MAKERS)
def test_memory_does_not_grow_with_a_batch(name, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK_BYTES", 1 << 16)
    monkeypatch.setattr(scan.slices, "__defaults__", ("text", 1 << 18))
    monkeypatch.setattr(jaccard, "COUNTERS", 1 << 12)
    batch = _texts(8000)
    make = MAKERS[name]
    _peak(make, batch.slice(0, 50))
    (small, n), (large, m) = _peak(make, batch.slice(0, 1000)), _peak(make, batch)
    assert m > 5 * n
    assert large < 1.5 * small + (2 << 20)


def test_slices_keep_all_rows():
    texts = ["a" * 5, None, "b" * 40, "", "c" * 3, "d" * 4, "é" * 3, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["k", "text"])
    out = list(scan.slices(iter([batch.slice(0, 0), batch, batch.slice(3)]), "text", 10))
    assert [k for b in out for k in b["k"].to_pylist()] == [*range(8), *range(3, 8)]
    assert [t for b in out for t in b["text"].to_pylist()] == texts + texts[3:]
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b["text"].to_pylist()) <= 10 for b in out)


def test_scan_by_parts_is_the_scan(monkeypatch):
    texts = pa.array(["Ab cd", "", "x" * 90 + " ab", "ab", "  ", "ÄÖ é", "cd ab cd"] * 3)
    (_, _, data, offsets), = scan.chunks(texts, 1 << 20)
    whole = scan.scan(data, offsets, scan.SPACED)
    monkeypatch.setattr(scan, "CHUNK_BYTES", 12)
    parts = scan.scan(data, offsets, scan.SPACED)
    for name in ("hash", "doc", "start", "end"):
        assert getattr(whole, name).tolist() == getattr(parts, name).tolist()
    assert parts.n_docs == whole.n_docs == 21


def test_tables_of_long_texts_are_not_kept():
    long = pa.array(["ab " * (scan.CHUNK_BYTES // 2)])
    (_, _, data, offsets), = scan.chunks(long)
    w = scan.scan(data, offsets, scan.SPACED)
    assert len(set(w.hash.tolist())) == 1
    assert len(scan._powers[0]) <= scan.CHUNK_BYTES + 1
    encode._code_powers.cache_clear()
    from inkstone.llm.queries import tokenizer_path

    own = encode.encoder(tokenizer_path())
    text = "ab " * (encode.CHUNK_BYTES // 3 + 9)
    assert next(own.encode(pa.array([text]))).tolist() == own.whole(text).tolist()
    assert encode._code_powers.cache_info().currsize == 0


def test_a_task_gives_memory_back(monkeypatch):
    seen = []
    monkeypatch.setattr(scan, "release", lambda: seen.append(1))
    test = decontaminate.prepare(["a"], ["one two three"])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two three"])], ["doc_id", "text"])
    for make in (*MAKERS.values(), lambda b: decontaminate._annotate(b, test, "text")):
        before = len(seen)
        list(make(iter([batch])))
        assert len(seen) == before + 1
