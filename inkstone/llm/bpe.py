"""Byte-level BPE encoding and decoding of whole texts, with long unsplit stretches encoded as trees of parts.

Merges stay within the segments of the pre-tokeniser, so a text is encoded by segments. A segment of more than `LEAF`
characters is an unsplit stretch, such as a line of coded data: it is halved until its parts are short, the parts go to
tasks as rows of their own and are encoded apart, and neighbours are joined again, two by two, up to the whole. At a join, the
tokens next to it on both sides are encoded anew, and more of them until the outermost new tokens are those that were there
before. Whether tokens may stand in a row is a matter of each two neighbours, so what lies beyond needs no change and the
tokens are exactly those of the whole stretch.

Memory: a text, its tokens, and a bounded store of segments. Texts without long stretches never leave their task.

Edge cases: a null text is empty, and an empty one has no tokens; repeated rows and null ids are documents of their own;
strings of the file's added tokens in a text are those tokens, as the library has it; an empty table gives no rows. Texts with
code points whose class isn't the same in all Unicode versions are encoded by the library in one go, whatever their length.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .encode import UNSURE, borders, classes, encoder
from .scratch import Scratch

#: The longest stretch, in characters, that is encoded in one go.
LEAF = 4096
_TEXT, _JOINED, _ADDED = range(3)


class Codec:
    """Encodes and decodes by a tokenizer file; the parts of long stretches one by one."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        added = self.encoder.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that take up or ask for what is around them aren't supported")
        self.added = {t.content: k for k, t in added.items()}
        # The longest of several that begin at a place.
        self.find_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        merges = self.encoder.merges
        self.bytes: list[bytes] = [b""] * (1 + max(merges.n_vocab - 1, *self.added.values(), 0))
        for token in merges.token_byte_values():
            self.bytes[merges.encode_single_token(token)] = token
        for content, k in self.added.items():
            self.bytes[k] = content.encode()
        self.digits = [str(k) for k in range(len(self.bytes))]

    def parts(self, text: str, leaf: int = LEAF) -> list[tuple[int, str]] | None:
        """The parts of a text that has an added token or a long stretch: (_TEXT, _JOINED or _ADDED, part), where a joined part
        goes on the stretch of the one before. None for any other text."""
        added = list(self.find_added.finditer(text))
        if not added and len(text) <= leaf:
            return None
        out, at = [], 0
        for m in added:
            out += self._stretches(text[at : m.start()], leaf)
            out.append((_ADDED, m[0]))
            at = m.end()
        rest = self._stretches(text[at:], leaf)
        return out + rest if out or len(rest) > 1 else None

    def _stretches(self, text: str, leaf: int) -> list[tuple[int, str]]:
        if len(text) <= leaf:
            return [(_TEXT, text)] if text else []
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = classes()[code]
        runs = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        if np.diff(np.append(runs, len(code))).max() <= leaf or (kind == UNSURE).any():
            return [(_TEXT, text)]
        at = borders(code, kind, np.zeros(1, np.int64))
        out, done = [], 0
        for k in np.flatnonzero(np.diff(at) > leaf):
            a, b = int(at[k]), int(at[k + 1])
            if a > done:
                out.append((_TEXT, text[done:a]))
            out += [(_JOINED if n else _TEXT, x) for n, x in enumerate(halved(text[a:b], leaf))]
            done = b
        return out + [(_TEXT, text[done:])] * (done < len(text))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        return self.encoder.encode(texts)

    def _starts_within(self, token: int) -> bool:
        """Whether a token begins in the middle of a character."""
        return self.bytes[token][0] & 0xC0 == 0x80

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens of a stretch from those of its two parts."""
        reach = 1
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            while i > 0 and self._starts_within(left[i]):
                i -= 1
            while j < len(right) and self._starts_within(right[j]):
                j += 1
            between = b"".join(self.bytes[t] for t in (*left[i:].tolist(), *right[:j].tolist()))
            anew = np.array(self.encoder.merges.encode_ordinary(between.decode()), np.uint32)
            if (i == 0 or anew[0] == left[i]) and (j == len(right) or anew[-1] == right[j - 1]):
                return np.concatenate([left[:i], anew, right[j:]])
            reach *= 2

    def concatenate(self, parts: list[np.ndarray]) -> np.ndarray:
        """The tokens of a stretch from those of its parts, joined two by two."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def whole(self, kinds: list[int], parts: list[np.ndarray]) -> np.ndarray:
        """The tokens of a text from those of its parts."""
        heads = [k for k, kind in enumerate(kinds) if kind != _JOINED] + [len(kinds)]
        stretches = [self.concatenate(parts[a:b]) for a, b in zip(heads, heads[1:], strict=False)]
        return np.concatenate(stretches) if stretches else np.zeros(0, np.uint32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def told(self, ids: np.ndarray, with_ids: bool) -> tuple:
        """Number and digest of the ids, digest of the decoded text[, ids, decoded text]."""
        numbers = ids.tolist()
        text = self.decode(numbers)
        joined = ",".join(map(self.digits.__getitem__, numbers))
        out = len(numbers), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        return (*out, numbers, text) if with_ids else out


def halved(text: str, leaf: int) -> list[str]:
    """`text` halved until no part is longer than `leaf`."""
    parts = [text]
    while max(map(len, parts)) > leaf:
        parts = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :])]
    return parts


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The one codec of this process for a file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = True, leaf: int = LEAF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each document, without what a post-processor adds.

    `tokenizer` is a file of a byte-level BPE tokenizer that every executor has. ids_sha256: of the decimal ids joined by
    commas; decoded_sha256: of the text that the ids decode to.
    """
    told = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32()), pa.string()] * with_ids]
    names = [f.split()[0] for f in told.split(", ")]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def told_batch(ids: pa.Array, rows: list[tuple], more: dict[str, pa.Array]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([ids, *columns, *more.values()], ["doc_id", *names, *more])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encodes what needs no tree; other texts go on as parts."""
        own = codec(tokenizer)
        for batch in batches:
            parts = [own.parts(t, leaf) for t in batch.column("text").to_pylist()]
            plain = np.flatnonzero([p is None for p in parts])
            column = batch.column("text").take(pa.array(plain))
            done = [own.told(ids, with_ids) for ids in own.encode_all(column)]
            none = lambda n, t: pa.nulls(n, t)
            yield told_batch(batch.column("doc_id").take(pa.array(plain)), done, {"row": none(len(plain), pa.int64()), "part": none(len(plain), pa.int32()), "kind": none(len(plain), pa.int32()), "text": none(len(plain), pa.string())})
            for k in np.flatnonzero([p is not None for p in parts]).tolist():
                n = len(parts[k])
                row, i = batch.column("row").take(pa.array([k] * n)), batch.column("doc_id").take(pa.array([k] * n))
                more = {"row": row, "part": pa.array(range(n), pa.int32()), "kind": pa.array([p[0] for p in parts[k]], pa.int32()), "text": pa.array([p[1] for p in parts[k]])}
                yield told_batch(i, [(None,) * len(kinds)] * n, more)

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            body, kind_of = batch.column("text"), batch.column("kind").to_pylist()
            ids = [np.array([own.added[t.as_py()]], np.uint32) if k == _ADDED else x for x, t, k in zip(own.encode_all(body), body, kind_of, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "part", "kind", "doc_id")), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["row", "part", "kind", "doc_id", "ids"])

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, held, of = codec(tokenizer), None, [], None
        for batch in batches:
            for k, row in enumerate(batch.column("row").to_pylist()):
                if row != now:
                    if held:
                        yield told_batch(of, [own.told(own.whole(*map(list, zip(*held, strict=True))), with_ids)], {})
                    now, held, of = row, [], batch.column("doc_id").slice(k, 1)
                held.append((batch.column("kind")[k].as_py(), batch.column("ids")[k].values.to_numpy().astype(np.uint32)))
        if held:
            yield told_batch(of, [own.told(own.whole(*map(list, zip(*held, strict=True))), with_ids)], {})

    scratch = Scratch(docs.sparkSession)
    begun = scratch.table("begun", rows.mapInArrow(first, f"doc_id {kind}, {told}, row bigint, part int, kind int, text string"))
    parts = begun.where("part is not null").select("row", "part", "kind", "doc_id", "text").repartition("row", "part")
    encoded = parts.mapInArrow(encode_parts, f"row bigint, part int, kind int, doc_id {kind}, ids array<int>")
    joined = encoded.repartition("row").sortWithinPartitions("row", "part").mapInArrow(join_parts, f"doc_id {kind}, {told}")
    return begun.where("part is null").select("doc_id", *names).union(joined)
