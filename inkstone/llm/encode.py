"""Token ids of a byte-level BPE tokenizer for whole Arrow columns, by distinct segments.

Merges never cross the borders of the pre-tokeniser's segments. So a chunk of texts is cut into segments by array
operations over code points, its distinct segments are encoded once, and ids are gathered back. Segments that were met
before are kept, up to a bound. The tokenizer itself encodes texts with code points whose class (letter, number,
space) is not the same in all Unicode versions.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from .scan import _BASE, _BASE_INVERSE, U, chunks, mix

KEPT_SEGMENTS = 200_000
CHUNK_BYTES = 1 << 19
OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)


@cache
def classes() -> np.ndarray:
    """The class of each code point; what Unicode 3.2 and this Python's version judge unlike is UNSURE."""

    def of(c: str, data) -> int:
        kind = data.category(c)
        return LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER

    old = unicodedata.ucd_3_2_0
    out = np.full(0x110000, OTHER, np.uint8)
    for k in range(0x30000):
        c = chr(k)
        now = of(c, unicodedata)
        out[k] = now if now == of(c, old) and (unicodedata.category(c) != "Cn") else UNSURE
    out[0x30000:] = UNSURE
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[spaces] = SPACE
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x180E, 0x200B]] = UNSURE
    return out


@cache
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters stand for
    themselves, the other bytes, in order, are the characters from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def borders(code: np.ndarray, kind: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where segments start. `edges`: where texts start; a segment ends with its text.

    The pattern is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
    """
    n = len(code)
    first = np.zeros(n + 1, bool)
    first[edges[edges < n]] = True
    first[n] = True
    run = first[:n].copy()  # a run of one class starts
    run[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(run)
    ends = np.append(starts[1:], n)
    spaces = kind[starts] == SPACE
    out = np.zeros(n + 1, bool)
    out[n] = True
    a, b = starts[spaces], ends[spaces]
    tail = first[b]  # the text ends with the spaces
    blank = code[b - 1] == 0x20
    out[a[tail]] = True
    out[a[~tail & (b - a > 1)]] = True
    out[(b - 1)[~tail]] = True  # alone, or, if it is a blank, before the next run
    joined = np.zeros(n + 1, bool)
    joined[b[~tail & blank]] = True
    words = starts[~spaces]
    out[words[~joined[words]]] = True
    # Contractions: an apostrophe of its own, not after a blank, before certain letters.
    apostrophe = words[(code[words] == 0x27) & ~joined[words]]
    apostrophe = apostrophe[apostrophe + 1 < n]
    apostrophe = apostrophe[(kind[apostrophe + 1] == LETTER) & ~first[apostrophe + 1]]
    if len(apostrophe):
        one = code[apostrophe + 1]
        after = np.minimum(apostrophe + 2, n - 1)
        two = np.where((apostrophe + 2 < n) & ~first[apostrophe + 2], code[after], 0)
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        size = np.where(short, 1, np.where(long, 2, 0))
        at, size = apostrophe[size > 0], size[size > 0]
        out[at + 1] = False
        rest = at + 1 + size
        within = rest < n
        rest = rest[within]
        rest = rest[(kind[rest] == LETTER) & ~first[rest]]
        out[rest] = True
    return np.flatnonzero(out)


@cache
def _code_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): k for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in byte for c in token)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {b: k for b, k in ranks.items() if b.decode("utf-8", "replace") not in special}
        # Ids ascend as merges are learnt, so they serve as the ranks of the merges.
        self.merges = tiktoken.Encoding("segments", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def places(self, found: np.ndarray, text: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place in the store of each distinct segment; new ones are encoded."""
        if len(self.known) > KEPT_SEGMENTS:
            self.forget()
        known, keys = self.known, found.tolist()
        out = np.array([known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            encode = self.merges.encode_ordinary
            ids = [encode(text[x:y]) for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True)]
            out[new] = np.arange(len(known), len(known) + len(new))
            known.update(zip(found[new].tolist(), out[new].tolist(), strict=True))
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32)])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array):
        """Yields the ids of each text in order; a null has none."""
        table = classes()
        for _, _, data, offsets in chunks(texts, CHUNK_BYTES):
            text = data.tobytes().decode()
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            lead = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))  # code points before each byte
            edges = lead[offsets]
            kind = table[code]
            unsure = np.unique(np.searchsorted(edges, np.flatnonzero(kind == UNSURE), side="right") - 1)
            at = borders(code, kind, edges[:-1])
            # Those of a longer text aren't kept.
            up, down = _code_powers(CHUNK_BYTES + 1) if len(code) <= CHUNK_BYTES else _code_powers.__wrapped__(len(code) + 1)
            total = np.zeros(len(code) + 1, np.uint64)
            np.cumsum((code + U(1)) * up[: len(code)], out=total[1:])
            a, b = at[:-1], at[1:]
            h = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
            found, where, number = np.unique(h, return_index=True, return_inverse=True)
            place = self.places(found, text, a[where], b[where])
            begin, size = self.begin[place], self.begin[place + 1] - self.begin[place]
            n = size[number]
            stop = np.cumsum(n)
            gather = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(begin[number] - (stop - n), n)
            out = self.flat[gather]
            upto = np.concatenate([[0], stop])[np.searchsorted(at, edges)] if len(at) > 1 else np.zeros(len(edges), np.int64)
            unsure = set(unsure.tolist())
            for d in range(len(edges) - 1):
                yield self.whole(text[edges[d] : edges[d + 1]]) if d in unsure else out[upto[d] : upto[d + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The one encoder of this process for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
