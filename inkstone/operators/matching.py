"""Longest-match replacement over whole Arrow buffers of text, without a Python call for a text or a match.

The keys are a trie in arrays: a table from code points to the nodes below the root, and an open-addressed hash table of the
edges (node, code point) below. The texts of a chunk are one array of code points; all places are walked down the trie
together, a depth at a time, and what is still alive shrinks with the depth. Of matches that overlap the leftmost counts,
then the next one that begins at its end or later; which these are is found by doubling jumps. One-character keys are
a table of code points. Edits are scattered into the output, and everything else is copied around them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa

CODES = 0x110000
#: Bytes of text that are worked on together; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
_EMPTY = np.uint64(2**64 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Edges:
    """(node, code point) → node, for arrays of both; 0 where there is no edge."""

    def __init__(self, edges: Mapping[tuple[int, int], int]):
        bits = max(4, (4 * len(edges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.int32)
        if not edges:
            return
        pairs = np.array(list(edges), np.uint64)
        self._insert((pairs[:, 0] << np.uint64(21)) | pairs[:, 1], np.fromiter(edges.values(), np.int32, len(edges)))

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = (keys * _SPREAD) >> self.shift
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == _EMPTY)
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            # Of several keys for a slot the last one written has it.
            lost = self.keys[slot] != keys
            keys, values, slot = keys[lost], values[lost], (slot[lost] + np.uint64(1)) & self.mask

    def follow(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        keys = (nodes.astype(np.uint64) << np.uint64(21)) | codes
        slot = (keys * _SPREAD) >> self.shift
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], 0)
        open_ = np.flatnonzero((there != keys) & (there != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != _EMPTY)]
        return out


class Matcher:
    """Replaces, from left to right, the longest key at each place.

    `lone`: characters that stay as they are, key or not, where a text begins with one or another of them is just before.
    """

    def __init__(self, pairs: Mapping[str, str], lone: frozenset[str] = frozenset()):
        single = {ord(k): v for k, v in pairs.items() if len(k) == 1}
        self.one = np.arange(CODES, dtype=np.uint32)  # code points that become one code point
        for k, v in single.items():
            if len(v) == 1:
                self.one[k] = ord(v)
        self.changes_one = any(len(v) == 1 and k != ord(v) for k, v in single.items())
        values, self.first, self.value_of = [""], np.zeros(CODES, np.int32), [0]
        nodes: dict[tuple[int, int], int] = {}
        for key, value in pairs.items():
            if len(key) < 2:
                continue
            node = int(self.first[ord(key[0])])
            if not node:
                node = self.first[ord(key[0])] = len(self.value_of)
                self.value_of.append(0)
            for c in key[1:]:
                below = nodes.get((node, ord(c)))
                if below is None:
                    below = nodes[node, ord(c)] = len(self.value_of)
                    self.value_of.append(0)
                node = below
            self.value_of[node] = len(values)
            values.append(value)
        self.edges, self.has_long = Edges(nodes), bool(nodes)
        self.value_of = np.array(self.value_of, np.int32)
        # One-character keys with values of another length are edits, too.
        self.other = np.zeros(CODES, np.int32)
        for k, v in single.items():
            if len(v) != 1:
                self.other[k] = len(values)
                values.append(v)
        self.has_other = bool(self.other.any())
        self.pool = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
        self.size = np.array([len(v) for v in values], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.lone = np.zeros(CODES, bool)
        self.lone[[ord(c) for c in lone]] = True
        self.has_lone = bool(lone)

    def _longest(self, code: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths and values of the longest keys of two characters or more at each place."""
        begun = np.flatnonzero(self.first[code[:-1]])
        node = self.edges.follow(self.first[code[begun]], code[begun + 1])
        alive = np.flatnonzero(node)
        begun, node = begun[alive], node[alive]
        # What is left is compared with the ends of the texts.
        limit = edges[np.searchsorted(edges, begun, side="right")]
        within = np.flatnonzero(begun + 1 < limit)
        begun, node, limit = begun[within], node[within], limit[within]
        value = self.value_of[node]
        length, place, number, depth = 2 * (value > 0), begun, np.arange(len(begun)), 2
        while len(number):
            within = np.flatnonzero(place + depth < limit)
            number, place, limit = number[within], place[within], limit[within]
            node = self.edges.follow(node[within], code[place + depth])
            alive = np.flatnonzero(node)
            number, place, limit, node = number[alive], place[alive], limit[alive], node[alive]
            depth += 1
            ends = self.value_of[node]
            found = np.flatnonzero(ends)
            length[number[found]], value[number[found]] = depth, ends[found]
        kept = np.flatnonzero(length)
        return begun[kept], length[kept], value[kept]

    def replace(self, code: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New code points and borders of the texts `code[edges[k]:edges[k + 1]]`; `edges` begins with 0 and ends with the size."""
        out = self.one[code] if self.changes_one else code
        alone = np.zeros(0, np.int64)
        if self.has_lone:
            hard = self.lone[code]
            before = np.zeros(len(code) + 1, bool)
            before[1:] = hard
            before[edges] = True
            alone = np.flatnonzero(hard & before[:-1])
            out = out.copy()
            out[alone] = code[alone]
        place, length, value = (np.zeros(0, np.int64),) * 3
        if self.has_long:
            place, length, value = self._longest(code, edges)
            kept = first_of_overlapping(place, length)
            if len(kept) < len(place):
                place, length, value = place[kept], length[kept], value[kept]
        if self.has_other:
            other = np.flatnonzero(self.other[code])
            if len(alone):
                other = other[~np.isin(other, alone)]
            if len(place) and len(other):  # not within a longer match
                last = np.searchsorted(place, other, side="right") - 1
                other = other[(last < 0) | (place[last] + length[last] <= other)]
            place, length, value = (np.concatenate(x) for x in ((place, other), (length, np.ones(len(other), np.int64)), (value, self.other[code[other]])))
            order = np.argsort(place, kind="stable")
            place, length, value = place[order], length[order], value[order]
        if not len(place):
            return out, edges
        size = self.size[value]
        gain = np.cumsum(size - length)
        begin = place + gain - (size - length)  # where each value goes
        stays = np.zeros(len(code) + 1, np.int8)
        stays[place] += 1
        stays[place + length] -= 1
        stays = np.cumsum(stays[:-1], dtype=np.int8) == 0
        stop = np.cumsum(size)
        to = np.arange(int(stop[-1])) - np.repeat(stop - size, size)
        made = np.empty(len(code) + int(gain[-1]), np.uint32)
        free = np.ones(len(made), bool)
        target = np.repeat(begin, size) + to
        made[target] = self.pool[np.repeat(self.begin[value], size) + to]
        free[target] = False
        made[free] = out[stays]
        upto = np.searchsorted(place, edges, side="left")
        return made, edges + np.append(0, gain)[upto]


def first_of_overlapping(place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes of the intervals, sorted by place, that stay if each one that begins within the one before is dropped."""
    n = len(place)
    if n < 2:
        return np.arange(n)
    reach = np.maximum.accumulate(place + length)
    starts = np.append(True, place[1:] >= reach[:-1])  # nothing before overlaps: these stay
    if starts.all():
        return np.arange(n)
    heads = np.flatnonzero(starts)
    longest = int(np.diff(np.append(heads, n)).max())
    jump = np.append(np.searchsorted(place, place + length), n)
    stays = np.append(starts, False)
    for _ in range(longest.bit_length()):
        stays[jump[np.flatnonzero(stays)]] = True
        stays[n] = False
        jump = jump[jump]
    return np.flatnonzero(stays[:n])


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes and borders of runs of texts; a null is empty."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def replace_all(texts: pa.Array, rounds: list[Matcher]) -> pa.Array:
    """`texts` (string or large_string) after all rounds; nulls stay null."""
    if not len(texts):
        return pa.array([], pa.string())
    bodies, sizes = [], []
    for data, edges in _chunks(texts):
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        if len(code) < len(data):  # borders in code points
            edges = np.append(0, np.cumsum((data & 0xC0) != 0x80))[edges]
        for matcher in rounds:
            code, edges = matcher.replace(code, edges)
        body = code.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode()
        if len(body) > len(code):
            width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            edges = np.append(0, np.cumsum(width))[edges]
        bodies.append(body)
        sizes.append(np.diff(edges))
    offsets = np.append(0, np.cumsum(np.concatenate(sizes)))
    valid = None if not texts.null_count else pa.array(texts.is_valid().to_numpy(zero_copy_only=False)).buffers()[1]
    out = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(b"".join(bodies)), valid)
    return out.cast(pa.string()) if offsets[-1] < 2**31 else out


_made: dict[str, list[Matcher]] = {}
KEPT = 32


def matchers(key: str, rounds: Callable[[], list[Mapping[str, str]]], lone: frozenset[str] = frozenset()) -> list[Matcher]:
    """The matchers of `rounds`, made once in a process for a key, so that the tasks of a worker share them."""
    if key not in _made:
        if len(_made) >= KEPT:
            _made.clear()
        _made[key] = [Matcher(pairs, lone) for pairs in rounds()]
    return _made[key]
