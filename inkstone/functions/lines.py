"""Lines of many texts in arrays, and their classes for the paragraph rules (see `reflow`), without a Python call for an ordinary line.

The lines of a chunk are one array of code points and their borders. A table has, for each code point, a bit for each set of
characters that the rules ask of; what a line ends and begins with, and whether it has brackets or marks, is read off by arrays.
Only lines that may be titles, headings, list items or dividers, or that may say something three times, are looked at as strings.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cached_property

import numpy as np

#: White space, and Han characters of the basic plane, as contents of a character class.
BLANK = "\t-\r\x1c- \u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000"
HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
CONTROLS = "".join(map(chr, range(33)))
#: Marks.
CLAUSE_END = "。！？；：…—”’」』）】》〗〕］｝＞〉>.):!?"
SENTENCE_END = "。！？!?"
COMMAS = "，,、"
COLONS = "：:"
POSTFIX_CLOSERS = "）)"
DIALOG = {"“": "”", "‘": "’", "「": "」", "『": "』", "﹁": "﹂", "﹃": "﹄"}
BRACKETS = {"（": "）", "(": ")", "[": "]", "［": "］", "{": "}", "｛": "｝", "<": ">", "＜": "＞", "〈": "〉", "【": "】", "《": "》", "〔": "〕", "〖": "〗"}
#: Words that titles begin with, units of a book and what doesn't follow them, numerals.
TITLE_WORDS = tuple("目录 目錄 前言 序章 楔子 终章 尾声 尾聲 后记 後記 番外".split())
UNITS, NOT_AFTER_UNIT, NUMERALS = "章节部卷節回", "分合的", "一二三四五六七八九十"
CHAPTER_CLOSERS = "】》〗〕〉」』）}"
#: Signs of dividers and of list items.
DIVIDERS = "─-╿\\-=_~～*＊★☆"
BULLETS = "\\-*＊•‧▪◦○●※"
#: What a line of bibliographic data begins with, and what comes after it.
METADATA_KEYS = frozenset(
    """書名 书名 作者 譯者 译者 校訂 校订 出版社 出版時間 出版时间 出版日期 版權 版权 版權頁 版权页 版權信息 版权信息
    責任編輯 责任编辑 編輯 编辑 責編 责编 定價 定价 前言 序章 簡介 简介 終章 终章 尾聲 尾声 後記 后记
    品牌方 出品方 授權方 授权方 電子版權 数字版权 發行 发行 掃描 扫描 OCR CIP 在版編目 在版编目 分類號 分类号
    主題詞 主题词 類型 类型 標簽 标签 系列 發行日 发行日 初版 ISBN""".split()
)
SEPARATORS = "：:　·・"

NUMBER = f"[0-9０-９{NUMERALS}]"
_OPENERS, _CLOSERS = "".join(DIALOG), "".join(DIALOG.values())
_BRACKETS = re.escape("".join(BRACKETS) + "".join(BRACKETS.values()))
BLANKS = "".join(chr(k) for k in range(0x3001) if re.match(f"[{BLANK}]", chr(k)))

#: The patterns are matched at a place of a longer text, so they have no anchor in front.
LIST_START = re.compile(rf"[{BLANK}]*(?:[{BULLETS}][{BLANK}]|\({NUMBER}{{1,2}}\)|（{NUMBER}{{1,2}}）|{NUMBER}{{1,2}}(?:[)）、]|\.[ {HAN}]))")
LIST_NUMBER = re.compile(rf"[{BLANK}]*{NUMBER}{{1,2}}[)）]")
ENDS_CHAPTER = re.compile(f"[{UNITS}][{CHAPTER_CLOSERS}]*$")
ONLY_HAN = re.compile(f"[{HAN}{BLANK}]+")
ANY_HAN = re.compile(f"[{HAN}]")
_DIVIDER = re.compile(f"(?:[{BLANK}]*[{DIVIDERS}]){{3,}}[{BLANK}]*")
_NUMBERED = re.compile("~{0,10}第~{0,5}[%s][^%s]".replace("~", "[^\r\n\x85\u2028\u2029]") % (UNITS, NOT_AFTER_UNIT))
_METADATA = re.compile(f"([^{SEPARATORS}]{{1,10}})[{SEPARATORS}][{BLANK}]*([^{BLANK}])")
_UNIT = re.compile(r"(.{4,10}?)\1{2,}", re.S)
_BRACKET, _MARK = re.compile(f"[{_BRACKETS}]"), re.compile(f"[{_OPENERS}{_CLOSERS}]")
_HAN_THEN_ANY, _LATIN, _LATIN_OR_DIGIT = re.compile(f"[{HAN}]+.", re.S), re.compile("[A-Za-z]"), re.compile("[A-Za-z0-9０-９]")
_MIXED, _DIGITS = re.compile(f"[ \\-/:.A-Za-z0-9０-９{HAN}]*"), re.compile("[0-9]+")
_SPACES = re.compile("[ \t]+")

CODES = 0x110000
_SETS = (
    BLANK, HAN, "A-Za-z", _BRACKETS, _OPENERS + _CLOSERS, _OPENERS, _CLOSERS, " \t", POSTFIX_CLOSERS, COLONS, SENTENCE_END, CLAUSE_END, SENTENCE_END + COLONS + "…", DIVIDERS, f"0-9０-９{NUMERALS}{BULLETS}(（",
    "=卷章" + "".join(w[0] for w in TITLE_WORDS) + "".join(w[0] for w in sorted(METADATA_KEYS)), "第", UNITS + CHAPTER_CLOSERS, " \t-\r\u3000",
)
IS_BLANK, IS_HAN, IS_LETTER, IS_BRACKET, IS_MARK, IS_OPENER, IS_CLOSER, IS_SPACE, IS_POSTFIX, IS_COLON, IS_SENTENCE_END, IS_CLAUSE_END, IS_COMPLETE, IS_DIVIDER, BEGINS_ITEM, BEGINS_ALONE, BEGINS_NUMBER, ENDS_TITLE, IS_INDENT = (1 << k for k in range(len(_SETS)))


def _table() -> np.ndarray:
    """For each code point the bits of the sets that it is in; all of them are in the basic plane. The last row is no character."""
    plane, out = "".join(chr(k) if not 0xD800 <= k < 0xE000 else "\0" for k in range(0x10000)), np.zeros(CODES + 1, np.uint32)
    for k, characters in enumerate(_SETS):
        out[[m.start() for m in re.finditer(f"[{characters}]", plane)]] |= 1 << k
    return out


SETS = _table()

#: What the fold asks of a line. ENDS: a sentence has ended with it; ENDS_HAN: it has if the paragraph is mostly Han. NEAR: the
#: line is too short to tell by itself.
EMPTY, ALONE, HEADING, OPENS_DIALOG, LISTED, CLOSES, COMPLETE, INDENTED, HAS_BRACKETS, HAS_MARKS, CHAPTER, ENDS, ENDS_HAN, NEAR, FULL_STOP = (1 << k for k in range(15))


def open_brackets(brackets: Iterable[str]) -> bool:
    """Whether a bracket lacks its partner or closes another one's."""
    due: list[str] = []
    for mark in brackets:
        if mark in BRACKETS:
            due.append(BRACKETS[mark])
        elif not due or due.pop() != mark:
            return True
    return bool(due)


def open_quotes(marks: Iterable[str]) -> bool:
    """Whether a dialog mark lacks its partner."""
    depth = dict.fromkeys(_CLOSERS, 0)
    for mark in marks:
        closer = DIALOG.get(mark, mark)
        depth[closer] += 1 if mark in DIALOG else -1
        if depth[closer] < 0:
            return True
    return any(depth.values())


def collapse(line: str) -> str:
    """`line` with its first run of three or more equal phrases (up to 8 words) said once, and words that are a unit of 4 to
    10 characters three times or more as that unit; single spaces between words."""
    words = _SPACES.split(line.strip(CONTROLS))
    if len(words) - len(set(words)) >= 2:
        words = _once(words)
    return " ".join(m[1] if 12 <= len(w) <= 200 and (m := _UNIT.fullmatch(w)) else w for w in words)


def _once(words: list[str]) -> list[str]:
    n = len(words)
    for start in range(n - 2):
        for size in range(1, min(8, (n - start) // 3) + 1):
            if words[start] == words[start + size] == words[start + 2 * size]:
                phrase, end = words[start : start + size], start + size
                while words[end : end + size] == phrase:
                    end += size
                if end >= start + 3 * size:
                    return words[: start + size] + words[end:]
    return words


def is_title(line: str) -> bool:
    """Whether a short line names a part of a book: by its first word, or by a number and a unit at its beginning."""
    if len(line) > 50 or "," in (later := line[20:50]) or "，" in later:
        return False
    return line.startswith(TITLE_WORDS) or (line[:1] in ("卷", "章") and line[1:2] != "" and line[1:2] in NUMERALS) or _NUMBERED.match(line) is not None


def is_metadata(line: str) -> bool:
    """Whether a short line is bibliographic data: a known key, a separator, and a value that is no dialog."""
    m = _METADATA.match(line) if len(line) <= 30 else None
    return m is not None and m[1].strip(CONTROLS) in METADATA_KEYS and m[2] not in DIALOG


def is_page_mark(line: str) -> bool:
    return line.startswith("=== ") and line.endswith("===")


def _stands_alone(line: str) -> bool:
    return is_page_mark(line) or is_title(line.lstrip(" \u3000")) or is_metadata(line)


def is_heading(line: str) -> bool:
    """Whether a short line looks like a heading by itself."""
    s = line.strip(CONTROLS)
    if not s or is_page_mark(s):
        return False
    n, last = len(s), s[-1]
    enclosed = BRACKETS.get(s[0]) == last
    if n > 16 and not enclosed and last not in POSTFIX_CLOSERS:
        return False
    if open_brackets(_BRACKET.findall(s)) or open_quotes(_MARK.findall(s)):
        return False
    if n > 2 and enclosed and 0 < (han := len(ANY_HAN.findall(s))) >= len(_LATIN.findall(s)):
        return True
    short = n <= 8
    if 8 < n <= 16:
        head = _MIXED.match(s)[0]
        short = s.isascii() or (ANY_HAN.search(head) is not None and _LATIN_OR_DIGIT.search(head) is not None)
    if short and last in COLONS and _HAN_THEN_ANY.fullmatch(s):
        return True
    if last in POSTFIX_CLOSERS and not any(c in s for c in COMMAS):
        return True
    if last in CLAUSE_END or not short:
        return False
    if s.isascii():
        return _DIGITS.fullmatch(s) is not None or _LATIN.search(s) is not None
    return last not in COMMAS


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def string(code: np.ndarray) -> str:
    return code.astype("<u4", copy=False).tobytes().decode("utf-32-le")


def split(code: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the lines of the texts `code[edges[k]:edges[k + 1]]`, and each text's first line, with the number of
    lines at the end. A line ends with CR LF, CR or LF."""
    at = np.flatnonzero((code == 10) | (code == 13))
    width = np.ones(len(at), np.int64)
    second = np.zeros(len(at), bool)
    second[1:] = (at[1:] == at[:-1] + 1) & (code[at[1:]] == 10) & (code[at[:-1]] == 13)
    if second.any():
        border = np.zeros(len(code) + 1, bool)
        border[edges] = True
        second &= ~border[at]
        width[:-1] += second[1:]
        at, width = at[~second], width[~second]
    each = np.diff(np.searchsorted(at, edges))
    first = np.append(0, np.cumsum(each + 1))
    begins, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    line = np.arange(len(at)) + np.repeat(np.arange(len(each)), each)
    ends[line], begins[line + 1] = at, at + width
    begins[first[:-1]], ends[first[1:] - 1] = edges[:-1], edges[1:]
    return begins, ends, first


def _within(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places are in one of the stretches, which don't overlap."""
    some = ends > begins
    mark = np.zeros(n + 1, np.int8)
    mark[begins[some]] += 1
    mark[ends[some]] -= 1
    return np.cumsum(mark[:n], dtype=np.int8).view(bool)


def counted(which: np.ndarray) -> np.ndarray:
    """How many are true before each place and at the end."""
    out = np.zeros(len(which) + 1, np.int32)
    out[1:] = which
    return np.cumsum(out, out=out)


def _says_again(code: np.ndarray, sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lines that `collapse` may change, and a few others: words are told apart by their lengths and their first and last characters."""
    space = (sets & IS_SPACE) != 0
    hits = [np.flatnonzero(space[:-1] & (space[1:] | (code[:-1] == 9)))]
    border = np.zeros(len(code) + 1, bool)
    border[at] = True
    after, before = border[:-1].copy(), border[1:].copy()
    after[1:] |= space[:-1]
    before[:-1] |= space[1:]
    begin, end = np.flatnonzero(~space & after), np.flatnonzero(~space & before) + 1
    size = end - begin
    key = (size << 42) | (code[begin].astype(np.int64) << 21) | code[end - 1]
    line = lambda place: np.searchsorted(at, place, side="right") - 1
    for k in range(1, 9):
        if len(key) < 3 * k:
            break
        same = key[:-k] == key[k:]
        hit = np.flatnonzero(same[:-k] & same[k:])
        hit = hit[hit + 2 * k <= len(same)]
        for j in range(1, k):
            hit = hit[same[hit + j] & same[hit + j + k]]
        hits.append(begin[hit[line(begin[hit]) == line(begin[hit + 3 * k - 1])]])
    long = (size >= 12) & (size <= 200)
    begin, end, size = begin[long], end[long], size[long]
    for k in range(4, 11):
        may = (size % k == 0) & (size >= 3 * k)
        b, e = begin[may], end[may]
        hits.append(b[(code[b] == code[b + k]) & (code[b] == code[b + 2 * k]) & (code[b + 1] == code[b + k + 1]) & (code[e - 1] == code[e - 1 - k])])
    return np.unique(line(np.concatenate(hits)))


def _clean(code: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points and borders of the lines as they go into paragraphs, which of them are dividers, and which are indented."""
    n, sets = len(code), SETS[code]
    if not n:
        none = np.zeros(len(begins), bool)
        return code, np.zeros(len(begins) + 1, np.int64), none, none
    solid = (sets & IS_BLANK) == 0
    count, place = counted(solid), np.append(np.flatnonzero(solid), n)
    low, high = count[begins], count[ends]
    some = high > low
    begin, end = begins.copy(), np.where(some, place[high - 1] + 1, begins)
    spaced = np.flatnonzero(some & (code[np.minimum(begin, n - 1)] == 32))
    if len(spaced):
        other = np.flatnonzero(code != 32)
        begin[spaced] = other[np.searchsorted(other, begin[spaced])]
    indented = (ends - begins >= 2) & ((sets[np.minimum(begins, n - 1)] & sets[np.minimum(begins + 1, n - 1)] & IS_INDENT) != 0)
    divider = np.zeros(len(begins), bool)
    for k in np.flatnonzero(some & ((sets[np.minimum(place[low], n - 1)] & sets[end - 1] & IS_DIVIDER) != 0)).tolist():
        divider[k] = _DIVIDER.fullmatch(string(code[begin[k] : end[k]])) is not None
    for k in np.flatnonzero(some & ~divider & ((code[np.minimum(begin, n - 1)] < 33) | (code[end - 1] < 33))).tolist():
        line = string(code[begin[k] : end[k]]).rstrip(CONTROLS)
        end[k] = begin[k] + len(line)
        begin[k] += len(line) - len(line.lstrip(CONTROLS))
    kept = _within(n, begin, end)
    code, sets, at = code[kept], sets[kept], np.append(0, np.cumsum(end - begin))
    if len(code):
        again = _says_again(code, sets, at)
        code, at = _rewritten(code, at, again[~divider[again]])
    return code, at, divider, indented


def _rewritten(code: np.ndarray, at: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All lines, those of the numbers `lines` collapsed."""
    if not len(lines):
        return code, at
    new = [code_points(collapse(string(code[at[k] : at[k + 1]]))) for k in lines.tolist()]
    size = np.diff(at)
    size[lines] = [len(x) for x in new]
    to = np.append(0, np.cumsum(size))
    made, other = np.empty(to[-1], np.uint32), _within(int(to[-1]), to[lines], to[lines + 1])
    made[~other] = code[~_within(len(code), at[lines], at[lines + 1])]
    made[other] = np.concatenate(new)
    return made, to


class Lines:
    """The lines from `begins` to `ends` of `code`, cleaned, and their classes in `codes`. `before`: the end of a paragraph that is
    open, which becomes the line 0."""

    def __init__(self, code: np.ndarray, begins: np.ndarray, ends: np.ndarray, before: str = ""):
        code, at, divider, indented = _clean(code, begins, ends)
        if before:
            code = np.concatenate((code_points(before), code))
            at = np.append(0, at + len(before))
            divider, indented = np.append(False, divider), np.append(False, indented)
        self.text = string(code)
        sets = SETS[code]
        begin, end, n = at[:-1], at[1:], len(code)
        size = end - begin
        # Behind the last character stands one that is in no set, also at -1.
        code, sets = np.append(code, CODES), np.append(sets, np.uint32(0))
        solid = (sets[:-1] & IS_BLANK) == 0
        count = counted(solid)
        place = np.concatenate(([-1, -1], np.flatnonzero(solid), [n]))
        low, high = count[begin], count[end]
        some, first, last, second = high > low, place[low + 2], place[high + 1], place[high]
        right_before = lambda x: np.where(x > 0, x - 1, -1)
        of_last, own = sets[last], np.where(some, sets[last], 0)
        dots = (code[last] == ord(".")) & (code[right_before(last)] == ord("."))
        closed = (of_last & (IS_POSTFIX | IS_CLOSER)) != 0
        han = lambda x: (sets[right_before(x)] & IS_HAN) != 0
        stop = (of_last & IS_SENTENCE_END) != 0
        brackets, marks = np.flatnonzero(sets & IS_BRACKET), np.flatnonzero(sets & IS_MARK)
        bracket_at, mark_at = np.searchsorted(brackets, at), np.searchsorted(marks, at)
        codes = np.zeros(len(size), np.int32)
        for bit, which in (
            (EMPTY, size == 0),
            (ALONE, divider),
            (OPENS_DIALOG, some & ((sets[first] & IS_OPENER) != 0)),
            (CLOSES, (own & IS_CLOSER) != 0),
            (COMPLETE, ((own & IS_COMPLETE) != 0) | (some & dots & (last > begin))),
            (INDENTED, indented),
            (HAS_BRACKETS, np.diff(bracket_at) > 0),
            (HAS_MARKS, np.diff(mark_at) > 0),
            (CHAPTER, (size > 0) & ((sets[end - 1] & ENDS_TITLE) != 0)),
            (ENDS, stop | (code[last] == ord("…")) | dots | (closed & ((sets[second] & IS_SENTENCE_END) != 0))),
            (ENDS_HAN, (((code[last] == ord(".")) | (code[last] == ord(":"))) & han(last)) | (closed & (code[second] == ord(".")) & han(second)) | ((of_last & IS_COLON) != 0)),
            (NEAR, second <= begin),
            (FULL_STOP, stop),
        ):
            codes[which] |= bit
        text, borders = self.text, at.tolist()

        def look(may: np.ndarray, bit: int, test) -> None:
            codes[[k for k in np.flatnonzero(may).tolist() if test(k)]] |= bit

        named = some & ((sets[first] & BEGINS_ALONE) != 0)
        named[np.searchsorted(at, np.flatnonzero(sets & BEGINS_NUMBER), side="right") - 1] = True
        look(named & ~divider, ALONE, lambda k: _stands_alone(text[borders[k] : borders[k + 1]]))
        look(some & ((sets[first] & BEGINS_ITEM) != 0), LISTED, lambda k: LIST_START.match(text, borders[k], borders[k + 1]) is not None)
        ends_with = sets[end - 1]
        paired = (sets[begin] & ends_with & IS_BRACKET) != 0
        short = (size <= 16) & (((ends_with & IS_CLAUSE_END) == 0) | ((ends_with & IS_COLON) != 0))
        look((size > 0) & ((codes & ALONE) == 0) & (short | paired | ((ends_with & IS_POSTFIX) != 0)), HEADING, lambda k: is_heading(text[borders[k] : borders[k + 1]]))
        self.codes, self.at, self.first, self.last, self.second = codes.tolist(), borders, first.tolist(), last.tolist(), second.tolist()
        self._sets, self._at = sets[:-1], at
        self._brackets, self._marks = string(code[brackets]), string(code[marks])
        self._bracket_at, self._mark_at = bracket_at.tolist(), mark_at.tolist()

    @cached_property
    def han(self) -> list[int]:
        """How many Han characters there are before each line, and in all."""
        return counted((self._sets & IS_HAN) != 0)[self._at].tolist()

    @cached_property
    def letters(self) -> list[int]:
        """How many letters there are before each line, and in all."""
        return counted((self._sets & IS_LETTER) != 0)[self._at].tolist()

    def brackets(self, k: int) -> str:
        return self._brackets[self._bracket_at[k] : self._bracket_at[k + 1]]

    def marks(self, k: int) -> str:
        return self._marks[self._mark_at[k] : self._mark_at[k + 1]]

    def opens_bracket(self, k: int) -> bool:
        """Whether a bracket of a line is open, but for the one of its list number."""
        brackets = self.brackets(k)
        if brackets and self.codes[k] & LISTED and LIST_NUMBER.match(self.text, self.at[k], self.at[k + 1]):
            brackets = brackets[1:]
        return open_brackets(brackets)

    def opens_quote(self, k: int) -> bool:
        return open_quotes(self.marks(k))
