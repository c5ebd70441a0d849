"""The paragraph rules over one whole text, as a plain loop that the Spark job is compared with."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: White space, and Han characters of the basic plane, as contents of a character class.
BLANK = "\t-\r\x1c- \u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000"
HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
BLANKS = "".join(chr(k) for k in range(0x3001) if re.match(f"[{BLANK}]", chr(k)))
CONTROLS = "".join(map(chr, range(33)))
#: Marks.
CLAUSE_END = set("。！？；：…—”’」』）】》〗〕］｝＞〉>.):!?")
SENTENCE_END = set("。！？!?")
COMMAS = set("，,、")
COLONS = set("：:")
POSTFIX_CLOSERS = set("）)")
DIALOG = {"“": "”", "‘": "’", "「": "」", "『": "』", "﹁": "﹂", "﹃": "﹄"}
#: The dialog marks that are followed from line to line.
FOLLOWED = {o: DIALOG[o] for o in "“‘「『"}
BRACKETS = {"（": "）", "(": ")", "[": "]", "［": "］", "{": "}", "｛": "｝", "<": ">", "＜": "＞", "〈": "〉", "【": "】", "《": "》", "〔": "〕", "〖": "〗"}
UNITS, NUMERALS = "章节部卷節回", "一二三四五六七八九十"
TITLE_WORDS = "目录 目錄 前言 序章 楔子 终章 尾声 尾聲 后记 後記 番外".split()


def is_title(s: str) -> bool:
    if len(s) > 50 or any(c in ",，" for c in s[20:]):
        return False
    if any(s.startswith(w) for w in TITLE_WORDS) or (s[:1] in ("卷", "章") and s[1:2] and s[1:2] in NUMERALS):
        return True
    for i, c in enumerate(s[:11]):
        if c == "第":
            for j in range(i + 1, min(i + 7, len(s) - 1)):
                if s[j] in UNITS and s[j + 1] not in "分合的":
                    return True
    return False


#: Patterns of dividers, list items and ends of chapter names.
DIVIDER = re.compile(f"^(?:[{BLANK}]*[─-╿\\-=_~～*＊★☆]){{3,}}[{BLANK}]*$")
NUMBER = "[0-9０-９一二三四五六七八九十]"
LIST_START = re.compile(rf"^[{BLANK}]*(?:[-*＊•‧▪◦○●※][{BLANK}]|\({NUMBER}{{1,2}}\)|（{NUMBER}{{1,2}}）|{NUMBER}{{1,2}}(?:[)）、]|\.[ {HAN}]))")
LIST_NUMBER = re.compile(rf"^[{BLANK}]*{NUMBER}{{1,2}}[)）]")
CHAPTER_END = re.compile("[章节部卷節回][】》〗〕〉」』）}]*$")
INDENT = re.compile("^[ \t-\r\u3000]{2,}")
#: What a line of bibliographic data begins with.
METADATA_KEYS = set(
    """書名 书名 作者 譯者 译者 校訂 校订 出版社 出版時間 出版时间 出版日期 版權 版权 版權頁 版权页 版權信息 版权信息
    責任編輯 责任编辑 編輯 编辑 責編 责编 定價 定价 前言 序章 簡介 简介 終章 终章 尾聲 尾声 後記 后记
    品牌方 出品方 授權方 授权方 電子版權 数字版权 發行 发行 掃描 扫描 OCR CIP 在版編目 在版编目 分類號 分类号
    主題詞 主题词 類型 类型 標簽 标签 系列 發行日 发行日 初版 ISBN""".split()
)
METADATA = re.compile(f"^([^：:　·・]{{1,10}})[：:　·・][{BLANK}]*([^{BLANK}])")

_BRACKET = re.compile("[" + re.escape("".join(BRACKETS) + "".join(BRACKETS.values())) + "]")
_MARK = re.compile("[" + "".join(DIALOG) + "".join(DIALOG.values()) + "]")
_TOKEN = re.compile(r"(.{4,10}?)\1{2,}", re.S)
_HAN, _LETTER, _ALL_HAN = re.compile(f"[{HAN}]"), re.compile("[A-Za-z]"), re.compile(f"[{HAN}]+")
_MIXED = re.compile(f"[ \\-/:.A-Za-z0-9０-９{HAN}]*")


def collapse(line: str) -> str:
    """`line` with its first run of three or more equal phrases (up to 8 words) said once, and words that are a unit
    of 4 to 10 characters three times or more as that unit; single spaces between words."""
    words = re.split("[ \t]+", line.strip(CONTROLS))

    def once() -> list[str]:
        for start in range(len(words) - 2):
            for size in range(1, min(8, (len(words) - start) // 3) + 1):
                phrase, end = words[start : start + size], start + size
                while words[end : end + size] == phrase:
                    end += size
                if end >= start + 3 * size:
                    return words[: start + size] + words[end:]
        return words

    if len(words) - len(set(words)) >= 2:
        words = once()
    return " ".join(m[1] if 12 <= len(w) <= 200 and (m := _TOKEN.fullmatch(w)) else w for w in words)


def last_mark(text: str, before: int | None = None) -> tuple[str, int]:
    """The last character that isn't blank, and its place; ("", -1) for none."""
    at = (len(text) if before is None else before) - 1
    while at >= 0 and text[at] in BLANKS:
        at -= 1
    return (text[at], at) if at >= 0 else ("", -1)


@dataclass
class _Nesting:
    """Brackets that are open, as texts come."""

    due: list[str] = field(default_factory=list)
    broken: bool = False

    def see(self, text: str) -> _Nesting:
        for mark in _BRACKET.findall(text):
            if mark in BRACKETS:
                self.due.append(BRACKETS[mark])
            elif not self.due or self.due.pop() != mark:
                self.broken = True
        return self

    @property
    def open(self) -> bool:
        return self.broken or bool(self.due)


def open_quote(text: str) -> bool:
    """Whether a dialog mark of the text lacks its partner."""
    depth = dict.fromkeys(DIALOG.values(), 0)
    for mark in _MARK.findall(text):
        closer = DIALOG.get(mark, mark)
        depth[closer] += 1 if mark in DIALOG else -1
        if depth[closer] < 0:
            return True
    return any(depth.values())


def mostly_han(han: int, letters: int) -> bool:
    return han > 0 and han >= letters


def _counts(text: str) -> tuple[int, int]:
    return len(_HAN.findall(text)), len(_LETTER.findall(text))


def is_metadata(line: str) -> bool:
    m = METADATA.match(line) if len(line) <= 30 else None
    return bool(m) and m[1].strip(CONTROLS) in METADATA_KEYS and m[2] not in DIALOG


def is_heading(line: str) -> bool:
    """Whether a short line looks like a heading by itself."""
    s = line.strip(CONTROLS)
    if not s or (s.startswith("=== ") and s.endswith("===")):
        return False
    first, last = s[0], s[-1]
    enclosed = BRACKETS.get(first) == last
    if len(s) > 16 and not enclosed and last not in POSTFIX_CLOSERS:
        return False
    if _Nesting().see(s).open or open_quote(s):
        return False
    if len(s) > 2 and enclosed and mostly_han(*_counts(s)):
        return True
    head = _MIXED.match(s)[0]
    mixed = bool(_HAN.search(head)) and bool(re.search("[A-Za-z0-9０-９]", head))
    short = len(s) <= (16 if s.isascii() or mixed else 8)
    if short and last in COLONS and _ALL_HAN.fullmatch(s[:-1]):
        return True
    if last in POSTFIX_CLOSERS and not COMMAS & set(s):
        return True
    if last in CLAUSE_END or not short:
        return False
    return bool(re.fullmatch("[0-9]+", s) or _LETTER.search(s)) if s.isascii() else last not in COMMAS


@dataclass
class _Line:
    """What the rules ask of a line."""

    text: str

    def __post_init__(self) -> None:
        t = self.text
        self.last, self.last_at = last_mark(t)
        self.listed = bool(LIST_START.match(t))
        self.dialog = t.lstrip(BLANKS)[:1] in DIALOG if t else False
        self.closes = self.last in set(DIALOG.values())
        numbered = LIST_NUMBER.match(t) if self.listed else None
        self.open_bracket = _Nesting().see(t[numbered.end() :] if numbered else t).open
        self.open_quote = open_quote(t)
        dots = self.last == "…" or (self.last == "." and t[self.last_at - 1 : self.last_at] == ".")
        self.complete = self.last in SENTENCE_END or self.last in COLONS or dots


class _Paragraph:
    """The text that is gathered, with what is open in it. The dialog outlives a paragraph only where a rule says so."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.clear_dialog()
        self._empty()

    def _empty(self) -> None:
        self.text, self.nesting, self.han, self.letters = "", _Nesting(), 0, 0

    def clear_dialog(self) -> None:
        self.depth = dict.fromkeys(FOLLOWED.values(), 0)

    @property
    def in_dialog(self) -> bool:
        return any(self.depth.values())

    @property
    def open_bracket(self) -> bool:
        return self.nesting.open

    def follow(self, line: str) -> None:
        for mark in _MARK.findall(line):
            closer = FOLLOWED.get(mark, mark)
            if closer in self.depth:
                self.depth[closer] = max(0, self.depth[closer] + (1 if mark in FOLLOWED else -1))

    def add(self, line: str) -> None:
        self.text += line
        self.nesting.see(line)
        han, letters = _counts(line)
        self.han, self.letters = self.han + han, self.letters + letters

    def end(self, clear: bool = True) -> None:
        """The paragraph is whole."""
        if self.text:
            self.out.append(self.text)
            self._empty()
            if clear:
                self.clear_dialog()

    def alone(self, line: str) -> None:
        """`line` is a paragraph of its own."""
        self.end()
        self.out.append(line)

    def ends_sentence(self) -> bool:
        last, at = last_mark(self.text)
        han = mostly_han(self.han, self.letters)
        if last in SENTENCE_END or last == "…" or self.text[max(0, at - 1) : at + 1] == "..":
            return True
        if last in (".", ":") and at > 0 and _HAN.match(self.text[at - 1]) and han:
            return True
        if last in POSTFIX_CLOSERS or last in set(DIALOG.values()):
            before, k = last_mark(self.text, at)
            if before in SENTENCE_END or (before == "." and k > 0 and _HAN.match(self.text[k - 1]) and han):
                return True
        return last in COLONS and han

    def is_bracketed(self) -> bool:
        """Whether the paragraph is Han text between one pair of brackets."""
        s = self.text.strip(BLANKS)
        if len(s) < 2 or BRACKETS.get(s[0]) != s[-1] or not s[1:-1].strip(BLANKS) or not mostly_han(*_counts(s[1:-1])):
            return False
        depth = 0
        for mark in re.findall("[" + re.escape(s[0] + s[-1]) + "]", s):
            depth += 1 if mark == s[0] else -1
            if depth < 0:
                return False
        return depth == 0


def _heads(p: _Paragraph, line: str) -> bool:
    """Whether a line that looks like a heading is one, after the paragraph so far."""
    last, _ = last_mark(p.text)
    if not p.text:
        return True
    if p.open_bracket:
        return False
    if not last:
        return True
    goes_on = bool(re.fullmatch(f"[{HAN}{BLANK}]+", line)) or last_mark(line)[0] in COLONS | POSTFIX_CLOSERS
    return last not in COMMAS and (not goes_on or last in CLAUSE_END)


def _blank(p: _Paragraph, headers: bool) -> None:
    """An empty line ends a paragraph; without page headers, only one that has ended its sentence."""
    if headers or not (p.in_dialog or p.open_bracket) and last_mark(p.text)[0] in SENTENCE_END:
        p.end()


def _starts(p: _Paragraph, line: _Line) -> None:
    """A line that opens a dialog or a list."""
    whole = (line.dialog and line.closes) or (line.listed and line.complete)
    if whole and not line.open_bracket and not line.open_quote:
        p.alone(line.text)
        p.clear_dialog()
        return
    last, _ = last_mark(p.text)
    in_list = line.listed and bool(LIST_START.match(p.text))
    if in_list or (last and not p.in_dialog and not p.open_bracket and last not in COMMAS and not _HAN.match(last)):
        p.end(clear=False)
    p.add(line.text)
    if line.dialog:
        p.clear_dialog()
    p.follow(line.text)


def _continues(p: _Paragraph, raw: str, line: _Line) -> None:
    """Any other line."""
    if line.complete and not line.closes and not line.open_quote:
        if p.text and not p.in_dialog and (not p.open_bracket or len(p.text) > 120):
            p.add(line.text)
            p.end()
            return
        if not p.text and not line.open_bracket:
            p.out.append(line.text)
            return
    if line.closes:
        before = last_mark(line.text, line.last_at)[0] or last_mark(p.text)[0]
        was_open = p.open_bracket
        p.add(line.text)
        p.follow(line.text)
        if not p.in_dialog and before in CLAUSE_END and (not was_open or line.open_bracket or len(p.text) > 120):
            p.end()
        return
    if p.text:
        ended = not p.in_dialog and ((not p.open_bracket and p.ends_sentence()) or p.is_bracketed())
        if ended or INDENT.match(raw) or (len(p.text) <= 12 and CHAPTER_END.search(p.text)):
            p.end()
    else:
        p.clear_dialog()
    p.add(line.text)
    p.follow(line.text)


def reflow(text: str, page_headers: bool = False, compact: bool = False) -> str:
    """`text` with its lines joined to paragraphs, an empty line between them unless `compact`.

    Dividers, page marks, titles and bibliographic data stay lines of their own; headings do where the paragraph before
    has ended. With `page_headers` every empty line ends a paragraph.
    """
    if not text.strip(CONTROLS):
        return ""
    p = _Paragraph()
    for raw in re.split("\r\n|\r|\n", text):
        line = raw.rstrip(BLANKS).lstrip(" ")
        if DIVIDER.match(line.lstrip(" \u3000")):
            p.alone(line)
            continue
        line = collapse(line)
        if not line:
            _blank(p, page_headers)
        elif (line.startswith("=== ") and line.endswith("===")) or is_title(line.lstrip(" \u3000")) or is_metadata(line) or (is_heading(line) and _heads(p, line)):
            p.alone(line)
        elif (seen := _Line(line)).dialog or seen.listed:
            _starts(p, seen)
        else:
            _continues(p, raw, seen)
    p.end()
    return ("\n" if compact else "\n\n").join(p.out)
