"""Dictionary slots from text files, JSON bundles and pairs, and JSON bundles from slots.

Dictionaries are small driver-side configuration (a few thousand pairs), which the converters broadcast. Their files
are a parameter: this repository ships a short example set only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

#: The names of the slots, in the order of a bundle.
SLOTS = (
    "st_characters st_phrases st_punctuations ts_characters ts_phrases ts_punctuations "
    "tw_phrases tw_phrases_rev tw_variants tw_variants_phrases tw_variants_rev tw_variants_rev_phrases "
    "hk_phrases hk_phrases_rev hk_variants hk_variants_phrases hk_variants_rev hk_variants_rev_phrases "
    "jps_characters jps_characters_rev jps_phrases"
).split()
#: What counts as white space at a line's ends: no-break spaces don't.
_BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f               　"


def slot_name(text: str) -> str:
    """The slot of a name, in any case and with blanks around it."""
    name = text.strip().lower()
    if name not in SLOTS:
        raise ValueError(f"unknown dictionary slot: {text!r}")
    return name


def parse_text(lines: Iterable[str]) -> dict[str, str]:
    """Pairs of a text dictionary: key, tab, value and other candidates, of which the first counts;
    blanks before it are skipped.

    Blank lines and those that begin with # or // are comments; a byte order mark may open the first line; lines
    without a key or value are skipped; a later line replaces an earlier one of the same key.
    """
    pairs: dict[str, str] = {}
    for k, line in enumerate(lines):
        line = (line.removeprefix("﻿") if not k else line).strip(_BLANK)
        if not line or line.startswith(("#", "//")):
            continue
        key, tab, rest = line.partition("\t")
        value = re.split("[ \t]+", rest.lstrip(" \t"))[0] if tab else ""
        if key and value:
            pairs[key] = value
    return pairs


def read_text(path: str | Path) -> dict[str, str]:
    return parse_text(Path(path).read_text("utf-8").split("\n"))


def units(text: str) -> int:
    """Length in UTF-16 units, in which dictionary bounds are stated."""
    return len(text.encode("utf-16-le")) // 2


def bounds(pairs: Mapping[str, str]) -> tuple[int, int]:
    """(longest, shortest) key; an empty slot has (0, 0)."""
    sizes = [units(k) for k in pairs]
    return (max(sizes), min(sizes)) if sizes else (0, 0)


def write_bundle(slots: Mapping[str, Mapping[str, str]], pretty: bool = False, sort: bool = True) -> str:
    """A JSON bundle: slot to [pairs, longest, shortest]; slots in their fixed order."""
    body = {name: [dict(sorted(slots[name].items())) if sort else dict(slots[name]), *bounds(slots[name])] for name in SLOTS if name in slots}
    return json.dumps(body, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))


def read_bundle(text: str) -> dict[str, dict[str, str]]:
    """Slots of a JSON bundle; older bundles lack the shortest length. Unknown slots are left out, null ones too."""
    out: dict[str, dict[str, str]] = {}
    for name, entry in json.loads(text).items():
        if name not in SLOTS or entry is None:
            continue
        if not isinstance(entry, list) or len(entry) not in (2, 3) or not isinstance(entry[0], dict) or not all(isinstance(x, int) for x in entry[1:]):
            raise ValueError(f"slot {name}: [pairs, longest, shortest] expected")
        longest, shortest = entry[1], entry[2] if len(entry) == 3 else int(bool(entry[0]))
        if shortest < 0 or longest < shortest:
            raise ValueError(f"slot {name}: lengths {shortest} to {longest}")
        out[name] = {str(k): str(v) for k, v in entry[0].items()}
    return out


@dataclass(frozen=True)
class CustomSpec:
    """Pairs for one slot, from files and then from `pairs`, that are put over its own or replace them."""

    slot: str
    mode: str
    paths: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        slot_name(self.slot)
        if self.mode not in ("append", "override"):
            raise ValueError(f"append or override expected, not {self.mode!r}")
        if not self.paths and not self.pairs:
            raise ValueError("a spec needs paths or pairs")
        if not all(p.strip() for p in self.paths):
            raise ValueError("a path is empty")

    @classmethod
    def parse(cls, text: str) -> CustomSpec:
        """`<slot>:<append|override>:<path>`; the path may have colons."""
        parts = text.split(":", 2)
        if len(parts) != 3 or not parts[2].strip():
            raise ValueError(f"<slot>:<append|override>:<path> expected, not {text!r}")
        mode = parts[1].strip().lower()
        if mode not in ("append", "override"):
            raise ValueError(f"append or override expected, not {parts[1]!r}")
        return cls(slot_name(parts[0]), mode, (parts[2].strip(),))

    @classmethod
    def from_files(cls, slot: str, paths: Sequence[str | Path], mode: str = "append") -> CustomSpec:
        """Files that are read in order; later ones win. Whether they exist is seen when the spec is applied."""
        return cls(slot_name(slot), mode, tuple(str(p).strip() for p in paths))

    @classmethod
    def from_file(cls, slot: str, path: str | Path, mode: str = "append") -> CustomSpec:
        return cls.from_files(slot, [path], mode)

    @classmethod
    def from_pairs(cls, slot: str, pairs: Mapping[str, str], mode: str = "append") -> CustomSpec:
        if not pairs or not all(pairs):
            raise ValueError("pairs with keys expected")
        return cls(slot_name(slot), mode, (), tuple(pairs.items()))


def apply_specs(slots: Mapping[str, Mapping[str, str]], specs: Iterable[CustomSpec]) -> dict[str, dict[str, str]]:
    """A copy of `slots` with the specs applied in order; later pairs win."""
    out = {k: dict(v) for k, v in slots.items()}
    for spec in specs:
        own = dict(out.get(spec.slot, {})) if spec.mode == "append" else {}
        for path in spec.paths:
            own |= read_text(path)
        out[spec.slot] = own | dict(spec.pairs)
    return out


#: A short example set of regional variants and phrases.
EXAMPLES = {
    "tw_variants": "僞偽 啓啟 喫吃 峯峰 擡抬 污汙 爲為 牀床 癡痴 祕秘 竈灶 糉粽 纔才 羣群 脣唇 衆眾 裏裡 鉢缽 麪麵 麼麼",
    "tw_variants_rev": "偽僞 啟啓 吃喫 峰峯 抬擡 為爲 床牀 痴癡 秘祕 灶竈 才纔 群羣 唇脣 眾衆 裡裏 麵麪",
    "tw_variants_phrases": "喫茶小舖=喫茶小舖",
    "tw_variants_rev_phrases": "一吃=一喫 才能=才能 群島=羣島 人才=人才 秘魯=祕魯 吃茶小舖=喫茶小舖",
    "tw_phrases": "信息=資訊 軟件=軟體 網絡=網路 數據庫=資料庫 操作系統=作業系統 打印機=印表機 光標=游標 出租車=計程車",
    "tw_phrases_rev": "資訊=信息 軟體=軟件 網路=網絡 資料庫=數據庫 作業系統=操作系統 印表機=打印機 游標=光標 計程車=出租車",
    "hk_variants": "僞偽 啓啟 喫吃 峯峰 爲為 牀床 癡痴 衆眾 裏裏 麪麪 羣群 綫線 污污 擡抬",
    "hk_variants_rev": "偽僞 啟啓 吃喫 峰峯 為爲 床牀 痴癡 眾衆 群羣 線綫",
    "hk_variants_phrases": "無線新聞台=無綫新聞台 喫茶小舖=喫茶小舖",
    "hk_variants_rev_phrases": "一吃=一喫 群島=羣島 無綫新聞台=無線新聞台",
    "hk_phrases": "光標=游標 出租車=的士 打印機=打印機 硅谷=矽谷 數據庫=資料庫",
    "hk_phrases_rev": "游標=光標 的士=出租車 矽谷=硅谷 資料庫=數據庫",
    "jps_characters": "亜亞 悪惡 圧壓 医醫 囲圍 壱壹 栄榮 駅驛 円圓 応應 桜櫻 価價 会會 学學 楽樂 気氣 国國 県縣 体體 写寫",
    "jps_characters_rev": "亞亜 惡悪 壓圧 醫医 圍囲 壹壱 榮栄 驛駅 圓円 應応 櫻桜 價価 會会 學学 樂楽 氣気 國国 縣県 體体 寫写",
    "jps_phrases": "三国=三國 弁護士=辯護士 弁当=便當",
    "st_punctuations": "“「 ”」 ‘『 ’』",
    "ts_punctuations": "「“ 」” 『‘ 』’",
}


def example_slots() -> dict[str, dict[str, str]]:
    """The example set: pairs of two characters, or key=value."""
    split = lambda p: tuple(p.split("=")) if "=" in p else (p[0], p[1])
    return {slot: dict(split(p) for p in text.split()) for slot, text in EXAMPLES.items()}


#: Slots whose file may be missing; they are empty then.
OPTIONAL_FILES = ("hk_phrases", "hk_phrases_rev")
BUNDLE = "dictionary_maxlength.json"


def file_name(slot: str) -> str:
    """The usual name of a slot's text file, such as TWVariantsRev.txt of tw_variants_rev."""
    group, *rest = slot_name(slot).split("_")
    return ("JPShinjitai" if group == "jps" else group.upper()) + "".join(map(str.capitalize, rest)) + ".txt"


def load_folder(path: str | Path, files: Mapping[str, str] | None = None) -> dict[str, dict[str, str]]:
    """Slots from the text files of a folder; `files` says which file is which slot's, without it all have their usual names.

    Missing files are an error that names them, but for slots that may be missing."""
    where = {slot_name(s): Path(path) / n for s, n in (files if files is not None else {s: file_name(s) for s in SLOTS}).items()}
    missing = [f"{s} ({p})" for s, p in where.items() if s not in OPTIONAL_FILES and not p.exists()]
    if missing:
        raise FileNotFoundError(f"dictionary files are missing: {', '.join(missing)}")
    return {s: read_text(p) if p.exists() else {} for s, p in where.items()}


def load_default(path: str | Path | None = None) -> dict[str, dict[str, str]]:
    """Slots of a JSON bundle, or of a folder: its bundle if it has one, else its text files. The example set without a path."""
    if path is None:
        return example_slots()
    path = Path(path)
    bundle = path / BUNDLE if path.is_dir() else path
    return read_bundle(bundle.read_text("utf-8")) if bundle.exists() else load_folder(path)
