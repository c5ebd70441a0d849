"""Conversion configurations: which slots each has, in rounds, and the checks on them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from inkstone.sources.dictionaries import bounds


def _variants(region: str, rev: bool, phrases: bool) -> tuple[str, ...]:
    end = "_rev" if rev else ""
    return (*[f"{region}_phrases{end}"] * phrases, f"{region}_variants{end}_phrases", f"{region}_variants{end}")


def _rounds() -> dict[str, tuple[tuple[str, ...], ...]]:
    st, ts = ("st_phrases", "st_characters"), ("ts_phrases", "ts_characters")
    out = {"s2t": (st,), "t2s": (ts,), "t2jp": (("jps_characters_rev",),), "jp2t": (("jps_phrases", "jps_characters"),)}
    for region in ("tw", "hk"):
        for phrases in (False, True):
            p = "p" * phrases
            there, back = _variants(region, False, phrases), _variants(region, True, phrases)
            out |= {f"s2{region}{p}": (st, there), f"{region}2s{p}": (back, ts), f"t2{region}{p}": (there,), f"{region}2t{p}": (back,)}
    return out


ROUNDS = _rounds()
CONFIGS = tuple(ROUNDS)
DEFAULT = "s2t"
#: Slots that may be missing.
OPTIONAL = {"hk_phrases", "hk_phrases_rev"}
#: A slot with a key of this many UTF-16 units or more is a phrase slot.
PHRASE_UNITS = 3
#: Characters that end a segment, which no key can cross.
DELIMITERS = frozenset(" \t\n\r!\"#$%&'()*+,-./:;<=>?@[\\]^_{}|~＝、。﹁﹂—－（）《》〈〉？！…／＼︒︑︔︓︿﹀︹︺︙︐［﹇］﹈︕︖︰︳︴︽︾︵︶｛︷｝︸﹃﹄【︻】︼　～．，；：")


def config_name(text: str | None) -> str:
    """The configuration of a name in any case, blanks around it aside."""
    name = (text or "").strip().lower()
    if name not in ROUNDS:
        raise ValueError(f"unknown configuration: {text!r}; known: {', '.join(sorted(CONFIGS))}")
    return name


def config_or_default(text: str | None) -> str:
    """As `config_name`, but unknown names and none mean the default."""
    name = (text or "").strip().lower()
    return name if name in ROUNDS else DEFAULT


@dataclass
class Round:
    """One pass of longest-match replacement."""

    pairs: dict[str, str] = field(default_factory=dict)

    @property
    def single(self) -> bool:
        """Whether every key is one code point, so that Spark's own `translate` can do it."""
        return all(len(k) == 1 for k in self.pairs)


def build_round(slots: list[Mapping[str, str]]) -> Round:
    """The pairs of a round: those of phrase slots at their lengths, then single code points of the others.

    An earlier slot's pair wins. A key that is a phrase slot's hides the same key elsewhere. Keys of other slots that
    aren't one code point are never looked up, and no key matches over a delimiter within it.
    """
    phrase = [s for s in slots if bounds(s)[0] >= PHRASE_UNITS]
    pairs: dict[str, str] = {}
    for slot in phrase:
        for key, value in slot.items():
            pairs.setdefault(key, value)
    for slot in slots:
        if bounds(slot)[0] < PHRASE_UNITS:
            for key, value in slot.items():
                if len(key) == 1:
                    pairs.setdefault(key, value)
    return Round({k: v for k, v in pairs.items() if not DELIMITERS & set(k[:-1])})


def plan(config: str, slots: Mapping[str, Mapping[str, str]], punctuation: bool = False) -> list[Round]:
    """The rounds of a configuration; a missing slot is an error unless it is optional."""
    name = config_name(config)
    out = []
    for names in ROUNDS[name]:
        if punctuation and names[0] in ("st_phrases", "ts_phrases"):
            names = (*names, f"{names[0][:2]}_punctuations")
        missing = [n for n in names if n not in slots and n not in OPTIONAL]
        if missing:
            raise ValueError(f"{name} needs the dictionary slots {', '.join(missing)}")
        out.append(build_round([slots[n] for n in names if n in slots]))
    return [r for r in out if r.pairs]


