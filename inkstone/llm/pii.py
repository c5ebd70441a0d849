"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel permutations.

A value that passes its validation is permuted among the values of its own format: card numbers (Luhn), IBANs (mod 97),
social security numbers (issued ranges), telephone numbers, IPv4 addresses, calendar dates, names of mail addresses and
quoted access tokens. Equal values get equal pseudonyms in every document, however they are punctuated; different values get
different ones, and the key's owner can invert them. Two kinds of values may get another pseudonym than elsewhere, as
they couldn't be inverted otherwise: dates with the month first, and card numbers and IBANs that would form another
valid number with what stands next to them. Punctuation, letter case and length of a format stay.

Digits of any script count as the digits that they are, so a value set in full-width digits gets the pseudonym of the
same value in ASCII, written in the script of each place; where a pseudonym's digits are at other places (IPv4 addresses), in
the script of the value's first digit.

Edge cases: a null text stays null; what fails its validation stays as it is; repeated rows, null ids and extra columns
pass through; an empty table gives an empty result. A value in a format of one value only stays.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .scan import slices, tidy

ROUNDS = 8


class Permutation:
    """A keyed bijection of the numbers below any `size`: a Feistel network over the next even number of bits, walked
    until it falls below `size`."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds

    def _round(self, tweak: bytes, k: int, half: int, width: int) -> int:
        data = b"%d|%d|%d|" % (k, width, half) + tweak
        return int.from_bytes(hashlib.blake2b(data, key=self.key[:64], digest_size=(width + 7) // 8 + 8).digest(), "big") & ((1 << width) - 1)

    def _once(self, x: int, width: int, tweak: bytes, back: bool) -> int:
        left, right = x >> width, x & ((1 << width) - 1)
        for k in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = right ^ self._round(tweak, k, left, width), left
            else:
                left, right = right, left ^ self._round(tweak, k, right, width)
        return left << width | right

    def apply(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        if size < 2:
            return x
        width = max(1, ((size - 1).bit_length() + 1) // 2)
        x = self._once(x, width, tweak.encode(), back)
        while x >= size:
            x = self._once(x, width, tweak.encode(), back)
        return x


def luhn(digits: str) -> int:
    """The check digit that `digits` need."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 - k % 2)
        total += v - 9 * (v > 9)
    return -total % 10


def _refill(form: str, values: str) -> str:
    """`form` with its letters and digits replaced in order."""
    it = iter(values)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in form)


def _mixed(text: str, p: Permutation, tweak: str, back: bool) -> str:
    """Each ASCII letter stays a letter of its case and each digit a digit; the string is one number in mixed radix."""
    base = lambda c: 10 if c.isdigit() else 26
    low = lambda c: "0" if c.isdigit() else "a" if c.islower() else "A"
    chars = [c for c in text if c.isascii() and c.isalnum()]
    x, size = 0, 1
    for c in chars:
        x, size = x * base(c) + ord(c) - ord(low(c)), size * base(c)
    x = p.apply(x, size, tweak + "".join("0" if c.isdigit() else "a" for c in chars), back)
    out = []
    for c in reversed(chars):
        x, r = divmod(x, base(c))
        out.append(chr(ord(low(c)) + r))
    return _refill(text, "".join(reversed(out)))


def _card(s: str, p: Permutation, back: bool) -> str | None:
    digits = re.sub(r"\D", "", s)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    n = len(digits) - 1
    body = str(p.apply(int(digits[:-1]), 10**n, f"card{n}", back)).zfill(n)
    return _refill(s, body + str(luhn(body)))


def _number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s))


def _iban(s: str, p: Permutation, back: bool) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _mixed(flat[4:], p, "iban" + flat[:2], back)
    check = 98 - _number(body + flat[:2] + "00") % 97
    return _refill(s, f"{flat[:2]}{check:02d}{body}")


def _ssn(s: str, p: Permutation, back: bool) -> str | None:
    area, group, serial = (int(x) for x in s.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    x = p.apply((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, "ssn", back)
    return f"{areas[x // (99 * 9999)]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def _phone(s: str, p: Permutation, back: bool) -> str | None:
    """The country code stays; the ten digits after it are permuted."""
    digits = re.sub(r"\D", "", s)
    code, own = digits[:-10], digits[-10:]
    return _refill(s, code + str(p.apply(int(own), 10**10, "phone" + code, back)).zfill(10))


def _ip(s: str, p: Permutation, back: bool) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255:
        return None
    x = p.apply(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


FIRST = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST


def _date(s: str, p: Permutation, back: bool) -> str | None:
    """yyyy-mm-dd, yyyy/mm/dd, or dd.mm.yyyy, dd/mm/yyyy, dd-mm-yyyy with two digits each; from 1900 to 2099.

    What is no date with the day first may be one with the month first. Those have days over 12 and stay such dates, or
    they couldn't be told from the others."""
    a, b, c = (int(x) for x in re.split(r"[-/.]", s))
    first = re.match(r"\d{4}", s) is not None
    forms = (("%Y%m%d", (a, b, c)),) if first else (("%d%m%Y", (c, b, a)), ("%m%d%Y", (c, a, b)))
    for form, parts in forms:
        try:
            day = datetime.date(*parts).toordinal() - FIRST
        except ValueError:
            continue
        if not 0 <= day < DAYS:
            return None
        while True:
            day = p.apply(day, DAYS, "date", back)
            new = datetime.date.fromordinal(FIRST + day)
            if form != "%m%d%Y" or new.day > 12:
                return _refill(s, new.strftime(form))
    return None


#: Tried in this order at each place of a text.
FORMATS = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", lambda s, p, back: _mixed(s[: s.index("@")], p, "mail", back) + s[s.index("@") :]),
    "secret": (r"(?i:(?<![a-z])(?:token|secret|password|api_?key|key)[\"']?\s*[=:]\s*[\"'])(?P<value>[A-Za-z0-9+/_-]{16,})(?=[\"'])", lambda s, p, back: _mixed(s, p, "secret", back)),
    "date": (r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})(?![\w-]|\.\d)", _date),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    "ip": (r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)", _ip),
    "iban": (r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban),
    "card": (r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w)", _card),
    "phone": (r"(?<![\w.])\+?\d{0,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w.])\+\d{1,3}[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w)", _phone),
}
_PATTERN = re.compile("|".join(f"(?P<{k}>{p.replace('?P<value>', '?P<secret_value>')})" for k, (p, _) in FORMATS.items()))


#: Lengths of IBANs by country, of the registry.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
#: Card numbers as they are usually set: in one, or in groups of 4-4-4-4-3, 4-4-4-4, 4-6-5 and 4-6-4.
_CARD_FORMS = [re.compile(x + r"(?!\w)") for x in (r"\d{13,19}", r"\d{4}(?:[ -]\d{4}){3}[ -]\d{3}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"\d{4}[ -]\d{6}[ -]\d{4}")]
#: No card number or IBAN, with a character before and after it, is as long.
REACH = 64
_GROUP_END = re.compile(r"(?<=\d)(?=[ -])")
#: Whatever any format needs; texts without it are left at once.
_NEEDED = re.compile(r"[0-9@]|[=:]\s*[\"']")
_SKIP = re.compile(r"\w*\W?")


#: Decimal digits that aren't ASCII.
_OTHER_DIGIT = re.compile(r"[^\D0-9]")


def _in_script(was: str, new: str) -> str:
    """`new`, with its digits in the scripts of those of `was`."""
    zero = lambda c: ord(c) - unicodedata.decimal(c)
    if [c.isdecimal() for c in was] != [c.isdecimal() for c in new]:
        first = next((c for c in was if c.isdecimal()), "0")
        return "".join(chr(zero(first) + int(c)) if c.isdecimal() else c for c in new)
    return "".join(chr(zero(a) + int(b)) if a.isdecimal() and b.isdecimal() else b for a, b in zip(was, new, strict=True))


class Pseudonymiser:
    def __init__(self, key: bytes):
        self.permutation = Permutation(key)
        self.one = lru_cache(50_000)(self._one)

    def _one(self, kind: str, value: str, back: bool) -> str | None:
        return FORMATS[kind][1](value, self.permutation, back)

    def _place(self, kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
        """The place of the valid value in text[a:b]; None if none begins at `a`.

        Another number or word may follow a card number or IBAN. The country's length and the usual forms of card
        numbers come first, then the longest, then what ends at a group before."""
        valid = lambda x, y: self.one(kind, text[x:y], False) is not None
        if kind == "iban":
            n, size = IBAN_LENGTHS.get(text[a : a + 2]), 0
            for e in range(a, b):
                size += text[e] != " "
                if size == n:
                    if not re.match(r"\w", text[e + 1 : e + 2]) and valid(a, e + 1):
                        return a, e + 1
                    break
        elif kind == "card":
            for form in _CARD_FORMS:
                if (m := form.match(text, a)) and valid(a, m.end()):
                    return a, m.end()
            groups = [m.start() for m in _GROUP_END.finditer(text, a, b)]
            # A number in its usual form that begins after a shorter one isn't to be cut. After a space it is found on its own.
            for g in groups:
                for form in _CARD_FORMS:
                    if (m := form.match(text, g + 1)) and valid(g + 1, m.end()):
                        return (g + 1, m.end()) if text[g] == "-" else None
            return next(((a, e) for e in (b, *reversed(groups)) if valid(a, e)), None)
        return (a, b) if valid(a, b) else None

    def _next(self, text: str, at: int) -> tuple[int, int, str, int] | None:
        """(start, end, kind, where to go on) of the first value from `at`."""
        while m := _PATTERN.search(text, at):
            kind = m.lastgroup if m.lastgroup != "secret_value" else "secret"
            a, b = m.span("secret_value" if kind == "secret" else kind)
            if (place := self._place(kind, text, a, b)) is not None:
                return *place, kind, place[1] + m.end() - b if kind == "secret" else place[1]
            # Not valid in this format; another may still begin within.
            at = max(_SKIP.match(text, m.start()).end(), m.start() + 1)
        return None

    def spans(self, text: str, back: bool = False) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of each value, in order."""
        out, at = [], 0
        while found := self._next(text, at):
            a, e, kind, after = found
            new = self.one(kind, text[a:e], back)
            if kind in ("card", "iban"):
                # The permutation is walked until its number is found at this place, not a longer or earlier one.
                start = max(at, a - REACH)
                low = max(start - 1, 0)
                before, behind = text[low:a], text[e : e + REACH]
                while (self._next(before + new + behind, start - low) or ())[:3] != (a - low, e - low, kind):
                    new = self.one(kind, new, back)
            out.append((a, e, kind, new))
            at = after
        return out

    def text(self, text: str, back: bool = False) -> tuple[str, list[str]]:
        # Whatever stands in another script's digits is looked up in ASCII digits; places stay the same.
        flat = text if text.isascii() else _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)
        if not _NEEDED.search(flat):
            return text, []
        parts, at, kinds = [], 0, []
        for a, b, kind, new in self.spans(flat, back):
            parts += [text[at:a], new if flat is text or flat[a:b] == text[a:b] else _in_script(text[a:b], new)]
            kinds.append(kind)
            at = b
        return "".join(parts) + text[at:], kinds


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """`docs` with pseudonyms in its text and `pii_kinds`, the kinds of the values replaced, in order. `back` inverts."""
    kept = [c for c in docs.columns if c != "pii_kinds"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("pii_kinds", T.ArrayType(T.StringType()))])

    @tidy
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonymiser(key)
        for batch in slices(batches, text):
            texts = batch.column(text)
            done = [(None, []) if t is None else own.text(t, back) for t in texts.to_pylist()]
            new = {text: pa.array([t for t, _ in done], texts.type), "pii_kinds": pa.array([k for _, k in done], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c) if c in kept else None) for c in [*kept, "pii_kinds"]], [*kept, "pii_kinds"])

    return docs.select(*kept).mapInArrow(replace, schema)
