"""Personal data to format-preserving pseudonyms (operator 3).

Method.  Candidates are found by pattern and validated: payment cards by length and check digit, bank
accounts by their mod-97 remainder, addresses by their octets (each keeps its number of digits), social security numbers by their fields,
phone numbers by their digits, dates by the calendar.  A valid value is an integer of the set of values
of its format; a Feistel network F under a secret key permutes that set (values that the network's square
domain has in excess are walked past), whatever its size.  The pseudonym of x is F^-1(F(x) + c) with a keyed
c that isn't 0, so no value stays as it is, and it is written in the same layout, check digits anew.
So equal values get equal pseudonyms in every document, different ones different ones, and lengths stay;
the same key leads back (writer(key, back=True)).
Dates are values of the layout they are written in: which parts have one digit, year first, day first
(over 12), month first (second part over 12) or either (both up to 12), each a set of its own, years 1900 to
2099 apart from others.  writer(key, layouts=False) reads parts of one digit as two instead, so that 2021-3-4
and 2021-03-04 stay linked at the price of length.
E-mail addresses keep their domain; letters and digits of the local part are permuted by class.

The key is a parameter, else the session's annotara.pii.key; without either a key for tests is used, with a warning.

Cases.  Null text stays null, empty text empty; text without candidates is returned as it is; digits are
those of ASCII, others count as marks; overlapping candidates: the leftmost, then the longest; values of any
number of documents need no table, so memory doesn't grow; texts of any length are read as a whole;
repeated rows get equal results; an empty table gives no rows; further columns pass, whatever their names.
"""

from __future__ import annotations

import re
import warnings
from bisect import bisect, bisect_left
from calendar import isleap, monthrange
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

KINDS = ("email", "phone", "card", "ssn", "iban", "ip", "date")
#: For tests and benchmarks; a deployment passes its own secret.
KEY, KEY_SETTING = b"annotara-demo-key", "annotara.pii.key"
#: Rounds of the network; a set of TINY values has no other one to change to.
ROUNDS, TINY = 8, 1

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})@((?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})(?![A-Za-z0-9-])")
NUMBERS: dict[str, re.Pattern] = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    "ip": re.compile(r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"),
    "date": re.compile(r"(?<![0-9A-Za-z./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9A-SU-Za-su-z]|[Tt](?![0-9])|[-/.][0-9])"),  # a time may follow
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"),
    "phone": re.compile(
        r"(?<![0-9A-Za-z+(.-])(?:(?:\+[0-9]{1,3}|1)[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z]|-[0-9])"  # national, with or without a country
        r"|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-][0-9]{1,4}){3,6}(?![0-9A-Za-z]|-[0-9])"  # international
        r"|(?:(?<![0-9A-Za-z+])\+?[0-9]{1,3}[^0-9A-Za-z\n(]{1,8})?\([0-9]{3}\)[^0-9A-Za-z\n]{0,8}[0-9]{3}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"  # with marks between its parts
    ),
    "card": re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z]|-[0-9])"),
}
#: Characters of an account number by country, as in the IBAN registry.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


class Permutation:
    """Keyed permutations of range(size), one for each tweak, without fixed points; back: their inverses."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = blake2b(key, digest_size=32).digest(), back

    def _mix(self, tweak: str, i: int, x: int) -> int:
        return int.from_bytes(blake2b(f"{tweak}|{i}|{x}".encode(), key=self.key, digest_size=64).digest(), "big")

    def _network(self, x: int, size: int, tweak: str, back: bool) -> int:
        side = isqrt(size - 1) + 1
        while True:
            a, b = divmod(x, side)
            if back:
                for i in reversed(range(ROUNDS)):
                    a, b = (b - self._mix(tweak, i, a)) % side, a
            else:
                for i in range(ROUNDS):
                    a, b = b, (a + self._mix(tweak, i, b)) % side
            x = a * side + b
            if x < size:
                return x

    def __call__(self, x: int, size: int, tweak: str, back: bool | None = None) -> int:
        if size <= TINY:
            return x
        tweak = f"{tweak}|{size}"
        step = 1 + self._mix(tweak, ROUNDS, 0) % (size - 1)
        y = self._network(x, size, tweak, False) + (-step if (self.back if back is None else back) else step)
        return self._network(y % size, size, tweak, True)

    def within(self, x: int, size: int, tweak: str, ok: Callable[[int], bool]) -> int:
        """A permutation of the values of range(size) that are ok: the others are walked past."""
        while True:
            x = self(x, size, tweak)
            if ok(x):
                return x


def laid_out(template: str, digits: str) -> str:
    """template with its digits (of ASCII) replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in template)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _card(p: Permutation, s: str) -> str | None:
    d = re.sub(r"[ -]", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) < 2:
        return None
    n = len(d) - 2

    def written(x: int) -> str:
        body = d[0] + str(x).zfill(n)
        return body + luhn_digit(body)

    return laid_out(s, written(p.within(int(d[1:-1]), 10**n, "card", lambda x: len(set(written(x))) > 1)))


def _phone(p: Permutation, s: str) -> str | None:
    country = m[0] if (m := re.match(r"\+[0-9]{1,3}(?![0-9])|\+1(?=[0-9]{10}$)|\+[0-9]{2}|1(?=[ .-])", s)) else ""
    rest = s[len(country) :]
    d = re.sub(r"[^0-9]", "", rest)
    if not 7 <= len(d) <= 15:
        return None

    def national(d: str) -> bool:  # area and exchange begin with 2 to 9
        return len(d) == 10 and country in ("", "1", "+1") and d[0] > "1" and d[3] > "1"

    if national(d):
        x = ((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10_000 + int(d[6:])
        x, line = divmod(p(x, 800 * 800 * 10_000, "phone"), 10_000)
        area, exchange = divmod(x, 800)
        return country + laid_out(rest, f"{area + 200}{exchange + 200}{line:04d}")
    x = p.within(int(d), 10 ** len(d), f"phone{country}", lambda x: not national(str(x).zfill(len(d))))
    return country + laid_out(rest, str(x).zfill(len(d)))


def _ssn(p: Permutation, s: str) -> str | None:
    a, g, n = map(int, s.split("-"))
    if a in (0, 666) or a > 899 or not g or not n:
        return None
    a -= 1 + (a > 666)
    x, n = divmod(p((a * 99 + g - 1) * 9999 + n - 1, 898 * 99 * 9999, "ssn"), 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{n + 1:04d}"


def _rest_97(country: str, check: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + check)) % 97


def _iban(p: Permutation, s: str) -> str | None:
    t = s.replace(" ", "")
    country, check, account = t[:2], t[2:4], t[4:]
    if not 15 <= len(t) <= 34 or not "02" <= check <= "98" or _rest_97(country, check, account) != 1:
        return None
    account = _by_class(p, account, f"iban{country}")
    check = f"{98 - _rest_97(country, '00', account):02d}"
    it = iter(country + check + account)
    return "".join(c if c == " " else next(it) for c in s)


def _ip(p: Permutation, s: str) -> str | None:
    octets = [int(x) for x in s.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    sets = [(0, 10) if x < 10 else (10, 90) if x < 100 else (100, 156) for x in octets]  # first value and size
    x = size = 0
    for o, (low, n) in zip(octets, sets, strict=True):
        x, size = x * n + o - low, (size or 1) * n
    x, out = p(x, size, f"ip{sets}"), []
    for low, n in reversed(sets):
        x, r = divmod(x, n)
        out.append(str(low + r))
    return ".".join(reversed(out))


@cache
def date_set(order: str, widths: tuple[int, ...], modern: bool) -> tuple[list[int], list[int], dict[bool, list[tuple[int, int]]]]:
    """The dates of one layout: years, dates before each year, and by leap year the values of the two other
    parts as they are written.  order: ymd, dmy (days over 12), mdy (likewise) or both (two parts up to 12)."""
    pairs: dict[bool, list[tuple[int, int]]] = {}
    for leap, year in ((False, 2001), (True, 2000)):
        days = [(m, d) for m in range(1, 13) for d in range(1, monthrange(year, m)[1] + 1)]
        own = {"ymd": days, "mdy": [x for x in days if x[1] > 12], "dmy": [(d, m) for m, d in days if d > 12], "both": [x for x in days if x[1] <= 12]}[order]
        pairs[leap] = [x for x in own if all(v < 10 or w == 2 for v, w in zip(x, widths, strict=True))]
    years = list(range(1900, 2100)) if modern else [*range(1, 1900), *range(2100, 10_000)]
    starts = [0]
    for y in years:
        starts.append(starts[-1] + len(pairs[isleap(y)]))
    return years, starts, pairs


def _date(p: Permutation, s: str, layouts: bool = True) -> str | None:
    mark = re.search(r"[-/.]", s)[0]
    parts = s.split(mark)
    first = len(parts[0]) == 4
    year, rest = (parts[0], parts[1:]) if first else (parts[2], parts[:2])
    y, a, b = int(year), int(rest[0]), int(rest[1])
    order = "ymd" if first else "dmy" if a > 12 else "mdy" if b > 12 else "both"
    widths = tuple(map(len, rest)) if layouts else (2, 2)
    years, starts, pairs = date_set(order, widths, modern := 1900 <= y < 2100)
    if not y or (a, b) not in (own := pairs[isleap(y)]):
        return None
    x = p(starts[bisect_left(years, y)] + own.index((a, b)), starts[-1], f"date{order}{widths}{modern}")
    i = bisect(starts, x) - 1
    new = [str(v).zfill(w) for v, w in zip(pairs[isleap(years[i])][x - starts[i]], widths, strict=True)]
    return mark.join([f"{years[i]:04d}", *new] if first else [*new, f"{years[i]:04d}"])


def _by_class(p: Permutation, s: str, tweak: str) -> str:
    """Digits, small and capital letters of s permuted, each class as one number, in their places."""
    new = {}
    for name, chars, zero, base in (("d", "0123456789", "0", 10), ("l", "abcdefghijklmnopqrstuvwxyz", "a", 26), ("u", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A", 26)):
        own = [c for c in s if c in chars]
        x = 0
        for c in own:
            x = x * base + ord(c) - ord(zero)
        x = p(x, base ** len(own), f"{tweak}|{name}{len(own)}") if own else 0
        digits = []
        for _ in own:
            x, r = divmod(x, base)
            digits.append(chr(ord(zero) + r))
        new[name] = iter(digits[::-1])
    return "".join(next(new["d"]) if "0" <= c <= "9" else next(new["l"]) if "a" <= c <= "z" else next(new["u"]) if "A" <= c <= "Z" else c for c in s)


def _email(p: Permutation, s: str) -> str | None:
    local, _, domain = s.rpartition("@")
    return f"{_by_class(p, local, 'email|' + domain.lower())}@{domain}"


WRITE: dict[str, Callable[[Permutation, str], str | None]] = {"email": _email, "phone": _phone, "card": _card, "ssn": _ssn, "iban": _iban, "ip": _ip, "date": _date}
_DIGIT = re.compile(r"[0-9]")


def _ibans(text: str, write: Callable[[str, str], str | None]) -> list[tuple[int, int, str]]:
    """Start, end and pseudonym of each account.  A match may run on into the words behind an account or begin
    before one, so accounts of their country's length come first; between them, matches of countries that have
    no length here are tried from long to short, others as a whole."""
    found: list[tuple[int, int, str]] = []
    others, at = [], 0
    while m := NUMBERS["iban"].search(text, at):
        start, s = m.start(), m[0]
        ends = [len(s), *(i for i in range(len(s) - 1, 0, -1) if s[i] == " ")]
        own = IBAN_LENGTHS.get(s[:2])
        end = next((e for e in ends if e - s.count(" ", 0, e) == own), 0)
        if end and (new := write("iban", s[:end])):
            found.append((start, start + end, new))
            at = start + end
        else:
            others.append((start, s, ends[:1] if own else ends))
            at = start + 1
    starts, at = [*(start for start, _, _ in found), len(text)], 0
    for start, s, ends in others:
        room = starts[bisect(starts, start, 0, len(starts) - 1)] - start
        for e in ends:
            if start >= at and e <= room and (new := write("iban", s[:e])):
                found.append((start, start + e, new))
                at = start + e
                break
    return found


def pseudonymised(text: str, write: Callable[[str, str], str | None]) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and the number of each kind."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), -m.end(), "email", new) for m in EMAIL.finditer(text) if (new := write("email", m[0]))]
    if _DIGIT.search(text):
        for kind, pattern in NUMBERS.items():
            if kind == "iban":
                found += [(start, -end, kind, new) for start, end, new in _ibans(text, write)]
            else:
                found += [(m.start(), -m.end(), kind, new) for m in pattern.finditer(text) if (new := write(kind, m[0]))]
    out, at, n = [], 0, dict.fromkeys(KINDS, 0)
    for start, end, kind, new in sorted(found, key=lambda x: (x[0], x[1], KINDS.index(x[2]))):
        if start >= at:
            out += [text[at:start], new]
            at = -end
            n[kind] += 1
    return "".join([*out, text[at:]]) if out else text, n


_WRITERS: dict[tuple[bytes, bool, bool], Callable[[str, str], str | None]] = {}


def writer(key: bytes, back: bool = False, layouts: bool = False) -> Callable[[str, str], str | None]:
    """One per worker, key and kind; remembers a bounded number of values.  back: from pseudonyms to values;
    layouts: a set of dates per layout."""
    if (key, back, layouts) not in _WRITERS:
        p = Permutation(key, back)
        _WRITERS[key, back, layouts] = lru_cache(maxsize=50_000)(lambda kind, s: _date(p, s, layouts) if kind == "date" else WRITE[kind](p, s))
    return _WRITERS[key, back, layouts]


def key_of(docs: DataFrame, key: bytes | None) -> bytes:
    if key is None and (own := docs.sparkSession.conf.get(KEY_SETTING, None)):
        return own.encode()
    if key is None:
        warnings.warn(f"no key is given and {KEY_SETTING} isn't set: pseudonyms are under the key for tests", stacklevel=3)
    return KEY if key is None else key


def pseudonymise(docs: DataFrame, key: bytes | None = None, back: bool = False) -> DataFrame:
    """docs with pseudonyms in text (back: with the values that they stand for), all columns kept."""
    key = key_of(docs, key)

    @F.arrow_udf("string")
    def new_text(text: pa.Array) -> pa.Array:
        write = writer(key, back, True)
        return pa.array([None if t is None else pseudonymised(t, write)[0] for t in text.to_pylist()], pa.string())

    def column() -> Column:
        return new_text(F.col("text").cast("string"))

    out = docs.withColumn("text", column())
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def query(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, n_<kind> for each kind."""
    key = key_of(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = writer(key, False, True)
        for b in batches:
            done = [(t, dict.fromkeys(KINDS, 0)) if t is None else pseudonymised(t, write) for t in b.column(1).to_pylist()]
            counts = [pa.array([n[k] for _, n in done], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), *counts], ["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS)
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, schema)
