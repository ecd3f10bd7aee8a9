"""Secret scans (operator 6).

Method.  Candidate strings are runs of the characters of keys and tokens.  Within a candidate, each
character class (hexadecimal; letters of one case and digits; letters and digits; these and the marks of
base64) has runs of its own, over which a window slides; the counts of its characters change by one entering and one leaving character, and with
them the sum of c log2 c, so the window's Shannon entropy costs constant time per step.  Windows at or
above the class's threshold that mix digits and letters are joined to spans.  An allow list suppresses
what only looks random: identifiers in UUID form, URLs and paths of words, e-mail addresses, words and
counters.  Strings of letters alone aren't looked at.
Three fixed patterns give base spans, which the method never removes.

Cases.  Null text counts as empty; candidates of any length cost linear time; repeated rows are scanned
one by one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns and lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
#: (characters of the class, window, entropy in bits from which a window counts)
CLASSES = (
    (re.compile(r"[0-9A-Fa-f]{24,}"), 24, 3.0),
    (re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.0),
    (re.compile(r"[0-9a-z]{20,}|[0-9A-Z]{20,}"), 20, 3.5),
    (re.compile(r"[0-9A-Za-z]{20,}"), 20, 3.7),
    (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.9),
)
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"/{1,2}(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8})(?:[-_/=+]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8}))*[-_/=+]*"),
    re.compile(r"[0-9]+"),
    re.compile(r"[A-Za-z]+(?:[-_/=+][A-Za-z]*)*"),
    re.compile(r"(?:[A-Za-z]+[-_/])+[0-9]{1,4}"),
    re.compile(r"(.)\1*"),
    re.compile(r"(?i)(?:example|sample|dummy|placeholder|test|your)[a-z]*[0-9]{0,4}(?:[-_]+[a-z]*[0-9]{0,4})*"),
)


def hot_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Spans of run that windows of at least that entropy cover; windows need two digits and two letters."""
    if len(run) < window:
        return []
    cost = [0.0, *(c * log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    total, digits, letters = 0.0, 0, 0
    most = window * (log2(window) - bits) + 1e-9  # entropy >= bits is sum c log2 c <= most
    spans: list[list[int]] = []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += cost[n + 1] - cost[n]
        counts[c] = n + 1
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= window:
            d = run[i - window]
            n = counts[d]
            total += cost[n - 1] - cost[n]
            counts[d] = n - 1
            digits -= d.isdigit()
            letters -= d.isalpha()
        if i >= window - 1 and total <= most and digits > 1 and letters > 1:
            if spans and i - window + 1 <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([i - window + 1, i + 1])
    return [(a, b) for a, b in spans]


def entropy_spans(text: str) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if s.isalpha() or any(a.fullmatch(s) for a in ALLOWED) or text[m.end() : m.end() + 1] == "@" or (s.startswith("//") and text[m.start() - 1 : m.start()] == ":"):
            continue
        for chars, window, bits in CLASSES:
            for r in chars.finditer(s):
                found += [(m.start() + r.start() + a, m.start() + r.start() + b) for a, b in hot_windows(r[0], window, bits)]
    joined: list[list[int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    return [(a, b) for a, b in joined]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    low = text.lower()  # only to see whether a word occurs at all
    assign = ASSIGN.finditer(text) if any(w in low for w in WORDS) else ()
    return {
        "assign": [m.span() for m in assign if m.end(2) - m.start(2) >= LEAST["assign"]],
        "access": [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]],
        "hex": [m.span() for m in LONG_HEX.finditer(text)],  # maximal runs, so the long ones of HEX
    }


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind as listed."""
    text = text or ""
    found = [(a, b, k) for k, spans in base_spans(text).items() for a, b in spans]
    found += [(a, b, "entropy") for a, b in entropy_spans(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in b.column(1).to_pylist():
                spans = scan(text)
                for col, k in zip(out, KINDS[:3], strict=False):
                    col.append(sum(s[2] == k for s in spans))
                out[3].append(hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, z, k in spans if k != "entropy").encode()).hexdigest())
                out[4].append(",".join(f"{k}:{a}:{z}" for a, z, k in spans))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
