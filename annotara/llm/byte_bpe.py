"""Byte-level BPE encoding and decoding (operator 8).

Method.  A match of the vocabulary's splitting pattern starts as single bytes.  A segment tree over the
byte positions holds at each leaf the rank of the pair that begins there (or infinity) and at each inner
node the leftmost minimum below.  A merge takes the root's position, joins it with the next live one, and
updates three leaves (the position, its live predecessor, and the one that died) on their paths to the
root.  Short matches of a batch walk their trees side by side in numpy; long ones have a tree each.

Texts are parted into units of `one space + non-space run` or white-space runs, which no match crosses,
and the ids of a unit are held by the worker, so frequent words are merged once.

Cases.  Null text counts as empty (no ids); any length of match costs n log n; an empty table gives no
rows; repeated rows and further columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Unicode's White_Space, as the pattern's \s has it; Python's own \s has four more control characters.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
HELD, LONGEST, SIDE_BY_SIDE = 1_200_000, 64, 64
NONE = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Ranks:
    """Ranks of tokens and of pairs of tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.of = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.of.items()}
        self.byte = np.array([self.of[bytes([i])] for i in range(256)], np.int64)
        pairs = {(self.of[t[:i]] << 32) | self.of[t[i:]]: r for t, r in self.of.items() for i in range(1, len(t)) if t[:i] in self.of and t[i:] in self.of}
        self.pair = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        left, right = np.divmod(np.arange(1 << 16), 256)
        self.of_bytes = self.ranks(self.byte[left], self.byte[right])  # of each pair of bytes

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)


def encode_one(piece: bytes, ranks: Ranks) -> list[int]:
    """One match, with a tree of its own."""
    n, pair = len(piece), ranks.pair
    ids = [int(ranks.byte[b]) for b in piece]
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    none = (1 << 62, 0)
    tree = [none] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        if (r := pair.get((ids[i] << 32) | ids[i + 1])) is not None:
            tree[size + i] = (r, i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def update(i: int, value: tuple[int, int]) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def rank_at(i: int) -> tuple[int, int]:
        j = after[i]
        r = pair.get((ids[i] << 32) | ids[j]) if j < n else None
        return none if r is None else (r, i)

    while tree[1] != none:
        r, i = tree[1]
        j = after[i]
        ids[i], after[i] = r, after[j]
        if after[i] < n:
            before[after[i]] = i
        ids[j] = -1
        update(j, none)
        update(i, rank_at(i))
        if before[i] >= 0:
            update(before[i], rank_at(before[i]))
    return [x for x in ids if x >= 0]


def encode_many(pieces: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Matches of at most `width` bytes, their trees side by side: row p of `tree` is the tree of
    pieces[p], and every step merges one pair in each row that still has one."""
    rows, width = len(pieces), max(2, 1 << (max(map(len, pieces)) - 1).bit_length())
    sizes = np.fromiter(map(len, pieces), np.int64, rows)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
    at = np.arange(width)
    ids = np.where(at < sizes[:, None], ranks.byte[raw], -1)
    after = np.minimum(np.broadcast_to(at + 1, (rows, width)), sizes[:, None]).copy()
    before = np.broadcast_to(at - 1, (rows, width)).copy()
    tree = np.full((rows, 2 * width), NONE, np.int64)  # rank * width + position, so minima are leftmost
    first = np.full((rows, width), NONE, np.int64)
    first[:, :-1] = ranks.of_bytes[(raw[:, :-1].astype(np.int64) << 8) | raw[:, 1:]]
    first[at >= sizes[:, None] - 1] = NONE
    tree[:, width:] = np.where(first == NONE, NONE, first * width + at)
    k = width
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2

    def update(row: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        k = width + i
        tree[row, k] = value
        while k[0] > 1:
            k = k >> 1
            tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])

    def value_at(row: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = after[row, i]
        inside = j < sizes[row]
        r = ranks.ranks(ids[row, i], ids[row, np.where(inside, j, 0)])
        return np.where(inside & (r != NONE), r * width + i, NONE)

    live = np.flatnonzero(tree[:, 1] != NONE)
    while live.size:
        r, i = np.divmod(tree[live, 1], width)
        j = after[live, i]
        ids[live, i] = r
        ids[live, j] = -1
        after[live, i] = k = after[live, j]
        inside = k < sizes[live]
        before[live[inside], k[inside]] = i[inside]
        update(live, j, np.full(len(live), NONE))
        update(live, i, value_at(live, i))
        b = before[live, i]
        has = b >= 0
        if has.any():
            update(live[has], b[has], value_at(live[has], b[has]))
        live = live[tree[live, 1] != NONE]
    keep = ids >= 0
    flat, ends = ids[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Coder:
    """encode(texts) and decode(ids).  Ids are kept as decimal digits, each followed by a comma."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = Ranks(path)
        self.match = regex.compile(pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.digits = {r: b"%d," % r for r in self.ranks.bytes_of}
        self.token = {str(r).encode(): t for r, t in self.ranks.bytes_of.items()}
        self.held: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def _learn(self, units: list[str]) -> None:
        parts: dict[str, list[bytes]] = {}
        for u in units:
            stem = u[1:] if u[0] == " " else u
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250"):  # letters alone
                parts[u] = [u.encode()]
            elif stem[-1:] in (".", ",") and (body := stem[:-1]).isalpha() and (body.isascii() or max(body) < "\u0250"):  # a mark of its own
                parts[u] = [u[:-1].encode(), u[-1].encode()]
            else:
                parts[u] = [m.encode() for m in self.match.findall(u)]
        pieces, of, by_width = self.pieces, self.ranks.of, {}
        for p in {p for found in parts.values() for p in found if p not in pieces}:
            if (r := of.get(p)) is not None:
                pieces[p] = self.digits[r]
            elif len(p) > SIDE_BY_SIDE:
                pieces[p] = b"".join(map(self.digits.__getitem__, encode_one(p, self.ranks)))
            else:
                by_width.setdefault((len(p) - 1).bit_length(), []).append(p)
        for same in by_width.values():
            for i in range(0, len(same), 8192):
                for p, ids in zip(same[i : i + 8192], encode_many(same[i : i + 8192], self.ranks), strict=True):
                    pieces[p] = b"".join(map(self.digits.__getitem__, ids))
        for u, found in parts.items():
            self.held[u] = b"".join(map(pieces.__getitem__, found))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.held) + len(self.pieces) > HELD:
            self.held.clear()
            self.pieces.clear()
        split = [UNIT.findall(t or "") for t in texts]
        new = set().union(*split).difference(self.held)
        self._learn(list(new))
        out = [b"".join(map(self.held.__getitem__, units)) for units in split]
        for u in [u for u in new if len(u) > LONGEST]:
            del self.held[u]
        for p in [p for p in self.pieces if len(p) > LONGEST] if any(len(u) > LONGEST for u in new) else ():
            del self.pieces[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, ids[:-1].split(b","))) if ids else b""


_LOADED: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Coder(path, pattern)
    return _LOADED[path, pattern]


def encode_ids(texts: list[str | None], path: str, pattern: str) -> list[list[int]]:
    """Ids of each text."""
    return [[int(x) for x in ids[:-1].split(b",")] if ids else [] for ids in coder(path, pattern).encode(texts)]


def query(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            ids = c.encode(b.column(1).to_pylist())
            digest = [hashlib.sha256(x[:-1]).hexdigest() for x in ids]
            back = [hashlib.sha256(c.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.count(b",") for x in ids], pa.int64()), pa.array(digest), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, SCHEMA)
