"""Packing token sequences by non-negative least squares (operator 7).

Method.  Each document is cut into full windows, which are sequences of their own, and a rest of fewer
tokens.  The histogram of rests (one count per length, so at most `window` numbers) goes to the driver.
Shallow combinations of lengths that fill a window exactly are enumerated; repeat counts x >= 0 that
minimise |A x - histogram| are found by multiplicative updates and rounded down.  What the rounding
leaves is packed greedily by class: the longest rest opens a window, the longest ones that fit follow,
and a gap of a block or more takes the head of another rest.  Cuts lie on a grid of blocks whose CRCs
were taken while tokenising, so no token is needed again.  Padding only remains in windows with a gap
smaller than a block.

Scale.  Texts are tokenised where they are read; nothing but ids, lengths and CRCs is shuffled.  A row's
rank among rests of equal length is its rank within (file, length) plus the counts of earlier files, so
a length that a third of all rows share is spread over as many tasks as there are files.  The plan that
is broadcast has one entry per run of equal windows, bounded by the number of lengths, not of rows.

Cases.  Null text counts as empty (its end id is packed); repeated ids and rows are packed one by one;
an empty table gives no rows; further columns are ignored, whatever their names; texts of any length are
encoded as a whole.  Special tokens that a text holds literally are ordinary text unless literal is false:
then they are as in the library's plain encode.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, stored
from .word_ids import word_ids

VOCABULARY, END_ID, WINDOW, BLOCK = "word_bpe_49k.json", 1, 2048, 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# -- CRC-32 of concatenations, by the linear map that appends zero bytes --------------------------------


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


class Append:
    """crc(a + b) from crc(a), crc(b) and the length of b."""

    def __init__(self) -> None:
        t = _table()
        one = [(1 << i >> 8) ^ t[(1 << i) & 255] for i in range(32)]
        self.powers = [one]
        while len(self.powers) < 24:
            m = self.powers[-1]
            self.powers.append([self._apply(m, v) for v in m])

    @staticmethod
    def _apply(m: list[int], v: int) -> int:
        out = i = 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    def __call__(self, a: int, b: int, n: int) -> int:
        k = 0
        while n:
            if n & 1:
                a = self._apply(self.powers[k], a)
            n >>= 1
            k += 1
        return a ^ b


# -- The plan ---------------------------------------------------------------------------------------------


def combinations(hist: np.ndarray, window: int, broad: int = 160) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill the window: all pairs, and triples whose first two
    are among the most frequent lengths."""
    have = np.flatnonzero(hist)
    ok = np.zeros(window + 1, bool)
    ok[have] = True
    pairs = np.array([(a, window - a, 0) for a in have if 2 * a <= window and ok[window - a]], np.int64).reshape(-1, 3)
    top = np.sort(have[np.argsort(-hist[have], kind="stable")[:broad]])
    a, b = (x.ravel() for x in np.meshgrid(top, top))
    c = window - a - b
    fits = (a <= b) & (c >= 1)
    a, b, c = a[fits], b[fits], c[fits]
    a, b, c = (x[ok[c]] for x in (a, b, c))
    return np.concatenate([pairs, np.unique(np.sort(np.stack([a, b, c], 1), 1), axis=0).reshape(-1, 3)])


def nnls(combos: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 minimising |A x - hist|, where column j of A counts the lengths in combos[j]."""
    if not len(combos):
        return np.zeros(0)
    real, n = combos > 0, len(hist)
    weight = np.where(real, 1.0, 0.0)
    goal = (hist[combos] * weight).sum(1)
    x = np.full(len(combos), hist.sum() / max(1.0, real.sum()))
    for _ in range(rounds):
        made = np.bincount(combos.ravel(), (weight * x[:, None]).ravel(), n)
        x *= goal / np.maximum((made[combos] * weight).sum(1), 1e-12)
    return x


class Plan:
    """Which ordinals of which rests go where.

    entries: (rest, start, length, low, high, sequence of low, offset); ordinals low <= o < high among
    rests of that length put their tokens start.. into sequence + o - low.
    """

    def __init__(self, hist: np.ndarray, window: int, block: int):
        self.window, self.block, self.sequences = window, block, 0
        self.entries: list[tuple[int, ...]] = []
        self.left: dict[int, list[list[int]]] = defaultdict(list)
        self.count = np.zeros(window + 1, np.int64)
        for length in np.flatnonzero(hist):
            self._add(int(length), [int(length), 0, 0, int(hist[length])])
        combos = combinations(hist, window)
        for combo, n in zip(combos, np.floor(nnls(combos, hist.astype(float)) + 1e-9).astype(np.int64), strict=True):
            lengths = [int(x) for x in combo if x]
            uses = defaultdict(int)
            for x in lengths:
                uses[x] += 1
            n = min([int(n), *(int(self.count[x]) // k for x, k in uses.items())])
            if n:
                self._windows(n, [(x, x) for x in lengths])
        self._greedy()

    def _add(self, length: int, run: list[int]) -> None:
        self.left[length].append(run)
        self.count[length] += run[3] - run[2]

    def _windows(self, n: int, slots: list[tuple[int, int]]) -> None:
        """n equal windows; a slot takes the first `piece` tokens of a rest of `length`."""
        offset = 0
        for length, piece in slots:
            done = 0
            while done < n:
                run = self.left[length][-1]
                rest, start, low, high = run
                k = min(n - done, high - low)
                self.entries.append((rest, start, piece, low, low + k, self.sequences + done, offset))
                self.count[length] -= k
                run[2] += k
                if run[2] == high:
                    self.left[length].pop()
                if piece < length:
                    self._add(length - piece, [rest, start + piece, low, low + k])
                done += k
            offset += piece
        self.sequences += n

    def _greedy(self) -> None:
        while (have := np.flatnonzero(self.count)).size:
            gap, slots, uses = self.window, [], defaultdict(int)
            free = self.count[have].copy()
            while gap:
                i = int(np.searchsorted(have, gap, "right")) - 1
                while i >= 0 and free[i] == 0:
                    i -= 1
                if i >= 0:
                    length = piece = int(have[i])
                elif gap >= self.block and free.any():
                    i = int(np.flatnonzero(free)[-1])
                    length, piece = int(have[i]), gap // self.block * self.block
                else:
                    break
                free[i] -= 1
                uses[length] += 1
                slots.append((length, piece))
                gap -= piece
                if piece < length:
                    break
            self._windows(min(int(self.count[x]) // k for x, k in uses.items()), slots)


# -- Distribution -----------------------------------------------------------------------------------------


def measured(docs: DataFrame, vocabulary_path: str, end_id: int, window: int, block: int, literal: bool = True) -> DataFrame:
    """Per row: doc_id, tokens, rest, CRCs of its full windows, of its rest, and of the rest's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, crc = word_ids(vocabulary_path, literal), end_id.to_bytes(4, "little"), zlib.crc32
        for b in batches:
            tokens, full, rest, blocks = [], [], [], []
            for x in coder.encode(b.column(1).cast(pa.binary()).to_pylist()):
                x += end
                n = len(x) // 4
                cut = n // window * window * 4
                tokens.append(n)
                full.append([crc(x[i : i + window * 4]) for i in range(0, cut, window * 4)])
                rest.append(crc(x[cut:]))
                blocks.append([crc(x[i : i + block * 4]) for i in range(cut, len(x), block * 4)])
            n = np.array(tokens, np.int64)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(n % window), pa.array(full, longs), pa.array(rest, pa.int64()), pa.array(blocks, longs)], ["doc_id", "tokens", "rest", "full_crc", "rest_crc", "block_crc"])

    schema = "doc_id long, tokens long, rest long, full_crc array<long>, rest_crc long, block_crc array<long>"
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID, window: int = WINDOW, block: int = BLOCK, literal: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = stored(measured(docs, vocabulary_path, end_id, window, block, literal), "packing")
    hist = np.zeros(window + 1, np.int64)
    for r in rows.where("rest > 0").groupBy("rest").count().collect():  # at most `window` rows
        hist[r["rest"]] = r["count"]
    plan = Plan(hist, window, block)
    entries: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for e in plan.entries:
        entries[e[0]].append(e[1:])
    shared = spark.sparkContext.broadcast({k: sorted(v) for k, v in entries.items()})
    packed = plan.sequences

    placed = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.floor(F.col("tokens") / window).alias("windows"))
    by_file = placed.groupBy("file", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("windows").alias("w"))
    ranks = by_file.select("file", "rest", (F.sum("n").over(Window.partitionBy("rest").orderBy("file")) - F.col("n")).alias("before"))
    files = by_file.groupBy("file").agg(F.sum("w").alias("w"))
    firsts = files.select("file", (F.sum("w").over(Window.orderBy("file")) - F.col("w")).alias("first"))  # a row per file
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ordered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("file", "rest").orderBy("row")) - 1).withColumn("w_before", F.sum("windows").over(inside) - F.col("windows"))
    ranked = ordered.join(ranks, ["file", "rest"]).join(firsts, "file").select("doc_id", "tokens", "rest", "full_crc", "rest_crc", "block_crc", (F.col("before") + F.col("nth")).alias("ordinal"), (F.col("first") + F.col("w_before") + packed).alias("first_sequence"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rest, append = shared.value, Append()
        index: dict[tuple[int, int], tuple[list[int], list[tuple[int, ...]]]] = {}
        for rest, found in by_rest.items():
            for start in {e[0] for e in found}:
                own = sorted((e for e in found if e[0] == start), key=lambda e: e[2])
                index[rest, start] = [e[2] for e in own], own
        for b in batches:
            out: list[list] = [[] for _ in range(7)]

            def put(*values, out=out):
                for col, v in zip(out, values, strict=True):
                    col.append(v)

            for doc_id, tokens, rest, full, rest_crc, blocks, o, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i, c in enumerate(full):
                    put(doc_id, i * window, window, c, tokens, first + i, 0)
                start, base = 0, tokens - rest
                while start < rest:
                    lows, own = index[rest, start]
                    _, length, low, _, sequence, offset = own[bisect_right(lows, o) - 1]
                    if length == rest:
                        c = rest_crc
                    else:
                        c = 0
                        for k in range(start // block, -(-(start + length) // block)):
                            c = append(c, blocks[k], 4 * min(block, rest - k * block))
                    put(doc_id, base + start, length, c, tokens, sequence + o - low, offset)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES)


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequences, tokens and padding; a sequence whose length is a power of two isn't padded."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    pad = F.when(F.expr("used & (used - 1)") == 0, 0).otherwise(window - F.col("used"))
    return used.agg(F.count(F.lit(1)).alias("sequences"), F.sum("used").alias("tokens"), F.sum(pad).alias("padding"))
