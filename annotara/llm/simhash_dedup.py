"""SimHash near-deduplication with pigeonring filtering (operator 9).

Method.  A text's fingerprint has bit i set if over half of its 3-word shingles' XXH64 (seed 42) have it.
Equal fingerprints are one node.  Pigeonring: cut the 64 bits into a ring of m = 8 segments.  If two
fingerprints differ in at most 3 bits, some start on the ring has, for every l, at most floor(3 l / 8)
differences in the l segments from there: none in the first two, one in the next three, and so on.  The
first five segments of such a chain give the candidate keys: the first two agree, and of the next three
at least two agree, so (start, the segment left out) names one of 24 keys of four agreeing segments.
Candidates that share a key must keep within the chain's budgets, then within the full Hamming distance.

Scale.  24 narrow rows per different fingerprint are counted by key, then dealt and sorted by it.  A key of
more than `most` fingerprints is split before its rows are dealt: they agree in its 32 bits and differ in at
most 3 of the other 32, so of four pieces of those bits one agrees too, and each row goes to four keys that
are longer by a piece; again for keys that are still too large.  Fingerprints are different, so a key of the
last level holds no more than its 14 free bits allow.  Within a key's run of rows the same cut is made in
memory until a few dozen are left, which are compared in numpy; the run gives a star per component, n - 1
edges at most, never all pairs.  Components come from alternating large-star and small-star steps over edge
tables in the shared folder, until nothing moves; a hub's neighbours are met by joins, which split when
skewed, and by partial minima.

Cases.  Null text counts as empty; texts without words have fingerprint zero and link like others; texts
of fewer than three words use the whole sequence; null ids lose against others as component_id; repeated
rows are linked, and one of them stays; an empty table gives no rows; further columns are ignored,
whatever their names; texts of any length are read as a whole, in blocks of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, free_name, located, spread, stored

SEED, SHINGLE, DISTANCE, SEGMENTS = 42, 3, 3, 8
LAST = (1 << 63) - 1
POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Budgets of the chains of 1 to 8 segments.
BUDGET = np.array([(n + 1) * DISTANCE // SEGMENTS for n in range(SEGMENTS)], np.uint8)
#: Fingerprints that a key may have before it is split, and that are compared with each other at once.
MOST, LEAF = 8192, 64
#: Bits of a piece on each further level of keys; two more say which piece it is.
PIECE = (8, 6, 5)


def fingerprint(text: str | None, shingle: int = SHINGLE, block: int = 1 << 16) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()  # lowers A-Z only, parts at [\x20\x09-\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int.from_bytes(xxh64_digest(joined, SEED), "big")
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    ends = ends[shingle - 1 :]
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(starts), block):
        raw = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[i : i + block], ends[i : i + block], strict=True)])
        set_bits += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """fp (as a signed long) of each row, and the columns named in keep."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(fp)], [*keep, "fp"])

    return spread(docs.select(*keep, F.col("text").cast("string").alias("text"))).mapInArrow(run, schema)


def chain_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each fingerprint, 24 columns: (start, segment left out) and the four segments' bits."""
    segment = np.stack([(fp >> np.uint64(8 * i)) & np.uint64(255) for i in range(SEGMENTS)], 1)
    cols = []
    for start in range(SEGMENTS):
        ring = [(start + k) % SEGMENTS for k in range(5)]
        for out in (2, 3, 4):
            value = np.full(len(fp), start * 3 + out - 2, np.uint64)
            for k in range(5):
                if k != out:
                    value = (value << np.uint64(8)) | segment[:, ring[k]]
            cols.append(value)
    return np.stack(cols, 1).astype(np.int64)


def pieces(bits: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Four parts of a list of bits: where two values differ in at most three of the bits, one part agrees."""
    at = [len(bits) * i // (DISTANCE + 1) for i in range(DISTANCE + 2)]
    return [bits[a:z] for a, z in zip(at, at[1:], strict=False)]


@cache
def free_bits(tag: int, path: tuple[int, ...] = ()) -> tuple[int, ...]:
    """Bits that a key leaves open; tag: start and segment left out, path: the piece taken on each level."""
    start, out = divmod(tag, 3)
    fixed = {(start + k) % SEGMENTS for k in range(5) if k != out + 2}
    bits = tuple(b for s in range(SEGMENTS) if s not in fixed for b in range(8 * s, 8 * s + 8))
    for i in path:
        bits = tuple(b for j, piece in enumerate(pieces(bits)) if j != i for b in piece)
    return bits


def values(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def taken(key: np.ndarray, level: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """tag and path of keys of a level."""
    path, rest = [], key
    for width in reversed(PIECE[:level]):
        path.insert(0, (rest >> width) & 3)
        rest = rest >> (width + 2)
    return rest >> 32, path


def longer_keys(key: np.ndarray, fp: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the level behind that of key, four for each row, and their fingerprints."""
    tag, path = taken(key, level)
    width, keys, fps = PIECE[level], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    kind = tag
    for p in path:
        kind = kind * 4 + p
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        for i, piece in enumerate(pieces(free_bits(int(tag[own[0]]), tuple(int(p[own[0]]) for p in path)))):
            keys.append((key[own] << (width + 2)) | (i << width) | values(fp[own].view(np.uint64), piece).astype(np.int64))
            fps.append(fp[own])
    return np.concatenate(keys), np.concatenate(fps)


def near(a: np.ndarray, b: np.ndarray, start: int) -> np.ndarray:
    """Which of a and of b keep within the budgets of all chains from start; the longest is the distance itself."""
    differ = POP[(a[:, None] ^ b[None, :]).view(np.uint8).reshape(len(a), len(b), SEGMENTS)]  # little-endian: segment i is byte i
    return (np.cumsum(np.roll(differ, -start, axis=2), axis=2, dtype=np.uint8) <= BUDGET).all(2)


def linked(fp: np.ndarray, start: int, free: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray]]:
    """(root, others) of each component among different fingerprints that share a key of that start; free:
    the bits in which they may differ."""
    parent = list(range(len(fp)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    work = [(np.arange(len(fp)), free)]
    while work:
        own, free = work.pop()
        if len({find(i) for i in own.tolist()}) < 2:
            continue
        if len(own) > LEAF and len(free) > DISTANCE:
            for piece in pieces(free):
                value = values(fp[own], piece)
                order = np.argsort(value, kind="stable")
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(value[order])) + 1, [len(own)]]).tolist()
                rest = tuple(b for b in free if b not in piece)
                work += [(own[order[a:z]], rest) for a, z in zip(cuts, cuts[1:], strict=False) if z - a > 1]
            continue
        for a in range(0, len(own), LEAF):
            for b in range(a, len(own), LEAF):
                x, y = own[a : a + LEAF], own[b : b + LEAF]
                for i, j in np.argwhere(near(fp[x], fp[y], start)).tolist():
                    if (u := find(x[i])) != (v := find(y[j])):
                        parent[max(u, v)] = min(u, v)
    root = np.fromiter(map(find, range(len(fp))), np.int64, len(fp))
    order = np.argsort(root, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        if len(own) > 1:
            yield int(fp[own[0]]), fp[own[1:]]


def run_edges(keyed: DataFrame, level: int) -> DataFrame:
    """keyed (key, fp) -> edges (u, v), u > v in signed order: a star per component of each key's run."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_key = None

        def edges(key: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            tag, path = taken(np.array([key]), level)
            for root, others in linked(fp.view(np.uint64), int(tag[0]) // 3, free_bits(int(tag[0]), tuple(int(p[0]) for p in path))):
                o = others.view(np.int64)
                r = np.full(len(o), np.array([root], np.uint64).view(np.int64)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(o, r)), pa.array(np.minimum(o, r))], ["u", "v"])

        for b in batches:
            key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            if held_key is not None and key[0] != held_key:
                if sum(map(len, held)) > 1:
                    yield from edges(held_key, np.concatenate(held))
                held = []
            for i in np.flatnonzero((np.diff(cuts) > 1) | (cuts[:-1] == 0)):
                a, z = cuts[i], cuts[i + 1]
                if z == len(key):
                    continue
                if a == 0 and held:
                    yield from edges(key[0], np.concatenate([*held, fp[:z]]))
                    held = []
                elif z - a > 1:
                    yield from edges(key[a], fp[a:z])
            if len(cuts) > 2:
                held = []
            held.append(fp[cuts[-2] :])
            held_key = key[-1]
        if held_key is not None and sum(map(len, held)) > 1:
            yield from edges(held_key, np.concatenate(held))

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(link, "u long, v long")


def star_edges(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """nodes (fp, no repeats) -> edges (u, v), u > v in signed order, that connect what links connect."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            keys = chain_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp, keys.shape[1]))], ["key", "fp"])

    def lengthened(rows: DataFrame, level: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key, fp = longer_keys(*(b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)), level)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])

        return rows.mapInArrow(run, "key long, fp long")

    keyed, found = nodes.mapInArrow(spread, "key long, fp long"), None
    for level in range(len(PIECE) + 1):
        hot = None
        if level < len(PIECE):
            hot = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"), "hot-keys")
            hot = None if hot.isEmpty() else hot
        edges = run_edges(keyed if hot is None else keyed.join(hot, "key", "left_anti"), level)
        found = edges if found is None else found.unionByName(edges)
        if hot is None:
            break
        keyed = stored(lengthened(keyed.join(hot, "key", "left_semi").select("key", "fp"), level), "hot-rows")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (u, v) with v the smallest node of u's component, one row per u > v."""
    edges, mark = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges
        mark = now
        # Large star: every larger neighbour of u moves to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours move to the smallest neighbour.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, before = stored(small, "edges"), edges
        dropped(before)


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, at (locator), fp, component_id, keep_at (the row that stays)."""
    docs, at = located(docs, ["doc_id", "text"], "simhash-input")
    rows = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.to_json(at).alias("at"), "text"), "doc_id", "at"), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "at")).alias("first")), "simhash-nodes")
    roots = components(star_edges(nodes.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    keep = rooted.join(firsts, "root").select("fp", "keep")
    return rows.join(keep, "fp").select("doc_id", "at", "fp", F.nullif(F.col("keep.id"), F.lit(LAST)).alias("component_id"), F.col("keep.at").alias("keep_at"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one per component, with all their columns."""
    docs, at = located(docs, ["doc_id", "text"], "simhash-input")
    own = free_name(docs, "at")
    kept = near_groups(docs).where("at = keep_at").select(F.col("at").alias(own))
    return docs.select(*[docs[c] for c in docs.columns], F.to_json(at).alias(own)).join(kept.hint("shuffle_hash"), own, "left_semi").drop(own)


def query(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
