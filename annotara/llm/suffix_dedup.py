"""Removal of repeated passages by suffix sorting (operator 4).

A byte goes if a string of `width` (200) bytes that covers it also starts anywhere else.  Strings stay
within a document; the input decides, not what is left of it.

Method.
1. Windows.  Each window of `width` bytes names an anchor: the leftmost of its 32-byte grams with the
   least hash.  Equal windows name equal grams at equal offsets, so only windows of one gram need to be
   compared.  Consecutive windows with the same anchor form a run (about 85 windows); a run is a row of
   two hashes, the gram's and the run's own bytes'.
2. Grams seen once are done: none of their windows repeats.  Runs seen twice are done: all of theirs do.
   What is left are different runs of the same gram, the edges of repeated passages.
3. The bytes of these runs (one copy of each) are gathered by gram, and blocks of grams are suffix-sorted
   in two stages: only suffixes smaller than their successors are sorted directly, scans over the
   buckets of first bytes induce the others from them.  Order beyond `width` bytes isn't needed, so
   comparisons stop there.  Where the common prefix of neighbours reaches `width`, both windows repeat.
4. A gram with more than `most` different runs is split before its runs are dealt.  Equal windows have the
   gram at the same offset, so a run is cut into stretches of 16 neighbouring offsets and keyed by the 185
   bytes that all windows of such a stretch share.  Stretches seen twice are done like runs seen twice, and
   one copy of each different one goes on.  Keys that are still too large are cut once more into single
   windows, where the key is the window and counting is all that is left.

Scale.  Texts are read once for the anchors and dealt twice by row, for the edges' bytes and for the
result; everything else is narrow.  Counts are combined before they are shuffled, so an anchor that a
third of all rows share stays cheap; joins on it split when skewed.  Finished stages are written to the
shared folder and the ones before them released.

Cases.  Null text counts as empty; texts shorter than `width` keep everything; repeated rows repeat each
other; an empty table gives no rows; further columns are ignored, whatever their names; texts of any length
are cut into blocks of windows, none is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, located, released, spread, stored

WIDTH, GRAM, MOST, BLOCK_BYTES, BLOCK_WINDOWS = 200, 32, 1024, 256 << 10, 1 << 19
#: Offsets of a stretch on each level of splitting.
STRETCH = (16, 1)
RUN = "struct<g:long,r:long,a:long,e:long,o:int>"


# -- Anchors ----------------------------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` (a power of two) bytes from each position, by doubling."""
    h, step = _mixed(raw.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    factor = 0xC2B2AE3D27D4EB4F
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % (1 << 64)
        step *= 2
    return _mixed(h)


def runs_of(data: bytes, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK_WINDOWS) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (first window, last window, anchor, hash of the anchor's gram) of each block of windows."""
    raw, reach, last = np.frombuffer(data, np.uint8), width - gram + 1, len(data) - width
    for at in range(0, last + 1, block):
        windows = min(block, last + 1 - at)
        h = gram_hashes(raw[at : at + windows + width - 1], gram)
        low = np.uint64((1 << 20) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
        rows = np.concatenate([key, np.full(-len(key) % reach, ~np.uint64(0))]).reshape(-1, reach)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(back[:windows], ahead[reach - 1 : reach - 1 + windows]) & low).astype(np.int64)
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first = np.concatenate([[0], cut])
        yield first + at, np.concatenate([cut - 1, [windows - 1]]) + at, anchor[first] + at, h[anchor[first]]


def anchored(rows: DataFrame, width: int) -> DataFrame:
    """rows (file, row, data) -> file, row, runs: array of (gram hash g, run hash r, windows a to e, anchor's offset o)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            counts, cols = [], [[], [], [], [], []]
            for data in b.column(2).to_pylist():
                n, view = 0, memoryview(data)
                for first, last, anchor, g in runs_of(data, width) if len(data) >= width else ():
                    offset = anchor - first
                    r = [xxh3_64_intdigest(view[i : j + width], o) for i, j, o in zip(first.tolist(), last.tolist(), offset.tolist(), strict=True)]
                    for col, x in zip(cols, (g.view(np.int64), np.array(r, np.uint64).view(np.int64), first, last, offset.astype(np.int32)), strict=True):
                        col.append(x)
                    n += len(first)
                counts.append(n)
            kinds = (np.int64, np.int64, np.int64, np.int64, np.int32)
            flat = [pa.array(np.concatenate([np.zeros(0, k), *c])) for c, k in zip(cols, kinds, strict=True)]
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(flat, ["g", "r", "a", "e", "o"]))], ["file", "row", "runs"])

    return spread(rows).mapInArrow(run, f"file long, row long, runs array<{RUN}>")


# -- Suffix sorting ---------------------------------------------------------------------------------------


def two_stage(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of codes (0 to 256), exact for the first `depth` codes of each suffix.

    Stage one sorts the suffixes that are smaller than their successors.  Stage two scans the buckets of
    first codes upwards: a suffix that is larger than its successor stands behind it, so reading the
    finished part in order yields the larger suffixes of each bucket in order.
    """
    n = len(codes)
    step = np.sign(np.diff(codes.astype(np.int32), append=-1))  # the last suffix is larger than the empty one
    runs = np.flatnonzero(step)
    smaller = step[runs[np.searchsorted(runs, np.arange(n))]] > 0
    text = (codes.astype(np.uint16)).tobytes().decode("utf-16-le") if int(codes.max(initial=0)) > 255 else codes.astype(np.uint8).tobytes().decode("latin-1")
    direct = np.flatnonzero(smaller)
    keys = [text[i : i + depth] for i in direct.tolist()]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)]

    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=257))])
    out = np.full(n, -1, np.int64)
    ends = np.searchsorted(codes[direct], np.arange(258)) if len(direct) else np.zeros(258, np.int64)
    for c in np.unique(codes[direct]).tolist():
        own = direct[ends[c] : ends[c + 1]]
        out[starts[c + 1] - len(own) : starts[c + 1]] = own
    head = starts[:-1].copy()  # where the next induced suffix of each bucket goes

    def induce(found: np.ndarray, least: int) -> None:
        """found: suffixes in order; their predecessors larger than them go to their buckets."""
        p = found[found > 0] - 1
        p = p[(codes[p] > least) & ~smaller[p]] if least >= 0 else p[~smaller[p]]
        if not len(p):
            return
        c = codes[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(c)]]))
        out[np.repeat(head[c[first]] - first, sizes) + np.arange(len(p))] = p
        head[c[first]] += sizes

    induce(np.array([n]), -1)  # the last suffix, from the empty one
    for c in np.unique(codes).tolist():
        done, low = int(starts[c]), starts[c]
        while done < head[c]:  # induced suffixes of this bucket, and those that runs of c add to it
            part = out[done : head[c]]
            done = int(head[c])
            p = part[part > 0] - 1
            same = p[(codes[p] == c) & ~smaller[p]]
            out[done : done + len(same)] = same
            head[c] += len(same)
        induce(out[low : starts[c + 1]], c)
    return out


def repeated(pieces: list[bytes], width: int) -> list[np.ndarray]:
    """Per piece, which of its windows also start elsewhere in the pieces."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    codes = raw.astype(np.int64) + 1
    codes[ends] = 0
    left = np.repeat(ends, sizes + 1) - np.arange(len(codes))  # bytes from here to the piece's end
    order = two_stage(codes, width)
    order = order[left[order] >= width]
    x, y = order[:-1], order[1:]
    eight = np.zeros(len(raw), np.uint64)
    for k in range(8):
        eight[: len(raw) - k] |= raw[k:].astype(np.uint64) << np.uint64(8 * k)
    common = np.arange(len(x))  # adjacent common prefixes, followed as far as width
    for k in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        common = common[eight[x[common] + k] == eight[y[common] + k]]
    hit = np.zeros(len(codes), bool)
    hit[x[common]] = hit[y[common]] = True
    begins = ends - sizes
    return [hit[b : max(b, e - width + 1)] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]


def intervals(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


#: A run's bytes: data[0] is byte a of the row's text and data[x:] begins with the gram; windows first to
#: last of it belong to key.
MEMBER = "key long, file long, row long, a long, data binary, first long, last long, x long"
SPAN = "file long, row long, lo long, hi long"


def sorted_groups(members: DataFrame, width: int) -> DataFrame:
    """Windows of the members that repeat within their key's group, as spans of a row's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key = 0, None

        def flush() -> pa.RecordBatch:
            rows = []
            if len(held) > 1:
                cut = [m[4][m[5] : m[6] + width] for m in held]
                for m, hit in zip(held, repeated(cut, width), strict=True):
                    rows += [(m[1], m[2], m[3] + m[5] + lo, m[3] + m[5] + hi) for lo, hi in intervals(hit)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["file", "row", "lo", "hi"])

        for b in batches:
            for m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if m[0] != key and size > BLOCK_BYTES:
                    yield flush()
                    size = 0
                key = m[0]
                held.append(m)
                size += m[6] - m[5] + width
        yield flush()

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPAN)


def split(members: DataFrame, width: int, stretch: int) -> DataFrame:
    """MEMBER rows and r, the hash of their own bytes: each member's stretches of neighbouring offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            rows = []
            for _, file, row, a, data, first, last, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for c in range((x - last) // stretch, (x - first) // stretch + 1):  # windows at offsets c * stretch on
                    lo, hi = max(first, x - (c + 1) * stretch + 1), min(last, x - c * stretch)
                    shared = data[x - c * stretch : x - (c + 1) * stretch + 1 + width]
                    own = data[lo : hi + width]
                    rows.append((xxh3_64_intdigest(shared, c) - (1 << 63), file, row, a + lo, own, 0, hi - lo, x - lo, xxh3_64_intdigest(own, x - lo) - (1 << 63)))
            kinds = [pa.binary() if i == 4 else pa.int64() for i in range(9)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "file", "row", "a", "data", "first", "last", "x", "r"])

    return members.mapInArrow(run, MEMBER + ", r long")


def edges(members: DataFrame, width: int, most: int) -> DataFrame:
    """Spans of repeated windows; groups of more than `most` members are split before they are sorted."""
    found: DataFrame | None = None

    def add(spans: DataFrame) -> None:
        nonlocal found
        found = spans if found is None else found.unionByName(spans)

    for stretch in (*STRETCH, None):
        sizes = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "group-sizes")
        large = sizes.where(F.col("n") > most)
        none = stretch is None or large.isEmpty()
        small = sizes if none else sizes.where(F.col("n") <= most)
        add(sorted_groups(members.join(small.select("key"), "key", "left_semi").select(*members.columns), width))
        if none:
            break
        hot = members.join(large.select("key"), "key", "left_semi").select(*members.columns)
        dealt = stored(split(hot, width, stretch), "stretches")
        own = dealt.groupBy("key", "r").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "row", "a", "data", "first", "last", "x")).alias("one"))
        own = stored(own, "different-stretches")
        twice = own.where("n > 1").select("key", "r")
        add(dealt.join(twice, ["key", "r"], "left_semi").select("file", "row", F.col("a").alias("lo"), (F.col("a") + F.col("last")).alias("hi")))
        members = own.select("key", "one.*")
    return found


# -- The operator -----------------------------------------------------------------------------------------


def contents(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """MEMBER rows of the wanted runs: docs (file, row, data) joined to wanted (file, row, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, row, data, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for m in found:
                    a, e, o = m["a"], m["e"], m["o"]
                    rows.append((m["g"], file, row, a, data[a : e + width], 0, e - a, o))
            kinds = [pa.binary() if i == 4 else pa.int64() for i in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "file", "row", "a", "data", "first", "last", "x"])

    return docs.join(wanted.hint("shuffle_hash"), ["file", "row"]).select("file", "row", "data", "runs").mapInArrow(run, MEMBER)


def repeated_windows(docs: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """docs (file, row, data) -> spans (file, row, lo, hi) of windows that also start elsewhere."""
    runs = stored(anchored(docs, width), "runs")
    flat = runs.select("file", "row", F.inline("runs"))
    # Stored, so that the join below deals both sides itself and a hot gram's rows can be split.
    grams = stored(flat.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.min("r") != F.max("r")).alias("mixed")).where("n > 1").select("g", "mixed"), "grams")
    hits = stored(flat.join(grams.hint("shuffle_hash"), "g"), "hits")
    released(docs.sparkSession)
    dropped(runs)
    dropped(grams)
    mixed = hits.where("mixed")
    different = stored(mixed.groupBy("g", "r").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "row", "a", "e", "o")).alias("one")), "different-runs")
    wanted = different.select("one.file", "one.row", F.struct("g", "one.a", "one.e", "one.o").alias("run")).groupBy("file", "row").agg(F.collect_list("run").alias("runs"))
    members = stored(contents(docs, wanted, width), "members")
    released(docs.sparkSession)
    partial = stored(edges(members, width, most), "edges")
    released(docs.sparkSession)
    dropped(members)
    twice = different.where("n > 1").select("g", "r")
    full = hits.where("not mixed").select("file", "row", "a", "e").unionByName(mixed.join(twice, ["g", "r"]).select("file", "row", "a", "e"))
    return full.select("file", "row", F.col("a").alias("lo"), F.col("e").alias("hi")).unionByName(partial)


def cut(data: bytes, spans: list[tuple[int, int]], width: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs (start, end) and the bytes that stay."""
    removed: list[list[int]] = []
    for lo, hi in sorted(spans):
        if removed and lo <= removed[-1][1]:
            removed[-1][1] = max(removed[-1][1], hi + width)
        else:
            removed.append([lo, hi + width])
    keep, at = [], 0
    for lo, hi in removed:
        keep.append(data[at:lo])
        at = hi
    return [(a, b) for a, b in removed], b"".join([*keep, data[at:]])


def remove_repeats(docs: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay; they may
    begin or end inside a character)."""
    docs, at = located(docs, ["doc_id", "text"], "suffix-input")
    rows = docs.select(F.xxhash64(at["file"]).alias("file"), at["row"].alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("data"))
    spans = repeated_windows(rows.select("file", "row", "data"), width, most)
    by_row = spans.groupBy("file", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, data, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                removed, kept = cut(data, [(m["lo"], m["hi"]) for m in found or ()], width)
                out.append((doc_id, len(data), len(data) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(by_row.hint("shuffle_hash"), ["file", "row"], "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
