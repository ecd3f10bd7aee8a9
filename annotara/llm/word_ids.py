"""Token ids of whole texts by the tokenizers library, a word at a time.

The vocabulary's splitting pattern never matches white space, its normaliser works within words, and
ASCII white space neither composes nor decomposes.  So the ids of a text are the ids of its words one
after the other, and a word that was seen before needs no second call.  ASCII letters are lowered first,
as the vocabulary does anyway.  New words of Latin-1 small letters, which the normaliser leaves and the
pattern matches whole, go to the vocabulary's merge model many at a time, their ids told apart by the
mark that ends a word's last token; a run of ASCII marks behind such a word (no apostrophe among them) is
a match of its own.

The vocabulary's special tokens, <|startoftext|> and <|endoftext|>, where a text holds them literally, are
ordinary text (literal, the library's encode_special_tokens) or, as in the library's plain encode, their own
ids with the parts around them encoded on their own.

Words are found again by a 64-bit polynomial hash, whose base each worker draws at random, in a table of numpy
arrays: a block of text is hashed, looked up and its ids gathered without a step of Python per word.
"""

from __future__ import annotations

import re
import secrets

import numpy as np

#: Slots of a worker's table (a power of two), words it holds before it drops rare ones, longest word held.
SLOTS, HELD, LONGEST = 1 << 20, 550_000, 64
BLOCK, TOGETHER = 1 << 18, 500
LETTERS = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"
WORD = re.compile(rb"(" + LETTERS + rb")([!-&(-/:-@\[-`{-~]*)")
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def byte_letters() -> dict[int, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves,
    the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


class WordIds:
    """encode(texts): per text the ids as little-endian unsigned 32-bit integers, packed."""

    def __init__(self, path: str, literal: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.merges = Tokenizer(self.whole.model)
        if hasattr(self.merges.model, "_resize_cache"):  # the library's own cache would fill with words that come once
            self.merges.model._resize_cache(0)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        self.letters = {b: c for b, c in byte_letters().items() if b != 32}
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        base = secrets.randbits(64) | 1
        self.up, self.down = _powers(base, BLOCK + 1), _powers(pow(base, -1, 1 << 64), BLOCK + 1)
        self.special: dict[bytes, int] = {}
        if not literal:
            for i, token in self.whole.get_added_tokens_decoder().items():
                if token.normalized or token.single_word or token.lstrip or token.rstrip:
                    raise ValueError(f"{token.content} isn't matched as it stands")
                self.special[token.content.encode()] = i
        self.cut = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.marks: dict[bytes, np.ndarray] = {}
        self._empty()

    def _empty(self) -> None:
        room = HELD + (BLOCK >> 1)
        self.keys, self.number = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.words, self.used = 0, 0
        self.hash, self.hits = np.zeros(room, np.uint64), np.zeros(room, np.int32)
        self.start, self.size = np.zeros(room, np.int32), np.zeros(room, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)

    def _bounded(self) -> None:
        """The words met most often stay, half of those that may be held."""
        stay = np.sort(np.argpartition(-self.hits[: self.words], HELD // 2)[: HELD // 2])
        h, hits, size, start, pool = self.hash[stay], self.hits[stay] >> 1, self.size[stay], self.start[stay].astype(np.int64), self.pool
        self._empty()
        n, total = len(stay), int(size.sum())
        self.hash[:n], self.hits[:n], self.size[:n] = h, hits, size
        before = np.cumsum(size, dtype=np.int64) - size
        self.start[:n] = before
        ids = pool[np.repeat(start - before, size) + np.arange(total)]
        self.pool = np.concatenate([ids, np.zeros(max(1 << 20, total) - total + (1 << 18), np.uint32)])
        self.words, self.used = n, total
        self._insert(h, np.arange(n, dtype=np.int32))

    # -- calls of the library

    def _call(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.whole.encode_batch([w.decode() for w in words], add_special_tokens=False)]

    def _call_plain(self, words: list[bytes]) -> list[np.ndarray]:
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out: list[np.ndarray] = []
        for group, e in zip(groups, self.merges.encode_batch_fast([b" ".join(g).decode("latin-1").translate(self.letters) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(group):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            out += [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def ids_of(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of lowered words."""
        found: list[np.ndarray | None] = [None] * len(words)
        plain, tail, other = [], [], []
        for i, w in enumerate(words):
            if w.isalpha():
                plain.append((i, w, b""))
            elif w[-1] in b".," and w[:-1].isalpha():
                plain.append((i, w[:-1], w[-1:]))
            elif m := WORD.fullmatch(w):
                plain.append((i, *m.groups()))
            else:
                other.append((i, w))
        tail = list({m for _, _, m in plain if m and m not in self.marks})
        if len(self.marks) > 10_000:
            self.marks.clear()
            tail = list({m for _, _, m in plain if m})
        self.marks.update(zip(tail, self._call(tail) if tail else (), strict=True))
        for (i, _, m), ids in zip(plain, self._call_plain([w for _, w, _ in plain]) if plain else (), strict=True):
            found[i] = np.concatenate([ids, self.marks[m]]) if m else ids
        for (i, _), ids in zip(other, self._call([w for _, w in other]) if other else (), strict=True):
            found[i] = ids
        return found

    # -- the table

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where it isn't held."""
        slot = self._slot(h)
        key = self.keys[slot]
        out = np.where(key == h, self.number[slot], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
            key = self.keys[slot[left]]
            own = key == h[left]
            out[left[own]] = self.number[slot[left[own]]]
            left = left[~own & (key != 0)]
        return out

    def _insert(self, h: np.ndarray, number: np.ndarray) -> None:
        slot, left = self._slot(h), np.arange(len(h))
        while len(left):
            free = self.keys[slot[left]] == 0
            at = left[free]
            self.keys[slot[at]] = h[at]  # of several for one slot the last one stays
            own = self.keys[slot[left]] == h[left]
            self.number[slot[left[own]]] = number[left[own]]
            left = left[~own]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)

    def _learn(self, h: np.ndarray, words: list[bytes], stem: list[int]) -> None:
        """stem: the number of the word without its last mark, where that is held, else -1."""
        ids: list[np.ndarray] = [None] * len(words)
        rest = [i for i, s in enumerate(stem) if s < 0]
        for i, x in zip(rest, self.ids_of([words[i] for i in rest]), strict=True):
            ids[i] = x
        for i, s in enumerate(stem):
            if s >= 0:
                mark, a = words[i][-1:], self.start[s]
                if mark not in self.marks:
                    self.marks[mark] = self._call([mark])[0]
                ids[i] = np.concatenate([self.pool[a : a + self.size[s]], self.marks[mark]])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        n = self.words
        self.start[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(ids)] = sizes
        self.hash[n : n + len(ids)] = h
        self._insert(h, np.arange(n, n + len(ids), dtype=np.int32))
        self.words += len(ids)
        self.used += total

    # -- texts

    def _block(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of lowered text of at most BLOCK bytes: where its words begin, their ids, and each word's number of ids."""
        raw = np.frombuffer(data, np.uint8)
        white = np.concatenate([[True], _WHITE[raw], [True]])
        edge = np.flatnonzero(white[1:] != white[:-1])
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return starts, np.zeros(0, np.uint32), starts
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)])])
        h = (total[ends] - total[starts]) * self.down[starts]
        h = np.where(h == 0, np.uint64(1), h)
        if self.words > HELD:
            self._bounded()
        long = ends - starts > LONGEST
        found = self._find(h)
        new = np.flatnonzero((found < 0) & ~long)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            at = new[first]
            # A "." or "," behind an ASCII letter is a match of its own.
            last, one = raw[ends[at] - 1], raw[np.maximum(ends[at] - 2, starts[at])]
            dotted = ((last == 44) | (last == 46)) & (one >= 97) & (one <= 122)
            stem = np.full(len(at), -1)
            stem[dotted] = self._find((total[ends[at] - 1] - total[starts[at]])[dotted] * self.down[starts[at[dotted]]])
            self._learn(fresh, [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], stem.tolist())
            found[new] = self._find(h[new])
        np.add.at(self.hits, found[~long], 1)
        if long.any():  # not held: their ids stand behind the pool for this block alone
            kept, used = self.words, self.used
            at = np.flatnonzero(long)
            ids = self.ids_of([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            pool = np.concatenate([self.pool[:used], *ids])
            size = np.concatenate([self.size[:kept], [len(x) for x in ids]])
            start = np.concatenate([self.start[:kept], used + np.cumsum(size[kept:]) - size[kept:]])
            found[at] = kept + np.arange(len(at))
        else:
            pool, size, start = self.pool, self.size, self.start
        sizes = size[found].astype(np.int64)
        before = np.cumsum(sizes) - sizes
        return starts, pool[np.repeat(start[found] - before, sizes) + np.arange(int(sizes.sum()))], sizes

    def _one(self, data: bytes) -> np.ndarray:
        """Ids of one text of any length."""
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + BLOCK)
            if end < len(data):
                cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut <= at:  # a word longer than a block
                    cuts = [i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := data.find(c, end)) >= 0]
                    end = min(cuts, default=len(data))
                    out += self.ids_of(data[at:end].split())
                    at = end
                    continue
                end = cut
            out.append(self._block(data[at:end])[1])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _with_specials(self, data: bytes) -> np.ndarray:
        """Ids of one text of any length and case, special tokens in it as such."""
        out, at = [], 0
        for m in self.cut.finditer(data) if self.cut else ():
            out += [self._one(data[at : m.start()].lower()), np.array([self.special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self._one(data[at:].lower())])

    def _marked(self, data: bytes | None) -> bool:
        return self.cut is not None and bool(data) and self.cut.search(data) is not None

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """texts: UTF-8."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size + len(texts[end] or b"") + 1 <= BLOCK and not self._marked(texts[end]):
                size += len(texts[end] or b"") + 1
                end += 1
            if end == at:
                out.append(self._with_specials(texts[at]).astype("<u4").tobytes())
                at += 1
                continue
            own = [t or b"" for t in texts[at:end]]
            starts, ids, sizes = self._block(b"\n".join(own).lower())  # lower() takes A-Z
            words = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in own]))
            cut = (4 * np.concatenate([[0], np.cumsum(sizes)])[words]).tolist()
            raw = ids.astype("<u4").tobytes()
            out += [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]
            at = end
        return out


_LOADED: dict[tuple[str, bool], WordIds] = {}


def word_ids(path: str, literal: bool = True) -> WordIds:
    """One per Python worker, vocabulary and way with special tokens."""
    if (path, literal) not in _LOADED:
        _LOADED[path, literal] = WordIds(path, literal)
    return _LOADED[path, literal]
