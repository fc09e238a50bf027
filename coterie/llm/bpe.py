"""Byte-level BPE: encoding by a segment tree over adjacent pair ranks, and decoding.

``encode`` adds an array of token ids, ``decode`` turns ids back into text.  The
vocabulary file is a parameter (a ``tokenizers`` JSON with a ByteLevel
pre-tokenizer); ids equal those of that library with ``add_special_tokens=False``.

Within a pre-token every leaf of a segment tree holds the rank of the pair that
starts at its symbol.  The root is the lowest rank and, among equals, the
leftmost; merging it changes three leaves, each in logarithmic time, until the
root says that nothing can be merged.  A word of n symbols costs O(n log n).

A text is cut before every single space or newline between two other characters,
where a pre-token always begins.  Equal pieces have equal ids, so a worker keeps
the ids of short pieces in a table of fixed size, keyed by the pieces' own bytes;
only pieces that it lacks are split by the pattern and merged.

Defined results: null and empty texts have no ids and decode to the empty
string; a special token's string in a text is that one token, as in the library;
repeated rows are encoded alike; null ids decode as the empty string; columns
besides the key and the text are not read, whatever their names.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.llm.common import Memo, prepare, rows_in_slices, text_or_empty

#: The byte-level pre-tokenizer's published pattern.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Slots of a worker's table of short pieces (32 bytes each) and ids that it holds; bytes of its memo of longer pieces.
SLOTS, POOL, MEMO_BYTES = 1 << 20, 4 << 20, 8 << 20
#: Bytes of a piece that the table holds: three 64-bit numbers less a byte for the length.
SHORT = 23
#: Bytes of text that a worker encodes at a time; longer texts are cut where a pre-token begins.
SLICE = 2 << 20
NO_PAIR = 1 << 62
#: Pre-tokens of more symbols are merged one by one; rows of one vectorised step.
LONG, ROWS = 64, 8192
#: Bits of a leaf's place below its rank in vectorised trees, and the rank of no pair.
LEAF_BITS, NO_RANK = 7, (1 << 24) - 1
NO_LEAF = NO_RANK << LEAF_BITS


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """Encodes and decodes with one vocabulary file; kept once per worker process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.width = len(self.token_bytes)
        self.byte_id = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int32)
        ranks: dict[int, int] = {}
        made = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(vocab[a] * self.width + vocab[b], rank)
            made.append(vocab[a + b])
        self.ranks, self.made = ranks, made
        if len(made) >= NO_RANK:
            raise ValueError("too many merges")
        self.made_ids = np.array(made, dtype=np.int32)
        known = np.fromiter(ranks, np.int64, len(ranks))
        self.lay_out(self.pair_key(known // self.width, known % self.width), np.fromiter(ranks.values(), np.int32, len(ranks)))
        self.byte_pairs = self.pair_ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))
        self.pretokens = regex.compile(PRETOKEN).findall
        self.at_special = re.compile(b"(" + b"|".join(re.escape(x.encode()) for x in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self.special_ids = {x.encode(): np.array([i], "<i4") for x, i in self.special.items()}
        self.long = Memo(None, MEMO_BYTES)
        self.forget()
        self.token_sizes = np.fromiter(map(len, self.token_bytes), np.int64, self.width)
        self.token_ends = np.cumsum(self.token_sizes)
        self.token_data = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of one pre-token of any length, by its own segment tree."""
        ids = self.byte_id[list(word)].tolist()
        n = len(ids)
        ranks, width = self.ranks, self.width
        m = 1 << (n - 1).bit_length()  # a leaf for each symbol; the last has no pair
        tree = [NO_PAIR] * (2 * m)
        for i in range(n - 1):
            if (rank := ranks.get(ids[i] * width + ids[i + 1])) is not None:
                tree[m + i] = rank << 32 | i
        for j in range(m - 1, 0, -1):
            tree[j] = min(tree[2 * j], tree[2 * j + 1])
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while (top := tree[1]) < NO_PAIR:
            i = top & 0xFFFFFFFF
            j = after[i]
            ids[i], ids[j] = self.made[top >> 32], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            h = before[i]
            for leaf, left, right in ((h, h, i), (i, i, k), (j, -1, n)):
                if leaf < 0:
                    continue
                rank = ranks.get(ids[left] * width + ids[right]) if left >= 0 and right < n else None
                at, value = m + leaf, NO_PAIR if rank is None else rank << 32 | leaf
                while at and tree[at] != value:
                    tree[at] = value
                    at >>= 1
                    if at:
                        value = min(tree[2 * at], tree[2 * at + 1])
        return [x for x in ids if x >= 0]

    def pair_key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A number for each pair of ids; no known pair has that of a pair with -1."""
        return (left.astype(np.int64) + 1) * (self.width + 1) + right + 1

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def lay_out(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """A table of ``ranks`` by hashed ``keys``, a fifth full; a taken slot sends a key to the next one."""
        self.bits = (5 * len(keys)).bit_length()
        self.rank_keys, self.rank_values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int32)
        slot = self.slot(keys)
        while len(keys):
            free = np.flatnonzero(self.rank_keys[slot] == -1)
            own, first = np.unique(slot[free], return_index=True)
            first = free[first]
            self.rank_keys[own], self.rank_values[own] = keys[first], ranks[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, slot = keys[rest], ranks[rest], slot[rest] + 1 & len(self.rank_keys) - 1

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent symbols; a symbol of -1 has no pair."""
        key = self.pair_key(left, right)
        slot = self.slot(key)
        have = self.rank_keys[slot]
        rank = self.rank_values[slot]
        wrong = have != key
        rank[wrong] = NO_RANK
        rest = np.flatnonzero(wrong & (have != -1))
        while len(rest):
            slot = slot[rest] + 1 & len(self.rank_keys) - 1 if len(slot) == len(key) else slot + 1 & len(self.rank_keys) - 1
            have = self.rank_keys[slot]
            hit = have == key[rest]
            rank[rest[hit]] = self.rank_values[slot[hit]]
            on = ~hit & (have != -1)
            rest, slot = rest[on], slot[on]
        return rank

    def merge_equal(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many short pre-tokens at once: a row of ``raw`` bytes each, padded to a power of two.

        Each row has its own segment tree; a step merges at the root of every
        tree that still has a pair.
        """
        rows_n, m = raw.shape
        ids = np.full((rows_n, m + 1), -1, np.int32)  # column m: no symbol
        ids[:, :m] = np.where(np.arange(m) < sizes[:, None], self.byte_id[raw], -1)
        tree = np.full((rows_n, 2 * m), NO_LEAF, dtype=np.int32)
        ranks = self.byte_pairs[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]] << LEAF_BITS | np.arange(m - 1, dtype=np.int32)
        tree[:, m:-1] = np.where(np.arange(1, m) < sizes[:, None], ranks, NO_LEAF)
        half = m
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        after = np.tile(np.append(np.arange(1, m + 1), m).astype(np.int16), (rows_n, 1))
        before = np.tile(np.append(np.arange(-1, m - 1), m).astype(np.int16), (rows_n, 1))
        rows = np.flatnonzero(tree[:, 1] < NO_LEAF)
        while len(rows):
            top = tree[rows, 1]
            i = top & (1 << LEAF_BITS) - 1
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = made = self.made_ids[top >> LEAF_BITS]
            ids[rows, j] = -1
            after[rows, i] = k
            before[rows, k] = i
            h = before[rows, i]
            tree[rows, m + j] = NO_LEAF
            tree[rows, m + i] = self.pair_ranks(made, ids[rows, k]) << LEAF_BITS | i
            has = np.flatnonzero(h >= 0)
            left = h[has]
            tree[rows[has], m + left] = self.pair_ranks(ids[rows[has], left], made[has]) << LEAF_BITS | left
            paths = [m + i, m + j, np.where(h >= 0, m + h, m + i)]
            while paths[0][0] > 1:
                paths = [x >> 1 for x in paths]
                for x in paths:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
            rows = rows[tree[rows, 1] < NO_LEAF]
        ids = ids[:, :m]
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in order, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words) + bytes(LONG), np.uint8)
        starts = np.cumsum(sizes) - sizes
        leaves = np.where(sizes > 1, 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64), sizes)
        counts, groups = np.zeros(len(words), np.int64), []
        for m in np.unique(leaves).tolist():
            where = np.flatnonzero(leaves == m)
            for start in range(0, len(where) if m else 0, ROWS if m <= LONG else 1):
                part = where[start : start + (ROWS if m <= LONG else 1)]
                if m > LONG:
                    flat, number = np.array(self.merge_long(words[part[0]]), np.int32), None
                    number = np.array([len(flat)])
                elif m == 1:
                    flat, number = self.byte_id[data[starts[part]]], np.ones(len(part), np.int64)
                else:
                    flat, number = self.merge_equal(data[starts[part][:, None] + np.arange(m)], sizes[part])
                counts[part] = number
                groups.append((part, flat, number))
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for part, flat, number in groups:
            out[np.repeat(ends[part] - np.cumsum(number), number) + np.arange(len(flat))] = flat
        return out, counts

    def merge_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each has: the pattern cuts them, pre-tokens are merged."""
        plan: list[int] = []
        sizes: list[int] = []
        words: dict[bytes, int] = {}
        place = words.setdefault
        for raw in pieces:
            if raw[0] == 32:  # ASCII letters after a space, then at most one mark, need no pattern
                if raw[1:].isalpha():
                    plan.append(place(raw, len(words)))
                    sizes.append(1)
                    continue
                if raw[-1] in b",.;:!?" and raw[1:-1].isalpha():
                    plan += (place(raw[:-1], len(words)), place(raw[-1:], len(words)))
                    sizes.append(2)
                    continue
            cut = self.pretokens(raw.decode("utf-8", "surrogatepass"))
            plan += [place(w.encode("utf-8", "surrogatepass"), len(words)) for w in cut]
            sizes.append(len(cut))
        ids, counts = self.merge_all(list(words))
        ends = np.cumsum(counts)
        of = np.array(plan, np.int64)
        number = counts[of]
        last = np.cumsum(number)
        flat = ids[np.repeat(ends[of] - last, number) + np.arange(int(last[-1]) if len(last) else 0)]
        until = np.append(0, last)[np.cumsum(sizes, dtype=np.int64)] if sizes else np.zeros(0, np.int64)
        return flat, np.diff(until, prepend=0)

    def forget(self) -> None:
        """Empty the table of pieces: rows of three numbers that are the piece, and where its ids stand in the pool."""
        self.table = np.zeros((SLOTS, 4), np.uint64)
        self.pool = np.zeros(POOL, np.int32)
        self.held = self.used = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, and whether the key stands there; else the slot is free."""
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[:, 2] * np.uint64(0x165667B19E3779F9)
        slot = ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - (SLOTS - 1).bit_length())).view(np.int64)
        hit = np.zeros(len(keys), bool)
        rest = np.arange(len(keys))
        while len(rest):
            have, want = self.table[slot[rest]], keys[rest]
            same = (have[:, 0] == want[:, 0]) & (have[:, 1] == want[:, 1]) & (have[:, 2] == want[:, 2])
            hit[rest[same]] = True
            rest = rest[~same & (have[:, 2] != 0)]
            slot[rest] = slot[rest] + 1 & SLOTS - 1
        return slot, hit

    def insert(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Add distinct ``keys`` that the table lacks, while it is at most half full."""
        keys, places = keys[: SLOTS // 2 - self.held], places[: SLOTS // 2 - self.held]
        self.held += len(keys)
        while len(keys):
            slot, _ = self.find(keys)
            own, first = np.unique(slot, return_index=True)
            self.table[own, :3], self.table[own, 3] = keys[first], places[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, places = keys[rest], places[rest]

    def encode_all(self, texts: list[str | bytes]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[list[bytes]] = []
        waiting: list[tuple[list[bytes], int, bytes]] = []
        size = 0
        for text in texts:
            raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
            parts = [x for x in self.at_special.split(raw) if x] if self.at_special and self.at_special.search(raw) else [raw] if raw else []
            done: list[bytes] = []
            out.append(done)
            for part in parts:
                if part in self.special_ids:
                    done.append(self.special_ids[part].tobytes())
                    continue
                for chunk in chunks(part, SLICE) if len(part) > SLICE else [part]:
                    waiting.append((done, len(done), chunk))
                    done.append(b"")
                    size += len(chunk)
                    if size >= 2 * SLICE:
                        self.fill(waiting)
                        waiting, size = [], 0
        if waiting:
            self.fill(waiting)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def fill(self, waiting: list[tuple[list[bytes], int, bytes]]) -> None:
        """Put the ids of each ``(list, place, part of a text)`` in its place."""
        data = b"".join([x[2] for x in waiting])
        sizes = np.fromiter((len(x[2]) for x in waiting), np.int64, len(waiting))
        begins = np.cumsum(sizes) - sizes
        starts = piece_starts(data, begins)
        lengths = np.diff(starts, append=len(data))
        offsets, counts = self.piece_ids(data, starts, lengths)
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(offsets - ends + counts, counts) + np.arange(ends[-1])]
        first = np.append((ends - counts)[np.searchsorted(starts, begins)], ends[-1]).tolist()
        for (done, place, _), a, b in zip(waiting, first, first[1:], strict=False):
            done[place] = ids[a:b].astype("<i4", copy=False).tobytes()

    def piece_ids(self, data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each piece stand, and their number."""
        if self.held >= SLOTS // 2 or self.used > POOL * 3 // 4 or len(self.pool) > POOL:
            self.forget()
        offsets, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = np.flatnonzero(lengths <= SHORT)
        keys = piece_keys(data, starts[short], lengths[short])
        slot, hit = self.find(keys)
        value = self.table[slot, 3]
        offsets[short], counts[short] = (value >> np.uint64(16)).view(np.int64), (value & np.uint64(0xFFFF)).view(np.int64)
        # the distinct pieces that the table lacks, in order of appearance; long ones come from the memo
        lacks = short[~hit]
        far = np.flatnonzero(lengths > SHORT)
        new: dict[bytes, int] = {}
        at = [new.setdefault(data[a : a + n], len(new)) for a, n in zip(starts[lacks].tolist(), lengths[lacks].tolist(), strict=True)]
        longs: dict[bytes, int] = {}
        for a, n in zip(starts[far].tolist(), lengths[far].tolist(), strict=True):
            p = data[a : a + n]
            at.append(longs.setdefault(p, len(new) + len(longs)))
        known = {p: self.long[p] for p in longs if p in self.long or p in self.long.old}  # either generation
        fresh = [p for p in longs if p not in known]
        ids, number = self.merge_pieces([*new, *fresh])
        kept = len(new)
        if longs:
            ends = (np.cumsum(number) * 4).tolist()
            raw = ids.tobytes()
            known.update((p, raw[e - 4 * c : e]) for p, e, c in zip(fresh, ends[kept:], number[kept:].tolist(), strict=True))
            self.long.keep({p: known[p] for p in fresh})
            packed = [known[p] for p in longs]
            number = np.append(number[:kept], np.fromiter(map(len, packed), np.int64, len(packed)) >> 2)
            ids = np.append(ids[: int(number[:kept].sum())], np.frombuffer(b"".join(packed), np.int32))
        if not at:
            return offsets, counts
        place = self.used + np.cumsum(number) - number
        end = self.used + len(ids)
        if end > len(self.pool):  # one very long piece: the pool grows, and is emptied before the next slice
            self.pool = np.append(self.pool, np.zeros(end - len(self.pool), np.int32))
        self.pool[self.used : end] = ids
        where = np.concatenate([lacks, far])
        offsets[where], counts[where] = place[at], number[at]
        if kept:
            first = np.zeros(kept, np.int64)
            first[at[: len(lacks)][::-1]] = np.flatnonzero(~hit)[::-1]  # a place of each new piece among the short ones
            self.insert(keys[first], (place[:kept] << 16 | number[:kept]).astype(np.uint64))
            self.used = int(place[kept - 1] + number[kept - 1])
        return offsets, counts

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, packed: list[bytes]) -> list[str]:
        ids = np.frombuffer(b"".join(packed), "<i4")
        sizes = self.token_sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.token_data[np.repeat(self.token_ends[ids] - ends, sizes) + np.arange(total)].tobytes()
        last = np.append(0, ends)[np.cumsum([len(x) // 4 for x in packed], dtype=np.int64)].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *last], last, strict=False)]

    def decode(self, ids: list[int]) -> str:
        if any(not 0 <= i < self.width for i in ids):
            raise IndexError("an id is outside the vocabulary")
        return self.decode_all([np.array(ids, "<i4").tobytes()])[0]


_CUT = re.compile(rb"(?<=[!-~])[ \n](?=[!-~])")


def chunks(text: bytes, size: int):
    """``text`` in parts of about ``size`` bytes, cut before a single space or newline, where a pre-token begins."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


#: The white-space bytes of ASCII, and the other white-space characters in UTF-8.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WIDE_SPACES = ["\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
_WIDE = np.array(sorted(int.from_bytes(x.encode().rjust(3, b"\0"), "big") for x in _WIDE_SPACES))


def piece_starts(data: bytes, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of ``data`` begin: at ``begins`` and at single spaces and newlines between other characters."""
    raw = np.frombuffer(data, np.uint8)
    padded = np.concatenate([np.full(3, 32, np.uint8), raw, np.full(3, 32, np.uint8)])  # byte i of the data is at i + 3
    at = np.flatnonzero((raw == 32) | (raw == 10))
    before, after = padded[at + 2], padded[at + 4]
    good = ~(_SPACE[before] | _SPACE[after])
    some = np.flatnonzero(good & ((before > 127) | (after > 127)))
    if len(some):
        place, wide = at[some] + 3, padded.astype(np.int64)
        ends_wide = before[some] > 127
        two = wide[place - 2] << 8 | wide[place - 1]
        three = wide[place - 3] << 16 | two
        starts_two = wide[place + 1] << 8 | wide[place + 2]
        starts_three = starts_two << 8 | wide[np.minimum(place + 3, len(padded) - 1)]
        spaced = ends_wide & (np.isin(two, _WIDE) | np.isin(three, _WIDE)) | (after[some] > 127) & (np.isin(starts_two, _WIDE) | np.isin(starts_three, _WIDE))
        good[some[spaced]] = False
    mark = np.zeros(len(raw) + 1, bool)
    mark[at[good]] = True
    mark[begins - 1] = False  # a space that ends one part has nothing after it
    mark[begins] = True
    return np.flatnonzero(mark[:-1])


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def piece_keys(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Three numbers for each piece of at most ``SHORT`` bytes: its bytes, zeros, and its length as the last byte."""
    padded = data + bytes(32)
    words = np.ndarray((len(data) + 25,), "<u8", padded, 0, (1,))  # the 8 bytes from any place
    keys = np.empty((len(starts), 3), np.uint64)
    for i in range(3):
        keys[:, i] = words[starts + 8 * i] & _MASKS[np.clip(lengths - 8 * i, 0, 8)]
    keys[:, 2] |= lengths.astype(np.uint64) << np.uint64(56)
    return keys


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def ids_array(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """``key, ids array<int>`` and, if asked, ``decoded`` (the ids decoded again); one row per row."""
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    source = docs.select(F.col(key).alias("key"), text_or_empty(text).cast("binary").alias("text"))
    fields = [T.StructField(key, source.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    names = [key, "ids", "decoded"][: 2 + decoded]

    def run(batches):
        c = codec(path)
        for whole in batches:
            for batch in rows_in_slices(whole, "text", SLICE):
                packed = c.encode_all(batch.column(1).to_pylist())
                columns = [batch.column(0), ids_array(packed)]
                if decoded:
                    columns.append(pa.array(c.decode_all(packed), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, T.StructType(fields + [T.StructField("decoded", T.StringType())] * decoded))


def decode(frame: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``key, text`` from an array of ids; ids outside the vocabulary raise ``IndexError``."""
    prepare(frame.sparkSession)
    path = vocabulary or default_vocabulary()
    source = frame.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x) for x in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    return source.mapInArrow(run, T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("text", T.StringType())]))
