"""Language-model scores by an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark: tasks count their texts' words and word pairs, packed as
sorted arrays by hash range, and one task for each range merges them.  A range
becomes a file of sorted hashes and counts in the shared scratch folder, written
under another name and then renamed, so a task that runs again changes nothing.
Workers memory-map these files and look n-grams up by binary search.

Ranges grow in number with the input, so that the text of one fits a task; what
is known of each range (its size, the number of its first word) lies in files of
``BLOCK`` ranges each, and the driver sees a row for each such block.

A word's id is its place among the sorted word hashes, so a word pair is one
64-bit number (mixed to spread over the ranges, exactly invertible).

Tokens are a text's words (A-Z lower-cased, cut at ASCII white space) and one
end token.  Defined results: null and empty texts are the end token alone;
without any training text all scores are null; unknown words get the share that
the continuation distribution leaves for them; repeated rows train as often as
they stand and score alike; a null id is a key like any other and trains too;
columns besides the key and the text are not read, whatever their names.
"""

from __future__ import annotations

import math
import mmap
import os
import sys
import tempfile
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm.common import drop_path, prepare, rows_in_slices, scratch_path, store

#: Bytes of text whose word pairs one range may hold, about; ranges grow in number with the input.
RANGE_BYTES = 8 << 20
#: Words whose values a worker keeps, at most half as many; bounds memory, not results.
SLOTS = 1 << 19
#: Bytes of a word that are hashed together with others; longer words are hashed one by one.
SHORT = 23
SLICE = 2 << 20
#: Keys that a task gathers before it packs them for the shuffle.
GATHER = 2_000_000
#: Ranges whose sizes lie in one file; the driver sees a row for each.
BLOCK = 1 << 16
#: Arrays that a worker maps at a time (the kernel bounds maps of a process).
MOST_MAPS = 20_000
END = xxhash.xxh64_intdigest(b"\n")
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31)) ^ (x >> U(62))) * U(0x319642B2D24D8EC3)
    x = (x ^ (x >> U(27)) ^ (x >> U(54))) * U(0x96DE1B173F119089)
    return x ^ (x >> U(30)) ^ (x >> U(60))


#: A-Z as a-z, and the white-space bytes of ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def hashed_tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's end token last, and the texts' token counts.

    A word's hash depends on its bytes alone: up to ``SHORT`` bytes are three numbers (the last with the
    length), which are mixed one into the other; a longer word has its XXH64.
    """
    sizes = np.fromiter((len(x or b"") for x in texts), np.int64, len(texts))
    raw = _LOWER[np.frombuffer(b"\n".join([x or b"" for x in texts]) + b"\n" + bytes(32), np.uint8)]
    raw[-33:] = 32
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not space[0]:
        starts = np.append(0, starts)
    lengths = np.flatnonzero(~space[:-1] & space[1:]) + 1 - starts
    data = raw.tobytes()
    words = np.ndarray((len(raw) - 7,), "<u8", data, 0, (1,))  # the 8 bytes from any place
    h = np.zeros(len(starts), U)
    for i in (2, 1, 0):
        part = words[np.minimum(starts + 8 * i, len(words) - 1)] & _MASKS[np.clip(lengths - 8 * i, 0, 8)]
        if i == 2:
            part = part | np.minimum(lengths, SHORT + 1).astype(U) << U(56)
        h = mix((h ^ part) + U(0x9E3779B97F4A7C15))
    for at in np.flatnonzero(lengths > SHORT).tolist():
        h[at] = xxhash.xxh64_intdigest(data[starts[at] : starts[at] + lengths[at]])
    counts = np.diff(np.searchsorted(starts, np.cumsum(sizes + 1)), prepend=0) + 1
    out = np.empty(len(h) + len(texts), U)
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), counts - 1)] = h
    out[np.cumsum(counts) - 1] = END
    return np.maximum(out, U(1)), counts  # 0 marks free slots of tables


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range of each key: its place among ``ranges`` equal parts of the 64-bit numbers."""
    return ((keys >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def cut_ranges(keys: np.ndarray, ranges: int):
    """``(range, first, end)`` of each range that sorted ``keys`` touch."""
    which = range_of(keys, ranges)
    starts = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else []
    for a, b in zip(starts, [*starts[1:], len(which)], strict=True):
        yield int(which[a]), int(a), int(b)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (a column for each sum)."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, axis=0, dtype=np.int64) if len(first) else counts.astype(np.int64)


#: Names of stores in Hadoop's addresses, where Arrow has another for the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gcs": "gs"}


def arrow_store(root: str):
    """Arrow's file system and path for an address as Hadoop writes it."""
    import pyarrow.fs as pfs

    scheme, colon, rest = root.partition(":")
    return pfs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


class Files:
    """The model's arrays in the shared folder."""

    def __init__(self, root: str):
        self.root = root

    @property
    def local(self) -> str | None:
        """The folder as a local path, if the shared folder is one."""
        url = urlparse(self.root)
        return url.path if url.scheme in ("", "file") else None

    def write(self, name: str, array: np.ndarray) -> None:
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            temporary = f"{self.local}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
            with open(temporary, "wb") as f:
                np.save(f, array)
            os.replace(temporary, f"{self.local}/{name}.npy")
            return
        fs, path = arrow_store(self.root)
        fs.create_dir(path, recursive=True)
        temporary = f"{path}/.{name}-{os.urandom(8).hex()}"
        with fs.open_output_stream(temporary) as f:
            np.save(f, array)
        fs.move(temporary, f"{path}/{name}.npy")

    def map(self, name: str) -> np.ndarray:
        """The array, memory-mapped; from a remote folder through an unlinked local copy."""
        if self.local:
            with open(f"{self.local}/{name}.npy", "rb") as f:
                return mapped(f)
        fs, path = arrow_store(self.root)
        with tempfile.NamedTemporaryFile() as copy:
            with fs.open_input_stream(f"{path}/{name}.npy") as f:
                while part := f.read(8 << 20):
                    copy.write(part)
            copy.flush()
            copy.seek(0)
            return mapped(copy)


def mapped(f) -> np.ndarray:
    """The array of an open ``.npy`` file as a read-only map that needs no open file."""
    np.lib.format.read_magic(f)
    shape, _, dtype = np.lib.format.read_array_header_1_0(f)
    if 0 in shape:
        return np.zeros(shape, dtype)
    # a tracked map holds a file handle, and a large model has more files than a process may open
    free = {"trackfd": False} if sys.version_info >= (3, 13) else {}
    view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **free)
    return np.frombuffer(view, dtype, math.prod(shape), f.tell()).reshape(shape)


@dataclass
class Model:
    """Where the arrays are, and the totals that scoring needs."""

    root: str
    ranges: int
    first_ids: list[int]  # of each block of ranges: the id of its first word
    block: int  # ranges of a block
    documents: int
    n_tokens: int
    vocabulary: int
    pairs: int = 0
    pair_discounts: tuple = ()
    word_discounts: tuple = ()
    unknown: float = 0.0
    extra: dict = field(default_factory=dict)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    keep = lambda d, most: min(max(d, 0.05), most)  # noqa: E731  small corpora can leave the proper interval
    return keep(d1, 0.95), keep(d2, 1.9), keep(d3, 2.85)


class Lookup:
    """A worker's view of the model: mapped arrays, opened when first touched."""

    def __init__(self, model: Model):
        self.model, self.files, self.maps = model, Files(model.root), {}
        self.forget()
        self.blocks = np.array(model.first_ids, np.int64)

    def array(self, name: str) -> np.ndarray:
        if name not in self.maps:
            if len(self.maps) >= MOST_MAPS:
                self.maps.pop(next(iter(self.maps)))  # it is mapped again when needed
            self.maps[name] = self.files.map(name)
        return self.maps[name]

    def firsts(self, kind: str, block: int) -> np.ndarray:
        """The number of the first key of each range of a block, and of the one after its last."""
        return self.array(f"{kind}-firsts-{block}")

    def first(self, kind: str, which: np.ndarray) -> np.ndarray:
        """The number of the first key of each range."""
        out = np.empty(len(which), np.int64)
        block = which // self.model.block
        for k in np.unique(block).tolist():
            here = block == k
            out[here] = self.firsts(kind, k)[which[here] - k * self.model.block]
        return out

    def range_of_id(self, ids: np.ndarray) -> np.ndarray:
        """The range of each word id."""
        out = np.empty(len(ids), np.int64)
        block = np.searchsorted(self.blocks, ids, side="right") - 1
        for k in np.unique(block).tolist():
            here = block == k
            firsts = self.firsts("word", k)
            out[here] = k * self.model.block + np.searchsorted(firsts[1:], ids[here], side="right")
        return out

    def places(self, kind: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range and place of each distinct sorted key, -1 if absent."""
        which, place = range_of(keys, self.model.ranges), np.full(len(keys), -1, np.int64)
        for r, a, b in cut_ranges(keys, self.model.ranges):
            block, at = divmod(r, self.model.block)
            firsts = self.firsts(kind, block)
            if firsts[at] == firsts[at + 1]:
                continue  # an empty range has no file
            have = self.array(f"{kind}-keys-{r}")
            at = np.searchsorted(have, keys[a:b])
            at[at == len(have)] = 0
            place[a:b] = np.where(have[at] == keys[a:b], at, -1)
        return which, place

    def gather(self, kind: str, which: np.ndarray, place: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Values at range and place (ranges sorted); zero where absent."""
        out = np.zeros((len(place), *like.shape[1:]), like.dtype)
        for r in np.unique(which).tolist():
            a, b = np.searchsorted(which, [r, r + 1])
            found = place[a:b] >= 0
            if found.any():
                out[a:b][found] = self.array(f"{kind}-{r}")[place[a:b][found]]
        return out

    def forget(self) -> None:
        """Empty the table of words: slots with hashes, and for each its row of values."""
        self.slots, self.rows = np.zeros(SLOTS, U), np.zeros(SLOTS, np.int32)
        self.known = {"id": np.zeros(SLOTS // 2, np.int64)}
        if self.model.pairs:
            self.known |= {"count": np.zeros(SLOTS // 2, np.int64), "own": np.zeros((SLOTS // 2, 4), np.uint32)}
        self.held = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key (a hash, never 0), and whether the key stands there; else the slot is free."""
        slot = (keys * U(0x9E3779B97F4A7C15) >> U(64 - (SLOTS - 1).bit_length())).view(np.int64)
        hit = np.zeros(len(keys), bool)
        rest = np.arange(len(keys))
        while len(rest):
            have = self.slots[slot[rest]]
            same = have == keys[rest]
            hit[rest[same]] = True
            rest = rest[~same & (have != 0)]
            slot[rest] = slot[rest] + 1 & SLOTS - 1
        return slot, hit

    def fetch(self, hashes: np.ndarray) -> dict[str, np.ndarray]:
        """Values of sorted distinct word hashes; an unknown word has the vocabulary's size as its id."""
        which, place = self.places("word", hashes)
        found = {"id": np.where(place >= 0, self.first("word", which) + place, self.model.vocabulary)}
        if self.model.pairs:
            found["count"] = self.gather("word-counts", which, place, np.zeros(0, np.int64))
            found["own"] = self.gather("word-own", which, place, np.zeros((0, 4), np.uint32))
        return found

    def values(self, hashes: np.ndarray) -> dict[str, np.ndarray]:
        """Values of any word hashes, by way of the table."""
        if self.held > SLOTS // 4:
            self.forget()
        slot, hit = self.find(hashes)
        row = self.rows[slot].astype(np.int64)
        lacks = np.flatnonzero(~hit)
        if not len(lacks):
            return {k: v[row] for k, v in self.known.items()}
        new, back = np.unique(hashes[lacks], return_inverse=True)
        found = self.fetch(new)
        kept = min(len(new), SLOTS // 2 - self.held)
        for k, v in found.items():
            self.known[k][self.held : self.held + kept] = v[:kept]
        keys, rows = new[:kept], np.arange(self.held, self.held + kept)
        while len(keys):
            slot, _ = self.find(keys)
            own, first = np.unique(slot, return_index=True)
            self.slots[own], self.rows[own] = keys[first], rows[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, rows = keys[rest], rows[rest]
        self.held += kept
        out = {k: v[np.where(hit, row, 0)] for k, v in self.known.items()}
        for k, v in out.items():
            v[lacks] = found[k][back]
        return out

    def pair_ids(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the token before each token and of the token; the vocabulary's size + 1 begins a text."""
        after = self.values(hashes)["id"]
        return before(after, sizes, self.model.vocabulary + 1), after


def before(values: np.ndarray, sizes: np.ndarray, start) -> np.ndarray:
    """The value of the token before each token; ``start`` where a text begins."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[np.cumsum(sizes) - sizes] = start
    return out


def pack_pairs(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(before.astype(U) << U(32) | after.astype(U))


_LOOKUPS: dict[str, Lookup] = {}


def lookup(model: Model) -> Lookup:
    """One lookup for each model in a worker process; the last model is kept."""
    found = _LOOKUPS.get(model.root)
    if found is None or found.model != model:
        _LOOKUPS.clear()
        found = _LOOKUPS[model.root] = Lookup(model)
    return found


PACKED = "part long, keys binary, counts binary"


def packed_rows(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row for each range: sorted keys as steps, byte planes apart, so that the shuffle's codec finds the zeros."""
    planes = [np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for _, keys, _ in parts]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array(planes, pa.binary()), pa.array([p[2].astype("<u4").tobytes() for p in parts], pa.binary())], ["part", "keys", "counts"])


def unpacked_keys(planes: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(U)[:, 0]
    return np.cumsum(steps, dtype=U)


def merge(columns: int):
    """A function that sums the packed rows of one range."""

    def run(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        keys = np.concatenate([unpacked_keys(x) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, columns) for x in table.column("counts").to_pylist()])
        return table.column("part")[0].as_py(), *summed(keys, counts)

    return run


def gathered(parts, ranges: int, most: int):
    """Packed rows of ``(keys, counts)`` parts, summed over about ``most`` keys at a time."""
    held, size = [], 0

    def emit():
        keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        return packed_rows([(r, keys[a:b], counts[a:b]) for r, a, b in cut_ranges(keys, ranges)])

    for keys, counts in parts:
        held.append((keys, counts))
        size += len(keys)
        if size >= most:
            yield emit()
            held, size = [], 0
    if held:
        yield emit()


def write_firsts(sizes: DataFrame, kind: str, ranges: int, files: Files) -> list[int]:
    """Store how many keys precede each range of ``sizes(part, n)``; the same for the blocks of ranges is returned."""
    spark = sizes.sparkSession
    blocks = -(-ranges // BLOCK)
    # a row for each block of ranges
    held = {r["block"]: r["n"] for r in sizes.groupBy(F.floor(F.col("part") / BLOCK).alias("block")).agg(F.sum("n").alias("n")).collect()}
    before = np.cumsum([0, *(held.get(k, 0) for k in range(blocks))]).tolist()
    starts = F.broadcast(spark.createDataFrame([(k, before[k]) for k in range(blocks)], "block long, before long"))

    def write(table: pa.Table) -> pa.Table:
        block, first = table.column("block")[0].as_py(), table.column("before")[0].as_py()
        n = np.zeros(min(BLOCK, ranges - block * BLOCK), np.int64)
        part = table.column("part").to_numpy()
        there = part >= 0
        n[part[there] - block * BLOCK] = table.column("n").to_numpy()[there]
        files.write(f"{kind}-firsts-{block}", first + np.append(0, np.cumsum(n)))
        return pa.table({"block": [block]})

    own = sizes.withColumn("block", F.floor(F.col("part") / BLOCK)).select("block", "part", "n")
    every = own.union(spark.range(blocks).selectExpr("id", "-1L", "0L"))  # a block without keys has its file too
    every.join(starts, "block").groupBy("block").applyInArrow(write, "block long").count()
    return before[:-1]


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count the words and word pairs of all rows and lay the model's arrays out in the shared folder."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    source = docs.select(F.col(text).cast("string").cast("binary").alias("text"))
    n_docs, n_bytes = source.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(1, -(-n_bytes // RANGE_BYTES))
    root = scratch_path(spark, "lm")
    files = Files(root)

    def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.diff(np.append(first, len(keys)))

    def count_words(batches):
        slices = (batch.column(0).to_pylist() for whole in batches for batch in rows_in_slices(whole, "text", SLICE))
        yield from gathered((counted(hashed_tokens(texts)[0]) for texts in slices), ranges, GATHER)

    def write_words(table: pa.Table) -> pa.Table:
        part, keys, counts = merge(1)(table)
        files.write(f"word-keys-{part}", keys)
        files.write(f"word-counts-{part}", counts[:, 0])
        return pa.table({"part": [part], "n": [len(keys)], "total": [int(counts.sum())]})

    sizes, sizes_path = store(source.mapInArrow(count_words, PACKED).groupBy("part").applyInArrow(write_words, "part long, n long, total long"), "lm-words")
    n_words, n_tokens = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    model = Model(root, ranges, write_firsts(sizes.select("part", "n"), "word", ranges, files), BLOCK, n_docs, n_tokens, n_words)
    if not n_docs:
        return model
    if model.vocabulary >= 2**32 - 2:
        raise ValueError("word ids must fit in 32 bits")

    def count_pairs(batches):
        words = lookup(model)
        slices = (batch.column(0).to_pylist() for whole in batches for batch in rows_in_slices(whole, "text", SLICE))
        yield from gathered((counted(pack_pairs(*words.pair_ids(*hashed_tokens(texts)))) for texts in slices), ranges, GATHER)

    stats = "kind string, part long, keys binary, counts binary, n array<long>"

    def write_pairs(table: pa.Table) -> pa.Table:
        """The range's pairs, and for each word the followers it has (by count) and the words it follows."""
        part, keys, counts = merge(1)(table)
        counts = counts[:, 0]
        files.write(f"pair-keys-{part}", keys)
        files.write(f"pair-counts-{part}", counts.astype(np.min_scalar_type(counts.max())))
        pair = unmix(keys)
        before, after = (pair >> U(32)).astype(np.int64), (pair & U(0xFFFFFFFF)).astype(np.int64)
        rows = [{"kind": "total", "part": part, "keys": b"", "counts": b"", "n": [len(keys), *(int((counts == i).sum()) for i in (1, 2, 3, 4))]}]
        ids = np.concatenate([before, after])
        own = np.zeros((len(ids), 4), np.int64)
        own[np.arange(len(before)), np.minimum(counts, 3) - 1] = 1
        own[len(before) :, 3] = 1
        ids, own = summed(ids, own)
        # the start of a text (and no unknown word, in training) has an id beyond the vocabulary
        which = np.full(len(ids), ranges - 1, np.int64)
        which[ids < model.vocabulary] = lookup(model).range_of_id(ids[ids < model.vocabulary])
        for r in np.unique(which).tolist():
            a, b = np.searchsorted(which, [r, r + 1])
            rows.append({"kind": "words", "part": r, "keys": packed_rows([(r, ids[a:b].astype(U), own[a:b])]).column(1)[0].as_py(), "counts": own[a:b].astype("<u4").tobytes(), "n": []})
        return pa.Table.from_pylist(rows, pa.schema([("kind", pa.string()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.list_(pa.int64()))]))

    found, found_path = store(source.mapInArrow(count_pairs, PACKED).groupBy("part").applyInArrow(write_pairs, stats), "lm-stats")

    def write_statistics(table: pa.Table) -> pa.Table:
        """Of each word of the range: followers seen once, twice and more often, and words it follows."""
        part, ids, counts = merge(4)(table)
        block, at = divmod(part, model.block)
        begin, end = lookup(model).firsts("word", block)[at : at + 2].tolist()
        own = np.zeros((end - begin, 4), np.uint32)
        inside = ids < model.vocabulary
        own[(ids[inside] - U(begin)).astype(np.int64)] = counts[inside]
        files.write(f"word-own-{part}", own)
        start = counts[ids == model.vocabulary + 1]
        seen = own[:, 3]
        return pa.table({"part": [part], "start": [start[0].tolist() if len(start) else []], "n": [[int((seen == i).sum()) for i in (1, 2, 3, 4)] + [int((seen > 0).sum())]]}, schema=pa.schema([("part", pa.int64()), ("start", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]))

    per_range, per_range_path = store(found.where("kind = 'words'").select("part", "keys", "counts").groupBy("part").applyInArrow(write_statistics, "part long, start array<long>, n array<long>"), "lm-words")
    every = found.where("kind = 'total'")
    write_firsts(every.select("part", F.col("n")[0].alias("n")), "pair", ranges, files)
    totals = every.select(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(5)]).first()
    *words, start = per_range.select(*[F.sum(F.col("n")[i]) for i in range(5)], F.max("start")).first()  # one range has the start
    for path in (sizes_path, found_path, per_range_path):  # the model's files are all that is left
        drop_path(spark, path)
    model.pairs = totals[0]
    model.pair_discounts, model.word_discounts = discounts(*totals[1:]), discounts(*words[:4])
    d = model.word_discounts
    model.unknown = (d[0] * words[0] + d[1] * words[1] + d[2] * (words[4] - words[0] - words[1])) / model.pairs / (model.vocabulary + 1)
    model.extra = {"start": start or [0, 0, 0, 0]}
    return model


def score_slice(words: Lookup, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``tokens, known tokens, base score, model score`` of each text."""
    m = words.model
    hashes, sizes = hashed_tokens(texts)
    found = words.values(hashes)
    count, own, ids = found["count"], found["own"], found["id"]
    base = np.log10((count + 0.1) / (m.n_tokens + 0.1 * (m.vocabulary + 1)))
    d, seen = np.array([0.0, *m.word_discounts]), own[:, 3].astype(np.int64)
    lower = np.maximum(seen - d[np.minimum(seen, 3)], 0) / m.pairs + m.unknown
    d = np.array([0.0, *m.pair_discounts])
    # what a context leaves to the lower order; all of it where it was never seen
    left = lambda own, count: np.where(count > 0, (own @ d[1:]) / np.maximum(count, 1), 1.0)
    backoff = before(left(own[:, :3].astype(np.float64), count), sizes, left(np.array(m.extra["start"][:3], np.float64), m.documents))
    context = before(count, sizes, m.documents)
    keys, back = np.unique(pack_pairs(before(ids, sizes, m.vocabulary + 1), ids), return_inverse=True)
    which, place = words.places("pair", keys)
    pair = words.gather("pair-counts", which, place, np.zeros(0, np.uint32)).astype(np.float64)
    pair = np.maximum(pair - d[np.minimum(pair, 3).astype(np.int64)], 0)[back]
    p = pair / np.maximum(context, 1) + backoff * lower
    starts = np.cumsum(sizes) - sizes
    total = lambda x: np.add.reduceat(x, starts)
    return sizes, total((count > 0).astype(np.int64)), total(base), total(np.log10(p))


SCORES = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, base_score, score``: log10 probabilities of each text; perplexity is ``10 ** (-score / n_tokens)``."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    schema = source.select("key").schema
    for part in SCORES.split(", "):
        schema = schema.add(*part.split())
    if not model.documents:
        words = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")) + 1
        none = F.lit(None).cast("double")
        return source.select(F.col("key").alias(key), words.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), none.alias("base_score"), none.alias("score"))

    def run(batches):
        words = lookup(model)
        for whole in batches:
            for batch in rows_in_slices(whole, "text", SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, score_slice(words, batch.column(1).to_pylist()))], schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
