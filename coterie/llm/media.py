"""Media columns: ISO media containers indexed by their boxes.

``index`` walks nested boxes, decodes the sample tables and gives codec,
duration, sample count and the byte range of each key frame, never decoding a
payload.  ``store`` wraps a payload
losslessly as uncompressed 8-bit frames of 8 x 8 samples, so that every media
column has a plain form to test against; ``payload`` reads bytes back through
the sample tables.

Every field is read within its own box, and boxes are walked with a stack of
their ends, so no file can make a reader fail: whatever breaks the format becomes
the row's ``error``.

Defined results: null, empty or malformed bytes, also boxes nested deeper than
``DEEPEST``, give null fields and the reason in ``error``; a track without a sync
table has only key frames; of several tracks the first video track counts, else
the first one; fragments outside the movie box are not indexed; equal rows give
equal rows, an empty table none; columns besides the key and the text or
container are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm.common import prepare, rows_in_slices, text_or_empty

NESTED = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta"])
#: Levels of nested boxes.
DEEPEST = 32
SIDE = 8
FRAME = SIDE * SIDE
#: Frames a second, frames from one key frame to the next, frames of a chunk in `store`.
RATE, GROUP, CHUNK = 25, 16, 64


class Malformed(ValueError):
    """A container that breaks its format."""


def walk(data):
    """``(path, first byte of the content, end)`` of every box, parents first."""
    at, ends, path = 0, [len(data)], ()
    while True:
        while ends and at >= ends[-1]:
            ends.pop()
            path = path[:-1]
        if not ends:
            return
        end = ends[-1]
        if end - at < 8:
            raise Malformed("cut box header")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise Malformed("cut box header")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Malformed(f"box {kind!r} of {size} bytes")
        yield (*path, kind), at + head, at + size
        if kind in NESTED:
            if len(ends) > DEEPEST:
                raise Malformed(f"boxes nested deeper than {DEEPEST}")
            ends.append(at + size)
            path = (*path, kind)
            at += head
        else:
            at += size


def fields(kind: str, data, at: int, end: int, skip: int) -> tuple:
    """Big-endian numbers ``skip`` bytes into the box whose content is ``at`` to ``end``."""
    if at + skip + struct.calcsize(kind) > end:
        raise Malformed("field beyond its box")
    return struct.unpack_from(kind, data, at + skip)


@dataclass
class Track:
    kind: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    tables: dict = field(default_factory=dict)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and size of every sample."""
        sizes = self.tables.get("sizes", np.zeros(0, np.int64))
        offsets, runs = self.tables.get("offsets", np.zeros(0, np.int64)), self.tables.get("runs", np.zeros((0, 3), np.int64))
        if not len(sizes):
            return sizes, sizes
        if not len(offsets) or not len(runs) or runs[0, 0] != 1:
            raise Malformed("samples without chunks")
        reach = np.diff(np.append(runs[:, 0], len(offsets) + 1))
        if np.any(reach < 0):
            raise Malformed("chunk runs out of order")
        per_chunk = np.repeat(runs[:, 1], reach)
        if len(per_chunk) != len(offsets) or np.any(per_chunk > len(sizes)) or per_chunk.sum() != len(sizes):
            raise Malformed("chunks and samples differ in number")
        chunk = np.repeat(np.arange(len(offsets)), per_chunk)
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(per_chunk) - per_chunk
        return offsets[chunk] + before - before[np.minimum(first, len(sizes) - 1)][chunk], sizes

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte range of each sync sample."""
        starts, sizes = self.samples()
        sync = self.tables.get("sync")
        sync = np.arange(len(sizes)) if sync is None else sync - 1
        if len(sync) and (sync.min() < 0 or sync.max() >= len(sizes)):
            raise Malformed("sync sample out of range")
        return [(int(starts[i]), int(starts[i] + sizes[i])) for i in sync]


def table(data, at: int, end: int, skip: int, kind: str, columns: int) -> np.ndarray:
    """A counted table of big-endian numbers that begins ``skip`` bytes into the box."""
    (count,) = fields(">I", data, at, end, skip)
    width = np.dtype(kind).itemsize * columns
    if at + skip + 4 + count * width > end:
        raise Malformed("table beyond its box")
    found = np.frombuffer(data, kind, count * columns, at + skip + 4)
    if found.size and found.max() >= 1 << 62:
        raise Malformed("number beyond any file")
    return found.astype(np.int64).reshape(-1, columns)


def parse(data: bytes) -> list[Track]:
    tracks: list[Track] = []
    for path, at, end in walk(data):
        name = path[-1]
        if name == b"trak":
            tracks.append(Track())
        if len(path) < 2 or path[0] != b"moov" or not tracks:
            continue
        t = tracks[-1]
        if name == b"mdhd":
            (version,) = fields(">B", data, at, end, 0)
            t.timescale, t.duration = fields(">IQ", data, at, end, 20) if version else fields(">II", data, at, end, 12)
            if t.duration >= 1 << 63:
                raise Malformed("duration beyond 63 bits")
        elif name == b"hdlr":
            t.kind = fields(">4s", data, at, end, 8)[0].decode("latin-1")
        elif name == b"stsd":
            if fields(">I", data, at, end, 4)[0]:
                t.codec = fields(">4s", data, at, end, 12)[0].decode("latin-1")
                if t.kind == "vide" and end - at >= 44:
                    t.width, t.height = fields(">HH", data, at, end, 40)
        elif name == b"stts":
            t.tables["times"] = table(data, at, end, 4, ">u4", 2)
        elif name == b"stsc":
            t.tables["runs"] = table(data, at, end, 4, ">u4", 3)
        elif name == b"stsz":
            size, count = fields(">II", data, at, end, 4)
            if size and count * size > len(data):
                raise Malformed("more samples than bytes")
            t.tables["sizes"] = np.full(count, size, np.int64) if size else table(data, at, end, 8, ">u4", 1)[:, 0]
        elif name in (b"stco", b"co64"):
            t.tables["offsets"] = table(data, at, end, 4, ">u4" if name == b"stco" else ">u8", 1)[:, 0]
        elif name == b"stss":
            t.tables["sync"] = table(data, at, end, 4, ">u4", 1)[:, 0]
    return tracks


def chosen(data: bytes) -> Track:
    tracks = parse(data)
    if not tracks:
        raise Malformed("no track")
    return next((t for t in tracks if t.kind == "vide"), tracks[0])


def payload(data: bytes, track: Track) -> bytes:
    """The bytes of all samples in order."""
    starts, sizes = track.samples()
    if not len(starts):
        return b""
    ends = starts + sizes
    if starts.min() < 0 or ends.max() > len(data):
        raise Malformed("samples beyond the file")
    breaks = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(starts[np.append(0, breaks)].tolist(), ends[np.append(breaks - 1, len(ends) - 1)].tolist(), strict=True))


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def counted(kind: bytes, rows: np.ndarray, number: str = ">u4") -> bytes:
    return box(kind, struct.pack(">II", 0, len(rows)), np.ascontiguousarray(rows).astype(number).tobytes())


def store(content: bytes) -> bytes:
    """A container of ``content``, whose length is a positive multiple of ``FRAME``."""
    n, rest = divmod(len(content), FRAME)
    if rest or not n:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    media = box(b"mdat", content)
    first = len(head) + len(media) - len(content)
    chunks = -(-n // CHUNK)
    runs = [(1, min(n, CHUNK), 1)] + ([(chunks, n - (chunks - 1) * CHUNK, 1)] if chunks > 1 and n % CHUNK else [])
    offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    tables = box(
        b"stbl",
        box(b"stsd", struct.pack(">II", 0, 1), entry),
        counted(b"stts", np.array([[n, 1]])),
        counted(b"stss", np.arange(1, n + 1, GROUP)),
        counted(b"stsc", np.array(runs)),
        box(b"stsz", struct.pack(">III", 0, FRAME, n)),
        counted(b"stco", offsets) if offsets[-1] < 2**32 else counted(b"co64", offsets, ">u8"),
    )
    info = box(b"minf", box(b"vmhd", struct.pack(">IHHHH", 1, 0, 0, 0, 0)), box(b"dinf", box(b"dref", struct.pack(">II", 0, 1), box(b"url ", struct.pack(">I", 1)))), tables)
    mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, RATE, n, 0x55C4, 0)), box(b"hdlr", bytes(8), b"vide", bytes(12), b"frames\0"), info)
    track = box(b"trak", box(b"tkhd", struct.pack(">IIIIII", 7, 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), matrix, struct.pack(">II", SIDE << 16, SIDE << 16)), mdia)
    movie = box(b"mvhd", struct.pack(">IIIIIIH", 0, 0, 0, RATE, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return head + media + box(b"moov", movie, track)


INDEX = "codec string, kind string, width int, height int, timescale long, duration long, n_samples long, keyframes array<struct<start:long,end:long>>, error string"


def index_row(data: bytes | None) -> dict:
    try:
        t = chosen(data or b"")
        ranges = [{"start": a, "end": b} for a, b in t.keyframes()]
        if any(r["end"] > len(data) for r in ranges):
            raise Malformed("samples beyond the file")
        return {"codec": t.codec, "kind": t.kind, "width": t.width, "height": t.height, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.tables.get("sizes", ())), "keyframes": ranges, "error": None}
    except Malformed as e:
        return dict.fromkeys(x.split()[0] for x in ("codec", "kind", "width", "height", "timescale", "duration", "n_samples", "keyframes")) | {"error": str(e)}


def index(frame: DataFrame, key: str, media: str) -> DataFrame:
    """``key`` and the index of the container in binary column ``media``, one row per row."""
    prepare(frame.sparkSession)
    source = frame.select(F.col(key).alias("key"), F.col(media).alias("media"))
    schema = source.select("key").schema
    for f in frame.sparkSession.createDataFrame([], INDEX).schema:
        schema = schema.add(f)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for whole in batches:
            for batch in rows_in_slices(whole, "media"):
                rows = [index_row(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[f.name] for r in rows], to_arrow_type(f.dataType)) for f in schema.fields[1:])], schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % FRAME or (0 if raw else FRAME)), len(raw)


TEXTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as a container, read it back through its sample tables, and describe both.

    ``feature`` is ``codec;width x height;timescale;duration;samples;key frame ranges``.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    schema = source.select("key").schema
    for part in TEXTS.split(", "):
        schema = schema.add(*part.split())

    def describe(text: str) -> tuple:
        content, n = padded(text)
        media = store(content)
        track = chosen(media)
        back = payload(media, track)
        ranges = ",".join(f"{a}-{b}" for a, b in track.keyframes())
        feature = f"{track.codec.strip()};{track.width}x{track.height};{track.timescale};{track.duration};{len(track.tables['sizes'])};{ranges}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches):
        for whole in batches:
            for batch in rows_in_slices(whole, "text"):
                columns = list(zip(*map(describe, batch.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in columns)], schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
