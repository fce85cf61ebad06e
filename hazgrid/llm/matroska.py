"""Media columns: Matroska files in binary columns, written and parsed into packet tables.

An EBML element is an id and a size of variable length, then that many bytes. The parser walks Segment, Info, Tracks,
Clusters (with SimpleBlocks and BlockGroups, in all four kinds of lacing) and Cues, and gives each packet's track, time
and byte range, so that readers can fetch single packets from a stored file.

Scale: map-only, a file at a time; memory is that of a few texts or files. A file is one binary value, so a table of files
splits and recovers like any other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazgrid.llm.tokens import slices

# Ids of the elements that are written or read.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
REFERENCE_BLOCK, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0xFB, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS, EBML}
DOC_TYPES = {b"matroska", b"webm"}
#: What ends a Segment of unknown size, and what ends a Cluster of unknown size.
ENDS = {SEGMENT: {EBML, SEGMENT}, CLUSTER: {EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}}

RATE = 8000  # samples a second, of one 8-bit channel
FRAME = 64  # samples in a packet
LACED = 8  # packets in a block
BLOCKS = 32  # blocks in a cluster


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(id_: int, body: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(id_: int, n: int) -> bytes:
    return element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(id_: int, x: float) -> bytes:
    return element(id_, np.array(x, ">f8").tobytes())


def laced(frames: list[bytes], lacing: int) -> bytes:
    """Frames behind one block header's flags: lacing 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if lacing == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == 3:
        head += _size(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            step = len(b) - len(a)
            width = next(w for w in range(1, 9) if abs(step) < (1 << (7 * w - 1)) - 1)
            head += _size(step + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def block(track: int, offset: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    return _size(track) + offset.to_bytes(2, "big", signed=True) + bytes([(0x80 if key else 0) | lacing << 1]) + laced(frames, lacing)


def _head(duration_ms: float) -> tuple[bytes, bytes, bytes]:
    header = element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, duration_ms) + element(MUXING_APP, b"hazgrid") + element(WRITING_APP, b"hazgrid"))
    audio = element(AUDIO, _float(SAMPLING, float(RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + audio))
    return header, info, tracks


def write(payload: bytes) -> bytes:
    """``payload`` (a multiple of FRAME bytes) as 8-bit samples of one track: packets of FRAME samples, laced by fixed size
    into blocks of LACED, BLOCKS blocks a cluster, and a cue for each cluster."""
    per_block, per_cluster = FRAME * LACED, FRAME * LACED * BLOCKS
    header, info, tracks = _head(1000 * len(payload) / RATE)
    body, cues = [info, tracks], b""
    position = len(info) + len(tracks)
    for start in range(0, len(payload), per_cluster):
        ms = 1000 * start // RATE
        blocks = []
        for at in range(start, min(start + per_cluster, len(payload)), per_block):
            samples = payload[at : at + per_block]
            n = len(samples) // FRAME
            lace = bytes([n - 1]) if n > 1 else b""
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + (1000 * at // RATE - ms).to_bytes(2, "big") + bytes([0x80 | (4 if n > 1 else 0)]) + lace + samples))
        cluster = element(CLUSTER, _uint(TIMESTAMP, ms) + b"".join(blocks))
        cues += element(CUE_POINT, _uint(CUE_TIME, ms) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, position)))
        body.append(cluster)
        position += len(cluster)
    body.append(element(CUES, cues))
    return header + element(SEGMENT, b"".join(body))


class BadMatroska(ValueError):
    """The bytes aren't a Matroska file that this parser reads."""


@dataclass
class Parsed:
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, cluster, block, time in ns, start, end, key frame, lacing)
    packets: list[tuple[int, int, int, int, int, int, bool, int]] = field(default_factory=list)
    #: (time in ns, track, byte position of the cluster in the file)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    #: nanoseconds of a frame, by track; 0 where the file doesn't say
    durations: dict[int, int] = field(default_factory=dict)


def _float_of(data: bytes) -> float:
    if len(data) not in (0, 4, 8):
        raise BadMatroska(f"a float of {len(data)} bytes")
    return float(np.frombuffer(data, f">f{len(data)}")[0]) if data else 0.0


def _vint(data: bytes, at: int, keep_mark: bool, end: int) -> tuple[int, int]:
    if at >= end or data[at] == 0:
        raise BadMatroska(f"no number of variable length at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise BadMatroska(f"number cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    return (value if keep_mark else value & ((1 << 7 * width) - 1)), at + width


def _children(data: bytes, at: int, end: int, ends: Collection[int] = ()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its body), up to ``end`` or an id of ``ends``. A Segment or Cluster of unknown
    size goes to the next element that can't be within it."""
    while at < end:
        id_, p = _vint(data, at, True, end)
        if id_ in ends:
            return
        size, body = _vint(data, p, False, end)
        stop = body + size
        if size == (1 << 7 * (body - p)) - 1 and id_ in ENDS:
            stop = body
            for _, _, _, stop in _children(data, body, end, ENDS[id_]):
                pass
        if stop > end:
            raise BadMatroska(f"element {id_:x} at {at} goes beyond its parent")
        yield id_, at, body, stop
        at = stop


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose data starts at ``at``."""
    if lacing == 0:
        return [(at, end)]
    if at >= end:
        raise BadMatroska(f"lacing cut off at {at}")
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        size, rest = divmod(end - at, n)
        if rest:
            raise BadMatroska(f"frames of fixed size don't fill the block at {at}")
        return [(at + i * size, at + (i + 1) * size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise BadMatroska(f"lacing cut off at {at}")
                size, at, last = size + data[at], at + 1, data[at] < 255
                if last:
                    break
        else:
            value, p = _vint(data, at, False, end)
            size = value if i == 0 else sizes[-1] + value - ((1 << (7 * (p - at) - 1)) - 1)
            at = p
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise BadMatroska(f"frames go beyond the block at {at}")
    ends = np.cumsum(sizes).tolist()
    return [(at + b - s, at + b) for s, b in zip(sizes, ends, strict=True)]


def parse(data: bytes) -> Parsed:
    """Packets, tracks and cues of a file, in file order. Raises BadMatroska where an element doesn't fit its parent."""
    out = Parsed()
    top = list(_children(data, 0, len(data)))
    if not top or top[0][0] != EBML or not any(k == DOC_TYPE and data[a:b].rstrip(b"\0") in DOC_TYPES for k, _, a, b in _children(data, *top[0][2:])):
        raise BadMatroska("no EBML header of a Matroska file")
    for id_, _, base, stop in top[1:]:
        if id_ != SEGMENT:
            continue
        for kind, start, at, end in _children(data, base, stop):
            if kind == INFO:
                for k, _, a, b in _children(data, at, end):
                    if k == TIMESTAMP_SCALE:
                        out.scale = int.from_bytes(data[a:b], "big")
                    elif k == DURATION:
                        out.duration = _float_of(data[a:b])
            elif kind == TRACKS:
                for k, _, a, b in _children(data, at, end):
                    if k != TRACK_ENTRY:
                        continue
                    entry = {k: data[x:y] for k, _, x, y in _children(data, a, b)}
                    number = int.from_bytes(entry.get(TRACK_NUMBER, b""), "big")
                    out.tracks[number] = {"type": int.from_bytes(entry.get(TRACK_TYPE, b""), "big"), "codec": entry.get(CODEC_ID, b"").decode("ascii", "replace")}
                    out.durations[number] = int.from_bytes(entry.get(DEFAULT_DURATION, b""), "big")
            elif kind == CLUSTER:
                _cluster(data, at, end, out)
                out.clusters.append(start)
            elif kind == CUES:
                for k, _, a, b in _children(data, at, end):
                    if k != CUE_POINT:
                        continue
                    time, places = 0, []
                    for k, _, x, y in _children(data, a, b):
                        if k == CUE_TIME:
                            time = int.from_bytes(data[x:y], "big")
                        elif k == CUE_TRACK_POSITIONS:
                            p = {i: int.from_bytes(data[u:v], "big") for i, _, u, v in _children(data, x, y)}
                            places.append((p.get(CUE_TRACK, 0), base + p.get(CUE_CLUSTER_POSITION, 0)))
                    out.cues += [(time * out.scale, track, place) for track, place in places]
    return out


def _cluster(data: bytes, at: int, end: int, out: Parsed) -> None:
    time, no = 0, 0
    for kind, _, a, b in _children(data, at, end):
        if kind == TIMESTAMP:
            time = int.from_bytes(data[a:b], "big")
            continue
        if kind == SIMPLE_BLOCK:
            ranges = [(a, b, None, None)]
        elif kind == BLOCK_GROUP:
            parts = list(_children(data, a, b))
            alone = all(k != REFERENCE_BLOCK for k, *_ in parts)
            lasts = [int.from_bytes(data[x:y], "big") for k, _, x, y in parts if k == BLOCK_DURATION]
            ranges = [(x, y, alone, lasts[0] if lasts else None) for k, _, x, y in parts if k == BLOCK]
        else:
            continue
        for x, y, alone, lasts in ranges:
            track, p = _vint(data, x, False, y)
            if p + 3 > y:
                raise BadMatroska(f"block cut off at {x}")
            offset, flags = int.from_bytes(data[p : p + 2], "big", signed=True), data[p + 2]
            lacing = flags >> 1 & 3
            frames = _frames(data, p + 3, y, lacing)
            step = lasts * out.scale // len(frames) if lasts is not None else out.durations.get(track, 0)
            start = (time + offset) * out.scale
            if not -(1 << 63) <= start + step * len(frames) < 1 << 63 or track >= 1 << 31:
                raise BadMatroska(f"time or track of the block at {x} is out of range")
            key = bool(flags & 0x80) if alone is None else alone
            out.packets += [(track, len(out.clusters), no, start + i * step, s, e, key, lacing) for i, (s, e) in enumerate(frames)]
            no += 1


PACKETS = "doc_id long, packet long, track int, cluster int, block int, time_ns long, start long, end long, key boolean, lacing int, error string"


def packet_table(files: DataFrame, column: str = "media") -> DataFrame:
    """One row a packet of each file in the binary ``column``. A null file has no rows; one that can't be parsed has one row
    with error set and nothing else. Repeated rows give repeated packets, an empty table none; further columns are ignored.

    A frame of a lace comes after those before it by the block's duration in equal parts, or else by the track's default
    duration; where a file says neither, all frames of a lace have the block's time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PACKETS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("_media"), strict=True):
                if not value.is_valid:
                    continue
                try:
                    rows += [(doc_id, i, *p, None) for i, p in enumerate(parse(value.as_py()).packets)]
                except BadMatroska as why:
                    rows.append((doc_id, *[None] * 9, str(why)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("_media")).mapInArrow(run, PACKETS)


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 and zero bytes up to a positive multiple of 64; and its length before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data)), len(data)


def feature(samples: np.ndarray, parsed: Parsed) -> str:
    """Packets, clusters, cues and milliseconds of a file; mean and deviation of its samples; and the shares in percent of its
    energy in four bands of frequency, averaged over its packets."""
    frames = samples.reshape(-1, FRAME).astype(np.float32) - 128
    power = np.zeros(FRAME // 2 + 1)
    for at in range(0, len(frames), 4096):
        power += (np.abs(np.fft.rfft(frames[at : at + 4096], axis=1)) ** 2).sum(axis=0)
    bands = [power[1:5].sum(), power[5:9].sum(), power[9:17].sum(), power[17:].sum()]
    total = sum(bands) or 1.0
    shares = ",".join(f"{100 * b / total:.1f}" for b in bands)
    return f"packets={len(parsed.packets)};clusters={len(parsed.clusters)};cues={len(parsed.cues)};ms={parsed.duration:g};mean={samples.mean():.2f};sd={samples.std():.2f};bands={shares}"


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Each whole text as a Matroska file, read back by its packet table: sizes, digests and a feature of what was read;
    with_media adds the file. Null texts count as empty; repeated rows give repeated results, an empty table none; further
    columns are ignored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = []
                for text in part.column("_text").to_pylist():
                    payload, n = padded(text)
                    media = write(payload)
                    parsed = parse(media)
                    view = memoryview(media)
                    read = b"".join([view[p[4] : p[5]] for p in parsed.packets])
                    samples = np.frombuffer(read, np.uint8)
                    row = (n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples, parsed))
                    rows.append((*row, media))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                names = [f.split()[0] for f in STORED.split(", ")] + ["media"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays][: len(names) - (not with_media)], names[: len(names) - (not with_media)])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    return source.mapInArrow(run, STORED + (", media binary" if with_media else ""))


def op3_media_columns(spark, sf_dir):
    """Every document stored as a Matroska file and read back."""
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
