"""MPEG transport streams as a media column.

Writer: the payload is cut into access units; each becomes a PES packet of a private stream with its own
timestamp, cut into packets of 188 bytes. The first packet of a unit has an adaptation field with a clock
reference and the random-access flag. A program association and a program map table come first.
Reader: finds the program and its stream through the tables (checking their CRC), checks the continuity
counters, reassembles the elementary packets, and gives timestamps and random-access points.

Defined cases: a null or empty text is one padding block of spaces; texts of any length are streamed in
units; equal texts give equal values; repeated rows stay; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets, private stream 1
UNIT = 192 * 64  # bytes of an access unit
TICKS = 3003  # of the 90 kHz clock from unit to unit
PES_HEADER = 14
FIRST_ROOM, ROOM = 176, 184  # bytes of PES data in the first and in a later packet of a unit


def pad(data: bytes, block: int = 192) -> bytes:
    """data with spaces up to a positive multiple of block."""
    return data + b" " * ((-len(data)) % block if data else block)


def _mpeg_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """A packet that holds one section of a program table."""
    section = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section += _mpeg_crc(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


TABLES = _table(PAT_PID, 0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + _table(
    PMT_PID, 0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _units(data: np.ndarray, first: int, counter: int) -> np.ndarray:
    """Packets of access units of one length: data has a row for each; first is the number of the first unit."""
    n, size = data.shape
    later = max(0, -(-(PES_HEADER + size - FIRST_ROOM) // ROOM))
    packets = 1 + later
    out = np.full((n, packets, PACKET), 0xFF, np.uint8)
    ticks = (np.arange(first, first + n, dtype=np.uint64) * TICKS) % (1 << 33)
    pes = np.empty((n, PES_HEADER + size), np.uint8)
    pes[:, :9] = np.frombuffer(bytes([0, 0, 1, STREAM_ID, 0, 0, 0x84, 0x80, 5]), np.uint8)
    length = size + 8
    pes[:, 4], pes[:, 5] = length >> 8, length & 0xFF
    pes[:, 9] = 0x21 | ((ticks >> np.uint64(29)) & np.uint64(0x0E)).astype(np.uint8)
    pes[:, 10] = ((ticks >> np.uint64(22)) & np.uint64(0xFF)).astype(np.uint8)
    pes[:, 11] = ((ticks >> np.uint64(14)) & np.uint64(0xFE)).astype(np.uint8) | 1
    pes[:, 12] = ((ticks >> np.uint64(7)) & np.uint64(0xFF)).astype(np.uint8)
    pes[:, 13] = ((ticks << np.uint64(1)) & np.uint64(0xFE)).astype(np.uint8) | 1
    pes[:, 14:] = data
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
    out[:, 0, 1] |= 0x40
    out[:, :, 3] = 0x10 | ((counter + np.arange(n * packets)) % 16).reshape(n, packets).astype(np.uint8)
    # The first packet: adaptation field with the random-access flag and the clock; stuffed if the unit is short.
    head = min(FIRST_ROOM, pes.shape[1])
    out[:, 0, 3] |= 0x20
    out[:, 0, 4] = PACKET - 5 - head
    out[:, 0, 5] = 0x50
    out[:, 0, 6] = ((ticks >> np.uint64(25)) & np.uint64(0xFF)).astype(np.uint8)
    out[:, 0, 7] = ((ticks >> np.uint64(17)) & np.uint64(0xFF)).astype(np.uint8)
    out[:, 0, 8] = ((ticks >> np.uint64(9)) & np.uint64(0xFF)).astype(np.uint8)
    out[:, 0, 9] = ((ticks >> np.uint64(1)) & np.uint64(0xFF)).astype(np.uint8)
    out[:, 0, 10] = ((ticks << np.uint64(7)) & np.uint64(0x80)).astype(np.uint8) | 0x7E
    out[:, 0, 11] = 0
    out[:, 0, PACKET - head :] = pes[:, :head]
    rest = pes[:, head:]
    full = rest.shape[1] // ROOM
    if full:
        out[:, 1 : 1 + full, 4:] = rest[:, : full * ROOM].reshape(n, full, ROOM)
    tail = rest[:, full * ROOM :]
    if tail.shape[1]:
        stuffing = ROOM - tail.shape[1]
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = stuffing - 1
        if stuffing > 1:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - tail.shape[1] :] = tail
    return out.reshape(-1, PACKET)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds the payload."""
    data = np.frombuffer(payload, np.uint8)
    full = len(data) // UNIT
    parts = [np.frombuffer(TABLES, np.uint8).reshape(-1, PACKET)]
    counter = 0
    if full:
        parts.append(_units(data[: full * UNIT].reshape(full, UNIT), 0, 0))
        counter = len(parts[-1]) % 16
    if len(data) > full * UNIT:
        parts.append(_units(data[full * UNIT :].reshape(1, -1), full, counter))
    return np.concatenate(parts).tobytes()


def _section(packets: np.ndarray, pids: np.ndarray, pid: int) -> bytes:
    """The body of the first section on a PID."""
    found = np.flatnonzero(pids == pid)
    if not len(found):
        raise ValueError(f"no table on PID {pid:#x}")
    raw = packets[found[0]].tobytes()[4:]
    raw = raw[1 + raw[0] :]
    length = 3 + ((raw[1] & 0x0F) << 8 | raw[2])
    if _crc_of(raw[:length]):
        raise ValueError(f"table on PID {pid:#x} is damaged")
    return raw[8 : length - 4]


_crcs: dict[bytes, int] = {}


def _crc_of(section: bytes) -> int:
    """Remembered, as nearly all streams have the same tables."""
    if section not in _crcs:
        if len(_crcs) > 1000:
            _crcs.clear()
        _crcs[section] = _mpeg_crc(section)
    return _crcs[section]


def demux(stream: bytes) -> dict:
    """payload, timestamps, random_access (numbers of the units with the flag), packets, breaks (continuity errors)."""
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("sync byte lost")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pat = _section(packets, pids, PAT_PID)
    pmt_pid = (pat[2] & 0x1F) << 8 | pat[3]
    pmt = _section(packets, pids, pmt_pid)
    at = 4 + ((pmt[2] & 0x0F) << 8 | pmt[3])
    pid = (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]
    own = packets[pids == pid]
    counters = own[:, 3] & 0x0F
    breaks = int(((counters[1:].astype(np.int16) - counters[:-1]) % 16 != 1).sum())
    adapted = (own[:, 3] & 0x20) != 0
    offset = np.where(adapted, 5 + own[:, 4].astype(np.int32), 4)
    starts = np.flatnonzero(own[:, 1] & 0x40)
    flagged = adapted & (own[:, 4] > 0) & ((own[:, 5] & 0x40) != 0)
    body = own[np.arange(PACKET) >= offset[:, None]]
    place = np.concatenate(([0], np.cumsum(PACKET - offset)))
    edges = [*place[starts].tolist(), int(place[-1])]
    times, units = [], []
    for a, b in zip(edges, edges[1:], strict=False):
        pes = body[a:b]
        if pes[0] or pes[1] or pes[2] != 1:
            raise ValueError("no start code at the start of a unit")
        h = pes[:14].tolist()
        times.append((h[9] >> 1 & 7) << 30 | h[10] << 22 | (h[11] >> 1) << 15 | h[12] << 7 | h[13] >> 1)
        units.append(pes[9 + h[8] : 6 + (h[4] << 8 | h[5])])
    return {"payload": np.concatenate(units).tobytes() if units else b"", "timestamps": times, "random_access": np.searchsorted(starts, np.flatnonzero(flagged)).tolist(), "packets": len(packets), "breaks": breaks}


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the padded UTF-8 text as a transport stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t.as_py() or b"" for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(work, f"doc_id {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def inspect(stored: DataFrame) -> DataFrame:
    """What is read back from the media column: digests, timestamps, random-access points and a feature string."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, rows = batch.slice(start, 256), []
                for doc, size, media in zip(*(part.column(k) for k in range(3)), strict=True):
                    stream = media.as_py()
                    got = demux(stream)
                    payload = got["payload"]
                    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                    share = counts[counts > 0] / max(1, len(payload))
                    feature = f"packets={got['packets']};units={len(got['timestamps'])};random_access={len(got['random_access'])};breaks={got['breaks']};last_pts={got['timestamps'][-1] if got['timestamps'] else -1};mean={float(counts @ np.arange(256)) / max(1, len(payload)):.6f};entropy={max(0.0, float(-(share * np.log2(share)).sum())):.6f}"
                    rows.append((doc.as_py(), size.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, got["timestamps"], got["random_access"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (part.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access"]
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(work, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<int>")
