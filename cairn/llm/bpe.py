"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte spans. Each merge rank has a bucket: a heap of the list positions
whose pair has that rank. Three levels of 64-bit words mark the ranks with a filled bucket, so that three
find-first-set steps give the lowest rank; the smallest position of its bucket is merged next. Entries
whose pair has changed meanwhile are skipped when they come up. A merge costs a constant number of steps
plus the heap, however long the pre-token is.

Pre-tokens that a worker does not remember share the queue, some hundred at a time. Their spans never join,
and the lowest pair of all is the lowest of its own pre-token, so each is merged as it would be alone; a
filled bucket is found once for all that are in it.

Defined cases: a null or empty text has no ids (digest of no bytes); equal texts give equal rows; a byte
without a rank is an error of the vocabulary; further columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds on memory only: entries after which a worker's memory of encoded pre-tokens turns (it has two generations), the longest pre-token kept, and the bytes of a group of texts (a longer text is one alone).
MEMORY, MEMORY_LENGTH, GROUP = 200_000, 64, 1 << 20
SHARED = 1 << 13  # bytes of the pre-tokens that share the queue, about (a longer one is alone): their lists stay in a core's cache


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """From, to: neighbours of about this size together."""
    if not sizes:
        return iter(())
    before = np.cumsum([0, *sizes])[:-1]
    turns = np.flatnonzero(np.diff(before // most)) + 1
    return pairwise([0, *turns.tolist(), len(sizes)])


class RankQueue:
    """Buckets by rank under a three-level bitmap: low has a bit for each rank, mid for each word of low, top for each word of mid.

    Empty again whenever it has been drained, so that one serves all groups. Its steps stand in line in
    Encoder.merge, where calls would cost as much as they do.
    """

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.bit = [1 << k for k in range(64)]


class Encoder:
    """Ranks, the pre-token pattern and a bounded memory of pre-tokens: their ids, packed as 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.decimals = pa.array([f"{rank} " for rank in range(len(tokens))], pa.large_string())
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(len(tokens))
        self.singles = np.array([ranks.get(bytes([k]), -1) for k in range(256)], np.int32)
        self.pairs = np.array([ranks.get(bytes(divmod(k, 256)), -1) for k in range(65536)], np.int32)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token; none is empty."""
        text, ends = b"".join(pieces), np.cumsum([len(piece) for piece in pieces])
        n, get, queue = len(text), self.ranks.get, self.queue
        buckets, low, mid, bit = queue.buckets, queue.low, queue.mid, queue.bit
        top = 0
        data = np.frombuffer(text, np.uint8).astype(np.int32)
        ranked = np.full(n, -1, np.int32)  # the rank of the pair that starts here, -1 for none
        ranked[:-1] = self.pairs[data[:-1] << 8 | data[1:]]
        ranked[ends - 1] = -1
        places = np.argsort(ranked, kind="stable")
        places = places[np.searchsorted(ranked, 0, sorter=places) :]
        starts = np.flatnonzero(np.diff(ranked[places], prepend=-1))
        filled, places = ranked[places[starts]].tolist(), places.tolist()
        for rank, (start, end) in zip(filled, pairwise([*starts.tolist(), len(places)]), strict=True):
            buckets[rank] = places[start:end]  # positions come in order, so the list is a heap
            word = rank >> 6
            low[word] |= bit[rank & 63]
            mid[word >> 6] |= bit[word & 63]
            top |= bit[word >> 6]
        before, after = np.arange(-1, n), list(range(1, n + 1))
        before[ends] = -1  # no position before the first of a pre-token
        pair, before, own = ranked.tolist(), before.tolist(), self.singles[data].tolist()  # own: the id of the span that starts here
        while top:
            group = (top & -top).bit_length() - 1  # find the first set bit, level by level
            bits = mid[group]
            word = (group << 6) + (bits & -bits).bit_length() - 1
            bits = low[word]
            lowest = (word << 6) + (bits & -bits).bit_length() - 1
            full, least = buckets[lowest], lowest
            while full and least == lowest:
                at = heappop(full)
                if pair[at] != lowest:
                    continue  # stale
                gone = after[at]
                far = after[at] = after[gone]
                pair[gone] = pair[at] = -1
                own[at], own[gone] = lowest, -2
                left = before[at]
                if before[far] >= 0:
                    before[far] = at
                    rank = get(text[at : after[far]])
                    if rank is not None:
                        pair[at] = rank
                        bucket = buckets[rank]
                        if not bucket:
                            word = rank >> 6
                            low[word] |= bit[rank & 63]
                            mid[word >> 6] |= bit[word & 63]
                            top |= bit[word >> 6]
                        heappush(bucket, at)
                        if rank < least:
                            least = rank
                if left >= 0:
                    rank = get(text[left:far])
                    if rank is None:
                        pair[left] = -1
                    elif rank != pair[left]:
                        pair[left] = rank
                        bucket = buckets[rank]
                        if not bucket:
                            word = rank >> 6
                            low[word] |= bit[rank & 63]
                            mid[word >> 6] |= bit[word & 63]
                            top |= bit[word >> 6]
                        heappush(bucket, left)
                        if rank < least:
                            least = rank
            if not full:
                word = lowest >> 6
                low[word] ^= bit[lowest & 63]
                if not low[word]:
                    mid[group] ^= bit[word & 63]
                    if not mid[group]:
                        top ^= bit[group]
        own = np.array(own, np.int32)
        stays = own != -2
        ids = own[stays]
        if (ids < 0).any():
            raise ValueError("the vocabulary has no rank for a byte")
        packed = ids.tobytes()
        return [packed[start:end] for start, end in pairwise([0, *(4 * np.cumsum(stays)[ends - 1]).tolist()])]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and end among them."""
        pieces = [self.find(text) if text else [] for text in texts]
        memory, older = self.memory, self.older
        unknown, raws = [], []
        missing = set().union(*pieces).difference(memory)
        for piece in missing:
            known = older.get(piece)
            if known is None:
                raw = piece.encode("utf-8")
                whole = self.ranks.get(raw)
                if whole is None:
                    unknown.append(piece)
                    raws.append(raw)
                    continue
                known = whole.to_bytes(4, sys.byteorder)
            memory[piece] = known
        for start, end in groups(list(map(len, raws)), SHARED):
            memory.update(zip(unknown[start:end], self.merge(raws[start:end]), strict=True))
        packed = [b"".join(map(memory.__getitem__, own)) for own in pieces]
        for piece in missing:
            if len(piece) > MEMORY_LENGTH:
                del memory[piece]
        if len(memory) >= MEMORY:  # what is used before the next turn stays for another
            self.older, self.memory = memory, {}
        return np.frombuffer(b"".join(packed), np.int32), np.cumsum([0, *(len(own) // 4 for own in packed)])


def _spelled(words: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    """For each text the words of its ids, joined: words holds one for each id."""
    if not len(ids):
        return [memoryview(b"")] * (len(bounds) - 1)
    _, ends, joined = words.take(pa.array(ids)).buffers()
    ends, joined = np.frombuffer(ends, np.int64, len(ids) + 1), memoryview(joined)
    return [joined[start:end] for start, end in pairwise(ends[bounds].tolist())]


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(broadcast, pattern: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    key = (broadcast.value["key"], pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(broadcast.value["ranks"], pattern)
    return _encoders[key]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded (binary). path: the vocabulary file, read once on the driver (its size is fixed)."""

    def shape(coder: Encoder, ids: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
        decoded = [bytes(part) for part in _spelled(coder.tokens, ids, bounds)]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)), pa.array(decoded, pa.binary())

    return _run(df, path, pattern, id_col, text_col, "doc_id {id}, n_tokens long, ids array<int>, decoded binary", shape)


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def shape(coder: Encoder, ids: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
        decimal = [part[:-1] for part in _spelled(coder.decimals, ids, bounds)]  # without the last blank
        return tuple(pa.array([hashlib.sha256(part).hexdigest() for part in parts], pa.string()) for parts in (decimal, _spelled(coder.tokens, ids, bounds)))

    return _run(df, path, pattern, id_col, text_col, "doc_id {id}, n_tokens long, ids_sha256 string, decoded_sha256 string", shape)


def _run(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: str, shape) -> DataFrame:
    ranks = read_ranks(path)
    shared = df.sparkSession.sparkContext.broadcast({"key": hash(frozenset(ranks.items())), "ranks": ranks})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared, pattern)
        for batch in batches:
            for start, end in groups(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), GROUP):
                part = batch.slice(start, end - start)
                ids, bounds = coder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds), pa.int64()), *shape(coder, ids, bounds)], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = schema.format(id=kind)
    names = [part.split()[0] for part in schema.split(", ")]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
