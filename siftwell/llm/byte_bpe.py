"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a doubly linked list. Every mergeable pair is filed in a bucket of its merge rank,
and a bitmap with a summary level above it marks the ranks whose bucket holds anything. Find-first-set picks
the lowest rank; its bucket's positions are merged from left to right and entries whose pair has changed
meanwhile are skipped. A merge costs a few word operations whatever the pre-token's length, and the logarithm of the
bucket's size to keep its positions in order, so very long pre-tokens take nearly time in proportion to their length.

Short pre-tokens repeat, so their ids are kept in a bounded cache. Defined results: a null text counts as
empty and has no ids; special-token strings are ordinary text; any byte string can be decoded; repeated rows and
repeated ids are encoded row by row; an empty table gives an empty result; a text may be of any length and is encoded whole, pre-token
by pre-token, in memory in proportion to the text; the query reads the id and the text only, whatever other columns are called.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush
from itertools import chain

import regex


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: always the lowest rank first, within a rank the leftmost pair first.

    The queue: ``buckets`` has the positions of each rank; level 0 of the bitmap, ``low``, has a word of 64 bits for every 64
    ranks, and level 1, ``high``, one bit for every word that is not zero. Find-first-set on both (the lowest set bit of an
    integer) gives the next rank. It is written out in place, since a call for every pair would cost more than the work.
    """
    if piece in ranks:
        return [ranks[piece]]
    n, get = len(piece), ranks.get
    end = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n))  # start of the part to the left
    pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the part here with the next one, as it is now
    pair.append(-1)
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    high = 0
    for i, rank in enumerate(pair):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                word = rank >> 6
                low[word] = low.get(word, 0) | 1 << (rank & 63)
                high |= 1 << word
    while high:
        word = (high & -high).bit_length() - 1
        bits = low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bits &= bits - 1
        if bits:
            low[word] = bits
        else:
            del low[word]
            high &= high - 1
        positions = buckets.pop(rank)
        if len(positions) > 1:
            heapify(positions)
        while positions:
            i = heappop(positions)
            if pair[i] != rank:
                continue  # stale
            j = end[i]
            k = end[i] = end[j]
            pair[j] = -1
            h = before[i]
            if k < n:
                before[k] = i
                fresh = pair[i] = get(piece[i : end[k]], -1)
                if fresh == rank:
                    heappush(positions, i)
                elif fresh in buckets:
                    buckets[fresh].append(i)
                elif fresh >= 0:
                    buckets[fresh] = [i]
                    word = fresh >> 6
                    low[word] = low.get(word, 0) | 1 << (fresh & 63)
                    high |= 1 << word
            else:
                pair[i] = -1
            if h >= 0:
                fresh = pair[h] = get(piece[h:k], -1)
                if fresh == rank:
                    heappush(positions, h)
                elif fresh in buckets:
                    buckets[fresh].append(h)
                elif fresh >= 0:
                    buckets[fresh] = [h]
                    word = fresh >> 6
                    low[word] = low.get(word, 0) | 1 << (fresh & 63)
                    high |= 1 << word
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def load_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Lines of base64 bytes and a rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Remembered(dict):
    """Ids of pre-tokens, in two generations of ``size`` entries, each of up to ``most`` bytes: when the younger is full the
    older goes, so what keeps occurring stays."""

    def __init__(self, ranks: dict[bytes, int], size: int, most: int):
        super().__init__()
        self.ranks, self.size, self.most, self.older = ranks, size, most, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "replace")
            ids = tuple(merge(raw, self.ranks))
            if len(raw) > self.most:
                return ids
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class ByteBpe:
    """One vocabulary. cache_size and cache_bytes bound what is remembered of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_size: int = 700_000, cache_bytes: int = 48):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.split: Callable[[str], list[str]] = splitter(pattern)
        self.cache = _Remembered(ranks, cache_size, cache_bytes)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.split(text or ""))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of the pattern; pattern must have no group."""
    return regex.compile(pattern).findall
