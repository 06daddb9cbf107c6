"""Byte-level BPE: the vocabulary as arrays, and rank-synchronous merging of ragged arrays.

A vocabulary is public and fixed, so what is shipped to executors (a few MB) doesn't grow with the data.
"""

from __future__ import annotations

import base64
import os

import numpy as np

NONE = np.int32(2**31 - 1)


def default_vocabulary() -> str:
    """Path of the rank file used by the queries; TALLYFORGE_BPE or any argument replaces it."""
    return os.environ.get("TALLYFORGE_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Merges:
    """ranks: bytes to rank. pairs: (left, right, merged) ids of every way to cut a token into two tokens.

    early: ids whose merge can make room for a lower-ranked merge; of those only the leftmost occurrence
    is merged at a time, of all others every occurrence at once, which is the same as one by one.
    """

    def __init__(self, path: str | None = None, state: dict | None = None):
        if state is not None:
            self.__dict__.update(state)
            return
        ranks = read_ranks(path)
        self.size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found, early = [], set()
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    found.append((a, b, rank))
                    early.update(x for x in (a, b) if x > rank)
        self.pairs = np.array(found, np.int64)
        self.early = np.zeros(self.size, bool)
        self.early[list(early)] = True
        self.pieces = [b""] * self.size
        for token, rank in ranks.items():
            self.pieces[rank] = token
        keys, bits = self.pairs[:, 0] << 20 | self.pairs[:, 1], 20
        while 1 << bits < 4 * len(keys):
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):  # linear probing: of those that want one slot the first takes it
            free = self.keys[slot] == -1
            _, chosen = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            chosen = chosen[free[chosen]]
            self.keys[slot[chosen]], self.values[slot[chosen]] = keys[left[chosen]], self.pairs[left[chosen], 2]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def state(self) -> dict:
        """What encode() needs, in plain arrays: executors read it without this package."""
        return {k: v for k, v in vars(self).items() if k not in ("pairs", "pieces")}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it makes no token."""
        key = a.astype(np.int64) << 20 | b
        slot = self._slot(key)
        at = self.keys[slot]
        out = np.where(at == key, self.values[slot], NONE)
        open_ = np.flatnonzero((at != key) & (at != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at = self.keys[slot[open_]]
            hit = at == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return out

    def encode(self, data: np.ndarray, off: np.ndarray, ids: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens per piece off[i]:off[i + 1] (none empty), and with ids the tokens themselves.

        Every round applies each sequence's lowest-ranked pair in all sequences at once; sequences
        with no pair left leave the arrays.
        """
        n_seq = len(off) - 1
        counts = np.zeros(n_seq, np.int64)
        sym = self.byte_ids[data]
        seq = np.repeat(np.arange(n_seq, dtype=np.int32), np.diff(off))
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = np.where(seq[1:] == seq[:-1], self.ranks_of(sym[:-1], sym[1:]), NONE)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            low = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(sym)))
            over = low == NONE
            if over.any():
                counts[seq[starts[over]]] = lengths[over]
                gone = np.repeat(over, lengths)
                if ids:
                    kept.append((seq[gone], sym[gone]))
                sym, seq, rank = sym[~gone], seq[~gone], rank[~gone]
                if not len(sym):
                    break
                low, lengths = low[~over], lengths[~over]
                starts = np.cumsum(lengths) - lengths
            hit = rank == np.repeat(low, lengths)
            at = np.flatnonzero(hit)
            new_run = np.ones(len(at), bool)
            new_run[1:] = np.diff(at) != 1
            run = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - run) % 2 == 0  # left to right, none overlapping
            alone = self.early[rank[at]]
            if alone.any():
                owner = seq[at]
                head = np.ones(len(at), bool)
                head[1:] = owner[1:] != owner[:-1]
                take &= ~alone | head
            at = at[take]
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            at = place[at]
            again = np.unique(np.concatenate([at, at[at > 0] - 1]))
            last = again == len(sym) - 1
            inner = again[~last]
            rank[again[last]] = NONE
            rank[inner] = np.where(seq[inner] == seq[inner + 1], self.ranks_of(sym[inner], sym[inner + 1]), NONE)
        if not ids:
            return counts, None
        if not kept:
            return counts, np.zeros(0, np.int32)
        where, what = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
        return counts, what[np.argsort(where, kind="stable")]
