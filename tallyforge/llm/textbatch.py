"""Vectorised text primitives over Arrow string columns: one flat byte buffer, offsets, no Python strings."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 4


def class_table() -> np.ndarray:
    """Class of each code point: \\p{L}, \\p{N}, \\s or anything else."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": DIGIT}
    for cp in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(cp))[0])
        if kind:
            table[cp] = kind
    table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def sized(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The rows of batches in order, regrouped into tables of about limit text bytes (one longer text stands alone)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, start, base = np.cumsum(lengths), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit - size, "right")))
            if held and ends[stop - 1] - base > limit - size:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - base)
            base, start = int(ends[stop - 1]), stop
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of each character of UTF-8 bytes."""
    pos = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[pos].astype(np.int32)
    wide = np.flatnonzero(cp >= 0x80)
    if len(wide):
        p, lead, padded = pos[wide], cp[wide], np.concatenate([data, np.zeros(3, np.uint8)])
        b1, b2, b3 = (padded[p + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        two, three = lead < 0xE0, lead < 0xF0
        cp[wide] = np.where(two, (lead & 0x1F) << 6 | b1, np.where(three, (lead & 0x0F) << 12 | b1 << 6 | b2, (lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
    return pos, cp


CONTRACTIONS = {ord("s"): {0}, ord("t"): {0}, ord("m"): {0}, ord("d"): {0}, ord("r"): {ord("e")}, ord("v"): {ord("e")}, ord("l"): {ord("l")}}


def pretokens(data: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens that the byte-level pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    cuts, and how many each text has. Pre-tokens tile the texts."""
    n_text = len(off) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n_text, np.int64)
    pos, cp = characters(data)
    cls = classes[cp]
    n = len(pos)
    first = np.zeros(n + 1, bool)  # the first character of a text; the end counts as one
    first[np.searchsorted(pos, off[:-1][off[:-1] < off[1:]])] = True
    first[n] = True
    edge = np.empty(n, bool)  # a run of one class begins
    edge[0] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:])
    edge |= first[:n]
    start = edge.copy()
    # White space before more text gives its last character up: a blank joins what follows, anything else stands alone.
    body = np.flatnonzero(edge & (cls != SPACE))
    body = body[(body > 0) & ~first[body]]
    body = body[cls[body - 1] == SPACE]
    start[body - 1] = True
    start[body[cp[body - 1] == 32]] = False
    # A lone apostrophe that begins a match takes a contraction's letters.
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        quote = quote[(quote + 1 < n)]
        quote = quote[~first[quote + 1] & (cls[np.minimum(quote + 1, n - 1)] == LETTER)]
        for q in quote.tolist():
            tails = CONTRACTIONS.get(int(cp[q + 1]))
            if tails is None:
                continue
            if 0 in tails:
                stop = q + 2
            elif q + 2 < n and not first[q + 2] and int(cp[q + 2]) in tails:
                stop = q + 3
            else:
                continue
            start[q + 1] = False
            if stop < n and not first[stop] and cls[stop] == LETTER:
                start[stop] = True
    begins = pos[start]
    return begins, np.diff(np.searchsorted(begins, off))


def unique_pieces(data: np.ndarray, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces of a tiling, as bytes and offsets, and the number of each piece's distinct one."""
    offsets = np.append(begins, end).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    words = coded.dictionary
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0], coded.indices.to_numpy()


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def piece_hashes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each piece off[i]:off[i + 1] (none empty)."""
    if len(off) < 2:
        return np.zeros(0, np.uint64)
    lengths = np.diff(off)
    power = np.cumprod(np.full(int(lengths.max()), MIX, np.uint64)) if len(lengths) else np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(off[:-1], lengths)
    with np.errstate(over="ignore"):
        terms = (data.astype(np.uint64) + np.uint64(1)) * power[place]
        return mixed(np.add.reduceat(terms, off[:-1]) + lengths.astype(np.uint64))
