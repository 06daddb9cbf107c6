"""Operator 9: SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm import textbatch as tb
from tallyforge.llm.session import arrow_batches, written

CHUNK = 4 << 20
#: Fingerprints of at most RADIUS different bits may be near copies; one of the SEGMENTS then has at most BALL different bits.
RADIUS, SEGMENTS, WIDTH = 11, 4, 16
BALL = RADIUS // SEGMENTS
#: Near copies also share at least ALIKE of their words, pairs and triples of words, estimated from one minimum in each of BINS.
BINS, ALIKE = 128, 0.3


def phrases(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every word, pair and triple of words; owner doesn't fall."""
    texts, found, h = [owner], [tb.mixed(hashes)], hashes
    with np.errstate(over="ignore"):
        for k in (1, 2):
            h = tb.mixed(h[:-1] * tb.MIX + hashes[k:])
            inside = owner[:-k] == owner[k:]
            texts.append(owner[:-k][inside])
            found.append(h[inside])
    return np.concatenate(texts), np.concatenate(found)


def minima(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n sketches of BINS bytes: of the phrases that fall into a bin, 1 to 255 of the smallest hash; 0 if there is none."""
    out = np.zeros(n * BINS, np.uint8)
    cell, rest = owner.astype(np.uint64) * np.uint64(BINS) + hashes % np.uint64(BINS), 35
    both = np.sort(cell << np.uint64(rest) | hashes >> np.uint64(64 - rest))
    cell = both >> np.uint64(rest)
    least = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    out[cell[least].astype(np.int64)] = tb.mixed(both[least] & np.uint64((1 << rest) - 1)) % np.uint64(255) + np.uint64(1)
    return out.reshape(n, BINS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, sketch): 64-bit SimHash of each text's words (runs of letters or digits, lower case), weighted by the
    fourth root of their number in the text, so that common words don't draw unrelated texts together, and minima of
    its phrases. A text without words has a hash of its bytes and an empty sketch; a null text nulls."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(tb.class_table())
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("raw"), F.lower(F.col(text_col).cast("string")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for table in tb.sized(batches, "text", CHUNK):
            column = table.column("text").combine_chunks()
            n = len(column)
            data, off = tb.flat(column)
            out = np.zeros(n, np.uint64)
            sketch = np.zeros((n, BINS), np.uint8)
            counted = np.zeros(n, bool)
            if len(data):
                pos, cp = tb.characters(data)
                word = (classes[cp] == tb.LETTER) | (classes[cp] == tb.DIGIT)
                head = np.zeros(len(pos) + 1, bool)
                head[np.searchsorted(pos, off[:-1][off[:-1] < off[1:]])] = True
                edge = np.ones(len(pos), bool)
                edge[1:] = word[1:] != word[:-1]
                cut = np.flatnonzero(edge | head[:-1])
                begins, is_word = pos[cut], word[cut]
                if is_word.any():
                    text_of = np.searchsorted(off, begins, "right") - 1
                    words, word_off, code = tb.unique_pieces(data, begins, len(data))
                    hashes = tb.piece_hashes(words, word_off)
                    there, at = np.unique(text_of[is_word], return_inverse=True)
                    sketch[there] = minima(*phrases(at, hashes[code[is_word]]), len(there))
                    key = text_of[is_word].astype(np.int64) << 32 | code[is_word]
                    key, times = np.unique(key, return_counts=True)
                    owner, code = key >> 32, key & 0xFFFFFFFF
                    weight = np.sqrt(np.sqrt(times)).astype(np.float32)
                    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32) * 2 - 1
                    sums = np.empty((len(starts), 64), np.float32)
                    ends = np.append(starts[1:], len(owner))
                    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                        sums[i] = weight[a:b] @ bits[code[a:b]]
                    out[owner[starts]] = np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()
                    counted[owner[starts]] = True
            rest = np.flatnonzero(~counted)
            if len(rest):
                raw = table.column("raw").combine_chunks()
                whole, whole_off = tb.flat(raw.take(pa.array(rest)))
                full = np.flatnonzero(np.diff(whole_off))
                out[rest] = tb.mixed(np.full(len(rest), 77, np.uint64))
                if len(full):
                    out[rest[full]] = tb.piece_hashes(whole, np.append(whole_off[:-1][full], whole_off[-1]))
            null = column.is_null().to_numpy(zero_copy_only=False)
            fp = pa.array(out.view(np.int64), pa.int64(), mask=null)
            cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BINS), n, [None, pa.py_buffer(sketch)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), fp, pc.if_else(pa.array(null), None, cells)], ["doc_id", "fp", "sketch"])

    return given.mapInArrow(sign, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, fp bigint, sketch binary")


def segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, k * WIDTH).bitwiseAND((1 << WIDTH) - 1)


def near_pairs(fps: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the distinct fingerprints fp that differ in at most RADIUS bits: all of them.

    Such a pair has a segment that differs in at most BALL bits. Each fingerprint is stored under its segments
    and looked up under the values of each segment's ball of radius BALL that aren't smaller: of two values,
    just the smaller one finds the other. Table matches are verified by the complete distance. A pair that
    several segments find counts in the first.
    """
    masks = [sum(1 << i for i in bits) for n in range(BALL + 1) for bits in itertools.combinations(range(WIDTH), n)]
    balls = F.expr(f"array({', '.join(str(k << WIDTH | mask) for k in range(SEGMENTS) for mask in masks)})")
    at = f"(shiftrightunsigned({{}}, (ball >> {WIDTH}) * {WIDTH}) & {(1 << WIDTH) - 1})"
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    key = lambda k: segment(F.col("fp"), k).bitwiseOR(F.lit(k << WIDTH)).cast("int")
    stored = spread.select(F.explode(F.array(*(key(k) for k in range(SEGMENTS)))).alias("key"), F.col("fp").alias("b"))
    probes = spread.select(F.explode(balls).alias("ball"), F.col("fp").alias("a"))
    probes = probes.where(f"({at.format('a')} ^ (ball & {(1 << WIDTH) - 1})) >= {at.format('a')}").select(F.expr(f"cast({at.format('a')} ^ ball as int)").alias("key"), "a")
    met = probes.join(stored.hint("shuffle_hash"), "key").where("a <> b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    whole = F.bit_count(differ) <= RADIUS
    seg = F.shiftright("key", WIDTH)
    first = F.lit(True)
    for k in range(SEGMENTS - 1):  # no earlier segment finds the pair
        first = first & ((seg <= k) | (F.bit_count(segment(differ, k)) > BALL))
    same = segment(F.col("a"), 0) == segment(F.col("b"), 0)
    for k in range(1, SEGMENTS):
        same = F.when(seg == k, segment(F.col("a"), k) == segment(F.col("b"), k)).otherwise(same)
    once = ~same | (F.col("a") < F.col("b"))  # equal segments find each other from both sides
    return met.where(whole & first & once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of fingerprints of which any sketches (fp, sketch) agree in at least ALIKE of the bins that either fills."""
    of = lambda side: sketches.select(F.col("fp").alias(side), F.col("sketch").alias(f"sketch_{side}"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
            same, filled = ((x == y) & (x > 0)).sum(1), ((x > 0) | (y > 0)).sum(1)
            yield batch.select([0, 1]).filter(pa.array((filled > 0) & (same >= ALIKE * filled)))

    met = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sketch_a", "sketch_b")
    return met.mapInArrow(verify, "a bigint, b bigint").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): each node of an edge list with the smallest node that it is connected to, by alternating
    large-star and small-star rounds until nothing changes; the number of rounds grows with the logarithm of the nodes."""
    edges = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))  # u > v
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.withColumn("m", low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", low)
        star = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = written(star.where("u <> v").distinct(), "components")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: (doc_id, fingerprint, group_id, group_size, keep), one row per distinct id.

    Documents whose fingerprints differ in at most RADIUS bits and whose words, pairs and triples of words
    have at least the share ALIKE in common are near copies; groups are connected components of that
    relation, over all documents. group_id is the smallest id of a group, which alone is kept. Equal
    fingerprints meet once as one, so that copies cost nothing in the search.

    Rows of one id are one document, with its smallest fingerprint. A null text is near nothing and kept.
    Empty texts are copies of each other; so are equal texts without words. A null id can't be named: such rows are left out.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    signed = written(fingerprints(docs, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("fp", "sketch")).alias("x")).select("doc_id", "x.*"), "simhash")
    sketches = written(signed.where("fp is not null").select("fp", "sketch").distinct(), "simhash-sketches")
    roots = components(written(alike(near_pairs(sketches.select("fp").distinct()), sketches), "simhash-pairs"))
    placed = signed.join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))
    group = Window.partitionBy("root", F.when(F.col("root").isNull(), F.col("doc_id")))
    out = placed.select("doc_id", F.col("fp").alias("fingerprint"), F.min("doc_id").over(group).alias("group_id"), F.count("*").over(group).alias("group_size"))
    return out.withColumn("keep", F.col("doc_id") == F.col("group_id"))
