"""Operator 10: byte-level BPE encoding and decoding with Spark higher-order functions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import bpe
from tallyforge.llm import textbatch as tb
from tallyforge.llm.session import arrow_batches, written

#: Bytes of text whose distinct words are gathered for the dictionary, and of text that is encoded together.
BLOCK, ENCODED = 4 << 20, 2 << 20
#: Bytes of a block that are cut into words at a time.
PART = 1 << 19
#: Words of more than WINDOW bytes are folded in windows of so many.
WINDOW = 128
#: At most so many words, those of the most blocks, are encoded once for all blocks; a block encodes its other words itself.
DICTIONARY = 2_000_000
#: Words that one task folds, about.
SHARE = 20_000
#: Bits of an id beside a position.
ID_BITS = 20
#: The arrays of the rank map that folding takes.
FOLD = ("entries", "shift", "early")
#: What stands where no pair has its entry.
NO_ENTRY = 1 << 61
#: The rank map's homes and buckets, in proportion to its pairs.
HOMES, BUCKETS = 1.7, 0.25


@lru_cache(maxsize=4)
def tables(vocabulary: str) -> tuple[pa.Table, int, int]:
    """The rank map as one row of arrays, with the numbers of homes and buckets.

    A pair of ids (a, b) that makes a token has the key a << ID_BITS | b and its entry key << ID_BITS | rank at the
    place key % homes + shift[key % buckets]. The shifts keep all entries apart, so that a single look-up tells the rank, or
    that there is none. pieces has the tokens' bytes in hexadecimal digits.
    """
    merges = bpe.Merges(vocabulary)
    if merges.size > 1 << ID_BITS:
        raise ValueError(f"the vocabulary has more than {1 << ID_BITS} ids")
    keys = merges.pairs[:, 0] << ID_BITS | merges.pairs[:, 1]
    homes, buckets = int(HOMES * len(keys)) | 1, int(BUCKETS * len(keys)) | 1
    while len(np.unique(keys % buckets * homes + keys % homes)) < len(keys):
        homes += 2
    order = np.argsort(keys % buckets, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(keys[order] % buckets)) + 1)
    entries, shift = np.full(2 * homes, NO_ENTRY, np.int64), np.zeros(buckets, np.int64)
    for group in sorted(groups, key=len, reverse=True):
        at = keys[group] % homes
        while (entries[at] != NO_ENTRY).any():
            at += 1
        entries[at], shift[keys[group[0]] % buckets] = keys[group] << ID_BITS | merges.pairs[group, 2], at[0] - keys[group[0]] % homes
    fields = {"entries": (entries[: homes + shift.max() + 1], pa.int64()), "shift": (shift, pa.int32()), "early": (merges.early.astype(np.int32), pa.int32()), "pieces": ([p.hex() for p in merges.pieces], pa.string())}
    return pa.table({k: pa.array([list(v)], pa.list_(kind)) for k, (v, kind) in fields.items()}), homes, buckets


def with_rank_map(df: DataFrame, vocabulary: str) -> DataFrame:
    """df, of few and large rows, with the rank map as column t: one literal row that a scalar subquery holds, so that plans
    don't have it as text."""
    return df.withColumn("t", df.sparkSession.createDataFrame(tables(vocabulary)[0]).select(F.struct("*")).scalar())


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates value once and binds it in body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def bound(body: str, *names: str) -> str:
    """SQL of body with the arrays of the rank map, column t, bound to the names t_<field>, unpacked once a row."""
    for name in names:
        body = let(f"t_{name}", f"transform(t.{name}, x -> x)", body)
    return body


def merged(ids: str, size: tuple[int, int], placed: bool = False) -> str:
    """SQL that folds the ranked merges over an array of ids, to begin with those of a word's bytes: each step merges the lowest
    pair of neighbours, in all places at once unless its merge makes room for a pair of lower rank (then in the leftmost),
    until no pair is in the rank map. placed: elements are start << ID_BITS | id, and keep the start of the left one."""
    top = 1 << ID_BITS
    homes, buckets = size
    a, b = (f"({x} & {top - 1}L)" if placed else x for x in "ab")
    keys = f"zip_with(s.ids, slice(s.ids, 2, size(s.ids)), (a, b) -> shiftleft(cast({a} as bigint), {ID_BITS}) | {b})"
    found = f"transform({keys}, x -> t_entries[cast(x % {homes} as int) + t_shift[cast(x % {buckets} as int)]] ^ shiftleft(x, {ID_BITS}))"
    new = f"(x & ~{top - 1}L) | m" if placed else "cast(m as int)"
    one = let("p", "cast(array_position(r, m) as int)", f"concat(slice(s.ids, 1, p - 1), transform(slice(s.ids, p, 1), x -> {new}), slice(s.ids, p + 2, size(s.ids)))")
    apart = "transform(r, v -> coalesce(v = m, false))"
    beside = "exists(zip_with(r, slice(r, 2, size(r)), (a, b) -> coalesce(a = m and b = m, false)), z -> z)"
    turns = "aggregate(r, cast(array() as array<boolean>), (f, v) -> array_append(f, coalesce(v = m, false) and not coalesce(try_element_at(f, -1), false)))"
    gone = f"cast(null as {'bigint' if placed else 'int'})"
    every = let("f", f"if({beside}, {turns}, {apart})", f"filter(transform(s.ids, (x, i) -> if(f[i], {new}, if(i > 0 and f[greatest(i - 1, 0)], {gone}, x))), x -> x is not null)")
    again = f"exists(slice(r, cast(array_position(r, m) as int) + 1, size(r)), v -> v = m)"
    change = f"if(t_early[cast(m as int)] = 1 or not {again}, {one}, {every})"
    step = let("r", found, let("m", "array_min(r)", f"if(m is null or m >= {top}, named_struct('ids', s.ids, 'over', true), named_struct('ids', {change}, 'over', false))"))
    return f"aggregate(array_repeat(0, size({ids}) - 1), named_struct('ids', {ids}, 'over', false), (s, _) -> if(s.over, s, {step}), s -> s.ids)"


def windowed(word: str, size: tuple[int, int]) -> str:
    """SQL of the ids of a long word, an array of its bytes' ids, in time that grows with its length.

    A row of tokens is what the merges give if and only if every two neighbours are what they give for the
    two's bytes. So two overlapping windows whose rows have a token in common (same place, same id) are joined
    there. The next window begins at a token in the middle of the last. Where windows have no token in
    common, the word is folded whole.
    """
    mask = (1 << ID_BITS) - 1
    part = lambda ids: let("v", f"transform({ids}, (x, i) -> shiftleft(cast(g + i as bigint), {ID_BITS}) | x)", merged("v", size, True))
    window = part(f"slice({word}, g + 1, {WINDOW})")
    joined = f"named_struct('done', concat(o.done, filter(o.last, e -> e < y)), 'last', filter(b, e -> e >= y), 'upto', least(size({word}), g + {WINDOW}), 'ok', true)"
    lost = "named_struct('done', o.done, 'last', o.last, 'upto', o.upto, 'ok', false)"
    step = let("g", f"cast(shiftright(o.last[cast(size(o.last) / 2 as int)], {ID_BITS}) as int)", let("b", window, let("y", "array_min(array_intersect(o.last, b))", f"if(y is null, {lost}, {joined})")))
    start = f"named_struct('done', cast(array() as array<bigint>), 'last', {let('g', '0', window)}, 'upto', least(size({word}), {WINDOW}), 'ok', true)"
    end = f"if(o.ok and o.upto >= size({word}), concat(o.done, o.last), {let('g', '0', part(word))})"
    whole = f"aggregate(array_repeat(0, cast(8 * size({word}) / {WINDOW} as int) + 8), {start}, (o, _) -> if(not o.ok or o.upto >= size({word}), o, {step}), o -> {end})"
    return f"transform({whole}, e -> cast(e & {mask}L as int))"


def fold(word: str, vocabulary: str) -> str:
    """SQL of the ids of a word, an array of its bytes' ids."""
    size = tables(vocabulary)[1:]
    return f"if(size({word}) <= {WINDOW}, {merged(word, size)}, {windowed(word, size)})"


def symbols(words: pa.Array, byte_ids: np.ndarray) -> pa.ListArray:
    """Binary words as arrays of their bytes' ids; null for null."""
    off, data = (np.frombuffer(words.buffers()[i], kind) if words.buffers()[i] is not None else np.zeros(0, kind) for i, kind in ((1, np.int32), (2, np.uint8)))
    off = off[words.offset : words.offset + len(words) + 1]
    lists = pa.ListArray.from_arrays(pa.array(off - off[0], pa.int32()), pa.array(byte_ids[data[off[0] : off[-1]]], pa.int32()))
    return pc.if_else(words.is_valid(), lists, pa.scalar(None, lists.type)) if words.null_count else lists


def joined(ids: str) -> str:
    """SQL of the text of an array of ids: their binary pieces one after the other."""
    return f"decode(unhex(array_join(transform({ids}, i -> t_pieces[i]), '')), 'UTF-8')"


def decoded(ids: Column | str, vocabulary: str | None = None) -> Column:
    """The text of an array of token ids. Null for null; the empty text for no token."""
    held = F.expr("split('" + ",".join(p.hex() for p in bpe.Merges(vocabulary or bpe.default_vocabulary()).pieces) + "', ',')")
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: held[i]), "")), "UTF-8")


def words_of(table: pa.Table, classes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts of a table, the number of each place's word, and the places of each text."""
    data, off = tb.flat(table.column("text").combine_chunks())
    parts, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    while at < len(off) - 1:
        stop = max(at + 1, int(np.searchsorted(off, off[at] + PART, "right")) - 1)
        begins, n_pre = tb.pretokens(data[off[at] : off[stop]], off[at : stop + 1] - off[at], classes)
        parts.append((begins + off[at], n_pre))
        at = stop
    begins, n_pre = map(np.concatenate, zip(*parts, strict=True))
    words, word_off, code = tb.unique_pieces(data, begins, len(data)) if len(begins) else (np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(word_off) - 1, [None, pa.py_buffer(word_off.astype(np.int32)), pa.py_buffer(words)]), code, n_pre


def places(words: pa.Array, known: pa.Array) -> pa.Array:
    """The place of each word in known, null for none; both distinct. Only words are hashed: known has many times as many."""
    at = pc.index_in(known, value_set=words)
    found = np.full(len(words), -1, np.int32)
    found[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return pa.array(found, mask=found < 0)


def dictionary(given: DataFrame, vocabulary: str, limit: int = DICTIONARY) -> tuple[pa.Array, pa.ListArray]:
    """Words of several blocks with their ids: all words of at least as many blocks as leave at most limit."""
    spark = given.sparkSession
    shared = spark.sparkContext.broadcast(tb.class_table())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tb.sized(batches, "text", BLOCK):
            yield pa.RecordBatch.from_arrays([words_of(table, shared.value)[0]], ["word"])

    often = written(given.select("text").mapInArrow(cut, "word binary").groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "bpe-words")
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 8) + 16).cast("bigint")  # below 600 of them
    sizes = {r["k"]: r["n"] for r in often.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect()}
    least, total = 1 << 62, 0
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > limit:
            break
        least, total = k, total + sizes[k]
    if not total:
        return pa.array([], pa.binary()), pa.array([], pa.list_(pa.int32()))

    byte_ids = bpe.Merges(vocabulary).byte_ids

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            whole = pa.array([0, len(words)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, x) for x in (words, symbols(words, byte_ids))], ["words", "bytes"])

    chosen = often.where(level >= F.lit(least)).select("word").repartition(-(-total // SHARE), "word").mapInArrow(packed, "words array<binary>, bytes array<array<int>>")
    each = bound(f"zip_with(words, bytes, (w, v) -> named_struct('word', w, 'ids', {fold('v', vocabulary)}))", *FOLD)
    folded = with_rank_map(chosen, vocabulary).select(F.explode(F.expr(each)).alias("x")).select("x.*")
    found = written(folded, "bpe-dictionary").toArrow()
    return found.column("word").combine_chunks().cast(pa.binary()), found.column("ids").combine_chunks().cast(pa.list_(pa.int32()))


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """Token ids of every text: (doc_id, n_tokens, tokens, round_trip), one row per input row.

    Texts are gathered in blocks of about ENCODED bytes, each a set of distinct words and texts as numbers of
    words. Higher-order functions fold the ranked merges over the byte arrays of distinct words: the
    DICTIONARY commonest words of several blocks once for all, in a table that is then broadcast, and every
    other word once in its block. Then they put the texts' ids together. Only the distinct words of blocks
    are shuffled. round_trip says whether decoding gives the text back (left out if check is False).

    A null text has null tokens, n_tokens and round_trip; an empty one no tokens. A null id, repeated rows
    and equal ids stay as they are. An empty table gives no rows. Other columns are ignored, whatever
    their names. Texts are never cut; one longer than a block is a block of its own. A vocabulary of more
    than 2^20 ids raises a ValueError.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    vocabulary = vocabulary or bpe.default_vocabulary()
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    common, ids = dictionary(given, vocabulary)
    arrays = (None,) * 4
    if len(common):
        offsets = np.frombuffer(common.buffers()[1], np.int32)[: len(common) + 1]
        arrays = offsets, np.frombuffer(common.buffers()[2], np.uint8)[: offsets[-1]], np.array(ids.offsets), np.array(ids.values)
    byte_ids = bpe.Merges(vocabulary).byte_ids
    shared = spark.sparkContext.broadcast((tb.class_table(), *arrays))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, offsets, data, id_off, id_values = shared.value
        known = None if offsets is None else pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        names = None if offsets is None else pa.ListArray.from_arrays(pa.array(id_off, pa.int32()), pa.array(id_values, pa.int32()))
        for table in tb.sized(batches, "text", ENCODED):
            column = table.column("text").combine_chunks()
            words, code, n_pre = words_of(table, classes)
            if known is None:
                found = pa.nulls(len(words), pa.list_(pa.int32()))
            else:
                found = names.take(places(words, known))
                words = pc.if_else(found.is_valid(), pa.scalar(None, pa.binary()), words)
            ends = np.concatenate([[0], np.cumsum(n_pre)])
            numbers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code, pa.int32()), mask=column.is_null())
            rows = pa.StructArray.from_arrays([table.column("doc_id").combine_chunks(), *([column] if check else []), numbers], ["doc_id", *(["text"] if check else []), "at"])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (symbols(words, byte_ids), found, rows)]
            yield pa.RecordBatch.from_arrays(lists, ["words", "known", "docs"])

    block = given.mapInArrow(blocks, f"words array<array<int>>, known array<array<int>>, docs array<struct<doc_id: {kind}, {'text: string, ' * check}at: array<int>>>")
    folded = f"zip_with(words, known, (v, k) -> if(v is null, k, {fold('v', vocabulary)}))"
    more = f", 'round_trip', {joined('w')} = d.text" if check else ""
    row = f"named_struct('doc_id', d.doc_id, 'n_tokens', if(w is null, null, size(w)), 'tokens', w{more})"
    built = let("e", folded, f"transform(docs, d -> {let('w', 'flatten(transform(d.at, i -> e[i]))', row)})")
    return with_rank_map(block, vocabulary).select(F.explode(F.expr(bound(built, *FOLD, "pieces"))).alias("row")).select("row.*")
