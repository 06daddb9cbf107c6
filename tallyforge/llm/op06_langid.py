"""Operator 6: language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import textbatch as tb
from tallyforge.llm.session import arrow_batches

CHUNK = 1 << 20
#: Characters of an n-gram; cells of the filter, of one bit for each language; hash functions.
N, CELLS, HASHES = 4, 1 << 20, 3
#: The filters are fitted on about SAMPLE texts of each language, chosen by the hash of id and text, equal ones once; an n-gram counts from LEAST occurrences.
SAMPLE, LEAST = 500, 3
#: A text is undetermined if the best language has less than this share of its n-grams.
RATE = 0.3


def grams(column: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of N characters in lower case whose inner ones are letters, and its text; any
    character but a letter counts as a blank."""
    data, off = tb.flat(pc.utf8_lower(column))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pos, cp = tb.characters(data)
    letter = classes[cp] == tb.LETTER
    cp = np.where(letter, cp, 32).astype(np.uint64)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(pos, off)))
    n = len(cp) - N + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = owner[:n] == owner[N - 1 :]
    for k in range(1, N - 1):
        ok &= letter[k : n + k]
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), np.uint64)
    for k in range(N):  # all bits of every code point count
        h = tb.mixed(h * tb.MIX + cp[at + k])
    return h, owner[at]


def cells(h: np.ndarray) -> list[np.ndarray]:
    step = h >> np.uint64(32) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((h + np.uint64(i) * step) & np.uint64(CELLS - 1)).astype(np.int64) for i in range(HASHES)]


class Filters:
    """Cells whose bit l % 64 of slice l // 64 belongs to language l: an AND over an n-gram's cells has all its languages."""

    def __init__(self, languages: list[str], found: list[np.ndarray], table: np.ndarray | None = None, false: np.ndarray | None = None):
        self.languages, self.table, self.false = languages, table, false
        if table is not None:
            return
        self.table = np.zeros((-(-len(languages) // 64), CELLS), np.uint64)
        for i, h in enumerate(found):
            for at in cells(h):
                self.table[i // 64, at] |= np.uint64(1 << i % 64)
        fill = np.array([((self.table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false = fill**HASHES  # chance that an n-gram of no language seems one of l

    def rates(self, h: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and by language the share of them it has, corrected for false positives."""
        first, *rest = cells(h)
        n = np.bincount(owner, minlength=n_texts)
        ends = np.searchsorted(owner, np.arange(n_texts + 1))
        out = np.zeros((n_texts, len(self.languages)))
        for i, false in enumerate(self.false):
            if i % 64 == 0:  # one slice at a time
                mask = self.table[i // 64, first]
                for at in rest:
                    mask &= self.table[i // 64, at]
            hits = np.diff(np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1))]).astype(np.int64)[ends])
            out[:, i] = np.clip((hits - n * false) / np.maximum(n * (1 - false), 1e-9), 0, 1)
        return n, out


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters of about sample labelled texts of each language (the bound of what is collected here). Rows without id
    and repeated ones are sampled by their text; equal rows count once."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(tb.class_table())
    given = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filters([], [])
    chance = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))))
    part = given.where((F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(1 << 30)) < chance[F.col("lang")]).dropDuplicates(["lang", "h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tb.sized(batches, "text", CHUNK):
            h, owner = grams(table.column("text").combine_chunks(), shared.value)
            coded = table.column("lang").combine_chunks().dictionary_encode()
            lang = coded.indices.to_numpy()[owner]
            for i, name in enumerate(coded.dictionary.to_pylist()):
                keys, n = np.unique(h[lang == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    kept = part.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("lang", "gram").toPandas()
    names = sorted(sizes)
    by = {k: g["gram"].to_numpy(np.int64).view(np.uint64) for k, g in kept.groupby("lang")}
    return Filters(names, [by.get(k, np.zeros(0, np.uint64)) for k in names])


def identify(docs: DataFrame, filters: Filters | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of every text: (doc_id, n_grams, language, rate, runner_up, keep), one row per input row.

    Every n-gram of the whole text is looked up once in the bit-sliced filters, which gives a mask of all
    languages that have it; each language's bits are counted over the text and corrected for the false
    positives that its fill makes likely. The largest share decides (equal ones: the language first by name);
    runner_up is the next share. keep: a language was found. Row-wise, without a shuffle; the filters have
    CELLS cells of 8 bytes for every 64 languages.

    Texts with fewer than one n-gram (null, empty, no letters) and those with a best share below RATE have
    language 'und' and keep false; a null text has null n_grams and shares. Null ids and repeated rows stay as
    they are. A null language isn't fitted; without any, all are 'und'. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    filters = filters or fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = spark.sparkContext.broadcast((tb.class_table(), filters.languages, filters.table, filters.false))
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, languages, cells_of, false = shared.value
        held = Filters(languages, [], cells_of, false)
        names = np.array([*held.languages, "und"], object)
        for table in tb.sized(batches, "text", CHUNK):
            column = table.column("text").combine_chunks()
            h, owner = grams(column, classes)
            n, rates = held.rates(h, owner, len(column))
            rates = np.round(np.hstack([rates, np.zeros((len(n), 2 - min(2, rates.shape[1])))]), 6)
            best = rates.argmax(1)
            high = np.sort(rates, axis=1)
            found = (n > 0) & (high[:, -1] >= RATE)
            language = names[np.where(found, np.minimum(best, len(names) - 1), -1)]
            null = column.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(n, pa.int64(), mask=null), pa.array(language, pa.string()), pa.array(high[:, -1], mask=null), pa.array(high[:, -2], mask=null), pa.array(found)], ["doc_id", "n_grams", "language", "rate", "runner_up", "keep"])

    return given.mapInArrow(decide, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_grams bigint, language string, rate double, runner_up double, keep boolean")
