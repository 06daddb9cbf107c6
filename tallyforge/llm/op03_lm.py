"""Operator 3: language-model scoring by cross-entropy difference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import textbatch as tb
from tallyforge.llm.session import arrow_batches, written

CHUNK = 4 << 20
#: Added to every count, in both models.
ALPHA = 0.1
#: Bigram occurrences, about, that one task counts at a time.
BUCKET = 1_500_000
#: Contexts that make up more than one in HOT of all; there can't be more than HOT of them.
HOT = 10_000
#: More target ids than this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 1_000_000
START = np.uint64(0x5DEECE66D)


def word_hashes(column: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of letters or digits, lower case) of the texts, and the text it is in."""
    data, off = tb.flat(pc.utf8_lower(column))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(data):
        return none
    pos, cp = tb.characters(data)
    word = (classes[cp] == tb.LETTER) | (classes[cp] == tb.DIGIT)
    cut = np.ones(len(pos), bool)
    cut[1:] = word[1:] != word[:-1]
    cut[np.searchsorted(pos, off[:-1][off[:-1] < off[1:]])] = True
    at = np.flatnonzero(cut)
    begins, kept = pos[at], word[at]
    if not kept.any():
        return none
    words, word_off, code = tb.unique_pieces(data, begins, len(data))
    return tb.piece_hashes(words, word_off)[code[kept]], (np.searchsorted(off, begins[kept], "right") - 1).astype(np.int64)


def contexts(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The word before each word, or START."""
    prev = np.empty_like(words)
    prev[:1] = START
    prev[1:] = np.where(owner[1:] == owner[:-1], words[:-1], START)
    return prev


def counted(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key) in order, and how often each occurs."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return owner[at], key[at], np.diff(np.append(at, len(key)))


def binary(x: np.ndarray, kind: type) -> bytes:
    return x.astype(kind).tobytes()


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cross-entropy difference of every document: (doc_id, n_words, target_loss, background_loss, score).

    Two bigram models of one order, vocabulary (all words of the documents, V) and smoothing: the background
    of all documents, the target of those labelled good (quality 1) and not toxic. A word w after p costs
    -ln((c(p, w) + ALPHA) / (c(p) + ALPHA * V)) nats by either model, in both without the document's own
    counts. score is the mean background loss less the mean target loss: higher is more like the target.

    Each chunk of texts sends its (document, bigram) counts, packed by hash bucket; a bucket counts its bigrams over
    all documents and returns one sum per document in it. Contexts travel the same way but for hot ones, at
    most HOT, whose counts are broadcast. The number of buckets follows the number of words.

    Rows of one id are one document; each row's losses leave out its own counts, then they are added. Rows
    without id are left out. A null or
    empty text, or one without words, has n_words 0 and null losses. Without labels the target model is
    uniform. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(tb.class_table())
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("doc_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("x")).where("q = 1 and coalesce(x, 0) = 0").select("doc_id", F.lit(1).alias("target"))
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null").join(marks, "doc_id", "left")
    kind = given.schema["doc_id"].dataType.simpleString()

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
        for table in tb.sized(batches, "text", CHUNK):
            words, owner = word_hashes(table.column("text").combine_chunks(), shared.value)
            yield table, words, owner, pc.fill_null(table.column("target"), 0).to_numpy()

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, owner, target in tables(batches):
            if not len(words):
                continue
            prev = contexts(words, owner)
            keys, code = np.unique(np.concatenate([prev, words]), return_inverse=True)
            code, n = code[: len(prev)], len(keys)
            c, t = np.bincount(code, minlength=n), np.bincount(code, target[owner].astype(float), n)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c), pa.array(t.astype(np.int64))], ["key", "c", "t"])

    uni = written(given.select("text", "target").mapInArrow(unigrams, "key bigint, c bigint, t bigint").groupBy("key").agg(F.sum("c").alias("c"), F.sum("t").alias("t")), "lm-contexts")
    sizes = uni.agg(F.count(F.when(F.col("key") != int(START), 1)).alias("v"), F.sum("c").alias("n")).first()
    v, n = sizes["v"], sizes["n"] or 0
    hot = uni.where((F.col("c") * HOT > n) | (F.col("key") == int(START))).toPandas().sort_values("key")
    hot_keys = hot["key"].to_numpy(np.int64)
    known = spark.sparkContext.broadcast((hot_keys, hot["c"].to_numpy(np.int64), hot["t"].to_numpy(np.int64)))
    buckets = max(1, n // BUCKET)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c, t = known.value
        for table, words, owner, target in tables(batches):
            ids = table.column("doc_id").combine_chunks()
            m = len(ids)
            n_words, base = np.bincount(owner, minlength=m), np.zeros((2, m))
            prev = contexts(words, owner)
            with np.errstate(over="ignore"):
                pairs = tb.mixed(prev * tb.MIX + words)
            o2, k2, n2 = counted(owner, pairs)
            o1, k1, n1 = counted(owner, prev)
            place = np.minimum(np.searchsorted(keys, k1.view(np.int64)), max(len(keys) - 1, 0))
            is_hot = keys[place] == k1.view(np.int64) if len(keys) else np.zeros(len(k1), bool)
            own, doc, p = n1[is_hot], o1[is_hot], place[is_hot]
            base[0] = np.bincount(doc, own * np.log(t[p] - own * target[doc] + ALPHA * v), m) if len(doc) else 0
            base[1] = np.bincount(doc, own * np.log(c[p] - own + ALPHA * v), m) if len(doc) else 0
            o1, k1, n1 = o1[~is_hot], k1[~is_hot], n1[~is_hot]
            rows: list[dict] = [{} for _ in range(buckets)]
            for what, o, k, times in (("2", o2, k2, n2), ("1", o1, k1, n1)):
                b = (k % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(b, kind="stable")
                ends = np.searchsorted(b[by], np.arange(buckets + 1))
                for i in range(buckets):
                    part = by[ends[i] : ends[i + 1]]
                    rows[i] |= {"per" + what: binary(np.bincount(o[part], minlength=m), np.int32), "keys" + what: binary(k[part], np.uint64), "times" + what: binary(times[part], np.int32)}
            whole = pa.array(np.arange(0, m * (buckets + 1), m), pa.int32())
            repeated = pa.concat_arrays([ids] * buckets)
            arrays = [pa.array(range(buckets), pa.int32()), pa.ListArray.from_arrays(whole, repeated), pa.array([binary(target, np.int8)] * buckets, pa.binary())]
            names = ["per2", "keys2", "times2", "per1", "keys1", "times1"]
            arrays += [pa.array([r[x] for r in rows], pa.binary()) for x in names]
            arrays.append(pa.array([binary(np.concatenate([n_words.astype(float), base[0], base[1]]), float)] + [None] * (buckets - 1), pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "ids", "target", *names, "base"])

    def losses(table: pa.Table) -> pa.Table:
        ids = pa.concat_arrays([x.flatten() for x in table.column("ids").chunks])
        read = lambda name, dtype: [np.frombuffer(x.as_py(), dtype) for x in table.column(name)]
        target = np.concatenate(read("target", np.int8)).astype(np.int64)
        m = len(ids)
        total = np.zeros((2, m))
        for what, sign in (("2", 1.0), ("1", -1.0)):
            doc = np.repeat(np.arange(m), np.concatenate(read("per" + what, np.int32)))
            keys, times = np.concatenate(read("keys" + what, np.uint64)), np.concatenate(read("times" + what, np.int32)).astype(np.int64)
            if not len(keys):
                continue
            distinct, code = np.unique(keys, return_inverse=True)
            mine = times * target[doc]
            c = np.bincount(code, times.astype(float), len(distinct))[code] - times
            t = np.bincount(code, mine.astype(float), len(distinct))[code] - mine
            more = ALPHA if what == "2" else ALPHA * v
            total[0] += sign * np.bincount(doc, times * np.log(t + more), m)
            total[1] += sign * np.bincount(doc, times * np.log(c + more), m)
        n_words, at = np.zeros(m), 0
        for x, size in zip(table.column("base"), (len(x) for x in table.column("ids"))):
            if x.is_valid:
                part = np.frombuffer(x.as_py(), float).reshape(3, size)
                n_words[at : at + size] = part[0]
                total[:, at : at + size] -= part[1:]
            at += size
        some = (total[0] != 0) | (total[1] != 0) | np.repeat([x.is_valid for x in table.column("base")], [len(x) for x in table.column("ids")])
        out = pa.table({"doc_id": ids, "n": n_words.astype(np.int64), "t": total[0], "b": total[1]})
        return out.filter(pa.array(some))

    packed = given.mapInArrow(sent, f"bucket int, ids array<{kind}>, target binary, per2 binary, keys2 binary, times2 binary, per1 binary, keys1 binary, times1 binary, base binary")
    sums = packed.groupBy("bucket").applyInArrow(losses, f"doc_id {kind}, n bigint, t double, b double").groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    mean = lambda x: F.when(F.col("n") > 0, F.round(x / F.col("n"), 6))
    return sums.select("doc_id", F.col("n").alias("n_words"), mean(-F.col("t")).alias("target_loss"), mean(-F.col("b")).alias("background_loss"), mean(F.col("t") - F.col("b")).alias("score"))


ORACLE = f"""with marks as (select doc_id from labels where doc_id is not null group by 1 having max(quality) = 1 and coalesce(max(toxic), 0) = 0),
texts as materialized (select row_number() over () r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') ws, (doc_id in (from marks))::int target from documents where doc_id is not null),
toks as materialized (select r, target, unnest(ws) w, unnest(list_prepend('', ws[:-2])) p from texts),
vocab as (select count(distinct w) v from toks),
own2 as materialized (select r, target, p, w, count(*) n from toks group by all),
own1 as materialized (select r, target, p, count(*) n from toks group by all),
c2 as (select p, w, sum(n) c, sum(n * target) t from own2 group by all), c1 as (select p, sum(n) c, sum(n * target) t from own1 group by all),
s2 as (select r, sum(n) n, sum(n * ln(t - n * target + {ALPHA})) t, sum(n * ln(c - n + {ALPHA})) b from own2 join c2 using (p, w) group by 1),
s1 as (select r, sum(n * ln(t - n * target + {ALPHA} * v)) t, sum(n * ln(c - n + {ALPHA} * v)) b from own1 join c1 using (p), vocab group by 1),
sums as (select doc_id, coalesce(sum(s2.n), 0) n, sum(s1.t - s2.t) t, sum(s1.b - s2.b) b from texts left join s2 using (r) left join s1 using (r) group by 1)
select doc_id, n::bigint n_words, round(t / n, 6) target_loss, round(b / n, 6) background_loss, round((b - t) / n, 6) score from sums"""
