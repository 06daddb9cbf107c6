"""Operator 1: token counts by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import bpe
from tallyforge.llm import textbatch as tb
from tallyforge.llm.session import arrow_batches

#: Bytes of text that are held as ragged arrays at a time.
CHUNK = 8 << 20


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte-level BPE tokens of every text: (doc_id, n_bytes, n_pretokens, n_tokens), one row per input row.

    Row-wise, without a shuffle. Each chunk of texts is cut into pre-tokens, whose distinct byte strings
    are merged together as ragged arrays; the merged lengths are then summed per text. Counts equal those
    of encoding each text by itself.

    A null text has null counts, an empty one 0 each. A null id, repeated rows and equal ids stay as they
    are: one output row per input row. An empty table gives none. Other columns are ignored, whatever
    their names. Texts are never cut, however long.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast((tb.class_table(), bpe.Merges(vocabulary or bpe.default_vocabulary()).state()))
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, merges = shared.value[0], bpe.Merges(state=shared.value[1])
        for table in tb.sized(batches, "text", CHUNK):
            column = table.column("text").combine_chunks()
            data, off = tb.flat(column)
            begins, n_pre = tb.pretokens(data, off, classes)
            n_tok = np.zeros(len(n_pre), np.int64)
            if len(begins):
                words, word_off, code = tb.unique_pieces(data, begins, len(data))
                counts, _ = merges.encode(words, word_off)
                total, ends = np.concatenate([[0], np.cumsum(counts[code])]), np.cumsum(n_pre)
                n_tok = total[ends] - total[ends - n_pre]
            null = column.is_null().to_numpy(zero_copy_only=False)
            numbers = [pa.array(x, pa.int64(), mask=null) for x in (np.diff(off), n_pre, n_tok)]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), *numbers], ["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_pretokens bigint, n_tokens bigint")
