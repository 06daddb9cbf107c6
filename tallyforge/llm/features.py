"""Text measures shared by the quality operators, as Spark columns and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[ \\t\\n\\r]+"
MARKS = "[#*$%&|<>{}=_~^\\\\]"


def measures(text: str = "text") -> list[Column]:
    """n_chars, n_words, n_distinct, n_marks, n_upper, n_bang, n_lines, n_same_lines of a text column; a null text counts as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(F.lower(t), BLANK), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    less = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("bigint")
    return [
        F.length(t).cast("bigint").alias("n_chars"),
        F.size(words).cast("bigint").alias("n_words"),
        F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
        less(MARKS + "+").alias("n_marks"),
        less("\\p{Lu}+").alias("n_upper"),
        less("!+").alias("n_bang"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_same_lines"),
    ]


_T = "coalesce(text, '')"
_WORDS = f"list_filter(string_split_regex(lower({_T}), '[ \\t\\n\\r]+'), lambda w: w <> '')"
_LINES = f"list_filter(string_split({_T}, chr(10)), lambda x: x <> '')"
#: The same in DuckDB.
MEASURES_SQL = f"""length({_T})::bigint n_chars, len({_WORDS})::bigint n_words, len(list_distinct({_WORDS}))::bigint n_distinct,
 length({_T}) - length(regexp_replace({_T}, '{MARKS}+', '', 'g')) n_marks, length({_T}) - length(regexp_replace({_T}, '\\p{{Lu}}+', '', 'g')) n_upper,
 length({_T}) - length(regexp_replace({_T}, '!+', '', 'g')) n_bang, len({_LINES})::bigint n_lines, (len({_LINES}) - len(list_distinct({_LINES})))::bigint n_same_lines"""
