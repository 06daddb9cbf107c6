"""Operator 5: mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.session import written

#: Tokens (words between blanks) of a block.
BLOCK = 8192
#: Target weights are token shares to this power, in parts of a million.
POWER = 0.7
#: The golden ratio's fraction.
PHI = 0.6180339887498949
#: Documents of one source that a window sorts at a time, about.
SHARD = 20_000
SEED = "mix-1"
#: Points that the schedule may fall short of a source's share; the golden ratio's discrepancy is far less up to 10^15 points.
SPARE = 16


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Slots of a training mixture: (slot, source, block, epoch, doc_id, first_token, last_token).

    Every source's documents are shuffled (by hash) and laid end to end; each BLOCK tokens are a block. Slot i
    is the point frac((i + 1) * golden ratio) on the line of cumulative target weights: the stretch it meets
    is its source, and its rank among the source's slots is the block, counted round and round (epoch). There
    are as many slots as it takes for every block of every weighted source to be used. One row per slot and
    stretch of a document in the slot's block; first_token and last_token count from 0 within the document.

    weights: target weight by source; those that lack one are left out. None: token shares to the power
    POWER. Hot sources are laid out in hash shards, whose offsets are summed first.

    A null source is the source ''. Documents without tokens, null or empty, fill no block and have no row. Null
    ids and repeated rows are laid out as rows. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.size(F.filter(F.split(t, "[ \\t\\n\\r]+"), lambda w: w != "")).cast("bigint")
    order = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(SEED)))
    sized = written(docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(id_col).alias("doc_id"), order.alias("h"), n.alias("n")).where("n > 0"), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    if weights is None:
        totals = totals.withColumn("w", F.round(1e6 * F.pow(F.col("tokens") / F.lit(1e6), POWER)).cast("bigint"))
    else:
        given = spark.createDataFrame([(k, int(round(v * 1e6))) for k, v in weights.items()] or [("", 0)], "source string, w bigint")
        totals = totals.join(F.broadcast(given), "source")
    totals = totals.where("w > 0").withColumn("blocks", F.ceil(F.col("tokens") / BLOCK)).withColumn("shards", F.ceil(F.col("docs") / SHARD).cast("bigint"))
    line = Window.orderBy("source")
    lines = totals.withColumns({"upto": F.sum("w").over(line), "whole": F.sum("w").over(Window.partitionBy())})
    lines = written(lines.withColumn("least", F.ceil((F.col("blocks") + SPARE) * F.col("whole") / F.col("w"))), "mix-lines")

    slots_n = lines.agg(F.max("least")).first()[0] or 0
    shard = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * F.col("shards") / F.lit(1 << 32)).cast("bigint")
    sharded = sized.join(F.broadcast(lines.select("source", "shards")), "source").withColumn("shard", shard).drop("shards")
    firsts = sharded.groupBy("source", "shard").agg(F.sum("n").alias("sn")).withColumn("base", F.sum("sn").over(Window.partitionBy("source").orderBy("shard")) - F.col("sn")).drop("sn")
    inside = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0)
    laid = sharded.withColumn("upto", F.sum("n").over(inside)).join(firsts, ["source", "shard"]).select("source", "doc_id", "n", (F.col("base") + F.col("upto") - F.col("n")).alias("at"))
    pieces = laid.select("source", "doc_id", "at", "n", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("n") - 1) / BLOCK))).alias("block"))
    pieces = pieces.select("source", "block", "doc_id", F.greatest(F.lit(0).cast("bigint"), F.col("block") * BLOCK - F.col("at")).alias("first_token"), F.least(F.col("n") - 1, (F.col("block") + 1) * BLOCK - F.col("at") - 1).alias("last_token"))

    i = F.col("id")
    point = (i + 1).cast("double") * PHI - F.floor((i + 1).cast("double") * PHI)
    stops = lines.select("source", "upto", "w", "whole", "blocks")
    slots = spark.range(slots_n).select(F.col("id").alias("slot"), point.alias("x")).join(F.broadcast(stops), (F.col("x") * F.col("whole") >= F.col("upto") - F.col("w")) & (F.col("x") * F.col("whole") < F.col("upto")))
    # Ranks within a source, in stretches of slots so that no source is one task: each stretch's count is summed first.
    slots = slots.withColumn("stretch", F.floor(F.col("slot") / 100_000))
    before = slots.groupBy("source", "stretch").agg(F.count("*").alias("c")).withColumn("base", F.sum("c").over(Window.partitionBy("source").orderBy("stretch")) - F.col("c")).drop("c")
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1).join(before, ["source", "stretch"]).withColumn("r", F.col("r") + F.col("base"))
    ranked = written(ranked, "mix-slots")
    last = ranked.where("r = blocks - 1").agg(F.max("slot")).first()[0]
    ranked = ranked.where(F.col("slot") <= F.lit(last)).select("slot", "source", (F.col("r") % F.col("blocks")).alias("block"), F.floor(F.col("r") / F.col("blocks")).alias("epoch"))
    return ranked.join(pieces, ["source", "block"]).select("slot", "source", F.col("block").cast("bigint").alias("block"), F.col("epoch").cast("bigint").alias("epoch"), "doc_id", "first_token", "last_token")


ORACLE = f"""with sized as materialized (select coalesce(source, '') source, doc_id, md5(concat(doc_id, '{SEED}')) h, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> ''))::bigint n from documents),
totals as (select source, sum(n) tokens, round(1e6 * pow(sum(n) / 1e6, {POWER}))::bigint w, ceil(sum(n) / {BLOCK})::bigint blocks from sized where n > 0 group by 1),
lines as materialized (select *, sum(w) over (order by source) upto, sum(w) over () whole from totals),
laid as (select source, doc_id, n, (sum(n) over (partition by source order by h, doc_id, n rows unbounded preceding) - n)::bigint begin_ from sized where n > 0),
pieces as (select source, unnest(range(begin_ // {BLOCK}, (begin_ + n - 1) // {BLOCK} + 1)) block, doc_id, begin_, n from laid),
slots as (select slot, (slot + 1)::double * {PHI} - floor((slot + 1)::double * {PHI}) x from range((select max(ceil((blocks + {SPARE}) * whole / w))::bigint from lines)) r(slot)),
ranked as (select slot, source, row_number() over (partition by source order by slot) - 1 r, blocks from slots join lines on x * whole >= upto - w and x * whole < upto),
last_ as (select max(slot) last from ranked where r = blocks - 1)
select slot, ranked.source, (r % blocks)::bigint block, (r // blocks)::bigint epoch, doc_id, greatest(0, pieces.block * {BLOCK} - begin_)::bigint first_token, least(n - 1, (pieces.block + 1) * {BLOCK} - begin_ - 1)::bigint last_token
from ranked join pieces on ranked.source = pieces.source and r % blocks = pieces.block and slot <= (select last from last_)"""
