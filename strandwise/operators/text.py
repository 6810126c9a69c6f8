"""Sequences and scores aligned to blocks of one text, the text in bounded chunks, and what stands at a place of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.ordering import ordered
from strandwise.runtime import cut, partitions

#: Ends each block; sorts by code point like any letter.
END = "$"
#: Letters of a chunk of the text, without its look-ahead.
CHUNK = 512
#: Letters of look-ahead: longer stretches are read in pieces of so many.
AHEAD = 64
BUCKETS = 1 << 14


def align(seqs: DataFrame, scores: DataFrame) -> DataFrame:
    """``(b BIGINT, seq_id, seq, score, offset BIGINT, len INT)``: sequences that have a score, ranked by id in code-point order.

    ``seqs(seq_id, seq)``, ``scores(seq_id, score)``. Ids without a partner, null ids and scores that are null or NaN drop out; a null sequence is
    empty; of repeated ids the greatest sequence and score stay. ``offset`` is the place of the block in the whole text, in
    which every block is closed by ``$``. Offsets are summed up in buckets of ranks and then within, never in one task.
    """
    s = seqs.where("seq_id is not null").groupBy("seq_id").agg(F.max(F.coalesce("seq", F.lit(""))).alias("seq"))
    y = scores.where("seq_id is not null and score is not null and not isnan(score)").groupBy("seq_id").agg(F.max(F.col("score").cast("double")).alias("score"))
    ranked = ordered(s.join(y, "seq_id").withColumn("len", F.length("seq")), ["seq_id"]).withColumnRenamed("pos", "b").drop("first", "tied")
    return with_offsets(ranked, "b", "len").select("b", "seq_id", "seq", "score", "offset", "len")


def with_offsets(blocks: DataFrame, b: str, length: str) -> DataFrame:
    """Adds ``offset``, the sum of length + 1 over smaller ``b`` (dense ranks): first over buckets of ranks, no more of them than ranks in one, then inside."""
    bucket = F.floor(F.col(b) / max(BUCKETS, math.isqrt(blocks.count())))
    sums = blocks.groupBy(bucket.alias("_bucket")).agg(F.sum(F.col(length) + 1).alias("_sum"))
    before = sums.select("_bucket", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(F.col(length) + 1).over(Window.partitionBy("_bucket").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("_bucket", bucket).withColumn("_inside", inside).join(before, "_bucket").withColumn("offset", F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside")


def chunks(blocks: DataFrame, size: int = CHUNK, ahead: int = AHEAD) -> DataFrame:
    """``(c BIGINT, text, pieces ARRAY<STRUCT<start, b, n, wi>>)``: letters [c * size, c * size + size + ahead) of the text and the blocks' pieces in them."""
    o, end = F.col("offset"), F.col("offset") + F.col("len") + 1
    first = F.greatest(F.lit(0), F.floor((o - ahead) / size))
    parts = blocks.withColumn("c", F.explode(F.sequence(first, F.floor((end - 1) / size))))
    start, stop = F.greatest(F.col("c") * size, o), F.least(F.col("c") * size + size + ahead, end)
    letters = F.concat("seq", F.lit(END)).substr((start - o + 1).cast("int"), (stop - start).cast("int"))
    parts = parts.where(stop > start).select("c", F.struct(start.alias("start"), "b", (stop - start).alias("n"), (start - o).alias("wi"), letters.alias("letters")).alias("p"))
    # A number of tasks that stays: few bytes go in, but many rows come out of every chunk.
    grouped = parts.repartition(partitions(blocks.sparkSession), "c").groupBy("c").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return grouped.select("c", F.concat_ws("", F.col("p.letters")).alias("text"), F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["b"].alias("b"), x["n"].alias("n"), x["wi"].alias("wi"))).alias("pieces"))


def text_at(places: DataFrame, blocks: DataFrame, s: str, k: Column | int, out: str = "kmer", size: int = CHUNK, from_: Column | int = 0, short: bool = False) -> DataFrame:
    """Adds letters [s + from_, s + k) of the text, both ends clamped to it, however many.

    Places meet the text by an equi-join on chunks. Stretches of more than ``AHEAD`` letters are read piece by piece and joined again; ``short`` says that
    there are none, as do plain numbers.
    """
    short = short or (isinstance(k, int) and isinstance(from_, int) and k - from_ <= AHEAD)
    low = F.greatest(F.lit(0), F.col(s) + from_).cast("bigint")
    asked = places.withColumn("_low", low).withColumn("_n", F.greatest(F.lit(0), F.col(s) + k - F.col("_low")).cast("bigint"))
    text = chunks(blocks, size).select(F.col("c").alias("_c"), F.col("text").alias("_text"))
    letters = F.coalesce(F.col("_text").substr((F.col("_low") - F.col("_c") * size + 1).cast("int"), F.col("_n").cast("int")), F.lit(""))
    read = lambda df, name: df.withColumn("_c", F.floor(F.col("_low") / size)).join(text, "_c", "left").withColumn(name, letters).drop("_c", "_text")
    if short:
        return read(asked, out).drop("_low", "_n")
    asked = cut(asked.withColumn("_row", F.monotonically_increasing_id()))
    long = asked.where(F.col("_n") > AHEAD).select("_row", "_low", "_n")
    pieces = long.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(AHEAD).cast("bigint"))))
    pieces = pieces.select("_row", "_p", (F.col("_low") + F.col("_p")).alias("_low"), F.least(F.lit(AHEAD), F.col("_n") - F.col("_p")).alias("_n"))
    joined = read(pieces, "_t").groupBy("_row").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"])).alias(out))
    whole = read(asked.where(F.col("_n") <= AHEAD), out).unionByName(asked.where(F.col("_n") > AHEAD).join(joined, "_row"))
    return whole.drop("_row", "_low", "_n")


def source_block(places: DataFrame, blocks: DataFrame, s: str = "s", size: int = CHUNK) -> DataFrame:
    """Adds ``b, seq_id, score, wi`` of the block that holds place ``s``: a range join made an equi-join on cells of the text."""
    o, end = F.col("offset"), F.col("offset") + F.col("len") + 1
    cells = blocks.withColumn("_c", F.explode(F.sequence(F.floor(o / size), F.floor((end - 1) / size)))).select("_c", "b", "seq_id", "score", "offset", "len")
    near = places.withColumn("_c", F.floor(F.col(s) / size)).join(cells, "_c")
    return near.where((F.col(s) >= o) & (F.col(s) < end)).withColumn("wi", (F.col(s) - o).cast("int")).drop("_c", "offset", "len")


def block_scores(blocks: DataFrame) -> DataFrame:
    return blocks.select("seq_id", "score")
