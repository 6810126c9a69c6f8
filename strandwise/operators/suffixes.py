"""The order of all suffixes of the text, and search in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.operators.ordering import ordered
from strandwise.operators.text import AHEAD, CHUNK, END, chunks, text_at
from strandwise.runtime import cut

#: Numbers of 63 bits in the first sorting key; longer ties are refined.
NUMBERS = 4
#: Letters of a chunk whose keys are made at once.
KEY_CHUNK = 1 << 13
#: A round of refinement compares so many times as many letters as the one before.
FAR = 8


def suffix_keys(blocks: DataFrame, letters: int, size: int = CHUNK) -> DataFrame:
    """``(s, b, wi, key)`` for every place of the text; key: the next ``letters`` letters, past the block's end and into the following ones."""
    place = F.sequence(F.col("p.start"), F.least(F.col("p.start") + F.col("p.n"), F.col("c") * size + size) - 1)
    pieces = chunks(blocks, size, letters).select("c", "text", F.explode("pieces").alias("p")).where(F.col("p.start") < F.col("c") * size + size)
    rows = pieces.select("c", "text", F.col("p.b").alias("b"), F.explode(place).alias("s"))
    keyed = rows.select("s", "b", F.col("text").substr((F.col("s") - F.col("c") * size + 1).cast("int"), F.lit(letters)).alias("key"))
    return keyed


def alphabet(blocks: DataFrame) -> np.ndarray:
    """The code points of the text in order: one small set from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                found.update(map(ord, set("".join(batch.column(0).slice(k, 256).to_pylist()))))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["x"])

    letters = blocks.where("seq is not null").select("seq").mapInArrow(run, "x int").distinct().collect()
    return np.unique(np.array([ord(END), *(r.x for r in letters)], np.uint32))


def packed(codes: np.ndarray, bits: int, letters: int) -> np.ndarray:
    """Of each place the next ``letters`` codes of ``bits`` bits as one number; codes behind the end are 0. Powers of two are put together pairwise."""
    shifted = lambda x, by: np.concatenate([x[by:], np.zeros(min(by, len(x)), np.int64)])
    power, size, out, done = codes.astype(np.int64), 1, np.zeros(len(codes), np.int64), 0
    while True:
        if letters & size:
            out = shifted(out, size) | power << bits * done
            done += size
        if size * 2 > letters:
            return out
        power = power << bits * size | shifted(power, size)
        size *= 2


def number_keys(blocks: DataFrame, numbers: int = NUMBERS, size: int = KEY_CHUNK) -> tuple[DataFrame, int]:
    """``(s, b, wi, k0, k1, ...)`` for every place of the text, and how many letters the keys have.

    The next letters, past the block's end and into the following ones, as numbers that compare as the letters do. How many fit depends on how many different letters there are.
    """
    known = alphabet(blocks)
    bits = int(len(known)).bit_length()
    each = 63 // bits
    letters = each * numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, text, pieces in zip(*(x.to_pylist() for x in batch.columns)):
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                codes = np.searchsorted(known, points) + 1
                own = min(size, len(codes))
                low = packed(codes, bits, each)
                keys = [np.concatenate([low[k * each :], np.zeros(min(k * each, len(low)), np.int64)])[:own] for k in range(numbers)]
                n = [min(p["n"], max(0, (c + 1) * size - p["start"])) for p in pieces]
                b, wi = np.repeat([p["b"] for p in pieces], n), np.arange(own) - np.repeat([p["start"] - c * size - p["wi"] for p in pieces], n)
                yield pa.RecordBatch.from_arrays([pa.array(c * size + np.arange(own)), pa.array(b.astype(np.int64)), pa.array(wi.astype(np.int32)), *map(pa.array, keys)], names=["s", "b", "wi", *[f"k{k}" for k in range(numbers)]])

    keys = chunks(blocks, size, letters).select("c", "text", "pieces").mapInArrow(run, "s bigint, b bigint, wi int, " + ", ".join(f"k{k} bigint" for k in range(numbers)))
    return keys, letters


def suffix_order(blocks: DataFrame, numbers: int = NUMBERS) -> DataFrame:
    """``(i BIGINT, s BIGINT, b BIGINT, wi INT)``: the rank i of the suffix that begins at place s of the text.

    Suffixes compare by code points, past the block's end; the end of the text sorts first. First all are sorted by ``number_keys`` of bounded
    length, then only tied ones again by the ranks of the suffixes that begin one, two, ... ``FAR`` - 1 times as many letters later, then ``FAR`` times as far.
    Equal keys may fill any number of tasks. No two suffixes are equal, so every tie ends. An empty text has no suffixes.
    """
    keys, step = number_keys(blocks, numbers)
    ranks = ordered(keys, [f"k{k}" for k in range(numbers)], ["s"], keep=["s", "b", "wi"]).select("s", "b", "wi", F.col("first").alias("r"), "tied")
    tied = cut(ranks.where("tied").select("s", "r"))
    known = ranks.select(F.col("s").alias("_at"), F.col("r").alias("_next"))
    newer = None  # ranks of the suffixes that were tied at first, as far as they are known
    while not tied.isEmpty():
        asked = tied.withColumn("_j", F.explode(F.array(*[F.lit(j) for j in range(1, FAR)]))).withColumn("_at", F.col("s") + F.col("_j") * step)
        asked = asked.join(known, "_at", "left")
        if newer is not None:
            asked = asked.join(newer.select(F.col("s").alias("_at"), F.col("r").alias("_newer")), "_at", "left").withColumn("_next", F.coalesce("_newer", "_next"))
        later = asked.groupBy("s", "r").agg(*[F.max(F.when(F.col("_j") == j, F.coalesce("_next", F.lit(-1)))).alias(f"next{j}") for j in range(1, FAR)])
        placed = ordered(later, ["r", *[f"next{j}" for j in range(1, FAR)]], ["s"], keep=["r", "s"])
        base = placed.groupBy("r").agg(F.min("pos").alias("_base"))
        new = cut(placed.join(base, "r").select("s", (F.col("r") + F.col("first") - F.col("_base")).alias("r"), "tied"))
        newer = new.select("s", "r") if newer is None else cut(newer.join(new.select("s"), "s", "left_anti").unionByName(new.select("s", "r")))
        tied = new.where("tied").select("s", "r")
        step *= FAR
    if newer is not None:
        ranks = ranks.where("not tied").select("s", "b", "wi", "r").unionByName(ranks.where("tied").drop("r", "tied").join(newer, "s").select("s", "b", "wi", "r"))
    return ranks.select(F.col("r").alias("i"), "s", "b", "wi")


def places_of(kmers: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(_at BIGINT, _new STRING)``: every place of the text where one of ``kmers(kmer)``, distinct and not empty, stands.

    K-mers meet the text by an equi-join on their first letters, as many as the power of two below their length, up to ``AHEAD``: a few joins whatever
    the lengths. The rest is compared piece by piece of ``AHEAD`` letters, each piece only where all before it agreed.
    """
    n = F.length("kmer")
    wanted = cut(kmers.select(F.col("kmer").alias("_new"), n.alias("_size"), F.expr(f"cast(pow(2, least(floor(log2(length(kmer) + 0.5)), {AHEAD.bit_length() - 1})) as int)").alias("_first")))
    sizes = sorted((r._first, r.n) for r in wanted.groupBy("_first").agg(F.max("_size").alias("n")).collect())
    out, text = None, suffix_keys(blocks, AHEAD).select(F.col("s").alias("_at"), "key")
    for first, longest in sizes:
        here = wanted.where(F.col("_first") == first).withColumn("_k", F.col("_new").substr(1, first))
        met = text.withColumn("_k", F.col("key").substr(1, first)).join(here, "_k").where(F.startswith("key", F.col("_new").substr(1, AHEAD))).select("_at", "_new", "_size")
        for done in range(AHEAD, longest, AHEAD):
            met = cut(met)
            rest = text_at(met.where(F.col("_size") > done).withColumn("_begin", F.col("_at") + done), blocks, "_begin", F.least(F.lit(AHEAD), F.col("_size") - done), "_t", short=True)
            met = met.where(F.col("_size") <= done).unionByName(rest.where(F.col("_t") == F.col("_new").substr(done + 1, AHEAD)).select("_at", "_new", "_size"))
        out = met if out is None else out.unionByName(met)
    if out is None:
        return text.select("_at", F.lit("").alias("_new")).limit(0)
    return cut(out.select("_at", "_new"))


def find_kmer(blocks: DataFrame, suffixes: DataFrame, kmers: DataFrame) -> DataFrame:
    """``(kmer, i_from, i_to)``: the half-open interval of ranks whose suffixes begin with each k-mer, which may have any length.

    The empty k-mer has all ranks, from their number; one that doesn't occur has no row; nulls are left out.
    """
    wanted = kmers.where("kmer is not null").select("kmer").distinct()
    at = places_of(wanted.where("kmer <> ''"), blocks).join(suffixes.select(F.col("s").alias("_at"), "i"), "_at")
    found = at.groupBy(F.col("_new").alias("kmer")).agg(F.min("i").alias("i_from"), (F.max("i") + 1).alias("i_to"))
    n = suffixes.count()
    every = wanted.where("kmer = ''").select("kmer", F.lit(0).cast("bigint").alias("i_from"), F.lit(n).cast("bigint").alias("i_to"))
    return found.unionByName(every.where(F.col("i_to") > 0))
