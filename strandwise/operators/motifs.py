"""Counting and locating motifs in sequences, and tables of motif intervals."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.operators.suffixes import places_of
from strandwise.runtime import cut

#: Complements of bases; brackets of patterns turn round.
BASES, PAIRS = "ACGTacgt[]", "TGCAtgca]["
#: Patterns that one pass holds; more are dealt to further passes.
PATTERNS = 1_000
#: Places of a cell in which rows meet the k-mers that stand around them.
CELL = 64


def reverse_complement(column: Column | str) -> Column:
    return F.translate(F.reverse(column), BASES, PAIRS)


def _complement(text: str) -> str:
    return text[::-1].translate(str.maketrans(BASES, PAIRS))


def canonical(column: Column | str) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(column, reverse_complement(column))


def extract_kmers(table: DataFrame, directional: bool = False) -> DataFrame:
    """Distinct k-mers of a table, both strands as one unless ``directional``."""
    return table.where("kmer is not null").select((F.col("kmer") if directional else canonical("kmer")).alias("kmer")).distinct()


def _pattern(members: list[str], directional: bool) -> str:
    """Any of the members or, if not directional, of their reverse complements."""
    every = set(members) | (set() if directional else {_complement(m) for m in members})
    return "|".join(sorted(every))


def counts(seqs: DataFrame, patterns: dict[str, str], overlap: bool = False, name: str = "regex") -> DataFrame:
    """``(seq_id, <name>, n BIGINT)`` for each sequence and named pattern, zeros included. Sequences are upper-cased, patterns are not; a null sequence counts 0.

    Overlapping matches are counted with a look-ahead. Each sequence is read once for ``PATTERNS`` patterns.
    """
    named = list(patterns.items())
    out = None
    for k in range(0, max(1, len(named)), PATTERNS):
        each = [F.struct(F.lit(n).alias("name"), F.coalesce(F.regexp_count(F.upper("seq"), F.lit(f"(?={p})" if overlap else p)), F.lit(0)).cast("bigint").alias("n")) for n, p in named[k : k + PATTERNS]]
        if not each:
            return seqs.select("seq_id", F.lit("").alias(name), F.lit(0).cast("bigint").alias("n")).limit(0)
        part = seqs.select("seq_id", F.explode(F.array(*each)).alias("c")).select("seq_id", F.col("c.name").alias(name), F.col("c.n").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def regex_counts(seqs: DataFrame, patterns: list[str], overlap: bool = False) -> DataFrame:
    return counts(seqs, {p: p for p in dict.fromkeys(patterns)}, overlap)


def kmer_counts(seqs: DataFrame, kmers: list[str], directional: bool = True, overlap: bool = False) -> DataFrame:
    """Counts by k-mer; if not directional a match of the reverse complement counts under the k-mer's name, a palindrome once."""
    return counts(seqs, {k: _pattern([k], directional) for k in dict.fromkeys(kmers)}, overlap, "kmer")


def cluster_counts(seqs: DataFrame, clusters: dict[str, list[str]], directional: bool = True, overlap: bool = False) -> DataFrame:
    """Counts of any member of each cluster."""
    return counts(seqs, {c: _pattern(m, directional) for c, m in clusters.items()}, overlap, "cluster")


def all_kmer_counts(seqs: DataFrame, k: int, directional: bool = True) -> DataFrame:
    """``(seq_id, kmer, n)`` of all k-mers over ACGT that occur, overlapping ones included: positions exploded, partial counts before the shuffle."""
    rows = seqs.where(F.length("seq") >= k).select("seq_id", F.upper("seq").alias("seq"))
    at = rows.withColumn("p", F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1))).select("seq_id", F.col("seq").substr(F.col("p"), F.lit(k)).alias("kmer"))
    kept = at.where(F.col("kmer").rlike("^[ACGT]+$"))
    return kept.select("seq_id", ("kmer" if directional else canonical("kmer").alias("kmer"))).groupBy("seq_id", "kmer").agg(F.count(F.lit(1)).alias("n"))


def as_matrix(long: DataFrame, name: str, values: list[str]) -> DataFrame:
    """One row for each sequence and a column for each of ``values``."""
    return long.groupBy("seq_id").pivot(name, values).agg(F.sum("n")).fillna(0)


def locate(seqs: DataFrame, patterns: dict[str, list[str]], name: str, base: int = 1, show_match: bool = False, longest: bool = True, plain: bool = False) -> DataFrame:
    """``(seqid, <name>, location INT[, match])``: matches that don't overlap, cases alike, places from ``base``; ``match`` is in upper case.

    Each pattern is a list of alternatives. ``longest``: of the matches at the leftmost place the longest is taken, whatever alternatives
    or groups it comes from; else the alternatives are tried in sorted order. ``plain``: alternatives are texts, not expressions. Sequences with a null id or text have no matches. The rows don't shuffle.
    """
    ready = []
    for label, members in patterns.items():
        ready.append((label, "|".join(re.escape(m) if plain else m for m in sorted(set(members)))))
    schema = T.StructType([T.StructField("seqid", T.StringType()), T.StructField(name, T.StringType()), T.StructField("location", T.IntegerType()), *([T.StructField("match", T.StringType())] if show_match else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(label, regex.compile(p, regex.IGNORECASE | (regex.POSIX if longest else 0))) for label, p in ready]
        for batch in batches:
            rows = []
            for seq_id, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for label, p in compiled:
                    rows.extend((seq_id, label, m.start() + base, m.group().upper()) for m in p.finditer(seq) if m.group())
                if len(rows) > 100_000:
                    yield _batch(rows, schema.names)
                    rows = []
            yield _batch(rows, schema.names)

    return seqs.where("seq_id is not null and seq is not null").select("seq_id", "seq").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)


def regex_locate(seqs: DataFrame, patterns: list[str], **how) -> DataFrame:
    return locate(seqs, {p: [p] for p in patterns}, "regex", **how)


def locate_kmers(seqs: DataFrame, kmers: list[str], directional: bool = True, **how) -> DataFrame:
    return locate(seqs, {k: [k] if directional else [k, _complement(k)] for k in dict.fromkeys(kmers)}, "kmer", plain=True, **how)


def locate_clusters(seqs: DataFrame, clusters: dict[str, list[str]], directional: bool = True, **how) -> DataFrame:
    return locate(seqs, {c: m if directional else [*m, *map(_complement, m)] for c, m in clusters.items()}, "cluster", plain=True, **how)


def prune_intervals(rows: DataFrame, start: str = "s", end: Column | None = None, key: str = "i", cell: int = 256) -> DataFrame:
    """Rows whose interval [start, start + length of kmer] lies in no other row's. Of equal intervals the one with the smallest ``key`` stays.

    A containing interval covers every cell of places the contained one touches, so candidates meet by the cell of the contained one's start;
    within a cell only the farthest end for each start can contain anything, which a running maximum over starts finds: no pairs are made.
    """
    e = F.col(start) + F.length("kmer") if end is None else end
    base = rows.withColumn("_s", F.col(start).cast("bigint")).withColumn("_e", e.cast("bigint"))
    spans = base.groupBy("_s", "_e").agg(F.min(key).alias("_keep"))
    asked = spans.select("_s", "_e", F.floor(F.col("_s") / cell).alias("_c"), F.lit(1).alias("_ask"))
    held = spans.select("_s", "_e", F.explode(F.sequence(F.floor(F.col("_s") / cell), F.floor(F.col("_e") / cell))).alias("_c"), F.lit(0).alias("_ask"))
    # By start, longest first: an interval is contained if an earlier one of the cell reaches as far.
    w = Window.partitionBy("_c").orderBy("_s", F.desc("_e"), F.desc("_ask")).rowsBetween(Window.unboundedPreceding, -1)
    seen = asked.unionByName(held).withColumn("_far", F.max(F.when(F.col("_ask") == 0, F.col("_e"))).over(w))
    inside = seen.where("_ask = 1 and _far >= _e").select("_s", "_e")
    kept = spans.join(inside, ["_s", "_e"], "left_anti")
    return base.join(kept, ["_s", "_e"]).where(F.col(key) == F.col("_keep")).drop("_s", "_e", "_keep")


def extend_kmers(table: DataFrame, blocks: DataFrame, suffixes: DataFrame, compatible: bool = False) -> DataFrame:
    """Lengthen k-mers to longer ones of the same table that stand around them in the text.

    Each row moves to the longest k-mer of the table whose text stands around it, the leftmost of equally long ones; s, i and wi move along. Nothing
    longer stands around that one, so one pass does. K-mers may have any length: their places come from ``places_of``, and meet the rows in cells of
    places. Values that no longer hold are null on changed rows; ``compatible`` also nulls khat, gini and windowed on every row shorter than the longest.
    """
    longest = table.agg(F.max(F.length("kmer"))).first()[0] or 0
    current = cut(table.withColumn("_row", F.monotonically_increasing_id()).withColumn("_s0", F.col("s")).withColumn("_kmer0", F.col("kmer")).withColumn("_short", F.length("kmer") < longest))
    # Of the k-mers at one place the longest stands around all that the others do.
    found = places_of(table.where("kmer <> ''").select("kmer").distinct(), blocks).withColumn("_n", F.length("_new"))
    held = found.groupBy("_at").agg(F.max("_n").alias("_n")).withColumn("_c", F.explode(F.sequence(F.floor(F.col("_at") / CELL), F.floor((F.col("_at") + F.col("_n")) / CELL))))
    asked = current.where("_short").select("_row", "s", F.length("kmer").alias("_len"), F.floor(F.col("s") / CELL).alias("_c"))
    around = asked.join(held, "_c").where((F.col("_at") <= F.col("s")) & (F.col("_at") + F.col("_n") >= F.col("s") + F.col("_len")) & (F.col("_n") > F.col("_len")))
    best = around.groupBy("_row").agg(F.min_by(F.struct("_at", "_n"), F.struct(-F.col("_n"), F.col("_at"))).alias("_b")).select("_row", "_b._at", "_b._n")
    best = best.join(found.withColumnRenamed("_new", "_text"), ["_at", "_n"]).select("_row", "_at", "_text")
    moved = current.join(best, "_row", "left").withColumn("_to", F.coalesce("_at", "s"))
    current = moved.withColumn("kmer", F.coalesce("_text", "kmer")).withColumn("wi", (F.col("wi") + F.col("_to") - F.col("s")).cast("int")).withColumn("s", F.col("_to"))
    places = suffixes.select(F.col("i").alias("_i"), "s")
    changed = F.col("s") != F.col("_s0")
    lost = F.col("_short") if compatible else changed | (F.length("kmer") != F.length("_kmer0"))
    out = current.join(places, "s").withColumn("i", F.col("_i"))
    for c in ("khat", "gini", "spatialGini", "windowed", "spatialWindowed"):
        if c in table.columns and not (compatible and c.startswith("spatial")):
            out = out.withColumn(c, F.when(~lost, F.col(c)))
    return out.select(*table.columns)
