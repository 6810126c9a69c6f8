"""Command line: ``select`` motifs from sequences and scores, ``test`` thresholds with new permutations, ``zrank`` the motifs of a selection, ``count`` motifs.

    python -m strandwise.cli select -f seqs.fa -s scores.tsv -w 4,8 -l 0,3 -g 1.1 -r 100 -z 4 -e 123 -o out/
    python -m strandwise.cli test -f seqs.fa -s scores.tsv -i out/ -r 1000 -e 321 -o out/
    python -m strandwise.cli zrank -i out/
    python -m strandwise.cli count -f seqs.fa -k CATACTGAGA,TACTGA
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise import sinks, sources
from strandwise.operators import filters, motifs, peaks, permutation, suffixes, text
from strandwise.runtime import cut, scratch


def numbers(kind):
    return lambda value: [kind(x) for x in value.split(",")]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandwise")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("select", "test"):
        p = commands.add_parser(name)
        p.add_argument("-f", "--fasta", required=True)
        p.add_argument("-s", "--scores", required=True)
        p.add_argument("-r", "--reps", type=int, default=100)
        p.add_argument("-e", "--seed", type=int, default=None)
        p.add_argument("-t", "--threads", type=int, default=None, help="shuffle partitions")
        p.add_argument("--compatible", action="store_true", help="sequential shuffles that java.util.Random gives")
        if name == "select":
            p.add_argument("-w", "--window", type=numbers(int), required=True)
            p.add_argument("-l", "--spatial", type=numbers(int), default=[0])
            p.add_argument("-g", "--gini", type=numbers(float), default=[1.1])
            p.add_argument("-z", "--sigma", type=float, default=4.0)
            p.add_argument("-k", "--kmax", type=int, default=12)
            p.add_argument("-o", "--out", required=True)
        else:
            p.add_argument("-i", "--input", required=True, help="folder or theta.tsv of a selection")
            p.add_argument("-o", "--out", default=None)
            p.add_argument("--interval", action="store_true", help="print the rate with its exact interval as well")
    p = commands.add_parser("zrank")
    p.add_argument("-i", "--input", required=True, help="folder of a selection")
    p.add_argument("-a", "--all", action="store_true", help="every parameter row of a motif rather than its best")
    p.add_argument("-w", "--write", default=None, help="folder for the table; printed if absent")
    p = commands.add_parser("count")
    p.add_argument("-f", "--fasta", required=True)
    p.add_argument("-k", "--kmers", default=None, help="file, list with commas, or - for standard input")
    p.add_argument("-c", "--clusters", default=None, help="file, or list with commas as one cluster")
    p.add_argument("-d", "--directional", action="store_true")
    p.add_argument("-l", "--locate", action="store_true")
    p.add_argument("-o", "--overlap", action="store_true")
    p.add_argument("-w", "--write", default=None, help="folder for the table; printed if absent")
    return top


def _load(spark: SparkSession, a):
    blocks = cut(text.align(sources.read_fasta(spark, a.fasta), sources.read_scores(spark, a.scores)))
    return blocks, cut(suffixes.suffix_order(blocks))


def select(spark: SparkSession, a) -> None:
    out = a.out.rstrip("/") + "/"
    blocks, order = _load(spark, a)
    grid = filters.parameter_grid(spark, a.window, a.spatial, a.gini)
    perms = cut(permutation.permutations(blocks, a.reps, a.seed or 0, a.compatible))
    null = cut(permutation.permutation_distribution(order, blocks, grid, perms, a.reps))
    limits = cut(permutation.thresholds(null, a.sigma))
    sinks.write_permutations(null, grid, out + "permdists")
    sinks.write_thresholds(limits, grid, out)
    sinks.write_peaks(peaks.kmer_peaks(order, blocks, grid, limits, True, a.kmax), out + "peaks.tsv")
    sinks.write_peaks(peaks.merged_sub_peaks(order, blocks, grid, limits, True, a.kmax), out + "merged_peaks.tsv")


def test(spark: SparkSession, a) -> int:
    path = a.input if a.input.endswith(".tsv") else a.input.rstrip("/") + "/theta.tsv"
    blocks, order = _load(spark, a)
    grid = cut(sources.read_thresholds(spark, path))
    limits = grid.select("f", "theta", "spatial_theta")
    rate, null = permutation.estimate_false_positive_rate(order, blocks, grid, limits, a.reps, a.seed or 0, compatible=a.compatible)
    if a.out:
        sinks.write_permutations(null, grid, a.out.rstrip("/") + "/test_permdists")
    found = rate.first()
    print("\t".join(map(str, found)) if a.interval else found.fp)
    return found.fp


def zrank(spark: SparkSession, a) -> DataFrame:
    found, null = sources.read_selection(spark, a.input)
    return _told(permutation.zrank_selection(found, null, not a.all).orderBy(F.desc("zmax"), "kmer"), a.write)


def _told(table: DataFrame, folder: str | None) -> DataFrame:
    """Every row, to a folder or, one task after another, to standard output."""
    if folder:
        sinks.write_table(table, folder)
        return table
    print("\t".join(table.columns))
    for row in table.toLocalIterator():
        print("\t".join("null" if x is None else str(x) for x in row))
    return table


def count(spark: SparkSession, a) -> DataFrame:
    seqs = sources.read_fasta(spark, a.fasta, strip=True)
    if a.clusters:
        groups: dict[str, list[str]] = {}
        if sources.exists(spark, a.clusters):
            for r in sources.read_clusters(spark, a.clusters).collect():
                groups.setdefault(r.cluster, []).append(r.kmer)
        else:
            groups[a.clusters] = sorted(set(a.clusters.split(",")))
        names, kind = list(groups), "cluster"
        out = motifs.locate_clusters(seqs, groups, a.directional, base=0, longest=False) if a.locate else motifs.cluster_counts(seqs, groups, a.directional, a.overlap)
    else:
        text = sys.stdin.read() if a.kmers == "-" else a.kmers
        listed = {"path": text} if a.kmers != "-" and sources.exists(spark, text) else {"kmers": text}
        names, kind = sorted(r.kmer for r in sources.read_kmers(spark, directional=a.directional, **listed).collect()), "kmer"
        out = motifs.locate_kmers(seqs, names, a.directional, base=0, longest=False) if a.locate else motifs.kmer_counts(seqs, names, a.directional, a.overlap)
    return _told(out.orderBy("seqid", "location", kind) if a.locate else motifs.as_matrix(out, kind, names).orderBy("seq_id"), a.write)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("strandwise")
    if getattr(a, "threads", None):
        builder = builder.config("spark.sql.shuffle.partitions", a.threads)
    spark = builder.getOrCreate()
    with scratch(spark):
        {"select": select, "test": test, "zrank": zrank, "count": count}[a.command](spark, a)


if __name__ == "__main__":
    main()
