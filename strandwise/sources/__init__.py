"""Readers of tables, sequences, scores, thresholds, motif and cluster lists."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``(f, n, value)``: the parts of files between separators, in order of n. ``.gz`` is decompressed by the reader, ``.gzip`` in a task for each file."""
    if not path.endswith(".gzip"):
        return spark.read.option("lineSep", sep).text(path).select(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen, rest, decoder = 0, "", io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), "utf-8", errors="replace", newline="")
                while text := decoder.read(1 << 20):
                    *parts, rest = (rest + text).split(sep)
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(parts), pa.string()), pa.array(range(seen, seen + len(parts)), pa.int64()), pa.array(parts, pa.string())], names=["f", "n", "value"])
                    seen += len(parts)
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([seen]), pa.array([rest])], names=["f", "n", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "f string, n bigint, value string")


def read_fasta(spark: SparkSession, path: str, strip: bool = False) -> DataFrame:
    """``(seq_id, seq)``: a line that begins with ``>`` opens a record, its rest is the id as it stands; the other lines are joined.

    ``.gz`` and ``.gzip`` are decompressed. Text before the first ``>`` belongs to no record; of records with one id the last stays. ``strip`` trims
    every line. Files are read by record, so a large file splits into many tasks. A missing path is an error.
    """
    raw = _records(spark, path, "\n>")
    first = F.col("value").startswith(">")
    opened = raw.groupBy("f").agg(F.min("n").alias("n0"))
    body = raw.join(F.broadcast(opened), "f").where((F.col("n") > F.col("n0")) | first).withColumn("value", F.when((F.col("n") == F.col("n0")) & first, F.expr("substring(value, 2)")).otherwise(F.col("value")))
    head, rest = F.substring_index("value", "\n", 1), F.expr("case when instr(value, '\n') > 0 then substring(value, instr(value, '\n') + 1) else '' end")
    clean = F.regexp_replace(rest, r"[ \t\r]*\n[ \t]*", "") if strip else F.regexp_replace(rest, r"\r?\n", "")
    rows = body.select(F.rtrim(head) if strip else F.regexp_replace(head, r"\r$", ""), F.trim(clean) if strip else F.regexp_replace(clean, r"\r$", ""), "f", "n").toDF("seq_id", "seq", "f", "n")
    return rows.groupBy("seq_id").agg(F.max_by("seq", F.struct("f", "n")).alias("seq"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """``(seq_id, score DOUBLE)`` of a tab-separated file. Lines whose second field is no number (a header) and lines of one field are left out; of repeated ids the last line stays."""
    raw = _records(spark, path, "\n").select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("x"), "f", "n")
    rows = raw.select(F.get("x", F.lit(0)).alias("seq_id"), F.expr("try_cast(trim(get(x, 1)) as double)").alias("score"), "f", "n").where("score is not null")
    return rows.groupBy("seq_id").agg(F.max_by("score", F.struct("f", "n")).alias("score"))


def from_rows(spark: SparkSession, seqs: dict[str, str], scores: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """In-memory sequences and scores as tables."""
    return spark.createDataFrame(list(seqs.items()), "seq_id string, seq string"), spark.createDataFrame([(k, float(v)) for k, v in scores.items()], "seq_id string, score double")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """A parameter grid with ``theta`` and ``spatial_theta`` from a file of thresholds: six columns by position, a header, ``null`` for null."""
    schema = "half_window int, min_gini double, spatial_length int, min_spatial_gini double, theta float, spatial_theta float"
    rows = spark.read.csv(path, sep="\t", header=True, nullValue="null", schema=schema, enforceSchema=True)
    w = Window.orderBy("n")  # a grid of parameters: a handful of rows
    return rows.withColumn("n", F.monotonically_increasing_id()).withColumn("f", (F.row_number().over(w) - 1).cast("int")).select("f", "half_window", "spatial_length", "min_gini", "min_spatial_gini", "theta", "spatial_theta")


def read_kmers(spark: SparkSession, path: str | None = None, kmers: str | None = None, directional: bool = False) -> DataFrame:
    """Distinct k-mers from a table with a ``kmer`` column, from lines, or from a list with commas or line breaks; canonical unless ``directional``."""
    from strandwise.operators.motifs import canonical

    if kmers is not None:
        rows = spark.createDataFrame([(kmers,)], "value string").select(F.explode(F.split("value", r"[,\n]")).alias("kmer"))
    else:
        text = spark.read.text(path)
        head = text.first()
        names = head[0].split("\t") if head else []
        if "kmer" in names:
            rows = text.where(F.col("value") != head[0]).select(F.get(F.split("value", "\t"), F.lit(names.index("kmer"))).alias("kmer"))
        else:
            rows = text.select(F.col("value").alias("kmer"))
    rows = rows.select(F.trim("kmer").alias("kmer")).where("kmer <> ''")
    return rows.select(("kmer" if directional else canonical("kmer").alias("kmer"))).distinct()


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``(cluster, kmer)`` from sections headed ``Cluster N: name``; gaps and spaces in members drop out, the name gets a ``+``."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    head = F.regexp_extract("line", r"^Cluster\s+\d+:\s*(.*?)\s*$", 1)
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # a list of motifs
    tagged = rows.withColumn("cluster", F.last(F.when(F.col("line").startswith("Cluster"), F.concat(head, F.lit("+"))), ignorenulls=True).over(w))
    return tagged.where(~F.col("line").startswith("Cluster") & F.col("cluster").isNotNull()).select("cluster", F.regexp_replace("line", r"[-\s]", "").alias("kmer")).where("kmer <> ''")


def read_selection(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(peaks, maxima of permuted scores) without spatial smoothing, from the files of a selection run or, where one isn't there, from its ``.gz``."""

    def read(name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        return spark.read.csv(path if exists(spark, path) else f"{path}.gz", sep="\t", header=True, nullValue="null", inferSchema=True).where("spatialLength = 0")

    return read("peaks.tsv"), read("permdists_windowed.tsv")
