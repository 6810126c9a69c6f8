"""Clusters of motifs by their k-gram profiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.operators import dendrogram
from strandwise.operators.motifs import reverse_complement
from strandwise.operators.ordering import ordered
from strandwise.runtime import cut

#: Profiles of a block; a task holds the products of two blocks.
BLOCK = 512
#: Profiles of a block of one gram. Each profile shuffles once for every block of its grams, so these are larger; a task goes through them in parts of ``BLOCK``.
GRAM_BLOCK = 4096


def grams(kmers: DataFrame, k: int, directional: bool) -> DataFrame:
    """``(kmer, gram, n)``: overlapping k-grams; on both strands a gram and its reverse complement are one, counted in either direction."""
    rows = kmers.where(F.length("kmer") >= k).withColumn("p", F.explode(F.sequence(F.lit(1), F.length("kmer") - k + 1))).select("kmer", F.upper(F.col("kmer").substr(F.col("p"), F.lit(k))).alias("gram"))
    return rows.withColumn("gram", F.col("gram") if directional else F.least("gram", reverse_complement("gram"))).groupBy("kmer", "gram").agg(F.count(F.lit(1)).alias("n"))


def distances(kmers: DataFrame, k: int = 4, directional: bool = True) -> DataFrame:
    """``(a, b, distance)`` for a < b: 1 - p.q / (|p|^2 + |q|^2 - p.q); zeros become half the smallest positive one.

    The whole matrix, as average linkage needs it, of a list of motifs; of large tables ``near_distances`` finds the pairs that are near.
    Profiles are dealt to blocks of about ``BLOCK`` and every two blocks meet in a task, which multiplies them: pairs don't shuffle, and no gram is a
    hot key. Pairs that share no gram have distance 1 and no row.
    """
    g = grams(kmers.select("kmer").distinct(), k, directional)
    profiles = cut(g.groupBy("kmer").agg(F.collect_list("gram").alias("grams"), F.collect_list("n").alias("counts")))
    blocks = max(1, -(-profiles.count() // BLOCK))
    met = _dealt(profiles, F.lit(blocks))
    return met.groupBy("_i", "_j").applyInArrow(lambda group: _products(group), "a string, b string, distance double")


def near_distances(kmers: DataFrame, k: int = 4, directional: bool = True, at_most: float = 0.3) -> DataFrame:
    """``(a, b, distance)`` for a < b of all pairs whose distance (as in ``distances``, but 0 for equal profiles) is ``at_most``, which is below 1.

    Only likely pairs meet: with t = 1 - at_most, p.q >= t / (1 + t) * (|p|^2 + |q|^2) >= 2 t / (1 + t) * |p| |q|, so the first gram of two near profiles in a
    common order can't lie in the tail of a profile whose norm is below 2 t / (1 + t) of the whole. Profiles meet on the grams in front of their tails, rarest
    grams first, and each pair is taken at its first common one. The profiles of one gram are dealt to blocks of about ``GRAM_BLOCK``, of which every two meet in a
    task, so a hot gram fills many tasks and only near pairs leave them. K-mers shorter than ``k`` have no grams and no row.
    """
    t = 1 - at_most
    least = (2 * t / (1 + t)) ** 2
    g = cut(grams(kmers.select("kmer").distinct(), k, directional))
    often = g.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    x = F.array_sort(F.collect_list(F.struct("often", "gram", "n"))).alias("x")
    profiles = g.join(often, "gram").groupBy("kmer").agg(x, F.sum(F.col("n") * F.col("n")).alias("norm"))
    # Squared norm of the tail from each gram on; a gram is in front if what comes from it on is large enough.
    tail = F.transform("x", lambda _, j: F.aggregate(F.slice("x", j + 1, F.size("x")), F.lit(0).cast("bigint"), lambda s, e: s + e["n"] * e["n"]))
    fronts = F.size(F.filter(tail, lambda e: e >= F.col("norm") * (least - 1e-9)))
    rows = cut(profiles.select("kmer", F.col("x.gram").alias("grams"), F.col("x.n").alias("counts"), fronts.alias("fronts")))
    at = rows.withColumn("_gram", F.explode(F.slice("grams", F.lit(1), F.col("fronts"))))
    blocks = at.groupBy("_gram").agg(F.ceil(F.count(F.lit(1)) / GRAM_BLOCK).alias("_n"))
    met = _dealt(at.join(blocks, "_gram"), F.col("_n"))
    found = met.groupBy("_gram", "_i", "_j").applyInArrow(lambda group: _products(group, at_most), "a string, b string, distance double")
    return found.where(F.col("distance") <= at_most + 1e-9)


def _dealt(profiles: DataFrame, blocks: Column) -> DataFrame:
    """Each profile once for every block it meets, its own included: blocks ``_i`` <= ``_j``, and whether it is of the first."""
    rows = profiles.withColumn("_x", F.pmod(F.xxhash64("kmer"), blocks)).withColumn("_y", F.explode(F.sequence(F.lit(0).cast("bigint"), (blocks - 1).cast("bigint"))))
    return rows.select(*(["_gram"] if "_gram" in profiles.columns else []), F.least("_x", "_y").alias("_i"), F.greatest("_x", "_y").alias("_j"), (F.col("_x") <= F.col("_y")).alias("_low"), "kmer", "grams", "counts")


def _products(group: pa.Table, at_most: float | None = None) -> pa.Table:
    """Distances within a block, or between the rows of two; with ``at_most`` of near ones that have no common gram before the one that they meet at."""
    names = np.array(group["kmer"].to_pylist(), object)
    low = group["_low"].to_numpy()
    codes = group["grams"].combine_chunks().flatten().dictionary_encode()
    lengths = pc.list_value_length(group["grams"]).to_numpy()
    x = np.zeros((len(names), len(codes.dictionary)))
    row, gram = np.repeat(np.arange(len(names)), lengths), codes.indices.to_numpy()
    x[row, gram] = group["counts"].combine_chunks().flatten().to_numpy()
    norm = (x * x).sum(1)
    same = group["_i"][0] == group["_j"][0]
    one, two = (np.arange(len(names)),) * 2 if same else (np.flatnonzero(low), np.flatnonzero(~low))
    rank = np.argsort(np.argsort(names))
    if at_most is not None:
        here = gram == codes.dictionary.index(group["_gram"][0]).as_py()
        before = np.arange(len(row)) < np.flatnonzero(here)[row]  # each profile has the gram once
        early = np.zeros_like(x)
        early[row[before], gram[before]] = 1
    found = []
    for k in range(0, len(one), BLOCK):
        some = one[k : k + BLOCK]
        dot = x[some] @ x[two].T
        wanted = (dot > 0) & (rank[some][:, None] < rank[two][None, :]) if same else dot > 0
        if at_most is not None:
            wanted &= dot * (2 - at_most) >= (1 - at_most) * (norm[some][:, None] + norm[two][None, :]) * (1 - 1e-9)
            wanted &= early[some] @ early[two].T == 0
        p, q = np.nonzero(wanted)
        found.append((some[p], two[q], dot[p, q]))
    p, q, d = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
    turned = rank[p] > rank[q]
    p, q = np.where(turned, q, p), np.where(turned, p, q)
    texts = group["kmer"].combine_chunks()
    return pa.table({"a": texts.take(pa.array(p)), "b": texts.take(pa.array(q)), "distance": 1 - d / (norm[p] + norm[q] - d)})


def average_linkage(d: np.ndarray, clusters: int) -> np.ndarray:
    """Cluster of each row when the closest pair of clusters, by mean distance, is joined until so many are left."""
    n = len(d)
    d, label, weight = d.astype(float).copy(), np.arange(n), np.ones(n)
    np.fill_diagonal(d, np.inf)
    for _ in range(n - clusters):
        a, b = sorted(divmod(int(np.argmin(d)), n))
        mean = (d[a] * weight[a] + d[b] * weight[b]) / (weight[a] + weight[b])
        d[a], d[:, a] = mean, mean
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        weight[a] += weight[b]
        label[label == b] = a
    return np.unique(label, return_inverse=True)[1]


def silhouette(d: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette width; rows alone in a cluster count 0."""
    k = label.max() + 1
    member = label[:, None] == np.arange(k)
    sums, sizes = d @ member, member.sum(0)
    own = sizes[label]
    inner = np.where(own > 1, sums[np.arange(len(d)), label] / np.maximum(own - 1, 1), 0)
    outer = np.where(member, np.inf, sums / sizes).min(1)
    width = np.where(own > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0)
    return float(width.mean())


def integral_optimum(f: Callable[[list[int]], list[float]], low: int, high: int, resolution: int = 10) -> int:
    """The integer in low..high with the largest value found on a grid that gets finer around the best so far; ``f`` has the values of a grid at once."""
    seen: dict[int, float] = {}
    while True:
        step = max(1, -(-(high - low) // resolution))
        grid = sorted({*range(low, high + 1, step), high})
        if new := [x for x in grid if x not in seen]:
            seen.update(zip(new, f(new)))
        best = max(grid, key=lambda x: (seen[x], -x))
        if step == 1:
            return best
        low, high = max(low, best - step), min(high, best + step)


def linkage(pairs: DataFrame, n: int) -> list[tuple[int, int]]:
    """The joins ``(a, b)`` of average linkage over rows 0..n-1, closest first; cluster b goes on as a, the smaller number. ``pairs(a, b, sim)`` for a < b, 0 where missing.

    Each round joins all mutual nearest neighbours by (mean distance, a, b) and adds up the similarities of what is left. No cluster comes closer by a join,
    so the order of heights is that of joining one pair at a time. What shares nothing joins last. Only the joins, n - 1 pairs of numbers, reach the driver.
    """
    spark = pairs.sparkSession
    weights = cut(spark.range(n).select(F.col("id").alias("c"), F.lit(1).cast("bigint").alias("w")))
    joins, pairs = [], cut(pairs)
    while not pairs.isEmpty():
        wa, wb = weights.select(F.col("c").alias("a"), F.col("w").alias("wa")), weights.select(F.col("c").alias("b"), F.col("w").alias("wb"))
        near = pairs.join(wa, "a").join(wb, "b").select(F.struct(F.round(1 - F.col("sim") / (F.col("wa") * F.col("wb")), 12).alias("d"), "a", "b").alias("p"))
        best = near.select(F.explode(F.array("p.a", "p.b")).alias("c"), "p").groupBy("c").agg(F.min("p").alias("p"))
        mutual = cut(best.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("p.d", "p.a", "p.b"))
        joins.extend((r.d, r.a, r.b) for r in mutual.collect())
        ends = {e: mutual.select(F.col("b").alias(e), F.col("a").alias(f"_{e}")) for e in "abc"}
        moved = pairs.join(ends["a"], "a", "left").join(ends["b"], "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"), "sim").where("x <> y")
        pairs = cut(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("sim").alias("sim")))
        weights = cut(weights.join(ends["c"], "c", "left").groupBy(F.coalesce("_c", "c").alias("c")).agg(F.sum("w").alias("w")))
    left = sorted(set(range(n)) - {b for _, _, b in joins})
    return [(a, b) for _, a, b in sorted(joins + [(1.0, left[0], b) for b in left[1:]])]


def labels(joins: list[tuple[int, int]], n: int, clusters: int) -> np.ndarray:
    """Cluster of each row when so many are left."""
    label = np.arange(n)
    for a, b in joins[: n - clusters]:
        label[b] = a
    while (label[label] != label).any():
        label = label[label]
    return label


def _sums(pairs: DataFrame, label: np.ndarray) -> DataFrame:
    """``(x, own, c, sim, size)``: the similarities of each row to each cluster it shares anything with, and to its own."""
    spark = pairs.sparkSession
    of = spark.createDataFrame(pa.table({"y": np.arange(len(label)), "c": label}))
    size = of.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "sim").select("p.x", "p.y", "sim")
    self = of.select(F.col("y").alias("x"), "c", F.lit(0.0).alias("sim"))
    sums = ways.join(of, "y").select("x", "c", "sim").unionByName(self).groupBy("x", "c").agg(F.sum("sim").alias("sim"))
    return sums.join(size, "c").join(of.select(F.col("y").alias("x"), F.col("c").alias("own")), "x")


def mean_silhouette(pairs: DataFrame, label: np.ndarray) -> float:
    """Mean silhouette width of distances 1 - sim; rows alone in a cluster count 0."""
    mine = F.col("c") == F.col("own")
    each = _sums(pairs, label).groupBy("x").agg(
        F.max(F.when(mine & (F.col("size") > 1), 1 - F.col("sim") / (F.col("size") - 1))).alias("inner"),
        F.coalesce(F.min(F.when(~mine, 1 - F.col("sim") / F.col("size"))), F.lit(1.0)).alias("outer"),
    )
    width = (F.col("outer") - F.col("inner")) / F.greatest("outer", "inner", F.lit(1e-300))
    return each.agg(F.avg(F.coalesce(width, F.lit(0.0)))).first()[0]


def cluster_kmers(kmers: DataFrame, k: int = 4, n_clusters: int | None = None, max_clusters: int | None = None, directional: bool = True, drop_short: bool = False) -> DataFrame:
    """``(cluster, kmer)``: average-linkage clusters named by their most central member.

    Without ``n_clusters`` their number is the one with the best mean silhouette. K-mers shorter than ``k`` have no grams: distance 1 from all others
    (``drop_short`` leaves them out). Up to three k-mers need ``n_clusters``. No pair is written: tasks make the similarities of their rows to all from the
    profiles, which each of them reads whole, and the driver has some numbers for each k-mer.
    """
    distinct = kmers.where("kmer is not null" + (f" and length(kmer) >= {k}" if drop_short else "")).select("kmer").distinct()
    names = cut(ordered(distinct, ["kmer"]).select(F.col("pos").alias("x"), "kmer"))
    n = names.count()
    if n <= 3 and (n_clusters is None or n_clusters > 3):
        raise ValueError("up to three k-mers need a number of clusters of at most three")
    if not n:
        return names.select(F.col("kmer").alias("cluster"), "kmer")
    spark = kmers.sparkSession
    profile = grams(names, k, directional).groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("gram", "n"))).alias("p"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    profiles = cut(names.join(profile, "kmer", "left").select("x", empty(F.col("p.gram"), "string").alias("grams"), empty(F.col("p.n"), "bigint").alias("counts")))
    uri = dendrogram.written(profiles)
    same = np.arange(n)
    for r in profiles.groupBy("grams", "counts").agg(F.sort_array(F.collect_list("x")).alias("rows"), F.count(F.lit(1)).alias("n")).where("n > 1 and size(grams) > 0").select("rows").collect():
        same[r.rows] = r.rows[0]
    joins, least = dendrogram.linkage(spark, uri, same)
    # Profiles that share no gram have distance 1, which is the smallest above 0 if no others differ.
    equal = (1.0 if least is None else least) / 2 if least is not None or (same != same[0]).any() else 0.0
    tree = dendrogram.Tree(joins, n, same, equal)
    if n_clusters is None:
        seen: dict[int, float] = {}

        def widths(c: list[int]) -> list[float]:
            """Once a grid spans few enough numbers, all between are judged in the same pass: the finer grids are among them."""
            if not seen.keys() >= {*c}:
                every = list(range(min(c), max(c) + 1)) if max(c) - min(c) < dendrogram.JUDGED else c
                seen.update(zip(every, dendrogram.silhouettes(spark, uri, tree, every)))
            return [seen[x] for x in c]

        n_clusters = integral_optimum(widths, 2, min(n - 1, max_clusters or n - 1))
    inside = cut(dendrogram.inside(spark, uri, tree, min(n_clusters, n)))
    heads = inside.groupBy("c").agg(F.min_by("x", F.struct(F.round(-F.col("sim") / F.col("size"), 12), "x")).alias("head"))
    named = heads.join(names.select(F.col("x").alias("head"), F.col("kmer").alias("cluster")), "head").select("c", "cluster")
    return inside.select("x", "c").join(named, "c").join(names, "x").select("cluster", "kmer")


def orient(kmers: DataFrame, representative: str, k: int = 4) -> DataFrame:
    """``(kmer, oriented)``: the reverse complement where its k-gram product with the representative is larger."""
    spark = kmers.sparkSession
    base = kmers.select("kmer").distinct()
    rep = grams(spark.createDataFrame([(representative,)], "kmer string"), k, True).select("gram", F.col("n").alias("m"))
    product = lambda g, name: g.join(F.broadcast(rep), "gram").groupBy("kmer").agg(F.sum(F.col("n") * F.col("m")).alias(name))
    turned = base.select("kmer", reverse_complement("kmer").alias("rc"))
    forward = product(grams(base, k, True), "f")
    back = product(grams(turned.select(F.col("rc").alias("kmer")), k, True), "r").withColumnRenamed("kmer", "rc")
    both = turned.join(forward, "kmer", "left").join(back, "rc", "left")
    return both.select("kmer", F.when(F.coalesce("r", F.lit(0)) > F.coalesce("f", F.lit(0)), F.col("rc")).otherwise(F.col("kmer")).alias("oriented"))


def position_counts(aligned: DataFrame) -> DataFrame:
    """``(pos, A, C, G, T)``: base counts by column of equally long or gapped motifs; positions from 0."""
    rows = aligned.select(F.posexplode(F.split("kmer", "")).alias("pos", "base")).where("base <> ''")
    return rows.groupBy("pos").pivot("base", ["A", "C", "G", "T"]).count().fillna(0)


def best_offsets(kmers: DataFrame, representative: str) -> DataFrame:
    """``(kmer, aligned)``: each motif without gaps at the offset of most agreeing letters, padded with ``-`` to one width. A simple stand-in for a multiple alignment."""
    rep = F.lit(representative)
    n = F.length("kmer")
    tries = kmers.select("kmer").distinct().withColumn("o", F.explode(F.sequence(-(n - 1), F.lit(len(representative) - 1))))
    same = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, p: a + F.when((p + F.col("o") >= 1) & (F.col("kmer").substr(p, F.lit(1)) == F.substr(rep, p + F.col("o"), F.lit(1))), 1).otherwise(0))
    best = tries.groupBy("kmer").agg(F.min_by("o", F.struct(-same, F.abs("o"), "o")).alias("o"))
    low, high = best.agg(F.min("o"), F.max(F.col("o") + F.length("kmer"))).first()
    if low is None:
        return best.select("kmer", F.col("kmer").alias("aligned"))
    low, high = min(low, 0), max(high, len(representative))
    left = F.repeat(F.lit("-"), (F.col("o") - low).cast("int"))
    return best.select("kmer", F.rpad(F.concat(left, "kmer"), high - low, "-").alias("aligned"))
