"""Clusters of motifs against joining one pair at a time."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandwise.operators import clustering, dendrogram


def _greedy(kmers, k, directional):
    """Joins of the closest pair by (mean distance to 12 digits, a, b), one at a time, and the distances."""
    names, turn = sorted(kmers), str.maketrans("ACGT", "TGCA")
    gram = lambda g: g if directional else min(g, g[::-1].translate(turn))
    profiles = [Counter(gram(m[p : p + k]) for p in range(len(m) - k + 1)) for m in names]
    grams_ = sorted(set().union(*profiles))
    x = np.array([[p[g] for g in grams_] for p in profiles], float)
    dot, norm = x @ x.T, (x * x).sum(1)
    d = 1 - dot / np.maximum(norm[:, None] + norm[None, :] - dot, 1)
    d[d < 1e-12] = d[d > 1e-12].min() / 2
    np.fill_diagonal(d, 0)
    n = len(names)
    sims, w, joins = 1 - d, np.ones(n), []
    np.fill_diagonal(sims, 0)
    upper = np.triu(np.ones((n, n), bool), 1)
    alive = upper.copy()
    for _ in range(n - 1):
        far = np.where(alive, np.round(1 - sims / np.outer(w, w), 12), np.inf)
        a, b = divmod(int(np.argmin(far)), n)
        joins.append((a, b))
        sims[a] += sims[b]
        sims[:, a] = sims[a]
        w[a] += w[b]
        alive[b] = alive[:, b] = False
    return names, d, joins


@pytest.mark.parametrize("directional", [True, False])
def test_dendrogram_against_one_pair_at_a_time(spark, monkeypatch, directional):
    """Tied distances, equal profiles and k-mers without grams; rounds in tasks down to 16 clusters, and the last ones in one task."""
    rng = random.Random(3)
    kmers = {"".join(rng.choice("ACGT") for _ in range(rng.randrange(5, 10))) for _ in range(80)} | {"AC", "A", "AAAAA", "AAAA", "ATATATAT", "TATATATA", "CATACT", "AGTATG"}
    names, d, joins = _greedy(kmers, 3, directional)
    n = len(names)
    monkeypatch.setattr(dendrogram, "LAST", 16)
    made = []
    whole = dendrogram.linkage
    monkeypatch.setattr(dendrogram, "linkage", lambda *a: made.append(whole(*a)) or made[-1])
    table = spark.createDataFrame([(m,) for m in kmers], "kmer string")
    cuts = [2, 3, 7, 20, 45, n - 2, n - 1]
    for c in cuts[2:4]:
        label = clustering.labels(joins, n, c)
        want = set()
        for head in set(label):
            mine = np.flatnonzero(label == head)
            best = mine[np.argmin(np.round(d[np.ix_(mine, mine)].mean(1), 12))]
            want |= {(names[best], names[m]) for m in mine}
        assert {tuple(r) for r in clustering.cluster_kmers(table, 3, n_clusters=c, directional=directional).collect()} == want
    for c in range(1, n + 1):
        assert (clustering.labels(made[0][0], n, c) == clustering.labels(joins, n, c)).all()
    seen = {}
    whole_silhouettes = dendrogram.silhouettes
    monkeypatch.setattr(dendrogram, "silhouettes", lambda s, u, t, c: seen.update(zip(cuts, whole_silhouettes(s, u, t, cuts))) or whole_silhouettes(s, u, t, c))
    chosen = len({r.cluster for r in clustering.cluster_kmers(table, 3, directional=directional).collect()})
    width = lambda c: clustering.silhouette(d, np.unique(clustering.labels(joins, n, c), return_inverse=True)[1])
    assert seen == pytest.approx({c: width(c) for c in cuts})
    assert chosen == clustering.integral_optimum(lambda cs: [round(width(c), 12) for c in cs], 2, n - 1)


def test_clusters_take_few_jobs(spark):
    """Before, every round of the linkage and every number of clusters ran jobs of their own over all pairs, hundreds in all."""
    rng = random.Random(4)
    kmers = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(9)),) for _ in range(150)], "kmer string")
    spark.sparkContext.setJobGroup("clusters", "")
    clustering.cluster_kmers(kmers, 3, directional=False).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("clusters"))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs < 60


def test_profiles_of_many_grams(spark, tmp_path, monkeypatch):
    """Tables of the grams at hand give the same as one of all, and clusters larger than a block the same sums."""
    rng = random.Random(6)
    rows = [(x, *zip(*sorted(Counter(rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 9))).items()))) if x % 7 else (x, [], []) for x in range(60)]
    spark.createDataFrame(rows, "x long, grams array<string>, counts array<long>").write.parquet(str(tmp_path / "p"))
    one = dendrogram.Profiles(f"file://{tmp_path}/p")
    order = np.array(random.Random(7).sample(range(60), 60))
    starts = np.array([0, 1, 2, 30, 33, 60])
    want = one.similar(order, order)
    member = np.repeat(np.eye(5), np.diff(starts), 0)
    sums = member.T @ want @ member
    np.fill_diagonal(sums, 0)
    monkeypatch.setattr(dendrogram, "DENSE", 0)
    monkeypatch.setattr(dendrogram, "CELLS", 100)
    other = dendrogram.Profiles(f"file://{tmp_path}/p")
    assert other.dense is None and np.array_equal(other.similar(order, order), want)
    for profiles in (one, other):
        assert dendrogram._sums(profiles, order, starts, np.arange(5)) == pytest.approx(sums)
        assert all(dendrogram._sums(profiles, order, starts, np.array([c]))[:, 0] == pytest.approx(sums[:, c]) for c in range(5))
    for tasks in (1, 3, 7):
        parts = [p for t in range(tasks) for p in dendrogram._parts(np.diff(starts), t, tasks, 5)]
        assert [c for low, high in parts for c in range(low, high)] == list(range(5))


def test_clusters_of_alike_and_of_short(spark):
    """No grams at all, one k-mer, and profiles that are all equal."""
    found = lambda kmers, **more: sorted(tuple(r) for r in clustering.cluster_kmers(spark.createDataFrame([(m,) for m in kmers], "kmer string"), 3, directional=False, **more).collect())
    assert found(["A", "C", "AC", "GT", "TT"]) == [("A", "A"), ("A", "AC"), ("A", "C"), ("A", "GT"), ("TT", "TT")]
    assert found(["A"], n_clusters=1) == [("A", "A")]
    assert found(["acg", "ACG", "Acg", "aCG"]) == [("ACG", "ACG"), ("ACG", "Acg"), ("ACG", "aCG"), ("acg", "acg")]
    assert found(["ACG", "CGT", "A"], n_clusters=2) == [("A", "A"), ("ACG", "ACG"), ("ACG", "CGT")]


def test_silhouettes_of_all_cuts_in_one_pass(spark, monkeypatch):
    """Before, each finer grid of cluster numbers took a pass of its own. Parts are small here, so clusters are larger than some of them."""
    rng = random.Random(8)
    kmers = {"".join(rng.choice("ACGT") for _ in range(rng.randrange(4, 9))) for _ in range(90)} | {"AC", "AAAAA", "AAAA", "CATACT", "AGTATG"}
    names, d, joins = _greedy(kmers, 3, False)
    n, asked = len(names), []
    monkeypatch.setattr(dendrogram, "DOWN", 8)
    monkeypatch.setattr(dendrogram, "ACROSS", 16)
    monkeypatch.setattr(dendrogram, "LAST", 16)
    whole = dendrogram.silhouettes
    monkeypatch.setattr(dendrogram, "silhouettes", lambda s, u, t, c: asked.append((c, whole(s, u, t, c))) or asked[-1][1])
    table = spark.createDataFrame([(m,) for m in kmers], "kmer string")
    width = [clustering.silhouette(d, np.unique(clustering.labels(joins, n, c), return_inverse=True)[1]) for c in range(2, n)]
    chosen = len({r.cluster for r in clustering.cluster_kmers(table, 3, directional=False).collect()})
    assert [c for c, _ in asked] == [list(range(2, n))]
    assert asked[0][1] == pytest.approx(width)
    assert chosen == clustering.integral_optimum(lambda cs: [round(width[c - 2], 12) for c in cs], 2, n - 1)


def test_nearest_clusters_in_pieces(tmp_path, monkeypatch):
    """Before, the sums of some clusters to all were held at once."""
    rng = random.Random(9)
    rows = [sorted(Counter(rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 7))).items()) for _ in range(70)]
    pq.write_table(pa.table({"x": range(70), "grams": pa.array([[g for g, _ in r] for r in rows], pa.list_(pa.string())), "counts": pa.array([[n for _, n in r] for r in rows], pa.list_(pa.int64()))}), tmp_path / "p")
    profiles = dendrogram.Profiles(f"file://{tmp_path}/p")
    order = np.array(rng.sample(range(70), 70))
    starts = np.array([0, 1, 2, 4, 5, 31, *range(32, 60), 63, 70])
    sizes = np.diff(starts)
    monkeypatch.setattr(dendrogram, "DOWN", 8)
    member, sims = np.repeat(np.eye(len(sizes)), sizes, 0), profiles.similar(order, order)
    sums = member.T @ sims @ member
    np.fill_diagonal(sums, 0)
    pieces = dendrogram._pieces(order, starts)
    for some in (np.arange(len(sizes)), np.array([4]), np.array([0, 2, 33])):
        near, far = dendrogram._nearest_of(profiles, pieces, order, starts, some)
        want, low = dendrogram._nearest(sums[:, some], sizes, sizes[some])
        assert (near == want).all() and far == pytest.approx(low)
