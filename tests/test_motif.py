import gzip
import hashlib
import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise import sinks, sources
from strandwise.operators import clustering, filters, motifs, peaks, permutation, smoothing, suffixes, text
from strandwise.operators.ordering import ordered
from strandwise.operators.smoothing import gini_counts
from strandwise.plans import motif as plans
from strandwise.runtime import cut


def made(seed=3, n=30, length=60, plant="CATACTGAGA"):
    """Random sequences; the last third has a planted motif and score 1."""
    rng = random.Random(seed)
    seqs, scores = {}, {}
    for k in range(n):
        s = "".join(rng.choice("ACGT") for _ in range(length))
        if k >= 2 * n // 3:
            at = rng.randrange(length - len(plant))
            s = s[:at] + plant + s[at + len(plant) :]
        seqs[str(k)], scores[str(k)] = s, float(k >= 2 * n // 3)
    seqs["e"], scores["e"] = "", 0.0
    seqs["d1"] = seqs["d2"] = "ACACACACAC" * 20
    scores["d1"] = scores["d2"] = 0.0
    return seqs, scores


@pytest.fixture(scope="module")
def world(spark):
    seqs, scores = made()
    s, y = sources.from_rows(spark, seqs | {"no score": "AC"}, scores | {"no seq": 1.0})
    b = cut(text.align(s, y))
    sx = cut(suffixes.suffix_order(b, 1))
    names = sorted(seqs)
    whole = "".join(seqs[k] + "$" for k in names)
    block = [n for n, k in enumerate(names) for _ in range(len(seqs[k]) + 1)]
    order = sorted(range(len(whole)), key=lambda p: whole[p:])
    return spark, seqs, scores, names, whole, block, order, b, sx


def test_align(world):
    _, seqs, scores, names, whole, block, _, b, _ = world
    rows = b.orderBy("b").collect()
    assert [r.seq_id for r in rows] == names and [r.offset for r in rows] == [block.index(k) for k in range(len(names))]


def test_order(world):
    _, _, _, _, whole, block, order, b, sx = world
    rows = sx.orderBy("i").collect()
    assert [r.s for r in rows] == order and [r.i for r in rows] == list(range(len(whole)))
    assert all(r.b == block[r.s] for r in rows)
    places = sx.select("s").where("s % 7 = 0")
    assert all(r.b == block[r.s] for r in text.source_block(places, b).collect())
    assert all(r.kmer == whole[r.s : r.s + 9] for r in text.text_at(places, b, "s", F.lit(9)).collect())


def test_find(world):
    spark, _, _, _, whole, _, order, b, sx = world
    words = ["", "CAT", "ACACACAC", "A$", "$", "GGGGGGGG", "zz", "AC" * 33, "AC" * 100, "AC" * 100 + "$" + "AC" * 70, whole[7:407], whole[-90:], "AC" * 101]
    found = {r.kmer: (r.i_from, r.i_to) for r in suffixes.find_kmer(b, sx, spark.createDataFrame([(w,) for w in words], "kmer string")).collect()}
    for w in words:
        hits = [i for i, s in enumerate(order) if whole[s:].startswith(w)]
        assert found.get(w) == ((hits[0], hits[-1] + 1) if hits else None)


def smoothed_by_hand(world, half):
    _, _, scores, names, whole, block, order, _, _ = world
    n, y, g = len(whole), [], []
    for i in range(n):
        c = min(max(i, half), n - 1 - half)
        near = [block[order[j]] for j in range(c - half, c + half + 1)]
        y.append(sum(scores[names[b]] for b in near) / len(near))
        g.append(1 - sum((near.count(b) / len(near)) ** 2 for b in set(near)))
    return y, g


@pytest.mark.parametrize("rows", [64, 1 << 16])
def test_smoothing(world, rows):
    _, _, _, _, whole, _, order, b, sx = world
    n, half, length = len(whole), 4, 3
    y, g = smoothed_by_hand(world, half)
    sm = smoothing.smooth(sx.join(b.select("b", "score"), "b"), half, n, rows)
    wide = smoothing.smooth_spatial(sm, length, n, rows).orderBy("i").collect()
    assert [r.windowed for r in wide] == pytest.approx(y, abs=1e-6) and [r.gini for r in wide] == pytest.approx(g, abs=1e-6)
    at = {s: i for i, s in enumerate(order)}
    for r in wide:
        s = min(r.s, n - length)
        assert r.spatial_windowed == pytest.approx(sum(y[at[s + k]] for k in range(length)) / length, abs=1e-6)
    assert filters.median_gini(sm) == pytest.approx(statistics.median(g), abs=1e-6)


def test_gini_counts_by_hand():
    import numpy as np

    rng = np.random.default_rng(1)
    b = rng.integers(0, 5, 80)
    for half in (0, 1, 7):
        want = [sum(int((b[i - half : i + half + 1] == x).sum()) ** 2 for x in range(5)) for i in range(half, 80 - half)]
        assert gini_counts(b, half, 80 - half, half).tolist() == want


def test_gini_impurity(spark):
    rows = spark.createDataFrame([([1, 1, 2],), ([5],), ([],), (None,)], "n array<int>")
    assert [r.g for r in rows.select(smoothing.gini_impurity("n").alias("g")).collect()] == [0.625, 0.0, 0.0, 0.0]


def test_peaks_and_merge(world):
    spark, _, _, _, whole, _, order, b, sx = world
    y, g = smoothed_by_hand(world, 4)
    n, at = len(whole), {s: i for i, s in enumerate(order)}
    gmin = 1 - (1 - statistics.median(g)) * 1.1
    grid = filters.parameter_grid(spark, [4], [0], [1.1])
    limits = spark.createDataFrame([(0, 0.8, None)], "f int, theta float, spatial_theta float")
    near = lambda i, d: y[at[order[i] + d]] if 0 <= order[i] + d < n else y[i]
    want = [i for i in range(n) if y[i] >= 0.8 - 1e-9 and g[i] >= gmin - 1e-7 and near(i, -1) <= y[i] + 1e-7 and near(i, 1) <= y[i] + 1e-7]
    table = peaks.kmer_peaks(sx, b, grid, limits).orderBy("i").collect()
    assert [r.i for r in table] == want and want

    def common(p, q):
        k = 0
        while k < 12 and p + k < n and q + k < n and whole[p + k] == whole[q + k]:
            k += 1
        return k

    khat = {r.i: sum(common(r.s, order[j]) for j in range(max(0, r.i - 4), min(n, r.i + 5)) if j != r.i) / 8 for r in table}
    assert all(r.khat == pytest.approx(khat[r.i]) and r.kmer == whole[r.s : r.s + int(khat[r.i] + 0.5)] for r in table)
    runs, ends = [], {}
    for s, i in sorted((r.s, r.i) for r in table):
        if not runs or s != runs[-1][1] + 1:
            runs.append([s, s])
        runs[-1][1] = s
        ends[runs[-1][0]] = max(ends.get(runs[-1][0], 0), s + int(khat[i] + 0.5))
    merged = peaks.merged_sub_peaks(sx, b, grid, limits)
    assert sorted((r.s, r.kmer) for r in merged.collect()) == [(s, whole[s : ends[s]]) for s, _ in runs]
    longer = motifs.extend_kmers(merged, b, sx).collect()
    assert all(whole[r.s :].startswith(r.kmer) and order[r.i] == r.s for r in longer)
    assert len(peaks.block_info(sx, b, spark.createDataFrame([("0",), ("e",)], "seq_id string"), grid).collect()) == 62


def test_extend_without_a_limit(world):
    spark, _, _, _, whole, _, _, b, sx = world
    order = {r.s: r.i for r in sx.collect()}
    runs = [(m.start(), m.end()) for m in re.finditer("(?:AC){50,}", whole)]
    (s1, e1), (s2, _) = runs  # 200 letters each
    rows = [(s1 + 3, whole[s1 + 3 : s1 + 9]), (s1, whole[s1 : s1 + 150]), (s2 + 60, whole[s2 + 60 : s2 + 90]), (5, whole[5:9]), (3, whole[3:12]), (700, whole[700:703]), (e1 - 2, whole[e1 - 2 : e1 + 2])]
    df = spark.createDataFrame([(order[s], s, k, "x", s) for s, k in rows], "i long, s long, kmer string, block string, wi int")
    got = sorted((r.s, r.kmer, r.i, r.wi) for r in motifs.extend_kmers(df, b, sx).collect())
    texts = {k for _, k in rows}
    want = []
    for s, k in rows:
        around = [(-len(t), at, t) for t in texts for at in range(max(0, s + len(k) - len(t)), s + 1) if whole.startswith(t, at)]
        _, at, t = min(around)
        want.append((at, t, order[at], at))
    assert got == sorted(want) and sum(len(t) == 150 for _, t, _, _ in got) == 3


def test_order_of_equal_letters(spark):
    """A hundred thousand equal letters: equal keys fill several tasks, and every tie is solved."""
    b = cut(text.align(*sources.from_rows(spark, {"a": "A" * 100_000, "b": "C" + "A" * 700, "c": ""}, {"a": 1, "b": 2, "c": 3})))
    whole = "A" * 100_000 + "$C" + "A" * 700 + "$$"
    got = [r.s for r in suffixes.suffix_order(b).orderBy("i").collect()]
    # Runs of A end in $C or in $$: the shorter run of two comes first, and of equal ones that before $$.
    left = {s: (0, 100_000 - s, 1) for s in range(100_000)} | {100_002 + k: (0, 700 - k, 0) for k in range(700)}
    want = sorted(left, key=lambda s: (left[s][1], left[s][2]))
    assert got == [100_703, 100_702, 100_000, *want, 100_001] and len(got) == len(whole)


def test_total_order_over_tasks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x"] * 8 + ["a", "z", None]), k) for k in range(2_000)]
    got = ordered(spark.createDataFrame(rows, "k string, u long"), ["k"], ["u"]).orderBy("pos").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    keys = [r[0] for r in want]
    assert [(r.k, r.u) for r in got] == want and [r.pos for r in got] == list(range(2_000))
    assert [r.first for r in got] == [keys.index(k) for k in keys] and all(r.tied == (keys.count(r.k) > 1) for r in got)
    lone = ordered(spark.createDataFrame([(k,) for k in range(300)], "k long"), ["k"]).collect()
    assert not any(r.tied for r in lone) and ordered(spark.createDataFrame([], "k long"), ["k"]).count() == 0


def test_text_of_any_length(world):
    _, _, _, _, whole, _, _, b, sx = world
    places = sx.select("s").where("s % 50 = 0")
    for k, from_ in ((200, -30), (90, 0), (5, -5), (0, -100)):
        assert all(r.kmer == whole[max(0, r.s + from_) : r.s + k] for r in text.text_at(places, b, "s", k, from_=from_).collect())
    rows = text.text_at(places.withColumn("n", (F.col("s") % 400).cast("int")), b, "s", F.col("n"), "t").collect()
    assert len(rows) == places.count() and all(r.t == whole[r.s : r.s + r.n] for r in rows)


def test_permutations(world):
    spark, _, scores, _, whole, _, _, b, sx = world
    grid = filters.parameter_grid(spark, [4], [0, 3], [1.1])
    perms = cut(permutation.permutations(b, 3, 5))
    for r in perms.groupBy("rep").agg(F.count("b").alias("n"), F.countDistinct("b").alias("d"), F.sum("score").alias("s")).collect():
        assert (r.n, r.d, r.s) == (len(scores), len(scores), sum(scores.values()))
    dist = cut(permutation.permutation_distribution(sx, b, grid, perms, 3, rows=100))
    assert dist.count() == 6
    gini = smoothing.smooth(sx.join(b.select("b", "score"), "b"), 4, len(whole))
    low = filters.relative_gini(filters.median_gini(gini), 1.1)
    for rep in range(3):
        dealt = perms.where(F.col("rep") == rep).select("b", "score")
        sm = smoothing.smooth(sx.join(dealt, "b"), 4, len(whole))
        assert dist.where((F.col("f") == 0) & (F.col("rep") == rep)).first().max_windowed == pytest.approx(sm.where(F.col("gini") >= low).agg(F.max("windowed")).first()[0])
    limits = permutation.thresholds(dist, 1.0).orderBy("f").collect()
    assert limits[0].theta is not None and limits[1].theta is None and limits[1].spatial_theta is not None
    rate, null = permutation.estimate_false_positive_rate(sx, b, grid, permutation.thresholds(dist, 1.0), 5, 6)
    assert rate.first().n == 5 and 0 <= rate.first().fp <= 5 and null.count() == 10
    md5 = lambda rep, k: hashlib.md5(f"5:{rep}:{k}".encode()).hexdigest()
    score = {r.b: r.score for r in b.collect()}
    want = {(rep, k): score[p] for rep in range(3) for p, k in enumerate(sorted(score, key=lambda k: md5(rep, k)))}
    assert {(r.rep, r.b): r.score for r in perms.collect()} == want
    # Repetitions in several passes.
    permutation.REPS_AT_ONCE, before = 2, permutation.REPS_AT_ONCE
    again = permutation.permutation_distribution(sx, b, grid, perms, 3)
    permutation.REPS_AT_ONCE = before
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, dist.collect()))
    wide = smoothing.smooth_spatial(gini, 3, len(whole))
    dealt = smoothing.smooth_spatial(smoothing.smooth(sx.join(perms.where("rep = 1").select("b", "score"), "b"), 4, len(whole)), 3, len(whole)).select("i", F.col("spatial_windowed").alias("y"))
    ok = wide.where((F.col("gini") >= low) & (F.col("spatial_gini") >= low)).join(dealt, "i")
    assert dist.where("f = 1 and rep = 1").first().max_spatial == pytest.approx(ok.agg(F.max("y")).first()[0])


def test_java_shuffles():
    first = permutation.java_permutations(1, 30, 123)[0]
    assert first == [5, 22, 24, 0, 13, 16, 3, 12, 11, 17, 23, 6, 15, 10, 9, 28, 14, 29, 26, 21, 1, 25, 4, 18, 7, 19, 8, 20, 27, 2]


def test_binomial_interval():
    assert permutation.binomial_interval(5, 250) == pytest.approx((0.0065251, 0.0460536), abs=1e-6)
    assert permutation.binomial_interval(0, 100)[1] == pytest.approx(0.036217, abs=1e-5)


def test_motif_tables(spark):
    seqs = spark.createDataFrame([("a", "AAAACATACTGAGAaaaa"), ("b", ""), ("c", None)], "seq_id string, seq string")
    n = {(r.seq_id, r.regex): r.n for r in motifs.regex_counts(seqs, ["AA"]).collect()}
    assert n == {("a", "AA"): 4, ("b", "AA"): 0, ("c", "AA"): 0}
    assert motifs.regex_counts(seqs, ["AA"], overlap=True).where("seq_id = 'a'").first().n == 7
    assert motifs.kmer_counts(seqs, ["TCTC"], directional=False).where("seq_id = 'a'").first().n == 1
    assert motifs.kmer_counts(seqs, ["TCTCA"], directional=False).where("seq_id = 'a'").first().n == 1
    found = motifs.locate_kmers(seqs, ["TCTCA", "aaa"], directional=False, show_match=True).collect()
    assert sorted((r.kmer, r.location, r.match) for r in found) == [("TCTCA", 10, "TGAGA"), ("aaa", 1, "AAA"), ("aaa", 14, "AAA")]
    longest = motifs.regex_locate(seqs, ["(?:CAT|CATAC)(?:T|TGA)?"], show_match=True).collect()
    assert [(r.location, r.match) for r in longest] == [(5, "CATACTGA")]
    rows = spark.createDataFrame([(1, 0, "ACGTA"), (2, 1, "CG"), (3, 0, "ACGTA"), (4, 4, "AC"), (5, 400, "A" * 300), (6, 690, "AAA")], "i int, s int, kmer string")
    assert sorted(r.i for r in motifs.prune_intervals(rows).collect()) == [1, 4, 5]
    assert sorted(r.kmer for r in motifs.extract_kmers(rows.where("i in (1, 4)")).collect()) == ["AC", "ACGTA"]


def test_clusters(spark):
    kmers = spark.createDataFrame([(k,) for k in ["CATACTGA", "ATACTGAG", "TACTGAGA", "GGGGCCCC", "GGGCCCCA", "TTTTTTAA", "TTTTTAAC", "AC"]], "kmer string")
    groups = {}
    for r in clustering.cluster_kmers(kmers, 4, n_clusters=4).collect():
        groups.setdefault(r.cluster, set()).add(r.kmer)
    assert sorted(map(sorted, groups.values())) == [["AC"], ["ATACTGAG", "CATACTGA", "TACTGAGA"], ["GGGCCCCA", "GGGGCCCC"], ["TTTTTAAC", "TTTTTTAA"]]
    assert clustering.cluster_kmers(kmers, 4).count() == 8
    turned = {r.kmer: r.oriented for r in clustering.orient(kmers.where("kmer = 'CATACTGA'"), "TCAGTATG", 4).collect()}
    assert turned == {"CATACTGA": "TCAGTATG"}
    assert "Cluster 1: " in sinks.cluster_text(clustering.cluster_kmers(kmers, 4, n_clusters=4))
    with pytest.raises(ValueError):
        clustering.cluster_kmers(kmers.limit(2), 4)


@pytest.fixture(scope="module")
def rare(spark, tmp_path_factory):
    """Peaks of 700 motifs in 700 blocks of their own: none is in one block of a hundred."""
    rng = random.Random(8)
    motifs_ = sorted({"".join(rng.choice("ACGT") for _ in range(rng.randrange(2, 12))) for _ in range(800)})[:700]
    d = str(tmp_path_factory.mktemp("rare"))
    spark.createDataFrame([(m.lower() + " ", f"b{k}") for k, m in enumerate(motifs_)] + [("ACGN", "b0"), ("GATTACAGATTACA", None)], "kmer string, block string").write.parquet(f"{d}/peaks.parquet")
    return d, motifs_


def test_every_motif_is_compared(spark, rare):
    d, all_ = rare
    assert {r.kmer for r in plans.k_orient(spark, d).collect()} == {r.kmer for r in plans.k_aligned(spark, d).collect()} == set(all_)
    assert sum(sum(r[1:]) for r in plans.k_position_counts(spark, d).collect()) == sum(map(len, all_))
    profiles = {m: Counter(m[p : p + 3] for p in range(len(m) - 2)) for m in all_}
    want = {}
    for i, a in enumerate(all_):
        for b in all_[i + 1 :]:
            dot = sum(n * profiles[b][g] for g, n in profiles[a].items())
            if dot:
                want[a, b] = 1 - dot / (sum(n * n for n in profiles[a].values()) + sum(n * n for n in profiles[b].values()) - dot)
    kmers = spark.createDataFrame([(m,) for m in all_], "kmer string")
    got = clustering.distances(kmers, 3).collect()
    assert len(got) == len(want) and all(r.distance == pytest.approx(want[r.a, r.b], abs=1e-6) for r in got)
    for at_most in (0.0, 0.3, 0.6, 0.9):
        near = {(r.a, r.b): r.distance for r in clustering.near_distances(kmers, 3, at_most=at_most).collect()}
        assert near == pytest.approx({p: x for p, x in want.items() if x <= at_most + 1e-9}, abs=1e-9)


def test_linkage_against_one_pair_at_a_time(spark):
    rng = np.random.default_rng(5)
    n = 24
    d = np.ones((n, n))
    np.fill_diagonal(d, 0)
    rows = []
    for a in range(n):
        for b in range(a + 1, n):
            if rng.random() < 0.4:
                rows.append((a, b, float(rng.integers(1, 2**20)) / 2**20))
                d[a, b] = d[b, a] = 1 - rows[-1][2]
    pairs = spark.createDataFrame(rows, "a long, b long, sim double")
    joins = clustering.linkage(pairs, n)
    for c in (1, 2, 5, 11, n):
        label = clustering.labels(joins, n, c)
        want = clustering.average_linkage(d, c)
        assert (np.unique(label, return_inverse=True)[1] == want).all()
        if c == 5:
            assert clustering.mean_silhouette(pairs, label) == pytest.approx(clustering.silhouette(d, want))


def test_files(spark, tmp_path):
    (tmp_path / "s.fa").write_text("junk\n>a b\nACG\nT\n>c\n>d>e\nGG\r\n>a b\nTTT\n")
    rows = {r.seq_id: r.seq for r in sources.read_fasta(spark, str(tmp_path / "s.fa")).collect()}
    assert rows == {"a b": "TTT", "c": "", "d>e": "GG"}
    with gzip.open(tmp_path / "s.gzip", "wb") as f:
        f.write((tmp_path / "s.fa").read_bytes())
    assert {r.seq_id: r.seq for r in sources.read_fasta(spark, str(tmp_path / "s.gzip")).collect()} == rows
    (tmp_path / "y.tsv").write_text("b\ty\na\t1\na\t2.5\nlone\nc\tx\n")
    assert [tuple(r) for r in sources.read_scores(spark, str(tmp_path / "y.tsv")).collect()] == [("a", 2.5)]
    grid = filters.parameter_grid(spark, [4, 8], [0, 3], [1.1])
    limits = spark.createDataFrame([(f, 0.5 if f % 2 == 0 else None, None if f % 2 == 0 else 0.25) for f in range(4)], "f int, theta float, spatial_theta float")
    sinks.write_thresholds(limits, grid, f"{tmp_path}/out/")
    back = sources.read_thresholds(spark, f"{tmp_path}/out/theta.tsv").orderBy("f").collect()
    assert [(r.half_window, r.spatial_length, r.theta, r.spatial_theta) for r in back] == [(4, 0, 0.5, None), (4, 3, None, 0.25), (8, 0, 0.5, None), (8, 3, None, 0.25)]
    (tmp_path / "c.txt").write_text("Cluster 1: CATA\n-CATA\nAC TG-\n\nCluster 2: GG\nGG\n")
    assert sorted(tuple(r) for r in sources.read_clusters(spark, str(tmp_path / "c.txt")).collect()) == [("CATA+", "ACTG"), ("CATA+", "CATA"), ("GG+", "GG")]
    assert sorted(r.kmer for r in sources.read_kmers(spark, kmers="TTT,ACG\nAAA").collect()) == ["AAA", "ACG"]


def test_command_line(spark, tmp_path, capsys):
    from strandwise import cli

    seqs, scores = made(n=12, length=30)
    (tmp_path / "s.fa").write_text("".join(f">{k}\n{v}\n" for k, v in seqs.items()))
    (tmp_path / "y.tsv").write_text("b\ty\n" + "".join(f"{k}\t{v}\n" for k, v in scores.items()))
    files = ["-f", str(tmp_path / "s.fa"), "-s", str(tmp_path / "y.tsv")]
    cli.select(spark, cli.parser().parse_args(["select", *files, "-w", "3", "-r", "4", "-z", "0", "-o", str(tmp_path / "out")]))
    header = next((tmp_path / "out" / "peaks.tsv").glob("*.csv")).read_text().split("\n")[0].split("\t")
    assert header == peaks.COLUMNS and (tmp_path / "out" / "merged_peaks.tsv").exists()
    found, null = sources.read_selection(spark, str(tmp_path / "out"))
    assert null.count() == 4 and found.count() > 0
    fp = cli.test(spark, cli.parser().parse_args(["test", *files, "-i", str(tmp_path / "out"), "-r", "4", "-e", "9", "--interval"]))
    assert 0 <= fp <= 4
    best = cli.zrank(spark, cli.parser().parse_args(["zrank", "-i", str(tmp_path / "out")])).collect()
    assert len({r.kmer for r in best}) == len(best) == found.select("kmer").distinct().count()
    told = lambda *args: cli.count(spark, cli.parser().parse_args(["count", *files[:2], *args]))
    capsys.readouterr()
    assert told("-k", "CATACTGAGA").agg(F.sum("CATACTGAGA")).first()[0] >= 4
    assert len(capsys.readouterr().out.splitlines()) == len(seqs) + 1
    (tmp_path / "k.txt").write_text("AC\nGT\nTTT\n")
    assert told("-k", str(tmp_path / "k.txt")).columns == ["seq_id", "AAA", "AC"]
    assert told("-c", "ACAC,CACA", "-d").columns == ["seq_id", "ACAC,CACA"]
    capsys.readouterr()
    located = told("-k", "AC", "-d", "-l").count()
    assert located > 200 and len(capsys.readouterr().out.splitlines()) == located + 1


def test_tables_go_and_indexes_follow_their_files(spark, tmp_path):
    from strandwise import runtime

    df = spark.range(3)
    with runtime.scratch(spark):
        inside = runtime.cut(df).inputFiles()
    assert inside and not any(sources.exists(spark, f) for f in inside)
    path = str(tmp_path / "t")
    df.write.parquet(path)
    made = [runtime.kept("x", spark.read.parquet(path), lambda: n) for n in (1, 2)]
    spark.range(5).write.mode("overwrite").parquet(path)
    assert [*made, runtime.kept("x", spark.read.parquet(path), lambda: 3)] == [1, 1, 3]


def test_null_leaves_only_maxima(world):
    """Before, windowed means of every place and repetition were written and shuffled, and shuffle files stayed."""
    import glob

    from strandwise import runtime

    spark, _, _, _, whole, _, _, b, sx = world
    shuffled = lambda: set(glob.glob(spark.conf.get("spark.local.dir") + "/**/shuffle_*.data", recursive=True))
    perms = cut(permutation.permutations(b, 3, 5))
    before, files = set(runtime._WRITTEN), shuffled()
    cut(spark.range(1000).groupBy(F.col("id") % 7).count())
    assert shuffled() <= files
    dist = permutation.permutation_distribution(sx, b, filters.parameter_grid(spark, [4, 8], [0, 3, 5], [1.1]), perms, 3, rows=70)
    assert len(set(runtime._WRITTEN) - before) == 2 and dist.count() == 18
    # No full window, or no spatial one.
    short = permutation.permutation_distribution(sx, b, filters.parameter_grid(spark, [len(whole)], [0], [None]), perms, 3)
    assert [r.max_windowed for r in short.collect()] == [-np.inf] * 3
    flat = permutation.permutation_distribution(sx, b, filters.parameter_grid(spark, [4], [len(whole) + 1], [None]), perms, 3).collect()
    assert all(r.max_spatial is None and r.max_windowed > 0 for r in flat)


def test_vectors(spark, monkeypatch):
    from strandwise import runtime

    n = runtime.PIECE + 5
    vector = runtime.filed(spark.range(n).select("id", (F.col("id") * 3).alias("x")), "id", "x", n, "uint32")
    assert (vector.load() == np.arange(n) * 3).all()
    monkeypatch.setattr(runtime.fs, "LocalFileSystem", dict)  # a folder that isn't mounted
    for k in (0, 1):
        vector.put(k, np.arange(k * runtime.PIECE, min(n, (k + 1) * runtime.PIECE), dtype="uint32") * 5)
    assert (vector.load() == np.arange(n) * 5).all()


@pytest.mark.parametrize("rows", [64, 1 << 16])
def test_window_summaries(world, rows):
    """As by counting each window's rows; before, every row was shuffled once for each window it lies in."""
    _, _, _, _, whole, block, order, _, sx = world
    n, half = len(whole), 4
    found = smoothing.window_summaries(sx, half, n, rows)
    got = {r.centre: (r.n_blocks, r.most, r.gini) for r in found.collect()}
    of = [block[s] for s in order]
    want = {}
    for i in range(half, n - half):
        counts = Counter(of[i - half : i + half + 1])
        want[i] = len(counts), max(counts.values()), pytest.approx(1 - sum(c * c for c in counts.values()) / 81)
    assert got == want
    assert smoothing.window_summaries(sx, n, n).count() == 0


def test_zrank_of_equal_maxima(spark):
    """Before, a division by zero ended the query."""
    grid = filters.parameter_grid(spark, [4, 8, 9], [0], [1.1])
    null = spark.createDataFrame([(0, 0.5), (0, 0.5), (1, 0.0), (1, 1.0), (2, 0.5), (2, 0.5)], "f int, max_windowed float")
    found = spark.createDataFrame([("A", 4, 1.0), ("A", 8, 1.0), ("A", 9, 1.0), ("C", 4, 0.5), ("C", 8, 1.0), ("G", 4, 0.25), ("G", 8, 0.5)], "kmer string, half_window int, windowed float").withColumn("min_gini", F.lit(1.1))
    z = {(r.kmer, r.half_window): r.zmax for r in permutation.zrank(found, null, grid, False).collect()}
    assert z["A", 4] == np.inf and np.isnan(z["C", 4]) and z["G", 4] == -np.inf and z["A", 8] == pytest.approx(0.5**0.5) and z["G", 8] == 0
    assert {r.kmer: r.half_window for r in permutation.zrank(found, null, grid).collect()} == {"A": 4, "C": 4, "G": 8}


def test_profiles_of_a_hot_gram_travel_once(spark, monkeypatch):
    """2,000 profiles of one gram are one block; before they were four, and each profile shuffled four times."""
    dealt = []
    whole = clustering._dealt
    monkeypatch.setattr(clustering, "_dealt", lambda profiles, blocks: dealt.append(whole(profiles, blocks)) or dealt[-1])
    kmers = spark.createDataFrame([("AAAA" + "".join("CGT"[n // 3**k % 3] for k in range(7)),) for n in range(2000)], "kmer string")
    near = clustering.near_distances(kmers, 4, at_most=0.3)
    assert dealt[0].groupBy("_gram", "kmer").count().agg(F.max("count")).first()[0] == 1
    rows = near.collect()
    assert rows and len({(r.a, r.b) for r in rows}) == len(rows)
