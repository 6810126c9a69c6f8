"""Queries of the motif engine over the blocks, peaks and scores tables, with the same in SQL where SQL can say it."""

from pyspark.sql import functions as F

from strandwise import sinks, sources
from strandwise.operators import clustering, filters, motifs, peaks, permutation, smoothing, suffixes, text
from strandwise.runtime import bare, cut, fresh_path, kept, only
from strandwise.sources import table

HALF, LENGTH, THETA, KMAX, REPS, SEED, TEST_SEED, SIGMA = 4, 3, 0.8, 12, 100, 123, 321, 0.0
#: The grid of the queries from scores to peaks: two half windows, without and with spatial smoothing.
HALVES, LENGTHS = (4, 8), (0, 3)
PATTERNS = ["CATACTGAGA", "TACTGA", "AAAA", "ACGT", "TT[AC]G"]
MOTIFS = ["CATACTGAGA", "TACTGA", "ACGT", "AAAA", "GATTACA"]
#: Letters of the long k-mers that are looked for.
LONG = (65, 100, 400)
CLUSTERS = {"tata": ["TATAAA", "TATA", "TATATA"], "ctgag": ["CTGAG", "TGAGA", "ACTGA"]}


def _aligned(spark, d):
    rows = table(spark, d, "blocks")
    return text.align(rows.select("seq_id", F.col("catseq").alias("seq")), rows.select("seq_id", "score"))


def _stored(spark, d):
    """The blocks with the places they have in the given text."""
    return table(spark, d, "blocks").select("b", "seq_id", F.coalesce("catseq", F.lit("")).alias("seq"), "score", F.col("seq_offset").alias("offset"), F.length(F.coalesce("catseq", F.lit(""))).alias("len"))


def _seqs(spark, d):
    return table(spark, d, "blocks").select("seq_id", F.col("catseq").alias("seq"))


def _suffixes(spark, d):
    """Blocks and suffix order; the index doesn't depend on parameters, so all queries of a session share it."""

    def make():
        b = only(spark, lambda: _aligned(spark, d))
        return b, only(spark, lambda: suffixes.suffix_order(b))

    return kept("suffixes", table(spark, d, "blocks"), make)


def _smooth(b, sx, half):
    return smoothing.smooth(sx.join(b.select("b", "score"), "b"), half, sx.count())


def c_blocks(spark, d):
    return _aligned(spark, d).select("b", "seq_id", "score", "offset", "len")


def c_block_scores(spark, d):
    return text.block_scores(_aligned(spark, d))


def c_suffix_order(spark, d):
    return _suffixes(spark, d)[1]


def c_source_block(spark, d):
    rows = table(spark, d, "peaks").select("peak_id", "s").distinct()
    return text.source_block(rows, _stored(spark, d)).select("peak_id", "s", "b", "seq_id", "wi")


def c_source_score(spark, d):
    rows = table(spark, d, "peaks").select("peak_id", "s").distinct()
    return text.source_block(rows, _stored(spark, d)).select("peak_id", "s", F.col("score").alias("source_score"))


def c_rank_of_place(spark, d):
    """The suffix rank of each place that peaks name."""
    rows = table(spark, d, "peaks").select("peak_id", "s").distinct()
    return rows.join(_suffixes(spark, d)[1].select("s", "i"), "s").select("peak_id", "s", F.col("i").alias("rank"))


def c_place_of_rank(spark, d):
    """The place of each suffix rank that peaks name."""
    rows = table(spark, d, "peaks").select("peak_id", "i").distinct()
    return rows.join(_suffixes(spark, d)[1].select("i", "s", "b", "wi"), "i").select("peak_id", "i", F.col("s").alias("place"), "b", "wi")


def c_kmer_at(spark, d):
    rows = table(spark, d, "peaks").select("peak_id", "s", "kmax").distinct()
    return text.text_at(rows, _stored(spark, d), "s", F.col("kmax"), "letters").select("peak_id", "s", "letters")


def c_kmer_around(spark, d):
    """Twenty letters before each peak and two hundred behind it."""
    rows = table(spark, d, "peaks").select("peak_id", "s").distinct()
    return text.text_at(rows, _stored(spark, d), "s", 200, "letters", from_=-20).select("peak_id", "s", "letters")


def d_find_kmer(spark, d):
    """Short motifs, and the first letters of the first blocks that have as many."""
    b, sx = _suffixes(spark, d)
    asked = spark.createDataFrame([(m,) for m in ["", *MOTIFS]], "kmer string")
    for n in LONG:
        asked = asked.unionByName(b.where(F.col("len") >= n).agg(F.min_by(F.col("seq").substr(1, n), "b").alias("kmer")))
    return suffixes.find_kmer(b, sx, asked)


def e_smooth(spark, d):
    b, sx = _suffixes(spark, d)
    return _smooth(b, sx, HALF).select("i", "s", F.round(F.col("windowed").cast("double"), 5).alias("windowed"), F.round(F.col("gini").cast("double"), 5).alias("gini"))


def e_smooth_spatial(spark, d):
    b, sx = _suffixes(spark, d)
    wide = smoothing.smooth_spatial(_smooth(b, sx, HALF), LENGTH, sx.count())
    return wide.select("i", "s", F.round(F.col("spatial_windowed").cast("double"), 4).alias("spatial_windowed"), F.round(F.col("spatial_gini").cast("double"), 4).alias("spatial_gini"))


def e_neighbours(spark, d):
    b, sx = _suffixes(spark, d)
    near = peaks.with_neighbours(_smooth(b, sx, HALF))
    return near.select("i", "s", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("before", "after")])


def e_block_counts(spark, d):
    """Of every full window the number of blocks in it, the most that one of them has, and the Gini impurity of the counts."""
    b, sx = _suffixes(spark, d)
    counts = smoothing.window_summaries(sx, HALF, sx.count())
    return counts.select("centre", "n_blocks", "most", F.round("gini", 6).alias("gini"))


def f_grid(spark, d):
    """The grid of the parameters that the runs in peaks were made with."""
    rows = table(spark, d, "peaks")
    values = {c: sorted(r[0] for r in rows.select(c).where(F.col(c).isNotNull()).distinct().collect()) for c in ("halfwindow", "spatiallength", "mingini")}
    return filters.parameter_grid(spark, values["halfwindow"], values["spatiallength"], values["mingini"])


def f_gini_threshold(spark, d):
    b, sx = _suffixes(spark, d)
    median = filters.median_gini(_smooth(b, sx, HALF))
    return spark.createDataFrame([(round(median, 5), round(filters.relative_gini(median, 1.1), 5))], "median_gini double, min_gini double")


def f_gini_mask(spark, d):
    """Which places either Gini test masks."""
    b, sx = _suffixes(spark, d)
    base = cut(_smooth(b, sx, HALF))
    low = filters.relative_gini(filters.median_gini(base), 1.1)
    return smoothing.smooth_spatial(base, LENGTH, sx.count()).select("i", filters.gini_mask(low, low, True).alias("masked"))


def _grid(spark, lengths=(0,)):
    return filters.parameter_grid(spark, [HALF], list(lengths), [1.1])


def _limits(spark, spatial=False):
    return spark.createDataFrame([(0, None if spatial else THETA, 0.7 if spatial else None)], "f int, theta float, spatial_theta float")


def _rounded(df):
    """Float columns as doubles of four places, for comparison."""
    return df.select(*[F.round(F.col(c).cast("double"), 4).alias(c) if t == "float" else F.col(c) for c, t in df.dtypes])


def f_peaks(spark, d):
    b, sx = _suffixes(spark, d)
    return _rounded(peaks.kmer_peaks(sx, b, _grid(spark), _limits(spark), True, KMAX).select("i", "s", "kmer", "khat", "block", "wi", "gini", "windowed"))


def f_peaks_spatial(spark, d):
    b, sx = _suffixes(spark, d)
    return _rounded(peaks.kmer_peaks(sx, b, _grid(spark, (LENGTH,)), _limits(spark, True), True, KMAX).select("i", "s", "kmer", "khat", "block", "wi", "spatialWindowed", "spatialTheta"))


def f_block_info(spark, d):
    """Every place of the blocks in which intervals of selected peaks begin."""
    b, sx = _suffixes(spark, d)
    return _rounded(peaks.block_info(sx, b, g_selected(spark, d).select(F.col("block").alias("seq_id")), _grid(spark), None, KMAX))


def g_merged(spark, d):
    b, sx = _suffixes(spark, d)
    return _rounded(peaks.merged_sub_peaks(sx, b, _grid(spark), _limits(spark), True, KMAX).select("i", "s", "kmer", "khat", "block", "wi"))


def g_merged_spatial(spark, d):
    b, sx = _suffixes(spark, d)
    return _rounded(peaks.merged_sub_peaks(sx, b, _grid(spark, (LENGTH,)), _limits(spark, True), True, KMAX).select("i", "s", "kmer", "khat", "block", "wi"))


def g_merged_kmers(spark, d):
    return peaks.merged_kmers(g_merged(spark, d))


def g_islands(spark, d):
    """Runs of consecutive places among all peaks."""
    rows = table(spark, d, "peaks").select("s").distinct()
    return peaks.islands(rows, "s").groupBy("island").agg(F.count(F.lit(1)).alias("n")).select(F.col("island").alias("s_start"), (F.col("island") + F.col("n")).alias("s_end"))


def _wide(spark):
    return filters.parameter_grid(spark, list(HALVES), list(LENGTHS), [1.1])


def _null(spark, d, seed=SEED):
    """The distribution of maxima under permuted scores, on the grid; shared by the queries of a session."""
    b, sx = _suffixes(spark, d)
    make = lambda: only(spark, lambda: permutation.permutation_distribution(sx, b, _wide(spark), only(spark, lambda: permutation.permutations(b, REPS, seed)), REPS))
    return kept(f"null {seed}", table(spark, d, "blocks"), make)


def _selecting(spark, d):
    return cut(permutation.thresholds(_null(spark, d), SIGMA))


def h_permutation_distribution(spark, d):
    return _rounded(_null(spark, d))


def h_permutations(spark, d):
    """The score that each block was dealt in every repetition."""
    return permutation.permutations(cut(_aligned(spark, d)), REPS, SEED)


def h_thresholds(spark, d):
    return _rounded(_selecting(spark, d))


def h_false_positives(spark, d):
    """Of new permutations, those in which a threshold is reached."""
    return permutation.false_positives(_null(spark, d, TEST_SEED), _selecting(spark, d))


def h_false_positive_rate(spark, d):
    b, sx = _suffixes(spark, d)
    rate, _ = permutation.estimate_false_positive_rate(sx, b, _wide(spark), _selecting(spark, d), REPS, TEST_SEED)
    return rate.select("fp", "n", "mean", *[F.round(c, 6).alias(c) for c in ("lower", "upper")])


def _found(spark, d):
    """The peaks above a fixed threshold, for each half window."""
    b, sx = _suffixes(spark, d)
    limits = spark.createDataFrame([(f, THETA, None) for f in range(len(HALVES))], "f int, theta float, spatial_theta float")
    return peaks.kmer_peaks(sx, b, filters.parameter_grid(spark, list(HALVES), [0], [1.1]), limits, True, KMAX)


def _zrank(spark, d, best_only):
    found = _found(spark, d).select("kmer", F.col("halfWindow").alias("half_window"), F.col("minGini").alias("min_gini"), "windowed")
    ranked = permutation.zrank(found, _null(spark, d), _wide(spark), best_only)
    return ranked.select("kmer", "half_window", "min_gini", F.round("zmax", 3).alias("zmax"))


def h_zrank(spark, d):
    """The motifs of all peaks against the permuted maxima of their own parameters."""
    return _zrank(spark, d, False)


def h_zrank_best(spark, d):
    """Of every motif its best parameters."""
    return _zrank(spark, d, True)


def f_selected(spark, d):
    """From scores to peaks: thresholds from permutations, for every parameter row."""
    b, sx = _suffixes(spark, d)
    return _rounded(peaks.kmer_peaks(sx, b, _wide(spark), _selecting(spark, d), True, KMAX))


def g_selected(spark, d):
    """From scores to intervals, for every parameter row."""
    b, sx = _suffixes(spark, d)
    return _rounded(peaks.merged_sub_peaks(sx, b, _wide(spark), _selecting(spark, d), True, KMAX))


def i_prune(spark, d):
    rows = table(spark, d, "peaks").where("kmer is not null").groupBy("peak_id").agg(F.min("s").alias("s"), F.min("kmer").alias("kmer"))
    return motifs.prune_intervals(rows, "s", None, "peak_id").select("peak_id", "s", "kmer")


def i_extend(spark, d):
    b, sx = _suffixes(spark, d)
    merged = cut(peaks.merged_sub_peaks(sx, b, _grid(spark), _limits(spark), True, KMAX))
    return motifs.extend_kmers(merged, b, sx).select("i", "s", "kmer", "block", "wi")


def i_extract(spark, d):
    return motifs.extract_kmers(table(spark, d, "peaks"))


def j_regex_counts(spark, d):
    return motifs.regex_counts(_seqs(spark, d), PATTERNS)


def j_regex_counts_overlap(spark, d):
    return motifs.regex_counts(_seqs(spark, d), MOTIFS, overlap=True)


def j_kmer_counts(spark, d):
    return motifs.kmer_counts(_seqs(spark, d), MOTIFS, directional=False)


def j_cluster_counts(spark, d):
    return motifs.cluster_counts(_seqs(spark, d), CLUSTERS)


def j_count_matrix(spark, d):
    return motifs.as_matrix(motifs.kmer_counts(_seqs(spark, d), MOTIFS), "kmer", MOTIFS)


def j_all_kmers(spark, d):
    return motifs.all_kmer_counts(_seqs(spark, d), 4)


def j_regex_locate(spark, d):
    return motifs.regex_locate(_seqs(spark, d), ["TT[AC]G"], show_match=True)


def j_locate_kmers(spark, d):
    return motifs.locate_kmers(_seqs(spark, d), MOTIFS)


def j_locate_kmers_from_zero(spark, d):
    return motifs.locate_kmers(_seqs(spark, d), MOTIFS, base=0, longest=False)


def j_locate_clusters(spark, d):
    return motifs.locate_clusters(_seqs(spark, d), CLUSTERS, directional=False, show_match=True)


def j_reverse_complement(spark, d):
    return _seqs(spark, d).select("seq_id", motifs.reverse_complement("seq").alias("rc"))


def _motifs(spark, d):
    """Every distinct motif over ACGT of the peaks that name a block."""
    return table(spark, d, "peaks").where("block is not null").select(F.upper(bare("kmer")).alias("kmer")).where("kmer rlike '^[ACGT]+$'").distinct()


def k_distances(spark, d):
    """The pairs of motifs whose distance is at most 0.3."""
    return clustering.near_distances(_motifs(spark, d), 4, at_most=0.3).select("a", "b", F.round("distance", 6).alias("distance"))


def k_clusters(spark, d):
    """Clusters of the motifs that the merged peaks give."""
    return clustering.cluster_kmers(motifs.extract_kmers(g_merged_kmers(spark, d)), 3, directional=False)


def k_orient(spark, d):
    return clustering.orient(_motifs(spark, d), "CATACTGAGA", 3)


def k_position_counts(spark, d):
    return clustering.position_counts(_motifs(spark, d))


def k_aligned(spark, d):
    return clustering.best_offsets(_motifs(spark, d), "CATACTGAGA")


def a_fasta(spark, d):
    """The sequences written as records of lines and read again."""
    path = fresh_path(spark, "fasta")
    folded = F.regexp_replace(F.coalesce("seq", F.lit("")), "(.{60})", "$1\n")
    _seqs(spark, d).select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), folded).alias("value")).write.option("compression", "gzip").text(path)
    return sources.read_fasta(spark, path)


def a_scores(spark, d):
    """Score lines written as files in the order of their ids and read again: of each sequence the last valid line."""
    path = fresh_path(spark, "scores")
    table(spark, d, "simulated_scores_raw").orderBy("line_id").select(F.regexp_replace("line", "[\r\n]", "").alias("value")).write.text(path)
    return sources.read_scores(spark, path)


def a_thresholds(spark, d):
    """The thresholds of the grid written as a file and read again."""
    root = fresh_path(spark, "thresholds") + "/"
    sinks.write_thresholds(_selecting(spark, d), _wide(spark), root)
    return _rounded(sources.read_thresholds(spark, root + "theta.tsv"))


def a_permutations(spark, d):
    """The maxima under permuted scores written as files and read again."""
    root = fresh_path(spark, "permutations") + "/"
    sinks.write_permutations(_null(spark, d), _wide(spark), root)
    schema = "halfWindow int, minGini double, spatialLength int, minSpatialGini double, rep int, max float"
    read = lambda name: spark.read.csv(root + name, sep="\t", header=True, nullValue="null", schema=schema).withColumn("file", F.lit(name))
    return _rounded(read("windowed.tsv").unionByName(read("spatial_windowed.tsv")))


def a_selection(spark, d):
    """The files of a selection written and read again, and its motifs ranked."""
    folder = fresh_path(spark, "selection")
    sinks.write_peaks(_found(spark, d), f"{folder}/peaks.tsv")
    sinks.write_permutations(_null(spark, d), _wide(spark), f"{folder}/permdists")
    return permutation.zrank_selection(*sources.read_selection(spark, folder)).select("kmer", "half_window", "min_gini", F.round("zmax", 3).alias("zmax"))


def a_kmers(spark, d):
    """The motifs of peaks written as a table and read again as canonical motifs."""
    path = fresh_path(spark, "kmers")
    rows = table(spark, d, "peaks").select("peak_id", F.upper(bare("kmer")).alias("kmer")).where("kmer rlike '^[ACGT]+$'")
    sinks.write_table(rows, path)
    return sources.read_kmers(spark, path)


QUERIES = {
    f.__name__: f
    for f in (
        c_blocks, c_block_scores, c_suffix_order, c_source_block, c_source_score, c_rank_of_place, c_place_of_rank, c_kmer_at, c_kmer_around, d_find_kmer, e_smooth, e_smooth_spatial, e_neighbours, e_block_counts, f_grid, f_gini_threshold, f_gini_mask, f_peaks, f_peaks_spatial, f_block_info, f_selected, g_selected, g_merged, g_merged_spatial, g_merged_kmers, g_islands,
        h_permutation_distribution, h_permutations, h_thresholds, h_false_positives, h_false_positive_rate, h_zrank, h_zrank_best, i_prune, i_extend, i_extract, j_regex_counts, j_regex_counts_overlap, j_kmer_counts, j_cluster_counts, j_count_matrix, j_all_kmers, j_regex_locate, j_locate_kmers,
        j_locate_kmers_from_zero, j_locate_clusters, j_reverse_complement, k_distances, k_clusters, k_orient, k_position_counts, k_aligned, a_fasta, a_scores, a_thresholds, a_permutations, a_selection, a_kmers,
    )
}

_TEXT = """
WITH RECURSIVE a AS (SELECT row_number() OVER (ORDER BY seq_id) - 1 AS b, seq_id, max(coalesce(catseq, '')) AS seq, max(score) AS score FROM blocks WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY seq_id),
e AS (SELECT b, seq_id, seq, score, length(seq)::INT AS len, (sum(length(seq) + 1) OVER (ORDER BY b) - length(seq) - 1)::BIGINT AS o FROM a),
tt AS (SELECT string_agg(seq || '$', '' ORDER BY b) AS t FROM e)
"""


def _suffixes_sql() -> str:
    """sx: every suffix with its rank and first 64 letters. Letters and then ranks are doubled until no two suffixes tie, so suffixes compare whole."""
    out = _TEXT + """,
k1 AS (SELECT b, o + wi AS s, wi::INT AS wi, score, seq_id, substring(seq || '$', wi + 1, 1) AS k FROM (SELECT *, unnest(range(len + 1)) AS wi FROM e))"""
    for n in (1, 2, 4, 8, 16, 32):
        out += f""",
k{2 * n} AS (SELECT * REPLACE (k || coalesce(lead(k, {n}) OVER (ORDER BY s), '') AS k) FROM k{n})"""
    return out + """,
rk AS (SELECT 64 AS ahead, s, rank() OVER (ORDER BY k) - 1 AS r, count(*) OVER (PARTITION BY k) > 1 AS tied FROM k64
  UNION ALL SELECT ahead * 2, s, rank() OVER (ORDER BY r, r2) - 1, count(*) OVER (PARTITION BY r, r2) > 1 FROM (SELECT *, coalesce(lead(r, ahead) OVER (ORDER BY s), -1) AS r2, bool_or(tied) OVER () AS goes_on FROM rk) WHERE goes_on),
sx AS (SELECT r AS i, k64.*, count(*) OVER () AS n FROM k64 JOIN (SELECT s, arg_max(r, ahead) AS r FROM rk GROUP BY s) USING (s))
"""


_SUFFIXES = _suffixes_sql()


def _at(place: str, letters: str) -> str:
    """Whether k-mer ``letters`` of any length stands at a suffix of sx."""
    return f"starts_with({place}.k, substring({letters}, 1, 64)) AND (length({letters}) <= 64 OR substring((SELECT t FROM tt), {place}.s + 1, length({letters})) = {letters})"


_N = "(SELECT count(*) FROM sx)"


def _clamped(h: int) -> str:
    """The frame of rank i, moved to the nearest full window."""
    c = f"greatest({h}, least(i, n - {h + 1}))"
    return f"ROWS BETWEEN (i - {c} + {h}) PRECEDING AND ({c} + {h} - i) FOLLOWING"


_AHEAD = "ROWS BETWEEN (s - least(s, n - 3)) PRECEDING AND (least(s, n - 3) + 2 - s) FOLLOWING"


def _smooth_sql(h: int) -> str:
    """sm: windowed and Gini; sp: with spatial means; nb: with neighbours; q: the Gini threshold; of half window h."""
    w = 2 * h + 1
    return f""",
pr{h} AS (SELECT i, count(*) AS p FROM (SELECT unnest(range(greatest(r.i - {h}, 0), l.i + {h + 1})) AS i FROM (SELECT i, b, unnest(range(i + 1, i + {w})) AS j FROM sx) l JOIN sx r ON r.i = l.j AND r.b = l.b) GROUP BY i),
sm{h} AS (SELECT sx.*, (avg(score) OVER (ORDER BY sx.i {_clamped(h).replace('i,', 'sx.i,').replace('(i ', '(sx.i ').replace('- i)', '- sx.i)')}))::FLOAT AS windowed, (1 - ({w} + 2 * coalesce(pr{h}.p, 0)) / {w * w}.0)::FLOAT AS gini FROM sx LEFT JOIN pr{h} ON pr{h}.i = greatest({h}, least(sx.i, n - {h + 1}))),
sp{h} AS (SELECT *, (avg(windowed::DOUBLE) OVER v)::FLOAT AS spatial_windowed, (avg(gini::DOUBLE) OVER v)::FLOAT AS spatial_gini FROM sm{h} WINDOW v AS (ORDER BY s {_AHEAD})),
nb{h} AS (SELECT *, coalesce(lag(windowed) OVER (ORDER BY s), windowed) AS before, coalesce(lead(windowed) OVER (ORDER BY s), windowed) AS after FROM sp{h}),
q{h} AS (SELECT 1 - (1 - median(gini)) * 1.1 AS gmin FROM sm{h})
"""


_LCP = "CASE WHEN " + " WHEN ".join(f"substring({{0}}, 1, {k}) = substring({{1}}, 1, {k}) AND length({{0}}) >= {k} AND length({{1}}) >= {k} THEN {k}" for k in range(12, 0, -1)) + " ELSE 0 END"


def _khat_sql(name: str, rows: str, h: int) -> str:
    """Rows with khat."""
    return f""",
kj_{name} AS (SELECT i, k, unnest(range(i - {h}, i + {h + 1})) AS j FROM {rows}),
kh_{name} AS (SELECT p.i, (sum({_LCP.format("p.k", "j.k")}) / {2 * h}.0)::FLOAT AS khat FROM kj_{name} p JOIN sx j ON j.i = p.j AND j.i <> p.i GROUP BY p.i),
{name} AS (SELECT * FROM {rows} JOIN kh_{name} USING (i))
"""


def _peaks_sql(name: str, h: int, theta: str = "", spatial: str = "") -> str:
    """Peaks of half window h; without or with spatial thresholds."""
    ok = [f"windowed >= {theta}"] if theta else []
    ok += [f"spatial_windowed >= {spatial} AND spatial_gini >= gmin"] if spatial else []
    return f""",
{name}_p AS (SELECT nb{h}.* FROM nb{h}, q{h} WHERE gini >= gmin AND before <= windowed AND after <= windowed AND {" AND ".join(ok)})
"""


def _merged_sql(name: str, h: int, theta: str = "", spatial: str = "") -> str:
    """Intervals {name}: places below spatial windows, islands, the values of the first place and the whole text."""
    rows = f"{name}_p"
    out = _peaks_sql(name, h, theta, spatial)
    if spatial:
        rows = f"{name}_u"
        out += f""",
{name}_c AS (SELECT DISTINCT unnest(range(s, least(s + 3, n))) AS s FROM {name}_p),
{name}_u AS (SELECT m.* FROM {name}_c c JOIN nb{h} m USING (s) LEFT JOIN {name}_c l ON l.s = c.s - 1 LEFT JOIN sm{h} pm ON pm.s = c.s - 1 WHERE m.windowed >= {spatial} AND (l.s IS NOT NULL OR pm.windowed IS NULL OR pm.windowed < {spatial}))
"""
    return out + _khat_sql(f"{name}_k", rows, h) + f""",
{name}_g AS (SELECT *, s - row_number() OVER (ORDER BY s) AS g FROM {name}_k),
{name}_iv AS (SELECT min(s) AS s, least(max(s + round(khat)::INT), {_N}) AS z FROM {name}_g GROUP BY g),
{name} AS (SELECT v.* EXCLUDE (k), substring(t, iv.s + 1, z - iv.s) AS kmer FROM {name}_iv iv JOIN {name}_g v USING (s), tt)
"""


_SMOOTH, _SMOOTH_8 = _SUFFIXES + _smooth_sql(4), _smooth_sql(8)
_PEAKS = _SMOOTH + _peaks_sql("pk", 4, "0.8::FLOAT") + _khat_sql("pt", "pk_p", 4)
_PEAKS_SPATIAL = _SMOOTH + _peaks_sql("pk", 4, spatial="0.7::FLOAT") + _khat_sql("pt", "pk_p", 4)
_MERGED = _SMOOTH + _merged_sql("mg", 4, "0.8::FLOAT")
_MERGED_COLUMNS = "SELECT i, s, kmer, round(khat::DOUBLE, 4) AS khat, seq_id AS block, wi FROM mg"


def _null_sql(seed: int, name: str = "mx") -> str:
    """Maxima under permuted scores, by f and rep."""
    return f""",
{name}_dealt AS (SELECT r.rep, r.b, a.score AS y FROM (SELECT rep, b, row_number() OVER (PARTITION BY rep ORDER BY md5('{seed}:' || rep || ':' || b)) - 1 AS p FROM a, (SELECT unnest(range({REPS})) AS rep)) r JOIN a ON a.b = r.p),
{name}_w AS (SELECT rep, i, s, n, (avg(y) OVER (PARTITION BY rep ORDER BY i {_clamped(4)}))::FLOAT AS y4, (avg(y) OVER (PARTITION BY rep ORDER BY i {_clamped(8)}))::FLOAT AS y8 FROM sx JOIN {name}_dealt d USING (b)),
{name}_s AS (SELECT *, (avg(y4::DOUBLE) OVER v)::FLOAT AS z4, (avg(y8::DOUBLE) OVER v)::FLOAT AS z8 FROM {name}_w WINDOW v AS (PARTITION BY rep ORDER BY s {_AHEAD})),
{name}_ok AS (SELECT p4.i, p4.gini >= q4.gmin AS a, p4.gini >= q4.gmin AND p4.spatial_gini >= q4.gmin AS b, p8.gini >= q8.gmin AS c, p8.gini >= q8.gmin AND p8.spatial_gini >= q8.gmin AS d FROM sp4 p4 JOIN sp8 p8 USING (i), q4, q8),
{name}_m AS (SELECT rep, max(y4) FILTER (a) AS m0, max(y4) FILTER (b) AS m1, max(z4) FILTER (b) AS s1, max(y8) FILTER (c) AS m2, max(y8) FILTER (d) AS m3, max(z8) FILTER (d) AS s3 FROM {name}_s JOIN {name}_ok USING (i) GROUP BY rep),
{name} AS (SELECT f::INT AS f, rep::INT AS rep, coalesce(CASE f WHEN 0 THEN m0 WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE m3 END, '-infinity'::FLOAT) AS a, CASE f WHEN 1 THEN coalesce(s1, '-infinity'::FLOAT) WHEN 3 THEN coalesce(s3, '-infinity'::FLOAT) END AS z FROM {name}_m, (SELECT unnest(range(4)) AS f))
"""


_NULL = _SMOOTH + _SMOOTH_8 + _null_sql(SEED)
_LIMITS = _NULL + f""",
th AS (SELECT f, CASE WHEN count(z) = 0 THEN (avg(a) + {SIGMA} * stddev_samp(a))::FLOAT END AS theta, (avg(z) + {SIGMA} * stddev_samp(z))::FLOAT AS spatial_theta FROM mx GROUP BY f)
"""
_HITS = _LIMITS + _null_sql(TEST_SEED, "tx") + ", h AS (SELECT rep, max((coalesce(a >= theta, FALSE) OR coalesce(z >= spatial_theta, FALSE))::INT) AS hit FROM tx JOIN th USING (f) GROUP BY rep), fp AS (SELECT sum(hit) AS fp, count(*) AS n FROM h)"
_AT_MOST = "list_sum(list_transform(range(0, {k} + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))"
_RATE = _HITS + f""",
bs AS (SELECT 0 AS step, fp::BIGINT AS k, n, 0.0::DOUBLE AS la, 1.0::DOUBLE AS lz, 0.0::DOUBLE AS ua, 1.0::DOUBLE AS uz FROM fp UNION ALL
  SELECT step + 1, k, n, CASE WHEN lo THEN (la + lz) / 2 ELSE la END, CASE WHEN lo THEN lz ELSE (la + lz) / 2 END, CASE WHEN up THEN (ua + uz) / 2 ELSE ua END, CASE WHEN up THEN uz ELSE (ua + uz) / 2 END
  FROM (SELECT *, k > 0 AND 1 - {_AT_MOST.format(k="k - 1", p="((la + lz) / 2)")} < 0.025 AS lo, {_AT_MOST.format(k="k", p="((ua + uz) / 2)")} > 0.025 AS up FROM bs WHERE step < 60))
SELECT k AS fp, n, k / n AS mean, round(CASE WHEN k = 0 THEN 0 ELSE (la + lz) / 2 END, 6) AS lower, round(CASE WHEN k = n THEN 1 ELSE (ua + uz) / 2 END, 6) AS upper FROM bs WHERE step = 60"""
#: Half window, spatial length and CTE of the rows of the grid.
_ROWS = [(h, length, f"f{n}") for n, (h, length) in enumerate((h, length) for h in HALVES for length in LENGTHS)]


def _limit(f: int, length: int) -> dict:
    return {"spatial": f"(SELECT spatial_theta FROM th WHERE f = {f})"} if length > 1 else {"theta": f"(SELECT theta FROM th WHERE f = {f})"}


def _told(name: str, f: int, h: int, length: int, kmer: str) -> str:
    """The table of peaks, floats rounded."""
    at = lambda c: f"round({c}::DOUBLE, 4)"
    spatial = lambda c: at(c) if length > 1 else "NULL::DOUBLE"
    return f"""SELECT i, s, {kmer} AS kmer, {at("khat")} AS khat, seq_id AS block, wi, {at("gini")} AS gini, {spatial("spatial_gini")} AS "spatialGini", {at("score::FLOAT")} AS score, {at("windowed")} AS windowed, {spatial("spatial_windowed")} AS "spatialWindowed",
12 AS kmax, {h} AS "halfWindow", 1.1::DOUBLE AS "minGini", (SELECT {at("theta")} FROM th WHERE f = {f}) AS theta, {length} AS "spatialLength", {"1.1" if length > 1 else "NULL"}::DOUBLE AS "minSpatialGini", (SELECT {at("spatial_theta")} FROM th WHERE f = {f}) AS "spatialTheta" FROM {name}"""


_SELECTED = _LIMITS + "".join(_merged_sql(name, h, **_limit(f, length)) for f, (h, length, name) in enumerate(_ROWS))
_SELECTED_PEAKS = _LIMITS + "".join(_peaks_sql(name, h, **_limit(f, length)) + _khat_sql(name, f"{name}_p", h) for f, (h, length, name) in enumerate(_ROWS))
_ZRANK = _NULL + _peaks_sql("za", 4, "0.8::FLOAT") + _khat_sql("zk", "za_p", 4) + _peaks_sql("zb", 8, "0.8::FLOAT") + _khat_sql("zl", "zb_p", 8) + """,
nu AS (SELECT f, avg(a) AS m, stddev_samp(a) AS sd FROM mx GROUP BY f),
zr AS (SELECT kmer, half_window, 1.1::DOUBLE AS min_gini, max((windowed - m) / sd) AS zmax FROM (SELECT substring(k, 1, round(khat)::INT) AS kmer, 4 AS half_window, 0 AS f, windowed FROM zk UNION ALL SELECT substring(k, 1, round(khat)::INT), 8, 2, windowed FROM zl) JOIN nu USING (f) GROUP BY ALL)
"""
_SEQS = "SELECT seq_id, upper(coalesce(catseq, '')) AS x FROM blocks"
_COUNT = "SELECT seq_id, '{0}' AS {2}, len(regexp_extract_all(x, '{1}'))::BIGINT AS n FROM ({3})"
_MOTIFS = """
WITH mo AS (SELECT DISTINCT kmer FROM (SELECT upper(trim(kmer, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) AS kmer FROM peaks WHERE block IS NOT NULL) WHERE regexp_full_match(kmer, '[ACGT]+'))
"""
_GRAMS = _MOTIFS + """, g AS (SELECT kmer, substring(kmer, q::INT, 4) AS gram, count(*) AS n FROM (SELECT kmer, unnest(range(1, length(kmer) - 2)) AS q FROM mo WHERE length(kmer) >= 4) GROUP BY ALL)
"""
_REP = "CATACTGAGA"


def _rc(x: str) -> str:
    return f"translate(reverse({x}), 'ACGTacgt[]', 'TGCAtgca][')"


def _comp(m: str) -> str:
    return m[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _both(m: str) -> str:
    return "|".join(sorted({m, _comp(m)}))


def _places(m: str, base: int, size: int | None = None) -> str:
    """Places of matches that don't overlap: lengths of what lies between them, summed."""
    parts = f"regexp_split_to_array(lower(catseq), '{m.lower()}')"
    return f"SELECT seq_id AS seqid, '{m}' AS kmer, (list_sum(list_transform(p[1:j], lambda z: length(z))) + (j - 1) * {size or len(m)} + {base})::INT AS location FROM (SELECT seq_id, p, unnest(range(1, len(p))) AS j FROM (SELECT seq_id, {parts} AS p FROM blocks WHERE catseq IS NOT NULL))"


def _located(name: str, members: list[str]) -> str:
    """Places and letters of matches of any member, longer ones first."""
    pattern = "|".join(members).lower()
    return f"SELECT seq_id AS seqid, '{name}' AS cluster, (list_sum(list_transform(p[1:j], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda z: length(z))), 0) + 1)::INT AS location, upper(m[j]) AS match FROM (SELECT seq_id, p, m, unnest(range(1, len(p))) AS j FROM (SELECT seq_id, regexp_split_to_array(lower(catseq), '{pattern}') AS p, regexp_extract_all(lower(catseq), '{pattern}') AS m FROM blocks WHERE catseq IS NOT NULL))"


_WHOLE = "WITH t AS (SELECT string_agg(coalesce(catseq, '') || '$', '' ORDER BY b) AS t FROM blocks) "
SQL = {
    "c_blocks": _TEXT + 'SELECT b, seq_id, score, o AS "offset", len FROM e',
    "c_suffix_order": _SUFFIXES + "SELECT i, s, b, wi FROM sx",
    "c_source_block": "SELECT peak_id, s, b.b, b.seq_id, (s - seq_offset)::INT AS wi FROM (SELECT DISTINCT peak_id, s FROM peaks) p JOIN blocks b ON p.s >= b.seq_offset AND p.s < b.seq_offset + length(coalesce(catseq, '')) + 1",
    "c_source_score": "SELECT peak_id, s, b.score AS source_score FROM (SELECT DISTINCT peak_id, s FROM peaks) p JOIN blocks b ON p.s >= b.seq_offset AND p.s < b.seq_offset + length(coalesce(catseq, '')) + 1",
    "c_rank_of_place": _SUFFIXES + "SELECT DISTINCT p.peak_id, s, sx.i AS rank FROM (SELECT peak_id, s FROM peaks) p JOIN sx USING (s)",
    "c_place_of_rank": _SUFFIXES + "SELECT DISTINCT p.peak_id, i, sx.s AS place, b, wi FROM (SELECT peak_id, i FROM peaks) p JOIN sx USING (i)",
    "c_kmer_at": _WHOLE + "SELECT peak_id, s, substring(t, s + 1, kmax) AS letters FROM (SELECT DISTINCT peak_id, s, kmax FROM peaks) p, t WHERE s < length(t)",
    "d_find_kmer": _SUFFIXES + " SELECT m.kmer, min(i) AS i_from, max(i) + 1 AS i_to FROM (SELECT unnest(['', " + ", ".join(f"'{m}'" for m in MOTIFS) + "]) AS kmer" + "".join(f" UNION SELECT arg_min(substring(seq, 1, {n}), b) FROM e WHERE len >= {n}" for n in LONG) + ") m JOIN sx ON " + _at("sx", "m.kmer") + " GROUP BY m.kmer",
    "e_smooth": _SMOOTH + "SELECT i, s, round(windowed::DOUBLE, 5) AS windowed, round(gini::DOUBLE, 5) AS gini FROM sm4",
    "e_smooth_spatial": _SMOOTH + "SELECT i, s, round(spatial_windowed::DOUBLE, 4) AS spatial_windowed, round(spatial_gini::DOUBLE, 4) AS spatial_gini FROM sp4",
    "e_neighbours": _SMOOTH + "SELECT i, s, round(before::DOUBLE, 5) AS before, round(after::DOUBLE, 5) AS after FROM nb4",
    "e_block_counts": _SUFFIXES + "SELECT centre, count(*) AS n_blocks, max(n) AS most, round(1 - sum(n * n) / 81.0::DOUBLE, 6) AS gini FROM (SELECT c.i AS centre, j.b, count(*) AS n FROM (SELECT i, unnest(range(i - 4, i + 5)) AS q FROM sx WHERE i BETWEEN 4 AND n - 5) c JOIN sx j ON j.i = c.q GROUP BY ALL) GROUP BY centre",
    "f_grid": """WITH h AS (SELECT DISTINCT halfwindow AS half_window FROM peaks WHERE halfwindow IS NOT NULL), l AS (SELECT DISTINCT spatiallength AS spatial_length FROM peaks WHERE spatiallength IS NOT NULL), g AS (SELECT DISTINCT mingini + 0.0 AS min_gini FROM peaks WHERE mingini IS NOT NULL)
SELECT (row_number() OVER (ORDER BY half_window, spatial_length, min_gini) - 1)::INT AS f, half_window, spatial_length, min_gini, CASE WHEN spatial_length > 1 THEN min_gini END AS min_spatial_gini FROM h, l, g""",
    "f_gini_threshold": _SMOOTH + "SELECT round(median(gini)::DOUBLE, 5) AS median_gini, round(1 - (1 - median(gini)::DOUBLE) * 1.1, 5) AS min_gini FROM sm4",
    "f_gini_mask": _SMOOTH + "SELECT i, gini < gmin OR spatial_gini < gmin AS masked FROM sp4, q4",
    "c_block_scores": _TEXT + "SELECT seq_id, score FROM e",
    "a_permutations": _NULL + """SELECT CASE WHEN f < 2 THEN 4 ELSE 8 END AS "halfWindow", 1.1::DOUBLE AS "minGini", CASE WHEN f % 2 = 0 THEN 0 ELSE 3 END AS "spatialLength", CASE WHEN f % 2 = 1 THEN 1.1::DOUBLE END AS "minSpatialGini", rep, round(max::DOUBLE, 4) AS max, file
FROM (SELECT f, rep, a AS max, 'windowed.tsv' AS file FROM mx UNION ALL SELECT f, rep, z, 'spatial_windowed.tsv' FROM mx)""",
    "f_peaks": _PEAKS + "SELECT i, s, substring(k, 1, round(khat)::INT) AS kmer, round(khat::DOUBLE, 4) AS khat, seq_id AS block, wi, round(gini::DOUBLE, 4) AS gini, round(windowed::DOUBLE, 4) AS windowed FROM pt",
    "f_peaks_spatial": _PEAKS_SPATIAL + 'SELECT i, s, substring(k, 1, round(khat)::INT) AS kmer, round(khat::DOUBLE, 4) AS khat, seq_id AS block, wi, round(spatial_windowed::DOUBLE, 4) AS "spatialWindowed", 0.7::DOUBLE AS "spatialTheta" FROM pt',
    "g_merged": _MERGED + _MERGED_COLUMNS,
    "f_block_info": _SELECTED + ", bi_p AS (SELECT * FROM sm4 WHERE b IN (" + " UNION ALL ".join(f"SELECT b FROM {name}" for _, _, name in _ROWS) + "))" + _khat_sql("bi", "bi_p", 4) + """SELECT i, s, substring(k, 1, round(khat)::INT) AS kmer, round(khat::DOUBLE, 4) AS khat, seq_id AS block, wi, round(gini::DOUBLE, 4) AS gini, NULL::DOUBLE AS "spatialGini", round(score::FLOAT::DOUBLE, 4) AS score, round(windowed::DOUBLE, 4) AS windowed, NULL::DOUBLE AS "spatialWindowed",
  12 AS kmax, 4 AS "halfWindow", 1.1::DOUBLE AS "minGini", NULL::DOUBLE AS theta, 0 AS "spatialLength", NULL::DOUBLE AS "minSpatialGini", NULL::DOUBLE AS "spatialTheta" FROM bi""",
    "f_selected": _SELECTED_PEAKS + " UNION ALL ".join(_told(name, f, h, length, "substring(k, 1, round(khat)::INT)") for f, (h, length, name) in enumerate(_ROWS)),
    "g_selected": _SELECTED + " UNION ALL ".join(_told(name, f, h, length, "kmer") for f, (h, length, name) in enumerate(_ROWS)),
    "g_merged_spatial": _SMOOTH + _merged_sql("mg", 4, spatial="0.7::FLOAT") + _MERGED_COLUMNS,
    "h_permutation_distribution": _NULL + "SELECT f, rep, round(a::DOUBLE, 4) AS max_windowed, round(z::DOUBLE, 4) AS max_spatial FROM mx",
    "h_false_positive_rate": _RATE,
    "h_zrank_best": _ZRANK + "SELECT kmer, half_window, min_gini, round(zmax, 3) AS zmax FROM (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY zmax DESC, half_window) AS r FROM zr) WHERE r = 1",
    "i_extend": _MERGED + f""",
nw AS (SELECT DISTINCT kmer FROM mg WHERE kmer <> ''), pl AS (SELECT sx.s AS pos, nw.kmer AS new FROM sx JOIN nw ON {_at('sx', 'nw.kmer')}), lg AS (SELECT max(length(kmer)) AS most FROM mg),
ex AS (SELECT m.i, arg_min(pos, (-length(new), pos)) AS pos, arg_min(new, (-length(new), pos)) AS new FROM mg m JOIN pl ON pos <= m.s AND pos + length(new) >= m.s + length(m.kmer) AND length(new) > length(m.kmer), lg WHERE length(m.kmer) < most GROUP BY m.i)
SELECT sx.i, sx.s, coalesce(ex.new, m.kmer) AS kmer, m.seq_id AS block, (m.wi + sx.s - m.s)::INT AS wi FROM mg m LEFT JOIN ex USING (i) JOIN sx ON sx.s = coalesce(ex.pos, m.s)""",
    "c_kmer_around": _WHOLE + "SELECT peak_id, s, substring(t, greatest(s - 20, 0) + 1, s + 200 - greatest(s - 20, 0)) AS letters FROM (SELECT DISTINCT peak_id, s FROM peaks) p, t",
    "j_locate_clusters": " UNION ALL ".join(_located(c, sorted({x for k in m for x in (k, _comp(k))}, key=lambda k: (-len(k), k))) for c, m in CLUSTERS.items()),
    "k_orient": _MOTIFS + f""", rp AS (SELECT substring('{_REP}', q::INT, 3) AS gram, count(*) AS m FROM (SELECT unnest(range(1, {len(_REP) - 1})) AS q) GROUP BY 1),
tu AS (SELECT kmer, {_rc('kmer')} AS rc FROM mo), sc AS (SELECT kmer, rc, coalesce((SELECT sum(m) FROM rp, (SELECT unnest(range(1, length(kmer) - 1)) AS q) WHERE substring(kmer, q::INT, 3) = gram), 0) AS f, coalesce((SELECT sum(m) FROM rp, (SELECT unnest(range(1, length(kmer) - 1)) AS q) WHERE substring(rc, q::INT, 3) = gram), 0) AS r FROM tu)
SELECT kmer, CASE WHEN r > f THEN rc ELSE kmer END AS oriented FROM sc""",
    "k_aligned": _MOTIFS + f""", t AS (SELECT kmer, o, (SELECT count(*) FROM (SELECT unnest(range(1, length(kmer) + 1)) AS p) WHERE p + o >= 1 AND p + o <= {len(_REP)} AND substring(kmer, p::INT, 1) = substring('{_REP}', (p + o)::INT, 1)) AS same FROM (SELECT kmer, unnest(range(1 - length(kmer), {len(_REP)})) AS o FROM mo)),
bo AS (SELECT kmer, arg_min(o, (-same, abs(o), o)) AS o FROM t GROUP BY kmer), ed AS (SELECT least(min(o), 0) AS low, greatest(max(o + length(kmer)), {len(_REP)}) AS high FROM bo)
SELECT kmer, rpad(repeat('-', (o - low)::INT) || kmer, (high - low)::INT, '-') AS aligned FROM bo, ed""",
    "g_islands": "SELECT min(s) AS s_start, max(s) + 1 AS s_end FROM (SELECT s, s - row_number() OVER (ORDER BY s) AS g FROM (SELECT DISTINCT s FROM peaks)) GROUP BY g",
    "h_permutations": _TEXT + f"SELECT r.rep::INT AS rep, r.b, a.score FROM (SELECT rep, b, row_number() OVER (PARTITION BY rep ORDER BY md5('{SEED}:' || rep || ':' || b)) - 1 AS p FROM a, (SELECT unnest(range({REPS})) AS rep)) r JOIN a ON a.b = r.p",
    "h_thresholds": _LIMITS + "SELECT f, round(theta::DOUBLE, 4) AS theta, round(spatial_theta::DOUBLE, 4) AS spatial_theta FROM th",
    "h_false_positives": _HITS + "SELECT fp, n FROM fp",
    "h_zrank": _ZRANK + "SELECT kmer, half_window, min_gini, round(zmax, 3) AS zmax FROM zr",
    "i_prune": "WITH r AS (SELECT peak_id, min(s) AS s, min(kmer) AS kmer FROM peaks WHERE kmer IS NOT NULL GROUP BY peak_id), q AS (SELECT *, s + length(kmer) AS z FROM r), w AS (SELECT *, max(z) OVER (ORDER BY s, z DESC, peak_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM q) SELECT peak_id, s, kmer FROM w WHERE far IS NULL OR far < z",
    "i_extract": f"SELECT DISTINCT least(kmer, {_rc('kmer')}) AS kmer FROM peaks WHERE kmer IS NOT NULL",
    "j_regex_counts": " UNION ALL ".join(_COUNT.format(p, p, "regex", _SEQS) for p in PATTERNS),
    "j_regex_counts_overlap": " UNION ALL ".join(f"SELECT seq_id, '{m}' AS regex, len(list_filter(range(1, length(x) - {len(m) - 2}), lambda p: substring(x, p::INT, {len(m)}) = '{m}'))::BIGINT AS n FROM ({_SEQS})" for m in MOTIFS),
    "j_kmer_counts": " UNION ALL ".join(_COUNT.format(m, _both(m), "kmer", _SEQS) for m in MOTIFS),
    "j_cluster_counts": " UNION ALL ".join(_COUNT.format(c, "|".join(sorted(m)), "cluster", _SEQS) for c, m in CLUSTERS.items()),
    "j_count_matrix": "SELECT seq_id, " + ", ".join(f"len(regexp_extract_all(x, '{m}'))::BIGINT AS {m}" for m in MOTIFS) + f" FROM ({_SEQS})",
    "j_all_kmers": f"SELECT seq_id, kmer, count(*) AS n FROM (SELECT seq_id, substring(x, p::INT, 4) AS kmer FROM (SELECT seq_id, x, unnest(range(1, length(x) - 2)) AS p FROM ({_SEQS}))) WHERE regexp_full_match(kmer, '[ACGT]{{4}}') GROUP BY ALL",
    "j_locate_kmers": " UNION ALL ".join(_places(m, 1) for m in MOTIFS),
    "j_locate_kmers_from_zero": " UNION ALL ".join(_places(m, 0) for m in MOTIFS),
    "j_reverse_complement": f"SELECT seq_id, {_rc('catseq')} AS rc FROM blocks",
    "k_distances": _GRAMS + ", nm AS (SELECT kmer, sum(n * n) AS q FROM g GROUP BY kmer), dt AS (SELECT a.kmer AS a, b.kmer AS b, sum(a.n * b.n) AS d FROM g a JOIN g b USING (gram) WHERE a.kmer < b.kmer GROUP BY ALL) SELECT a, b, round(1 - d / (x.q + y.q - d), 6) AS distance FROM dt JOIN nm x ON x.kmer = a JOIN nm y ON y.kmer = b WHERE 1 - d / (x.q + y.q - d) <= 0.3 + 1e-9",
    "k_position_counts": _MOTIFS + ", c AS (SELECT (p - 1)::INT AS pos, substring(kmer, p::INT, 1) AS base FROM (SELECT kmer, unnest(range(1, length(kmer) + 1)) AS p FROM mo)) SELECT pos, " + ", ".join(f"count(*) FILTER (base = '{x}') AS {x}" for x in "ACGT") + " FROM c GROUP BY pos",
    "j_regex_locate": f"SELECT seqid, 'TT[AC]G' AS regex, location, upper(substring(catseq, location, 4)) AS match FROM ({_places('TT[AC]G', 1, 4)}) JOIN blocks ON seq_id = seqid",
    "a_scores": r"""WITH l AS (SELECT line_id, string_split(regexp_replace(line, '[\r\n]', '', 'g'), chr(9)) AS x FROM simulated_scores_raw), h AS (SELECT line_id, x[1] AS seq_id, trim(x[2], ' ') AS y, regexp_extract(lower(trim(x[2], ' ')), '^([+-]?)0x([0-9a-f]+)p([+-]?[0-9]+)$', ['sign', 'digits', 'power']) AS p FROM l),
v AS (SELECT line_id, seq_id, CASE WHEN p.digits <> '' THEN CASE WHEN p.sign = '-' THEN -1.0 ELSE 1.0 END * list_reduce(list_transform(string_split(p.digits, ''), lambda c: (strpos('0123456789abcdef', c) - 1)::DOUBLE), lambda m, c: 16 * m + c) * pow(2, p.power::INT) ELSE try_cast(y AS DOUBLE) END AS score FROM h)
SELECT seq_id, arg_max(score, line_id) AS score FROM v WHERE score IS NOT NULL GROUP BY seq_id""",
    "a_thresholds": _LIMITS + "SELECT f, CASE WHEN f < 2 THEN 4 ELSE 8 END AS half_window, 1.1::DOUBLE AS min_gini, CASE WHEN f % 2 = 0 THEN 0 ELSE 3 END AS spatial_length, CASE WHEN f % 2 = 1 THEN 1.1::DOUBLE END AS min_spatial_gini, round(theta::DOUBLE, 4) AS theta, round(spatial_theta::DOUBLE, 4) AS spatial_theta FROM th",
    "a_kmers": f"SELECT DISTINCT least(kmer, {_rc('kmer')}) AS kmer FROM (SELECT upper(trim(kmer, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) AS kmer FROM peaks) WHERE regexp_full_match(kmer, '[ACGT]+')",
    "a_fasta": "SELECT seq_id, coalesce(catseq, '') AS seq FROM blocks",
}
SQL["a_selection"] = SQL["h_zrank_best"]
SQL["g_merged_kmers"] = "SELECT DISTINCT kmer FROM (" + SQL["g_merged"] + ")"
