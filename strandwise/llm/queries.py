"""Queries on corpus preparation, with SQL where SQL can say the same."""

from pyspark.sql import functions as F

from strandwise.llm import frequency, mixture, spans, tokens, topn, toxicity
from strandwise.runtime import bare
from strandwise.sources import table


def _spans(spark, d):
    return spans.shared_spans(table(spark, d, "blocks"), "b", "catseq", 50)


def p1_found(spark, d):
    return _spans(spark, d)


def p1_report(spark, d):
    return spans.shared_report(table(spark, d, "blocks"), "b", "catseq", _spans(spark, d))


def _kmer():
    return F.upper(bare("kmer"))


def _frequencies(spark, d):
    return frequency.term_frequencies(table(spark, d, "peaks"), "peak_id", _kmer(), "block").withColumnRenamed("term", "kmer")


def p2_found(spark, d):
    return _frequencies(spark, d).where("mark is not null").select("kmer", "mark")


def p2_frequencies(spark, d):
    return _frequencies(spark, d).select("kmer", F.col("n_rows").alias("n_peaks"), F.col("n_records").alias("n_blocks"), "mark")


def _best(spark, d):
    peaks = table(spark, d, "peaks").select("peak_id", "s", _kmer().alias("kmer"), "halfwindow", "mingini", "windowed").where("kmer is not null")
    return topn.top_n(peaks, ["kmer", "halfwindow", "mingini"], "windowed", ["s", "peak_id"], 3)


def p3_found(spark, d):
    return _best(spark, d).select("peak_id")


def p3_best(spark, d):
    return _best(spark, d)


def p6_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"), "text", ["doc_id"])


def _mix(spark, d):
    sizes = tokens.encode(table(spark, d, "documents"), "text", ["doc_id", "source"], count=True)
    return mixture.mix(sizes, table(spark, d, "mix_targets"))


def p7_mixture(spark, d):
    return _mix(spark, d)[0]


def p7_shares(spark, d):
    return _mix(spark, d)[1]


def _scored(spark, d, keep):
    return toxicity.score_documents(table(spark, d, "documents"), table(spark, d, "review_labels"), keep)


def p8_found(spark, d):
    return _scored(spark, d, ["doc_id"]).where("flagged").select("doc_id")


def p8_scores(spark, d):
    return _scored(spark, d, ["doc_id", "source"])


def p8_rates(spark, d):
    return toxicity.rates(_scored(spark, d, ["source"]))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_frequencies, p3_found, p3_best, p6_ids, p7_mixture, p7_shares, p8_found, p8_scores, p8_rates)}

_BARE = "upper(trim(kmer, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)))"
_RUNS = """
WITH w AS (SELECT b, i AS wi, substring(catseq, i + 1, 50) AS x FROM (SELECT b, catseq, unnest(range(length(catseq) - 49)) AS i FROM blocks WHERE length(catseq) >= 50)),
f AS (SELECT DISTINCT b, wi FROM w WHERE x IN (SELECT x FROM w GROUP BY x HAVING count(DISTINCT b) > 1)),
g AS (SELECT b, wi, coalesce(wi > lag(wi) OVER (PARTITION BY b ORDER BY wi) + 50, TRUE)::INT AS fresh FROM f),
r AS (SELECT b, wi, sum(fresh) OVER (PARTITION BY b ORDER BY wi) AS run FROM g),
found AS (SELECT b, min(wi)::INT AS wi_from, (max(wi) + 50)::INT AS wi_to FROM r GROUP BY b, run)
"""
_COUNTS = f"""
WITH p AS (SELECT DISTINCT peak_id, {_BARE} AS kmer, block FROM peaks),
t AS (SELECT count(DISTINCT block) AS n FROM peaks),
c AS (SELECT kmer, count(*) AS n_peaks, count(DISTINCT block) AS n_blocks FROM p WHERE kmer <> '' GROUP BY kmer),
m AS (SELECT kmer, n_peaks, n_blocks, CASE WHEN n_blocks < 3 THEN 'rare' WHEN n_blocks > t.n / 20.0 THEN 'common' END AS mark FROM c, t)
"""
_TOP = f"""
WITH p AS (SELECT DISTINCT peak_id, s, {_BARE} AS kmer, halfwindow, mingini + 0.0 AS mingini, windowed FROM peaks),
q AS (SELECT *, row_number() OVER (PARTITION BY kmer, halfwindow, mingini ORDER BY windowed DESC, s, peak_id) AS place FROM p WHERE kmer <> '' AND windowed IS NOT NULL AND NOT isnan(windowed))
"""
SQL = {
    "p1_found": _RUNS + "SELECT * FROM found",
    "p1_report": _RUNS + """, n AS (SELECT b, sum(wi_to - wi_from) AS n FROM found GROUP BY b)
SELECT b, length(coalesce(catseq, '')) AS n_letters, coalesce(n, 0)::BIGINT AS n_shared, CASE WHEN length(catseq) > 0 THEN coalesce(n, 0) / length(catseq) ELSE 0.0 END AS share FROM blocks LEFT JOIN n USING (b)""",
    "p2_found": _COUNTS + "SELECT kmer, mark FROM m WHERE mark IS NOT NULL",
    "p2_frequencies": _COUNTS + "SELECT * FROM m",
    "p3_found": _TOP + "SELECT peak_id FROM q WHERE place <= 3",
    "p3_best": _TOP + "SELECT kmer, halfwindow, mingini, windowed, s, peak_id, place FROM q WHERE place <= 3",
}
