"""Queries on parse failures and orphan references, with the same in SQL."""

from strandwise.operators import parsing, references
from strandwise.sources import table


def _parsed(spark, d):
    return parsing.parse_scores(table(spark, d, "simulated_scores_raw"))


def p4_found(spark, d):
    return parsing.failed_lines(_parsed(spark, d))


def p4_loaded(spark, d):
    return parsing.good_scores(_parsed(spark, d))


def _orphans(spark, d):
    return references.orphan_references(table(spark, d, "simulated_scores"), "score_id", "b", "loaded_at", table(spark, d, "seq_register"), "seq_id", "added_at", "deleted_at")


def p5_found(spark, d):
    return _orphans(spark, d).select("score_id", "reason")


def p5_report(spark, d):
    return references.orphan_report(_orphans(spark, d), "simulated_scores")


QUERIES = {"p4_found": p4_found, "p4_loaded": p4_loaded, "p5_found": p5_found, "p5_report": p5_report}

_FIELD = r"""("([^"]|"")*"|[^"\t][^"\t]*|)"""
_LINES = rf"""
WITH l AS (SELECT line_id, regexp_replace(line, '\r$', '') AS x FROM simulated_scores_raw),
q AS (SELECT line_id, x, regexp_full_match(x, '(?s){_FIELD}(\t{_FIELD})*') AS well, regexp_full_match(x, '(?s){_FIELD}\t{_FIELD}') AS two,
  regexp_extract(x, '(?s)^{_FIELD}\t', 1) AS f1, regexp_extract(x, '(?s)^{_FIELD}\t{_FIELD}$', 3) AS f2 FROM l),
u AS (SELECT line_id, well, two,
  CASE WHEN f1 LIKE '"%' THEN replace(substring(f1, 2, length(f1) - 2), '""', '"') ELSE f1 END AS b,
  CASE WHEN f2 LIKE '"%' THEN replace(substring(f2, 2, length(f2) - 2), '""', '"') ELSE f2 END AS yt FROM q),
v AS (SELECT line_id, b, CASE WHEN regexp_full_match(trim(yt, ' '), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trim(yt, ' ') AS DOUBLE) END AS y, well, two FROM u),
r AS (SELECT line_id, b, y, CASE WHEN NOT well THEN 'quoting' WHEN NOT two THEN 'columns' WHEN trim(b, ' ') = '' OR y IS NULL OR NOT isfinite(y) THEN 'value' END AS reason FROM v)
"""
_ORPHANS = r"""
WITH r AS (SELECT score_id, trim(b, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS k, loaded_at AS t FROM simulated_scores),
f AS (SELECT seq_id, min(added_at) AS first FROM seq_register GROUP BY seq_id),
o AS (SELECT score_id, t, CASE WHEN f.seq_id IS NULL THEN 'missing' WHEN f.first > t THEN 'late' ELSE 'deleted' END AS reason
  FROM r LEFT JOIN f ON f.seq_id = r.k
  WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM seq_register g WHERE g.seq_id = r.k AND g.added_at <= r.t AND (g.deleted_at IS NULL OR r.t < g.deleted_at)))
"""
SQL = {
    "p4_found": _LINES + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p4_loaded": _LINES + "SELECT line_id, b, y FROM r WHERE reason IS NULL",
    "p5_found": _ORPHANS + "SELECT score_id, reason FROM o",
    "p5_report": _ORPHANS + "SELECT 'simulated_scores' AS table_name, date_trunc('month', t) AS period, reason, count(*) AS n FROM o GROUP BY ALL",
}
