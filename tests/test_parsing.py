import pytest

from strandwise.operators.parsing import failed_lines, good_scores, parse_record, parse_scores


@pytest.mark.parametrize(
    "line, out",
    [
        ("a\t1", ("a", 1.0, None)), ("a\t1\r", ("a", 1.0, None)), ('"a\tx"\t"2."', ("a\tx", 2.0, None)), ('"a""b"\t.5', ('a"b', 0.5, None)), ("a\t -1e-3 ", ("a", -0.001, None)), (" a \t+5.", (" a ", 5.0, None)),
        ('"a\t1', (None, None, "quoting")), ('"a"x\t1', (None, None, "quoting")), ('a"b\t1', (None, None, "quoting")), (' "a"\t1', (None, None, "quoting")), ('"', (None, None, "quoting")),
        ("", (None, None, "columns")), (None, (None, None, "columns")), ("a", (None, None, "columns")), ("a\t1\t", (None, None, "columns")), ('a"\t1\t2', (None, None, "quoting")),
        ("\t1", (None, None, "value")), ("  \t1", (None, None, "value")), ("a\t", (None, None, "value")), ("a\tnan", (None, None, "value")), ("a\t1e999", (None, None, "value")), ("a\t1,5", (None, None, "value")),
        ("a\t1\r\r", (None, None, "value")), ("a\t١", (None, None, "value")), ("a\t.", (None, None, "value")), ("a\t 1", (None, None, "value")), ("a\nb\t1", ("a\nb", 1.0, None)), ("b\ty", (None, None, "value")),
    ],
)
def test_records(line, out):
    assert parse_record(line) == out


def test_long_line():
    assert parse_record("x" * 300_000 + "\t1")[2] is None


def test_table(spark):
    rows = spark.createDataFrame([(1, "a\t1", "z"), (1, "a\t1", "z"), (None, "a", "z"), (3, None, None)], "line_id long, line string, reason string")
    parsed = parse_scores(rows)
    assert sorted(map(tuple, good_scores(parsed).collect())) == [(1, "a", 1.0), (1, "a", 1.0)]
    assert {tuple(r) for r in failed_lines(parsed).collect()} == {(None, "columns"), (3, "columns")}
    assert parse_scores(rows.limit(0)).count() == 0
