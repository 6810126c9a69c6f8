import random

import numpy as np
import pytest

from strandwise.llm import spans
from strandwise.llm.spans import shared_report, shared_spans, window_hashes


def brute(rows, least):
    where = {}
    for b, t in rows:
        for i in range(len(t or "") - least + 1):
            where.setdefault(t[i : i + least], set()).add(b)
    out = []
    for b, t in dict(rows).items():
        hit = [False] * len(t or "")
        for i in range(len(t or "") - least + 1):
            if len(where[t[i : i + least]]) > 1:
                hit[i : i + least] = [True] * least
        i = 0
        while i < len(hit):
            j = i
            while j < len(hit) and hit[j]:
                j += 1
            if j > i:
                out.append((b, i, j))
            i = max(j, i + 1)
    return sorted(out)


@pytest.mark.parametrize(("least", "segment"), [(50, 1 << 16), (50, 75), (7, 9), (2, 3)])
def test_against_brute_force(spark, least, segment):
    rng = random.Random(least)
    word = lambda n: "".join(rng.choice("ACGTN日") for _ in range(n))
    shared = [word(rng.randrange(least - 1, least * 4)) for _ in range(6)]
    rows = [(b, word(rng.randrange(0, 80)) + rng.choice(shared) + word(rng.randrange(0, 40)) + rng.choice(shared)) for b in range(30)]
    rows += [(100 + b, "A" * (60 + b)) for b in range(12)] + [(200, None), (201, ""), (202, "a" * 90), (203, rows[0][1]), (204, "CA" * 60), (205, word(least))]
    found = shared_spans(spark.createDataFrame(rows, "b long, catseq string"), "b", "catseq", least, segment).collect()
    assert sorted(map(tuple, found)) == brute(rows, least)


def test_edges(spark):
    text = "ACGTTGCA" * 10
    schema = "b long, catseq string, h long, wi int, lo long"
    assert shared_spans(spark.createDataFrame([], schema), "b", "catseq", 50).count() == 0
    one = [(1, text[:49] + "x", 0, 0, 0), (1, text[:49] + "x", 0, 0, 0), (None, text[:49] + "x", 0, 0, 0)]
    rows = spark.createDataFrame(one, schema)
    assert shared_spans(rows, "b", "catseq", 50).count() == 0  # repeats of a record and rows without a key aren't other records
    rows = spark.createDataFrame(one + [(2, "y" + text[:49] + "x", 0, 0, 0)], schema)
    runs = shared_spans(rows, "b", "catseq", 50)
    assert sorted(map(tuple, runs.collect())) == [(1, 0, 50), (2, 1, 51)]
    report = {r.b: (r.n_letters, r.n_shared) for r in shared_report(rows, "b", "catseq", runs).collect()}
    assert report == {1: (50, 50), 2: (51, 50)}


def test_hashes_follow_the_letters():
    import numpy as np

    x = np.frombuffer(("abcab" * 40).encode("utf-32-le"), np.uint32)
    for width in (1, 2, 25, 50, 64):
        h = window_hashes(x, width, 7)
        assert len(h) == len(x) - width + 1 and (h[:-5] == h[5:]).all() and len(set(h.tolist())) == len({bytes(x[k : k + width]) for k in range(len(h))})


def test_long_records_and_one_letter(spark):
    """A record of ten million letters that holds two others, and records of one letter only."""
    rng = np.random.default_rng(1)
    long = "".join(np.array(list("ACGT"))[rng.integers(0, 4, 10_000_000)])
    rows = [(0, long), (1, "NN" + long[65_500:65_700] + "N"), (2, long[9_999_900:]), (3, "A" * 30_000), (4, "A" * 70_001), (5, "A" * 40)]
    found = shared_spans(spark.createDataFrame(rows, "b long, catseq string"), "b", "catseq", 50).collect()
    assert sorted(map(tuple, found)) == [(0, 65_500, 65_700), (0, 9_999_900, 10_000_000), (1, 2, 202), (2, 0, 100), (3, 0, 30_000), (4, 0, 70_001)]


def test_filter_loses_nothing(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**63), 2**63, 5_000)
    anchors = spark.createDataFrame([(int(x), 1, 1 + k % 2) for k, x in enumerate(h)], "h long, lo long, hi long")
    other = rng.integers(-(2**63), 2**63, 20_000)
    for bitmap, inside in zip(spans._filters(anchors), (h, h[1::2])):
        assert spans._holds(bitmap, inside).all() and spans._holds(bitmap, other).mean() < 0.05
    assert spans._holds(spans._filters(anchors)[1], h[::2]).mean() < 0.05
