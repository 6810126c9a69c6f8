import random
from datetime import datetime, timedelta

import numpy as np
import pytest

import strandwise.operators.references as module
from strandwise.operators.references import Bitmap, _ranges, orphan_references

T0 = datetime(2023, 1, 1)


def brute(refs, parents):
    out = []
    for i, k, t in refs:
        k = (k or "").strip(" \t\r\n ")
        if not k:
            continue
        own = [p for p in parents if p[0] == k]
        if any(a and a <= t and (d is None or t < d) for _, a, d in own):
            continue
        out.append((i, "missing" if not own else "late" if min(a for _, a, _ in own) > t else "deleted"))
    return sorted(out)


@pytest.mark.parametrize(("hot_rows", "lives", "size"), [(100_000, 256, 1 << 15), (3, 256, 1 << 15), (3, 0, 8), (100_000, 1, 16)])
def test_against_brute_force(spark, hot_rows, lives, size, monkeypatch):
    rng = random.Random(4)
    when = lambda: T0 + timedelta(hours=rng.randrange(24 * 120))
    parents = []
    for k in range(30):
        for _ in range(rng.randrange(1, 4)):
            a = when()
            parents.append((f"s{k}", a, None if rng.random() < 0.3 else a + timedelta(hours=rng.randrange(1, 1500))))
    parents += parents[:5]
    refs = [(i, rng.choice([f"s{rng.randrange(34)}", "s1", " s2 ", None, "  "]), when()) for i in range(600)]
    refs += [(1000 + n, p[0], p[1]) for n, p in enumerate(parents)] + [(2000 + n, p[0], p[2]) for n, p in enumerate(parents) if p[2]]
    r = spark.createDataFrame(refs, "score_id long, b string, loaded_at timestamp")
    p = spark.createDataFrame(parents, "seq_id string, added_at timestamp, deleted_at timestamp")
    monkeypatch.setattr(module, "LIVES", lives)
    monkeypatch.setattr(module, "RANGE", size)
    found = module.orphan_references(r, "score_id", "b", "loaded_at", p, "seq_id", "added_at", "deleted_at", hot_rows=hot_rows)
    assert sorted((x.score_id, x.reason) for x in found.collect()) == brute(refs, parents)


def test_edges(spark):
    r = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "a", T0), (3, "a", T0), (4, None, T0)], "score_id long, b string, loaded_at timestamp")
    p = spark.createDataFrame([("a", None, None), (None, T0, None)], "seq_id string, added_at timestamp, deleted_at timestamp")
    args = ("score_id", "b", "loaded_at")
    found = sorted((x.score_id, x.reason) for x in orphan_references(r, *args, p, "seq_id", "added_at", "deleted_at").collect())
    assert found == [(2, "missing"), (3, "deleted"), (3, "deleted")]
    old = spark.createDataFrame([(1, "a", datetime(1950, 5, 5)), (2, "a", datetime(1961, 5, 5)), (3, "b", datetime(1950, 5, 5))], "score_id long, b string, loaded_at timestamp")
    life = spark.createDataFrame([("a", datetime(1960, 1, 1), None)], "seq_id string, added_at timestamp, deleted_at timestamp")
    assert sorted((x.score_id, x.reason) for x in orphan_references(old, *args, life, "seq_id", "added_at", "deleted_at").collect()) == [(1, "late"), (3, "missing")]
    none = orphan_references(r, *args, p.limit(0), "seq_id", "added_at", "deleted_at").collect()
    assert {x.reason for x in none} == {"missing"} and len(none) == 4
    assert orphan_references(r.limit(0), *args, p, "seq_id", "added_at", "deleted_at").count() == 0


def test_bitmaps():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, module.RANGE, n) for n in (0, 1, 500, 2_048, 30_000, 100_000)]
    assert [Bitmap(s).bits is None for s in sets] == [True, True, True, True, False, False]
    for a in sets:
        assert Bitmap(a).decoded().tolist() == sorted(set(a.tolist()))
        for b in sets:
            assert Bitmap(a).and_not(Bitmap(b)).tolist() == sorted(set(a.tolist()) - set(b.tolist()))


def test_ranges_of_keys(monkeypatch):
    """Batches and ranges border anywhere; a key with many rows stays in its range."""
    import pyarrow as pa

    monkeypatch.setattr(module, "RANGE", 4)
    rng = random.Random(2)
    rows = sorted((f"k{k:02}", rng.random() < 0.5, *sorted((rng.randrange(100), rng.randrange(100, 200))), 1) for k in range(23) for _ in range(rng.choice([1, 2, 9])))
    rows = [(k, int(p), a if p else 50, z if p else 120, 0 if p else 1) for k, p, a, z, _ in rows]
    for size in (1, 3, 10, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], names=list("kpazn")) for i in range(0, len(rows), size)]
        got = {r["_key"]: r["_sure"] for b in _ranges(iter(batches)) for r in b.to_pylist()}
        want = {}
        for k in {r[0] for r in rows if not r[1]}:
            near = [r for r in rows if r[0] == k and r[1] and r[2] < 120 and r[3] > 50]
            if not any(r[2] <= 50 and r[3] >= 120 for r in near):
                want[k] = not near
        assert got == want
