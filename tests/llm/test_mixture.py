import random
from fractions import Fraction

from strandwise.llm import mixture
from strandwise.llm.mixture import allot, mix, timetable


def test_allot():
    goal = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 1)}
    assert allot({"a": 100, "b": 30, "c": 100}, goal) == {"a": 100.0, "b": 60.0, "c": 40.0}
    due = allot({"a": 100, "b": 30, "c": 100}, goal, 240)
    assert due["b"] == 60 and due["a"] == 100 and abs(due["c"] - 80) < 1e-9
    assert allot({}, goal) == {}


def within_one_block(rows, due):
    """Blocks (source, block, slot, release, deadline): each in its window, in order, one a slot, every source less than a block off its weight."""
    whole, slots, taken = sum(due.values()), {}, dict.fromkeys(due, 0)
    for s, k, slot, release, deadline in sorted(rows, key=lambda r: r[2]):
        assert release == k * whole // due[s] and deadline == -(-(k + 1) * whole // due[s])
        assert release <= slot < deadline and slot not in slots and taken[s] == k
        slots[slot] = taken[s] = k + 1
        assert all(abs(taken[x] - Fraction(due[x] * (slot + 1), whole)) < 1 or taken[x] == -(-due[x] // BLOCK) for x in due)


BLOCK = 100


def test_timetable():
    rng = random.Random(1)
    for n in (1, 2, 7, 51):
        due = {f"s{k}": rng.choice([1, 250, 4_000, rng.randrange(1, 60_000)]) for k in range(n)}
        rows = timetable(due, {s: -(-d // BLOCK) for s, d in due.items()})
        assert len(rows) == sum(-(-d // BLOCK) for d in due.values())
        within_one_block(rows, due)
    assert timetable({}, {}) == []


def test_one_large_and_fifty_small_sources(spark):
    """Documents of one token against documents of a hundred: every source stays within one block at every turn."""
    rows = [(k, "a", 1) for k in range(20_000)]
    rows += [(100_000 * (s + 1) + k, f"b{s:02}", 100) for s in range(50) for k in range(4)]
    goals = [("a", 0.5, 1)] + [(f"b{s:02}", 0.01, 1) for s in range(50)]
    chosen, shares = mix(spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), spark.createDataFrame(goals, "source string, target_share double, max_repeats int"))
    got = chosen.orderBy("turn").collect()
    assert len(got) == 20_200 and {round(r.reached_share, 9) for r in shares.collect()} == {0.5, 0.01}
    due = {"a": 20_000} | {f"b{s:02}": 400 for s in range(50)}
    within_one_block({(r.source, r.block, r.slot, r.release, r.deadline) for r in got}, due)
    taken, total, off = dict.fromkeys(due, 0), 0, 0.0
    for r in got:
        taken[r.source] += r.n_tokens
        total += r.n_tokens
        off = max(off, *(abs(taken[s] - total * due[s] / 40_000) for s in due))
        assert r.slot >= r.release
    assert off <= BLOCK


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixture, "GROUP_ROWS", 50)
    rng = random.Random(3)
    rows = [(k, rng.choice(["a"] * 6 + ["b", "b", "c", None, "x"]), rng.choice([0, *range(1, 40)])) for k in range(1500)]
    goals = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("none", 0.05, 1)]
    sizes = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, n_tokens long, turn int")
    chosen, shares = mix(sizes, spark.createDataFrame(goals, "source string, target_share double, max_repeats int"))
    got = chosen.orderBy("turn").collect()
    assert [r.turn for r in got] == list(range(len(got))) and got
    size, limit = {r[0]: (r[1], r[2]) for r in rows}, {g[0]: g[2] for g in goals}
    weight = {g[0]: g[1] / 0.95 for g in goals}
    assert all(size[r.doc_id] == (r.source, r.n_tokens) and 1 <= r.use <= limit[r.source] for r in got)
    assert len({(r.doc_id, r.use) for r in got}) == len(got)
    so_far, total = dict.fromkeys(weight, 0), 0
    for r in got:
        so_far[r.source] += r.n_tokens
        total += r.n_tokens
        # A block of 39 tokens, and half a document at its borders.
        assert all(abs(so_far[s] - weight[s] * total) < 39 + 20 for s in ("a", "b", "c"))
        assert r.release <= r.slot < r.deadline
    for r in shares.collect():
        assert r.taken == so_far[r.source] and abs(r.reached_share - r.taken / total) < 1e-9
        assert r.source == "none" or abs(r.reached_share - weight[r.source]) < 40 / total
    first = {}
    for r in got:
        assert r.use == 1 or first.get((r.doc_id, r.use - 1)) is not None
        first[r.doc_id, r.use] = r.turn
    # Larger blocks where there would be too many.
    monkeypatch.setattr(mixture, "MAX_BLOCKS", 10)
    few = mix(sizes, spark.createDataFrame(goals, "source string, target_share double, max_repeats int"))[0]
    assert few.count() == len(got) and few.select("slot").distinct().count() <= 13


def test_empty(spark):
    sizes = spark.createDataFrame([(1, None, 5), (2, "a", 0)], "doc_id long, source string, n_tokens long")
    goals = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mix(sizes, goals)
    assert chosen.count() == 0 and shares.first().reached_share == 0
    assert mix(sizes, goals.limit(0))[0].count() == 0
