import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandwise.llm import frequency
from strandwise.llm.frequency import BurstTrie, nodes, packed, route, term_frequencies, unpacked


def filled(rng, n, capacity=8, prefix=""):
    trie, want = BurstTrie(capacity, prefix), Counter()
    for _ in range(n):
        t = prefix + "".join(rng.choice("AB") for _ in range(rng.randrange(6)))
        trie.add(t, 2, 1)
        want[t] += 1
    return trie, want


def counted(trie):
    return {n.prefix + s: (c[0], c[1]) for n in nodes(trie.root) for s, c in n.terms.items()}


def test_trie_keeps_every_count():
    trie, want = filled(random.Random(2), 3000)
    assert counted(trie) == {t: (2 * n, n) for t, n in want.items()} and trie.terms == len(want)
    assert any(n.children for n in nodes(trie.root)) and trie.root.weight == 6000


@pytest.mark.parametrize("seed", range(8))
def test_subtrees_merge_node_by_node(seed):
    rng = random.Random(seed)
    trie, want = filled(rng, rng.choice([1, 5, 60, 900]), rng.choice([1, 4, 50]), "X")
    for n in (3, 400):
        other, more = filled(rng, n, rng.choice([1, 4, 50]), "X")
        assert counted(unpacked(packed(other), "X")) == counted(other)
        trie.merge(unpacked(packed(other), "X"))
        want += more
        assert counted(trie) == {t: (2 * k, k) for t, k in want.items()}
        assert trie.terms == len(want) and trie.root.weight == 2 * sum(want.values())
        assert all(n.weight == sum(c.weight for c in n.children.values()) for n in nodes(trie.root) if n.children)


def test_routes():
    assert [route(t, {"", "A", "AB"}) for t in ("", "A", "AC", "ABA", "B")] == ["", "A", "AC", "ABA", "B"]
    assert route("ABA", set()) == ""


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for k in range(4000):
        term = rng.choice(["HOT"] * 3 + ["".join(rng.choice("ACG") for _ in range(rng.randrange(1, 5))), None, ""])
        rows.append((k, term, rng.choice([f"b{rng.randrange(40)}", None, "one"])))
    rows += [(10_000 + k, "PAIR", "one") for k in range(1500)] + [(None, "HOT", "b1")] * 3 + [(20_000, "long" * 3000, "b2")]
    rows += rows[:300]
    df = spark.createDataFrame([(*r, "x") for r in rows], "peak_id long, kmer string, block string, route string").repartition(6)
    monkeypatch.setattr(frequency, "SUBTREE_TERMS", 5)
    n, blocks = Counter(), defaultdict(set)
    for k, t, b in set(rows):
        if t:
            n[t] += 1
            blocks[t] |= {b} - {None}
    total = len({b for _, _, b in rows if b})
    mark = lambda c: "rare" if c < 3 else "common" if c > total / 20 else None
    want = {t: (n[t], len(blocks[t]), mark(len(blocks[t]))) for t in n}
    found = term_frequencies(df, "peak_id", F.col("kmer"), "block").collect()
    assert {r.term: (r.n_rows, r.n_records, r.mark) for r in found} == want and len(found) == len(want)


def test_weights(spark):
    rows = [("HOT", "one")] * 400 + [("HOT", f"r{k}") for k in range(100)] + [(f"A{k % 7}{k}", None) for k in range(300)] + [(None, "none")]
    got = {(r.kind, r.a, r.b): r.n for r in frequency.weights(spark.createDataFrame(rows, "term string, record string").coalesce(1), 50).collect()}
    assert got["prefix", "", None] == 800 and got["prefix", "A", None] == 300 and got["term", "HOT", None] == 500 and got["pair", "HOT", "one"] == 400
    assert sum(k == "record" for k, _, _ in got) == 102


def test_empty(spark):
    df = spark.createDataFrame([], "peak_id long, kmer string, block string, n long, route string")
    assert term_frequencies(df, "peak_id", F.col("kmer"), "block").count() == 0
