"""Occurrences and records of every distinct term, counted in burst tries."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.runtime import cut, partitions

#: Distinct terms that a task's trie holds before it hands them on and starts anew: while prefixes are weighed, and in a subtree that is sent.
TRIE_TERMS, SUBTREE_TERMS = 200_000, 50_000
#: Routes per shuffle partition, and terms of a leaf of a subtree before it bursts.
ROUTES, LEAF_TERMS = 4, 64
#: Pairs of term and record that a task watches for hot ones.
PAIRS = 100_000


class BurstTrie:
    """Terms under shared prefixes, each with its occurrences and records. A leaf keeps suffixes in a small table; above its capacity it bursts into one leaf for each next letter.

    ``weigh``: leaves burst by their occurrences rather than by their terms.
    """

    __slots__ = ("capacity", "root", "terms", "weigh")

    def __init__(self, capacity: int, prefix: str = "", weigh: bool = False):
        self.capacity, self.root, self.terms, self.weigh = capacity, Node(prefix), 0, weigh

    def add(self, term: str, rows: int, records: int = 0) -> None:
        self._put(self.root, term, rows, records)

    def _put(self, node: Node, term: str, rows: int, records: int) -> None:
        while node.children is not None:
            node.weight += rows
            node = node.child(term[len(node.prefix) : len(node.prefix) + 1])
        node.weight += rows
        suffix = term[len(node.prefix) :]
        counts = node.terms.get(suffix)
        if counts is None:
            node.terms[suffix] = [rows, records]
            self.terms += 1
        else:
            counts[0] += rows
            counts[1] += records
        if not node.ends and len(node.terms) > 1 and (node.weight if self.weigh else len(node.terms)) > self.capacity:
            node.burst()

    def merge(self, other: BurstTrie) -> None:
        """Take over another trie's counts, node by node; both begin at the same prefix."""
        todo = [(self.root, other.root)]
        while todo:
            mine, its = todo.pop()
            if its.children is None:
                for suffix, (rows, records) in its.terms.items():
                    self._put(mine, its.prefix + suffix, rows, records)
                continue
            if mine.children is None:
                mine.burst()
            mine.weight += its.weight
            for letter, node in its.children.items():
                if letter in mine.children:
                    todo.append((mine.children[letter], node))
                else:
                    mine.children[letter] = node
                    self.terms += sum(len(n.terms) for n in nodes(node))


class Node:
    __slots__ = ("prefix", "ends", "weight", "terms", "children")

    def __init__(self, prefix: str, ends: bool = False):
        self.prefix, self.ends, self.weight, self.terms, self.children = prefix, ends, 0, {}, None

    def child(self, letter: str) -> Node:
        node = self.children.get(letter)
        if node is None:
            node = self.children[letter] = Node(self.prefix + letter, ends=not letter)
        return node

    def burst(self) -> None:
        self.children = {}
        for suffix, counts in self.terms.items():
            node = self.child(suffix[:1])
            node.terms[suffix[1:]] = counts
            node.weight += counts[0]
        self.terms = {}


def nodes(root: Node) -> Iterator[Node]:
    """All nodes, parents first, by letter."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        if node.children is not None:
            todo.extend(node.children[c] for c in sorted(node.children, reverse=True))


LEAVES = "leaves array<struct<prefix:string,suffixes:array<string>,n_rows:array<bigint>,n_records:array<bigint>>>"
_LEAF = pa.struct([("prefix", pa.string()), ("suffixes", pa.list_(pa.string())), ("n_rows", pa.list_(pa.int64())), ("n_records", pa.list_(pa.int64()))])


def packed(trie: BurstTrie) -> list[dict]:
    """A trie as its leaves."""
    return [{"prefix": n.prefix, "suffixes": list(n.terms), "n_rows": [c[0] for c in n.terms.values()], "n_records": [c[1] for c in n.terms.values()]} for n in nodes(trie.root) if n.terms]


def unpacked(leaves: list[dict], prefix: str) -> BurstTrie:
    """The trie of these leaves: every node as it was."""
    trie = BurstTrie(LEAF_TERMS, prefix)
    for leaf in leaves:
        node, whole = trie.root, sum(leaf["n_rows"])
        node.weight += whole
        for k in range(len(prefix), len(leaf["prefix"])):
            if node.children is None:
                node.burst()
            node = node.child(leaf["prefix"][k])
            node.weight += whole
        if node.children is not None:  # the leaf of the term that ends here
            node = node.child("")
            node.weight += whole
        node.terms = {s: [r, c] for s, r, c in zip(leaf["suffixes"], leaf["n_rows"], leaf["n_records"])}
        trie.terms += len(node.terms)
    return trie


def weights(rows: DataFrame, local: int) -> DataFrame:
    """``(kind, a, b, n)``, in one pass: the weight of prefixes and of single terms, pairs of term and record that are frequent somewhere, and every record.

    Each task bursts its own trie over all its rows and tells every node above ``local`` rows, so a prefix lacks at most ``local`` rows for each trie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, records, pairs = BurstTrie(local, weigh=True), set(), {}

        def told() -> pa.RecordBatch:
            out = []
            for node in nodes(trie.root):
                if node.children is not None:
                    out.append(("prefix", node.prefix, None, node.weight))
                out.extend(("term", node.prefix + s, None, c[0]) for s, c in node.terms.items() if c[0] > local)
            out.extend(("pair", t, r, n) for (t, r), n in pairs.items() if n > local)
            out.extend(("record", r, None, 1) for r in records)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["kind", "a", "b", "n"])

        for batch in batches:
            terms, seen = batch.column(0), batch.column(1)
            records.update(pc.unique(seen).drop_null().to_pylist())
            kept = pa.Table.from_batches([batch]).filter(pc.fill_null(pc.not_equal(terms, ""), False))
            for x in pc.value_counts(kept.column(0)).to_pylist():
                trie.add(x["values"], x["counts"])
            met = kept.filter(pc.is_valid(kept.column(1))).group_by(["term", "record"]).aggregate([([], "count_all")])
            met = met.filter(pc.greater_equal(met.column("count_all"), 8))
            for t, r, n in zip(*(met.column(c).to_pylist() for c in ("term", "record", "count_all"))):
                pairs[t, r] = pairs.get((t, r), 0) + n
            if max(trie.terms, len(records)) > TRIE_TERMS or len(pairs) > PAIRS:
                yield told()
                trie, records, pairs = BurstTrie(local, weigh=True), set(), {}
        yield told()

    return rows.select("term", "record").mapInArrow(run, "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def route(term: str, prefixes: set[str]) -> str:
    """The shortest prefix of a term that isn't too heavy."""
    k = 0
    while k < len(term) and term[:k] in prefixes:
        k += 1
    return term[:k]


def _routed(rows: DataFrame, plan) -> DataFrame:
    """Adds route and salt. Rows of a hot term are dealt by record, those without a record and those of a hot pair by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, hot, pairs = plan.value
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            terms = coded.dictionary.to_pylist()
            salts = np.zeros(batch.num_rows, np.int32)
            many = np.array([hot.get(t, 1) for t in terms])[coded.indices.to_numpy(zero_copy_only=False)] if terms else salts
            for k in np.flatnonzero(many > 1).tolist():
                key, term, record = (c[k].as_py() for c in batch.columns)
                by = repr(key) if record is None or (term, record) in pairs else record
                salts[k] = crc32(by.encode("utf-8", "replace")) % int(many[k])
            routes = pa.array([route(t, prefixes) for t in terms], pa.string()).take(coded.indices)
            yield pa.RecordBatch.from_arrays([*batch.columns, routes, pa.array(salts)], names=["key", "term", "record", "route", "salt"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", route string, salt int")


def _fresh(columns: list[pa.Array], last: list | None) -> np.ndarray:
    """Where a row differs from the one before, the first from ``last``; nulls are equal."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[0] = last is None or any(c[0].as_py() != x for c, x in zip(columns, last))
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def _subtrees(ordered: DataFrame, plan) -> DataFrame:
    """``(route, leaves)``: the trie of each route that a task holds, from rows in the order of route, term, record and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = plan.value[2]
        trie, at, last = None, None, None

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([packed(trie)], pa.list_(_LEAF))], names=["route", "leaves"])

        for batch in batches:
            if not batch.num_rows:
                continue
            routes, term, record, key = batch.columns
            new_term = _fresh([term], last and last[:1])
            new_pair = new_term | _fresh([record], last and last[1:2])
            new_key = new_pair | _fresh([key], last and last[2:])
            counted = new_pair & record.is_valid().to_numpy(zero_copy_only=False)
            if pairs:
                some = np.flatnonzero(counted)
                counted[some] = [(t, r) not in pairs for t, r in zip(term.take(pa.array(some)).to_pylist(), record.take(pa.array(some)).to_pylist())]
            new_term[0] = True
            begin = np.flatnonzero(new_term)
            n_rows, n_records = np.add.reduceat(new_key.astype(np.int64), begin).tolist(), np.add.reduceat(counted.astype(np.int64), begin).tolist()
            begin = pa.array(begin)
            for r, t, n, m in zip(routes.take(begin).to_pylist(), term.take(begin).to_pylist(), n_rows, n_records):
                if r != at or trie.terms >= SUBTREE_TERMS:
                    if trie is not None:
                        yield sent()
                    trie, at = BurstTrie(LEAF_TERMS, r), r
                trie.add(t, n, m)
            last = [c[batch.num_rows - 1].as_py() for c in (term, record, key)]
        if trie is not None:
            yield sent()

    return ordered.select("route", "term", "record", "key").mapInArrow(run, f"route string, {LEAVES}")


def _merged(group: pa.Table) -> pa.Table:
    """The counts of one route: its subtrees of all workers, merged node by node."""
    where, subtrees = group["route"][0].as_py(), group["leaves"].to_pylist()
    if len(subtrees) > 1:
        trie = unpacked(subtrees[0], where)
        for leaves in subtrees[1:]:
            trie.merge(unpacked(leaves, where))
        subtrees = [packed(trie)]
    leaves = subtrees[0]
    terms = [x["prefix"] + s for x in leaves for s in x["suffixes"]]
    return pa.table({"term": pa.array(terms, pa.string()), "n_rows": pa.array([n for x in leaves for n in x["n_rows"]], pa.int64()), "n_records": pa.array([n for x in leaves for n in x["n_records"]], pa.int64())})


def term_frequencies(rows: DataFrame, key: str, term: F.Column, record: str, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """``(term, n_rows BIGINT, n_records BIGINT, mark STRING)`` for every distinct non-null value of ``term``.

    ``n_rows`` counts distinct rows by ``key``: repeated deliveries of a key with equal term and record count once. ``n_records`` counts
    distinct non-null records. ``mark`` is ``rare`` below ``rare_below`` records, else ``common`` above the share ``common_above`` of all
    distinct non-null records of the table (rows without a term included), else null.

    Two passes over the rows. The first weighs prefixes in tries; the second sends each row along the shortest prefix that isn't too heavy, and each
    task counts what came, in order, in a trie for each route. Tries travel as one row each, and those of one route from several workers are merged node by
    node: a term that alone is too heavy goes to several workers, dealt by record, so that its records add up; a pair of term and record that alone is
    too heavy is dealt by key and counted as a record once, at the end.
    A null or empty term isn't counted; a null record counts as occurrence only; rows with a null key count as one for each (term, record).
    An empty table gives no rows. Long terms are kept whole. Other columns are ignored.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(key).alias("key"), term.alias("term"), F.col(record).cast("string").alias("record"))
    parts = partitions(spark)
    total = rows.count()
    capacity = max(1, total // (parts * ROUTES))
    tries = rows.rdd.getNumPartitions() + total // TRIE_TERMS
    weighed = cut(weights(rows, max(16, capacity // (2 * tries))))
    n_records = weighed.where("kind = 'record'").count()
    heavy: dict[str, dict] = {"prefix": {}, "term": {}, "pair": {}}
    for r in weighed.where((F.col("kind") != "record") & (F.col("n") > capacity)).collect():
        heavy[r.kind][r.a if r.kind != "pair" else (r.a, r.b)] = r.n
    hot = {t: -(-n // capacity) for t, n in heavy["term"].items()}
    pairs = {p for p in heavy["pair"] if p[0] in hot}
    plan = spark.sparkContext.broadcast((set(heavy["prefix"]), hot, pairs))

    routed = _routed(rows.where("term <> ''"), plan).repartition(parts, "route", "salt").sortWithinPartitions("route", "term", "record", "key")
    counts = _subtrees(routed, plan).groupBy("route").applyInArrow(_merged, "term string, n_rows bigint, n_records bigint")
    dealt: dict[str, int] = {}
    for t, _ in pairs:
        dealt[t] = dealt.get(t, 0) + 1
    if dealt:
        more = spark.createDataFrame(list(dealt.items()), "term string, _more bigint")
        counts = counts.join(F.broadcast(more), "term", "left").select("term", "n_rows", (F.col("n_records") + F.coalesce("_more", F.lit(0))).alias("n_records"))
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_above * n_records, "common")
    return counts.withColumn("mark", mark)
