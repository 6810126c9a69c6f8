"""Abusive, hateful or sexual passages, tagged by a linear-chain conditional random field."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.llm.tokens import text_runs

#: Labelled documents of either kind that a model is fitted on, at most.
MAX_LABELLED = 1_500
#: Hashed features of each place (the word itself and two neighbours on either side).
BITS = 18
PLACES = (0, -1, 1, -2, 2)
#: Sentences alike that a model is fitted on.
COPIES = 6
MEMO_PIECES, MEMO_LETTERS = 200_000, 8_000_000

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKE = str.maketrans("аеорсухіјѕԁһкмтвнαορνικτ", "aeopcyxijsdhkmtbhaopvikt")
STAND_IN = str.maketrans("0134578@$!", "oieastbasi")

CJK = "぀-ヿ㐀-鿿가-힯"
WORD = re.compile(rf"[{CJK}]|[^\W_{CJK}*][^\W_{CJK}]*(?:[*@$!][^\W_{CJK}*@$!]+|\*+)*")
SPELLED = re.compile(r"\W*(?:[^\W_][^\w\s]){2,}[^\W_]\W*")
NUMERAL = re.compile(r"[a-z]{0,2}[0-9]+[a-z]?")
DOUBLE = re.compile(r"(.)\1+")
LAST = re.compile(r"[.!?。！？…][\"'”’)\]>]*(?:</\w+>)?$|[。！？]")
#: Ends of sentences that no space follows.
STOP = re.compile(r"(?<=[。！？])(?=[^\s。！？\"'”’)\]>」』）])")


def words_of(piece: str) -> list[str]:
    """The words of a text without white space, written alike: folded, without accents and invisible signs, look-alikes and digits back to letters,
    letters spelled apart joined, repeated letters once, numerals as 0; ideographs and kana are words of their own."""
    if piece.isascii() and piece.isalpha():
        return [DOUBLE.sub(r"\1", piece.lower())]
    text = unicodedata.normalize("NFKD", piece).casefold()
    text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Mn"))
    text = unicodedata.normalize("NFC", text.translate(LOOK_ALIKE))
    if SPELLED.fullmatch(text):
        text = re.sub(r"[\W_]", "", text)
    out = []
    for word in WORD.findall(text):
        if any("0" <= c <= "9" for c in word):
            if NUMERAL.fullmatch(word):
                out.append("0")
                continue
            word = word.translate(STAND_IN)
        elif not word.isalnum():
            word = word.translate(STAND_IN)
        out.append(DOUBLE.sub(r"\1", word))
    return out


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def features(word: str) -> list[int]:
    """Of a word at its own place: itself, that it is a word, and its letter triples. At neighbours' places only the first counts."""
    edge = f"<{word}>"
    return [_hash(word), _hash("any word"), *(_hash(f"3{edge[k : k + 3]}") for k in range(len(edge) - 2) if len(word) > 3)]


class Pieces(dict):
    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, piece):
        code = self[piece] = len(self)
        self.fresh.append(piece)
        return code


class Reader:
    """Texts as word codes with chain borders. Pieces and words met before are remembered, with what the model says of them."""

    def __init__(self, theta: np.ndarray | None = None):
        self.theta = theta
        self.forget()

    def forget(self) -> None:
        self.pieces, self.letters, self.words = Pieces(), 0, {}
        self.lists: list[list[str]] = []
        self.at, self.n, self.single, self.last = (np.zeros(1024, t) for t in (np.int64, np.int64, bool, bool))
        self.flat, self.used = np.zeros(4096, np.int64), 0
        self.scores = np.zeros((4096, len(PLACES)), np.float32)  # row 0: no word

    def _word(self, word: str) -> int:
        code = self.words.get(word)
        if code is None:
            code = self.words[word] = len(self.words) + 1
            if self.theta is not None:
                if code >= len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                f = features(word)
                self.scores[code] = self.theta[:, f[0]]
                self.scores[code, 0] = self.theta[0, f].sum()
        return code

    def _learn(self) -> None:
        fresh, self.pieces.fresh = self.pieces.fresh, []
        if not fresh:
            return
        lists = [[self._word(w) for w in words_of(p)] for p in fresh]
        size, new = len(self.pieces), [c for x in lists for c in x]
        if size > len(self.at):
            self.at, self.n, self.single, self.last = (np.concatenate([x, np.zeros(size, x.dtype)]) for x in (self.at, self.n, self.single, self.last))
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(new), np.int64)])
        n = np.array([len(x) for x in lists], np.int64)
        here = slice(size - len(fresh), size)
        self.flat[self.used : self.used + len(new)] = new
        self.at[here], self.n[here] = self.used + np.cumsum(n) - n, n
        self.single[here] = [len(p) == 1 and p.isalpha() and len(x) == 1 and p < "぀" for p, x in zip(fresh, lists)]
        self.last[here] = [bool(LAST.search(p)) for p in fresh]
        self.used += len(new)
        self.letters += sum(map(len, fresh))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """(word codes, text of each, chain of each, pieces of each text)."""
        if len(self.pieces) > MEMO_PIECES or self.letters > MEMO_LETTERS:
            self.forget()
        parts = [STOP.sub(" ", t or "").split() for t in texts]
        get = self.pieces.__getitem__
        code: list[int] = []
        for p in parts:
            code.extend(map(get, p))
        self._learn()
        codes = np.array(code, np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        alone = self.single[codes]
        if len(alone) > 3 and (spelled := np.unique(owner[1:-1][alone[:-2] & alone[1:-1] & alone[2:]])).size:
            for k in spelled:
                parts[k] = joined(parts[k])
            code = []
            for p in parts:
                code.extend(map(get, p))
            self._learn()
            codes = np.array(code, np.int64)
            owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        n = self.n[codes]
        ends = np.cumsum(n)
        words = self.flat[np.repeat(self.at[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        owner_of = np.repeat(owner, n)
        cut = np.zeros(len(codes), bool)
        if len(codes):
            cut[1:] = self.last[codes[:-1]] | (owner[1:] != owner[:-1])
        chain = np.repeat(np.cumsum(cut), n)
        return words, owner_of, chain, parts


def joined(parts: list[str]) -> list[str]:
    """Runs of three or more single letters as one piece, its spaces kept so that it still has its length."""
    out, run = [], []
    for p in [*parts, ""]:
        if len(p) == 1 and p.isalpha() and p < "぀":
            run.append(p)
            continue
        out.extend([" ".join(run)] if len(run) > 2 else run)
        run = []
        if p:
            out.append(p)
    return out


def neighbours(words: np.ndarray, chain: np.ndarray) -> list[np.ndarray]:
    """For each place the word code there, 0 beyond the chain."""
    out = [words]
    for d in PLACES[1:]:
        other = np.zeros_like(words)
        if len(words) > abs(d):
            a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
            same = chain[a] == chain[b]
            other[a] = np.where(same, words[b], 0)
        out.append(other)
    return out


class Chains:
    """Chains of words, laid out so that the words at one place of all chains lie together and a step handles them at once."""

    def __init__(self, chain: np.ndarray):
        begin = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]]) if len(chain) else np.zeros(0, np.int64)
        size = np.diff(np.r_[begin, len(chain)])
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        self.active = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) if len(size) else 0)]
        self.at = np.cumsum([0, *self.active])
        self.order = np.concatenate([begin[:m] + t for t, m in enumerate(self.active)]) if self.active else begin

    def marginals(self, e: np.ndarray, a: np.ndarray, pairs: bool = False):
        """Forward-backward in log-odds of the two tags; e: log-odds of each word, a: 2 x 2 transition scores.

        With ``pairs`` also the expected number of each pair of tags.
        """
        x = np.exp(a).astype(np.float32)
        e = np.clip(e[self.order], -30, 30).astype(np.float32)
        fwd, bwd, at = e.copy(), np.zeros_like(e), self.at
        for t in range(1, len(self.active)):
            here, before = slice(at[t], at[t + 1]), slice(at[t - 1], at[t - 1] + self.active[t])
            r = np.exp(np.clip(fwd[before], -30, 30))
            fwd[here] += np.log((x[0, 1] + r * x[1, 1]) / (x[0, 0] + r * x[1, 0]))
        for t in range(len(self.active) - 1, 0, -1):
            here, before = slice(at[t], at[t + 1]), slice(at[t - 1], at[t - 1] + self.active[t])
            r = np.exp(np.clip(e[here] + bwd[here], -30, 30))
            bwd[before] = np.log((x[1, 0] + r * x[1, 1]) / (x[0, 0] + r * x[0, 1]))
        p = np.empty(len(e))
        p[self.order] = 1 / (1 + np.exp(-np.clip(fwd + bwd, -30, 30)))
        if not pairs:
            return p
        before = np.concatenate([np.arange(at[t - 1], at[t - 1] + m) for t, m in enumerate(self.active) if t] or [np.zeros(0, np.int64)])
        here = slice(at[1] if len(at) > 1 else 0, None)
        l, r = np.exp(np.clip(fwd[before], -30, 30)), np.exp(np.clip(e[here] + bwd[here], -30, 30))
        w = np.stack([np.full(len(l), x[0, 0]), x[0, 1] * r, l * x[1, 0], l * x[1, 1] * r])
        return p, (w / w.sum(0)).sum(1, dtype=np.float64).reshape(2, 2)


class Model:
    """theta: weight of each hashed feature at each place; a: transitions."""

    def __init__(self, theta: np.ndarray, a: np.ndarray):
        self.theta, self.a = theta, a


def seed_labels(words: np.ndarray, owner: np.ndarray, chain: np.ndarray, bad: np.ndarray, n_words: int) -> np.ndarray:
    """First token labels from document labels: sentences of bad documents rich in words that clean documents lack, from the first to the last such word."""
    pairs = np.unique(owner * (n_words + 1) + words)
    docs, word = pairs // (n_words + 1), pairs % (n_words + 1)
    t = np.bincount(word[bad[docs]], minlength=n_words + 1)
    c = np.bincount(word[~bad[docs]], minlength=n_words + 1)
    odds = (np.log((t + 1) / (bad.sum() + 2)) - np.log((c + 1) / ((~bad).sum() + 2))) * t / (t + 2)
    w = odds[words]
    hits, rich = w > 0.7, np.bincount(chain, np.clip(w, -1, 3)) / np.bincount(chain)
    many = np.bincount(chain, hits)
    good = (rich > 0.6) & (many >= 2)
    first = np.r_[True, chain[1:] != chain[:-1]]
    owner_of = owner[first]
    lone = bad & ~np.isin(np.arange(len(bad)), owner_of[good])  # no sentence stands out: the best one
    if lone.any():
        score = np.where(lone[owner_of], rich, -np.inf)
        order = np.lexsort((score, owner_of))
        best = order[np.r_[owner_of[order][1:] != owner_of[order][:-1], True]]
        good[best[lone[owner_of[best]] & (score[best] > 0.3)]] = True
    good &= bad[owner_of]
    at = np.arange(len(words))
    lo, hi = np.full(len(rich), len(words)), np.full(len(rich), -1)
    np.minimum.at(lo, chain[hits], at[hits])
    np.maximum.at(hi, chain[hits], at[hits])
    return (good[chain] & (at >= lo[chain]) & (at <= hi[chain])).astype(np.float64)


def fit(texts: list[str], bad: list[bool], rounds: int = 2, steps: int = 30, rate: float = 0.2, l2: float = 0.3) -> Model:
    """A model from documents labelled as a whole. Token labels start from ``seed_labels``; each further round takes the model's own tags in bad documents. Without both kinds of label it tags nothing."""
    empty = Model(np.zeros((len(PLACES), 1 << BITS), np.float32), np.zeros((2, 2)))
    bad_docs = np.array(bad, bool)
    if not len(bad_docs) or bad_docs.all() or not bad_docs.any():
        empty.theta[:] = 0
        empty.a[:, 1] = -20
        return empty
    reader = Reader()
    words, owner, chain, _ = reader.read(texts)
    if not len(words):
        empty.a[:, 1] = -20
        return empty
    n_words = len(reader.words)
    # Of sentences that are alike but for numbers a few are enough.
    chain = np.unique(chain, return_inverse=True)[1]
    first = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    y = seed_labels(words, owner, chain, bad_docs, n_words)
    sums = np.add.reduceat((words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x5851F42D4C957F2D)) * (np.arange(len(words)) - first[chain] + 1).astype(np.uint64), first)
    order = np.argsort(sums, kind="stable")
    begin = np.flatnonzero(np.r_[True, np.diff(sums[order]) != 0])
    unique = np.zeros(len(first), bool)
    unique[order] = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)])) < COPIES
    keep = unique[chain] | (y > 0)
    words, owner, chain, y = words[keep], owner[keep], np.unique(chain[keep], return_inverse=True)[1], y[keep]
    places, chains, inner = neighbours(words, chain), Chains(chain), chain[1:] == chain[:-1]
    listed = [[], *(features(w) for w in reader.words)]
    sizes = np.array([len(x) for x in listed])
    flat, word_of = np.array([f for x in listed for f in x], np.int64), np.repeat(np.arange(len(listed)), sizes)
    own = np.array([x[0] if x else 0 for x in listed])
    theta, a = np.zeros((len(PLACES), 1 << BITS)), np.zeros((2, 2))
    a[0, 1] = -2.0
    for turn in range(rounds):
        m, v, ma, va = np.zeros_like(theta), np.zeros_like(theta), np.zeros((2, 2)), np.zeros((2, 2))
        for step in range(1, steps + 1):
            table = np.zeros((len(PLACES), len(listed)))
            table[0] = np.bincount(word_of, theta[0, flat], minlength=len(listed))
            table[1:] = theta[1:][:, own]
            table[:, 0] = 0
            p, expected = chains.marginals(sum(table[k][places[k]] for k in range(len(PLACES))), a, pairs=True)
            diff = y - p
            grad = -l2 / 10 * theta
            per_word = np.bincount(places[0], diff, minlength=len(listed))
            grad[0] += np.bincount(flat, per_word[word_of], minlength=1 << BITS)
            for k in range(1, len(PLACES)):
                g = np.bincount(places[k], diff, minlength=len(listed))
                g[0] = 0
                grad[k] += np.bincount(own, g, minlength=1 << BITS)
            tag = y.astype(np.int64)
            seen = np.bincount(2 * tag[:-1][inner] + tag[1:][inner], minlength=4).reshape(2, 2)
            ga = seen - expected - 0.1 * a
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            ma, va = 0.9 * ma + 0.1 * ga, 0.99 * va + 0.01 * ga**2
            theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
            a += rate * (ma / (1 - 0.9**step)) / (np.sqrt(va / (1 - 0.99**step)) + 1e-3)
        if turn + 1 < rounds:
            y = ((p > 0.5) & bad_docs[owner]).astype(np.float64)
    return Model(theta.astype(np.float32), a)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model.theta)

    def score(self, texts: list[str | None], threshold: float) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """(score of each text, offending spans in code points). The score is the highest mean of the marginals of a word and its neighbours in the chain, as many as there are."""
        words, owner, chain, parts = self.reader.read(texts)
        scores = np.zeros(len(texts))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(words):
            return scores, spans
        places = neighbours(words, chain)
        p = Chains(chain).marginals(sum(self.reader.scores[:, k][x] for k, x in enumerate(places)).astype(np.float64), self.model.a)
        same = np.r_[chain[1:] == chain[:-1], False]
        right = np.where(same, np.r_[p[1:], 0], 0)
        left = np.where(np.r_[False, same[:-1]], np.r_[0, p[:-1]], 0)
        np.maximum.at(scores, owner, (left + p + right) / (1 + same + np.r_[False, same[:-1]]))
        for k in np.flatnonzero(scores >= threshold):
            spans[k] = self._spans(texts[k], parts[k], p[np.searchsorted(owner, k) : np.searchsorted(owner, k, side="right")])
        return scores, spans

    def _spans(self, text: str, parts: list[str], p: np.ndarray) -> list[tuple[int, int]]:
        out, at, word, open_ = [], 0, 0, False
        for piece in parts:
            begin = text.find(piece, at)
            begin = at if begin < 0 else begin
            at = begin + len(piece)
            n = int(self.reader.n[self.reader.pieces[piece]])
            if n and p[word : word + n].max() > 0.5:
                if open_:
                    out[-1] = (out[-1][0], at)
                else:
                    out.append((begin, at))
                open_ = True
            elif n:
                open_ = False
            word += n
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, clean: str, limit: int) -> tuple[list[str], list[bool]]:
    """Labelled documents, whole, at most ``limit`` of either kind: those with the smallest hash of the key. Documents with differing labels count as bad; of repeated ones the greatest text counts."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max((F.col(label) != clean).cast("int")).alias("_bad"))
    of = lambda bad: known.where(F.col("_bad") == bad).orderBy(F.xxhash64(key, F.lit(1)), key).limit(limit)
    rows = docs.select(key, F.col(text).alias("_text")).where("_text is not null").join(F.broadcast(of(1).union(of(0))), key).groupBy(key).agg(F.max("_text").alias("_text"), F.max("_bad").alias("_bad")).collect()
    rows.sort(key=lambda r: r[0])
    return [r._text for r in rows], [bool(r._bad) for r in rows]


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", label: str = "label", clean: str = "clean", threshold: float = 0.7, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The ``keep`` columns with ``score DOUBLE, flagged BOOLEAN, spans ARRAY<STRUCT<from_: INT, to_: INT>>`` for every row.

    The model is fitted on at most ``max_labelled`` documents of either kind. Every text is tagged whole, in
    chains of a sentence of any length; its score is the highest mean marginal of a word and its neighbours in the chain, ``flagged`` is score >= threshold,
    ``spans`` are the tagged places of flagged texts in code points, from and up to. Null, empty and blank texts score 0. Without
    bad or without clean labels nothing is flagged. Repeated rows are scored each; rows don't shuffle. ``keep`` mustn't hold the names of the results.
    """
    made = ("score", "flagged", "spans")
    if set(made) & set(keep):
        raise ValueError(f"{made} are the names of the results")
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, key, text, label, clean, max_labelled)))
    span = pa.struct([pa.field("from_", pa.int32(), False), pa.field("to_", pa.int32(), False)])
    schema = T.StructType([*[docs.schema[c] for c in keep], *T._parse_datatype_string("score double, flagged boolean, spans array<struct<from_:int,to_:int>>").fields])
    last = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for begin, texts in text_runs(batch.column(last)):
                scores, spans = scorer.score(texts, threshold)
                found = pa.array([[{"from_": a, "to_": b} for a, b in x] for x in spans], pa.list_(span))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(begin, len(texts)) for k in range(last)], pa.array(scores), pa.array(scores >= threshold), found], names=schema.names)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """``(source, n_documents, n_flagged, rate, mean_score)``; null sources are a source."""
    flagged = F.sum(F.col("flagged").cast("int"))
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("n_documents"), flagged.alias("n_flagged"), (flagged / F.count(F.lit(1))).alias("rate"), F.avg("score").alias("mean_score"))
