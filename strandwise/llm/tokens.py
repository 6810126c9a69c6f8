"""Token ids of whole texts: a memory-mapped lexicon automaton for frequent words, exact merges for the rest."""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.runtime import cut, fresh_path

#: Fixed value: the word pattern that belongs to the vocabulary byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZERS = "/opt/tokenizers"
#: Words of the lexicon, and the longest that may be one, in letters.
LEXICON_WORDS = 1 << 16
LEXICON_LETTERS = 24
#: Pieces whose ids a worker remembers, their letters, and letters encoded at once.
MEMO_PIECES, MEMO_LETTERS, CHUNK = 200_000, 8_000_000, 1 << 20

WORD = regex.compile(PATTERN)
#: A space beside other white space. Where there is none, every space begins a word, and pieces cut before spaces can be encoded one by one.
BESIDE = re.compile(r" \s|\s ")
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """The text cut at spaces between two other letters; such a space always begins a word, so no word crosses a cut. The space is left out."""
    return BETWEEN.split(text) if BESIDE.search(text) else text.split(" ")


class Automaton:
    """Minimal acyclic transducer: sorted byte strings to their rank, with suffixes shared, and from rank to ids.

    The rank of a word is the sum of the outputs on its path. Edges are kept by (state, byte) in one sorted array, so the
    arrays can be mapped from a file and many words be looked up at once.
    """

    NAMES = ("keys", "to", "out", "final", "at", "ids")

    def __init__(self, **arrays: np.ndarray):
        for name in self.NAMES:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Automaton:
        order = sorted(words)
        register: dict[tuple, int] = {}
        counts: list[int] = []
        states: list[tuple] = []

        def freeze(node: list) -> int:
            """The state equal to this node, new or found: suffixes shared by several words are stored once."""
            signature = (node[0], tuple(node[1]))
            state = register.get(signature)
            if state is None:
                state = register[signature] = len(states)
                states.append(signature)
                counts.append(node[0] + sum(counts[t] for _, t in node[1]))
            return state

        path: list[list] = [[False, []]]
        last = b""
        for word in order:
            same = len(os.path.commonprefix((last, word)))
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], freeze(node)))
            path.extend([False, []] for _ in range(len(word) - same))
            path[-1][0] = True
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        top = freeze(path[0])
        number = lambda s: 0 if s == top else s + 1
        edges = []
        for s, (final, out) in enumerate(states):
            before = int(final)
            for byte, t in out:
                edges.append((number(s) * 256 + byte, number(t), before))
                before += counts[t]
        edges.sort()
        keys, to, out = (np.array([e[k] for e in edges] or [-1], np.int64) for k in range(3))
        final = np.zeros(len(states) + 2, bool)
        final[[number(s) for s, (f, _) in enumerate(states) if f]] = True
        at = np.cumsum([0] + [len(words[w]) for w in order])
        ids = np.array([i for w in order for i in words[w]], np.int32)
        return cls(keys=keys, to=to, out=out, final=final, at=at, ids=ids)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where it isn't one of the lexicon."""
        lens = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(lens) - lens
        state, rank, dead = (np.zeros(len(words), np.int64) for _ in range(3))
        here = np.flatnonzero(lens > 0)
        step = 0
        while len(here):
            key = state[here] * 256 + letters[start[here] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[edge] == key
            dead[here[~ok]] = 1
            here, edge = here[ok], edge[ok]
            rank[here] += self.out[edge]
            state[here] = self.to[edge]
            step += 1
            here = here[lens[here] > step]
        return np.where((dead == 0) & self.final[state], rank, -1)

    def save(self, uri: str) -> None:
        where, path = fs.FileSystem.from_uri(uri)
        where.create_dir(path)
        for name in self.NAMES:
            with where.open_output_stream(f"{path}/{name}.npy") as f:
                sink = pa.BufferOutputStream()
                np.save(sink, np.ascontiguousarray(getattr(self, name)))
                f.write(sink.getvalue())

    @classmethod
    def load(cls, uri: str) -> Automaton:
        """Mapped into memory where the shared folder is mounted, else read."""
        where, path = fs.FileSystem.from_uri(uri)
        if isinstance(where, fs.LocalFileSystem):
            return cls(**{name: np.load(f"{path}/{name}.npy", mmap_mode="r") for name in cls.NAMES})
        arrays = {}
        for name in cls.NAMES:
            with where.open_input_file(f"{path}/{name}.npy") as f:
                arrays[name] = np.load(pa.BufferReader(f.read()))
        return cls(**arrays)


def merger(tokenizers: str, vocabulary: str):
    """The exact merges of a vocabulary, without special tokens."""
    import tiktoken

    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Codes(dict):
    """Pieces numbered as they come; new ones wait in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, piece):
        code = self[piece] = len(self)
        self.fresh.append(piece)
        return code


class Encoder:
    """Ids of texts, with the ids of frequent pieces remembered."""

    def __init__(self, lexicon: Automaton, tokenizers: str, vocabulary: str):
        self.lexicon, self.merge = lexicon, merger(tokenizers, vocabulary)
        self.forget()

    def forget(self) -> None:
        self.codes, self.letters = Codes(), 0
        self.at, self.n, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def words(self, words: list[str]) -> list:
        """Ids of words: by the automaton, or merged if unseen."""
        data = [w.encode("utf-8", "replace") for w in words]
        return [self.lexicon.ids[self.lexicon.at[r] : self.lexicon.at[r + 1]] if r >= 0 else self.merge.encode_ordinary(w) for r, w in zip(self.lexicon.ranks(data), words)]

    def _learn(self) -> None:
        fresh, self.codes.fresh = self.codes.fresh, []
        if not fresh:
            return
        # A piece is a text (its space left out), the first piece of a document a tuple (nothing left out).
        split = [WORD.findall(p[0] if type(p) is tuple else " " + p) for p in fresh]
        distinct = list(dict.fromkeys(w for s in split for w in s))
        known = dict(zip(distinct, self.words(distinct)))
        parts = [known[w] for s in split for w in s]
        per_word = np.array([len(p) for p in parts], np.int64)
        ends = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum([0] + [len(s) for s in split])]
        new = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        size, more = len(self.codes), self.used + len(new)
        if size > len(self.at):
            self.at, self.n = (np.concatenate([x, np.zeros(size, np.int64)]) for x in (self.at, self.n))
        if more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(more, np.int32)])
        self.ids[self.used : more] = new
        self.at[size - len(fresh) : size] = self.used + ends[:-1]
        self.n[size - len(fresh) : size] = np.diff(ends)
        self.used = more
        self.letters += sum(map(len, fresh))

    def encode(self, texts: list[str | None], count: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(tokens of each text, all ids one after another)."""
        if len(self.codes) > MEMO_PIECES or self.letters > MEMO_LETTERS:
            self.forget()
        code, sizes = [], []
        get = self.codes.__getitem__
        for text in texts:
            if not text:
                sizes.append(0)
                continue
            found = pieces(text)
            first = found[0]
            code.append(get((first,)))
            code.extend(map(get, found[1:]))
            sizes.append(len(found))
        self._learn()
        codes = np.array(code, np.int64)
        n = self.n[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        each = np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])
        if count:
            return each, None
        shift = np.repeat(self.at[codes] - ends[:-1], n)
        return each, self.ids[shift + np.arange(len(shift))]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(uri: str, tokenizers: str, vocabulary: str) -> Encoder:
    """One for each worker process."""
    key = (uri, tokenizers, vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Automaton.load(uri), tokenizers, vocabulary)
    return _ENCODERS[key]


def text_runs(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, list]]:
    """(first row, texts) of about ``size`` letters, so that memory doesn't grow with the batch."""
    run, begin, letters = [], 0, 0
    for k in range(len(texts)):
        run.append(texts[k].as_py())
        letters += len(run[-1] or "")
        if letters >= size:
            yield begin, run
            run, begin, letters = [], k + 1, 0
    if run:
        yield begin, run


def frequent_words(docs: DataFrame, text: str, n: int) -> list[str]:
    """The words of the most frequent pieces of all texts, of at most ``n`` pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            kept = [(p, c) for p, c in counts.items() if len(p) <= LEXICON_LETTERS]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in kept], pa.string()), pa.array([c for _, c in kept], pa.int64())], names=["piece", "n"])

        for batch in batches:
            for _, texts in text_runs(batch.column(0)):
                for t in texts:
                    if t:
                        counts.update(pieces(t))
                if len(counts) > MEMO_PIECES:
                    yield out()
                    counts.clear()
        yield out()

    counts = cut(docs.select(text).mapInArrow(run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1"))
    # The least count with at most n pieces above, from a table of counts of counts of at most 256 rows: so at most n rows are collected.
    level = F.floor(F.log2("n") * 4).cast("int")
    least, total = 256, 0
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > n:
            break
        least = row.level
    found = counts.where(level >= least)
    words: Counter = Counter()
    for row in found.collect():
        for word in WORD.findall(" " + row.piece):
            words[word] += row.n
    return sorted(words)


def compile_lexicon(docs: DataFrame, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, n: int = LEXICON_WORDS) -> str:
    """Write the automaton of the corpus' frequent words to the shared folder; its place. It only speeds encoding: no id depends on it."""
    merge = merger(tokenizers, vocabulary)
    lexicon = Automaton.build({w.encode(): merge.encode_ordinary(w) for w in frequent_words(docs, text, n)})
    uri = fresh_path(docs.sparkSession, "lexicon")
    uri = uri if "//" in uri else "file://" + uri.removeprefix("file:")
    lexicon.save(uri)
    return uri


def encode(docs: DataFrame, text: str = "text", keep: list[str] = ("doc_id",), tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, lexicon: str | None = None, count: bool = False) -> DataFrame:
    """The ``keep`` columns with ``ids ARRAY<INT>``, the token ids of the whole text without special tokens, or with ``n_tokens BIGINT`` if ``count``.

    One row per input row, repeats included. A null or empty text has an empty list (no tokens); strings of special tokens are
    ordinary text; blank texts and very long runs without spaces are encoded like any other. Rows don't shuffle: texts are encoded where they
    are read. ``keep`` mustn't hold a column named ``ids`` (``n_tokens``); other columns are ignored. An empty table gives no rows.
    """
    name = "n_tokens" if count else "ids"
    if name in keep:
        raise ValueError(f"{name} is the name of the result")
    uri = lexicon or compile_lexicon(docs, text, tokenizers, vocabulary)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, T.LongType() if count else T.ArrayType(T.IntegerType(), False))])
    last = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(uri, tokenizers, vocabulary)
        for batch in batches:
            for begin, texts in text_runs(batch.column(last)):
                n, ids = coder.encode(texts, count)
                made = pa.array(n, pa.int64()) if count else pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()), type=pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(begin, len(texts)) for k in range(last)], made], names=schema.names)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
