import random

import pytest

from strandwise.llm import tokens
from strandwise.llm.tokens import Automaton, encode, merger, pieces

HARD = [None, "", " ", "\n\n \t", "  a", "a  ", "don't they'll", "<|endoftext|> x", "日本語の文章です。" * 40, "x" * 5000, "a b\x85c\xa0 d", "½²３ ٣", "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace"), "é́ 😀 \x1c\x1d z", "A\r\n B \n  C"]


def test_automaton():
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 7))): [rng.randrange(99) for _ in range(rng.randrange(1, 4))] for _ in range(400)}
    a = Automaton.build(words)
    asked = [*words, b"", b"zz", b"abcabcabc"]
    for w, r in zip(asked, a.ranks(asked)):
        assert (a.ids[a.at[r] : a.at[r + 1]].tolist() == words[w]) if w in words else r == -1
    assert len(a.keys) < sum(map(len, words))  # shared prefixes and suffixes


def test_pieces_join_to_the_text():
    for t in HARD:
        if t:
            assert " ".join(pieces(t)) == t


def test_exact(spark):
    rng = random.Random(2)
    letters = " \t\n\r 'stdm12²½ab,.;_é漢字́ \x1c\x85　😀"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["the cat sat on the mat the cat"] * 20
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, piece string")
    merge = merger(tokens.TOKENIZERS, tokens.VOCABULARY)
    got = {r.doc_id: r.ids for r in encode(df).collect()}
    assert got == {k: merge.encode_ordinary(t) if t else [] for k, t in enumerate(texts)}
    n = {r.doc_id: r.n_tokens for r in encode(df, count=True).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encode(df.withColumnRenamed("piece", "ids"), keep=["ids"])
