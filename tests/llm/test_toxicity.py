import random

import numpy as np

from strandwise.llm.toxicity import Chains, Scorer, fit, labelled_sample, rates, score_documents, words_of

GOOD = ["The valve 12 opens the chamber.", "A lever kills the oscillation of the spring.", "The moderation module scores insults such as moron in messages.", "Der Kolben 3 bewegt die Feder."]
BAD = ["You are a stupid moron and everybody knows it.", "Shut up you filthy idiot nobody wants you.", "I hope you choke on your own lever you loser."]


def test_words_are_written_alike():
    assert words_of("M0r0n!") == ["moron"] and words_of("i.d.i.o.t.") == ["idiot"] and words_of("idi​ot") == ["idiot"]
    assert words_of("Іdiоt") == ["idiot"] and words_of("stuuupid") == ["stupid"] and words_of("S405") == ["0"] and words_of("図6") == ["図", "0"]
    assert words_of("") == [] and words_of("...") == []


def test_marginals_against_enumeration():
    rng = np.random.default_rng(4)
    chain = np.array([0, 0, 0, 0, 1, 2, 2])
    e, a = rng.normal(size=7), rng.normal(size=(2, 2))
    p, pairs = Chains(chain).marginals(e, a, pairs=True)
    want, total = np.zeros(7), np.zeros((2, 2))
    for c in range(3):
        at = np.flatnonzero(chain == c)
        z, own, two = 0, np.zeros(len(at)), np.zeros((2, 2))
        for m in range(1 << len(at)):
            y = [m >> k & 1 for k in range(len(at))]
            w = np.exp(sum(e[i] * v for i, v in zip(at, y)) + sum(a[p, q] for p, q in zip(y, y[1:])))
            z += w
            own += w * np.array(y)
            for u, v in zip(y, y[1:]):
                two[u, v] += w
        want[at] = own / z
        total += two / z
    assert np.allclose(p, want, atol=1e-4) and np.allclose(pairs, total, atol=1e-4)


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        bad = rng.random() < 0.3
        parts = [rng.choice(GOOD) for _ in range(rng.randrange(2, 8))]
        if bad:
            parts.insert(rng.randrange(len(parts)), rng.choice(BAD))
        out.append((k, " ".join(parts), "s" if k % 2 else None, bad))
    return out


def test_held_out(spark):
    train, test = corpus(150, 1), corpus(200, 2)
    docs = [(r[0], r[1], r[2], r[3]) for r in test]
    docs += [(1000, None, "s", False), (1001, "", "s", False), (1002, " \n", None, False), (1003, "y o u a r e a s t u p i d m o r o n. " + "x" * 100_000, "s", None), (0, test[0][1], None, test[0][3])]
    known = [(5000 + r[0], r[1], "t", r[3]) for r in train]
    df = spark.createDataFrame(docs + known, "doc_id long, text string, source string, score2 boolean")
    labels = spark.createDataFrame([(5000 + r[0], "abuse" if r[3] else "clean", "r1") for r in train] + [(None, "hate", "r2"), (7, None, "r")], "doc_id long, label string, reviewer string")
    rows = score_documents(df, labels, ["doc_id", "source"]).collect()
    assert len(rows) == len(docs) + len(known)
    got = {r.doc_id: r for r in rows}
    right = sum(got[r[0]].flagged == r[3] for r in test)
    assert right >= 0.97 * len(test)
    assert not any(got[k].flagged or got[k].score for k in (1000, 1001, 1002))
    hit = next(got[r[0]] for r in test if r[3])
    text = next(r[1] for r in test if r[3])
    assert any(text[s.from_ : s.to_] in " ".join(BAD) for s in hit.spans)
    table = {r.source: r.n_documents for r in rates(spark.createDataFrame(rows)).collect()}
    assert sum(table.values()) == len(rows) and None in table


def test_sentences_of_one_and_two_words():
    bad = ["The valve 12 opens the chamber. Idiot!", "Filthy loser! Der Kolben 3 bewegt die Feder.", "A lever opens. Idiot! Filthy loser!"] * 12
    model = fit(bad + GOOD * 9, [True] * len(bad) + [False] * len(GOOD) * 9)
    texts = ["The valve 12 opens the chamber. Idiot! A lever opens.", "A lever opens. Filthy loser!", "Idiot!", "A lever opens. Kolben! The valve.", "Kolben!"]
    scores, spans = Scorer(model).score(texts, 0.7)
    assert (scores >= 0.7).tolist() == [True, True, True, False, False]
    assert [[texts[k][a:b] for a, b in s] for k, s in enumerate(spans)] == [["Idiot!"], ["Filthy loser!"], ["Idiot!"], [], []]


def test_without_both_labels():
    for labels in ([], [True], [False]):
        model = fit(["you moron"][: len(labels)], labels)
        assert model.a[0, 1] < -10


def test_chains_are_as_long_as_sentences():
    model = fit([f"{BAD[0]} {g}" for g in GOOD * 9] + GOOD * 9, [True] * len(GOOD) * 9 + [False] * len(GOOD) * 9)
    reader = Scorer(model).reader
    words, _, chain, _ = reader.read(["valve " * 5_000 + BAD[0], "これは弁です。それはばねである！" * 3])
    assert np.bincount(chain)[0] == 5_000 + 9 and chain.max() == 6
    scores, spans = Scorer(model).score(["valve " * 127 + BAD[0], "valve " * 20_000 + "opens."], 0.7)
    assert scores[0] >= 0.7 > scores[1] and ("valve " * 127 + BAD[0])[spans[0][0][0] : spans[0][-1][1]].endswith("knows it.")


def test_whole_labelled_texts(spark):
    """A bad passage behind 30,000 letters is learnt; the sample is bounded by rows and the same every time."""
    docs = [(k, GOOD[k % 4] * 1_000 + " " + BAD[k % 3] if k % 2 else GOOD[k % 4] * 3) for k in range(60)] + [(1, "zz")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, "hate" if k % 2 else "clean") for k in range(60)], "doc_id long, label string")
    sample = [labelled_sample(df, labels.repartition(n), "doc_id", "text", "label", "clean", 10) for n in (1, 3)]
    texts, bad = sample[0]
    assert sample[0] == sample[1] and len(texts) == 20 and sum(bad) == 10 and min(len(t) for t, b in zip(texts, bad) if b and t != "zz") > 20_000
