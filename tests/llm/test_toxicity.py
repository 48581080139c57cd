"""Toxicity: parts against brute force, held-out accuracy, awkward tables."""

import itertools
import random
import zlib

import numpy as np
import pytest
from corpus_fixtures import documents
from pyspark.sql import functions as F

from cartwheel.llm import toxicity as T

WORDS = ["lorem", "ipsum", "dolor", "sitam", "consec", "adipi", "elits", "seddo", "eius", "tempor", "you", "labore"]
STEMS = ["grunk", "zorbal"]


def corpus(n=420, seed=1):
    """A third toxic: a few words with one of two stems and changing ends."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "a", "is", "um"]) for _ in range(rng.randint(20, 120))]
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(STEMS) + rng.choice(["", "ing", "ed", "xu", "os"])
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), f"s{i % 4}"))
        labels.append((i, int(toxic)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame([(i, 1, t, "x") for i, t in labels], "doc_id long, quality int, toxic int, score string")


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in T.scores(docs, T.train(docs, label_table(spark, labels))).collect()}
    truth, hits = dict(labels), []
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.held_out:
            hits.append(r.predicted == truth[i])
    assert len(hits) > 100 and np.mean(hits) > 0.95
    # held-out labels, language and source are not looked at
    other = documents(spark, [(i, t, None, "z") for i, t, *_ in rows])
    changed = label_table(spark, [(i, 1 - t if got[i].held_out else t) for i, t in labels])
    assert {r.doc_id: r.score for r in T.scores(other, T.train(other, changed)).collect()} == {i: r.score for i, r in got.items()}


def test_given_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = T.scores(docs, T.train(docs, labels)).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where("held_out").collect()
    # so few toxic documents of the other languages are labelled here that only English is learned
    assert sum(r.predicted for r in out if r.toxic) >= 0.7 * sum(r.toxic for r in out)
    assert sum(r.predicted for r in out if not r.toxic) <= 0.03 * len(out)


def test_awkward_tables(spark):
    rows, labels = corpus(200)
    train = documents(spark, rows)
    model = T.train(train, label_table(spark, [*labels, (None, 1), (0, 0), (1, None), (9_999, 1)]))
    odd = [(1, None, None, None), (2, "", None, None), (None, "lorem ipsum", None, None), (3, "x" * 600_000, "en", "s"),
           (4, "grunking you zorbaled " * 30_000, "en", "s"), (5, " \n\t ", "en", "s"), (5, "😀 中文 ☃", "en", "s"), (5, "😀 中文 ☃", "en", "s")]
    got = T.scores(documents(spark, odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[1] == by[2] and max(by[4]) >= 0.7 > max(by[2]) and not next(r for r in got if r.doc_id is None).held_out
    assert T.scores(documents(spark, odd).limit(0), model).count() == 0
    for some, score in (([], 0.0), ([(i, 1) for i, _ in labels], 1.0), ([(i, 0) for i, _ in labels], 0.0)):
        assert {r.score for r in T.scores(documents(spark, odd), T.train(train, label_table(spark, some))).collect()} == {score}
    assert T.train(train.limit(0), label_table(spark, labels)).trees is None


def test_pieces_add_up(monkeypatch):
    """A text's features don't depend on how it is cut."""
    rng = random.Random(3)
    lexicon = T.Lexicon(np.zeros(T.CELLS, dtype=np.float32), np.zeros(T.CELLS, dtype=np.int8))
    lexicon.tier[T.words_of(["grunk"]).cells[0, -1]] = 2
    texts = [" ".join(rng.choice([*WORDS, "grunk", "LOUD", "w0rd", "sooo", "what?!"]) for _ in range(400)), "", None, "a" * 700]
    whole = T.features(texts, lexicon)
    monkeypatch.setattr(T, "PIECE", 300)
    cut = T.features(texts, lexicon)
    near = T.FEATURES.index("near_rate")                       # looks at words side by side
    keep = [k for k in range(len(T.FEATURES)) if k != near]
    assert np.allclose(whole[:3, keep], cut[:3, keep]) and abs(whole[0, near] - cut[0, near]) < 1
    assert whole[0, 0] > 0 and not whole[1].any() and not whole[2].any()


def test_words_and_signs():
    a, b = T.words_of(["an id1ot!"]), T.words_of(["IDIOT"])
    assert (a.cells[1] == b.cells[0]).all() and a.facts["signs"][0] == 1 and b.facts["shouted"][0] == 1
    assert (T.words_of(["call 555 1234"]).facts["signs"] == 0).all()
    assert T.words_of(["x y z w"]).facts["spelled"][0] == 2 and T.words_of(["sooo"]).facts["repeats"][0] == 1


@pytest.mark.parametrize("seed", range(6))
def test_isotonic_is_the_best_ascending_fit(seed):
    rng = np.random.default_rng(seed)
    score, y = rng.integers(0, 5, 7).astype(float), rng.integers(0, 2, 7).astype(float)
    knots, values = T.isotonic(score, y)
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()
    fitted = np.interp(score, knots, values)
    distinct = np.unique(score)
    grid = np.unique([a / b for b in range(1, 8) for a in range(b + 1)])
    best = min(sum(((y[score == s] - v) ** 2).sum() for s, v in zip(distinct, chosen))
               for chosen in itertools.combinations_with_replacement(grid, len(distinct)))
    assert ((y - fitted) ** 2).sum() == pytest.approx(best)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = T.fit_trees(x[:1500], y[:1500])
    assert ((trees.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.93
    assert T.fit_trees(x[:0], y[:0]).raw(x[:2]).shape == (2,)
