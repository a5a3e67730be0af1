import random
import zlib

import numpy as np
import pytest

from tillroll.llm import toxicity
from tillroll.llm.toxicity import Reader, Trees, isotonic

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id")
    model = toxicity.train(docs, labels)
    scored = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in scored.items())
    tested = [(scored[r.doc_id].predicted, r.toxic) for r in labels.collect() if scored[r.doc_id].held_out]
    assert len(tested) > 500
    assert np.mean([p == t for p, t in tested]) >= 0.97
    assert np.mean([p for p, t in tested if t == 1]) >= 0.85
    assert np.mean([p for p, t in tested if t == 0]) <= 0.01


def test_inputs_are_the_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    model = toxicity.ToxicityModel()
    model.lexicon, model.trees = {"scum": 5.0}, Trees().fit(np.eye(24), np.eye(24)[0])
    model.curve = np.array([-9.0, 9.0]), np.array([0.0, 1.0])
    score = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    other = docs.selectExpr("doc_id + 100000 as doc_id", "text", "'x' as lang", "'y' as source", "1 as toxic")
    assert {r.doc_id - 100000: r.score for r in toxicity.score_documents(other, model).collect()} == score


@pytest.mark.parametrize("rows, score", [([], 0.5), ([(1, 1), (2, None), (None, 0)], 1.0), ([(1, 0), (1, 1)], 0.5), ([(1, 0), (2, 0)], 0.0)])
def test_without_two_labels_the_score_is_their_share(spark, rows, score):
    assert all(zlib.crc32(str(i).encode()) % 5 for i in (1, 2))
    docs = spark.createDataFrame([(1, "x", "clash"), (2, None, None), (None, "", "")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, toxic int, quality int")
    got = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 3 and all(r.score == score for r in got)
    assert toxicity.score_documents(docs.limit(0), toxicity.ToxicityModel()).collect() == []


def test_repeated_ids_do_not_enlarge_the_sample(spark, monkeypatch):
    seen = []
    real = toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df: seen.append(real(df)) or seen[-1])
    docs = spark.range(3000).selectExpr("id % 3 as doc_id", "if(id % 3 = 0, 'you scum', 'a calm river') as text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    assert seen[0].count() == sum(1 for i in range(3) if zlib.crc32(str(i).encode()) % 5)


def test_learned_words_in_other_languages_and_disguises(spark):
    rng = random.Random(1)
    words = ["river", "walk", "home", "calm", "street", "people", "évening", "lamp"]
    rows = []
    for i in range(600):
        text = rng.choices(words, k=30)
        if i % 3 == 0:
            for place in rng.sample(range(30), 4):
                text[place] = "grumpf" + rng.choice(words)
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    calm = " ".join(words * 4)
    reader = Reader(model.lexicon)
    low, high = model.score(reader, [calm, f"{calm} grumpfunseen {calm} grumpfnew grumpfother grumpfthird"])
    assert low < 0.5 < high
    assert model.score(reader, ["", " \n", "x" * 3_000_000, "é " * 400_000]).shape == (4,)


def test_token_features():
    reader = Reader({"scum": 5.0, "gru*": 2.0})
    at = reader.token
    assert at("Scum!!")[:4] == (True, True, 5.0, True) and at("Scum!!")[toxicity.BANGS] == 2
    assert at("grumble")[:3] == (True, False, 2.0) and at("gr")[2] == 0
    assert at("1d1ot")[toxicity.HIDDEN] and at("s.c.u.m")[toxicity.HIDDEN] and at("$cum,")[toxicity.HIDDEN] and not at("idiot")[toxicity.HIDDEN]
    assert at("YOU")[toxicity.SECOND] and at("YOU")[toxicity.SHOUTED] and at("sooo")[toxicity.STRETCH]
    near, far = reader.features("you are scum"), reader.features("you " + "and " * 9 + "scum")
    assert near[13] > 0 == far[13]


def test_pieces_do_not_change_the_features(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choices(["you", "scum", "A", "calm!", "grumpf", "LOUD", "\n"], k=3000))
    whole = Reader({"scum": 5.0}).features(text)
    monkeypatch.setattr(toxicity, "PIECE", 50)
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    assert "".join(toxicity.pieces(text)) == text
    assert np.allclose(Reader({"scum": 5.0}).features(text), whole)


def test_trees_learn_what_no_single_feature_tells():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.3)).astype(float)
    trees = Trees().fit(x[:1500], y[:1500])
    assert (((trees.margin(x[1500:]) > 0) == (y[1500:] > 0.5)).mean()) > 0.95


def test_isotonic_curve_is_the_nearest_rising_one():
    rng = np.random.default_rng(4)
    margin, y = rng.normal(size=200), rng.integers(0, 2, 200).astype(float)
    at, share = isotonic(margin, y)
    assert (np.diff(share) >= 0).all() and (np.diff(at) >= 0).all()
    order = np.argsort(margin)
    want = np.array([max(min(y[order][i:j + 1].mean() for j in range(k, 200)) for i in range(k + 1)) for k in range(200)])
    # the pools are those of the max-min formula; shares are drawn to one half by a row
    edges = np.flatnonzero(np.diff(want)) + 1
    sizes = np.diff(np.r_[0, edges, 200])
    pooled = (want[np.r_[0, edges]] * sizes + 0.5) / (sizes + 1)
    assert np.allclose(share[::2], np.maximum.accumulate(pooled))
