import zlib
from itertools import product

import numpy as np
import pytest

from tillroll.llm import quality

SF = "/root/testdata/sf0.01"


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(2)
    unary, turn, lengths = rng.normal(size=(3, 4, 2)), rng.normal(size=(2, 2)), np.array([4, 1, 3])
    single, pairs, total = quality.marginals(unary, turn, lengths)
    for chain, n in enumerate(lengths):
        weights = {y: np.exp(sum(unary[chain, t, y[t]] for t in range(n)) + sum(turn[y[t - 1], y[t]] for t in range(1, n))) for y in product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        assert np.isclose(total[chain], np.log(z))
        for t in range(n):
            assert np.isclose(single[chain, t, 1], sum(w for y, w in weights.items() if y[t]) / z)
        for a, b in product((0, 1), repeat=2):
            assert np.isclose(pairs[chain, a, b], sum(w * sum(y[t - 1] == a and y[t] == b for t in range(1, n)) for y, w in weights.items()) / z)


def test_line_counts_do_not_depend_on_the_piece(monkeypatch):
    text = "One two two!\n\nUPPER ## x| y\n  é 12 \n".encode() * 5
    counts, lengths = quality.line_counts(text)
    assert lengths.tolist() == [len(line) for line in text.split(b"\n")]
    assert counts[0, quality.TAIL + 1] == 3 and counts[0, quality.TAIL + 2] == 0
    assert quality.line_counts(b"a a a b")[0][0, quality.TAIL + 2] == 2
    monkeypatch.setattr(quality, "PIECE", 41)
    again, _ = quality.line_counts(text)
    assert (again[:, :quality.TAIL + 1] == counts[:, :quality.TAIL + 1]).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    scored = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    assert len(scored) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in scored.items())
    tested = [(scored[r.doc_id].predicted, r.quality) for r in labels.collect() if scored[r.doc_id].held_out]
    assert np.mean([p == q for p, q in tested]) >= 0.95
    assert np.mean([p == q for p, q in tested if q == 0]) >= 0.9


@pytest.mark.parametrize("rows, score", [([], 0.5), ([(1, 1), (2, None), (None, 0)], 1.0), ([(1, 0), (1, 1)], 0.5)])
def test_without_two_labels_the_score_is_their_share(spark, rows, score):
    docs = spark.createDataFrame([(1, "x", "clash"), (2, None, None), (None, "", "")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, quality.train(docs, labels)).collect()
    assert len(got) == 3 and all(r.score == score for r in got)
    assert quality.score_documents(docs.limit(0), quality.LineModel()).collect() == []


def test_stage_drops_what_the_classifier_rejects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.score_documents(docs, model).filter("predicted = 1").collect()}
    kept = quality.keep_good(spark, docs, SF)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == want and len(want) < docs.count()


def test_long_and_odd_texts():
    model = quality.LineModel()
    model.trained = True
    scores = model.score([b"", b"\n\n\n", b"a" * 300_000, b"x\n" * 20_000, "é".encode() * 5])
    assert len(scores) == 5 and np.isfinite(scores).all()


def test_long_texts_are_learned_from_whole(spark):
    """Junk that begins after the first 200 lines is learned as such."""
    clean = "The river was calm and the people walked home along the quiet street."
    junk = "$$$ BUY NOW!!! ||| 4829 CLICK $$$ !!!"
    texts = [("\n".join([clean] * (250 + i) + [junk] * (250 * (i % 2))), i % 2 == 0) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(good)) for i, (_, good) in enumerate(texts)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert (model.score([t.encode() for t, _ in texts]) >= 0.5).tolist() == [good for _, good in texts]


def test_rows_repeated_under_one_id_count_once(spark):
    clean, junk = "The river was calm and the people walked home.", "$$$ BUY NOW!!! ||| 4829 CLICK $$$ !!!"
    rows = [(i, f"{(junk, clean)[i % 2]} {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once, often = (quality.train(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows + [rows[0]] * 3000))
    texts = [t.encode() for _, t in rows]
    assert np.array_equal(once.score(texts), often.score(texts))
    many = spark.createDataFrame([(0, f"{junk} {i}") for i in range(500)] + rows[1:], "doc_id long, text string")
    assert (quality.train(many, labels, max_rows=60).score(texts) >= 0.5).tolist() == [bool(i % 2) for i in range(40)]
