import re
from hashlib import sha256

import pytest

from tillroll.llm import decontamination


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for item, item_text in items:
            v = words(item_text)
            if not v:
                continue
            n = min(len(v), window)
            for piece in {tuple(v[i:i + n]) for i in range(len(v) - n + 1)}:
                for s in range(len(w) - n + 1):
                    if tuple(w[s:s + n]) == piece:
                        hit.update(range(s, s + n))
                        named.update([str(item)] if item is not None else [])
        joined = ",".join(sorted(named))
        out.append((doc, len(w), len(hit), len(named), sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PASSAGE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
ITEMS = [(1, PASSAGE), (10, PASSAGE), (2, "two words"), (3, "the"), (4, "the the the the the the the the the the the the"), (5, None), (6, " ... "),
         (7, "Éa 1st\x00éÉ x-y"), (None, PASSAGE), (None, "known without any id"), (2, "two words"), (8, "Alpha beta gamma delta epsilon zeta eta theta iota other ending words here")]
DOCS = [(1, f"before {PASSAGE.upper()}, after"), (2, None), (3, ""), (4, "THE " * 30), (5, "two, WORDS; two words"), (5, "nothing of it"), (None, "the end"),
        (6, "alpha beta gamma delta epsilon zeta eta theta iota"), (7, "x éa 1ST éÉ X y z"), (8, "beta gamma delta epsilon zeta eta theta iota kappa lambda" * 2),
        (9, (PASSAGE + " ") * 200), (5, "two, WORDS; two words"),
        (11, "it is KNOWN without any id, and two words")]


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "k", 1, None) for d in docs], "doc_id long, text string, key string, words int, row string"),
            spark.createDataFrame([(*i, "w") for i in items], "item_id long, text string, window string"))


@pytest.mark.parametrize("settings", [{}, {"shingle": 1}, {"window": 4}, {"window": 2, "shingle": 5}])
def test_hits_are_those_of_all_windows(spark, settings):
    got = sorted((tuple(r) for r in decontamination.contamination(*frames(spark, DOCS, ITEMS), **settings).collect()), key=str)
    assert got == brute(DOCS, ITEMS, settings.get("window", 10))


@pytest.mark.parametrize("docs, items", [(DOCS, []), ([], ITEMS), ([], []), (DOCS, [(1, None)])])
def test_empty_tables(spark, docs, items):
    got = sorted((tuple(r) for r in decontamination.contamination(*frames(spark, docs, items)).collect()), key=str)
    assert got == brute(docs, items)


def test_no_python_runs_on_the_executors(spark):
    plan = decontamination.contamination(*frames(spark, DOCS, ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_stage_keeps_clean_documents(spark, tmp_path):
    docs, items = frames(spark, DOCS, ITEMS)
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = decontamination.keep_clean(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    # an id all of whose rows are clean by brute force
    hit = {row[0] for row in brute(DOCS, ITEMS) if row[-1]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in DOCS if d not in hit) == [2, 3, 6, 7, 8]


def test_stage_does_not_move_texts_for_few_hits(spark, tmp_path):
    docs, items = frames(spark, DOCS, ITEMS)
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = decontamination.keep_clean(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan, plan
