import pytest

import corpus_pipeline
from tillroll.llm import packing, pii, queries, quality

from test_decontamination import brute as brute_hits
from test_simhash import brute_groups, brute_print

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs, labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    kinds = docs.schema
    model = quality.train(docs, labels)
    rows = sorted(map(tuple, docs.collect()))
    good = [r for r in rows if model.score([(r[1] or "").encode()])[0] >= 0.5]
    groups = brute_groups([brute_print(r[1]) for r in good])
    single = [r for i, r in enumerate(good) if groups[i] == i]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    hit = {r[0] for r in brute_hits([(r[0], r[1]) for r in single], items) if r[-1]}
    clean = [r for r in single if r[0] not in hit]
    assert 0 < len(clean) < len(single) < len(good) < len(rows)
    now, wanted = docs, [good, single, clean]
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted):
        now = stage(spark, now, SF)
        assert now.schema == kinds, name
        assert sorted(map(tuple, now.collect())) == want, name
    masked = corpus_pipeline.STAGES[3][1](spark, now, SF)
    assert masked.schema == kinds
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert set(texts) == {r[0] for r in clean} and not any(pii.base_spans(t) for t in texts.values())
    packed = corpus_pipeline.STAGES[4][1](spark, masked, SF).collect()
    assert {r.doc_id for r in packed} == set(texts)
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, packed))


@pytest.mark.parametrize("name", list(queries.queries()))
def test_queries_run_with_their_columns(spark, name):
    columns = {"op1": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
               "op3": "doc_id piece bin_id bin_offset n_tokens", "op4": "vec_id n_links component_id kept", "op5": "doc_id held_out score predicted",
               "op6": "doc_id n_bytes n_removed n_spans kept_sha256", "op7": "page_id url text n_chars", "op8": "doc_id start n_tokens ids_crc32",
               "op9": "doc_id n_words n_hit n_items items_sha256 contaminated", "op10": "doc_id fingerprint component_id",
               "op11": "doc_id held_out score predicted", "op12": "word form root n n_near form_n", "op13": "lang rank phrase a l r n score"}
    got = queries.queries()[name](spark, SF)
    assert " ".join(got.columns) == columns[name.split("_")[0]]
    assert got.count() > 0


def test_empty_documents(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_packing_capacity_is_what_the_stage_uses():
    assert packing.CAPACITY == 4096
