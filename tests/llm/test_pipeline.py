"""Every stage of the pipeline against its operator's verdicts."""

import corpus_pipeline
from watchkeep.llm import decontamination, near_dedup, quality_rules
from watchkeep.llm.common import prepare, read, store


def test_stages_keep_what_their_operators_keep(spark, small):
    docs = read(prepare(spark), small, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(store(stage(spark, kept[-1], small), name))
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert all(after <= before for before, after in zip(ids, ids[1:], strict=False))
    rules = {r["doc_id"] for r in quality_rules.line_rules(kept[1]).where("kept").collect()}
    near = {r["doc_id"] for r in near_dedup.near_duplicates(kept[2], 5).where("kept").collect()}
    leaked = {r["doc_id"] for r in decontamination.leaks(kept[3], read(spark, small, "benchmark")).collect()}
    assert ids[2] == rules and ids[3] == near and ids[4] == ids[3] - leaked and ids[5] == ids[4]
    # The second stage takes lines away, and says so in n_chars.
    before = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    after = kept[2].collect()
    assert all(r["n_chars"] == len(r["text"]) and len(r["text"]) <= len(before[r["doc_id"]]) for r in after)


def test_lines_that_many_documents_share_are_gone_after_the_second_stage(spark, tmp_path):
    prepare(spark)
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = corpus_pipeline.quality_lines(spark, docs, "").collect()
    changed = [r for r in after if r["text"] != before[r["doc_id"]]]
    assert changed and all(set(r["text"].split("\n")) < set(before[r["doc_id"]].split("\n")) for r in changed)
