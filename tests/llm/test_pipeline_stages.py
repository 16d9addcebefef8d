import collections

import corpus_pipeline
from llm_tables import SMALL, no_docs, odd_docs, with_clashes

from verbaloom.llm import decontamination
from verbaloom.llm.common import stored, table


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "secrets", "source_mix"]
    columns, before, results = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, SMALL), name)
        assert after.columns[: len(columns)] == columns
        results[name], before = after, after
    ids = {n: [r["doc_id"] for r in results[n].select("doc_id").collect()] for n in names}
    assert set(ids["near_duplicates"]) < set(ids["quality_rules"]) and len(ids["near_duplicates"]) == len(set(ids["near_duplicates"]))
    assert sorted(ids["decontamination"]) == sorted(ids["near_duplicates"]) and sorted(ids["secrets"]) == sorted(ids["decontamination"])
    windows = stored(decontamination.benchmark_windows(table(spark, SMALL, "benchmark")), "w")
    assert decontamination.verified_hits(decontamination.keyed(results["decontamination"]), windows).isEmpty()
    assert results["secrets"].filter("text RLIKE 'token = \"[0-9a-f]{40}\"'").isEmpty()
    copies = collections.Counter(ids["source_mix"])
    assert set(copies) <= set(ids["secrets"]) and max(copies.values()) <= 3


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (with_clashes(odd_docs(spark)), no_docs(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SMALL), name)
            assert docs.columns[: len(columns)] == columns, name
