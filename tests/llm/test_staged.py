"""Staged tables that nothing reads any more don't stay on disk."""

import os

from lamina.llm import ngram_join, shared


def test_ngram_join_removes_prefixes_and_first_entries(spark):
    folder = shared.shared_dir(spark).removeprefix("file:").replace("///", "/")
    before = set(os.listdir(folder))
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 3) * 100 + j}" for j in range(20))) for i in range(9)], "doc_id long, text string")
    got = ngram_join.similar_groups(docs).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, i % 3) for i in range(9)]
    made = sorted(set(os.listdir(folder)) - before)
    (prefixes,) = [x for x in made if x.startswith("prefixes-")]
    assert [x for x in os.listdir(f"{folder}/{prefixes}") if "=" in x] == ["part=sizes"]
    assert len([x for x in made if x.startswith("entries-")]) == 1
