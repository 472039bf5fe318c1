"""The pipeline and the registered queries on the small tables."""

from __future__ import annotations

import collections
import pathlib
import re
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

import pytest  # noqa: E402
from cases import ROWS, documents  # noqa: E402
from test_duplicates import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from faultline.llm import language, mixing, pseudonyms, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SF)
    verdict = {r["doc_id"]: r["rejected"] for r in language.classify(docs, language.fit(docs)).collect()}
    assert sorted(r["doc_id"] for r in known.collect()) == sorted(d for d, rejected in verdict.items() if not rejected)
    single = stages["ngram_jaccard_join"](spark, known, SF)
    groups = brute([(r["doc_id"], r["text"]) for r in known.collect()])
    assert sorted(str(r["doc_id"]) for r in single.collect()) == sorted(d for d, n, c in groups if n == 0 or d == c)
    private = stages["pseudonyms"](spark, single, SF)
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    found = {r["doc_id"]: r["pseudonyms"] for r in pseudonyms.pseudonymise(single).collect()}
    for r in private.collect():
        assert all(p["value"] not in r["text"] for p in found[r["doc_id"]] or [])
        assert found[r["doc_id"]] or r["text"] == before[r["doc_id"]]
    mixed = stages["source_mix"](spark, private, SF)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(private).collect() if r["taken"]}
    words = collections.Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert dict(words) == taken
    coded = stages["byte_pair_codec"](spark, mixed, SF)
    assert sorted((r["doc_id"], r["text"]) for r in coded.collect()) == sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    for stage in (known, single, private, mixed):
        assert stage.columns == COLUMNS


def test_hand_made_documents_pass_every_stage(spark):
    for rows in (ROWS, []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, SF)
            assert name == "byte_pair_codec" or made.columns == docs.columns
            docs = spark.createDataFrame(made.collect(), made.schema)


def test_whole_pipeline(spark):
    once, again = (sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert once and once == again


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_table(spark, name):
    table, key = ("embeddings", "vec_id") if name.startswith("op8_") else ("documents", "doc_id")
    rows = queries.QUERIES[name](spark, SF).select(key).collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
