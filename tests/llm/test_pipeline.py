"""The pipeline's stages beside what each must keep, and the registered statements."""

import duckdb
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from fleetlens.llm import langid, queries
from fleetlens.llm.oracles import ORACLE
from tests.llm.test_search import brute_components, brute_hits, brute_spans
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    one = stages["language"](spark, docs, SF)
    assert one.columns == docs.columns
    rejected = {r.doc_id for r in langid.identify(docs, langid.fit(docs)).where("rejected").collect()}
    kept = {r.doc_id: r.text for r in one.collect()}
    assert set(kept) == set(before) - rejected and len(rejected) < 0.03 * len(before)

    two = {r.doc_id: r.text for r in stages["near_duplicates"](spark, one, SF).collect()}
    groups = brute_components(sorted(kept.items()), 5, 8, 10)
    assert set(two) == {i for i, _, component in groups if i == component}

    left = docs.where(docs.doc_id.isin(list(two)))
    three = {r.doc_id for r in stages["decontamination"](spark, left, SF).collect()}
    assert three == {i for i, t in two.items() if not brute_hits(t, items)[4]}

    four = {r.doc_id: r for r in stages["secrets"](spark, docs, SF).collect()}
    for i, r in four.items():
        assert (r.text == before[i].text) == (not brute_spans(before[i].text)) and r.n_chars == len(r.text) and not brute_spans(r.text)

    truth = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    for r in stages["encoding"](spark, docs, SF).limit(40).collect():
        assert r.ids == truth.encode(before[r.doc_id].text) and r.round_trip


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 100 < out.count() < 200 and "ids" in out.columns


@pytest.mark.parametrize("name", list(ORACLE))
def test_statement(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    at = [names.index(c) for c in columns]
    assert compare([tuple(r[c] for c in columns) for r in df.collect()], [tuple(r[i] for i in at) for r in cursor.fetchall()]) is None


def test_registered():
    found = entry.queries()
    assert "pipeline" in found and all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 14))
