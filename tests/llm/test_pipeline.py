"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

import corpus_pipeline

from orthoflow.llm import langid
from orthoflow.llm.decontamination import contamination
from orthoflow.llm.exact_dedup import exact_duplicates
from orthoflow.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_run_is_their_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{SF}/benchmark.parquet")
    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        after.append(docs)
        assert name == "pack" or docs.columns == columns
    language, exact, near, clean, packed = after
    assert language.count() == 200
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(r["doc_id"] for r in exact_duplicates(language).where("kept").collect())
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(r["doc_id"] for r in near_duplicates(exact).where("doc_id = component_id").collect())
    hit = {r["doc_id"] for r in contamination(near, bench).where("contaminated").collect()}
    assert hit and clean.count() and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - hit
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(tuple, packed.drop("sequence_id", "offset").collect()))


def test_documents_without_a_language_go(documents):
    docs = documents([(1, "the cat and the dog"), (2, "12 34 !!"), (3, None), (4, ""), (None, "the dog", "xx"), (1, "the cat and the dog")], extra=True)
    kept = langid.drop_unidentified(docs, langid.fit(documents([(1, "the cat and the dog", "en")])))
    assert sorted((str(r["doc_id"]), r["lang"]) for r in kept.collect()) == [("1", "en"), ("1", "en"), ("None", "xx")] and kept.columns == docs.columns
    far = documents([(i, chr(0x1200 + 3 * i) * 3 + chr(0x3041 + i) * 40) for i in range(60)])  # letters that no prototype has seen
    assert langid.drop_unidentified(far, langid.fit(documents([(1, "the cat and the dog", "en")]))).count() < 40
    assert langid.drop_unidentified(documents([]), {}).count() == 0 and langid.drop_unidentified(far, {}).count() == 60


def test_run_over_odd_tables(spark, documents, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    odd = [(1, None), (2, ""), (3, "a few words of text", "en"), (3, "a few words of text", "en"), (None, "a few words of text"), (None, None), (4, "other words " * 5000, "en")]
    for name, rows, want in (("empty", [], []), ("odd", odd, ["3", "4"])):
        folder = tmp_path / name
        documents(rows).select(columns).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, "nothing of this stands anywhere else in the table at all")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted({str(r["doc_id"]) for r in got}) == want
        assert sum(r["piece"] == 0 for r in got) == len(want)


def test_run_deletes_what_earlier_stages_stored(spark, tmp_path, monkeypatch):
    from orthoflow.sources import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda spark: str(tmp_path))
    corpus_pipeline.run(spark, SF).count()
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "orthoflow").glob("*/*")}
    assert left == {"decontaminate"}


def test_two_runs_in_one_driver_keep_their_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(lambda _: sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())), range(2))
    assert one == two and one
