"""The pipeline's stages against plain versions of their decisions, and on awkward rows."""

import os

import public_tokenizers
import pytest
import tiktoken
from tests_prose import drifting, prose, size_bits

import corpus_pipeline
from weftgraph.llm import bpe, winnowing


def test_stages_on_a_corpus(spark, tmp_path):
    good = [(i, prose(80 + i, i), "en", "s", 0) for i in range(60)]
    junk = [(100 + i, "$$$ ### " * 30 + prose(5, i) + " *** %%% " * 20, "en", "s", 0) for i in range(20)]
    copy = [(200, good[3][1], "en", "s", 0)]
    item = prose(40, 900)
    leaked = [(300, prose(40, 7) + " " + item + " " + prose(20, 901) + " " + prose(40, 902), "en", "s", 0)]
    leaked += [(301, prose(70, 11) + " " + " ".join(item.split()[5:13]) + " " + prose(60, 12), "en", "s", 0)]  # one window of one item
    private = [(400, prose(60, 8) + " write to some.one@mail.example.org now", "en", "s", 0)]
    docs = spark.createDataFrame([*good, *junk, *copy, *leaked, *private], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, prose(40, 902))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf_dir, left = str(tmp_path), docs
    made = []
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, sf_dir)
        made.append((name, left.columns, {r.doc_id: r for r in left.collect()}))
        left = left if name == corpus_pipeline.STAGES[-1][0] else spark.createDataFrame(left.collect(), left.schema)
    assert all(columns == docs.columns for _, columns, _ in made[:-1])
    quality, near, clean, private_, ids = (rows for _, _, rows in made)
    assert not any(100 <= i < 200 for i in quality) and all(r[0] in quality for r in good)
    assert set(near) == set(quality) - {200}
    assert {300, 301} <= set(near) and set(clean) == set(near) - {300, 301}
    assert set(private_) == set(clean) and "<EMAIL>" in private_[400].text and all(private_[i].text == clean[i].text for i in clean if i != 400)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert all(r.ids == own.encode_ordinary(private_[i].text) and r.n_tokens == len(r.ids) and r.round_trip for i, r in ids.items())


def test_stages_on_awkward_and_empty_rows(spark, awkward, empty, tmp_path):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        assert stage(spark, awkward, str(tmp_path)).count() > 0
    left = awkward  # without labels nothing is rejected; one row of each text with words stays, and all rows without words
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path))
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [0, 1, 2, 3, 4, 4, 6, 7, 8, 9, 10, None]))


def test_near_duplicates_size_estimate_stays_short(spark):
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in drifting()], "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert size_bits(left) < 2000
    assert [r.doc_id for r in left.collect()] == [0]


def test_decontamination_keeps_no_document_with_a_hit(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("needs the tables")
    docs, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    hit = {r.doc_id for r in winnowing.decontaminate(docs, bench).where("n_hit > 0").collect()}
    kept = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, path).collect()}
    assert len(hit) == 26 and kept == {r.doc_id for r in docs.select("doc_id").collect()} - hit
