"""The pipeline's stages against brute force over their own input, and the driver's entry points."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pagequarry.llm import bpe, quality, secrets, simhash
from tests.llm.conftest import ROWS


@pytest.fixture
def folder(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(["th", "er", "ing", "on", "ou", "st"], int(rng.integers(1, 4))))
    rows, marks = [], []
    for k in range(240):
        words = [word() for _ in range(int(rng.integers(20, 90)))]
        bad = k % 6 == 0
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        if k % 10 == 1:
            text += " password: " + "s3cr3tvalue" * 2
        rows.append((k, text if k % 12 != 9 else rows[k - 1][1], "en", f"src{k % 4}", len(text)))
        marks.append((k, int(not bad), 0))
    docs = spark.createDataFrame(rows + [(300, None, None, None, None), (301, "", "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bad = {r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id % 6 == 0 and r.doc_id < 240 and r.text and "!!" in r.text}
    first = corpus_pipeline.quality_classifier(spark, docs, folder)
    kept = {r.doc_id for r in first.collect()}
    assert first.columns == docs.columns and not kept & bad and len(kept) >= 195
    second = corpus_pipeline.simhash_near_dedup(spark, first, folder)
    groups = {r.component_id for r in simhash.components(first).collect()}
    assert {r.doc_id for r in second.collect()} == groups and second.count() == len(groups)
    third = corpus_pipeline.secret_scans(spark, second, folder)
    assert third.count() == second.count() and secrets.report(third).filter("n_assign + n_access + n_hex > 0").count() == 0
    assert third.filter("text LIKE '%[assign]'").count() > 10
    fourth = corpus_pipeline.mixing_sources(spark, third, folder)
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} <= {r.doc_id for r in third.collect()}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    last = corpus_pipeline.byte_level_bpe(spark, fourth, folder)
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in last.collect())
    want = []
    for r in fourth.collect():
        ids = library.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert got == sorted(want)


def test_run_is_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 150 and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


def test_stages_stand_odd_and_empty_tables(spark, hostile, nothing, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (hostile, nothing):
        for _, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= 3 * len(ROWS)
    assert quality.selected(nothing, labels).count() == 0


def test_entry_points_know_every_operator():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
