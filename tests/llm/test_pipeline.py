"""The pipeline against its operators run by hand in plain Python, and without rows."""

import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_row_operators import INSULTS, prose

import corpus_pipeline
from quarterlight.llm import quality, toxicity
from quarterlight.llm.tokens import library_tokenizer, tokenizer_path, word_encoder


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(8)
    rows = []

    def add(text, good=1, toxic=0):
        rows.append((len(rows), text, "en", f"s{len(rows) % 4}", len(text or ""), good, toxic))

    for _ in range(160):
        add(prose(rng, 140))
    for i in range(40):
        words = prose(rng, 140).split()
        words.insert(rng.randrange(140), INSULTS[i % 4])
        add(" ".join(words), toxic=1)
    for i in range(40):
        add(re.sub(" ", "### ", prose(rng, 120)) if i % 2 else prose(rng, 120).upper().replace(" ", "!! "), good=0)
    for i in range(10):
        add(rows[i][1])  # exact copies
        near = rows[20 + i][1].split()
        near[50] = "changed"
        add(" ".join(near))
    add(None, good=0), add("", good=0), add("too short", good=0)
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int").createOrReplaceTempView("all_rows")
    spark.sql("SELECT doc_id, text, lang, source, n_chars FROM all_rows").write.parquet(f"{folder}/documents.parquet")
    spark.sql("SELECT doc_id, quality, toxic FROM all_rows").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    clean, toxic = set(range(160)), set(range(160, 200))
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert ids("quality_rules") <= set(range(200)) | set(range(240, 260)) and len(ids("quality_rules") & clean) >= 157
    assert len(ids("toxicity") & toxic) <= 2 and ids("toxicity") >= ids("quality_rules") & clean
    # Of each copied or changed document one stays.
    left = ids("near_dedup")
    for i in range(10):
        assert len({i, 240 + 2 * i} & left) <= 1 and len({20 + i, 241 + 2 * i} & left) <= 1
    assert ids("toxicity") - left <= set(range(240, 260)) | set(range(30))
    assert {r["doc_id"]: r["text"] for r in seen["mixing"]}.items() <= {r[0]: r[1] for r in rows}.items()
    tokens = library_tokenizer(tokenizer_path())
    want = Counter()
    for r in seen["mixing"]:
        want[r["doc_id"]] += len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1
    got = Counter()
    for r in seen["packing"]:
        got[r["doc_id"]] += r["length"]
    assert got == want
    assert sum(want.values()) == max(r["sequence_id"] * 4096 + r["offset"] + r["length"] for r in seen["packing"])


def test_run_and_no_rows(spark, corpus, tmp_path):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", [k for k, _ in corpus_pipeline.STAGES if k != "mixing"])
def test_texts_go_to_python_in_short_batches(spark, corpus, monkeypatch, stage):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["size"])

    setting = corpus_pipeline.BATCH_SETTING
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").coalesce(1)
    most = lambda: max(r["size"] for r in docs.mapInArrow(sizes, "size long").collect())
    assert spark.conf.get(setting, None) is None and most() > 100_000
    monkeypatch.setattr(corpus_pipeline, "BATCH_BYTES", 20_000)
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, docs, corpus[0])
        assert most() < 25_000
        spark.conf.set(setting, "60000")  # the user's own
        dict(corpus_pipeline.STAGES)[stage](spark, docs, corpus[0])
        assert spark.conf.get(setting) == "60000"
    finally:
        spark.conf.unset(setting)


def test_run_leaves_the_session_as_it_was(spark, corpus):
    corpus_pipeline.run(spark, corpus[0])
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING, None) is None


def test_memory_of_the_encoder():
    rng, encoder = random.Random(3), word_encoder(tokenizer_path())
    texts = pa.array([prose(rng, 200) for _ in range(3000)])
    ids, counts = encoder.encode(texts)
    tracemalloc.start()
    again = encoder.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (again[0] == ids).all() and (again[1] == counts).all()
    assert most < 20 * len(ids)  # 24 with numbers of 64 bits
    assert encoder.words
    encoder.forget()
    assert not encoder.words and not encoder.chunks and not encoder.words.old and not encoder.chunks.old
    assert (encoder.encode(texts)[0] == ids).all()


def test_held_out_rows_of_the_test_data(spark, sf_dir):
    labels = {r["doc_id"]: r for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    rows = {r["doc_id"]: r for r in toxicity.op9_string_kernel_svm(spark, sf_dir).collect()}
    clean = [rows[i]["predicted"] for i, x in labels.items() if rows[i]["held_out"] and not x["toxic"]]
    assert sum(clean) <= max(1, len(clean) // 20)
    verdicts = {r["doc_id"]: r for r in quality.op1_isolation_forest(spark, sf_dir).collect()}
    good = [verdicts[i]["kept"] for i, x in labels.items() if x["quality"] == 1 and not verdicts[i]["base_failed"]]
    assert sum(good) >= 0.97 * len(good)
