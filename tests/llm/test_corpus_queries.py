"""Queries without SQL over the whole small tables, against brute force."""

import html
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_row_operators import by_hand, united, weighted_jaccard, weights

from quarterlight.llm.queries import ORACLE_SQL, QUERIES
from quarterlight.llm.tokens import library_tokenizer, tokenizer_path


@pytest.fixture(scope="module")
def documents(sf_dir):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def ids(documents):
    encoded = library_tokenizer(tokenizer_path()).encode_batch(list(documents.values()), add_special_tokens=False)
    return dict(zip(documents, [e.ids for e in encoded], strict=True))


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def rows(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def test_thirteen_operators():
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(i) for i in range(1, 14)} and len(QUERIES) == 13 and set(ORACLE_SQL) <= set(QUERIES)


def test_op1(spark, sf_dir, documents):
    for r in rows(spark, sf_dir, "op1_isolation_forest"):
        n, chars, symbols, lines, again = by_hand(documents[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, again)
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n) and not (r["kept"] and r["base_failed"])


def test_op3(spark, sf_dir, documents, ids):
    from test_text_operators import leaves_by_hand

    from quarterlight.llm.edit_counts import drawn_edits

    edits = {r["doc_id"]: r["edits"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", drawn_edits().alias("edits")).collect()}
    want = {}
    for i, text in documents.items():
        after = text or ""
        for e in edits[i]:
            after = after[: e["start"]] + e["replacement"] + after[max(e["start"], e["end"]) :]
        n = len(library_tokenizer(tokenizer_path()).encode(after, add_special_tokens=False).ids)
        want[i] = (len(ids[i]), n, len(after), *leaves_by_hand(text or "", edits[i]))
    got = rows(spark, sf_dir, "op3_edit_aware_counts")
    assert {r["doc_id"]: (r["n_tokens"], r["n_tokens_edited"], r["n_chars"], r["n_leaves"], r["encoded_chars"]) for r in got} == want


def test_op4(spark, sf_dir, ids):
    got = rows(spark, sf_dir, "op4_concat_and_cut")
    at, seen = 0, defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        own = [*ids[r["doc_id"]], 2]
        assert r["sequence_id"] * 4096 + r["offset"] == at and r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        seen[r["doc_id"]] += r["length"]
        at += r["length"]
    assert seen == {i: len(x) + 1 for i, x in ids.items()}


def test_op6(spark, sf_dir, ids):
    at, want = 0, []
    for i in sorted(ids):
        own = [*ids[i], 1]
        want.append((i, at, len(own), crc(own)))
        at += len(own)
    assert sorted(map(tuple, rows(spark, sf_dir, "op6_bit_planes"))) == want


def test_op7(spark, sf_dir, documents):
    """Against the weighted similarity of all pairs; estimated frequencies may decide within 0.003 of 0.8 only."""
    order = sorted(documents)
    bags = dict(zip(order, weights([documents[i] for i in order]), strict=True))
    sure, possible = [], []
    for k, a in enumerate(order):
        for b in order[:k]:
            s = weighted_jaccard(bags[a], bags[b])
            possible += [(a, b)] if s >= 0.797 else []
            sure += [(a, b)] if s >= 0.803 else []
    got = rows(spark, sf_dir, "op7_weighted_minhash")
    label = {r["doc_id"]: r["class_id"] for r in got}
    assert len(got) == len(documents) and all(label[a] == label[b] for a, b in sure)
    wide = united(order, possible)
    assert all(wide[i] == wide[label[i]] for i in order)
    assert label == united(order, sure) and len(set(label.values())) < len(order)
    assert {r["doc_id"] for r in got if r["kept"]} == set(label.values())


def test_op8(spark, sf_dir):
    got = {r["page_id"]: r["text"] for r in rows(spark, sf_dir, "op8_wrapper_induction")}
    for p in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[p["page_id"]] == "\n\n".join(x for x in parts if x)


def test_op9(spark, sf_dir, documents):
    got = rows(spark, sf_dir, "op9_string_kernel_svm")
    assert len(got) == len(documents)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
