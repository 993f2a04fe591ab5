"""Token ids, packing, shards, edit counts, media: against brute force on small fixtures."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarterlight.llm import bitplanes, edit_counts, interleaved, packing
from quarterlight.llm.common import own_dir
from quarterlight.llm.tokens import library_tokenizer, tokenizer_path, word_encoder

TEXTS = ["Plain words, and more words.", "", None, "it's 12 o'clock!\n\nÉté ΣΑΣ İx ﬁ   漢字", "x<|endoftext|>y z", "  ", "the the the\nthe the", "lo-ng " * 3000, "a.b,c.,", "#*$ %&|", "́a \x85b \x1cc"]


def library(text, end):
    return [*library_tokenizer(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 9 else None, t, "src", 7) for i, t in enumerate([*TEXTS, TEXTS[0]])] + [(3, TEXTS[3], "src", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, part string, ids int").repartition(3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_ids_equal_the_library(texts):
    ids, counts = word_encoder(tokenizer_path()).encode(pa.array(texts, pa.string()))
    own = [library(t, 0)[:-1] for t in texts]
    assert counts.tolist() == [len(x) for x in own] and ids.tolist() == [i for x in own for i in x]


def test_pack(docs):
    pieces = packing.pack(docs, window=64).collect()
    by_sequence = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in by_sequence:  # gapless, full but for the last
        assert r["sequence_id"] * 64 + r["offset"] == at and 0 < r["length"] and r["offset"] + r["length"] <= 64
        at += r["length"]
    whole = {}
    for r in sorted(pieces, key=lambda r: (str(r["doc_id"]), r["sequence_id"], r["offset"])):
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    expected = sorted(crc(library(r["text"], 2)) for r in docs.collect())
    got = []
    for rs in whole.values():
        ids = []
        for r in rs:
            if r["start"] == 0 and ids:
                got.append(crc(ids))
                ids = []
            assert r["start"] == len(ids) and r["continued"] == (r["start"] > 0)
            ids += np.frombuffer(r["ids"], "<u4").tolist()
        got.append(crc(ids))
    assert sorted(got) == expected


def test_pack_nothing(docs):
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_shards_round_trip(spark, docs, planes):
    manifest = bitplanes.write_bitplanes(docs, own_dir(spark, "t"), planes, block=256)
    rows = bitplanes.read_bitplanes(manifest).collect()
    rows.sort(key=lambda r: r["start"])
    source = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert source[0][0] is None
    assert [r["doc_id"] for r in rows] == [i for i, _ in source]
    at = 0
    for r, (_, text) in zip(rows, source, strict=True):
        assert r["start"] == at and r["n_tokens"] == len(library(text, 1)) and r["ids"] == np.array(library(text, 1), "<u4").tobytes()
        at += r["n_tokens"]


def test_shards_of_nothing(spark, docs):
    assert bitplanes.read_bitplanes(bitplanes.write_bitplanes(docs.limit(0), own_dir(spark, "t"))).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=600), st.sampled_from(["byte", "bit"]))
def test_planes(data, kind):
    ids = np.frombuffer(data[: len(data) // 2 * 2], "<u2")
    assert bitplanes.from_planes(bitplanes.to_planes(ids, kind), len(ids), ids.dtype, kind).tolist() == ids.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*"ab .,\né'1-\u0301Σ<|>", "'s", "<|endoftext|>", "word", "42"]), max_size=900).map("".join), st.lists(st.tuples(st.integers(-2, 1600), st.integers(-2, 1600), st.text(st.sampled_from("x \né.'s\u0301"), max_size=6)), max_size=12))
def test_edits(text, edits):
    encoder = word_encoder(tokenizer_path())
    count = lambda s: sum(len(encoder.chunk(c)) for c in edit_counts.SPACE.split(s)) // 2
    full = lambda s: len(library(s, 0)) - 1
    leaves = edit_counts.leaves_of(text)
    tree = edit_counts.CountTree(leaves, [full(x) for x in leaves], count)
    for a, b, new in edits:
        tree.edit(a, b, new)
        a = min(max(a, 0), len(text))
        text = text[:a] + new + text[min(max(b, a), len(text)) :]
        assert "".join(tree.leaves) == text
        assert tree.n_tokens == full(text) == tree.token_sums.before(len(tree.leaves))


def leaves_by_hand(text, edits):
    """(leaves at first, characters encoded): the leaves in a plain list, counted from its start."""
    leaves, n, encoded = edit_counts.leaves_of(text), 0, 0
    n = len(leaves)
    for e in edits:
        size = sum(map(len, leaves))
        a = min(max(e["start"], 0), size)
        b = min(max(e["end"], a), size)
        ends = np.cumsum([len(x) for x in leaves])
        first = min(int(np.searchsorted(ends, a, "right")), len(leaves) - 1)
        base = int(ends[first]) - len(leaves[first])
        if a == base and (k := max((i for i in range(first) if leaves[i]), default=None)) is not None and leaves[k][-1] not in " \n":
            first, base = k, int(ends[k]) - len(leaves[k])
        last = first
        while b >= ends[last] and last + 1 < len(leaves):
            last += 1
        joined = "".join(leaves[first : last + 1])
        leaves[first : last + 1] = [joined[: a - base] + e["replacement"] + joined[b - base :], *[""] * (last - first)]
        encoded += len(leaves[first])
    return n, encoded


def test_leaves_of_text_without_spaces(spark):
    rows = [(1, "a.b," * 5000, [(10000, 10001, "x")]), (2, "7" * 9000, [(0, 0, "1"), (8000, 8100, "")]), (3, None, [(0, 5, "new")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,end:long,replacement:string>>")
    got = {r["doc_id"]: r for r in edit_counts.edited_counts(docs, keep=True).collect()}
    assert got[1]["n_leaves"] > 150 and got[1]["encoded_chars"] < 300 and got[2]["encoded_chars"] < 900
    # A second round on the kept leaves encodes no whole text.
    again = spark.createDataFrame([(i, [tuple(x) for x in r["leaves"]], [(3, 4, "z")]) for i, r in got.items()], f"doc_id long, kept {edit_counts.LEAVES}, edits array<struct<start:long,end:long,replacement:string>>")
    for r in edit_counts.edited_counts(again, leaves="kept").collect():
        text = "".join(x["text"] for x in got[r["doc_id"]]["leaves"])
        assert r["n_tokens"] == got[r["doc_id"]]["versions"][-1] == len(library(text, 0)) - 1
        assert r["versions"] == [len(library(text[:3] + "z" + text[4:], 0)) - 1] and r["encoded_chars"] < 300


SCRIPTS = "abZé ñß我的话日本語한국어ひカΣσςЖ жأب٣४Ⅷ²0159 ，。！「」、：（）…—“”¡¿«».,;:!?()[]{}#=-_'<>|/\u0301\u0338\u3099\n"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=SCRIPTS, max_size=900))
def test_leaves_of_any_script_count_alike(text):
    """Leaves begin only where the tokenizer begins a pre-token: their counts add up."""
    leaves = edit_counts.leaves_of(text)
    assert "".join(leaves) == text
    assert sum(len(library(x, 0)) - 1 for x in leaves) == len(library(text, 0)) - 1


def test_leaves_of_other_scripts(spark):
    """Text without white space in other scripts is many leaves, and an edit re-encodes a few."""
    rows = [(1, "这是一个句子，没有空格。" * 1700, [(9000, 9001, "x")]), (2, "слово,другое—третье" * 900, [(5000, 5003, "д")]), (3, "日本語「テスト」" * 2000, [(1, 1, "。")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,end:long,replacement:string>>")
    for r in edit_counts.edited_counts(docs).collect():
        text, (e,) = next((t, x) for i, t, x in rows if i == r["doc_id"])
        assert r["n_leaves"] > 80 and r["encoded_chars"] < 600
        assert r["n_tokens"] == len(library(text, 0)) - 1 and r["versions"] == [len(library(text[: e[0]] + e[2] + text[e[1] :], 0)) - 1]


def test_edit_query_form(spark, docs):
    from quarterlight.llm.edit_counts import drawn_edits, edited_counts, with_edits

    rows = docs.withColumn("edits", drawn_edits())
    want = {}
    for r in rows.collect():
        text, n = r["text"] or "", []
        for e in r["edits"]:
            text = text[: e["start"]] + e["replacement"] + text[max(e["start"], e["end"]) :]
            n.append(len(library(text, 0)) - 1)
        want.setdefault(r["doc_id"], []).append((len(library(r["text"], 0)) - 1, n, len(text)))
    got = {}
    for r in edited_counts(rows).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["versions"], r["n_chars"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    edits = spark.createDataFrame([(0, 2, 0, 0, "b "), (0, 1, 0, 5, None), (1, 1, None, 3, "x")], "doc_id long, number int, start int, end int, replacement string")
    got = {r["doc_id"]: r["versions"] for r in edited_counts(with_edits(docs.filter("doc_id < 3"), edits)).collect()}
    assert len(got[0]) == 2 and got[1] == [0] and got[2] == []


def test_media(spark, docs):
    store = interleaved.media_store(docs.selectExpr("encode(coalesce(text, ''), 'UTF-8') AS payload"))
    described = {r["digest"]: r for r in interleaved.features(store).collect()}
    for t in TEXTS:
        data = (t or "").encode()
        full = data + bytes((-len(data)) % 64 or (64 if not data else 0))
        r = described[hashlib.sha256(full).hexdigest()]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert interleaved.from_png(interleaved.to_png(full)) == full
    with pytest.raises(ValueError):
        interleaved.from_png(interleaved.to_png(bytes(64))[:-20] + b"x" * 20)


def test_media_query(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        data = (r["text"] or "").encode()
        full = data + bytes((-len(data)) % 64 or (64 if not data else 0))
        want[r["doc_id"]] = (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    got = {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in interleaved.op2_interleaved_media(spark, sf_dir).collect()}
    assert got == want


def test_sequences(spark):
    d = "0" * 64
    html = f'<h1>Title</h1>before <b>bold</b><figure><img src="media:sha256/{d}"><figcaption>The &amp; caption</figcaption></figure>after<img alt="  an alt " src="http://x/y.png"><script>no()</script><p>end'
    pages = spark.createDataFrame([(1, html, "x"), (2, None, "x"), (3, "", "x")], "page_id long, html string, items string")
    got = {r["page_id"]: [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in r["items"]] for r in interleaved.sequences(pages).collect()}
    assert got == {1: [(0, "text", "Title", None, None), (1, "text", "before bold", None, None), (2, "media", None, d, "The & caption"), (3, "text", "after", None, None), (4, "media", None, None, "an alt"), (5, "text", "end", None, None)], 2: [], 3: []}
    described = spark.createDataFrame([(d, 5)], "digest string, payload_bytes long")
    rows = {(r["page_id"], r["position"]): r["payload_bytes"] for r in interleaved.resolved(interleaved.sequences(pages), described).collect()}
    assert rows[(1, 2)] == 5 and rows[(1, 4)] is None and len(rows) == 6


def test_captions_stay_with_their_media():
    def of(html):
        return [(i["kind"], i["text"] or i["caption"]) for i in interleaved.items_of(html)]

    two = '<figure><div><img src="a"><p><figcaption>first</figcaption></div><video src="b"></video><figcaption>second <b>one</b></figcaption><img src="c" alt="x"></figure>'
    assert of(two) == [("media", "first"), ("media", "second one"), ("media", "second one")]
    assert of("one<figure><blockquote>said</blockquote><figcaption>by whom</figcaption></figure>two") == [("text", "one"), ("text", "said"), ("text", "by whom"), ("text", "two")]
    assert of('<figure><figure><img src="in"><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>') == [("media", "inner"), ("text", "outer")]
    deep = '<figure><img src="a"><figcaption>' + "<span>" * 5000 + "deep" + "</span>" * 5000 + "</figcaption></figure>" + "<div>" * 3000 + "end"
    assert of(deep) == [("media", "deep"), ("text", "end")]


def test_pages_of_several_items(spark):
    """Texts and figures of a page resolve in order, the payloads from the store."""
    data = [b"one", b"", b"three" * 50]
    store = interleaved.features(interleaved.media_store(spark.createDataFrame([(bytearray(d),) for d in [*data, data[0]]], "payload binary")))
    digest = [hashlib.sha256(interleaved.padded(d)).hexdigest() for d in data]
    html = "".join(f'<p>text {k}</p><figure><img src="media:sha256/{d}"><figcaption>caption {k}</figcaption></figure>' for k, d in enumerate([*digest, digest[0]]))
    rows = sorted(interleaved.resolved(interleaved.sequences(spark.createDataFrame([(1, html)], "page_id long, html string")), store).collect(), key=lambda r: r["position"])
    assert [(r["text"] or r["caption"], r["payload_bytes"]) for r in rows] == [x for k, n in enumerate((64, 64, 256, 64)) for x in ((f"text {k}", None), (f"caption {k}", n))]
