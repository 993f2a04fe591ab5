"""Operators 11 to 13 against brute force: whole small tables, then edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from quarterlight.llm import hard_negatives, resampling, substrings
from quarterlight.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Substrings.


def repeats_by_hand(texts, k):
    """(words, covered word numbers, maximal spans, kept text) of each text."""
    split = [WORD.findall(t or "") for t in texts]
    often = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for w in split:
        gone = sorted({j for i in range(len(w) - k + 1) if often[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})
        spans = []
        for j in gone:
            if spans and spans[-1][1] == j:
                spans[-1][1] = j + 1
            else:
                spans.append([j, j + 1])
        out.append((len(w), len(gone), [tuple(s) for s in spans], " ".join(x for j, x in enumerate(w) if j not in set(gone))))
    return out


def test_op13(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    want = {d["doc_id"]: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, _, kept) in zip(docs, repeats_by_hand([d["text"] for d in docs], 35), strict=True)}
    got = QUERIES["op13_fixed_block_anchors"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want and len(got) == len(docs)
    assert sum(w[1] for w in want.values()) > 0


def texts_with_repeats(rng):
    word = lambda: rng.choice(["ä", "b", "cc", "Über", "e,", "f"]) + str(rng.randrange(200))
    shared = [" ".join(word() for _ in range(n)) for n in (34, 35, 36, 60, 120)]
    texts = [" ".join(word() for _ in range(rng.randrange(80))) for _ in range(30)]
    for i, s in enumerate(shared):
        for _ in range(3):
            at = rng.randrange(30)
            texts[at] = f"{texts[at]}{rng.choice([' ', chr(10), chr(9) + ' '])}{s} tail{i}-{rng.randrange(10**6)} {texts[at][:40]}"
    texts += [None, "", "  \n ", "same " * 90, "a b " * 40, "x y " * 36, texts[0], texts[0], " ".join(shared[3].split()[:35]), "one " + " ".join(shared[4].split()[50:90])]
    return texts + [" ".join(word() for _ in range(5000))] * 2


@pytest.mark.parametrize(("window", "size"), [(35, 1 << 22), (35, 300), (6, 2000), (7, 300), (2, 1 << 20), (1, 4000)])
def test_substrings(spark, monkeypatch, window, size):
    monkeypatch.setattr(substrings, "SLICE_BYTES", size)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 3000)
    texts = texts_with_repeats(random.Random(window))
    ids = [None if i == 3 else i % 40 for i in range(len(texts))]  # null and repeated ids
    rows = [(i, t, "x", 1.0) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, spans string, slice double").repartition(5)
    got = substrings.without_repeats(docs, window).collect()
    want = [(i, n, gone, spans, kept) for i, (n, gone, spans, kept) in zip(ids, repeats_by_hand(texts, window), strict=True)]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], [tuple(s) for s in r["spans"]], r["text"])) for r in got)


def test_substrings_of_nothing(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = substrings.without_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, [], "")]


def test_substrings_shared_by_all(spark, monkeypatch):
    """A passage of all documents asks a range once for each slice."""
    monkeypatch.setattr(substrings, "SLICE_BYTES", 20_000)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"own{i} words{i} {passage} end{i}") for i in range(400)], "doc_id long, text string").repartition(4)
    got = substrings.without_repeats(docs).collect()
    assert len(got) == 400 and all(r["text"] == f"own{r['doc_id']} words{r['doc_id']} end{r['doc_id']}" and r["n_removed"] == 40 for r in got)


def test_runs():
    import numpy as np

    words = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    for k in (1, 2, 3, 17, 18, 35, 64):
        h = substrings.runs(words, k)
        as_words = [tuple(words[i : i + k].tolist()) for i in range(400 - k + 1)]
        assert len(h) == len(as_words) and len(set(h.tolist())) == len(set(as_words)) == len(set(zip(h.tolist(), as_words, strict=True)))


# Hard negatives.


def negatives_by_hand(rows, every, positives, negatives):
    """Each row is (vec_id, label, vector); result tuples without order."""
    part = []
    for i, (vec_id, label, vector) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            part.append((i, vec_id, label, [math.floor(256 * x) for x in vector]))
    last = lambda v: (v is None, v or 0)
    out = []
    for i, a, label, v in part:
        if a is None or a % every:
            continue
        score = {j: sum(x * y for x, y in zip(v, u, strict=False)) for j, _, _, u in part}
        order = sorted(part, key=lambda r: (-score[r[0]], last(r[1])))
        for p in [r for r in order if r[2] == label and r[0] != i][:positives]:
            inside = [r for r in order if r[2] != label and 80 * score[p[0]] <= 100 * score[r[0]] <= 100 * score[p[0]]]
            out += [(a, p[1], k + 1, r[1], score[p[0]], score[r[0]]) for k, r in enumerate(inside[:negatives])]
    return out


def drawn_vectors(rng, n, width=6):
    rows = [(i, rng.randrange(3), [round(rng.gauss(0.3, 0.4), 2) for _ in range(width)]) for i in range(n)]
    copy = rows[17][2]
    rows += [(1000 + i, rng.randrange(3), copy) for i in range(60)]  # ties
    rows += [(None, 1, copy), (None, 2, [0.5] * width), (None, None, copy), (2000, None, copy), (2100, 1, None), (2200, 2, [0.1, None]), (2300, 0, [float("nan")] * width), (2400, 0, [float("inf")] * width)]
    rows += [(2500, 1, []), (2600, 2, [0.9, 0.9]), (2700, 2, [0.4] * (width + 3)), (2800, 0, [-0.5] * width), rows[40], rows[40], rows[20], rows[20]]
    return rows


@pytest.mark.parametrize(("anchors", "bits", "spare"), [(4096, 8, 8), (3, 2, 1), (1, 3, 0)])
def test_negatives(spark, monkeypatch, anchors, bits, spare):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "DIGIT_BITS", bits)
    monkeypatch.setattr(hard_negatives, "SPARE", spare)
    rows = drawn_vectors(random.Random(bits), 120)
    every = 100 if anchors < 10 else 20
    frame = spark.createDataFrame([(v, l, x, 1, "x") for v, l, x in rows], "vec_id long, label int, embedding array<float>, row int, target string").repartition(3)
    exact = [(v, l, None if x is None else [None if y is None else struct_float(y) for y in x]) for v, l, x in rows]
    got = hard_negatives.mined(frame, every, 4, 3).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, negatives_by_hand(exact, every, 4, 3))) and got


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_negatives_of_nothing(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.mined(spark.createDataFrame([], schema)).collect() == []
    assert hard_negatives.mined(spark.createDataFrame([(1, 1, [0.1]), (3, 2, [0.1])], schema)).collect() == []  # no anchor
    assert hard_negatives.mined(spark.createDataFrame([(100, 1, [0.1]), (3, 2, [0.1])], schema)).collect() == []  # no positive


def test_negatives_of_great_numbers(spark):
    """Scores beyond 2 ** 53 are exact, beyond 2 ** 63 held at the limit."""
    schema = "vec_id long, label int, embedding array<double>"
    big = float(1 << 22)
    rows = [(100, 1, [big, 1.0]), (1, 1, [big, 1.0]), (2, 2, [big, 0.0]), (3, 2, [big, 1.0]), (4, 2, [0.0, 1.0]), (5, 2, [big, -1.0])]
    got = sorted(map(tuple, hard_negatives.mined(spark.createDataFrame(rows, schema)).collect()))
    assert got == sorted(negatives_by_hand([(a, b, c) for a, b, c in rows], 100, 5, 5)) and len(got) == 3
    huge = [(100, 1, [1e30]), (1, 1, [1e30]), (2, 2, [1e30])]
    assert [r["negative_score"] for r in hard_negatives.mined(spark.createDataFrame(huge, schema)).collect()] == [(1 << 63) - 1]


# Resampling.


def draw_by_hand(docs, target, share, least):
    lower = str.maketrans(resampling.UPPER, resampling.LOWER)

    def buckets(text):
        w = re.findall(resampling.WORDS, (text or "").translate(lower))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    own = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for *_, bs in own for b in bs), Counter(b for x in target for b in buckets(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10000.0) / ((s[b] + 1.0) * (t.total() + 10000.0))))
    known = {b: gain(b) for b in s}
    rows = []
    for i, n, bs in own:
        weight = sum(known[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[5] = k + 1
    return rows


def test_resampling(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["Straße", "ÀB", "x9", "and", "THE", "it's", "n b", "日本", "o"]) + rng.choice(["", "", "1", "-", "!"])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "?!"), (None, " ".join(["the"] * 30)), (403, "one"), (404, "x y " * 20_000)]
    docs += [(500 + i, docs[7][1]) for i in range(50)]
    target = ["The straße and it", None, "", "o o o"]
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, rank string, score int").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(frame, aim).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(r)) for r in draw_by_hand(docs, target, 25, 20))
    assert sum(r["rank"] is not None for r in got) == 25 * sum(r["n_words"] >= 20 for r in got) // 100 > 0


def test_resampling_of_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 3, "a b c d " * 6) for i in range(12)], "doc_id long, text string")
    got = resampling.resampled(docs, docs.limit(0), share=50).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == [1, 2, 3, 4, 5, 6]
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(r["score"])
    assert all(len(s) == 1 for s in by_id.values())


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resampled(none, none).collect() == []
    short = resampling.resampled(spark.createDataFrame([(1, "few words")], "doc_id long, text string"), none).collect()
    assert [(r["n_features"], r["rank"]) for r in short] == [(3, None)]


def test_gains_are_one_literal(spark):
    rows = spark.createDataFrame([(1, 2, 3, [0, 9999])], "doc_id long, tie long, n_words long, buckets array<short>")
    out = resampling.scored(rows, list(range(10_000)))
    assert out.first()["weight"] == 4999
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "explode" not in plan
