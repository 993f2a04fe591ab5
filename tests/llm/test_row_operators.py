"""Quality, toxicity, mixing, near-duplicates, wrappers, perspectives: brute force, held-out rows and edge cases."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarterlight.llm import mixing, near_dedup, perspectives, quality, toxicity, wrappers

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing", str(rng.randrange(99))]) for _ in range(n)) + "."


# quality

ODD = ["", None, "one", " \t\n\x0b\x0c\r ", "a b c a b c", "x x x x x x", "line\nline\n\n \nline two\nline", "#*$%&|<> #  nbsp word", "é ü wide"]


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_statistics():
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(200)] + [prose(rng, 3000)]
    s = quality.statistics(pa.array(texts, pa.string()))
    assert list(zip(*(s[c].tolist() for c in quality.STATS[:5]), strict=True)) == [by_hand(t) for t in texts]
    assert all(len(v) == 0 for v in quality.statistics(pa.array([], pa.string())).values())


def test_forest_tells_junk(spark):
    rng = random.Random(5)
    good, junk = [prose(rng, 120) for _ in range(150)], [re.sub(" ", "### ", prose(rng, 100)) for _ in range(20)] + [prose(rng, 90).upper().replace(" ", "!! ") for _ in range(20)]
    rows = [(i, t, i) for i, t in enumerate(good + junk)] + [(999, None, 0), (1000, "short", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 190, 2)], "doc_id long, quality int")
    forest = quality.fit(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(docs, forest).collect()}
    assert sum(kept[i] for i in range(150)) >= 147 and sum(kept[i] for i in range(150, 190)) <= 1 and not kept[999] and not kept[1000]
    accepted = quality.accepted(docs, forest)
    assert accepted.schema == docs.schema and {r["doc_id"] for r in accepted.collect()} == {i for i, k in kept.items() if k}
    none = quality.fit(docs, labels.limit(0))
    assert {r["kept"] for r in quality.judged(docs, none).filter("not base_failed").collect()} == {True}
    assert quality.judged(docs.limit(0), forest).count() == 0


def test_scores_are_path_lengths():
    """Each tree walked by hand; what lies outside the grown rows ends after few splits."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 6))
    x[-1] = 9
    forest = quality.Forest.grow(x[:-1], quality.ranges(x), trees=30, rows=64)

    def depth(at, row, steps=0):
        if not forest.left[at]:
            return forest.depth[at]
        return depth(forest.left[at] + int(row[forest.feature[at]] >= forest.split[at]), row, steps + 1)

    lengths = np.array([np.mean([depth(r, row) for r in forest.roots]) for row in x])
    assert np.allclose(forest.score(x), 2.0 ** (-lengths / quality.path_length(64)))
    assert lengths[-1] < lengths[:-1].min()


def test_all_labelled_rows_count(spark):
    """More labelled rows than the 8192 that a fit once took: box, trees and threshold are those of all of them."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (9000, 6))
    x[8500:] += rng.normal(3, 1, (500, 6))
    rows = [(i, *[100] * 5, i % 100 == 99, *map(float, v)) for i, v in enumerate(x)]
    measured = spark.createDataFrame(rows + [(None, *rows[0][1:]), rows[5]], quality.MEASURED).repartition(7)
    labels = spark.createDataFrame([(i, int(i < 8500)) for i in range(9000)] + [(0, 1), (None, 0)], "doc_id long, quality int")
    forest = quality.fit_measured(measured, labels, trees=20)
    inside = np.arange(9000) % 100 != 99
    x, good = x[inside], (np.arange(9000) < 8500)[inside]
    want = quality.Forest.grow(x[good], quality.ranges(x), trees=20)
    for name in ("feature", "split", "left", "depth", "roots"):
        assert np.array_equal(getattr(forest, name), getattr(want, name)), name
    threshold = quality.best_threshold(want.score(x), good)
    assert threshold < 2 and forest.threshold == pytest.approx(threshold, abs=1e-12)


def test_labels_beyond_the_first_8192_count(spark):
    """The only bad rows are those that a sample by hash would have left out."""
    rng = random.Random(14)
    last = {r[0] for r in spark.range(8300).orderBy(F.xxhash64("id").desc()).limit(40).collect()}
    texts = [prose(rng, 60) for _ in range(50)]
    docs = spark.createDataFrame([(i, texts[i % 50].replace(" ", "### ") if i in last else texts[i % 50]) for i in range(8300)], "doc_id long, text string")
    labels = docs.select("doc_id", (~F.col("text").contains("#")).cast("int").alias("quality"))
    kept = {r["doc_id"] for r in quality.judged(docs, quality.fit(docs, labels)).filter("kept").collect()}
    assert kept == set(range(8300)) - last


def test_threshold_of_a_table(spark):
    rng = np.random.default_rng(12)
    for n, kinds, keep in ((3000, 40, 0.9), (3000, 3000, 0.99), (200, 1, 0.5), (50, 5, 0.0)):
        score = rng.integers(1, kinds + 1, n) / kinds
        good = rng.random(n) > score * 0.7
        table = spark.createDataFrame(list(zip(score.tolist(), good.astype(int).tolist(), strict=True)), "score double, quality int")
        assert quality.best_threshold_of(table, keep) == quality.best_threshold(score, good, keep)
    assert quality.best_threshold_of(table.limit(0)) == 2.0


def test_depths_are_expected_ones_over_draws():
    """Depths against trees of the same cuts that hold drawn rows only."""
    rng = np.random.default_rng(13)
    x = rng.normal(0, 1, (300, 6))
    forest = quality.Forest.grow(x, quality.ranges(x), trees=1, rows=20)
    leaves, total = np.flatnonzero(forest.left == 0), np.zeros(len(forest.left))
    above = {0: []}
    for k in range(len(forest.left)):
        if forest.left[k]:
            above[forest.left[k]] = above[forest.left[k] + 1] = [*above[k], k]
    at = forest.leaves(x)[:, 0]
    for _ in range(1000):
        held = np.zeros(len(forest.left))
        for leaf in at[rng.choice(300, 20, replace=False)]:
            held[[*above[leaf], leaf]] += 1
        for leaf in leaves:
            total[leaf] += sum(held[k] >= 2 for k in above[leaf])
    assert np.abs(total[leaves] / 1000 - forest.depth[leaves]).max() < 0.25
    small = quality.chance_to_meet(np.arange(6), 5, 5)
    assert np.allclose(small, [0, 0, 1, 1, 1, 1]) and np.allclose(quality.chance_to_meet(np.array([2, 3]), 4, 2), [1 / 6, 1 / 2])


# toxicity

class TaskOnly:
    """In place of a DataFrame: what would run in a task is returned."""

    schema = None

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("kind", ["measured", "accepted"])
def test_a_quality_task_needs_little_memory_beside_its_batch(spark, kind):
    """Two tasks, the JVM and what earlier stages left in the workers share an executor."""
    rng = np.random.default_rng(2)
    forest = quality.Forest.grow(rng.random((3000, 6)), np.array([[0.0] * 6, [3.0] * 6]), trees=20)
    run = quality.measured(TaskOnly()) if kind == "measured" else quality.accepted(TaskOnly(), forest)
    words = np.array([f"w{k}" for k in range(20000)])
    texts = [" ".join(words[rng.integers(0, 20000, 300 if k % 9 else 20)]) for k in range(5000)]
    batch = pa.record_batch([pa.array(range(5000)), pa.array(texts)], names=["doc_id", "text"])
    assert batch.column("text").nbytes > 7 << 20
    alone = pa.Table.from_batches([b for k in range(0, 5000, 97) for b in run([batch.slice(k, 97)])])
    tracemalloc.start()
    whole = list(run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20  # numpy's part
    assert pa.Table.from_batches(whole).equals(alone) and 0 < len(alone) <= 5000


INSULTS = ["blockhead", "numskull", "dimwit", "nitwit"]


def test_toxicity_held_out():
    rng = random.Random(9)

    def doc(toxic):
        words = prose(rng, 60).split()
        if toxic:
            words.insert(rng.randrange(60), rng.choice(INSULTS))
        return " ".join(words)

    y = np.array([i % 4 == 0 for i in range(400)])
    texts = [doc(t) for t in y]
    machine = toxicity.train(texts[:300], y[:300])
    got = machine.score(pa.array([*texts[300:], "", None, "you b l o c k h e a d", "such a num-skull", "what a blockxhead"], pa.string()))
    assert ((got[:100] >= 0.7) == y[300:]).all()
    assert (got >= 0).all() and (got <= 1).all() and (got[100:102] < 0.5).all() and (got[102:104] >= 0.7).all()
    assert got[104] > got[:100][~y[300:]].max()
    split = machine.score(pa.array(["what a block head", "a num skull he is", "you di mwit", "alpha beta"]))
    assert (split[:3] >= 0.7).all() and (split[3:] < 0.7).all()


def test_toxicity_disguises():
    """Inserted, replaced and repeated letters and spaces anywhere, at the threshold that rejects."""
    rng = random.Random(3)
    texts, y = [], np.array([i % 6 == 0 for i in range(1200)])
    for toxic in y:
        words = prose(rng, rng.randrange(10, 60)).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "blockhead", "scumbag"]))
        texts.append(" ".join(words))
    machine = toxicity.train(texts, y)
    plain = "idiot moron blockhead scumbag".split()
    gapped = "idxiot 1diot idiiot mor0n morxon bloxckhead blockh3ad scuumbag xxidiotxx idioooooooooooot".split()
    spaced = ["idi ot", "id i ot", "mo ron", "mor on", "bl ock head", "b lockhead", "block head", "i d i o t", "sc um bag"]
    for group in (plain, gapped, spaced):
        got = machine.score(pa.array([f"{prose(rng, 5)} {w} {prose(rng, 5)}" for w in group], pa.string()))
        assert (got >= 0.7).all(), dict(zip(group, got.round(2).tolist(), strict=True))
    clean = machine.score(pa.array([prose(rng, 300) for _ in range(300)], pa.string()))
    assert (clean < 0.7).mean() >= 0.99


def test_parting():
    y = np.array([False] * 90 + [True] * 10)
    assert toxicity.parting(np.r_[np.linspace(-2, -1, 90), np.linspace(1, 2, 10)], y) == 0.0
    tied = toxicity.parting(np.zeros(100), y)
    assert np.isfinite(tied) and tied > 0
    mixed = np.r_[np.linspace(-2, -1, 89), 1.5, np.linspace(1, 2, 10)]
    assert -1 < toxicity.parting(mixed, y) < 2


def test_toxicity_edges(spark):
    constant = toxicity.train(["a", "b"], np.array([False, False]))
    assert (constant.score(pa.array(["x", None])) < 1e-6).all() and len(constant.score(pa.array([], pa.string()))) == 0
    docs = spark.createDataFrame([(1, "x" * 5000, "a"), (1, "x" * 5000, "a"), (None, None, "b")], "doc_id long, text string, held_out string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    assert toxicity.scored(docs, machine).count() == 3 and toxicity.accepted(docs, machine).count() == 3 and toxicity.scored(docs.limit(0), machine).count() == 0


def test_toxicity_sample_bytes(spark):
    rng = random.Random(4)
    rows = [(i, " ".join([prose(rng, 20), INSULTS[i // 4 % 4] if i % 4 == 0 else ""])) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    # The row that comes first is longer than all others may be together: it is left out, the others still teach.
    first = labels.filter(toxicity.fold(F.col("doc_id")) != 1).orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    docs = spark.createDataFrame([(i, "long " * 40000 if i == first else t) for i, t in rows], "doc_id long, text string")
    machine = toxicity.fit(docs, labels, most_bytes=100_000)
    score = machine.score(pa.array(["what a " + w for w in INSULTS] + [prose(rng, 20)]))
    assert (score[:4] >= 0.7).all() and score[4] < 0.7


def test_kernel_by_definition():
    def features(w):
        out = defaultdict(float)
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i - 1)
        return out

    words = ["idiot", "idxiot", "aaaaaa", "abcabc", "a" + "longwords" * 4]
    _, x = toxicity.dense(words, toxicity.letter_table("abcdefghijklmnopqrstuvwxyz"))
    for a, p in enumerate(words):
        for b, q in enumerate(words):
            f, g = features(p), features(q)
            norm = (sum(v * v for v in f.values()) * sum(v * v for v in g.values())) ** 0.5
            assert abs(x[a] @ x[b] - sum(v * g[u] for u, v in f.items()) / norm) < 1e-5


# mixing

def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, ""]), prose(rng, rng.randrange(1, 60))) for i in range(600)]
    rows += [(700, "a", None), (701, "empty", ""), (702, "empty", None), (703, "b", "w " * 900), (5, "b", "same id"), (6, "c", "again"), (6, "c", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "'k' AS key", "0 AS target")
    got = mixing.decisions(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, s, t in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    total, goal, open_ = sum(size.values()), {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    rest = float(total)
    while True:  # share by weight, stop at the cap, share the excess again
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in open_ if share[s] > 3 * size[s]]
        for s in full:
            goal[s] = 3.0 * size[s]
            rest -= goal[s]
            del open_[s]
        if not full:
            goal |= share
            break
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6 * total and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - goal[s]) <= 1000 for s in size) and sum(taken.values()) <= total
    assert sorted(map(str, got)) == sorted(map(str, mixing.decisions(docs.repartition(7)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in Counter({i: sum(r["copies"] for r in got if r["doc_id"] == i) for i, _, _ in rows}).items() if n})
    assert mixing.decisions(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mix_stops_at_latest(spark):
    # "b" queues one document of far more words than its target; "a" runs on, but only to LATEST, though the budget would allow 100.
    rows = [(i, "a", "w") for i in range(100)] + [(100 + i, "c", "w " * 5) for i in range(100)] + [(1000, "b", "w " * 1000)]
    got = mixing.decisions(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1, 5, 1000)).collect()
    goal, taken = {r["source"]: r["target"] for r in got}, Counter()
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
    assert goal["c"] == 1500 and abs(goal["a"] - 100 / 6) < 1e-6 and abs(goal["b"] - 500 / 6) < 1e-6
    assert taken == {"a": int(mixing.LATEST * goal["a"]), "b": 0, "c": 1500}


# near-duplicates

def test_near_duplicates(spark):
    rng = random.Random(11)
    texts, want = [], []

    def add(t, c):
        texts.append(t)
        want.append(c)

    passage = " ".join(f"common{i}" for i in range(60))
    for c in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([150, 250, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            near = list(words)
            near[rng.randrange(len(near))] = f"n{rng.randrange(10**6)}"
            add(" ".join(near), c)
    big = [f"b{i}" for i in range(200)]
    for _ in range(130):  # a large group of near copies
        near = list(big)
        near[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        add(" ".join(near), "big")
    for c in range(80):  # one long passage in many documents
        add(passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)), f"p{c}")
    for t, c in ((None, "none"), ("", "none"), ("!!", "none"), ("Two words", "two"), ("two, WORDS", "two"), ("one", "one")):
        add(t, c)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(5)
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(rows)
    label = {r["doc_id"]: r["first"]["doc_id"] for r in got}
    first = {}
    for i, c in enumerate(want):
        first.setdefault(c, i)
    assert label == {i: first[c] for i, c in enumerate(want)}
    kept = near_dedup.distinct(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values())
    assert near_dedup.classes(docs.limit(0)).count() == 0 and near_dedup.distinct(docs.limit(0)).count() == 0


def weights(texts):
    """Each text's shingles with their weights, from exact document frequencies."""
    bags = [near_bag(t) for t in texts]
    df, n = Counter(s for bag in bags for s in bag), len(texts)
    idf = {s: 1 + near_dedup.DAMP * (np.log(n + 1) - np.log(c + 1)) / np.log(n + 1) for s, c in df.items()}
    return [{s: (1 + np.log(c)) * idf[s] for s, c in bag.items()} for bag in bags]


def near_bag(text):
    words = [w for w in (re.sub(r"[\W_]+", "", x) for x in (text or "").lower().split()) if w]
    return Counter(zip(*[words[i:] for i in range(5)], strict=False)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def weighted_jaccard(a, b):
    low = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a or b else 1.0


def united(names, links):
    first = {n: n for n in names}

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        first[y] = x
    return {n: find(n) for n in names}


def node(i):
    return b"%06d" % i


def groups_of_copies(rng, sizes, words=60):
    """Texts in groups around a common one, with one to many changed words, some runs repeated."""
    for size in sizes:
        base = [f"w{rng.randrange(300)}" for _ in range(words)]
        base += base[:20]
        for _ in range(size):
            near = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                near[rng.randrange(len(near))] = f"n{rng.randrange(10**5)}"
            yield " ".join(near)


@pytest.mark.parametrize("cell", [3, 256])
def test_tiles_leave_no_link_out(spark, monkeypatch, cell):
    """Buckets of any size: the classes are those of all pairs, by weighted Jaccard similarity."""
    monkeypatch.setattr(near_dedup, "CELL", cell)
    texts = list(dict.fromkeys(groups_of_copies(random.Random(1), [1, 2, 2, 3, 7, 30, 45])))
    bucket = [0 if len(t.split()) % 2 else i % 5 for i, t in enumerate(texts)]
    vectors_, idf = near_dedup.vectors(spark.createDataFrame([(t,) for t in texts], "text string")), np.ones(1 << near_dedup.DF_BITS, np.float32)
    digests = near_dedup.shingles(pa.array(texts))[2]
    sets = [{s: 1 + np.log(c) for s, c in near_bag(t).items()} for t in texts]
    # Every text stands in the bucket of band 0 and in one of band 9.
    rows = [(digests[i], len(sets[i]), band, key) for i in range(len(texts)) for band, key in ((0, -1), (9, bucket[i]))]
    member = spark.createDataFrame(rows, "node binary, size int, band int, key long")
    sizes = member.groupBy("key").agg({"node": "count", "size": "sum"}).toDF("key", "n", "shingles").filter("n > 1")
    member = near_dedup.saved(member.join(sizes, "key"))
    labels = near_dedup.components(near_dedup.saved(near_dedup.compared(near_dedup.first_cells(member), vectors_, idf, 0.8)))
    links = near_dedup.saved(near_dedup.compared(near_dedup.later_cells(member, labels), vectors_, idf, 0.8))
    roots = near_dedup.components(links)
    label = {d: d for d in digests} | {bytes(r["node"]): bytes(r["label"]) for r in labels.collect()}
    root = {bytes(r["node"]): bytes(r["label"]) for r in roots.collect()}
    want = united(digests, [(digests[i], digests[j]) for i in range(len(texts)) for j in range(i) if weighted_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9])
    assert {d: root.get(x, x) for d, x in label.items()} == want and 5 < len(set(want.values())) < len(texts)


def test_one_round_joins_near_copies(spark, monkeypatch):
    """Copies whose buckets all agree are dealt anew in each band, so the first bands leave one class and no later tile."""
    monkeypatch.setattr(near_dedup, "CELL", 16)
    rng, seen, later = random.Random(9), [], near_dedup.later_cells

    def spy(member, labels):
        seen.append((labels.count(), labels.select("label").distinct().count(), later(member, labels).count()))
        return later(member, labels)

    monkeypatch.setattr(near_dedup, "later_cells", spy)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = []
    for i in range(160):
        words[rng.randrange(3000)] = f"own{i}"
        rows.append((i, " ".join(words)))
        words = rows[0][1].split()
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["first"]["doc_id"] for r in got} == {0} and seen == [(160, 1, 0)]


def test_components(spark):
    rng = random.Random(3)
    links = [(node(i), node(i + 1)) for i in range(60) if i % 20 != 19]  # chains
    links += [(node(100), node(i)) for i in range(101, 160)]  # a hub
    links += [(node(rng.randrange(200, 300)), node(rng.randrange(200, 300))) for _ in range(60)] + [(node(7), node(7))]
    got = {bytes(r["node"]): bytes(r["label"]) for r in near_dedup.components(spark.createDataFrame(links, "a binary, b binary").repartition(3)).collect()}
    want = united({x for p in links if p[0] != p[1] for x in p}, links)
    assert got == want
    assert near_dedup.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_idf_of_crowded_counters():
    """A counter that many rare shingles share still looks rare, a frequent shingle frequent."""
    rng = np.random.default_rng(2)
    crowded = rng.poisson(500, 1 << 12)
    crowded[5] += 100_000
    idf = near_dedup.damped_idf(crowded, 1_000_000)
    alone = near_dedup.damped_idf(np.r_[np.ones(10, np.int64), 100_000], 1_000_000)
    assert abs(idf[5] - alone[10]) < 0.001 and np.median(idf) > alone[0] - 0.035 and idf.max() <= 1 + near_dedup.DAMP


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    s = near_dedup.mixed(np.arange(1, 401, dtype=np.uint64))
    a, b = rng.uniform(1, 3, 300), rng.uniform(1, 3, 300)
    x = near_dedup.samples(s[:300], np.zeros(300, np.int64), a, 1, 2000)
    y = near_dedup.samples(s[100:], np.zeros(300, np.int64), np.r_[a[100:], b[:100]], 1, 2000)
    true = a[100:].sum() / (a.sum() + b[:100].sum())
    assert abs((x == y).mean() - true) < 0.05


# wrappers

def page(title, paras, share="Share this page now", article=True):
    body = "".join(f"<p>{p}" for p in paras)
    body = f"<article><h1>{title}</h1>{body}</article>" if article else f"<div class=c><h2>{title}</h2>{body}<p>{share}</p></div>"
    return f"<html><head><title>t</title><script>x='<p>'</script></head><body><nav><ul><li>Home<li>About</ul></nav><div class='ad'>Buy!</div>{body}<div id=comments><p>first!</div><footer>&copy; site</footer></body></html>"


def test_wrappers(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(40):
        title, paras = prose(rng, 4), [prose(rng, 30) for _ in range(rng.randrange(1, 5))]
        rows.append((i, f"https://{'a' if i % 2 else 'b'}.example/{i}", page(title, [p.replace("a", "&#97;", 1) for p in paras], article=i % 2 == 0)))
        want[i] = "\n\n".join([title, *paras])
    rows += [(100, None, page("Alone", ["one &amp;  two<br>three", "  "])), (101, "odd url", None), (102, "https://a.example/x", ""), (103, "https://c.example", "plain <b>text</b> only"), (0, rows[0][1], rows[0][2])]
    want |= {100: "Alone\n\none & two three", 101: "", 102: "", 103: "plain text only"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "1 AS template").repartition(4)
    got = wrappers.main_texts(pages).collect()
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got} == want
    assert wrappers.main_texts(pages.limit(0)).count() == 0


def test_wrappers_keep_all_slots():
    rng = random.Random(6)
    html, want = [], []
    for i in range(20):
        title, summary, paras = prose(rng, 4), prose(rng, 8), [prose(rng, 60) for _ in range(3)]
        if i == 7:  # a page whose text is mainly in a sibling of the body
            summary, paras = prose(rng, 90), [prose(rng, 3)]
        html.append(f"<body><p>Welcome to the site</p><div class=post><h1>{title}</h1><div class=summary>{summary}</div><div class=body>{''.join(f'<p>{p}' for p in paras)}</div><div class=more>Read on</div></div></body>")
        want.append("\n\n".join([title, summary, *paras]))
    template = wrappers.skeleton(wrappers.parse(html[0]))
    for page_ in html[1:]:
        template = wrappers.merged(template, wrappers.skeleton(wrappers.parse(page_)))
    assert [wrappers.extracted(page_, wrappers.Wrapper(template)) for page_ in html] == want
    # The template decides: by itself, a page keeps what the others have, too.
    assert all(t.startswith("Welcome to the site") and t.endswith("Read on") for t in (wrappers.extracted(p, None) for p in html))


def learned(html):
    template = wrappers.skeleton(wrappers.parse(html[0]))
    for page_ in html[1:]:
        template = wrappers.merged(template, wrappers.skeleton(wrappers.parse(page_)))
    return wrappers.Wrapper(wrappers.pruned(template))


def test_wrappers_names_do_not_decide():
    rng = random.Random(7)
    # Content under names of boilerplate: kept inside an article, and elsewhere where it holds most of what varies.
    inside = [(prose(rng, 30), prose(rng, 20)) for _ in range(12)]
    html = [f"<body><div class=ad>{prose(rng, 9)}</div><article><p>Share this</p><p>{a}</p><p class=notice>{b}</p><section class=related-work><p>end {i}</p></section></article><div id=comments><p>{prose(rng, 80)}</p></div></body>" for i, (a, b) in enumerate(inside)]
    wrapper = learned(html)
    assert [wrapper.blocks(wrappers.parse(h)) for h in html] == [[a, b, f"end {i}"] for i, (a, b) in enumerate(inside)]
    html = [f"<body><div class=sidebar>{prose(rng, 5)}</div><div class='social post'><h2>{a}</h2><p>{b}</p></div><div class=comments>{prose(rng, 90)}</div><p>Contact us</p></body>" for a, b in inside]
    wrapper = learned(html)
    assert [wrapper.blocks(wrappers.parse(h)) for h in html] == [[a, b] for a, b in inside]
    # A text that one page has many times is no template.
    html = [f"<body><article><p>{prose(rng, 9)}</p></article></body>" for _ in range(20)] + ["<body><article>" + "<p>again</p>" * 60 + "</article></body>"]
    assert learned(html).blocks(wrappers.parse(html[-1])) == ["again"] * 60


def chrome(body):
    return f"<body><div class=top><a href=/>Home</a> <a href=/a>About</a></div>{body}<div class=end>All rights reserved</div></body>"


@pytest.mark.parametrize("article", [True, False])
def test_wrappers_keep_near_copies(article):
    """Pages that have most of their text in common keep it; what all pages have around it goes."""
    rng = random.Random(8)
    put = lambda paras: chrome(f"<{'article' if article else 'div class=c'}>{''.join(f'<p>{p}</p>' for p in paras)}</{'article' if article else 'div'}>")
    shared, other = [prose(rng, 30) for _ in range(5)], [[prose(rng, 30) for _ in range(6)] for _ in range(4)]
    for copies, others in ((39, 1), (6, 4), (20, 0)):
        texts = [[*shared[:2], prose(rng, 30), *shared[2:]] for _ in range(copies)] + other[:others]
        html = [put(x) for x in texts]
        wrapper = learned(html)
        assert [wrapper.blocks(wrappers.parse(h)) for h in html] == texts


def test_wrappers_by_template_alone():
    """Neutral names and no article: the template decides, and pages by themselves keep what it drops."""
    rng = random.Random(12)
    texts = [[prose(rng, 5), *[prose(rng, 40) for _ in range(rng.randrange(2, 6))]] for _ in range(30)]
    html = [chrome(f"<div class=c><h1>{x[0]}</h1>{''.join(f'<p>{p}</p>' for p in x[1:])}<p>Read the terms of use</p></div><div class=e><p>Offices in Ulm</p></div>") for x in texts]
    wrapper = learned(html)
    assert [wrapper.blocks(wrappers.parse(h)) for h in html] == texts
    alone = [wrappers.extracted(h, None).split("\n\n") for h in html]
    assert all(a != x and a[0] == "Home About" and a[-1] == "All rights reserved" for a, x in zip(alone, texts, strict=True))


def test_wrappers_headings_comments_and_teasers():
    rng = random.Random(10)
    rows = [[prose(rng, 6), "Ingredients", prose(rng, 30), prose(rng, 20), prose(rng, 20), prose(rng, 12)] for _ in range(15)]
    html = [
        chrome(
            f"<article><h1>{a}</h1><h2>{b}</h2><p>{c}</p><section id=comments-on-kant><p>{d}</p></section><div class=reply>{e}</div><p class=social-comment>{f}</p><div class=comments><p>{prose(rng, 9)}</p></div></article>"
            f"<div class=more><article>{prose(rng, 4)}</article><article>{prose(rng, 4)}</article></div>"
        )
        for a, b, c, d, e, f in rows
    ]
    wrapper = learned(html)
    assert [wrapper.blocks(wrappers.parse(h)) for h in html] == rows
    # Without an article, paragraphs that vary stay whatever they are called, and names are read as a whole.
    rows = [[prose(rng, 40), prose(rng, 20), prose(rng, 30)] for _ in range(15)]
    html = [chrome(f"<div class=c><p>{a}</p><p class=notice>{b}</p><div class=related-work>{c}</div></div><div class=related-posts>{prose(rng, 8)}</div><div class=sidebar-left><ul><li>{prose(rng, 6)}</ul></div>") for a, b, c in rows]
    wrapper = learned(html)
    assert [wrapper.blocks(wrappers.parse(h)) for h in html] == rows


def test_wrappers_of_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "<p>in the deep" + "</div>" * 5000 + "<p>after it<nav><div>menu</div></nav><script>no()</script>"
    spans = ("<p>" + "<span>" * 3000 + "inline" + "</span>" * 3000 + " text</p><ul>") * 2
    long = "<article>" + "".join(f"<p>{i} words" for i in range(20000)) + "</article>"
    pages = spark.createDataFrame([(i, f"http://h{i % 2}/", h) for i, h in enumerate((deep, spans, long, deep, None))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(pages).collect()}
    assert got[0] == got[3] == "in the deep\n\nafter it" and got[1] == "inline text\n\ninline text" and got[4] == ""
    assert got[2].split("\n\n") == [f"{i} words" for i in range(20000)]


def test_wrappers_beyond_the_broadcast(spark, monkeypatch):
    rng = random.Random(8)
    pages = spark.createDataFrame([(i, "http://one/" if i % 3 else None, f"<body><p>Menu</p><div>{prose(rng, 20)}</div></body>") for i in range(60)] * 2, "page_id long, url string, html string")
    want = sorted(map(tuple, wrappers.main_texts(pages).collect()), key=str)
    monkeypatch.setattr(wrappers, "SHIPPED", 0)
    assert sorted(map(tuple, wrappers.main_texts(pages).collect()), key=str) == want and not any("Menu" in r[2] for r in want)


def test_tree_matching():
    t = lambda tag, *children: [tag, 1, 0, 0, {}, list(children)]
    a, b = t("body", t("nav"), t("div", t("p"), t("ul")), t("footer")), t("body", t("div", t("p")), t("aside"), t("footer"))
    assert wrappers.matched(a, b)[0] == 4
    m = wrappers.merged(a, b)
    assert [c[0] for c in m[5]] == ["nav", "div", "aside", "footer"] and m[5][1][1] == 2 and m[1] == 2


def test_summaries_keep_frequent_texts():
    total = {}
    for i in range(1000):
        total = wrappers.summed(total, {"often": 1, f"r{i}": 1})
    assert total["often"] > 1000 - 2000 / wrappers.TEXTS and len(total) <= wrappers.TEXTS


# perspectives

def test_perspectives(spark):
    rows = [(1, t, ["ann", "bob", None][t % 3], f"text {t} <|assistant|>") for t in range(700)] + [(1, 700, "system", "rules"), (2, None, "ann", None), (2, 0, "ann", "x"), (2, 0, "ann", "x"), (2, 0, "a<|\nb", "y"), (3, 0, "system", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS start", "'s' AS span")
    got = defaultdict(list)
    for r in perspectives.rotate(turns).collect():
        got[(r["conv_id"], r["perspective"])].append(r)
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (2, "a<|\nb")}
    for (conv, who), parts in got.items():
        parts.sort(key=lambda r: r["position"])
        assert [r["position"] for r in parts] == list(range(sum(x[0] == conv for x in rows)))
        whole = "".join(r["segment"] for r in parts)
        for r in parts:
            assert whole[r["start"] :].startswith(r["segment"])
            masked = whole[r["mask_start"] : r["mask_end"]]
            assert (masked != "") == (r["role"] == "assistant") and (not masked or r["segment"] == f"<|assistant|>\n{masked}")
        assert whole.count("<|assistant|>") == sum((x[2] or "unknown") == who for x in rows if x[0] == conv)
    assert perspectives.rotate(turns.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op5_weighted_fair_queueing", "op10_perspective_rotation", "op11_importance_resampling", "op12_radix_negatives"])
def test_matches_sql(spark, duck, sf_dir, name):
    from compare import same

    from quarterlight.llm import queries

    same(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name]))
