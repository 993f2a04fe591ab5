"""Toxicity: a subsequence string-kernel SVM with Nystroem landmarks.

Two words are as similar as the letter subsequences that they share: each
subsequence of three letters counts DECAY ** (letters it spans), up to SPAN
letters, normalised (Lodhi et al., 2002).  Inserted or replaced letters only
weaken an insult's subsequences, they don't remove them.

Training reads a bounded sample of labelled rows (SAMPLE rows and SAMPLE_BYTES of whole texts) in
one task; only the machine goes to the driver.  A toxic document's witness is its word that looks
most toxic and that clean documents don't have: at first by its log-odds over the training documents,
then by the machine itself, which is trained again with the clean words that it takes for most
toxic added to the others (multiple-instance learning).  LANDMARKS witnesses span the
Nystroem feature space, in which a linear SVM (squared hinge) is solved.  The
decision on a word is then a weighted sum over its own subsequences, so scoring
needs no landmark at all.  A document's score is the logistic of its most toxic
word's decision, calibrated on one labelled document of CALIBRATE that the machine has not seen, so that REJECT parts the
two kinds best.

Letters are numbered by an alphabet learned from the training words (the ALPHABET - 1 most
frequent ones); any other letter matches nothing.

Every word of every whole text is scored.  Words longer than WIDE letters are read
through windows that overlap by all but STEP letters; runs of single letters
("s p a c e d") count as one word, and so do two neighbours that are the first
and the last part of toxic witnesses, three letters each, unless clean training documents
have them side by side, too ("spa ced").  Up to PIECES neighbours of any length count as one word if that
is a witness ("s pac ed"), letters that stand three times or more also count once ("spaaaaced"), and digits among letters
also as the letters that they look like ("sp4ced").  Words of one or two letters have no
subsequence and count only in these joins.  Null or empty text has no word: it gets the
score of the least decision.  Without labels of both kinds all scores are the share of toxic rows
(0 if there is none).  Repeated rows score alike; an empty table stays empty.
``accepted`` keeps all columns as they are.
"""

from __future__ import annotations

import functools
import pickle
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .texts import give_back, sliced, split_words

SAMPLE = 5000
SAMPLE_BYTES = 64 << 20
LANDMARKS = 512
DECAY = 0.6
SPAN = 7
WIDE = 14
STEP = 2
ROUNDS = 5
#: Words seen in so many toxic documents, and in no more than WRONG clean ones for each, are witnesses from the
#: start, if EXPLAINED of the toxic documents can be explained by words that are seen as often.
SEEN = 3
WRONG = 0.1
EXPLAINED = 0.98
#: Clean words that each round adds.
HARD = 768
#: A clean word counts as often as it is seen, up to here.
OFTEN = 20
#: What a disguised witness counts, where a witness counts 10 each time that it is seen; only witnesses that are seen in so many
#: documents, as a share of the most frequent one's, are disguised.
GAPPED, DISGUISED = 4.0, 0.25
#: Pieces of a witness with spaces in it.
PIECES = 4
#: What a clean document that is rejected counts, against a toxic one that is not.
FALSE = 4.0
#: One document of so many only calibrates the score.
CALIBRATE = 5
REJECT = 0.7
#: Letters that are told apart, with one number for all others.
ALPHABET = 64
#: Words whose subsequences are weighed at a time; a word has some hundred of them.
WORDS = 1 << 11
REPEATED = "|".join(f"{c}{c}{c}" for c in "abcdefghijklmnopqrstuvwxyzàáâäçèéêëìíîïñòóôöùúûüß")
#: Digits among letters are read as the letters that they look like, too.
READ_AS, LETTERS = "[a-z][0134578]|[0134578][a-z]", str.maketrans("0134578", "oieastb")
SPACED = re.compile(r"(?:(?<=\s)|^)\w(?:\s+\w){2,}(?=\s|$)")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@functools.lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the three-letter subsequences of n letters, and their spans less 3."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    return np.array(at, np.int64).reshape(-1, 3).T, np.array([k - i - 2 for i, _, k in at], np.int64)


def letter_table(alphabet: str) -> np.ndarray:
    """The number of each code point: from 1 by its place in the alphabet, else 0."""
    table = np.zeros(0x110000, np.uint8)
    table[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
    return table


def letters(words: pa.Array, n: int, table: np.ndarray) -> np.ndarray:
    """Letter numbers of words of n letters, one row each."""
    joined = "".join(words.to_pylist())
    return table[np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(-1, n)].astype(np.int64)


def known_letters(sub: np.ndarray) -> np.ndarray:
    """Whether all three letters of a subsequence are in the alphabet."""
    return (sub % ALPHABET > 0) & (sub // ALPHABET % ALPHABET > 0) & (sub // ALPHABET**2 > 0)


def subsequences(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, normalised weight) of words of one length, each subsequence once a word."""
    (i, j, k), span = triples(code.shape[1])
    key = np.sort((((code[:, i] * ALPHABET + code[:, j]) * ALPHABET + code[:, k]) << 3) | span, axis=1)
    new = np.ones(key.shape, bool)
    new[:, 1:] = key[:, 1:] >> 3 != key[:, :-1] >> 3
    starts = np.flatnonzero(new.ravel())
    weight = np.add.reduceat((DECAY ** np.arange(1, 9))[key.ravel() & 7], starts)
    word = starts // key.shape[1]
    norm = np.sqrt(np.bincount(word, weight * weight, len(code)))
    return word, (key.ravel() >> 3)[starts], weight / norm[word]


def by_length(words: pa.Array, table: np.ndarray, whole: bool = False):
    """Yields (places, words) for each length; unless ``whole``, longer words as windows of WIDE letters."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[(sizes >= 3) & (whole | (sizes <= WIDE))]).tolist():
        at = np.flatnonzero(sizes == n)
        yield at, letters(words.take(pa.array(at)), n, table)
    at = np.flatnonzero(sizes > WIDE)
    if len(at) and not whole:
        place, parts = [], []
        for p, w in zip(at.tolist(), words.take(pa.array(at)).to_pylist(), strict=True):
            cuts = [w[a : a + WIDE] for a in range(0, len(w) - WIDE, STEP)] + [w[-WIDE:]]
            place += [p] * len(cuts)
            parts += cuts
            if len(parts) >= 1 << 15:
                yield np.array(place), letters(pa.array(parts), WIDE, table)
                place, parts = [], []
        if parts:
            yield np.array(place), letters(pa.array(parts), WIDE, table)


def normal(words: pa.Array) -> pa.Array:
    """Lower case, letters and digits only."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\pL\pN]+", "")


@dataclass
class Machine:
    """decision(word) = sum of weight[subsequence] * its normalised weight in the word + bias."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float
    alphabet: str = ""
    #: First and last parts of toxic witnesses.
    heads: tuple[str, ...] = ()
    tails: tuple[str, ...] = ()
    #: Joined neighbours that clean training documents have, too.
    innocent: tuple[str, ...] = ()
    #: The toxic witnesses that are joined of any pieces.
    known: tuple[str, ...] = ()

    @functools.cached_property
    def table(self) -> np.ndarray:
        return letter_table(self.alphabet)

    def decide(self, words: pa.Array) -> np.ndarray:
        out = np.full(len(words), self.bias)
        seen = np.full(len(words), -np.inf)
        for at, code in by_length(words, self.table):
            for a in range(0, len(code), WORDS):
                word, sub, w = subsequences(code[a : a + WORDS])
                np.maximum.at(seen, at[a : a + WORDS], np.bincount(word, w * self.weight[sub], len(code[a : a + WORDS])))
        long = seen > -np.inf
        out[long] += seen[long]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        """Each text's score."""
        best = np.full(len(texts), self.bias)
        for words, row in documents_words(texts, self.heads, self.tails, self.innocent, self.known):
            decision = self.decide(words.dictionary)[words.indices.to_numpy()]
            np.maximum.at(best, row, decision)
        return 1 / (1 + np.exp(-(self.slope * best + self.offset)))


def documents_words(texts: pa.Array, heads: tuple[str, ...] = (), tails: tuple[str, ...] = (), innocent: tuple[str, ...] = (), known: tuple[str, ...] = ()):
    """(dictionary-coded normal words, their rows): the words, neighbours that belong
    together (``neighbours``, ``in_pieces``) as one word, words without repeated letters, and runs of spaced single letters."""
    words, row = split_words(texts)
    plain = normal(words.dictionary).dictionary_encode()
    code = plain.indices.take(words.indices)
    yield pa.DictionaryArray.from_arrays(code, plain.dictionary), row
    joined, at = neighbours(plain.dictionary, code.to_numpy(), row, heads, tails)
    some = pc.invert(pc.is_in(joined, value_set=pa.array(innocent, pa.string())))
    if pc.any(some).as_py():
        yield joined.filter(some).dictionary_encode(), at[some.to_numpy(zero_copy_only=False)]
    for n in range(2, PIECES + 1):
        joined, at = in_pieces(plain.dictionary, code.to_numpy(), row, known, n)
        joined, at = joined.filter(some := pc.invert(pc.is_in(joined, value_set=pa.array(innocent, pa.string())))), at[some.to_numpy(zero_copy_only=False)]
        if len(at):
            yield joined.dictionary_encode(), at
    other = pc.match_substring_regex(plain.dictionary, f"{REPEATED}|{READ_AS}").to_numpy(zero_copy_only=False)
    if other.any():
        here = np.flatnonzero(other[code.to_numpy()])
        names = plain.dictionary.take(code.take(pa.array(here)))
        yield pa.array([re.sub(r"(.)\1{2,}", r"\1", w).translate(LETTERS) for w in names.to_pylist()]).dictionary_encode(), row[here]
    runs, at = [], []
    spaced = pc.match_substring_regex(pc.fill_null(texts, ""), r"(^|\s)\w\s+\w\s+\w(\s|$)")
    for i in np.flatnonzero(spaced.to_numpy(zero_copy_only=False)).tolist():
        for m in SPACED.finditer(texts[i].as_py()):
            runs.append("".join(m[0].split()))
            at.append(i)
    if runs:
        yield normal(pa.array(runs)).dictionary_encode(), np.array(at)


def neighbours(names: pa.Array, code: np.ndarray, row: np.ndarray, heads: tuple[str, ...], tails: tuple[str, ...]) -> tuple[pa.Array, np.ndarray]:
    """Two words side by side, joined, where the first is one of ``heads`` and the second one of ``tails``; their rows."""
    if not len(code) or not heads:
        return pa.array([], pa.string()), row[:0]
    first, last = (pc.is_in(names, value_set=pa.array(x, pa.string())).to_numpy(zero_copy_only=False)[code] for x in (heads, tails))
    pair = np.flatnonzero(first[:-1] & last[1:] & (row[:-1] == row[1:]))
    return pc.binary_join_element_wise(names.take(pa.array(code[pair])), names.take(pa.array(code[pair + 1])), ""), row[pair]


def in_pieces(names: pa.Array, code: np.ndarray, row: np.ndarray, known: tuple[str, ...], n: int) -> tuple[pa.Array, np.ndarray]:
    """n words side by side that make one of ``known``; their rows."""
    if len(code) < n or not known:
        return pa.array([], pa.string()), row[:0]
    first, last = {w[:k] for w in known for k in range(1, len(w))}, {w[k:] for w in known for k in range(1, len(w))}
    inner = {w[a:b] for w in known for a in range(1, len(w)) for b in range(a + 1, len(w))} if n > 2 else set()
    may = [pc.is_in(names, value_set=pa.array(sorted(x), pa.string())).to_numpy(zero_copy_only=False)[code] for x in (first, inner, last)]
    size = len(code) - n + 1
    ok = may[0][:size] & may[2][n - 1 :] & (row[:size] == row[n - 1 :])
    for k in range(1, n - 1):
        ok &= may[1][k : k + size]
    at = np.flatnonzero(ok)
    joined = pc.binary_join_element_wise(*[names.take(pa.array(code[at + k])) for k in range(n)], "")
    some = pc.is_in(joined, value_set=pa.array(known, pa.string())).to_numpy(zero_copy_only=False)
    return joined.filter(pa.array(some)), row[at[some]]


def solve(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear SVM, squared hinge, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(x), bool)
    for _ in range(30):
        a, c = x[active], cost[active]
        w = np.linalg.solve(ridge + a.T @ (a * c[:, None]), a.T @ (c * y[active]))
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's calibration by Newton steps; a slight ridge keeps it finite."""
    x, w = np.stack([f, np.ones(len(f))], axis=1), np.zeros(2)
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def parting(f: np.ndarray, y: np.ndarray) -> float:
    """The decision that parts two kinds best, the share of clean documents above it counting FALSE times that
    of toxic ones below it; the middle of the widest gap, if there are several."""
    order = np.argsort(f)
    f, y = f[order], y[order]
    lost = np.r_[0, np.cumsum(y)] / y.sum() + FALSE * np.r_[0, np.cumsum(~y[::-1])][::-1] / (~y).sum()
    edges = np.r_[f[0] - 1, f, f[-1] + 1]
    width = edges[1:] - edges[:-1]
    lost[width <= 0] = np.inf
    best = np.flatnonzero(lost <= lost.min() + 1e-12)
    at = best[np.argmax(width[best])]
    return float(edges[at] + edges[at + 1]) / 2


def dense(words: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subsequences that occur, a row of weights for each whole word)"""
    word, sub, weight = [], [], []
    for at, code in by_length(pa.array(words, pa.string()), table, whole=True):
        i, u, w = subsequences(code)
        some = known_letters(u)
        word.append(at[i[some]]), sub.append(u[some]), weight.append(w[some])
    word, sub, weight = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (word, sub, weight))
    known, column = np.unique(sub, return_inverse=True)
    out = np.zeros((len(words), len(known)), np.float32)
    out[word, column] = weight
    return known, out


def against(words: list[str], subs: np.ndarray, z: np.ndarray, table: np.ndarray, rows: int = 512) -> np.ndarray:
    """The kernel of each word with the landmarks, whose subsequences are ``subs`` and weights ``z``."""
    out = np.zeros((len(words), len(z)))
    for a in range(0, len(words), rows):
        mine, x = dense(words[a : a + rows], table)
        common, i, j = np.intersect1d(mine, subs, assume_unique=True, return_indices=True)
        out[a : a + rows] = x[:, i] @ z[:, j].T
    return out


def parts(words: list[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """First and last parts, of three letters at least, of words cut in two."""
    cuts = [(w[:k], w[k:]) for w in words for k in range(3, len(w) - 2)]
    return tuple(sorted({a for a, _ in cuts})), tuple(sorted({b for _, b in cuts}))


def explaining(word: np.ndarray, doc: np.ndarray, often: np.ndarray) -> int:
    """How often a word must be seen to be a witness: the most frequent words are taken until
    EXPLAINED of the documents hold one of them; rarer words come from chance or copies."""
    left, at = set(doc.tolist()), np.argsort(-often[word], kind="stable")
    few = (1 - EXPLAINED) * len(left)
    for w, d in zip(word[at].tolist(), doc[at].tolist(), strict=True):
        left.discard(d)
        if len(left) <= few:
            return int(often[w])
    return 0


def beside(texts: list[str], machine: Machine) -> tuple[str, ...]:
    """The neighbours that the machine would join in these texts."""
    out: set[str] = set()
    for batch in sliced([pa.record_batch([pa.array(texts, pa.string())], names=["text"])]):
        words, row = split_words(batch.column("text"))
        plain = normal(words.dictionary).dictionary_encode()
        code = plain.indices.take(words.indices).to_numpy()
        found = [neighbours(plain.dictionary, code, row, machine.heads, machine.tails), *[in_pieces(plain.dictionary, code, row, machine.known, n) for n in range(2, PIECES + 1)]]
        out.update(w for joined, _ in found for w in joined.unique().to_pylist())
    return tuple(sorted(out))


def inserted(word: str) -> list[str]:
    """The word with letters put in or replaced, as insults are disguised."""
    if len(word) < 4:
        return []
    k, n = zlib.crc32(word.encode()), len(word)
    put = [word[:at] + "abcdefghijklmnopqrstuvwxyz"[(k // 7 + 5 * at) % 26] + word[at:] for at in {1, n // 2, n - 1}]
    return put + [word[:at] + "013457x"[(k // 11 + at) % 7] + word[at + 1 :] for at in range(0, n, max(1, n // 4))]


def train(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Machine:
    """``toxic``: the documents' labels."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    constant = Machine(np.zeros(ALPHABET**3), 0.0, 0.0, float(np.log(share + 1e-9) - np.log(1 - share + 1e-9)))
    if not toxic.any() or toxic.all():
        return constant

    # Each document's distinct words, as numbers.
    number: dict[str, int] = {}
    known: dict[str, int] = {}

    def of(raw: str) -> int:
        if (n := known.get(raw)) is None:
            word = re.sub(r"[\W_]+", "", raw.lower())
            n = known[raw] = number.setdefault(word, len(number)) if len(word) > 2 else -1
        return n

    bags = [np.array(sorted({of(w) for w in set(text.split())} - {-1}), np.int32) for text in texts]
    del known
    if not number:
        return constant
    vocabulary = list(number)
    often = Counter("".join(vocabulary))
    alphabet = "".join(sorted(sorted(often, key=lambda c: (-often[c], c))[: ALPHABET - 1]))
    table = letter_table(alphabet)
    word, doc = np.concatenate(bags), np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b in bags])
    del bags, number

    # Every CALIBRATE-th document only calibrates, if that leaves both kinds on both sides.
    learn = np.arange(len(texts)) % CALIBRATE != CALIBRATE - 1
    if not all(toxic[x].any() and not toxic[x].all() for x in (learn, ~learn)):
        learn[:] = True
    used = learn[doc]
    pos = np.bincount(word[used & toxic[doc]], minlength=len(vocabulary))
    neg = np.bincount(word[used & ~toxic[doc]], minlength=len(vocabulary))
    # Log-odds of the toxic label, less what chance allows for a word seen this often.
    value = np.log((pos + 0.1) / (toxic[learn].sum() + 1)) - np.log((neg + 0.1) / ((~toxic[learn]).sum() + 1)) - 2 / np.sqrt(np.maximum(pos + neg, 1))
    # Clean documents hold no toxic word, but for a few wrong labels.
    may_be = (pos > 0) & (neg <= WRONG * pos)
    bag = used & toxic[doc] & may_be[word]
    least = explaining(word[bag], doc[bag], pos)
    seeds = np.flatnonzero(may_be & (pos >= max(SEEN, least)))
    if not bag.any() or not len(seeds):
        return constant
    machine, words_pa, rest = constant, pa.array(vocabulary, pa.string()), np.zeros(0, np.int64)
    in_clean = neg > WRONG * pos
    for _ in range(rounds):
        # The witness of each toxic document, if it looks as toxic as most of the witnesses that are seen often.
        order = np.lexsort((-value[word[bag]], doc[bag]))
        first = np.r_[True, np.diff(doc[bag][order]) != 0]
        witness = word[bag][order][first].astype(np.int64)
        witness = witness[value[witness] >= np.quantile(value[seeds], 0.1)]
        rows, count = np.unique(np.r_[witness, np.repeat(seeds, np.minimum(pos[seeds], 5))], return_counts=True)
        hard = np.flatnonzero(in_clean)
        hard = hard[np.argsort(-value[hard], kind="stable")][:HARD]
        rest = np.setdiff1d(np.union1d(rest, hard), rows)
        chosen = np.r_[rows[np.argsort(-count, kind="stable")][: landmarks // 2], rest[np.argsort(-value[rest], kind="stable")][: landmarks // 2]]
        plain = rows[pos[rows] >= DISGUISED * pos[rows].max()]
        gapped = [g for i in plain for g in inserted(vocabulary[i])]
        subs, z = dense([vocabulary[i] for i in chosen], table)
        kernel = against([*(vocabulary[i] for i in np.r_[rows, rest]), *gapped], subs, z, table)
        # Nystroem: features k(x, z) K^(-1/2), small eigenvalues left out.
        values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
        some = values > 1e-6 * values.max()
        root = vectors[:, some] / np.sqrt(values[some])
        y = np.r_[np.ones(len(rows)), -np.ones(len(rest)), np.ones(len(gapped))]
        cost = np.r_[10.0 * np.minimum(count, 5), 10.0 * np.clip(neg[rest], 1, OFTEN), np.full(len(gapped), GAPPED)]
        w, bias = solve(kernel @ root, y, cost)
        weight = np.zeros(ALPHABET**3)
        weight[subs] = z.T @ (root @ w)
        machine = Machine(weight, bias, 1.0, 0.0, alphabet)
        value = machine.decide(words_pa)
    held = ~learn if (~learn).any() else learn
    f = np.full(len(texts), machine.bias)
    np.maximum.at(f, doc, value[word])
    machine.slope, _ = logistic(f[held], toxic[held])
    machine.offset = float(np.log(REJECT / (1 - REJECT)) - machine.slope * parting(f[held], toxic[held]))
    names = [vocabulary[i] for i in seeds]
    machine.heads, machine.tails = parts(names)
    machine.known = tuple(sorted(w for w in names if len(w) > 3))
    machine.innocent = beside([t for t, y in zip(texts, toxic.tolist(), strict=True) if not y], machine)
    return machine


def fold(doc_id) -> F.Column:
    """The remainder that sets rows apart: 1 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Machine:
    """Learns, in one task, from at most ``sample`` labelled rows that are not held out (those
    whose doc_id hashes lowest, so the same rows each time), and no more than ``most_bytes`` of text; a text
    that no longer fits is left out, shorter ones after it are not."""
    chosen = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("toxic in (0, 1) and doc_id is not null").filter(fold(F.col("doc_id")) != 1)
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample)
    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))

    def run(batches):
        texts, toxic, size = [], [], 0
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                text = text or ""
                n = len(text.encode())
                if size + n <= most_bytes:
                    size += n
                    texts.append(text)
                    toxic.append(y == 1)
        learned = pickle.dumps(train(texts, np.array(toxic, bool)))
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([learned], pa.binary())], names=["machine"])

    learned = got.repartition(1).sortWithinPartitions("place", "doc_id").select("text", "toxic").mapInArrow(run, "machine binary")
    row = learned.first()  # none if Spark knows that there are no rows
    return pickle.loads(bytes(row["machine"])) if row else train([], np.zeros(0, bool))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and verdict of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in sliced(batches):
            score = shared.value.score(batch.column("text"))
            held = [zlib.crc32(str(i).encode() if i is not None else b"") % 3 == 1 for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held), pa.array(score), pa.array((score >= REJECT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in sliced(batches):
            yield batch.filter(pa.array(shared.value.score(batch.column("text").cast(pa.string())) < REJECT))

    return docs.mapInArrow(run, docs.schema)


def op9_string_kernel_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
