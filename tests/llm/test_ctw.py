import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbank.llm import ctw

TEXTS = ["the cat sat on the mat", "The cat ate the rat", "", "abc abd abe", "the cat sat on the mat", "zzz é é ü", "the mat sat on the cat"]
TRAIN = [True, True, True, True, True, False, False]


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


def brute(texts, train):
    """log10 probabilities by the recursion itself, over a dictionary of nodes."""
    counts = defaultdict(lambda: [0, 0])

    def steps(text):
        raw = b"\xff" * ctw.DEPTH + (text or "").encode().lower() + b"\xff"
        for i in range(ctw.DEPTH, len(raw)):
            for j in range(8):
                yield [(raw[i - d : i], raw[i] >> (8 - j) | 1 << j) for d in range(ctw.DEPTH + 1)], raw[i] >> (7 - j) & 1

    children = defaultdict(set)
    for t, f in zip(texts, train):
        if f:
            for path, bit in steps(t):
                for d, node in enumerate(path):
                    counts[node][bit] += 1
                    if d:
                        children[path[d - 1]].add(node)
    weighted, weight = {}, {}

    def visit(node):
        if node not in weighted:
            own = kt(*counts[node])
            below = [visit(c) for c in children.get(node, ())]
            weighted[node] = np.logaddexp(own, sum(below)) + math.log(0.5) if below else own
            weight[node] = math.exp(own + math.log(0.5) - weighted[node]) if below else 1.0
        return weighted[node]

    for node in list(counts):
        visit(node)

    def predict(path, bit):
        p, seen = 0.5, False
        for node in reversed(path):
            if node in counts:
                a = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
                p, seen = (weight[node] * a + (1 - weight[node]) * p if seen else a), True
        return p

    return [sum(math.log10(predict(path, bit)) for path, bit in steps(t)) for t in texts]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, keep boolean, n_tokens string")


@pytest.mark.parametrize("fan", [2, 256])
def test_scores_equal_the_recursion(spark, fan):
    rows = [(i, t, f, "x") for i, (t, f) in enumerate(zip(TEXTS, TRAIN))]
    got = {r.doc_id: r for r in ctw.score(frame(spark, rows).repartition(5), F.col("keep"), shard_bytes=30, fan=fan).collect()}
    for i, want in enumerate(brute(TEXTS, TRAIN)):
        assert got[i].score == pytest.approx(want, abs=1e-7)
        n_bytes = len(TEXTS[i].encode())
        assert got[i].n_bytes == n_bytes and got[i].bits_per_byte == pytest.approx(-want / math.log10(2) / (n_bytes + 1), abs=1e-6)
    words = [t.lower().split() + [None] for t in TEXTS]
    counts = defaultdict(int)
    for w, f in zip(words, TRAIN):
        for x in w:
            counts[x] += f
    n, v = sum(counts.values()), sum(c > 0 for c in counts.values())
    for i, w in enumerate(words):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), abs=1e-9)


def test_contexts_longer_than_a_short_word_count(spark):
    texts = ["Qabcde1", "Zabcde2"] * 20 + ["Qabcde1", "Qabcde2"]  # only the sixth byte back tells what follows
    got = {r.doc_id: r.score for r in ctw.score(frame(spark, [(i, t, i < 40, None) for i, t in enumerate(texts)]), F.col("keep")).collect()}
    assert got[40] > got[41] + 1


def test_odd_rows(spark):
    rows = [(None, "a", None, None), (1, None, True, "q"), (1, None, True, "q"), (2, "x" * 50_000, False, None)]
    got = ctw.score(frame(spark, rows), F.col("keep")).collect()
    assert len(got) == 4 and all(math.isfinite(r.score) and r.train_tokens == 2 for r in got)


def test_nothing_to_learn_from(spark):
    got = ctw.score(frame(spark, [(1, "ab", False, None)]), F.col("keep")).collect()
    assert got[0].score == pytest.approx(24 * math.log10(0.5)) and got[0].train_tokens == 0
    assert ctw.score(frame(spark, []), F.col("keep")).collect() == []


def test_probabilities_of_all_bytes_sum_to_one():
    keys, _ = ctw.byte_pairs([b"the cat sat", b"the hat"])
    keys, n = np.unique(keys, return_counts=True)
    root = ctw.Root(*(x.astype(np.int64) if i == 0 else x for i, x in enumerate(ctw.root_parts(keys, n))))
    context = keys[3] & ~np.uint64(255)
    asked = np.union1d(keys, context | np.arange(256, dtype=np.uint64))
    counts = np.zeros(len(asked), np.int64)
    counts[np.searchsorted(asked, keys)] = n
    p = ctw.log_probabilities(asked, counts, root)[(asked & ~np.uint64(255)) == context]
    assert (10**p).sum() == pytest.approx(1)
