import random

import numpy as np
import pytest

from quillbank.llm import decontam as D


def brute(docs, items, window=8):
    out = {}
    for i, text in docs:
        w = D.words_of(text)
        hit, found = [False] * len(w), set()
        for item, t in items:
            q = D.words_of(t)
            for s in range(max(len(q) - window, 0) + 1 if q else 0):
                p = q[s : s + window]
                for a in range(len(w) - len(p) + 1):
                    if w[a : a + len(p)] == p:
                        hit[a : a + len(p)] = [True] * len(p)
                        found.add(str(item))
        out[i] = (len(w), sum(hit), sorted(found))
    return out


def case(seed):
    r = random.Random(seed)
    word = lambda: r.choice("the of a cat Dog é x1 run und".split())
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 8, 12, 20])))) for i in range(12)] + [(50, None), (51, "!!"), (52, "")]
    docs = []
    for i in range(60):
        parts = [r.choice(items)[1] or "" if r.random() < 0.5 else " ".join(word() for _ in range(r.randrange(12))) for _ in range(4)]
        docs.append((i, r.choice([". ", " ", "\n"]).join(parts)))
    return docs + [(70, None), (71, ""), (72, "...")], items


@pytest.mark.parametrize("seed,blocks", [(1, 10**7), (2, 10**7), (3, 300)])
def test_hits_of_brute_force(spark, seed, blocks):
    docs, items = case(seed)
    found = D.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_bytes=blocks)
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found.collect()} == brute(docs, items)


def test_index_finds_all_places():
    r = np.random.default_rng(0)
    codes = r.integers(1, 4, 300)
    starts = np.array([0, 5, 130, 131])
    index = D.FMIndex(codes, starts, 3)
    assert sorted(index.locate(np.flatnonzero(index.sample >= -1)[len(starts) :]).tolist()) == list(range(300))


def test_cleaning_and_odd_tables(spark):
    passage = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"Before. {passage.upper()}! After", 7), (2, "clean text", 8), (None, None, 9), (3, passage + " x " + "ten eleven", 1)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(1, passage, "e"), (2, "ten eleven", "e")], "item_id long, text string, doc_id string")
    for blocks in (10**7, 64):
        got = {r.doc_id: (r.text, r.n_hit) for r in D.decontaminate(docs.where("doc_id IS NOT NULL"), bench, block_bytes=blocks).collect()}
        assert got == {1: ("Before. ! After", 7), 2: ("clean text", 8)}
    assert D.decontaminate(docs, bench.limit(0)).count() == 4 and D.decontaminate(docs.limit(0), bench).count() == 0
    assert D.without_spans("a, bé-c d", [(1, 3)]) == "a,  d"


def test_an_item_in_several_rows_counts_once(spark):
    passage, other = "one two three four five six seven eight nine", "red green blue black white grey brown pink"
    docs = spark.createDataFrame([(1, f"{passage} and {other}")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage), (7, passage), (7, other)], "item_id long, text string")
    for blocks in (10**7, 64):
        found = D.scan(docs, bench, block_bytes=blocks).first()
        assert (found["items"], found["n_hit"]) == (["7"], 17)
        assert [r.text for r in D.decontaminate(docs, bench, block_bytes=blocks).collect()] == [" and "]


def test_every_row_stays_whatever_the_blocks(spark):
    a, b = "one two three four five six seven eight nine", "red green blue black white grey brown pink"
    rows = [(None, "clean"), (None, f"x {a}"), (None, None), (1, f"{a} y"), (1, f"{a} y"), (1, f"{b} z"), (2, f"{a} {b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, a), (8, b)], "item_id long, text string")
    for blocks in (10**7, 64):
        found = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in D.scan(docs, bench, block_bytes=blocks).collect()), key=str)
        assert found == sorted([(None, 1, 0, []), (None, 10, 9, ["7"]), (None, 0, 0, []), (1, 10, 9, ["7"]), (1, 10, 9, ["7"]), (1, 9, 8, ["8"]), (2, 17, 17, ["7", "8"])], key=str)
        kept = sorted((tuple(r) for r in D.decontaminate(docs, bench, block_bytes=blocks).collect()), key=str)
        assert kept == sorted([(None, "clean"), (None, "x "), (None, None), (1, " y"), (1, " y"), (1, " z")], key=str)


@pytest.mark.parametrize("round_blocks", [1, 2, 16])
def test_one_result_at_every_number_of_blocks(spark, round_blocks):
    docs, items = case(7)
    docs, items = docs + docs[:5] + [(None, docs[0][1]), (docs[1][0], docs[2][1])], items + items[:3] + [(items[0][0], items[5][1])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    size = sum(len((t or "").encode()) + 64 for _, t in items)
    results = []
    for blocks in (1, 2, 5):
        assert D._blocks(bench, 8, -(-size // blocks))[0] == blocks
        found = D.scan(frame, bench, block_bytes=-(-size // blocks), round_blocks=round_blocks).collect()
        clean = D.decontaminate(frame, bench, block_bytes=-(-size // blocks), round_blocks=round_blocks).collect()
        results.append((sorted(map(str, found)), sorted(map(str, clean))))
        assert len(found) == len(docs)
    assert results[0] == results[1] == results[2]
