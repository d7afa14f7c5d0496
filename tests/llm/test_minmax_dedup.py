import random

import pytest

from quillbank.llm import minmax_dedup as M
from tests.llm.cases import near_duplicates


def corpus(seed, groups=6, members=25):
    """Groups of copies with few and many changes, so that links chain, and texts of their own."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(30, 120))]
        for _ in range(members):
            text = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 8))):
                text[r.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rows += [" ".join(word() for _ in range(40)) for _ in range(20)]
    r.shuffle(rows)
    odd = [(None, None), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, rows[0].upper()), (907, rows[0])]
    return list(enumerate(rows)), odd[1:]


@pytest.mark.parametrize("seed,width", [(1, 2), (2, 2), (3, 5)])
def test_components_of_brute_force(spark, seed, width):
    plain, odd = corpus(seed)
    docs = spark.createDataFrame(plain + odd, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(docs, width).collect()}
    assert got == near_duplicates(plain + odd, width, 80)


def test_one_of_each_and_odd_rows(spark):
    rows = [(5, "a b c d e f", "x", 1), (3, "A b  c d e f", "y", 2), (9, "q w e r t y", None, 3), (None, "a b c d e f", "z", 4), (7, None, "u", 5), (7, None, "u", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, label int")
    kept = M.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "7", "9", "None"]
    empty = docs.limit(0)
    assert M.near_duplicates(empty).collect() == [] and M.one_of_each(empty).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r.node: r.root for r in M.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_one_id_on_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (9, b, 3), (5, b, 4), (None, a, 5), (7, None, 6), (7, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(docs).collect())
    assert got == [(-1, 26, 1, None), (1, 26, 1, True), (5, 26, 1, False), (5, 26, 5, True), (5, 26, 5, True), (7, 0, 7, True), (7, 0, 7, True), (9, 26, 5, False)]
    assert sorted(r.node for r in M.one_of_each(docs).collect()) == [0, 2, 4, 5, 6, 7]
