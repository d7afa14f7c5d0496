"""Quality rules and line dedup: brute force, certified cutoffs, odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillbank.llm import line_dedup, quality

TEXTS = [None, "", " \n\t", "a b c a b c", "a a a a a a", "x\nx\n\nx \ny", "### $5 ABC!!", "one", "é ü ö", "w " * 3000, "p q r s p q r t\np q r s"]


def counts(text):
    t = text or ""
    w = [x for x in t.translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ") if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, seen = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            seen |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if x.strip(" \t\x0b\f\r")]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(seen)


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, stratum string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    for i, t in enumerate(TEXTS):
        r, want = got[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality.quality_rules(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("k,n,p", [(0, 100, 0.02), (3, 1000, 0.01), (150, 20000, 0.01), (5, 10, 0.1), (0, 0, 0.1), (9000, 10**6, 0.01)])
def test_binomial_tail(spark, k, n, p):
    got = spark.range(1).select(F.lit(k).cast("long").alias("k"), F.lit(n).cast("long").alias("n")).select(quality.binomial_tail("k", "n", p)).first()[0]
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)
    want = math.fsum(math.exp(log(i)) for i in range(k + 1)) if n and k < p * n else 1.0
    assert got == pytest.approx(want, rel=1e-6)


def test_rules_are_certified_by_stratum(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, labels = [], []
    for i in range(6000):
        bad = i % 4 == 0
        rows.append((i, " ".join(word() + ("%%%" if bad else "") for _ in range(55)), "en" if i % 100 else "xx"))
        labels.append((i, int(not bad)))
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {(x["lang_"], x["bad"]): x["n"] for x in out.select(F.col("stratum").alias("lang_"), (F.col("doc_id") % 4 == 0).alias("bad"), "kept").where("kept").groupBy("lang_", "bad").agg(F.count("*").alias("n")).collect()}
    assert ("en", True) not in kept and kept["en", False] == 4500 and kept["xx", True] == 60  # too few of xx to certify a rule


def test_lines(spark):
    r = random.Random(2)
    common = ["Subscribe now", " subscribe NOW\t", "x", "", "é"]
    rows = [(i, "\n".join(r.choice(common) if r.random() < 0.5 else f"line {r.randrange(400)}" for _ in range(r.randrange(1, 9)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "only\nonly\nonly"), (103, "Subscribe now"), (104, "\n".join(["x"] * 3000))]
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\f\r"))
    docs_of = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs_of[key(line)].add(i)
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, n_lines string, bin int")
    got = {x.doc_id: x for x in line_dedup.line_dedup(docs).collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(docs_of[key(x)]) >= 10)]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.line_dedup(docs.limit(0)).collect() == []
    alone = line_dedup.line_dedup(spark.createDataFrame([(None, "a\nb"), (None, "a\nb")], "doc_id long, text string"), min_docs=2).collect()
    assert [x.text for x in alone] == ["a\nb", "a\nb"]
    assert hashlib.sha256(b"").hexdigest()


def test_lines_of_repeated_rows_and_rows_without_an_id(spark):
    rows = [(1, "often\na"), (1, "often\na"), (1, "c\noften\nd"), (2, "b\noften"), (None, "often\nz"), (None, "often\nz"), (None, None), (3, "twice\ntwice"), (3, "twice\ntwice")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2).collect()
    want = [(1, "a", 2, 1), (1, "a", 2, 1), (1, "c\nd", 3, 1), (2, "b", 2, 1), (None, "z", 2, 1), (None, "z", 2, 1), (None, "", 1, 0), (3, "twice\ntwice", 2, 0), (3, "twice\ntwice", 2, 0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_strata_beyond_the_broadcast_give_the_same(spark, monkeypatch):

    rows = [(i, ("w%d " % (i % 7)) * (60 if i % 3 else 5) + "#" * (i % 5), f"l{i % 3}", None) for i in range(90)] + [(None, "x", None, 1), (3, None, "l1", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long")
    labels = spark.createDataFrame([(i, 1) for i in range(90)], "doc_id long, quality int")
    one = sorted(map(str, quality.quality_rules(docs, labels).collect()))
    kept = sorted(map(str, quality.keep_good(docs, labels).collect()))
    monkeypatch.setattr(quality, "STRATA_BYTES", -1)
    assert sorted(map(str, quality.quality_rules(docs, labels).collect())) == one and sorted(map(str, quality.keep_good(docs, labels).collect())) == kept
    assert quality.keep_good(docs, labels).columns == docs.columns and len(one) == 92


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_false_rejection_stays_below_alpha(spark, seed):
    """Cutoffs chosen on labelled good rows, held against fresh rows of the same kind: what all rules reject together."""


    r = random.Random(seed)

    def row(i):
        chars = 1000
        part = lambda scale: min(chars, int(chars * r.expovariate(1 / scale)))
        return (i, f"s{i % 2}", 200, chars, part(0.02), r.randrange(3), r.randrange(40), 40, part(0.05), part(0.03), part(0.01))

    names = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_word_lines long, n_capitals long, n_digits long, n_bangs long"
    known, fresh = [row(i) for i in range(6000)], [row(i) for i in range(4000)]
    labels = spark.createDataFrame([(i, 1) for i in range(6000)], "doc_id long, quality int")
    cuts = {(c.stratum, c.rule): c.cutoff for c in quality.cutoffs(spark.createDataFrame(known, names), labels).collect()}
    assert len(cuts) >= 8  # most rules are on in both strata
    column = {n.split()[0]: k for k, n in enumerate(names.split(", "))}
    for stratum in ("s0", "s1"):
        own = [x for x in fresh if x[1] == stratum]
        ratio = lambda x, rule: min(quality.GRID, -(-quality.GRID * x[column[quality.RULES[rule][0]]] // x[column[quality.RULES[rule][1]]]))
        rejected = sum(any(ratio(x, rule) > cuts.get((stratum, rule), quality.GRID) for rule in quality.RULES) for x in own)
        assert rejected <= 0.05 * len(own)


def test_lines_beyond_the_broadcast_give_the_same(spark, monkeypatch):
    rows = [(i % 25, f"common\nown {i}\nhalf {i % 2}\n\ncommon", i) for i in range(40)] + [(None, "common\nx", 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a long")
    one = sorted(map(str, line_dedup.line_dedup(docs).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert sorted(map(str, line_dedup.line_dedup(docs).collect())) == one and any("own 7\\n" in x for x in one) and not any("common" in x for x in one)
