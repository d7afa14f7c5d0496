"""Language identification and toxicity: held-out accuracy on made-up languages, automata against edit distance."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillbank.llm import langid, toxicity
from quillbank.llm.shared import fold_remainder

SYLLABLES = {"aa": ["ka", "mo", "ti", "ru", "sel"], "bb": ["sch", "ung", "ein", "über", "ach"], "cc": ["eau", "ois", "qué", "lle", "mont"]}


def sentence(r, lang, n=40):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    r = random.Random(1)
    rows = [(i, sentence(r, lang := r.choice(list(SYLLABLES)), r.randrange(3, 60)), lang, "x") for i in range(300)]
    odd = [(1000, None, None, "x"), (1001, "", "aa", "x"), (1002, "123 !!", "aa", "x"), (None, rows[0][1], None, "x"), (1003, rows[0][1], None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = {x.doc_id: x for x in langid.identify(docs, fold_remainder(F.col("doc_id"), 4) != 2).collect()}
    held = [x[0] for x in spark.createDataFrame([(i,) for i in range(300)], "doc_id long").where(fold_remainder(F.col("doc_id"), 4) == 2).collect()]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and all(0 <= x.score <= 1 for x in got.values())
    assert got[1003].lang_pred == rows[0][2]
    none = langid.identify(docs, F.lit(False)).collect()
    assert {x.lang_pred for x in none} == {"und"} and langid.identify(docs.limit(0), F.lit(True)).collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    entries = [("abba", False, 1), ("babab", False, 2), ("aab", True, 0), ("bbba", True, 1)]
    lexicon = toxicity.FuzzyLexicon(entries)
    for n in range(7):
        for word in map("".join, itertools.product("ab", repeat=n)):
            told = [min(distance(text, word[:k]) for k in range(len(word) + 1)) if stem else distance(text, word) for text, stem, _ in entries]
            want = min((d for d, (_, _, limit) in zip(told, entries) if d <= limit), default=None)
            assert lexicon.match(word) == want
            assert lexicon.distances(word) == {(lexicon.node_of[text, stem], stem): d for d, (text, stem, limit) in zip(told, entries) if d <= limit}


def test_quotation_is_no_abuse():
    m = toxicity.Matcher([("idiot", False, 1)])
    plain, quoted, said = (m.features(t) for t in ("you are an idiot ok", 'the "idiot" remark', "the word idiot is rude"))
    assert plain[0] == 1 and plain[4] > 0 and plain[3] == 0
    assert quoted[0] == said[0] == 0 and quoted[3] > 0 and said[3] > 0 and m.features(None)[0] == 0
    assert m.features("what an idiott")[0] == pytest.approx(toxicity.NEAR)


def test_toxicity(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        text, toxic = sentence(r, "aa").split(), i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(r.randrange(len(text)), "zorn" + r.choice(["ix", "elk", "ub", "at"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic), 1))
    rows += [(1000, None), (1001, ""), (1002, "calm text with the word zornab here"), (1003, "you moroon what a idiott and loooser"), (None, "ka mo")]
    labels += [(1000, None, 1), (None, 1, 1)]
    got = {x.doc_id: x.score for x in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), fold_remainder(F.col("doc_id"), 4) != 2).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(400)) and got[1000] < 0.3 and got[1003] >= 0.3
    none = toxicity.score(spark.createDataFrame(rows[:3], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True)).collect()
    assert len(none) == 3 and all(x.score < 0.3 for x in none)


def test_entries_and_words_of_any_length():
    text = "schimpfwort" * 7  # 77 characters
    lexicon = toxicity.FuzzyLexicon([(text, False, 2), ("kotzen", True, 1)])
    assert [lexicon.match(w) for w in (text, text[:-1], text + "xy", text[:-3], "x" * 100_000, "kozen" + "y" * 100_000)] == [0, 1, 2, None, None, 1]


def test_odd_tables_of_toxicity(spark):
    known = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), known, F.lit(True)).collect() == []
    rows = [(1, "calm words", "x"), (1, "calm words", "x"), (2, "you idiot " * 20_000, "y")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), known, F.lit(True)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2] and len({r.score for r in got}) == 2


def test_scores_by_edit_distance(spark):
    """The features behind a score, from a plain edit distance to every entry instead of the automaton."""
    r = random.Random(11)
    entries = [("zornig", False, 1), ("zornelk", False, 1), ("blödmann", False, 2), ("kotz", True, 0), ("trottel", True, 1)]
    m, near = toxicity.Matcher(entries), "bcdfgmnprstz"

    def found(word):
        told = [min(distance(text, word[:k]) for k in range(len(word) + 1)) if stem else distance(text, word) for text, stem, _ in entries]
        return min((d for d, (_, _, limit) in zip(told, entries) if d <= limit), default=None)

    for _ in range(150):
        words = sentence(r, "aa", 12).split() + [r.choice(entries)[0] + r.choice(["", "en", "x"]) for _ in range(3)] + [t.replace(t[2], r.choice(near), 1) for t, _, _ in entries]
        r.shuffle(words)
        told = [found(w) for w in words]
        address = [any(x in toxicity.ADDRESS for x in words[max(0, i - 4) : i] + words[i + 1 : i + 5]) for i in range(len(words))]
        exact, close = sum(d == 0 for d in told), sum(d is not None and d > 0 for d in told)
        plain = exact + toxicity.NEAR * close
        want = [min(1.0, plain), toxicity.np.log1p(plain), 100 * plain / max(len(words), 20), 0.0, toxicity.np.log1p(sum(a for a, d in zip(address, told) if d is not None))]
        assert m.features(" ".join(words)) == pytest.approx(want)


def test_languages_by_compression_in_plain_python(spark):
    import zstandard

    r = random.Random(5)
    rows = [(i, sentence(r, lang := r.choice(list(SYLLABLES)), r.randrange(1, 400)), lang) for i in range(120)]
    rows += [(200, rows[0][1], rows[0][2]), (200, rows[0][1], rows[0][2]), (201, sentence(r, "bb", 60_000), None), (202, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    raw = langid.dictionaries(docs, F.col("doc_id") < 100, sample=20, piece=80)
    pieces = {lang: {langid.normal(t[k : k + 80]) for i, t, x in rows if i < 100 and x == lang for k in range(0, len(t), 80)} for lang in SYLLABLES}
    assert set(raw) == set(SYLLABLES)
    for lang, (content, n) in raw.items():
        held = content.split(b"\n")
        assert n == sum(x == lang for i, _, x in rows if i < 100) and len(held) == 20 and set(held) <= pieces[lang]

    def size(lang, text):
        held = zstandard.ZstdCompressionDict(raw[lang][0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress(langid.normal(text))
        total = sum(n for _, n in raw.values())
        return len(made) + toxicity.np.log2(total / raw[lang][1]) / 8

    got = {x.doc_id: x for x in langid.identify(docs, F.col("doc_id") < 100, sample=20, piece=80).collect()}
    for i, t, _ in rows:
        sizes = {lang: size(lang, t) for lang in sorted(raw)}
        assert got[i].lang_pred == min(sizes, key=sizes.get), i
    assert got[201].lang_pred == "bb"


def test_many_languages_share_the_budget(spark, monkeypatch):
    monkeypatch.setattr(langid, "BUDGET", 40 * 30 * 3)
    rows = [(i, "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(400)), f"l{i % 30}") for i in range(300)]
    raw = langid.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), piece=40)
    assert len(raw) == 30 and all(1 <= len(c.split(b"\n")) <= 3 for c, _ in raw.values())


def test_ties_go_to_more_rows_then_to_the_first_name():
    model = langid.Classifier({"aa": (b"ka mo ti", 5), "bb": (b"ka mo ti", 9)})
    assert model.predict("ka mo")[0] == "bb"
    assert langid.Classifier({"aa": (b"ka mo ti", 5), "bb": (b"ka mo ti", 5)}).predict("ka mo")[0] == "aa"
    assert langid.Classifier({}).predict("ka mo") == ("und", 0.0, True)
