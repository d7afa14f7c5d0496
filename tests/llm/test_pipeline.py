import hashlib

import corpus_pipeline
from quillbank.llm import queries


def test_stages_in_order_and_their_effect(spark, tmp_path):
    word = lambda i, j: f"w{(i * 7919 + j * 104729) % 99991}"
    body = lambda i: " ".join(word(i, j) for j in range(80))
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(i, f"SAME line here\n{body(i)}", "en", "s") for i in range(20)]
    rows += [(100, body(3) + " tail", "en", "s"), (101, "too short", "en", "s"), (102, f"{body(50)} {passage} end", "en", "s"), (103, None, None, None), (104, f"{body(51)} {passage} mid one two three four five six seven eight nine", "en", "s")]
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "one two three four five six seven eight nine")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert k + 1 == len(corpus_pipeline.STAGES) or docs.columns == before
        seen.append({r.doc_id: r for r in docs.collect()})
    quality, lines, near, clean, coded = seen
    assert set(quality) == {*range(20), 100, 102, 104}
    assert lines[0].text == body(0) and lines[0].n_chars == len(body(0))
    assert set(near) == {*range(20), 102, 104}
    assert set(clean) == {*range(20), 102} and clean[102].text == f"{body(50)}  end"
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(whole) == set(coded) and whole[5].decoded_sha256 == hashlib.sha256(body(5).encode()).hexdigest()


def test_ten_operators_are_registered():
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_on_repeated_rows_ids_and_other_columns(spark, tmp_path):
    body = lambda i: " ".join(f"w{(i * 7919 + j * 104729) % 99991}" for j in range(80))
    rows = [(1, body(1)), (1, body(1)), (1, body(2)), (1, "too short"), (2, body(2)), (None, body(3)), (None, "short"), (None, None), (4, f"frequent\n{body(4)}"), (4, f"frequent\n{body(4)}")]
    rows += [(i, f"frequent\n{body(i)}") for i in range(20, 29)]
    rows = [(i, t, "en", None, 0, f"x{k}", k) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, keys long")
    spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, body(1)), (5, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, str(tmp_path))
    assert sorted(r["keys"] for r in good.collect()) == [0, 1, 2, 4, 5, *range(8, 19)] and good.columns == docs.columns
    lines = stages["line dedup"](spark, good, str(tmp_path))
    text = {r["keys"]: r.text for r in lines.collect()}
    assert len(text) == 16 and text[8] == text[9] == body(4) and text[10] == body(20) and text[2] == body(2)
    near = stages["MinHash near-dedup"](spark, lines, str(tmp_path))
    assert sorted(r["keys"] for r in near.collect()) == [0, 1, 2, 5, *range(8, 19)]  # (2, body 2) goes for (1, body 2); a row that repeats id and text stays with it
    clean = stages["benchmark decontamination"](spark, near, str(tmp_path))
    assert clean.count() == 15 and clean.columns == docs.columns
    coded = stages["byte-level BPE"](spark, clean, str(tmp_path))
    assert coded.count() == 15 and {"n_words", "keys"} < set(coded.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_the_whole_run_equals_plain_versions_of_its_stages(spark):
    """SQL for the first two stages, brute force over all pairs and windows for the next two, the tokenizer's own library for the last."""
    import os

    import duckdb
    import numpy as np
    import pytest

    from quillbank.llm import bpe, decontam, line_dedup, quality
    from tests.llm import cases, test_decontam

    data = "/root/testdata/sf0.001"
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for name in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    con.sql(f"CREATE TABLE good AS WITH {quality.verdict_sql()} SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM q_verdict WHERE kept)")
    lines = con.sql(f"WITH {line_dedup.kept_sql('good')} SELECT doc_id, text FROM l_kept ORDER BY doc_id").fetchall()
    groups = cases.near_duplicates(lines, 5, 80)
    single = [(i, t) for i, t in lines if groups[i][1] == i]
    items = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    windows = decontam.Windows([(str(i), t) for i, t in items])
    hits = test_decontam.brute([x for x in single[:60]], items)
    spans, found = decontam.search_shard([decontam.words_of(t) for _, t in single], windows)
    assert all((len(decontam.words_of(t)), sum(e - b for b, e in s), f) == hits[i] for (i, t), s, f in list(zip(single, spans, found))[:60])
    clean = [(i, decontam.without_spans(t, s) if s else t) for (i, t), s, f in zip(single, spans, found) if len(f) < 2]
    model = bpe.ByteBPE.load(*bpe.vocabulary_file())
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    want = {i: hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest() for i, t in clean}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, data).collect()}
    assert got == want and 0 < len(want) < con.sql("SELECT count(*) FROM documents").fetchall()[0][0]
