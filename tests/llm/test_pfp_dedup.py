import hashlib
import random

import pytest

from quillbank.llm import pfp_dedup


def brute(rows, length):
    first, out = {}, {}
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    for i in sorted(texts):
        raw = texts[i]
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            if first.setdefault(raw[s : s + length], i) < i:
                gone[s : s + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def rows_of(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    passage = [" ".join(word() for _ in range(r.randrange(8, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(passage) if r.random() < 0.5 else " ".join(word() for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(1, 6))]
        text = " ".join(parts)
        if r.random() < 0.3 and rows:
            text = rows[r.randrange(len(rows))][1] or ""
            at = r.randrange(len(text) + 1)
            text = text[:at] + r.choice(["", "x", "yy zz"]) + text[at + r.randrange(3) :]
        rows.append((i * 3, text))
    return rows + [(500, None), (501, ""), (502, "a" * 400), (503, "a" * 300), (504, "a" * 49), (505, "short")]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_bytes_as_brute_force(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in pfp_dedup.without_repeats(docs, digests=True).collect()}
    assert got == brute(rows, 50)


def test_long_documents_are_parsed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pfp_dedup, "CHUNK", 256)
    rows = rows_of(3)[:20]
    raws = [t.encode() for _, t in rows]
    for pieces in pfp_dedup._pieces(raws, 50):
        for d, lo, part in pieces:
            assert raws[d][lo : lo + len(part)] == part and len(part) >= 50
    windows = sorted((d, s) for pieces in pfp_dedup._pieces(raws, 50) for p in [pfp_dedup.Parse(pieces, 50)] for d, b, n in zip(p.document, p.start, p.count) for s in range(b, b + n))
    assert windows == [(d, s) for d, raw in enumerate(raws) for s in range(len(raw) - 49)]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, phrase int")
    assert pfp_dedup.without_repeats(empty).collect() == []
    rows = [(None, "b" * 60, 1), (None, "b" * 60, 2), (2, "b" * 60, 3)]
    got = pfp_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, phrase int")).collect()
    assert len(got) == 3 and all(r.n_removed == 0 and bytes(r.kept) == b"b" * 60 for r in got)


@pytest.mark.parametrize("hot", [0, 3, 100_000])
def test_hot_triggers_go_window_by_window(spark, hot):
    rows = rows_of(4) + [(600 + i, f"{i * 7919 % 1000} begins here, and this line is in a third of all documents, then ends {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in pfp_dedup.without_repeats(docs, digests=True, hot=hot, shard_bytes=2000).collect()}
    assert got == brute(rows, 50)


def test_repeated_rows_and_ids_and_other_columns(spark):
    passage = "x".join(str(i) for i in range(40))
    rows = [(7, passage, "a", 1), (7, passage, "b", 2), (9, "start " + passage, "c", 3), (9, "other text", "d", 4), (None, passage, "e", 5)]
    got = sorted(pfp_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, shard string, kept int")).collect(), key=lambda r: r.shard)
    assert [(r.doc_id, r.n_removed, r.shard) for r in got] == [(7, 0, "a"), (7, 0, "b"), (9, len(passage), "c"), (9, 0, "d"), (None, 0, "e")]
    assert bytes(got[2].kept) == b"start " and [tuple(s) for s in got[2].spans] == [(6, 6 + len(passage))]


def test_suffixes_in_order_of_their_first_bytes():
    r = random.Random(5)
    for length in (3, 8, 17, 50):
        data = bytes(r.choice(b"ab") for _ in range(400))
        begin = pfp_dedup.np.arange(400 - length + 1)
        order, new = pfp_dedup.suffix_order(pfp_dedup.np.frombuffer(data, pfp_dedup.np.uint8), begin, length)
        ordered = [data[i : i + length] for i in order.tolist()]
        assert ordered == sorted(ordered) and new.tolist() == [i == 0 or a != ordered[i - 1] for i, a in enumerate(ordered)]
