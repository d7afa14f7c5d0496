import hashlib
import random

import numpy as np
import pytest

from quillbank.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    return bpe.ByteBPE.load(*bpe.vocabulary_file())


@pytest.fixture(scope="module")
def library(model):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def texts():
    r = random.Random(1)
    out = ["", "a" * 1000, "ab" * 700, "\x1c\x1d a\x85b᠎ c​ d   x", "'s 'S x's'll", " " * 999 + "x", "\n\n \t x", "é" * 400, "日本語" * 200, "<|endoftext|> x", "it's 123456 ½ ٣٤"]
    out += ["".join(r.choice(a) for _ in range(n)) for a, n in (("abcdeé ", 5000), ("abcdest", 3000), ("etaoin shrdlu\n", 4000))]
    out += ["😀 astral 𝔘𝔫𝔦 \U0010ffff x\U00020000y", "👩‍👩‍👧‍👦" * 60]
    return out + ["".join(chr(r.randrange(1, 0x3000)) for _ in range(5000))]


def test_same_ids_as_the_library(model, library):
    for text, ids in zip(texts(), model.encode_batch(texts())):
        assert ids == np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert model.decode(ids) == text.encode()


def test_long_pieces_merge_as_in_the_matrix(model):
    r = random.Random(2)
    for _ in range(20):
        piece = "".join(r.choice("abcdethinos") for _ in range(r.randrange(2, 200))).encode()
        ids, n = model._merge_matrix(model.byte_rank[np.frombuffer(piece, np.uint8)][None], np.array([len(piece)]))
        assert ids[0, : n[0]].tolist() == model._merge_long(piece).tolist()


def test_frames(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, None, 2), (3, "x", 2), (3, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for r in bpe.digests(docs).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        if r.doc_id != 3:
            assert r.ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(rows[r.doc_id][1]), "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id][1].encode()).hexdigest()
    assert bpe.digests(docs).count() == len(rows) and bpe.digests(docs.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs.where("doc_id IS NOT NULL"))).collect()}
    assert all(back[i] == t for i, t in enumerate(texts()) if i != 3)
