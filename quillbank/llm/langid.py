"""Language identification by compression.

Each language has a raw-content dictionary cut from a bounded sample of labelled training texts. A text is compressed
whole with every dictionary; the language of the smallest code (the result, and the bytes that name the language among
the training rows) is predicted, and rejected where the next smallest is nearly as small.

The sample: of each language's distinct training texts the SAMPLE of least hash, or fewer where there are so many languages
that BUDGET characters in all would not do (one at least). A text falls into pieces of PIECE characters, and its hash says
which of them is taken, so any part of a text may be. These bounds are parameters; all else reads all rows and whole texts.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbank.llm.shared import fold_remainder, read, ship

SAMPLE, PIECE = 512, 500
#: Characters of all dictionaries together, which go to every executor.
BUDGET = 64_000_000
LEVEL = 3
#: Share of the best size by which the second best must be larger for a prediction not to be rejected.
MARGIN = 0.01
#: Bytes of difference in size that count as a factor e of odds in the score.
SCALE = 3.0
LETTER = regex.compile(r"\p{L}")
NONE = "und"
#: ASCII bytes that are no letters become blanks, so that only words are compressed.
LETTERS = bytes(b if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(LETTERS).split())


def dictionaries(docs: DataFrame, train: Column, sample: int = SAMPLE, piece: int = PIECE) -> dict[str, tuple[bytes, int]]:
    """A dictionary and the number of training rows for each language (``lang`` not null) of the training rows."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    size = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"), F.count("*").alias("rows")).collect()
    if not size:
        return {}
    rows_of = {r["lang"]: r["rows"] for r in size}
    each = max(1, min(sample, BUDGET // (piece * len(size))))
    # About three times the sample falls below the bound; copies count once, so a text with many rows is one row here.
    share = F.create_map(*[F.lit(x) for r in size for x in (r["lang"], 3.0 * each / r["n"])])[F.col("lang")]
    low = rows.select("lang", "text", F.xxhash64("text").alias("h"), share.alias("share")).where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.floor((F.length("text") - 1) / piece) + 1)
    low = low.select("lang", "h", F.substr("text", (place * piece + 1).cast("int"), F.lit(piece)).alias("piece"))
    found = defaultdict(list)
    for r in low.groupBy("lang", "h").agg(F.min("piece").alias("piece")).collect():
        found[r["lang"]].append((r["h"], r["piece"]))
    return {lang: (b"\n".join(normal(p) for _, p in sorted(found[lang])[:each]), rows_of[lang]) for lang in sorted(found)}


class Classifier:
    def __init__(self, raw: dict[str, tuple[bytes, int]]):
        self.languages, self.compressors = list(raw), []
        total = sum(n for _, n in raw.values())
        self.prior = np.array([math.log2(total / n) / 8 for _, n in raw.values()])  # bytes that name the language
        for content, _ in raw.values():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected; without letters or without languages (und, 0, rejected)."""
        if not text or not self.compressors or not LETTER.search(text):
            return NONE, 0.0, True
        data = normal(text)
        sizes = np.array([len(c.compress(data)) for c in self.compressors], np.float64) + self.prior
        best = int(sizes.argmin())
        score = 1.0 / float(np.exp(-(sizes - sizes[best]) / SCALE).sum())
        second = np.partition(sizes, 1)[1] if len(sizes) > 1 else math.inf
        return self.languages[best], score, bool(second - sizes[best] < MARGIN * sizes[best])


@lru_cache(maxsize=2)
def _model(pickled: bytes) -> Classifier:
    """One model for a worker process, whatever the number of its tasks."""
    return Classifier(pickle.loads(pickled))


def identify(docs: DataFrame, train: Column, sample: int = SAMPLE, piece: int = PIECE) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and rejected for every row of ``docs`` (doc_id, text, lang).

    Null texts and texts without a letter are ``und`` with score 0. Ties go to the language of more training
    rows, then to the one that sorts first. Without training rows every text is ``und``. Texts are compressed whole,
    however long; extra columns are not read; repeated rows give repeated results.
    """
    ship(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(pickle.dumps(dictionaries(docs, train, sample, piece)))

    def run(batches):
        model = _model(raw.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fold_remainder(F.col("doc_id"), 4) != 2)
    return found.select("doc_id", (fold_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
