"""Byte-level BPE encoding and decoding with numpy matrices.

Pieces (matches of the split pattern) go through a bounded cache; those not in it are bucketed by length, padded into one
matrix per bucket, and merged together: in each round every row merges its leftmost pair of least rank, found by one
lookup of all adjacent pairs in a hash table, and the matrix is compacted to the left. Rows that have no pair left leave
the matrix. Pieces longer than LONG bytes are merged one at a time with a heap over a linked list, in the same order of
merges, since a matrix round costs the whole row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quillbank.llm.shared import LongMap, read, ship

LONG = 256
#: Pieces that a worker remembers; beyond this it starts anew.
CACHE = 400_000
NONE = np.int64(2**31 - 1)


class ByteBPE:
    """Encoder and decoder for ranks given as (token bytes, rank) pairs; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = max(ranks.values()) + 1
        # A pair of tokens merges where the joined bytes are a token: every split of every token into two tokens.
        left, right, into = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), into.append(rank)
        self.pairs = LongMap(np.array(left, np.uint64) * np.uint64(self.size) + np.array(right, np.uint64))
        self.into = np.append(np.array(into, np.int64), NONE)  # row -1 is no pair
        by_rank = sorted((r, t) for t, r in ranks.items())
        self.lengths = np.zeros(self.size + 1, np.int64)
        for r, t in by_rank:
            self.lengths[r + 1] = len(t)
        self.starts = np.cumsum(self.lengths)
        self.blob = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)
        self.cache: dict[str, bytes] = {}

    @classmethod
    def load(cls, lines: bytes, pattern: str) -> ByteBPE:
        """From the text of a rank file: a line per token, its bytes in base64, a space, its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}, pattern)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) * np.uint64(self.size) + right.astype(np.uint64)
        return self.into[self.pairs.find(keys.ravel())].reshape(left.shape)

    def _merge_matrix(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of ``ids`` (padded on the right) to its end; returns ids and lengths."""
        out, left = np.zeros_like(ids), lengths.copy()
        rows, ids, lengths = np.arange(len(ids)), ids.copy(), lengths.copy()
        ranks = np.full(ids.shape, NONE, np.int64)
        if ids.shape[1] > 1:
            ranks[:, :-1] = self._pair_ranks(ids[:, :-1], ids[:, 1:])
            ranks[:, :-1][np.arange(1, ids.shape[1]) >= lengths[:, None]] = NONE
        columns = np.arange(ids.shape[1])
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            least = ranks[np.arange(len(rows)), at]
            done = least == NONE
            if done.any():
                out[rows[done]], left[rows[done]] = ids[done], lengths[done]
                live = ~done
                rows, ids, lengths, ranks, at, least = rows[live], ids[live], lengths[live], ranks[live], at[live], least[live]
                if not len(rows):
                    break
            moved = columns[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(moved, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            lengths -= 1
            each = np.arange(len(rows))
            ids[each, at] = least
            after, before = at + 1 < lengths, at > 0
            ranks[each, at] = NONE
            ranks[each[after], at[after]] = self._pair_ranks(ids[each[after], at[after]], ids[each[after], at[after] + 1])
            ranks[each[before], at[before] - 1] = self._pair_ranks(ids[each[before], at[before] - 1], ids[each[before], at[before]])
        return out, left

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece: a heap of (rank, position) over a linked list; stale entries are skipped."""
        ids = self.byte_rank[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self._pair_ranks(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        start, end = list(range(n)), list(range(1, n + 1))  # of the token that starts at i
        before, after, now = list(range(-1, n - 1)), list(range(1, n + 1)), [int(r) if r != NONE else -1 for r in first] + [-1]
        alive = [True] * n
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or now[i] != rank:
                continue
            j = after[i]
            alive[j] = False
            end[i], after[i] = end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    m = after[k]
                    r = self.ranks.get(piece[start[k] : end[m]], -1) if m < n else -1
                    now[k] = r
                    if r >= 0:
                        heapq.heappush(heap, (r, k))
        return np.array([self.ranks[piece[start[i] : end[i]]] for i in range(n) if alive[i]], np.uint32)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:  # a piece that is a token needs no merge, whatever its splits are
                out[i] = whole.to_bytes(4, "little")
                continue
            buckets.setdefault(max(2, 1 << (len(p) - 1).bit_length()) if len(p) <= LONG else 0, []).append(i)
        for width, members in buckets.items():
            if not width:
                for i in members:
                    out[i] = self._merge_long(pieces[i]).astype("<u4").tobytes()
                continue
            for lo in range(0, len(members), step := max(1, 4_000_000 // width)):
                block = members[lo : lo + step]
                lengths = np.array([len(pieces[i]) for i in block], np.int64)
                flat = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in block), np.uint8)
                ids, lengths = self._merge_matrix(self.byte_rank[flat].reshape(len(block), width), lengths)
                flat_ids = ids.astype("<u4")
                for row, (i, n) in enumerate(zip(block, lengths.tolist(), strict=True)):
                    out[i] = flat_ids[row, :n].tobytes()
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; a null text has none."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        new = list({p for pieces in split for p in pieces if p not in cache})
        cache.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        return [b"".join(map(cache.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as little-endian unsigned 32-bit integers."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(tokens):
            return b""
        lengths = self.lengths[tokens + 1]
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1]) + np.repeat(self.starts[tokens] - (ends - lengths), lengths)
        return self.blob[index].tobytes()


@lru_cache(maxsize=2)
def _model(lines: bytes, pattern: str) -> ByteBPE:
    """One model for a worker process, whatever the number of its tasks."""
    return ByteBPE.load(lines, pattern)


def _slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``max_bytes`` of text, so that a batch of long texts is not held in pieces at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > max_bytes:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def map_texts(docs: DataFrame, vocabulary: bytes, pattern: str, per_text, schema: str) -> DataFrame:
    """``per_text(model, texts)`` gives a dict of arrays for the columns that ``schema`` adds to the other columns."""
    ship(docs.sparkSession)
    lines = docs.sparkSession.sparkContext.broadcast(vocabulary)
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        model = _model(lines.value, pattern)
        for batch in batches:
            for part in _slices(batch, "text"):
                made = per_text(model, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + list(made.values()), names=others + list(made))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def vocabulary_file(path: str | None = None) -> tuple[bytes, str]:
    """The rank file's text and the split pattern; by default the installed multilingual vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (its columns except text) with n_tokens and ids, an array of the text's token ids.

    A null or empty text has no tokens; repeated rows give repeated results. Columns of ``docs`` named n_tokens or ids
    are replaced.
    """

    def per_text(model, texts):
        ids = model.encode_batch(texts)
        ends = np.cumsum([0] + [len(x) // 4 for x in ids])
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        return {"n_tokens": pa.array(np.diff(ends), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}

    return map_texts(docs.drop("n_tokens", "ids"), *vocabulary_file(path), per_text, "n_tokens bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ids replaced by text, the decoded bytes as UTF-8; a null array gives a null text."""
    ship(encoded.sparkSession)
    vocabulary, pattern = vocabulary_file(path)
    lines = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    others = [c for c in encoded.columns if c not in ("ids", "text")]

    def run(batches):
        model = _model(lines.value, pattern)
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(texts, pa.string())], names=others + ["text"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.schema if f.name in others)
    return encoded.mapInArrow(run, f"{kept}text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (its columns except text) with n_tokens, ids_sha256 and decoded_sha256, the round trip's digests."""

    def per_text(model, texts):
        ids = model.encode_batch(texts)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return {
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([sha(x) for x in ids], pa.string()),
            "decoded_sha256": pa.array([sha(model.decode(x)) for x in ids], pa.string()),
        }

    return map_texts(docs.drop("n_tokens", "ids_sha256", "decoded_sha256"), *vocabulary_file(path), per_text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents").select("doc_id", "text"))
