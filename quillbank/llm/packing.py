"""Documents in compressed shards, and arrays in compressed blobs.

Operators that read the texts several times, or exchange millions of numbers, move a few rows of some megabytes in place
of many small ones: a shard holds some megabytes of consecutive texts and the other columns beside them, a blob holds
numpy arrays. Nothing of a size that grows with the input is held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillbank.llm.shared import cut, ship

SHARD_BYTES = 8_000_000
PACKED = "shard bigint, raw_bytes bigint, rest binary, sizes binary, texts binary"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes: all first bytes of an array's numbers, then all second ones, and so on, compressed."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes()
    kinds = b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + kinds + planes)


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    lengths = np.frombuffer(raw, "<i8", n, 8)
    at, out = 8 + 8 * n + 4 * n, []
    for k, length in enumerate(lengths.tolist()):
        kind = np.dtype(raw[8 + 8 * n + 4 * k : 12 + 8 * n + 4 * k].decode().strip())
        size = kind.itemsize
        out.append(np.frombuffer(raw, np.uint8, length * size, at).reshape(size, length).T.copy().view(kind).reshape(length))
        at += length * size
    return out


def pack(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each run of documents with about ``shard_bytes`` of text, written to the shared scratch folder.

    ``rest`` has all columns but text as an Arrow stream, ``sizes`` the bytes of each text (-1: null), ``texts`` the
    texts' UTF-8 end to end, compressed. Every row of ``docs``, repeated or without an id, is in exactly one shard; a
    longer text is a shard of its own.
    """
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]

    def made(shard: int, rest: list[pa.RecordBatch], sizes: list[int], raws: list[bytes]) -> pa.RecordBatch:
        data = b"".join(raws)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest[0].schema) as out:
            for part in rest:
                out.write_batch(part)
        row = (shard, len(data), sink.getvalue().to_pybytes(), np.array(sizes, "<i8").tobytes(), zstandard.ZstdCompressor(level=3).compress(data))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=["shard", "raw_bytes", "rest", "sizes", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        rest, sizes, raws, total = [], [], [], 0
        for batch in batches:
            lo, beside = 0, batch.select(others)
            for i, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                sizes.append(-1 if raw is None else len(raw))
                raws.append(raw or b"")
                total += len(raw or b"")
                if total >= shard_bytes:
                    yield made(shard, [*rest, beside.slice(lo, i + 1 - lo)], sizes, raws)
                    shard, lo = shard + 1, i + 1
                    rest, sizes, raws, total = [], [], [], 0
            if lo < batch.num_rows:
                rest.append(beside.slice(lo))
        if sizes:
            yield made(shard, rest, sizes, raws)

    return cut(docs.mapInArrow(run, PACKED))


def unpack(row: dict) -> tuple[pa.Table, np.ndarray, bytes]:
    """The other columns, the sizes of the texts (-1: null) and their bytes end to end, of one packed row."""
    with pa.ipc.open_stream(row["rest"]) as stream:
        rest = stream.read_all()
    return rest, np.frombuffer(row["sizes"], "<i8"), zstandard.ZstdDecompressor().decompress(row["texts"])


def raws_of(sizes: np.ndarray, data: bytes) -> list[bytes]:
    """Each text's bytes; a null text has none."""
    ends = np.cumsum(np.maximum(sizes, 0))
    return [data[e - max(n, 0) : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def bucket_count(packed: DataFrame, bucket_bytes: int) -> int:
    """Into how many buckets an exchange falls, so that each has some megabytes and all tasks have several."""
    from pyspark.sql import functions as F

    raw = packed.agg(F.coalesce(F.sum("raw_bytes"), F.lit(0))).first()[0]
    return max(4 * int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-raw // bucket_bytes))
