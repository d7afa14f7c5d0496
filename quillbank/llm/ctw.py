"""Language-model scores by context-tree weighting over bytes.

The next byte is decomposed into eight binary choices; each has its own tree over the preceding DEPTH bytes. A node holds
Krichevsky-Trofimov counts; its weighted probability mixes, half and half, its own estimate with the product of its
children's, so all depths take part. After training the mixture is fixed: a node's own estimate has the weight that the
training text gives it, the rest goes to the child; the recursion ends at the deepest node that training has seen.

How it is spread: documents form shards of some megabytes (``packing``). A shard sends its distinct (context, byte) pairs
and words with their training counts, as compressed blobs, to buckets of the nearest two context bytes, where whole
subtrees are at hand. Counts of at most FAN shards are summed at a time, in as many levels as the shards need. The
256 x 255 nodes above are summed and sent to every bucket, a fixed size. Each shard gets back the values of just the pairs
and words that it sent, in its own order. No model goes to the driver or to all executors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbank.llm.packing import bucket_count, pack, raws_of, squeeze, unpack, unsqueeze
from quillbank.llm.shared import LongMap, cut, fold_remainder, mix64, read, reclaim, ship

DEPTH = 6  # a 64-bit key with the byte itself holds up to 7
SHARD_BYTES = 10_000_000
CHUNK_BYTES = 2_000_000
#: Text for each bucket of pairs, and shards (then sums of shards) whose counts are summed together.
BUCKET_BYTES, FAN = 4_000_000, 256
EDGE = b"\xff"  # not in UTF-8: stands before the text DEPTH times and after it once
HALF = math.log(0.5)


def word_hashes(raw: bytes) -> np.ndarray:
    """64 bits for each word in lower case and one for the end."""
    words = raw.lower().split()
    words.append(EDGE)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def byte_pairs(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all (context, byte) pairs, nearest context byte first and the byte last, and how many each text has."""
    data = np.frombuffer(b"".join(EDGE * DEPTH + r.lower() + EDGE for r in raws), np.uint8)
    sizes = np.array([len(r) + DEPTH + 1 for r in raws], np.int64)
    keys = np.zeros(len(data), np.uint64)
    each = keys.view(np.uint8).reshape(-1, 8)  # little-endian: the byte comes first, the nearest context byte last
    each[:, 0] = data
    for d in range(1, DEPTH + 1):
        each[d:, DEPTH + 1 - d] = data[:-d]
    real = np.ones(len(data), bool)
    begins = np.cumsum(sizes) - sizes
    for d in range(DEPTH):
        real[begins + d] = False
    return keys[real], sizes - DEPTH


def _chunks(raws: list[bytes]):
    lo, total = 0, 0
    for i, r in enumerate(raws):
        total += len(r) + 1
        if total >= CHUNK_BYTES:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(raws):
        yield lo, len(raws)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


def counts_of(raws: list[bytes], train: np.ndarray) -> list[np.ndarray]:
    """A shard's distinct words and their training counts, then its distinct pairs and theirs."""
    parts: tuple[list, list] = ([], [])
    for lo, hi in _chunks(raws):
        for flag in (True, False):
            some = [r for r, f in zip(raws[lo:hi], train[lo:hi].tolist(), strict=True) if f == flag]
            for part, keys in zip(parts, (np.concatenate([word_hashes(r) for r in some]), byte_pairs(some)[0]) if some else (), strict=False):
                keys, n = np.unique(keys, return_counts=True)
                part.append((keys, n if flag else np.zeros_like(n)))
    return [x for part in parts for x in _summed(*(np.concatenate([*y, np.zeros(0, kind)]) for y, kind in zip(zip(*part) if part else ((), ()), (np.uint64, np.int64), strict=True)))]


#: For the nearest two context bytes, nearest first, 64 bits that say which bucket has them.
SPREAD = mix64(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _dealt(counts: list[np.ndarray], buckets: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Words and pairs with their numbers in the order of their buckets, and where each bucket's begin."""
    rows, edges = [], []
    for keys, n, spread in ((counts[0], counts[1], counts[0]), (counts[2], counts[3], SPREAD[counts[2] >> np.uint64(8 * (DEPTH - 1))])):
        bucket = ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows += [keys[order], n[order]]
        edges.append(np.searchsorted(bucket[order], np.arange(buckets + 1)))
    return rows, edges


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series above 8, brought down by the recurrence."""
    z = x + 8
    down = np.ones_like(z)
    for k in range(8):
        down *= x + k
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - np.log(down)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    a, b = zeros.astype(np.float64), ones.astype(np.float64)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1)


SMALL = 128
#: Values for small counts, which nearly all nodes have.
FEW = _log_kt(*np.divmod(np.arange(SMALL * SMALL), SMALL))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    zeros, ones = np.asarray(zeros), np.asarray(ones)
    out = FEW[np.minimum(zeros, SMALL - 1).astype(np.int64) * SMALL + np.minimum(ones, SMALL - 1).astype(np.int64)]
    many = (zeros >= SMALL) | (ones >= SMALL)
    if many.any():
        out[many] = _log_kt(zeros[many], ones[many])
    return out


class Pairs:
    """The distinct (context, byte) pairs of one depth: sorted keys, training counts, and which of them each key has."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        each = ((keys >> np.uint64(8 * (DEPTH + 1 - depth))) << np.uint64(8)) | (keys & np.uint64(255)) if depth < DEPTH else keys
        order = np.argsort(each, kind="stable") if depth < DEPTH else np.arange(len(keys))
        each = each[order]
        new = np.concatenate([np.ones(min(len(each), 1), bool), each[1:] != each[:-1]])
        first = np.flatnonzero(new)
        self.key, self.symbol, self.sample = each[first], each[first] & np.uint64(255), order[first]  # sample: a key of each pair
        self.n = np.add.reduceat(n[order], first) if len(first) else n[:0]
        self.of_key = np.empty(len(keys), np.int64)
        self.of_key[order] = np.cumsum(new) - 1


class Nodes:
    """Binary nodes of one depth and one bit place: sorted keys (context, bits so far), their counts and weighted probability."""

    def __init__(self, pairs: Pairs, bit: int):
        self.pairs = pairs
        key = self._key(pairs.key, bit)
        new = np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]])
        self.first = np.flatnonzero(new)
        self.of_pair = np.cumsum(new) - 1
        self.key = key[self.first]
        one = ((pairs.symbol >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        self.n1 = np.add.reduceat(pairs.n * one, self.first) if len(key) else pairs.n[:0]
        self.n0 = np.add.reduceat(pairs.n, self.first) - self.n1 if len(key) else pairs.n[:0]
        self.own = log_kt(self.n0, self.n1)
        self.weighted, self.weight = self.own, np.ones(len(self.key))

    @staticmethod
    def _key(pair: np.ndarray, bit: int) -> np.ndarray:
        return (pair & ~np.uint64(255)) | ((pair & np.uint64(255)) >> np.uint64(8 - bit))

    def find(self, pair: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of any pairs of this depth, and whether training has seen them."""
        key = self._key(pair, bit)
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return at, (self.key[at] == key if len(self.key) else np.zeros(len(key), bool))

    def add_children(self, child: Nodes) -> None:
        parent = self.of_pair[self.pairs.of_key[child.pairs.sample[child.first]]]
        self.weighted = HALF + np.logaddexp(self.own, np.bincount(parent, child.weighted, len(self.key)))
        self.weight = np.exp(HALF + self.own - self.weighted)

    def estimate(self, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        return (np.where(one, self.n1[at], self.n0[at]) + 0.5) / (self.n0[at] + self.n1[at] + 1.0)


def pairs_of(keys: np.ndarray, n: np.ndarray, top: int = 2) -> list[Pairs]:
    """Depths ``top`` to DEPTH for sorted pair keys with training counts above 0."""
    return [Pairs(keys, n, d) for d in range(top, DEPTH + 1)]


def subtree(levels: list[Pairs], bit: int) -> list[Nodes]:
    nodes = [Nodes(x, bit) for x in levels]
    for upper, lower in zip(nodes[-2::-1], nodes[:0:-1], strict=True):
        upper.add_children(lower)
    return nodes


def root_parts(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What depth 1 needs from these subtrees: (context byte, bits so far) nodes, their zeros, ones and children's sum."""
    parts, levels = [], pairs_of(keys, n)
    for bit in range(8):
        nodes = subtree(levels, bit)[0]
        context, prefix = nodes.key >> np.uint64(16), (nodes.key & np.uint64(255)) | np.uint64(1 << bit)
        parts.append(((context << np.uint64(8)) | prefix, nodes.n0, nodes.n1, nodes.weighted))
    key, n0, n1, weighted = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return key, n0, n1, weighted
    return key[order][first], *(np.add.reduceat(x[order], first) for x in (n0, n1, weighted))


class Root:
    """Depths 0 and 1, for all bit places, as tables over (context byte, bits so far with a leading 1)."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray):
        table = np.zeros((3, 256 * 256))
        for row, x in zip(table, (n0, n1, children), strict=True):
            row[key] = x
        self.levels = []
        ones, zeros, below = table[1].reshape(256, 256), table[0].reshape(256, 256), table[2].reshape(256, 256)
        for n1_, n0_, sums in ((ones, zeros, below), (ones.sum(axis=0)[None], zeros.sum(axis=0)[None], None)):
            own = log_kt(n0_, n1_)
            sums = self.levels[0][3].sum(axis=0)[None] if sums is None else sums
            weighted = HALF + np.logaddexp(own, sums)
            self.levels.append((n0_, n1_, np.exp(HALF + own - weighted), weighted))

    def predict(self, context: np.ndarray, prefix: np.ndarray, one: np.ndarray, below: np.ndarray, below_seen: np.ndarray) -> np.ndarray:
        for (n0, n1, weight, _), row in zip(self.levels, (context, np.zeros_like(context)), strict=True):
            total = n0[row, prefix] + n1[row, prefix]
            estimate = (np.where(one, n1[row, prefix], n0[row, prefix]) + 0.5) / (total + 1.0)
            mixed = weight[row, prefix] * estimate + (1 - weight[row, prefix]) * below
            below = np.where(total > 0, np.where(below_seen, mixed, estimate), below)
            below_seen = below_seen | (total > 0)
        return below


def log_probabilities(keys: np.ndarray, n: np.ndarray, root: Root) -> np.ndarray:
    """log10 of the byte's probability for each sorted pair key; whole depth-2 subtrees must be among the keys."""
    out, known, new = np.zeros(len(keys)), np.flatnonzero(n > 0), np.flatnonzero(n == 0)
    levels = pairs_of(keys[known], n[known])
    asked = [((keys[new] >> np.uint64(8 * (DEPTH + 1 - d))) << np.uint64(8)) | (keys[new] & np.uint64(255)) if d < DEPTH else keys[new] for d in range(2, DEPTH + 1)]
    for bit in range(8):
        nodes = subtree(levels, bit)
        for some, places in ((known, None), (new, asked)):
            symbol, nearest = keys[some] & np.uint64(255), (keys[some] >> np.uint64(8 * DEPTH)).astype(np.int64)
            one = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            below, below_seen = np.full(len(some), 0.5), np.zeros(len(some), bool)
            for k in range(len(nodes) - 1, -1, -1):
                each = nodes[k]
                if not len(each.key):
                    continue
                if places is None:  # training has seen these at every depth
                    at = each.of_pair[each.pairs.of_key]
                    weight = each.weight[at]  # 1 at the deepest nodes
                    below = weight * each.estimate(at, one) + (1 - weight) * below
                    continue
                at, seen = each.find(places[k], bit)
                weight = np.where(below_seen, each.weight[at], 1.0)
                below = np.where(seen, weight * each.estimate(at, one) + (1 - weight) * below, below)
                below_seen |= seen
            prefix = ((symbol >> np.uint64(8 - bit)) | np.uint64(1 << bit)).astype(np.int64)
            out[some] += np.log10(root.predict(nearest, prefix, one, below, below_seen if places is not None else np.ones(len(some), bool)))
    return out


#: Values are sent as 32 bits: below 8 in steps of 2**-28, from there on (up to 136, which no byte reaches) of 2**-24.
def _to_bits(value: np.ndarray) -> np.ndarray:
    cost = -value
    return np.where(cost < 8, np.minimum(np.rint(cost * 2.0**28), 2.0**31 - 1), 2.0**31 + np.rint((cost - 8) * 2.0**24)).astype(np.uint32)


def _from_bits(code: np.ndarray) -> np.ndarray:
    low = (code & np.uint32(0x7FFFFFFF)).astype(np.float64)
    return -np.where(code < 2**31, low * 2.0**-28, 8 + low * 2.0**-24)


def _summed_blobs(blobs: list[bytes]) -> list[np.ndarray]:
    """Words and pairs of several blobs together, their counts summed."""
    parts = [unsqueeze(b) for b in blobs]
    return [x for k in (0, 2) for x in _summed(np.concatenate([p[k] for p in parts]), np.concatenate([p[k + 1].astype(np.int64) for p in parts]))]


def _squeezed(counts: list[np.ndarray]) -> bytes:
    return squeeze(*(x if x.dtype == np.uint64 else x.astype(np.uint32) if not len(x) or x.max() < 2**32 else x for x in counts))


def _binaries(**columns: list) -> pa.Table:
    return pa.table({name: pa.array(x, pa.binary() if name not in ("bucket", "part", "shard") else pa.int64()) for name, x in columns.items()})


def score(docs: DataFrame, train: Column, shard_bytes: int = SHARD_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row of ``docs``.

    Training are the rows where ``train`` holds (null: not). A null or empty text is the end alone. Without training rows
    every bit has probability 1/2. Repeated rows count each time and get equal scores. Columns other than doc_id, text
    and those of ``train`` are not read. ``score`` is the log10 probability of the text's bytes (A-Z in lower case) and
    its end; ``bits_per_byte`` its code length over its bytes and the end; ``base_score`` the log10 probability of its
    words and the end under add-one counts.
    """
    spark = docs.sparkSession
    ship(spark)
    packed = pack(docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train")), shard_bytes)
    buckets = bucket_count(packed, BUCKET_BYTES)
    parts = -(-packed.count() // fan)

    def gathered(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rest, sizes, data = unpack(row)
                made, edges = _dealt(counts_of(raws_of(sizes, data), np.array(rest.column("train").to_pylist(), bool)), buckets)
                full = [b for b in range(buckets) if any(e[b] < e[b + 1] for e in edges)]
                blobs = [_squeezed([x[edges[k // 2][b] : edges[k // 2][b + 1]] for k, x in enumerate(made)]) for b in full]
                yield from _binaries(bucket=full, shard=[row["shard"]] * len(full), blob=blobs).to_batches()

    def held(table: pa.Table) -> pa.Table:
        """What a part of the shards sent to one bucket, in one row, and its sum."""
        blobs = table.column("blob").to_pylist()
        sent = np.array([len(b) for b in blobs], "<i8").tobytes() + table.column("shard").to_numpy().astype("<i8").tobytes()
        return _binaries(bucket=table.column("bucket")[:1].to_pylist(), part=table.column("part")[:1].to_pylist(), sent=[sent], blobs=[b"".join(blobs)], model=[_squeezed(_summed_blobs(blobs))])

    sent = packed.mapInArrow(gathered, "bucket bigint, shard bigint, blob binary").withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(max(parts, 1))))
    rows = cut(sent.groupBy("bucket", "part").applyInArrow(held, "bucket bigint, part bigint, sent binary, blobs binary, model binary"))
    del sent
    reclaim(spark)

    def joined(table: pa.Table) -> pa.Table:
        return _binaries(bucket=table.column("bucket")[:1].to_pylist(), part=table.column("part")[:1].to_pylist(), model=[_squeezed(_summed_blobs(table.column("model").to_pylist()))])

    models, several = rows.select("bucket", "part", "model"), parts > 1
    while parts > 1:
        parts = -(-parts // fan)
        models = cut(models.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("bucket", "part").applyInArrow(joined, "bucket bigint, part bigint, model binary"))

    def upper(batches):
        for batch in batches:
            for blob in batch.column("model").to_pylist():
                _, words, keys, n = unsqueeze(blob)
                key, n0, n1, weighted = root_parts(keys[n > 0], n[n > 0].astype(np.int64))
                told = np.append(key.astype(np.int64), [-1])  # -1: the words' number and how many are known
                yield pa.RecordBatch.from_arrays([pa.array(told.astype(np.int32)), pa.array(np.append(n0, words.sum(dtype=np.int64))), pa.array(np.append(n1, (words > 0).sum())), pa.array(np.append(weighted, 0.0))], names=["node", "n0", "n1", "below"])

    summed = models.mapInArrow(upper, "node int, n0 bigint, n1 bigint, below double").groupBy("node").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).toPandas()  # at most 256 * 255 + 1 rows
    nodes = summed.to_numpy(np.float64) if len(summed) else np.zeros((0, 4))
    is_word = nodes[:, 0] < 0
    total, distinct = (int(nodes[is_word, k].sum()) for k in (1, 2))
    nodes = nodes[~is_word]
    root = spark.sparkContext.broadcast(Root(nodes[:, 0].astype(np.int64), nodes[:, 1], nodes[:, 2], nodes[:, 3]))

    def values_of(model: bytes) -> list[np.ndarray]:
        """Words, their counts, pairs and the values of these, from a bucket's counts."""
        words, known, keys, n = unsqueeze(model)
        return [words, known, keys, _to_bits(log_probabilities(keys, n.astype(np.int64), root.value))]

    def valued(batches):
        for batch in batches:
            yield from _binaries(bucket=batch.column("bucket").to_pylist(), model=[squeeze(*values_of(m)) for m in batch.column("model").to_pylist()]).to_batches()

    def replies(batches):
        for batch in batches:
            for bucket, model, sent, blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "model", "sent", "blobs")), strict=True):
                words, known, keys, code = unsqueeze(model) if several else values_of(model)
                lengths, shards = np.frombuffer(sent, "<i8").reshape(2, -1)
                ends = np.cumsum(lengths)
                for shard, lo, hi in zip(shards.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
                    own = unsqueeze(blobs[lo:hi])
                    reply = squeeze(known[np.searchsorted(words, own[0])], code[np.searchsorted(keys, own[2])])
                    yield from _binaries(bucket=[bucket], shard=[shard], blob=[reply]).to_batches()

    with_model = rows
    if several:  # a bucket's values are made once, whatever its number of rows
        values = cut(models.select("bucket", "model").mapInArrow(valued, "bucket bigint, model binary"))
        with_model = rows.drop("model").join(values.hint("merge"), "bucket")
    told = with_model.mapInArrow(replies, "bucket bigint, shard bigint, blob binary")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([_score_shard(row, right, buckets, total, distinct) for row in left.to_pylist()])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return packed.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(scored, f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double")


def _score_shard(row: dict, told: pa.Table, buckets: int, total: int, distinct: int) -> pa.Table:
    rest, sizes, data = unpack(row)
    raws, train = raws_of(sizes, data), np.array(rest.column("train").to_pylist(), bool)
    (words, _, keys, _), _ = _dealt(counts_of(raws, train), buckets)
    replies = [unsqueeze(b) for _, b in sorted(zip(told.column("bucket").to_pylist(), told.column("blob").to_pylist(), strict=True))]
    count, value = (np.concatenate(x) for x in zip(*replies, strict=True))
    word_map, pair_map, value = LongMap(words), LongMap(keys), _from_bits(value)
    tokens, known, base, scores = [], [], [], np.zeros(len(raws))
    for lo, hi in _chunks(raws):
        hashed = [word_hashes(r) for r in raws[lo:hi]]
        n = np.array([len(h) for h in hashed], np.int64)
        c = count[word_map.find(np.concatenate(hashed))].astype(np.float64)
        starts = np.cumsum(n) - n
        tokens.append(n)
        known.append(np.add.reduceat((c > 0).astype(np.int64), starts))
        base.append(np.add.reduceat(np.log10((c + 1) / (total + distinct + 1)), starts))
        pairs, n = byte_pairs(raws[lo:hi])
        scores[lo:hi] = np.add.reduceat(value[pair_map.find(pairs)], np.cumsum(n) - n)
    own = np.maximum(sizes, 0)
    return pa.table(
        {
            "doc_id": rest.column("doc_id"), "train": rest.column("train"), "n_tokens": pa.array(np.concatenate(tokens)), "n_known": pa.array(np.concatenate(known)),
            "train_tokens": pa.array([total] * len(raws), pa.int64()), "base_score": pa.array(np.concatenate(base)), "score": pa.array(scores),
            "n_bytes": pa.array(own), "bits_per_byte": pa.array(-scores / math.log10(2) / (own + 1)),
        }
    )


def op3(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, fold_remainder(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
