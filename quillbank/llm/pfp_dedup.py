"""Removal of byte strings that an earlier document has already, by prefix-free parsing.

Rolling-hash triggers parse every document into phrases: a window of ``length`` bytes belongs to the trigger, the least
hash of TRIGGER bytes inside it (the leftmost of equals), and a phrase is the run of windows with one trigger, its bytes
overlapping the next phrase's by ``length`` - 1. Where a trigger falls depends on the window's bytes alone, so equal
windows have equal triggers wherever they are, and no phrase's windows begin in another one.

* Triggers: the shards send theirs to buckets of the hash; back come those that two documents or more have. Unique text
  goes no further.
* Dictionary and parse: each shard sends its distinct phrases at those triggers with the least document that has them.
  A bucket joins them to its part of the dictionary and sorts the suffixes of phrases whose trigger has several: equal
  prefixes of ``length`` bytes, compared as bytes, are neighbours there. The parse tells which document is the first to
  have each of those phrases, and so the first that has the prefix in corpus order.
* Removal: each shard gets, for the phrases that it sent, the first document of every window, and removes the bytes of
  the windows that an earlier document has.

A phrase has all its windows whole, so the order of the parse's suffixes beyond a phrase never decides between prefixes
of ``length`` bytes; what is needed of it is the order of documents, which each dictionary entry carries.

Everything is exchanged as compressed blobs, a shard's for a bucket or back (``packing``). A trigger with more than HOT
phrases, such as the edge of a line that a third of all documents have, sends its windows one by one, as phrases of one
window in buckets of their own hashes, so that it is spread too. Memory is bounded by a shard, and by HOT phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbank.llm.packing import SHARD_BYTES, bucket_count, pack, raws_of, squeeze, unpack, unsqueeze
from quillbank.llm.shared import cut, mix64, read, reclaim, ship

LENGTH, TRIGGER = 50, 24
CHUNK = 1 << 19
#: Phrases of one trigger beyond which its windows are exchanged one by one.
HOT = 100_000
#: Text for each bucket of an exchange, and windows whose suffixes are sorted together (or those of one trigger).
BUCKET_BYTES, SORTED = 8_000_000, 500_000
#: Kinds of blobs that a shard gets: keys of shared triggers, and the first documents of its phrases.
KEYS, FIRSTS = 0, 1

_random = np.random.default_rng(50)
BYTE = _random.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0x9E3779B97F4A7C15
INVERSE = pow(STEP, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Text:
    """Some bytes, end to end, with hashes of any part of them."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        global _up, _down
        if len(_up) < n:
            _up, _down = _powers(STEP, max(n, CHUNK + 4096)), _powers(INVERSE, max(n, CHUNK + 4096))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(BYTE[data] * _up[: n - 1], out=self.sums[1:])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[begin]) * _down[begin] + (end - begin).astype(np.uint64))


_up = _down = np.zeros(0, np.uint64)


def _pieces(raws: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, offset, bytes) of about CHUNK bytes; the parts of a longer document share length - 1 bytes."""
    held, total = [], 0
    for d, raw in enumerate(raws):
        for lo in range(0, max(len(raw) - length + 1, 0), CHUNK):
            part = raw[lo : lo + CHUNK + length - 1]
            if held and total + len(part) > CHUNK:
                yield held
                held, total = [], 0
            held.append((d, lo, part))
            total += len(part)
    if held:
        yield held


class Parse:
    """The phrases of some pieces: document, start in it and in ``data``, number of windows and trigger's hash."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], length: int, trigger: int = TRIGGER):
        self.data, self.length = b"".join(p for _, _, p in pieces), length
        data = np.frombuffer(self.data, np.uint8)
        self.text = Text(data)
        sizes = np.array([len(p) for _, _, p in pieces], np.int64)
        ends = np.cumsum(sizes)
        valid = np.ones(len(data), bool)
        for back in range(1, length):
            valid[ends - back] = False
        windows = np.flatnonzero(valid)  # every piece has at least one
        low, places = self.text.sums, np.arange(len(data) - trigger + 1)
        grams = mix64((low[trigger:] - low[:-trigger]) * _down[: len(places)])  # hash of the trigger's bytes at each place
        least = (grams & ~np.uint64(4 * CHUNK - 1)) | places.astype(np.uint64)
        width, span = length - trigger + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        at = (least[windows] & np.uint64(4 * CHUNK - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.begin, self.count = windows[first], np.diff(np.append(first, len(windows)))
        self.trigger = grams[at[first]] & ~np.uint64(0xFFFF)  # 48 bits: fewer bytes to move, and a false hit is harmless
        piece = np.searchsorted(ends, self.begin, "right")
        self.document = np.array([d for d, _, _ in pieces])[piece]
        self.start = self.begin - (ends - sizes)[piece] + np.array([lo for _, lo, _ in pieces])[piece]


def _expand(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 ... n[0] numbers in all, then those of the next."""
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs begin, given the places at which something new does, and their lengths."""
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _changes(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash; ascending in it."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Shard:
    """One packed row: ids, texts, and the parse of those rows that have an id and a text."""

    def __init__(self, row: dict, length: int):
        self.rest, self.sizes, self.data = unpack(row)
        self.length, ids = length, self.rest.column("doc_id").combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.raws = raws_of(self.sizes, self.data)

    def parses(self) -> Iterator[Parse]:
        for pieces in _pieces([r if k else b"" for r, k in zip(self.raws, self.known.tolist(), strict=True)], self.length):
            yield Parse(pieces, self.length)

    def triggers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and how often each occurs; the top bit is set where several documents have it."""
        parts = [(p.trigger, self.ids[p.document]) for p in self.parses()]
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        keys, own = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        keys, own = keys[order], own[order]
        first, n = _runs(_changes(keys))
        several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        return keys[first], np.minimum(n, 0x7FFF).astype(np.uint16) | (several.astype(np.uint16) << np.uint16(15))

    def phrases(self, shared: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[dict, dict]:
        """The distinct phrases at the shared triggers, in the order of their buckets, and where they occur.

        ``shared``: sorted keys, ``hot``: whether windows go one by one. The order is the same on every call.
        """
        seen: dict[bytes, int] = {}
        key, entry, document, start, count = [], [], [], [], []
        for p in self.parses() if len(shared) else ():
            at = np.minimum(np.searchsorted(shared, p.trigger), len(shared) - 1)
            found = shared[at] == p.trigger
            some = np.flatnonzero(found & ~hot[at])
            split = np.flatnonzero(found & hot[at])
            n = p.count[split]
            single = _expand(p.begin[split], n)
            begin = np.concatenate([p.begin[some], single])
            windows = np.concatenate([p.count[some], np.ones(len(single), np.int64)])
            end = begin + windows - 1 + self.length
            hashes = np.concatenate([p.trigger[some], p.text.hash(single, single + self.length)])
            known, data = len(seen), p.data
            own = np.fromiter((seen.setdefault(data[b:e], len(seen)) for b, e in zip(begin.tolist(), end.tolist(), strict=True)), np.int64, len(begin))
            fresh = np.flatnonzero(own >= known)
            first = fresh[np.unique(own[fresh], return_index=True)[1]]
            key.append(hashes[first]), entry.append(own), count.append(windows)
            document.append(np.concatenate([p.document[some], np.repeat(p.document[split], n)]))
            start.append(np.concatenate([p.start[some], _expand(p.start[split], n)]))
        key, entry, document, start, count = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in ((key, np.uint64), (entry, np.int64), (document, np.int64), (start, np.int64), (count, np.int64)))
        bucket = _bucket(key, buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        entry = place[entry]
        least = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(least, entry, self.ids[document])
        texts = list(seen)
        return (
            {"key": key[order], "bucket": bucket[order], "least": least, "text": [texts[i] for i in order.tolist()]},
            {"entry": entry, "document": document, "start": start, "count": count},
        )


def _blob_rows(shards: list[int], kind: int, buckets: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table({"shard": pa.array(shards, pa.int64()), "kind": pa.array([kind] * len(shards), pa.int32()), "bucket": pa.array(buckets, pa.int32()), "blob": pa.array(blobs, pa.binary())})


BLOBS = "shard bigint, kind int, bucket int, blob binary"


def in_several(table: pa.Table, hot: int) -> pa.Table:
    """One bucket's triggers from all shards: to each shard, those of its own that two documents have, and which are hot."""
    bucket, shards = table.column("bucket")[0].as_py(), table.column("shard").to_pylist()
    parts = [unsqueeze(b) for b in table.column("blob").to_pylist()]
    keys, told = (np.concatenate(x) for x in zip(*parts, strict=True))
    source = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, told, source = keys[order], told[order], source[order]
    first, n = _runs(_changes(keys))
    total = np.add.reduceat((told & np.uint16(0x7FFF)).astype(np.int64), first)
    several = (n > 1) | (np.maximum.reduceat(told, first) >= 0x8000)
    some = np.flatnonzero(np.repeat(several, n))
    keys, source, many = keys[some], source[some], np.repeat(total > hot, n)[some]
    order = np.argsort(source, kind="stable")
    ends = np.cumsum(np.bincount(source, minlength=len(parts)))
    rows = [(s, order[lo:hi]) for s, lo, hi in zip(shards, [0, *ends[:-1].tolist()], ends.tolist(), strict=True) if lo < hi]
    return _blob_rows([s for s, _ in rows], KEYS, [bucket] * len(rows), [squeeze(keys[x], many[x].astype(np.uint8)) for _, x in rows])


def suffix_order(data: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``begin`` by their first ``length`` bytes, and which differ from the one before."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data), np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + len(data)]
    places = [*range(0, max(length - 7, 1), 8), *([length - 8] if length % 8 and length > 8 else [])]
    columns = [word[begin + at] if length >= 8 else word[begin] >> np.uint64(8 * (8 - length)) for at in places]
    order = np.lexsort(columns[::-1])
    new = np.ones(len(begin), bool)
    new[1:] = False
    for column in columns:
        ordered = column[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    return order, new


def first_documents(texts: list[bytes], key: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the dictionary's phrases, given the first document of each: runs of windows and the first document that has those.

    Gives the number of runs of each phrase, and the windows and first document of each run. A phrase that is alone at
    its trigger, or whose trigger's phrases have one first document, needs no comparison; all others are sorted by their
    suffixes, those of a trigger together.
    """
    windows = np.array([len(t) for t in texts], np.int64) - length + 1
    order = np.argsort(key, kind="stable")
    at, n = _runs(_changes(key[order]))
    apart = np.minimum.reduceat(first[order], at) != np.maximum.reduceat(first[order], at) if len(at) else np.zeros(0, bool)
    runs, lengths, firsts = np.ones(len(texts), np.int64), [], []
    settled = order[np.repeat(~apart, n)]
    phrase, lengths, firsts = [settled], [windows[settled]], [first[settled]]
    open_, group = order[np.repeat(apart, n)], np.repeat(at, n)[np.repeat(apart, n)]
    edges = np.append(np.flatnonzero(_changes(group)), len(group))
    done = np.concatenate([[0], np.cumsum(windows[open_])])
    lo = 0
    while lo < len(open_):
        fits = int(np.searchsorted(done[edges], done[lo] + SORTED, "right")) - 1
        hi = int(edges[max(fits, int(np.searchsorted(edges, lo)) + 1)])
        part = open_[lo:hi]
        data = np.frombuffer(b"".join([texts[i] for i in part.tolist()]), np.uint8)
        m = windows[part]
        starts = np.cumsum(m + length - 1) - (m + length - 1)
        owner = np.repeat(np.arange(len(part)), m)
        ranked, new = suffix_order(data, _expand(starts, m), length)
        begins, sizes = _runs(new)
        value = np.empty(len(ranked), np.int64)
        value[ranked] = np.repeat(np.minimum.reduceat(first[part][owner[ranked]], begins), sizes)
        begins, sizes = _runs(_changes(owner) | _changes(value))
        runs[part] = np.bincount(owner[begins], minlength=len(part))
        phrase.append(part[owner[begins]]), lengths.append(sizes), firsts.append(value[begins])
        lo = hi
    order = np.argsort(np.concatenate(phrase), kind="stable")
    return runs, np.concatenate(lengths)[order], np.concatenate(firsts)[order]


def settle(table: pa.Table, length: int) -> pa.Table:
    """One bucket's phrases from all shards: to each shard, the first documents of its phrases' windows, in its order."""
    bucket, shards = table.column("bucket")[0].as_py(), table.column("shard").to_pylist()
    keys, least, sizes, seen, entry = [], [], [], {}, []
    for blob in table.column("blob").to_pylist():
        key, own, count, data = unsqueeze(blob)
        raw, ends = data.tobytes(), np.cumsum(count.astype(np.int64) + length - 1)
        entry += [seen.setdefault(raw[b:e], len(seen)) for b, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        keys.append(key), least.append(own), sizes.append(len(key))
    texts, entry = list(seen), np.array(entry, np.int64)
    key, first = np.zeros(len(texts), np.uint64), np.full(len(texts), np.iinfo(np.int64).max)
    key[entry] = np.concatenate(keys)
    np.minimum.at(first, entry, np.concatenate(least))
    runs, lengths, firsts = first_documents(texts, key, first, length)
    starts, blobs, lo = np.cumsum(runs) - runs, [], 0
    for n in sizes:
        some = entry[lo : lo + n]
        at = _expand(starts[some], runs[some])
        blobs.append(squeeze(runs[some].astype(np.uint32), lengths[at].astype(np.uint32), firsts[at]))
        lo += n
    return _blob_rows(shards, FIRSTS, [bucket] * len(shards), blobs)


def _told(table: pa.Table, kind: int) -> list[list[np.ndarray]]:
    """The blobs of one kind that a shard got, in the order of their buckets."""
    rows = sorted((b, x) for k, b, x in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True) if k == kind)
    return [unsqueeze(x) for _, x in rows]


def _shared(told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = _told(told, KEYS)
    keys = np.concatenate([*(k for k, _ in parts), np.zeros(0, np.uint64)])  # ascending, as the buckets are ranges
    return keys, np.concatenate([*(h for _, h in parts), np.zeros(0, np.uint8)]).astype(bool)


def covered(shard: Shard, told: pa.Table, buckets: int) -> np.ndarray:
    """Which bytes of the shard's texts lie in a window that an earlier document has."""
    change = np.zeros(len(shard.data) + 1, np.int32)
    replies = _told(told, FIRSTS)
    if replies:
        runs, lengths, firsts = (np.concatenate(x).astype(np.int64) for x in zip(*replies, strict=True))
        _, found = shard.phrases(*_shared(told), buckets)
        starts = np.cumsum(runs) - runs
        offset = np.cumsum(lengths) - lengths
        offset -= np.repeat(offset[starts], runs)
        n = runs[found["entry"]]
        at = _expand(starts[found["entry"]], n)
        later = firsts[at] < np.repeat(shard.ids[found["document"]], n)
        base = np.cumsum(np.maximum(shard.sizes, 0)) - np.maximum(shard.sizes, 0)
        begin = (np.repeat(base[found["document"]] + found["start"], n) + offset[at])[later]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + lengths[at][later] - 1 + shard.length, -1)
    return np.cumsum(change[:-1]) > 0


def without_repeats(docs: DataFrame, length: int = LENGTH, digests: bool = False, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns of ``docs`` but text, n_bytes, n_removed, n_spans, spans (begin, end) and kept, the remaining bytes.

    Each byte goes that is covered by a string of ``length`` bytes that starts in a document of smaller doc_id too. One
    row for each row of ``docs``; with ``digests`` kept_sha256 takes the place of spans and kept. Documents without an
    id, without a text or with fewer bytes neither lose anything nor count as earlier ones; rows that repeat an id count
    as one document. A null or empty text has no bytes; an empty table gives no rows. ``kept`` is binary, as a cut may
    fall inside a character. Columns of ``docs`` with the names of the new ones are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    made = ["n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"]
    docs = docs.drop(*made).withColumn("doc_id", F.col("doc_id").cast("long"))
    packed = pack(docs, shard_bytes)
    buckets = bucket_count(packed, BUCKET_BYTES)

    def triggers(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, told = Shard(row, length).triggers()
                edges = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edges))
                yield from _blob_rows([row["shard"]] * len(full), KEYS, full.tolist(), [squeeze(keys[edges[b] : edges[b + 1]], told[edges[b] : edges[b + 1]]) for b in full.tolist()]).to_batches()

    sent = packed.mapInArrow(triggers, BLOBS)
    keys = cut(sent.groupBy("bucket").applyInArrow(lambda table: in_several(table, hot), BLOBS))
    del sent
    reclaim(spark)

    def phrases(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            made, _ = Shard(row, length).phrases(*_shared(right), buckets)
            first, n = _runs(_changes(made["bucket"]))
            for lo, hi in zip(first.tolist(), (first + n).tolist(), strict=True):
                texts = made["text"][lo:hi]
                count = np.array([len(t) for t in texts], np.int64) - length + 1
                rows.append((row["shard"], int(made["bucket"][lo]), squeeze(made["key"][lo:hi], made["least"][lo:hi], count.astype(np.uint32), np.frombuffer(b"".join(texts), np.uint8))))
        return _blob_rows([r[0] for r in rows], FIRSTS, [r[1] for r in rows], [r[2] for r in rows])

    entries = packed.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(phrases, BLOBS)
    firsts = cut(entries.groupBy("bucket").applyInArrow(lambda table: settle(table, length), BLOBS))
    del entries
    reclaim(spark)
    others = [c for c in docs.columns if c != "text"]
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            shard = Shard(row, length)
            gone, at = covered(shard, right, buckets), 0
            n_bytes, n_removed, n_spans, spans, kept = [], [], [], [], []
            for raw in shard.raws:
                own = gone[at : at + len(raw)]
                at += len(raw)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]))).tolist() if own.any() else []
                left_over = b"".join(raw[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(raw)], strict=True)) if edges else raw
                n_bytes.append(len(raw)), n_removed.append(len(raw) - len(left_over)), n_spans.append(len(edges) // 2)
                kept.append(hashlib.sha256(left_over).hexdigest() if digests else left_over)
                spans.append(None if digests else [{"begin": b, "end": e} for b, e in zip(edges[::2], edges[1::2], strict=True)])
            columns = {c: shard.rest.column(c) for c in others} | {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64())}
            columns |= {"kept_sha256": pa.array(kept, pa.string())} if digests else {"spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())}
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    beside = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    last = "kept_sha256 string" if digests else "spans array<struct<begin:bigint,end:bigint>>, kept binary"
    return packed.groupBy("shard").cogroup(keys.unionByName(firsts).groupBy("shard")).applyInArrow(removed, f"{beside}n_bytes bigint, n_removed bigint, n_spans bigint, {last}")


def op5(spark, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


ORACLE = f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents), n AS (SELECT doc_id, raw, octet_length(raw) AS n FROM d),
w AS (SELECT doc_id, i, raw[i + 1 : i + {LENGTH}] AS x FROM (SELECT doc_id, raw, unnest(range(0, n - {LENGTH - 1})) AS i FROM n)),
f AS (SELECT x, min(doc_id) AS f FROM w GROUP BY x), r AS (SELECT doc_id, i FROM w JOIN f USING (x) WHERE f < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
s AS (SELECT doc_id, min(i) AS b, max(i) + {LENGTH} AS e FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, b, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS a FROM (SELECT doc_id, b, e FROM s UNION ALL SELECT doc_id, n, n FROM n)),
t AS (SELECT doc_id, string_agg(hex(raw[a + 1 : b]), '' ORDER BY b, a) AS kept FROM k JOIN n USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM n JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)"""
