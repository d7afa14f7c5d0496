"""Benchmark decontamination with an FM-index per training shard.

The benchmark is the stated query set: its windows of WINDOW words (a shorter item is one window) go to the executors,
in blocks of bounded size, ROUND_BLOCKS of them for one pass over the documents; what a round finds stays on the row. Each
shard of documents, a run of rows with at most SHARD_WORDS words, becomes one integer text over the block's vocabulary. A
word outside that vocabulary can be in no occurrence, so only runs of known words that are long enough are indexed, each
closed by its own separator. The index is the Burrows-Wheeler transform of that text in a wavelet matrix; all windows are searched backwards together, occurrences are located by walking to sampled suffix
positions (every SAMPLE-th and each run's start, so that no walk meets a separator), and overlapping ones merge to spans.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbank.llm.shared import read, ship

WINDOW = 8
SHARD_WORDS = 1_500_000
SAMPLE = 8
#: Text of the benchmark in one block, which a worker holds at a time, and blocks that go to the executors together.
BLOCK_BYTES, ROUND_BLOCKS = 4_000_000, 16

#: Bytes of words stay, A-Z in lower case; all others become blanks. Bytes from 0x80 are parts of letters beyond ASCII.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


class Windows:
    """The distinct windows of some items as rows of word codes, and the distinct items of each; an item may have several rows."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items})
        place = {i: n for n, i in enumerate(self.items)}
        for item, text in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(len(codes) - window, 0) + 1 if codes else 0):
                rows.setdefault(tuple(codes[i : i + window]), set()).add(place[item])
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.codes = np.zeros((len(rows), window), np.int32)  # aligned to the right, for the search from the end
        for k, r in enumerate(rows):
            self.codes[k, window - len(r) :] = r
        self.item_starts = np.cumsum([0] + [len(x) for x in rows.values()])
        self.item_of = np.array([i for x in rows.values() for i in sorted(x)], np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of ``text`` by prefix doubling; the end of the text sorts before every symbol."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank, step = _ranks(order, text[order]), 1
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        rank, step = _ranks(order, key[order]), 2 * step
    return order


def _ranks(order: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(order) else 0
    return rank


class WaveletMatrix:
    """Ranks of any symbol in a sequence of codes: one row of cumulated bits for each bit of a code."""

    def __init__(self, codes: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (codes >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(codes) - int(bit.sum()))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])
        self.first = self._walk(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            set_before = ones[at].astype(np.int64)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + set_before, at - set_before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbol, at) - self.first[symbol]


class FMIndex:
    """Over runs of codes from 1 up, laid end to end; ``starts`` are the runs' places."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, size: int):
        is_start = np.zeros(len(codes) + 1, bool)
        is_start[starts] = True
        runs = len(starts)
        place = np.arange(len(codes)) + np.cumsum(is_start[:-1]) - 1  # in the text with a separator after each run
        text = np.full(len(codes) + runs, -1, np.int64)
        text[place] = codes + runs - 1  # separators 0 .. runs - 1, each its own, sort before all words
        ends = np.flatnonzero(text < 0)
        text[ends] = np.arange(runs)
        order = suffix_array(text)
        symbols = np.zeros(len(text) + 1, np.int64)
        symbols[:-1][place] = codes  # code 0: any separator
        self.bwt = symbols[order - 1]  # before the first symbol: the 0 at the end
        self.ranks = WaveletMatrix(self.bwt, size + 1)
        self.before = runs + np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=size + 1)[1:])])  # rows before code c: before[c - 1]
        source = np.full(len(text), -1, np.int64)
        source[place] = np.arange(len(codes))
        origin = source[order]
        sampled = (origin >= 0) & ((origin % SAMPLE == 0) | is_start[np.maximum(origin, 0)])
        self.sample = np.where(sampled, origin, -1)

    def search(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each window."""
        width = windows.codes.shape[1]
        low, high = np.zeros(len(windows.codes), np.int64), np.full(len(windows.codes), len(self.bwt), np.int64)
        for step in range(width):
            live = np.flatnonzero((windows.lengths > step) & (low < high))
            symbol = windows.codes[live, width - 1 - step].astype(np.int64)
            first = self.before[symbol - 1]
            low[live] = first + self.ranks.rank(symbol, low[live])
            high[live] = first + self.ranks.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the codes at which the rows' suffixes begin."""
        out, steps = self.sample[rows], np.zeros(len(rows), np.int64)
        left, at = np.flatnonzero(out < 0), rows.copy()
        while len(left):
            symbol = self.bwt[at[left]]
            at[left] = self.before[symbol - 1] + self.ranks.rank(symbol, at[left])
            steps[left] += 1
            out[left] = self.sample[at[left]]
            left = left[out[left] < 0]
        return out + steps


def occurrences(codes: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every occurrence in ``codes``, where 0 stands for words that no window has."""
    none = np.zeros(0, np.int64)
    if not len(windows.codes):
        return none, none
    known = np.concatenate([[0], (codes > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(known))
    begins, ends = edge[::2], edge[1::2]
    enough = ends - begins >= windows.lengths.min()
    begins, ends = begins[enough], ends[enough]
    if not len(begins):
        return none, none
    sizes = ends - begins
    starts = np.cumsum(sizes) - sizes
    origin = np.arange(sizes.sum()) + np.repeat(begins - starts, sizes)
    index = FMIndex(codes[origin], starts, len(windows.vocabulary))
    low, high = index.search(windows)
    found = high - low
    window = np.repeat(np.arange(len(found)), found)
    rows = np.arange(len(window)) + np.repeat(low - (np.cumsum(found) - found), found)
    return window, origin[index.locate(rows)]


def search_shard(word_lists: list[list[bytes]], windows: Windows) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """For each document its merged spans of hit words and the items found, sorted as strings."""
    counts = np.array([len(w) for w in word_lists], np.int64)
    get = windows.vocabulary.get
    starts = np.cumsum(counts + 1) - (counts + 1)  # one unknown word after each document
    codes = np.zeros(int((counts + 1).sum()), np.int64)
    for s, words in zip(starts.tolist(), word_lists, strict=True):
        if words:
            codes[s : s + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
    window, at = occurrences(codes, windows)
    spans: list[list[tuple[int, int]]] = [[] for _ in word_lists]
    items: list[list[str]] = [[] for _ in word_lists]
    if len(window):
        change = np.bincount(at, minlength=len(codes) + 1) - np.bincount(at + windows.lengths[window], minlength=len(codes) + 1)
        covered = np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(covered))
        for b, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            d = int(np.searchsorted(starts, b, "right")) - 1
            spans[d].append((b - int(starts[d]), e - int(starts[d])))
        doc = np.searchsorted(starts, at, "right") - 1
        pairs = np.unique(doc * len(windows.codes) + window)
        doc, window = pairs // len(windows.codes), pairs % len(windows.codes)
        n = np.diff(windows.item_starts)[window]
        index = np.arange(n.sum()) + np.repeat(windows.item_starts[window] - (np.cumsum(n) - n), n)
        for key in np.unique(np.repeat(doc, n) * len(windows.items) + windows.item_of[index]).tolist():
            items[key // len(windows.items)].append(windows.items[key % len(windows.items)])
    return spans, [sorted(x) for x in items]


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for b, e in spans:
        out.append(raw[at : places[b][0]])
        at = places[e - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[int, Iterator[Windows]]:
    """How many blocks of about ``block_bytes`` of text the benchmark makes, one if it is empty, and each one's windows."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / block_bytes))
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    parts = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n))
    return n, (Windows([(r[0], r[1]) for r in part.collect()], window) for part in parts)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that meet made one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


#: Columns that carry what earlier rounds found, on the row itself.
ITEMS, SPANS, N_WORDS, N_HIT = "_decontam_items", "_decontam_spans", "_decontam_n_words", "_decontam_n_hit"
SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _round(docs: DataFrame, blocks: Iterator[Windows], last: bool, clean: bool) -> DataFrame:
    """``docs`` after a search for all windows of some blocks, ITEMS and SPANS united with those of earlier rounds.

    The last round adds n_words, n_hit, items and spans, prefixed as ITEMS, and drops text, or with ``clean`` cuts the spans.
    """
    spark = docs.sparkSession
    ship(spark)
    held = [spark.sparkContext.broadcast(pickle.dumps(w)) for w in blocks]  # the driver has one at a time
    others = [c for c in docs.columns if c not in ("text", ITEMS, SPANS)]
    first, with_text = ITEMS not in docs.columns, clean or not last

    def results(rows: list[pa.RecordBatch], texts: list, words: list, load) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        if first:
            items, spans = [set() for _ in words], [[] for _ in words]
        else:
            items = [set(x) for x in table.column(ITEMS).to_pylist()]
            spans = [[(x["begin"], x["end"]) for x in s] for s in table.column(SPANS).to_pylist()]
        for k in range(len(held)):
            found, ids = search_shard(words, load(k))
            for d in range(len(words)):
                if found[d]:
                    spans[d] = _united(spans[d] + found[d])
                    items[d].update(ids[d])
        columns = {c: table.column(c) for c in others}
        if with_text:
            columns["text"] = pa.array([without_spans(t, s) if s and last else t for t, s in zip(texts, spans, strict=True)], pa.string())
        if last:
            columns[N_WORDS] = pa.array([len(w) for w in words], pa.int64())
            columns[N_HIT] = pa.array([sum(e - b for b, e in s) for s in spans], pa.int64())
        columns[ITEMS] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
        columns[SPANS] = pa.array([[{"begin": b, "end": e} for b, e in s] for s in spans], SPAN)
        return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns.values()], names=list(columns))

    def run(batches):
        only = pickle.loads(held[0].value) if len(held) == 1 else None
        load = lambda k: only or pickle.loads(held[k].value)  # noqa: E731  of several blocks a worker has one at a time
        rows, texts, words, total = [], [], [], 0
        for batch in batches:
            column, lo, beside = batch.column("text").to_pylist(), 0, batch.select([c for c in batch.schema.names if c != "text"])
            for i, text in enumerate(column):
                found = words_of(text)
                words.append(found)
                texts.append(text if with_text else None)
                total += len(found) + 1
                if total >= SHARD_WORDS or i + 1 == len(column):
                    rows.append(beside.slice(lo, i + 1 - lo))
                    lo = i + 1
                if total >= SHARD_WORDS:
                    yield results(rows, texts, words, load)
                    rows, texts, words, total = [], [], [], 0
        if words:
            yield results(rows, texts, words, load)

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in others) + "text string, " * with_text + f"{N_WORDS} bigint, {N_HIT} bigint, " * last
    return docs.mapInArrow(run, f"{kept}{ITEMS} array<string>, {SPANS} array<struct<begin:bigint,end:bigint>>")


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, round_blocks: int, clean: bool) -> DataFrame:
    """``docs`` after all rounds; a round takes ``round_blocks`` blocks, and one is the rule."""
    n, blocks = _blocks(benchmark, window, block_bytes)
    for done in range(0, n, round_blocks):
        docs = _round(docs, islice(blocks, round_blocks), done + round_blocks >= n, clean)
    return docs


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings) and spans (merged, of word places) for each document.

    Null and empty texts have no words and no hits; null items or item ids and items without words match nothing; items
    are told apart by item_id, whatever their rows; an empty benchmark gives no hits. Every row gives one row, repeated
    ones and those without a doc_id too, at every size of the benchmark. Extra columns are not read.
    """
    found = _searched(docs.select("doc_id", "text"), benchmark, window, block_bytes, round_blocks, False)
    return found.select("doc_id", F.col(N_WORDS).alias("n_words"), F.col(N_HIT).alias("n_hit"), F.col(ITEMS).alias("items"), F.col(SPANS).alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """``docs`` without the contaminated documents (``min_items`` items or more) and, in the others, without hit words.

    All columns of ``docs`` stay; texts without a hit come back unchanged. See ``scan`` for odd inputs.
    """
    return _searched(docs, benchmark, window, block_bytes, round_blocks, True).where(F.size(ITEMS) < min_items).select(*docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def hits_sql(documents: str = "documents", benchmark: str = "benchmark", window: int = WINDOW) -> str:
    """DuckDB CTEs ending in d_found(doc_id, n_words, n_hit, items)."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
d_docs AS (SELECT doc_id, coalesce({words}, []) AS words FROM {documents}),
d_items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS words FROM {benchmark} WHERE text IS NOT NULL),
d_windows AS (SELECT DISTINCT item_id, words[i : i + {window - 1}] AS w FROM
  (SELECT item_id, words, unnest(range(1, greatest(len(words) - {window - 1}, 1) + 1)) AS i FROM d_items WHERE len(words) > 0)),
d_places AS (SELECT doc_id, i, n, words[i : i + n - 1] AS w FROM
  (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d_docs, (SELECT DISTINCT len(w) AS n FROM d_windows) WHERE len(words) >= n)),
d_hits AS (SELECT doc_id, i, n, item_id FROM d_places JOIN d_windows USING (w)),
d_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM d_hits)) GROUP BY doc_id),
d_ids AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM d_hits GROUP BY doc_id),
d_found AS (SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(items, []) AS items
  FROM d_docs LEFT JOIN d_words USING (doc_id) LEFT JOIN d_ids USING (doc_id))"""


ORACLE = f"""WITH {hits_sql()} SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_hit AS BIGINT) AS n_hit, CAST(len(items) AS BIGINT) AS n_items,
sha256(array_to_string(items, ',')) AS items_sha256, len(items) >= 2 AS contaminated FROM d_found"""
