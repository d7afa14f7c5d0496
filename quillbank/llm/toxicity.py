"""Toxicity by fuzzy lexicon matches and their surroundings.

The lexicon has whole words and stems (beginnings of words). It is learnt from a bounded sample of labelled training
rows: an entry has to occur after several different words, nearly always in toxic rows, so that the words of one copied
text do not qualify. Each entry gets the largest edit distance at which what it matches in that sample is still nearly
always toxic. Matching runs each entry's Levenshtein automaton over a trie of all entries at once; the states of that
intersection are determinised as texts need them. Matches inside quotation marks or beside words of reporting count as
quoted. A logistic regression over a text's match counts, fitted on the same sample, gives the score.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbank.llm.shared import cut, fold_remainder, read, ship

#: Labelled training rows that the lexicon and the weights are learnt from, about, at most.
SAMPLE = 20_000
#: Different preceding words that an entry needs in toxic rows, and the share of toxic ones among all.
CONTEXTS, PRECISION = 5, 0.9
STEM_LENGTHS = (4, 5, 6, 7)
#: Entries that hold without training rows too. Common English insults.
SEEDS = ("idiot", "imbecile", "moron", "scumbag", "dumbass", "asshole", "bastard", "bitch", "retard", "loser", "pathetic", "worthless", "stupid", "disgusting")
#: Marks that open or close a quotation, words that report one, and words that address someone.
MARKS = "\"'“”„‘’«»‹›`"
REPORTS = frozenset("said says say saying called calls wrote writes quote quoted quoting word words term terms insult insults slur slurs dit disait écrit mot terme sagte sagt schrieb wort dijo dice escribió palabra término".split())
ADDRESS = frozenset("you your you're youre u ur du dich dir euch tu te toi vous vos usted ustedes ti".split())
WINDOW = 4
NEAR = 0.8
EDGE = " \t\n.,;:!?()[]{}<>|#*$%&=+/\\~^_-…—–" + MARKS
FEATURES = 5


def radius(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


class FuzzyLexicon:
    """Entries (text, whether a stem, edit distance); ``match`` gives the least distance of a word to any, or None."""

    STATES = 100_000

    def __init__(self, entries: list[tuple[str, bool, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.word_radius, self.stem_radius, self.most = [-1], [-1], [-1]  # by node; most: in the node's subtree
        self.node_of: dict[tuple[str, bool], int] = {}
        for text, stem, limit in entries:
            path = [0]
            for c in text:
                path.append(self._child(path[-1], c))
            self.node_of[text, stem] = path[-1]
            (self.stem_radius if stem else self.word_radius)[path[-1]] = max(limit, (self.stem_radius if stem else self.word_radius)[path[-1]])
            for node in path:
                self.most[node] = max(self.most[node], limit)
        self._reset()

    def _child(self, node: int, c: str) -> int:
        if c not in self.children[node]:
            self.children[node][c] = len(self.children)
            self.children.append({})
            for x in (self.word_radius, self.stem_radius, self.most):
                x.append(-1)
        return self.children[node][c]

    def _reset(self) -> None:
        self.moves: dict[tuple[int, str], int] = {}
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.ends: list[int | None] = []
        self.over = self._state(set(), None)
        self.start = self._state({(0, 0)}, None)

    def _state(self, places: set[tuple[int, int]], met: int | None) -> int:
        """The number of the state at these (node, edits), closed under dropped letters; met: least distance of a stem so far."""
        todo, closed = list(places), set()
        while todo:
            node, edits = place = todo.pop()
            if place in closed or edits > self.most[node]:
                continue
            closed.add(place)
            if edits <= self.stem_radius[node] and (met is None or edits < met):
                met = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        key = frozenset(closed | {("met", met)})
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            ends = [e for n, e in closed if e <= self.word_radius[n]] + ([met] if met is not None else [])
            self.ends.append(min(ends, default=None))
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        places, met = set(), None
        for node, edits in self.sets[state]:
            if node == "met":
                met = edits
                continue
            if c in self.children[node]:
                places.add((self.children[node][c], edits))
            places.add((node, edits + 1))
            places.update((child, edits + 1) for child in self.children[node].values())
        self.moves[state, c] = to = self._state(places, met)
        return to

    def match(self, word: str) -> int | None:
        if len(self.sets) > self.STATES:
            self._reset()
        state, moves = self.start, self.moves
        for c in word:
            state = moves[state, c] if (state, c) in moves else self._move(state, c)
            if state == self.over:  # no entry can be met any more, and no stem was
                return None
        return self.ends[state]

    def distances(self, word: str) -> dict[tuple[int, bool], int]:
        """The least distance to each entry that matches, by the entry's node and whether it is a stem."""
        found: dict[tuple[int, bool], int] = {}
        places = {0: 0}
        for k in range(len(word) + 1):
            todo, closed = sorted(places.items(), key=lambda x: x[1]), {}
            while todo:  # dropped letters: a child costs one edit more, so the queue stays in order
                node, edits = todo.pop(0)
                if edits > self.most[node] or closed.get(node, edits + 1) <= edits:
                    continue
                closed[node] = edits
                todo += [(child, edits + 1) for child in self.children[node].values()]
            for node, edits in closed.items():
                if edits <= self.stem_radius[node]:
                    found[node, True] = min(edits, found.get((node, True), edits))
            if k == len(word):
                break
            places = {}
            for node, edits in closed.items():
                for c, child in self.children[node].items():
                    cost = edits + (c != word[k])
                    places[child] = min(cost, places.get(child, cost))
                places[node] = min(edits + 1, places.get(node, edits + 1))
        found |= {(node, False): edits for node, edits in closed.items() if edits <= self.word_radius[node]}
        return found


def core(token: str) -> str:
    return token.strip(EDGE)


class Matcher:
    """Finds a text's matches and turns them into features."""

    CACHE = 250_000

    def __init__(self, entries: list[tuple[str, bool, int]]):
        self.lexicon, self.cache = FuzzyLexicon(entries), {}

    def _found(self, token: str) -> int | None:
        if len(self.cache) > self.CACHE:
            self.cache.clear()
        found = self.cache[token] = self.lexicon.match(core(token))
        return found

    def features(self, text: str | None) -> list[float]:
        """Plain matches (any, how many, their share of the words), quoted ones, and those beside an address.

        A near match counts NEAR of an exact one: its entry's distance has held in the training sample.
        """
        tokens = text.lower().split() if text else []
        cache, exact, near, quoted, addressed = self.cache, 0, 0, 0, 0
        for i, token in enumerate(tokens):
            found = cache[token] if token in cache else self._found(token)
            if found is None:
                continue
            before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
            opened = token[0] in MARKS or any(t[0] in MARKS and t[-1] not in MARKS for t in before)
            closed = token.rstrip(".,;:!?")[-1:] in MARKS or any(t.rstrip(".,;:!?")[-1:] in MARKS for t in after)
            around = [core(t) for t in before + after]
            if opened and closed or any(t in REPORTS for t in around):
                quoted += 1
            else:
                exact += found == 0
                near += found > 0
                addressed += any(t in ADDRESS for t in around)
        plain = exact + NEAR * near
        return [min(1.0, plain), float(np.log1p(plain)), 100.0 * plain / max(len(tokens), 20), float(np.log1p(quoted)), float(np.log1p(addressed))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method; the intercept has next to no penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample_rows(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of about ``sample`` labelled training rows at most, picked by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    some = known.where((F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) * n <= sample)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic")  # the sample bounds that side


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool, int]]:
    """Entries (text, stem, distance) from rows of text and toxic (0 or 1)."""
    strip = "".join(sorted(set(EDGE)))
    words = F.filter(F.transform(F.split(F.lower("text"), r"\s+"), lambda t: F.btrim(t, F.lit(strip))), lambda t: F.length(t) >= 4)
    listed = sample.where("text IS NOT NULL").select("toxic", words.alias("w"))
    each = listed.select("toxic", F.posexplode("w").alias("i", "word"), "w").select("toxic", "word", F.expr("xxhash64(get(w, i - 1))").alias("p")).distinct()
    by_word = cut(each.groupBy("word").agg(F.count(F.when(F.col("toxic") > 0, 1)).alias("t"), F.count(F.when(F.col("toxic") <= 0, 1)).alias("n")))
    good = (F.col("t") >= CONTEXTS) & (F.col("t") >= PRECISION * (F.col("t") + F.col("n")))
    stems = by_word.select(F.explode(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEM_LENGTHS])).alias("stem"), "t", "n").where("stem IS NOT NULL")
    stems = stems.groupBy("stem").agg(F.count(F.when(F.col("t") > 0, 1)).alias("words"), F.sum("t").alias("t"), F.sum("n").alias("n")).where(good & (F.col("words") >= 3))
    top = lambda df, c: [r[c] for r in df.orderBy(F.desc("t"), c).collect()]  # noqa: E731  what the sample's words bound
    chosen, kept_stems = [], set()
    for stem in sorted(top(stems, "stem"), key=len):
        if not any(stem[:k] in kept_stems for k in STEM_LENGTHS):
            kept_stems.add(stem)
            chosen.append((stem, True))
    for word in top(by_word.where(good), "word"):
        if not any(word[:k] in kept_stems for k in STEM_LENGTHS if k < len(word)):
            chosen.append((word, False))
    chosen += [(s, False) for s in SEEDS if (s, False) not in chosen]
    return _limits(by_word, chosen)


def _limits(by_word: DataFrame, chosen: list[tuple[str, bool]]) -> list[tuple[str, bool, int]]:
    """With the largest distance, up to ``radius``, at which the sample's matched words are nearly always toxic."""
    ship(by_word.sparkSession)

    def run(batches):
        near = FuzzyLexicon([(text, stem, radius(len(text))) for text, stem in chosen])
        entry_of = {(node, stem): (text, stem) for (text, stem), node in near.node_of.items() if radius(len(text))}
        counts: dict[tuple[str, bool, int], list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for word, t, n in zip(*(batch.column(c).to_pylist() for c in ("word", "t", "n")), strict=True):
                if near.match(word):  # few words come near any entry without being one
                    for place, edits in near.distances(word).items():
                        if place in entry_of:
                            told = counts[*entry_of[place], max(1, edits)]
                            told[0] += t
                            told[1] += n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[x][0] for x in keys], pa.int64()), pa.array([counts[x][1] for x in keys], pa.int64())], names=["text", "stem", "d", "t", "n"])

    rows = by_word.mapInArrow(run, "text string, stem boolean, d int, t bigint, n bigint").groupBy("text", "stem", "d").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()  # at most two rows an entry
    counts = {(r["text"], r["stem"], r["d"]): (r["t"], r["n"]) for r in rows}
    out = []
    for text, stem in chosen:
        limit = 0
        for d in range(1, radius(len(text)) + 1):
            t, n = counts.get((text, stem, d), (0, 0))
            if n > (1 - PRECISION) * (t + n):
                break
            limit = d
        out.append((text, stem, limit))
    return out


@lru_cache(maxsize=2)
def _matcher(pickled: bytes) -> Matcher:
    """One matcher for a worker process, whatever the number of its tasks."""
    return Matcher(pickle.loads(pickled))


def _featured(docs: DataFrame, entries: list[tuple[str, bool, int]], weights: np.ndarray | None) -> DataFrame:
    """The columns of ``docs`` but text, with x, the features, or with ``weights`` the score."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(entries))
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        matcher = _matcher(held.value)
        for batch in batches:
            x = np.array([matcher.features(t.as_py()) for t in batch.column("text")]).reshape(-1, FEATURES)
            made = pa.array(x.tolist(), pa.list_(pa.float64())) if weights is None else pa.array(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [made], names=[*others, "x" if weights is None else "score"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, kept + ("x array<double>" if weights is None else "score double"))


def score(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and toxic (0 or 1; null: unknown; of several the largest counts), ``train`` is a condition on
    doc_id. Null and empty texts get the score of a text without matches. Without labelled training rows the seeds are
    the lexicon and fixed weights apply. Whole texts are read, however long; repeated rows give repeated results; other
    columns are not read.
    """
    known = cut(sample_rows(docs, labels, train, sample))
    entries = learn_lexicon(known)
    rows = _featured(known, entries, None).select("toxic", "x").collect()  # the sample bounds it
    x, y = np.array([r["x"] for r in rows]).reshape(-1, FEATURES), np.array([float(r["toxic"] > 0) for r in rows])
    weights = fit_logistic(x, y) if 0 < y.sum() < len(y) else np.array([2.0, 1.0, 0.5, -1.0, 1.0, -3.0])
    return _featured(docs.select("doc_id", "text"), entries, weights)


def op7(spark, sf_dir: str) -> DataFrame:
    fold = fold_remainder(F.col("doc_id"), 4)
    out = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold != 2)
    return out.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
