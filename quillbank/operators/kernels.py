"""Numeric kernels that are sequential by nature, as grouped Arrow functions over inputs of stated size."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbank.functions import numbers as N
from quillbank.session import ship

#: Rows of a group that an eigenvalue problem or a discriminator is given at most, by a hash of the id (the operator's own sample).
VENDI_ROWS, DISCRIMINATOR_ROWS = 400, 1200


class Lloyd:
    """One k-means model while it is fitted: unit vectors by greatest dot product, or points by least squared distance."""

    def __init__(self, centroids: np.ndarray, cosine: bool, seed: int):
        self.centroids, self.cosine, self.done, self.before = centroids, cosine, False, None
        self.random = np.random.default_rng(seed)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best centroid of each row, of equals (to ten digits) the first, and how good it is (higher is better)."""
        gain = x @ self.centroids.T if self.cosine else -((x[:, None, :] - self.centroids[None]) ** 2).sum(axis=2)
        at = np.round(gain, 10).argmax(axis=1)
        return at, gain[np.arange(len(x)), at]

    def update(self, sums: np.ndarray, counts: np.ndarray, spare: np.ndarray) -> None:
        """Move to the means; a centroid without rows takes one of the ``spare`` rows."""
        means = sums / np.maximum(counts, 1)[:, None]
        if self.cosine:
            length = np.linalg.norm(means, axis=1, keepdims=True)
            means = means / np.where(length > 0, length, 1)
        for c in np.flatnonzero(counts == 0):
            means[c] = spare[int(self.random.integers(len(spare)))]
        self.done = self.before is not None and np.array_equal(np.round(means, 12), np.round(self.centroids, 12))
        self.before, self.centroids = self.centroids, means


#: Rows from which the first centroids of a model are drawn, by a hash of the id.
SEED_ROWS = 2_000


def first_centroids(x: np.ndarray, k: int, cosine: bool, seed: int) -> np.ndarray:
    """k-means++: each next one is drawn with a weight that grows with the distance to those drawn already."""
    random = np.random.default_rng(seed)
    chosen = [int(random.integers(len(x)))]
    while len(chosen) < min(k, len(x)):
        c = x[chosen]
        far = 1 - (x @ c.T).max(axis=1) if cosine else ((x[:, None, :] - c[None]) ** 2).sum(axis=2).min(axis=1)
        weight = np.maximum(1e-9, far)
        chosen.append(int(np.searchsorted(np.cumsum(weight), random.random() * weight.sum())))
    return x[np.minimum(chosen, len(x) - 1)]


def fit_kmeans(vectors: DataFrame, asked: list[tuple[int, int]], cosine: bool = True, restarts: int = 3, max_iter: int = 60) -> list[tuple[np.ndarray, float]]:
    """Centroids and total gain for each (k, seed) of ``asked``: the best of ``restarts`` starts.

    All models and all their starts are fitted together: an iteration is one pass over the vectors, in which each
    partition adds up its rows by model and centroid; the partitions' sums are added up by tasks too, one for each model, so
    what comes to the driver is as large as the models, whatever the number of partitions.
    """
    ship(vectors.sparkSession)
    rows = vectors.select("id", (N.normalize(N.as_doubles(F.col("v"))) if cosine else N.as_doubles(F.col("v"))).alias("v")).persist()
    some = np.array([r["v"] for r in sampled(rows, [], SEED_ROWS).orderBy("id").collect()])
    models = [[Lloyd(first_centroids(some, k, cosine, seed + 101 * r), cosine, seed + 101 * r) for r in range(restarts)] for k, seed in asked]
    flat = [m for group in models for m in group]

    def totals(active: list[Lloyd]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        width = some.shape[1]

        def run(batches):
            held = [(np.zeros((len(m.centroids), width)), np.zeros(len(m.centroids), np.int64), [0.0]) for m in active]
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    for m, (sums, counts, gain) in zip(active, held, strict=True):
                        at, good = m.nearest(x)
                        np.add.at(sums, at, x)
                        counts += np.bincount(at, minlength=len(counts))
                        gain[0] += float(good.sum())
            for k, (sums, counts, gain) in enumerate(held):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array(gain)], names=["model", "sums", "counts", "gain"])

        def add(table: pa.Table) -> pa.Table:
            m = active[table.column("model")[0].as_py()]
            sums, counts, gain = np.zeros((len(m.centroids), width)), np.zeros(len(m.centroids), np.int64), 0.0
            for r in table.sort_by("sums").to_pylist():  # one order of addition
                sums += np.frombuffer(r["sums"]).reshape(sums.shape)
                counts += np.frombuffer(r["counts"], np.int64)
                gain += r["gain"]
            return pa.table({"model": table.column("model")[:1], "sums": [sums.tobytes()], "counts": [counts.tobytes()], "gain": [gain]}, schema=table.schema)

        parts = rows.select("v").mapInArrow(run, "model int, sums binary, counts binary, gain double")
        out: list = [None] * len(active)
        for r in parts.groupBy("model").applyInArrow(add, "model int, sums binary, counts binary, gain double").collect():
            sums = np.frombuffer(r["sums"])
            out[r["model"]] = sums.reshape(-1, width), np.frombuffer(r["counts"], np.int64), r["gain"]
        return out

    for _ in range(max_iter):
        active = [m for m in flat if not m.done]
        if not active:
            break
        for m, (sums, counts, _) in zip(active, totals(active), strict=True):
            m.update(sums, counts, some)
    gains = iter([g for _, _, g in totals(flat)])
    best = [max(((m, next(gains)) for m in group), key=lambda x: round(x[1], 9)) for group in models]
    rows.unpersist()
    return [(m.centroids, g) for m, g in best]


def assigned(vectors: DataFrame, centroids: np.ndarray, cosine: bool = True) -> DataFrame:
    """id and cid, the nearest of ``centroids`` (a model of bounded size)."""
    ship(vectors.sparkSession)
    model = Lloyd(centroids, cosine, 0)

    def run(batches):
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.nearest(x)[0] if batch.num_rows else np.zeros(0, np.int64))], names=["id", "cid"])

    return vectors.select("id", (N.normalize(N.as_doubles(F.col("v"))) if cosine else N.as_doubles(F.col("v"))).alias("v")).mapInArrow(run, "id bigint, cid bigint")


def kmeans(vectors: DataFrame, k: int, seed: int = 7, cosine: bool = True, restarts: int = 3) -> DataFrame:
    """id and cid by k-means over unit vectors (cosine) or as they are."""
    return assigned(vectors, fit_kmeans(vectors, [(k, seed)], cosine, restarts)[0][0], cosine)


def principal(vectors: DataFrame, k: int) -> DataFrame:
    rows = vectors.select("id", array_to_vector(N.as_doubles(F.col("v"))).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="p").fit(rows).transform(rows).select("id", vector_to_array("p").alias("p"))


def sampled(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of each key, those of least hash of the id; a filter on the hash comes first, so no key is sorted whole."""
    size = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    near = df.join(F.broadcast(size), keys) if keys else df.crossJoin(F.broadcast(size))  # one row
    near = near.withColumn("_h", F.xxhash64("id")).where((F.col("_h") / F.lit(2.0**64) + 0.5) * F.col("_n") <= 3.0 * rows)
    return near.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "id"))).where(F.col("_p") <= rows).drop("_n", "_h", "_p")


def vendi(vectors: DataFrame, key: str) -> DataFrame:
    """The exponential of the entropy of the cosine Gram matrix's eigenvalues over n, for each key."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(length > 0, length, 1)
        e = np.clip(np.linalg.eigvalsh(x @ x.T / len(x)), 0, None)
        e = e[e > 1e-12]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [len(x)], "vendi": [float(np.exp(-(e * np.log(e)).sum()))]})

    return sampled(vectors, [key], VENDI_ROWS).groupBy(key).applyInPandas(one, f"{key} bigint, n bigint, vendi double")


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.3, ridge: float = 1e-3):
    """Full-batch gradient descent on z-scored features; returns a function that scores rows."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1)
    z, w, b = (x - mean) / sd, np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - rate * (z.T @ gap / len(y) + ridge * w), b - rate * gap.mean()
    return lambda rows: 1 / (1 + np.exp(-(((rows - mean) / sd) @ w + b)))


def rank_auc(scores: np.ndarray, labels: np.ndarray) -> float:
    order = np.argsort(scores, kind="stable")
    pos, n = labels.sum(), len(labels)
    return 0.5 if pos in (0, n) else float(((np.flatnonzero(labels[order]) + 1).sum() - pos * (pos + 1) / 2) / (pos * (n - pos)))


def folds(y: np.ndarray, seed: int) -> np.ndarray:
    """Which rows a seeded 70 % of either class has."""
    random, train = np.random.default_rng(seed), np.zeros(len(y), bool)
    for c in (1, 0):
        rows = random.permutation(np.flatnonzero(y == c))
        train[rows[: int(0.7 * len(rows))]] = True
    return train


def held_out_auc(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """seed, auc: a discriminator of label 1 against 0 (id, x, y), fitted on a seeded 70 % of either class and scored on the rest."""
    ship(rows.sparkSession)
    one = sampled(rows, ["y"], DISCRIMINATOR_ROWS).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, y = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(float)
        train = folds(y, int(pdf["seed"].iloc[0]))
        model = fit_logistic(x[train], y[train])
        return pd.DataFrame({"seed": [int(pdf["seed"].iloc[0])], "auc": [rank_auc(model(x[~train]), y[~train])]})

    return one.groupBy("seed").applyInPandas(fit, "seed bigint, auc double")


def held_out_gram_auc(rows: DataFrame, seeds: list[int], least: int = 3, most: int = 250) -> DataFrame:
    """As ``held_out_auc``, from rows (id, y, size, grams: array of (g, n)): the features are the shares of those grams
    that are the most frequent by document in the training fold, so the vocabulary never sees the scored rows."""
    ship(rows.sparkSession)
    one = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, seed = pdf.sort_values("id"), int(pdf["seed"].iloc[0])
        y, size = pdf["y"].to_numpy(float), np.maximum(pdf["size"].to_numpy(float), 1)
        lists = [list(g) for g in pdf["grams"]]
        row = np.repeat(np.arange(len(lists)), [len(g) for g in lists])
        gram, n = (np.array([x[c] for g in lists for x in g], np.int64) for c in ("g", "n"))
        train = folds(y, seed)
        df = np.bincount(gram[train[row]], minlength=int(gram.max(initial=0)) + 1)
        vocabulary = np.lexsort((np.arange(len(df)), -df))[:most]
        vocabulary = vocabulary[df[vocabulary] >= least]
        place = np.full(len(df), -1)
        place[vocabulary] = np.arange(len(vocabulary))
        x = np.zeros((len(y), len(vocabulary)))
        inside = place[gram] >= 0
        x[row[inside], place[gram[inside]]] = n[inside]
        x /= size[:, None]
        model = fit_logistic(x[train], y[train])
        return pd.DataFrame({"seed": [seed], "auc": [rank_auc(model(x[~train]), y[~train])]})

    return one.groupBy("seed").applyInPandas(fit, "seed bigint, auc double")


def small_kmeans(x: np.ndarray, k: int, seed: int, restarts: int = 2, max_iter: int = 40) -> np.ndarray:
    """Euclidean assignment of a bounded sample, the best of some starts, in one place."""
    best, least = None, -np.inf
    for r in range(restarts):
        model = Lloyd(first_centroids(x, k, False, seed + 131 * r), False, seed + 131 * r)
        for _ in range(max_iter):
            at, _ = model.nearest(x)
            sums, counts = np.zeros_like(model.centroids), np.bincount(at, minlength=len(model.centroids))
            np.add.at(sums, at, x)
            model.update(sums, counts, x)
            if model.done:
                break
        at, gain = model.nearest(x)
        if best is None or round(gain.sum(), 9) > least:
            best, least = at, round(gain.sum(), 9)
    return best


def mauve(x: np.ndarray, y: np.ndarray, seed: int = 9) -> float:
    """Divergence frontier of two classes of feature rows over Euclidean clusters of their pooled z-scores."""
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    k = max(6, min(50, len(z) // 15))
    at = small_kmeans(z, min(k, len(z)), seed)
    p, q = (np.bincount(at[y == c], minlength=k) / max(1, (y == c).sum()) for c in (1, 0))
    return frontier(p, q)


def calibration(rows: DataFrame, seed: int = 4):
    """AUC on a held-out 30 %, MAUVE, and a function for r(q) fitted on all rows of the bounded sample (id, x, y)."""
    some = sampled(rows, ["y"], DISCRIMINATOR_ROWS).orderBy("id").collect()
    x, y = np.array([r["x"] for r in some]), np.array([float(r["y"]) for r in some])
    train = folds(y, seed)
    held = fit_logistic(x[train], y[train])
    return rank_auc(held(x[~train]), y[~train]), mauve(x, y), fit_logistic(x, y)


def frontier(p: np.ndarray, q: np.ndarray, scale: float = 5.0, points: int = 25) -> float:
    """Area under the divergence frontier of two histograms, in [0, 1]."""
    curve = []
    for t in range(1, points):
        m = t / points * p + (1 - t / points) * q
        kl = lambda a: float((a[a > 0] * np.log(a[a > 0] / m[a > 0])).sum())
        curve.append((np.exp(-scale * kl(q)), np.exp(-scale * kl(p))))
    x, y = (np.array(c) for c in zip(*sorted(curve), strict=True))
    x, y = np.concatenate([[0], x, [1]]), np.concatenate([y[:1], y, y[-1:]])
    return float(np.clip(((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum(), 0, 1))


def fit_2pl(succ: np.ndarray, trials: np.ndarray, steps: int = 3000, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Discrimination and difficulty of items and ability of takers by Adam on the joint likelihood.

    Ability is standardised after every step; weak ridge terms hold the items. Nothing is random.
    """
    n_items, n_takers = succ.shape
    alpha, b, theta = np.full(n_items, 0.5), np.zeros(n_items), np.where(np.arange(n_takers) % 2 == 0, -0.1, 0.1)
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (alpha, b, theta)]
    for step in range(1, steps + 1):
        a = np.logaddexp(0, alpha)
        gap = trials / (1 + np.exp(-a[:, None] * (theta[None] - b[:, None]))) - succ
        grads = ((gap * (theta[None] - b[:, None])).sum(axis=1) / (1 + np.exp(-alpha)) + 0.02 * alpha, -(gap * a[:, None]).sum(axis=1) + 0.05 * b, (gap * a[:, None]).sum(axis=0))
        new = []
        for v, g, (m, s) in zip((alpha, b, theta), grads, state, strict=True):
            m[:], s[:] = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            new.append(v - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8))
        alpha, b, theta = new
        theta = (theta - theta.mean()) / (theta.std() or 1)
    return np.logaddexp(0, alpha), b, theta


def irt(responses: DataFrame, key: str, steps: int = 3000) -> DataFrame:
    """key, item, a, b from long responses (key, item, taker, succ, trials); one independent fit for each key.

    The takers are a universe of bounded size chosen beforehand, so a key's matrix is small.
    """

    ship(responses.sparkSession)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        succ, trials = (pdf.pivot_table(index="item", columns="taker", values=c, aggfunc="sum", fill_value=0).sort_index() for c in ("succ", "trials"))
        a, b, _ = fit_2pl(succ.to_numpy(float), trials.to_numpy(float), steps)
        return pd.DataFrame({key: pdf[key].iloc[0], "item": succ.index, "a": a, "b": b})

    kind = dict(responses.dtypes)[key]
    return responses.groupBy(key).applyInPandas(fit, f"{key} {kind}, item string, a double, b double")


def irt_replicates(cells: DataFrame, replicates: DataFrame, steps: int) -> DataFrame:
    """kind, rep, side, item, a, b: one fit for each row of ``replicates`` (kind, rep, side) over the cells (item, taker, succ, trials).

    kind 'whole' takes all takers, 'boot' as many drawn with replacement, 'half' one of two disjoint halves (side 0 or 1).
    The cells, a universe chosen beforehand, go to every fit; the fits run side by side.
    """
    ship(cells.sparkSession)
    matrix = cells.toPandas()
    succ, trials = (matrix.pivot_table(index="item", columns="taker", values=c, aggfunc="sum", fill_value=0).sort_index() for c in ("succ", "trials"))
    items, succ, trials = list(succ.index), succ.to_numpy(float), trials.to_numpy(float)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, rep, side = pdf["kind"].iloc[0], int(pdf["rep"].iloc[0]), int(pdf["side"].iloc[0])
        n = succ.shape[1]
        random = np.random.default_rng([{"whole": 0, "boot": 4242, "half": 7000}[kind], rep])
        takers = np.arange(n) if kind == "whole" else random.integers(0, n, n) if kind == "boot" else random.permutation(n)[side * (n // 2) : (side + 1) * (n // 2)]
        a, b, _ = fit_2pl(succ[:, takers], trials[:, takers], 2 * steps if kind == "whole" else steps)
        return pd.DataFrame({"kind": kind, "rep": rep, "side": side, "item": items, "a": a, "b": b})

    return replicates.groupBy("kind", "rep", "side").applyInPandas(fit, "kind string, rep bigint, side bigint, item string, a double, b double")


def shuffled(n: int, seed: int) -> list[int]:
    """Fisher-Yates over 0 .. n - 1 with the 32-bit counter generator; sequential, for short lists."""
    out, state = list(range(n)), seed & 0xFFFFFFFF
    for i in range(n - 1, 0, -1):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
        t = (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) & 0xFFFFFFFF) ^ t
        j = int((t ^ t >> 14) / 4294967296 * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out
