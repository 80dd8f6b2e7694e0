"""Boosted trees for several classes and a perceptron that stops by itself, fitted over data that stays distributed.

Both fit in rounds. In a round each task adds up what its rows give (histograms of gradients, or a gradient), Spark
adds up the tasks' sums, and the driver takes one step with a model whose size does not depend on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import argmax, checkpointed, seeded_int

SIZE = len(K.CLASSES)
#: Rows that a task works on at once.
AT_ONCE = 8192


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, label, weight) of some rows at a time."""
    for batch in batches:
        for s in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(s, AT_ONCE)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield x, part.column(1).to_numpy(zero_copy_only=False).astype(np.int64), part.column(2).to_numpy(zero_copy_only=False)


def summed(rows: DataFrame, work: Callable[[Iterator], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of an array that work makes of a task's rows; arrays are added up place by place in Spark."""

    def run(batches):
        made = np.asarray(work(batches_of(batches)), np.float64).ravel()
        at = np.flatnonzero(made)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(made[at])], names=["at", "value"])

    parts = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    size = int(np.asarray(work(iter(()))).size)
    out = np.zeros(size)
    out[parts["at"].to_numpy()] = parts["value"].to_numpy()
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    up = np.exp(scores - scores.max(1, keepdims=True))
    return up / up.sum(1, keepdims=True)


@dataclass
class Tree:
    """A tree of full depth: node i has the children 2 i + 1 and 2 i + 2; a feature below 0 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def places(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row at some depth, or the leaf where it stopped before."""
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            f = self.feature[at]
            goes = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(goes, 2 * at + 1 + right, at)
        return at


@dataclass
class Boosted:
    """Rounds of one tree for each class, added up and scaled by a softmax."""

    rate: float
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), SIZE))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += self.rate * tree.value[tree.places(x, self.depth)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.scores(x))


def fit_boosted(rows: DataFrame, width: int, rounds: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 1.0, penalty: float = 1.0) -> Boosted:
    """Softmax boosting on binned features.

    rows: features (array), label, weight. Features are cut at approximate quantiles, which come to the driver, bins - 1
    for each of them. A level of the trees of a round is one pass: a task sums gradients and
    Hessians by (class, node, feature, bin), and the sums of all tasks decide the splits, and the values of both
    children, by the usual gain with an L2 penalty. A child holds `least` of the Hessian at least.
    """
    rows = checkpointed(rows.select("features", "label", "weight"))
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.get("features", i), shares, 1000).alias(f"c{i}") for i in range(width)]).first()
    cuts = [np.unique(np.array(c or [0.0], np.float64)) for c in found]
    padded = np.full((width, bins - 1), np.inf)
    for i, c in enumerate(cuts):
        padded[i, : len(c)] = c
    model, nodes = Boosted(rate, depth), 2 ** (depth + 1) - 1

    def bin_of(x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts[i], x[:, i], side="left") for i in range(width)], axis=1)

    for _ in range(rounds):
        trees = [Tree(np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)) for _ in range(SIZE)]
        for level in range(depth):
            first, count = 2**level - 1, 2**level

            def histograms(parts, trees=trees, level=level, first=first, count=count):
                out = np.zeros((2, SIZE, count * width * bins))
                for x, label, weight in parts:
                    p, b = model.probabilities(x), bin_of(x)
                    for k in range(SIZE):
                        node = trees[k].places(x, level) - first
                        here = node >= 0
                        place = ((node[here, None] * width + np.arange(width)) * bins + b[here]).ravel()
                        for side, value in ((0, weight * (p[:, k] - (label == k))), (1, weight * np.maximum(p[:, k] * (1 - p[:, k]), 1e-9))):
                            out[side, k] += np.bincount(place, np.repeat(value[here], width), minlength=out.shape[2])
                return out

            sums = summed(rows, histograms).reshape(2, SIZE, count, width, bins)
            for k in range(SIZE):
                for n in range(count):
                    g, h = sums[0, k, n], sums[1, k, n]
                    whole_g, whole_h = g[0].sum(), h[0].sum()
                    if level == 0:
                        trees[k].value[0] = -whole_g / (whole_h + penalty)
                    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                    gain = left_g**2 / (left_h + penalty) + (whole_g - left_g) ** 2 / (whole_h - left_h + penalty) - whole_g**2 / (whole_h + penalty)
                    gain[(left_h < least) | (whole_h - left_h < least) | ~np.isfinite(padded)] = 0
                    f, c = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, c] > 1e-9:
                        at = first + n
                        trees[k].feature[at], trees[k].cut[at] = f, padded[f, c]
                        trees[k].value[2 * at + 1] = -left_g[f, c] / (left_h[f, c] + penalty)
                        trees[k].value[2 * at + 2] = -(whole_g - left_g[f, c]) / (whole_h - left_h[f, c] + penalty)
        model.rounds.append(trees)
    return model


@dataclass
class Perceptron:
    """Layers with ReLU between them and a softmax at the end."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        held = [x]
        for i, (w, b) in enumerate(self.layers):
            z = held[-1] @ w + b
            held.append(np.maximum(z, 0) if i < len(self.layers) - 1 else softmax(z))
        return held

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def gradients(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Summed loss and summed gradients of some rows."""
        held = self.forward(x)
        loss = -float((weight * np.log(np.maximum(held[-1][np.arange(len(x)), label], 1e-300))).sum())
        back = weight[:, None] * (held[-1] - np.eye(SIZE)[label])
        out = []
        for i in range(len(self.layers) - 1, -1, -1):
            out += [back.sum(0), held[i].T @ back]
            back = (back @ self.layers[i][0].T) * (held[i] > 0)
        return loss, out[::-1]


def start_perceptron(width: int, hidden: Sequence[int] = (64, 32), seed: int = 42) -> Perceptron:
    random, sizes = np.random.default_rng(seed), [width, *hidden, SIZE]
    return Perceptron([(random.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])])


def fit_perceptron(rows: DataFrame, width: int, hidden: Sequence[int] = (64, 32), rounds: int = 150, rate: float = 0.02, penalty: float = 1e-4, patience: int = 10, tolerance: float = 1e-4, seed: int = 42, key: str | None = None) -> tuple[Perceptron, list[float]]:
    """(model, scores): Adam on the gradient of all rows, one round for a pass, until a held-back tenth stops gaining.

    rows: features (array), label, weight and the key by whose hash a tenth is held back (by features, without one). A round broadcasts the
    weights; a task returns its summed gradient and the loss of the held-back rows. The model is the one of the
    least mean loss on these (scores: its negative, by round); the fit stops after `patience` rounds without a gain above the tolerance.
    """
    at = seeded_int(seed, F.col(key) if key else F.to_json("features")) % 10 == 0
    rows = checkpointed(rows.select("features", F.when(at, -1 - F.col("label")).otherwise(F.col("label")).cast("int").alias("label"), "weight"))
    model = start_perceptron(width, hidden, seed)
    shapes = [p.shape for layer in model.layers for p in layer]
    sizes = [int(np.prod(s)) for s in shapes]
    moments, best, waited, scores = [np.zeros(sum(sizes))] * 2, (-np.inf, model), 0, []
    for step in range(1, rounds + 1):

        def work(parts, model=model):
            out, gradient = np.zeros(4), np.zeros(sum(sizes))
            for x, label, weight in parts:
                held = label < 0
                out[:2] += [-model.gradients(x[held], -1 - label[held], np.ones(held.sum()))[0], held.sum()]
                loss, parts_of = model.gradients(x[~held], label[~held], weight[~held])
                out[2:] += [loss, weight[~held].sum()]
                gradient += np.concatenate([g.ravel() for g in parts_of])
            return np.concatenate([out, gradient])

        sums = summed(rows, work)
        score = sums[0] / max(sums[1], 1)
        scores.append(score)
        if score > best[0] + tolerance:
            best, waited = (score, model), 0
        else:
            waited += 1
            if waited >= patience and sums[1]:
                break
        now = np.concatenate([p.ravel() for layer in model.layers for p in layer])
        gradient = sums[4:] / max(sums[3], 1e-12) + penalty * now
        moments = [0.9 * moments[0] + 0.1 * gradient, 0.999 * moments[1] + 0.001 * gradient**2]
        now = now - rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        flat = [p.reshape(s) for p, s in zip(np.split(now, np.cumsum(sizes)[:-1]), shapes)]
        model = Perceptron(list(zip(flat[::2], flat[1::2])))
    return best[1] if sums[1] else model, scores


def apply_probabilities(df: DataFrame, model, features: str = "features") -> DataFrame:
    """Adds probs and pred from a model of this module over an array of features; the model is small and goes with the function."""
    @F.pandas_udf("array<double>")
    def probabilities(x):
        import pandas as pd

        return pd.Series(list(model.probabilities(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

    return df.withColumn("probs", probabilities(features)).withColumn("pred", argmax(F.col("probs")))
