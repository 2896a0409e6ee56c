"""Probes on standardized features: logistic regression by Newton steps, and a ReLU network with a penalty.

Each step is a pass: tasks sum what their rows add to the losses and derivatives of all
models of a grid, parts that belong together are summed again by tasks, and the driver gets
as many numbers as the models have.  What is broadcast is the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.evaluation import binary

#: Rows worked on at a time.
ROWS = 8192


def _prepared(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(x, y): rows with a null label or vector, or a null or infinite number, are an error."""
    bad = F.col(vector).isNull() | F.col(label).isNull() | F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    y = F.when(bad | ~F.col(label).isin(0, 1), F.raise_error(F.lit("features are numbers, and labels 0 or 1"))).otherwise(F.col(label)).cast("double")
    return df.select(F.col(vector).cast("array<double>").alias("x"), y.alias("y"))


def _sums(rows: DataFrame, dims: int, state, part: Callable[[object, np.ndarray, np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """By key, the sum over all rows of what ``part(state, x, y)`` gives for some of them."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                x = some.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                for key, v in part(shared.value, x, some.column(1).to_numpy(zero_copy_only=False)).items():
                    held[key] = held[key] + v if key in held else v
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.astype(float).tobytes() for v in held.values()], pa.binary())], names=["key", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(v.as_py())
                held[key] = held[key] + v if key in held else v
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["key", "v"])

    found = rows.mapInArrow(run, "key long, v binary").repartition("key").mapInArrow(add, "key long, v binary")
    out = {r["key"]: np.frombuffer(bytes(r["v"])) for r in found.collect()}  # a row a key: a row of a matrix, or a model
    shared.unpersist()
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def log_loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))


@dataclass
class Logistic:
    c: float
    weights: np.ndarray  # the intercept is the last
    loss: float = np.inf
    steps: int = 0

    def probability(self, vector: str) -> Column:
        """The probability of label 1, as an expression on an array column."""
        w = F.array(*(F.lit(float(v)) for v in self.weights[:-1]))
        z = F.aggregate(F.zip_with(vector, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v) + float(self.weights[-1])
        return 1 / (1 + F.exp(-z))


def _newton_part(state: list[tuple[int, np.ndarray]], x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
    """Rows of (gradient and loss, then each row of the second derivatives), keys by model."""
    out, one = {}, np.concatenate([x, np.ones((len(x), 1))], 1)
    d = one.shape[1]
    for i, w in state:
        z = one @ w
        p = sigmoid(z)
        out[i * (d + 1)] = np.append(one.T @ (p - y), log_loss(z, y).sum())
        for j, row in enumerate((one * (p * (1 - p))[:, None]).T @ one):
            out[i * (d + 1) + 1 + j] = row
    return out


def logistic(train: DataFrame, grid: tuple[float, ...] = (1e-3, 1e-2, 1e-1, 1.0, 10.0), vector: str = "features", label: str = "label", tolerance: float = 1e-9, most: int = 100) -> list[Logistic]:
    """For each C the minimum of ``|w|^2 / 2 + C * sum of log losses``; the intercept has no penalty.

    Damped Newton steps until the gradient's largest entry is ``tolerance * (1 + C n)`` at
    most; a step that doesn't lower the loss is halved.  No rows give weights of 0.
    """
    rows = _prepared(train, vector, label)
    first = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("d"), F.max(F.size("x")).alias("e")).first()
    if first["d"] != first["e"]:
        raise ValueError("vectors of several lengths")
    n, dims = first["n"], first["d"] or 0
    models = [Logistic(c, np.zeros(dims + 1)) for c in grid]
    if not n:
        return models
    rows = rows.persist()
    trial = {i: m.weights for i, m in enumerate(models)}
    step: dict[int, np.ndarray] = {}
    for _ in range(most):
        found = _sums(rows, dims, list(trial.items()), _newton_part)
        after = {}
        for i, w in trial.items():
            m, base = models[i], i * (dims + 2)
            penalty = np.append(w[:-1], 0.0)
            loss = m.c * found[base][-1] + penalty @ penalty / 2
            m.steps += 1
            if loss > m.loss * (1 + 1e-14) and np.abs(step[i]).max() > 1e-14:
                step[i] = step[i] / 2
                after[i] = m.weights + step[i]
                continue
            m.weights, m.loss = w, loss
            gradient = m.c * found[base][:-1] + penalty
            if np.abs(gradient).max() <= tolerance * (1 + m.c * n):
                continue
            hessian = m.c * np.stack([found[base + 1 + j] for j in range(dims + 1)]) + np.diag(np.append(np.ones(dims), 1e-12))
            step[i] = -np.linalg.solve(hessian, gradient)
            after[i] = w + step[i]
        trial = after
        if not trial:
            break
    rows.unpersist()
    return models


@dataclass
class Network:
    """``relu(x @ w1 + b1) @ w2 + b2``, in one array of weights."""

    alpha: float
    dims: int
    hidden: int
    weights: np.ndarray
    losses: list[float]

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        d, h = self.dims, self.hidden
        w = self.weights
        return w[: d * h].reshape(d, h), w[d * h : d * h + h], w[d * h + h : d * h + 2 * h], float(w[-1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts()
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def initial(dims: int, hidden: int, seed: int) -> np.ndarray:
    """Uniform weights and biases within sqrt(6 / (in + out)) of a ReLU layer, and sqrt(2 / (in + out)) of the logistic one."""
    rng = np.random.default_rng(seed)
    a, b = (6 / (dims + hidden)) ** 0.5, (2 / (hidden + 1)) ** 0.5
    return np.concatenate([rng.uniform(-a, a, dims * hidden + hidden), rng.uniform(-b, b, hidden + 1)])


def _network_part(state: list[tuple[int, Network]], x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
    """The gradient of the summed log losses, then their sum, by model."""
    out = {}
    for i, m in state:
        w1, b1, w2, b2 = m.parts()
        first = x @ w1 + b1
        active = np.maximum(first, 0)
        z = active @ w2 + b2
        delta = sigmoid(z) - y
        back = delta[:, None] * w2 * (first > 0)
        out[i] = np.concatenate([(x.T @ back).ravel(), back.sum(0), active.T @ delta, [delta.sum(), log_loss(z, y).sum()]])
    return out


def networks(train: DataFrame, alphas: tuple[float, ...] = (1e-4, 1e-2, 1.0), hidden: int = 256, steps: int = 200, rate: float = 0.01, seed: int = 42, vector: str = "features", label: str = "label") -> list[Network]:
    """For each alpha a network of ReLU units after ``steps`` Adam steps on the mean log loss plus ``alpha * |w|^2 / (2 n)``.

    Each step sees all rows, so the order and the partitions of rows change nothing but
    rounding; biases have no penalty.  ``losses`` has the loss before each step.
    """
    rows = _prepared(train, vector, label)
    first = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("d"), F.max(F.size("x")).alias("e")).first()
    if first["d"] != first["e"]:
        raise ValueError("vectors of several lengths")
    n, dims = first["n"], first["d"] or 0
    models = [Network(a, dims, hidden, initial(dims, hidden, seed), []) for a in alphas]
    if not n:
        return models
    penalized = np.concatenate([np.ones(dims * hidden), np.zeros(hidden), np.ones(hidden), np.zeros(1)])
    rows, moments = rows.persist(), [np.zeros((2, len(penalized))) for _ in models]
    for t in range(1, steps + 1):
        found = _sums(rows, dims, list(enumerate(models)), _network_part)
        for i, m in enumerate(models):
            own = penalized * m.weights
            m.losses.append((found[i][-1] + m.alpha * own @ own / 2) / n)
            g = (found[i][:-1] + m.alpha * own) / n
            moments[i][0] = 0.9 * moments[i][0] + 0.1 * g
            moments[i][1] = 0.999 * moments[i][1] + 0.001 * g * g
            m.weights = m.weights - rate * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t) * moments[i][0] / (np.sqrt(moments[i][1]) + 1e-8)
    rows.unpersist()
    return models


def network_probability(df: DataFrame, model: Network, vector: str = "features", to: str = "prob") -> DataFrame:
    """The rows with the probability of label 1; a null vector has none."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(x: pa.Array) -> pa.Array:
        filled = x.drop_null()
        flat = filled.flatten().to_numpy(zero_copy_only=False).reshape(-1, shared.value.dims)
        out = np.full(len(x), np.nan)
        out[np.asarray(x.is_valid())] = sigmoid(shared.value.logit(flat)) if len(filled) else []
        return pa.array(out, mask=~np.asarray(x.is_valid()))

    return df.withColumn(to, of(F.col(vector).cast("array<double>")))


def chosen(scored: list[DataFrame], label: str = "label") -> tuple[int, list[float]]:
    """(which, rounded MCC of each): the first of the best at a threshold of 0.5."""
    figures = [float(x.transform(lambda df: binary(df, [], 0.5, label)).first()["mcc"]) for x in scored]
    return int(np.argmax(figures)), figures
