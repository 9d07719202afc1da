"""A small convolutional network that adds to a frozen pixel model, trained by gradients that Spark sums.

An epoch is one pass over the rows: each task returns, for each session, the gradient summed over its training
rows and the loss over its validation rows under the weights so far. The sums, of some thousand numbers a
session, go to the driver, which takes one step of Adam with decoupled weight decay. Which epoch is best is
told by validation rows; then a fresh network takes as many steps on training and validation rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.functions.exprs import pearson, r_squared
from photonloom.operators import linear
from photonloom.operators.moments import Moments

Weights = dict[str, np.ndarray]
CHANNELS, HIDDEN = 4, 16
LEAST_GAIN = 1e-5


@dataclass(frozen=True)
class Shape:
    """x is lags images of height by width, one after the other; y has so many responses."""

    lags: int
    height: int
    width: int
    responses: int

    def initial(self, seed: int) -> Weights:
        """Weights within one over the root of their inputs' number; the last layer is zero, so the network adds nothing at first."""
        rng = np.random.default_rng(seed)
        sizes = {"conv1": (CHANNELS, self.lags, 3, 3), "conv2": (CHANNELS, CHANNELS, 3, 3), "dense": (HIDDEN, CHANNELS * (self.height // 2) * (self.width // 2))}
        out: Weights = {}
        for name, size in sizes.items():
            bound = 1 / math.sqrt(math.prod(size[1:]))
            out[name], out[f"{name}_bias"] = rng.uniform(-bound, bound, size), rng.uniform(-bound, bound, size[0])
        return out | {"head": np.zeros((self.responses, HIDDEN)), "head_bias": np.zeros(self.responses)}

    def images(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(-1, self.lags, self.height, self.width)


def _elu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope."""
    low = np.exp(np.minimum(x, 0))
    return np.where(x > 0, x, low - 1), np.where(x > 0, 1.0, low)


def _around(x: np.ndarray) -> np.ndarray:
    """Of each place its 3 by 3 surroundings, zeros beyond the edge."""
    p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    return np.lib.stride_tricks.sliding_window_view(p, (3, 3), axis=(2, 3))


def _convolved(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.einsum("nchwij,ocij->nohw", _around(x), kernel, optimize=True) + bias[:, None, None]


def _pooled(x: np.ndarray) -> np.ndarray:
    h, w = x.shape[2] // 2, x.shape[3] // 2
    return x[:, :, : 2 * h, : 2 * w].reshape(*x.shape[:2], h, 2, w, 2).mean(axis=(3, 5))


def output(weights: Weights, images: np.ndarray) -> tuple[np.ndarray, tuple]:
    """What the network adds, and what the gradient needs."""
    a, da = _elu(_convolved(images, weights["conv1"], weights["conv1_bias"]))
    b, db = _elu(_convolved(a, weights["conv2"], weights["conv2_bias"]))
    flat = _pooled(b).reshape(len(images), -1)
    c, dc = _elu(flat @ weights["dense"].T + weights["dense_bias"])
    return c @ weights["head"].T + weights["head_bias"], (images, a, da, b, db, flat, c, dc)


def gradient(weights: Weights, kept: tuple, error: np.ndarray) -> Weights:
    """Sums over rows of the slopes of error times output."""
    images, a, da, b, db, flat, c, dc = kept
    out = {"head": error.T @ c, "head_bias": error.sum(axis=0)}
    back = (error @ weights["head"]) * dc
    out |= {"dense": back.T @ flat, "dense_bias": back.sum(axis=0)}
    h, w = b.shape[2] // 2, b.shape[3] // 2
    pooled = (back @ weights["dense"]).reshape(len(images), CHANNELS, h, w) / 4
    wide = np.zeros_like(b)
    wide[:, :, : 2 * h, : 2 * w] = pooled.repeat(2, axis=2).repeat(2, axis=3)
    for name, below, slope, own in (("conv2", a, da, wide * db), ("conv1", images, None, None)):
        own = own if own is not None else later
        out |= {name: np.einsum("nohw,nchwij->ocij", own, _around(below), optimize=True), f"{name}_bias": own.sum(axis=(0, 2, 3))}
        if slope is not None:
            later = np.einsum("nohwij,ocij->nchw", _around(own), weights[name][:, :, ::-1, ::-1], optimize=True) * slope
    return out


class Adam:
    """Adam with decoupled weight decay."""

    def __init__(self, weights: Weights, rate: float, decay: float):
        self.weights, self.rate, self.decay, self.n = weights, rate, decay, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))

    def step(self, slopes: Weights) -> None:
        self.n += 1
        for k, g in slopes.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            size = self.first[k] / (1 - 0.9**self.n) / (np.sqrt(self.second[k] / (1 - 0.999**self.n)) + 1e-8)
            self.weights[k] = self.weights[k] * (1 - self.rate * self.decay) - self.rate * size


@dataclass(frozen=True)
class Network:
    """One session's network: weights, the pixel model it adds to, and the mean and spread that responses are scaled by."""

    weights: Weights
    beta: np.ndarray
    bias: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    epoch: int = 0

    def predict(self, shape: Shape, x: np.ndarray) -> np.ndarray:
        linear_part = x @ self.beta + self.bias
        return linear_part + output(self.weights, shape.images(x))[0] * self.scale if self.epoch else linear_part


def _flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    parts = np.split(flat, np.cumsum([like[k].size for k in sorted(like)])[:-1])
    return {k: v.reshape(like[k].shape) for k, v in zip(sorted(like), parts)}


def _summed(rows: DataFrame, nets: dict[str, Network], shape: Shape, fan_in: int = 32) -> dict[tuple[str, str], tuple[int, float, np.ndarray]]:
    """(session, part): rows, squared error summed over rows and responses, and of part fit the summed gradient."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for whole in batches:
            for (s, part), g in whole.groupby(["session", "part"], sort=False):
                if s not in nets:
                    continue
                net = nets[s]
                for k in range(0, len(g), 512):
                    x, y = (np.stack(g[c].iloc[k : k + 512].to_numpy()).astype(float) for c in "xy")
                    added, kept = output(net.weights, shape.images(x))
                    error = added - (y - x @ net.beta - net.bias) / net.scale
                    slope = _flat(gradient(net.weights, kept, 2 * error)) if part == "fit" else np.zeros(0)
                    n, loss, total = held.get((s, part), (0, 0.0, 0.0))
                    held[s, part] = n + len(x), loss + float((error * error).sum()), total + slope
        lot = TaskContext.get().partitionId() // fan_in
        yield pd.DataFrame([(s, p, lot, n, loss, np.asarray(g).tobytes()) for (s, p), (n, loss, g) in held.items()], columns=["session", "part", "lot", "n", "loss", "slope"])

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in g["slope"])
        return pd.DataFrame({"session": g["session"].iloc[:1], "part": g["part"].iloc[:1], "lot": 0, "n": g["n"].sum(), "loss": math.fsum(g["loss"]), "slope": [total.tobytes()]})

    schema = "session string, part string, lot int, n long, loss double, slope binary"
    parts = rows.select("session", "part", "x", "y").mapInPandas(run, schema).groupBy("session", "part", "lot").applyInPandas(joined, schema)
    found = parts.groupBy("session", "part").applyInPandas(joined, schema).collect()
    return {(r.session, r.part): (r.n, r.loss, np.frombuffer(r.slope)) for r in found}


def _begun(groups: dict[str, Moments], betas: dict[str, np.ndarray], biases: dict[str, np.ndarray], shape: Shape, seed: int) -> dict[str, Network]:
    spread = {s: np.sqrt(np.maximum(m.variance, 0)) for s, m in groups.items()}
    return {s: Network(shape.initial(seed), betas[s], biases[s], m.my, np.where(spread[s] > 1e-6, spread[s], 1.0)) for s, m in groups.items()}


def pixel_fit(m: Moments, pixels: np.ndarray, penalties: list[float], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercepts of pixel models at given pixels and penalties."""
    beta, bias = np.zeros((len(m.sx), len(pixels))), np.zeros(len(pixels))
    for r, (pixel, a) in enumerate(zip(pixels, penalties)):
        columns = np.arange(bins) * (len(m.sx) // bins) + pixel
        b, bias[r : r + 1] = linear.Ridge(m.picked(columns, r)).fit(a)
        beta[columns, r] = b[:, 0]
    return beta, bias


def fit(rows: DataFrame, sessions: linear.Sessions, shape: Shape, max_epochs: int = 60, patience: int = 10, rate: float = 0.01, decay: float = 0.001, seed: int = 20260929) -> tuple[dict[str, Network], list[tuple[str, int, float]]]:
    """Networks by session, and the validation loss of each epoch. rows: (session, split, x, y); test rows are not read."""
    if max_epochs < 1 or patience < 1 or rate <= 0 or decay < 0:
        raise ValueError("epochs, patience and rate must be positive, the decay not negative")
    baseline = linear.individual_pixel(sessions, shape.lags)
    train = {s: p["train"] for s, p in sessions.items()}
    early = {s: pixel_fit(m, baseline.extra["pixels"][s], baseline.chosen[s], shape.lags) for s, m in train.items()}
    nets = _begun(train, {s: b for s, (b, _) in early.items()}, {s: c for s, (_, c) in early.items()}, shape, seed)
    part = F.when(F.col("split") == "train", "fit").when(F.col("split") == "validation", "validation")
    marked = rows.withColumn("part", part).where("part is not null")
    steps = {s: Adam(n.weights, rate, decay) for s, n in nets.items()}
    best = dict.fromkeys(nets, (math.inf, 0))
    curve, running = [], dict(nets)
    for epoch in range(max_epochs + 1):
        sums = _summed(marked, running, shape)
        for s in list(running):
            n, loss, _ = sums[s, "validation"]
            loss /= n * shape.responses
            curve.append((s, epoch, loss))
            if loss < best[s][0] - LEAST_GAIN:
                best[s] = loss, epoch
            elif epoch - best[s][1] >= patience:
                del running[s]
                continue
            n, _, slope = sums[s, "fit"]
            steps[s].step(_shaped(slope / (n * shape.responses), nets[s].weights))
        if not running:
            break
    both = {s: linear.refit(p) for s, p in sessions.items()}
    nets = _begun(both, baseline.beta, baseline.bias, shape, seed)
    steps = {s: Adam(n.weights, rate, decay) for s, n in nets.items()}
    marked = rows.where("split in ('train', 'validation')").withColumn("part", F.lit("fit"))
    for epoch in range(max((e for _, e in best.values()), default=0)):
        own = {s: n for s, n in nets.items() if best[s][1] > epoch}
        for (s, _), (n, _, slope) in _summed(marked, own, shape).items():
            steps[s].step(_shaped(slope / (n * shape.responses), nets[s].weights))
    return {s: Network(n.weights, n.beta, n.bias, n.center, n.scale, best[s][1]) for s, n in nets.items()}, curve


def predict(rows: DataFrame, nets: dict[str, Network], shape: Shape, keep: list[str]) -> DataFrame:
    """(session, keep, predicted, baseline): arrays with an entry for each response; a session without a network is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for s, g in whole.groupby("session", sort=False):
                if s not in nets:
                    raise ValueError(f"no network of session {s}")
                x = np.stack(g["x"].to_numpy()).astype(float)
                if x.shape[1] != shape.lags * shape.height * shape.width:
                    raise ValueError(f"vectors of session {s} don't have the network's shape")
                yield g.drop(columns="x").assign(predicted=list(nets[s].predict(shape, x)), baseline=list(x @ nets[s].beta + nets[s].bias))

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ["session", *keep])
    return rows.select("session", *keep, "x").mapInPandas(run, f"{kinds}, predicted array<double>, baseline array<double>")


def held_out_scores(rows: DataFrame, nets: dict[str, Network], shape: Shape) -> DataFrame:
    """(session, response, selected_epoch, pixel_r, pixel_r2, network_r, network_r2, delta_r2) on test rows."""
    found = predict(rows.where("split = 'test'"), nets, shape, ["y"])
    long = found.select("session", F.posexplode(F.arrays_zip("y", "predicted", "baseline")).alias("response", "v")).select("session", "response", "v.*")
    own = long.groupBy("session", "response").agg(pearson("y", "baseline").alias("pixel_r"), r_squared("y", "baseline").alias("pixel_r2"), pearson("y", "predicted").alias("network_r"), r_squared("y", "predicted").alias("network_r2"))
    epochs = rows.sparkSession.createDataFrame([(s, n.epoch) for s, n in nets.items()], "session string, selected_epoch int")
    return own.join(epochs, "session").withColumn("delta_r2", F.col("network_r2") - F.col("pixel_r2"))


_SAVED = "session string, name string, size array<int>, numbers array<double>"


def as_table(spark, nets: dict[str, Network]) -> DataFrame:
    """(session, name, size, numbers): every array of every network."""
    rows = []
    for s, n in nets.items():
        arrays = n.weights | {"skip": n.beta, "skip_bias": n.bias, "center": n.center, "scale": n.scale, "epoch": np.array([float(n.epoch)])}
        rows += [(s, k, list(v.shape), v.ravel().tolist()) for k, v in arrays.items()]
    return spark.createDataFrame(rows, _SAVED)


def from_table(saved: DataFrame, shape: Shape) -> dict[str, Network]:
    """The networks of as_table(); arrays that are missing or don't fit the shape, and scales that aren't positive, are errors."""
    found: dict[str, dict[str, np.ndarray]] = {}
    for r in saved.collect():
        found.setdefault(r.session, {})[r.name] = np.array(r.numbers).reshape(r["size"])
    want = {k: v.shape for k, v in shape.initial(0).items()}
    want |= {"skip": (shape.lags * shape.height * shape.width, shape.responses)} | {k: (shape.responses,) for k in ("skip_bias", "center", "scale")} | {"epoch": (1,)}
    out = {}
    for s, own in found.items():
        if {k: v.shape for k, v in own.items()} != want or not (own["scale"] > 0).all():
            raise ValueError(f"the saved network of session {s} doesn't have the shape of {shape}")
        out[s] = Network({k: own[k] for k in shape.initial(0)}, own["skip"], own["skip_bias"], own["center"], own["scale"], int(own["epoch"][0]))
    return out


def check_baseline(rows: DataFrame, nets: dict[str, Network], shape: Shape, saved: DataFrame, keys: list[str], tolerance: float = 1e-9) -> None:
    """Raise unless the pixel part of the networks predicts on test rows what saved (session, keys, baseline) has, row by row."""
    now = predict(rows.where("split = 'test'"), nets, shape, keys).select("session", *keys, F.col("baseline").alias("_now"))
    pairs = saved.select("session", *keys, "baseline").join(now, ["session", *keys], "full_outer")
    same = (F.size("baseline") == F.size("_now")) & F.forall(F.zip_with("baseline", "_now", lambda a, b: F.abs(a - b) <= tolerance + tolerance * F.abs(b)), lambda v: v)
    odd = pairs.where(~F.coalesce(same, F.lit(False))).limit(3).collect()
    if odd:
        raise ValueError(f"the pixel baseline differs from the saved one: {odd}")
