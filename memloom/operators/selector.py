"""Scores of a selector network for the actions of the sequence model, and its choice of an architecture for a finished set.

The network is frozen: a set encoder over a unit's sources, a recurrent state along the prefix, a pointer over actions, and an architecture head
that reads the finished set. Prefixes, legality and decoding are rows and joins (``policy``); only the arithmetic runs in
tasks, a bounded number of actions of one unit at a time. Weights are sent once to each executor.
"""

from __future__ import annotations

from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.structure import ARCHITECTURES

#: Actions of a unit that one row holds.
CHUNK = 4096
#: Input tokens that a budget is measured against.
INPUT_LIMIT = 15872

_erf = np.vectorize(erf, otypes=[float])
Weights = dict[str, np.ndarray]


def random_weights(inputs: int, width: int = 32, heads: int = 4, hidden: int = 64, layers: int = 2, seed: int = 7) -> Weights:
    """Weights of the network's shape from a seed: ``name`` and ``name_b`` are a linear map (outputs x inputs) and its offset."""
    random = np.random.default_rng(seed)
    shapes = {"input": (width, inputs), "gru_x": (3 * width, width), "gru_h": (3 * width, width), "start": (width, 2 * width + 2), "head": (len(ARCHITECTURES), 2 * width + 2)}
    for k in range(layers):
        shapes |= {f"qkv{k}": (3 * width, width), f"out{k}": (width, width), f"up{k}": (hidden, width), f"down{k}": (width, hidden)}
    out = {}
    for name, (rows, columns) in shapes.items():
        out[name], out[f"{name}_b"] = random.normal(0, columns**-0.5, (rows, columns)), random.normal(0, 0.1, rows)
    for name, columns in (("action", width), ("state", width), ("budget", 2), ("dynamic", 4)):
        out[name] = random.normal(0, columns**-0.5, (width, columns))
    for k in range(layers):
        for part in ("a", "b"):
            out[f"norm{k}{part}"], out[f"norm{k}{part}_b"] = random.normal(1, 0.1, width), random.normal(0, 0.1, width)
    return out | {"stop": random.normal(0, 1, width), "score": random.normal(0, width**-0.5, width), "heads": np.array(heads), "layers": np.array(layers)}


def _linear(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    return x @ w[name].T + w[f"{name}_b"]


def _normed(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + 1e-5) * w[name] + w[f"{name}_b"]


def encoded(w: Weights, features: np.ndarray) -> np.ndarray:
    """The sources of a unit (rows), each in view of all."""
    x, heads = _linear(w, "input", features), int(w["heads"])
    n, width = x.shape
    for k in range(int(w["layers"])):
        q, key, v = np.split(_linear(w, f"qkv{k}", _normed(w, f"norm{k}a", x)), 3, axis=1)
        q, key, v = (y.reshape(n, heads, width // heads).transpose(1, 0, 2) for y in (q, key, v))
        shares = q @ key.transpose(0, 2, 1) / np.sqrt(width // heads)
        shares = np.exp(shares - shares.max(axis=2, keepdims=True))
        mixed = (shares / shares.sum(axis=2, keepdims=True)) @ v
        x = x + _linear(w, f"out{k}", mixed.transpose(1, 0, 2).reshape(n, width))
        up = _linear(w, f"up{k}", _normed(w, f"norm{k}b", x))
        x = x + _linear(w, f"down{k}", up * 0.5 * (1 + _erf(up / np.sqrt(2))))
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Unit:
    """A unit's encoded sources, and the states of prefixes that were met."""

    def __init__(self, w: Weights, features: list, vectors: list, sessions: list, budget: float, limit: float):
        self.w, self.x = w, encoded(w, np.array(features, float))
        self.n, self.sessions, self.budget, self.limit = len(features), np.array(sessions, object), budget, limit
        width = max((len(v) for v in vectors if v), default=1)
        self.vectors = np.array([v or [0.0] * width for v in vectors], float)
        self.known = np.array([bool(v) for v in vectors])
        start = np.concatenate([self.x.mean(axis=0), [budget / max(limit, 1), 1.0], np.zeros(self.x.shape[1])])
        self.states = {(): np.tanh(_linear(w, "start", start))}

    def state(self, prefix: tuple[int, ...]) -> np.ndarray:
        if prefix not in self.states:
            before = self.state(prefix[:-1])
            (rx, zx, nx), (rh, zh, nh) = np.split(_linear(self.w, "gru_x", self.x[prefix[-1] - 1]), 3), np.split(_linear(self.w, "gru_h", before), 3)
            keep = _sigmoid(zx + zh)
            self.states[prefix] = (1 - keep) * np.tanh(nx + _sigmoid(rx + rh) * nh) + keep * before
        return self.states[prefix]

    def spare(self, cost: float) -> list[float]:
        return [self.budget / max(self.limit, 1), max(self.budget - cost, 0.0) / max(self.budget, 1.0)]

    def logits(self, prefix: tuple[int, ...], cost: float, ids: np.ndarray) -> np.ndarray:
        """Logits of adding each of ``ids`` to a prefix of that cost; id 0 is STOP."""
        w, at = self.w, ids - 1
        shared = w["state"] @ self.state(prefix) + w["budget"] @ np.array(self.spare(cost))
        out = np.tanh(np.where((ids > 0)[:, None], self.x[at], w["stop"]) @ w["action"].T + shared) @ w["score"]
        chosen = np.array(prefix, int) - 1
        near, same = np.zeros(len(ids)), np.zeros(len(ids))
        beside = chosen[self.known[chosen]]
        if len(beside):
            near = np.where(self.known[at], (self.vectors[at] @ self.vectors[beside].T).max(axis=1), 0.0)
        if len(chosen):
            named = [x for x in self.sessions[chosen] if x is not None]
            same = np.array([float(x is not None and x in named) for x in self.sessions[at]])
        dynamic = np.stack([np.full(len(ids), max(self.budget, 0) / max(self.budget, 1.0)), near, same, np.full(len(ids), len(prefix) / max(self.n, 1))], axis=1)
        return out + np.where(ids > 0, np.tanh(dynamic @ w["dynamic"].T) @ w["score"], 0.0)

    def architectures(self, ids: tuple[int, ...], cost: float) -> np.ndarray:
        """Logits of the architectures for a finished set of that cost."""
        chosen = self.x[[i - 1 for i in ids]].mean(axis=0) if ids else np.zeros(self.x.shape[1])
        return _linear(self.w, "head", np.concatenate([self.x.mean(axis=0), chosen, self.spare(cost)]))


def ids_in(mask: int) -> tuple[int, ...]:
    """The sorted ids in a mask."""
    return tuple(i + 1 for i in range(64) if mask >> i & 1)


def _units_of(batch: pa.RecordBatch, weights: Weights, budget: float, limit: float):
    for row in batch.to_pylist():
        yield row, Unit(weights, row["features"], row["vectors"], row["sessions"], budget, limit)


def _chunks(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Rows of a unit as arrays of up to about ``CHUNK``, beside the unit's inputs."""
    sizes = rows.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("_n"))
    items = F.struct(*(c for c in rows.columns if c != "unit"))
    chunks = rows.join(sizes, "unit").groupBy("unit", F.pmod(F.xxhash64("mask"), F.col("_n")).alias("_chunk")).agg(F.collect_list(items).alias("items"))
    return chunks.join(units.select("unit", "features", "vectors", "sessions"), "unit").drop("_chunk")


def legal_actions(sets: DataFrame) -> DataFrame:
    """``unit, mask, id, next, cost``: what may follow each prefix of :func:`policy.prefixes`: a larger id within the budget, or STOP (id 0). cost: the prefix's own."""
    grown = sets.where("mask <> 0").select("unit", F.expr("mask ^ shiftleft(1L, greatest(last - 1, 0))").alias("mask"), F.col("last").alias("id"), F.col("mask").alias("next"))
    stopped = sets.select("unit", "mask", F.lit(0).alias("id"), F.col("mask").alias("next"))
    return grown.unionByName(stopped).join(sets.select("unit", "mask", "cost"), ["unit", "mask"])


def action_logps(sets: DataFrame, units: DataFrame, weights: Weights, budget: float, limit: float = INPUT_LIMIT) -> DataFrame:
    """``unit, mask, id, next, logp``: the log-probability of every legal action at every prefix.

    ``units``: unit, ``features`` (an array of numbers for each source), ``vectors`` (unit vectors; null for a source without) and ``sessions`` (null belongs to none).
    """
    shared = sets.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for row, unit in _units_of(batch, shared.value, budget, limit):
                prefixes = {}
                for item in row["items"]:
                    prefixes.setdefault((item["mask"], item["cost"]), []).append((item["id"], item["next"]))
                out = []
                for (mask, cost), actions in prefixes.items():
                    ids = np.array([i for i, _ in actions])
                    out += [(row["unit"], mask, int(i), after, float(x)) for (i, after), x in zip(actions, unit.logits(ids_in(mask), cost, ids), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["unit", "mask", "id", "next", "logit"])

    kind = f"unit {sets.schema['unit'].dataType.simpleString()}, mask long, id long, next long, logit double"
    scored = _chunks(legal_actions(sets), units).mapInArrow(run, kind)
    over = Window.partitionBy("unit", "mask")  # at most 65 actions
    top = F.max("logit").over(over)
    return scored.withColumn("logp", F.col("logit") - top - F.log(F.sum(F.exp(F.col("logit") - top)).over(over))).drop("logit")


def with_architecture(found: DataFrame, units: DataFrame, weights: Weights, budget: float, limit: float = INPUT_LIMIT) -> DataFrame:
    """Adds ``architecture``, the likeliest feasible one (the first of equals), ``architecture_logp`` and ``joint`` (score and architecture together).

    ``found``: unit, mask, cost, score, ``feasible`` (names of architectures whose exact cost is within the budget). The empty set is Flat. A set without a feasible architecture is left out.
    """
    shared = found.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            out = []
            for row, unit in _units_of(batch, shared.value, budget, limit):
                for item in row["items"]:
                    names = [x for x in ARCHITECTURES if x in item["feasible"]] if item["mask"] else ["Flat"]
                    if not names:
                        continue
                    logits = unit.architectures(ids_in(item["mask"]), item["cost"])[[ARCHITECTURES.index(x) for x in names]]
                    best = int(np.argmax(logits))
                    logp = float(logits[best] - logits.max() - np.log(np.exp(logits - logits.max()).sum()))
                    out.append((row["unit"], item["mask"], item["score"], names[best], logp, item["score"] + logp))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (None, pa.int64(), pa.float64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k or batch.schema.field("unit").type) for c, k in zip(columns, kinds, strict=True)], names=["unit", "mask", "score", "architecture", "architecture_logp", "joint"])

    kind = f"unit {found.schema['unit'].dataType.simpleString()}, mask long, score double, architecture string, architecture_logp double, joint double"
    return _chunks(found.select("unit", "mask", "cost", "score", "feasible"), units).mapInArrow(run, kind)
