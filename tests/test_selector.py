"""The selector network against plain loops over numbers, and its decoding against a loop over prefixes."""

import math

import numpy as np
import pytest

from memloom.jobs import selection
from memloom.operators import policy, selector
from memloom.operators.structure import ARCHITECTURES

SF = "/root/testdata/sf0.001"


def linear(w, name, x, offset=True):
    return [sum(a * b for a, b in zip(row, x)) + (w[name + "_b"][i] if offset else 0) for i, row in enumerate(w[name].tolist())]


def norm(w, name, x):
    mean = sum(x) / len(x)
    var = sum((v - mean) ** 2 for v in x) / len(x)
    return [(v - mean) / math.sqrt(var + 1e-5) * w[name][i] + w[name + "_b"][i] for i, v in enumerate(x)]


def encode(w, features):
    xs, heads = [linear(w, "input", f) for f in features], int(w["heads"])
    width = len(xs[0])
    part = width // heads
    for k in range(int(w["layers"])):
        qkv = [linear(w, f"qkv{k}", norm(w, f"norm{k}a", x)) for x in xs]
        mixed = []
        for i in range(len(xs)):
            row = []
            for h in range(heads):
                at = range(h * part, (h + 1) * part)
                s = [math.exp(sum(qkv[i][c] * qkv[j][width + c] for c in at) / math.sqrt(part)) for j in range(len(xs))]
                row += [sum(s[j] * qkv[j][2 * width + c] for j in range(len(xs))) / sum(s) for c in at]
            mixed.append(row)
        xs = [[a + b for a, b in zip(x, linear(w, f"out{k}", m))] for x, m in zip(xs, mixed)]
        up = [linear(w, f"up{k}", norm(w, f"norm{k}b", x)) for x in xs]
        xs = [[a + b for a, b in zip(x, linear(w, f"down{k}", [v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in u]))] for x, u in zip(xs, up)]
    return xs


class Loop:
    def __init__(self, w, row, budget, limit):
        self.w, self.row, self.budget, self.limit = w, row, budget, limit
        self.x = encode(w, row.features)
        self.width = len(self.x[0])
        self.mean = [sum(x[c] for x in self.x) / row.n for c in range(self.width)]

    def cost(self, ids):
        return sum(self.row.costs[i - 1] for i in ids)

    def spare(self, ids):
        return [self.budget / self.limit, max(self.budget - self.cost(ids), 0) / self.budget]

    def state(self, prefix):
        h = [math.tanh(v) for v in linear(self.w, "start", self.mean + [self.budget / self.limit, 1.0] + [0.0] * self.width)]
        sig = lambda v: 1 / (1 + math.exp(-v))
        for i in prefix:
            a, b = linear(self.w, "gru_x", self.x[i - 1]), linear(self.w, "gru_h", h)
            n = self.width
            h = [(1 - sig(a[n + c] + b[n + c])) * math.tanh(a[2 * n + c] + sig(a[c] + b[c]) * b[2 * n + c]) + sig(a[n + c] + b[n + c]) * h[c] for c in range(n)]
        return h

    def logps(self, prefix):
        w, row = self.w, self.row
        shared = [a + b for a, b in zip(linear(w, "state", self.state(prefix), False), linear(w, "budget", self.spare(prefix), False))]
        score = lambda xs: sum(s * math.tanh(v) for s, v in zip(w["score"], xs))
        out = {}
        for i in [0, *range((prefix or (0,))[-1] + 1, row.n + 1)]:
            if i and self.cost((*prefix, i)) > self.budget:
                continue
            out[i] = score([a + b for a, b in zip(linear(w, "action", self.x[i - 1] if i else w["stop"].tolist(), False), shared)])
            if i:
                near = [sum(a * b for a, b in zip(row.vectors[i - 1], row.vectors[j - 1])) for j in prefix if row.vectors[i - 1] and row.vectors[j - 1]]
                same = any(row.sessions[i - 1] is not None and row.sessions[i - 1] == row.sessions[j - 1] for j in prefix)
                out[i] += score(linear(w, "dynamic", [1.0, max(near, default=0.0), float(same), len(prefix) / row.n], False))
        total = math.log(sum(math.exp(v) for v in out.values()))
        return {i: v - total for i, v in out.items()}

    def joint(self, width, dearer):
        active, done = [((), 0.0)], []
        while active:
            grown = []
            for prefix, score in active:
                for i, logp in self.logps(prefix).items():
                    (grown if i else done).append(((*prefix, i) if i else prefix, score + logp))
            active = sorted(grown, key=lambda x: (-round(x[1], 9), x[0]))[:width]
        found = []
        for ids, score in sorted(done, key=lambda x: (-round(x[1], 9), x[0]))[:width]:
            names = [g for k, g in enumerate(ARCHITECTURES) if self.cost(ids) + dearer * k * len(ids) <= self.budget] if ids else ["Flat"]
            chosen = [sum(self.x[i - 1][c] for i in ids) / len(ids) for c in range(self.width)] if ids else [0.0] * self.width
            logits = dict(zip(ARCHITECTURES, linear(self.w, "head", self.mean + chosen + self.spare(ids))))
            if names:
                best = max(names, key=lambda g: logits[g])
                found.append((score + logits[best] - math.log(sum(math.exp(logits[g]) for g in names)), ids, best))
        top = max(round(x[0], 9) for x in found)
        return min((x for x in found if round(x[0], 9) == top), key=lambda x: x[1])


@pytest.fixture(scope="module")
def scored(spark):
    units, sets, actions, weights = selection._scored(spark, SF)
    return {r.unit: r for r in units.collect()}, sets, actions, weights


def test_log_probabilities_are_those_of_a_loop(spark, scored):
    units, sets, actions, weights = scored
    rows = actions.collect()
    some = sorted(units)[:6]
    for u in some:
        loop = Loop(weights, units[u], selection.BUDGET, selector.INPUT_LIMIT)
        masks = {r.mask for r in rows if r.unit == u}
        assert len(masks) > 1
        for mask in masks:
            got = {r.id: r.logp for r in rows if r.unit == u and r.mask == mask}
            assert got == pytest.approx(loop.logps(selector.ids_in(mask)), abs=1e-9)
    assert {len(v or []) for u in some for v in units[u].vectors} == {0, 64} or all(v for u in some for v in units[u].vectors)
    total = policy.sequence_logps(sets, actions).groupBy("unit").agg({"logp": "count"}).count()
    assert total == len(units)


def test_joint_choice_is_that_of_a_loop(spark, scored):
    units, _, _, weights = scored
    got = {r.unit: r for r in selection.selector_joint(spark, SF).collect()}
    assert set(got) == set(units)
    for u, row in units.items():
        joint, ids, architecture = Loop(weights, row, selection.BUDGET, selector.INPUT_LIMIT).joint(selection.WIDTH, 9)
        assert (selector.ids_in(got[u].mask), got[u].architecture, got[u].joint) == (ids, architecture, pytest.approx(joint, abs=2e-6))


def test_one_source_without_vector_or_session():
    w = selector.random_weights(2, width=8, heads=2, hidden=8, layers=1)
    unit = selector.Unit(w, [[1.0, 2.0]], [None], [None], 10, 100)
    assert np.isfinite(unit.logits((), 0, np.array([0, 1]))).all() and np.isfinite(unit.logits((1,), 5, np.array([0]))).all()
