"""A small causal self-attention model over subword ids, trained and run in numpy.

One layer, one head: token and position embeddings, attention with a causal mask, a residual, and a softmax over the
`heads` most frequent subwords and one symbol for all others, whose share is split by their corpus frequency. Texts
are read in windows of `WINDOW` subwords that overlap by `OVERLAP`; a window scores what its predecessor did not, so
each subword is scored once, with at least OVERLAP subwords before it where the text has them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.llm import textbytes as tb

WINDOW, OVERLAP, WIDTH = 32, 8, 16
#: Rows of outputs that are worked on at once, so that they stay in a core's cache.
BLOCK = 1024


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    """The weights one after another, by name."""
    return np.concatenate([weights[name].ravel() for name in sorted(weights)]).astype(np.float64)


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([0, *(like[name].size for name in sorted(like))])
    return {name: values[a:b].reshape(like[name].shape).astype(np.float32) for name, a, b in zip(sorted(like), cuts[:-1], cuts[1:], strict=True)}


@dataclass(frozen=True)
class AttentionModel:
    """places: the place of each subword id by frequency, the last one shared by all rare ids; the first `heads` places
    have an output of their own; tail: natural log share of each id among the others."""

    places: np.ndarray
    heads: int
    tail: np.ndarray
    weights: dict[str, np.ndarray]

    def log_probabilities(self, ids: np.ndarray, first: np.ndarray, batch: int = 48) -> np.ndarray:
        """The natural log-probability of every id given those before it in its row. Row r holds ids[first[r]:first[r + 1]]."""
        out = np.zeros(len(ids), np.float32)
        if not len(ids):
            return out
        x, target, where = windows(ids, first, self.places, self.heads)
        w = self.weights
        # Queries against embeddings, and values as outputs, are one product each, looked up by place.
        into = np.concatenate((w["Wq"] @ w["Wk"].T * np.float32(1 / np.sqrt(WIDTH)), w["Wv"] @ w["Wo"]), axis=1)
        tokens, positions = (np.concatenate((w[n], w[n] @ into), axis=1) for n in ("E", "P"))
        upper = np.concatenate((w["U"], w["b"][None, :]))
        causal = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        ones = np.ones(max(self.heads + 1, WINDOW), np.float32)
        later = (where[:, :OVERLAP] < 0).all(1)  # these need no outputs where they overlap
        for of, skip in ((np.flatnonzero(later), OVERLAP), (np.flatnonzero(~later), 0)):
            mask = causal[skip:]
            for begin in range(0, len(of), batch):
                some = of[begin : begin + batch]
                all_ = tokens.take(x[some], 0)
                all_ += positions
                e, q, v = all_[:, :, :WIDTH], all_[:, skip:, WIDTH : 2 * WIDTH], all_[:, :, 2 * WIDTH :]
                a = np.matmul(q, e.transpose(0, 2, 1))
                if max(a.max(initial=0), -a.min(initial=0)) > 60:  # else exp is in range without a shift
                    a -= np.where(mask > 0, a, -np.inf).max(2, keepdims=True)
                    np.minimum(a, 0, out=a)
                np.exp(a, out=a)
                a *= mask
                mixed = np.matmul(a, v)
                mixed /= (a.reshape(-1, WINDOW) @ ones[:WINDOW]).reshape(len(some), -1, 1)
                mixed += e[:, skip:]
                goal = where[some, skip:].ravel()
                scored = np.flatnonzero(goal >= 0)
                goal, wants = goal[scored], target[some, skip:].ravel()[scored]
                # The last column makes the bias a row of the output weights.
                h = np.ones((len(scored), WIDTH + 1), np.float32)
                h[:, :WIDTH] = mixed.reshape(-1, WIDTH).take(scored, 0)
                for at in range(0, len(h), BLOCK):
                    z = h[at : at + BLOCK] @ upper
                    wanted = z[np.arange(len(z)), wants[at : at + BLOCK]]
                    if z.max(initial=0) > 60 or z.min(initial=0) < -60:
                        top = z.max(1)
                        z -= top[:, None]
                        wanted = wanted - top
                    np.exp(z, out=z)
                    out[goal[at : at + BLOCK]] = wanted - np.log(z @ ones[: self.heads + 1])
        outside = np.minimum(self.places[ids], self.heads) == self.heads
        out[outside] += self.tail[ids[outside]]
        return out


def windows(ids: np.ndarray, first: np.ndarray, places: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets (places) and the index of each target in ids, or -1 where a window does not score it. An input is
    the subword before its target; a row starts with the place for the start, which is the last one."""
    heads_and_rest = places[ids]
    start = places.max() + 1
    before = np.concatenate(([start], heads_and_rest[:-1]))
    lengths = np.diff(first)
    before[first[:-1][lengths > 0]] = start
    step = WINDOW - OVERLAP
    many = np.where(lengths > 0, np.maximum(1, -(-(lengths - OVERLAP) // step)), 0)
    row = np.repeat(np.arange(len(lengths)), many)
    nth = tb.ranges(np.zeros(len(many), np.int64), many)
    begin = first[:-1][row] + nth * step
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < first[1:][row][:, None]
    safe = np.where(inside, at, 0)
    scored = inside & ((nth == 0)[:, None] | (np.arange(WINDOW) >= OVERLAP))
    return np.where(inside, before[safe], start), np.minimum(heads_and_rest[safe], heads), np.where(scored, at, -1)


def train(
    x: np.ndarray, target: np.ndarray, scored: np.ndarray, places: int, outputs: int, steps: int = 500, batch: int = 128, rate: float = 8e-3, seed: int = 3, start: dict[str, np.ndarray] | None = None,
) -> dict[str, np.ndarray]:
    """Weights after `steps` of Adam on windows x (place ids), their targets and which of them count, from `start` or afresh. No window is
    seen again before all were."""
    rng = np.random.default_rng(seed)
    new = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    w = {"E": new(places, WIDTH), "P": new(WINDOW, WIDTH), "Wq": new(WIDTH, WIDTH), "Wk": new(WIDTH, WIDTH), "Wv": new(WIDTH, WIDTH), "Wo": new(WIDTH, WIDTH), "U": new(WIDTH, outputs), "b": np.zeros(outputs, np.float32)}
    if start is not None:
        w = {name: value.copy() for name, value in start.items()}
    if not len(x):
        return w
    share = np.bincount(target[scored], minlength=outputs) + 0.5
    if start is None:
        w["b"] += np.log(share / share.sum()).astype(np.float32)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    causal = np.tril(np.ones((WINDOW, WINDOW), np.float32))
    scale = np.float32(1 / np.sqrt(WIDTH))
    ones = np.ones(max(outputs, WINDOW), np.float32)
    cube = lambda m: m.reshape(-1, WINDOW, WIDTH)
    cube3 = lambda m: m.reshape(-1, WINDOW, 3 * WIDTH)
    flat = lambda m: m.reshape(-1, WIDTH)
    order, at = np.zeros(0, np.int64), 0
    for step in range(1, steps + 1):
        # Each round goes over all windows once, in an order of its own.
        if at >= len(order):
            order, at = rng.permutation(len(x)), 0
        chosen = order[at : at + batch]
        at += batch
        part, count = x[chosen].ravel(), np.flatnonzero(scored[chosen])
        goal = target[chosen].ravel()[count]
        e = flat(cube(w["E"].take(part, 0)) + w["P"])
        into = np.concatenate((w["Wq"] * scale, w["Wk"], w["Wv"]), axis=1)
        all_ = e @ into
        q, k, v = (cube3(all_)[:, :, c : c + WIDTH] for c in (0, WIDTH, 2 * WIDTH))
        a = np.matmul(q, k.transpose(0, 2, 1))
        if max(a.max(initial=0), -a.min(initial=0)) > 60:  # else exp is in range without a shift
            a -= np.where(causal > 0, a, -np.inf).max(2, keepdims=True)
            np.minimum(a, 0, out=a)
        np.exp(a, out=a)
        a *= causal
        a /= (a.reshape(-1, WINDOW) @ ones[:WINDOW]).reshape(-1, WINDOW, 1)
        mixed = flat(np.matmul(a, v))
        # The last column makes the bias a row of the output weights.
        h = np.ones((len(count), WIDTH + 1), np.float32)
        h[:, :WIDTH] = (e + mixed @ w["Wo"]).take(count, 0)
        upper = np.concatenate((w["U"], w["b"][None, :]))
        back = np.ascontiguousarray(w["U"].T)
        dh, g_upper = np.zeros_like(e), np.zeros_like(upper)
        share_of = np.float32(1 / max(1, len(count)))
        for begin in range(0, len(count), BLOCK):
            # The block's exponentials stay as they are: their sums divide what is taken from them.
            some = h[begin : begin + BLOCK]
            z = some @ upper
            if z.max(initial=0) > 60 or z.min(initial=0) < -60:
                z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            total = z @ ones[:outputs]
            z[np.arange(len(z)), goal[begin : begin + BLOCK]] -= total
            by = (share_of / total)[:, None]
            g_upper += (some * by).T @ z
            dh[count[begin : begin + BLOCK]] = (z @ back) * by
        g = {"U": g_upper[:WIDTH], "b": g_upper[WIDTH]}
        g["Wo"] = mixed.T @ dh
        d_mixed = cube(dh @ w["Wo"].T)
        d_s = np.matmul(d_mixed, v.transpose(0, 2, 1))
        # The rows' sums of a * d_a are those of the mixed values.
        d_s -= ((flat(d_mixed) * mixed) @ ones[:WIDTH]).reshape(-1, WINDOW, 1)
        d_s *= a
        d_all = np.empty_like(all_)
        d_q, d_k, d_v = (cube3(d_all)[:, :, c : c + WIDTH] for c in (0, WIDTH, 2 * WIDTH))
        np.matmul(d_s, k, out=d_q)
        np.matmul(d_s.transpose(0, 2, 1), q, out=d_k)
        np.matmul(a.transpose(0, 2, 1), d_mixed, out=d_v)
        de = dh + d_all @ into.T
        g_into = e.T @ d_all
        g["Wq"], g["Wk"], g["Wv"] = g_into[:, :WIDTH] * scale, g_into[:, WIDTH : 2 * WIDTH], g_into[:, 2 * WIDTH :]
        g["P"] = cube(de).sum(0)
        g["E"] = np.bincount((part[:, None] * WIDTH + np.arange(WIDTH)).ravel(), de.ravel(), places * WIDTH).reshape(places, WIDTH).astype(np.float32)
        pace = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for name, grad in g.items():
            mean[name] += np.float32(0.1) * (grad - mean[name])
            square[name] += np.float32(0.01) * (grad * grad - square[name])
            w[name] -= np.float32(pace / (1 - 0.9**step)) * mean[name] / (np.sqrt(square[name] * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-8))
    return w
