"""A bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _forward(table: np.ndarray, u: np.ndarray, c: np.ndarray, seqs: np.ndarray, keep: bool = False):
    """States (time, row, unit) of one direction over ``seqs`` (row, time) of bytes.

    ``table`` holds, for each byte, its part of the update gate, reset gate and candidate;
    ``u`` and ``c`` are the recurrent weights and the candidate's bias inside the reset.
    """
    h_size = u.shape[0]
    h = np.zeros((len(seqs), h_size), table.dtype)
    states, kept = [], []
    for t in range(seqs.shape[1]):
        x, a = table[seqs[:, t]], h @ u
        gates = _sigmoid(x[:, : 2 * h_size] + a[:, : 2 * h_size])
        z, r = gates[:, :h_size], gates[:, h_size:]
        inner = a[:, 2 * h_size :] + c
        n = np.tanh(x[:, 2 * h_size :] + r * inner)
        if keep:
            kept.append((h, z, r, inner, n))
        h = n + z * (h - n)
        states.append(h)
    return np.stack(states), kept


def _states(table: np.ndarray, u: np.ndarray, c: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """As ``_forward``, of ``steps`` (time, row): states (time, unit, row), computed in place for speed."""
    units, (length, rows) = u.shape[0], steps.shape
    sign = np.repeat(np.array([-1, -1, 1], table.dtype), units)[:, None]  # gates are 1 / (1 + exp(-x))
    table, u, c = np.ascontiguousarray(table.T * sign), np.ascontiguousarray(u.T * sign), c[:, None]
    out = np.empty((length, units, rows), table.dtype)
    x, a = np.empty((3 * units, rows), table.dtype), np.empty((3 * units, rows), table.dtype)
    gates, h = np.empty((2 * units, rows), table.dtype), np.zeros((units, rows), table.dtype)
    for t in range(length):
        n = out[t]
        np.take(table, steps[t], axis=1, out=x, mode="clip")
        np.matmul(u, h, out=a)
        np.add(x[: 2 * units], a[: 2 * units], out=gates)
        np.minimum(gates, 80, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.add(a[2 * units :], c, out=n)
        n *= gates[units:]
        n += x[2 * units :]
        np.tanh(n, out=n)
        h = h - n
        h *= gates[:units]
        n += h
        h = n
    return out


def _backward(table: np.ndarray, u: np.ndarray, seqs: np.ndarray, kept: list, d_states: np.ndarray):
    """Gradients of ``table``, ``u`` and ``c`` by backpropagation through time."""
    h_size = u.shape[0]
    d_table, d_u, d_c = np.zeros_like(table), np.zeros_like(u), np.zeros(h_size, table.dtype)
    d_h = np.zeros_like(d_states[0])
    for t in range(seqs.shape[1] - 1, -1, -1):
        h, z, r, inner, n = kept[t]
        d_h = d_h + d_states[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z = d_h * (h - n) * z * (1 - z)
        d_inner = d_n * r
        d_r = d_n * inner * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_n], axis=1)
        d_a = np.concatenate([d_z, d_r, d_inner], axis=1)
        np.add.at(d_table, seqs[:, t], d_x)
        d_u += h.T @ d_a
        d_c += d_inner.sum(axis=0)
        d_h = d_h * z + d_a @ u.T
    return d_table, d_u, d_c


@dataclass
class ByteGru:
    """Parameters: input table, recurrent weights and bias of each direction, and the output layer."""

    labels: list[str]
    params: list[np.ndarray]

    @classmethod
    def new(cls, labels: list[str], units: int, rng: np.random.Generator) -> ByteGru:
        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        one = [
            p
            for _ in range(2)
            for p in (normal(256, 3 * units, scale=0.3), normal(units, 3 * units, scale=units**-0.5), normal(units, scale=0))
        ]
        return cls(labels, [*one, normal(2 * units, len(labels), scale=units**-0.5), normal(len(labels), scale=0)])

    def _logits(self, seqs: np.ndarray, keep: bool = False):
        tf, uf, cf, tb, ub, cb, w, b = self.params
        ahead, kept_f = _forward(tf, uf, cf, seqs, keep)
        back, kept_b = _forward(tb, ub, cb, seqs[:, ::-1], keep)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return both @ w + b, both, kept_f, kept_b

    def label_sums(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum of the labels' log probabilities over the first ``lengths`` bytes of each window: (row, label)."""
        tf, uf, cf, tb, ub, cb, w, b = self.params
        steps, units = windows.T.astype(np.intp), uf.shape[0]
        ahead, back = _states(tf, uf, cf, steps), _states(tb, ub, cb, steps[::-1])
        w_ahead, w_back = np.ascontiguousarray(w[:units].T), np.ascontiguousarray(w[units:].T)
        total = np.zeros((len(self.labels), len(windows)))
        for t in range(len(steps)):
            logits = w_ahead @ ahead[t] + w_back @ back[-1 - t] + b[:, None]
            logits -= logits.max(axis=0)
            logits -= np.log(np.exp(logits).sum(axis=0))
            total += logits * (t < lengths)
        return total.T

    def gradients(self, seqs: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Weighted cross-entropy, and its gradients; ``weights`` are for each position (row, time)."""
        units = self.params[1].shape[0]
        logits, both, kept_f, kept_b = self._logits(seqs, keep=True)
        logits -= logits.max(axis=2, keepdims=True)
        probs = np.exp(logits)
        probs /= probs.sum(axis=2, keepdims=True)
        share = (weights / weights.sum()).T.astype(np.float32)
        rows = np.arange(len(seqs))
        loss = float(-(np.log(probs[:, rows, labels] + 1e-12) * share).sum())
        probs[:, rows, labels] -= 1
        d_logits = probs * share[:, :, None]
        d_w = np.einsum("trh,trl->hl", both, d_logits, optimize=True)
        d_both = d_logits @ self.params[6].T
        ahead = _backward(self.params[0], self.params[1], seqs, kept_f, d_both[:, :, :units])
        back = _backward(self.params[3], self.params[4], seqs[:, ::-1], kept_b, d_both[::-1, :, units:])
        return loss, [*ahead, *back, d_w, d_logits.sum(axis=(0, 1))]

    def train(
        self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int, batch: int, rate: float,
        rng: np.random.Generator,
    ) -> float:
        """Adam over batches of byte windows, of which the first ``lengths`` bytes count; returns the last epoch's mean loss."""
        inside = np.arange(windows.shape[1]) < lengths[:, None]
        first, second, step, mean = [0.0] * len(self.params), [0.0] * len(self.params), 0, 0.0
        total = epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order, losses = rng.permutation(len(windows)), []
            for i in range(0, len(order), batch):
                take = order[i : i + batch]
                loss, grads = self.gradients(windows[take], labels[take], weights[take, None] * inside[take])
                losses.append(loss)
                step += 1
                pace = rate * (1 - (step - 1) / total)
                for j, g in enumerate(grads):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.99 * second[j] + 0.01 * g * g
                    change = first[j] / (1 - 0.9**step) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)
                    self.params[j] = (self.params[j] - pace * change).astype(np.float32)
            mean = float(np.mean(losses))
        return mean
