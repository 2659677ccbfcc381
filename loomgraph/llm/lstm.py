"""A bidirectional LSTM with one logistic output per step, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BiLstm:
    """`ahead` and `back` are (input, recurrent, bias) of one direction, gates in the order i, f, o, g."""

    ahead: list[np.ndarray]
    back: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(inputs: int, hidden: int, seed: int) -> BiLstm:
        rng = np.random.default_rng(seed)

        def one() -> list[np.ndarray]:
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            return [
                rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden)).astype(np.float32),
                rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32),
                bias,
            ]

        return BiLstm(one(), one(), rng.normal(0, 0.1, 2 * hidden).astype(np.float32), np.zeros(1, np.float32))

    @property
    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead, *self.back, self.out, self.bias]

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities for `x` (steps, rows, inputs); `mask` (steps, rows) is 0 behind a row's end."""
        h, _ = _run(self.ahead, x, mask)
        back, _ = _run(self.back, x[::-1], mask[::-1])
        return _sigmoid(np.concatenate((h, back[::-1]), axis=2) @ self.out + self.bias)

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the logistic loss, averaged over the steps that count."""
        ahead, saved_ahead = _run(self.ahead, x, mask)
        back, saved_back = _run(self.back, x[::-1], mask[::-1])
        both = np.concatenate((ahead, back[::-1]), axis=2)
        wrong = (_sigmoid(both @ self.out + self.bias) - target) * mask / mask.sum()
        d_both = wrong[:, :, None] * self.out
        n = ahead.shape[2]
        g_ahead = _gradient(self.ahead, x, mask, saved_ahead, d_both[:, :, :n])
        g_back = _gradient(self.back, x[::-1], mask[::-1], saved_back, d_both[::-1, :, n:])
        return [*g_ahead, *g_back, np.tensordot(wrong, both, ((0, 1), (0, 1))), np.array([wrong.sum()])]


def _run(weights: list[np.ndarray], x: np.ndarray, mask: np.ndarray):
    into, again, bias = weights
    steps, rows, _ = x.shape
    n = again.shape[0]
    given = x @ into + bias
    h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
    hs, saved = np.zeros((steps, rows, n), np.float32), []
    for t in range(steps):
        z = given[t] + h @ again
        gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        m = mask[t][:, None]
        cell = f * c + i * g
        bent = np.tanh(cell)
        saved.append((i, f, o, g, c, bent, h))
        # Behind its end a row keeps its state, so that the other direction starts from zero.
        c, h = m * cell + (1 - m) * c, m * (o * bent) + (1 - m) * h
        hs[t] = h
    return hs, saved


def _gradient(weights, x, mask, saved, d_hs) -> list[np.ndarray]:
    into, again, _ = weights
    steps, rows, _ = x.shape
    n = again.shape[0]
    d_z = np.zeros((steps, rows, 4 * n), np.float32)
    d_again = np.zeros_like(again)
    d_h, d_c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
    for t in reversed(range(steps)):
        i, f, o, g, before, bent, h_before = saved[t]
        m = mask[t][:, None]
        d_h = d_h + d_hs[t]
        d_out, d_cell = d_h * m, d_c * m
        d_cell = d_cell + d_out * o * (1 - bent**2)
        d_z[t] = np.concatenate(
            (d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d_out * bent * o * (1 - o), d_cell * i * (1 - g**2)),
            axis=1,
        )
        d_again += h_before.T @ d_z[t]
        d_h = d_h * (1 - m) + d_z[t] @ again.T
        d_c = d_c * (1 - m) + d_cell * f
    return [np.tensordot(x, d_z, ((0, 1), (0, 1))), d_again, d_z.sum(axis=(0, 1))]


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences side by side, (steps, rows, inputs), and their mask."""
    steps = max(len(r) for r in rows)
    x = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(rows)), np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


def train(
    sequences: list[np.ndarray], labels: list[np.ndarray], hidden: int, epochs: int, seed: int = 5, rows: int = 32
) -> BiLstm:
    """Fit by Adam on minibatches of sequences of similar length."""
    model = BiLstm.new(sequences[0].shape[1], hidden, seed)
    rng = np.random.default_rng(seed)
    order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
    batches = [order[k : k + rows] for k in range(0, len(order), rows)]
    first = [np.zeros_like(p) for p in model.parameters]
    second = [np.zeros_like(p) for p in model.parameters]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for b in rng.permutation(len(batches)):
            x, mask = padded([sequences[k] for k in batches[b]])
            target = np.zeros(mask.shape, np.float32)
            for at, k in enumerate(batches[b]):
                target[: len(labels[k]), at] = labels[k]
            step += 1
            for p, g, m, v in zip(model.parameters, model.gradients(x, mask, target), first, second, strict=True):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model
