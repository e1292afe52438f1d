"""A bidirectional gated recurrent layer in numpy: forward for scoring, forward and backward through time for training.

Arrays are (features, batch) at each step, so that every operation runs over one long contiguous axis.
The gates use a logistic function, the candidate a hyperbolic tangent:
    z = s(Wz x + Uz h + bz),  r = s(Wr x + Ur h + br),  c = tanh(Wc x + Uc (r h) + bc),  h' = h + z (c - h)
"""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


def tanh(x: np.ndarray) -> np.ndarray:
    """By the exponential, which numpy vectorises on more processors; the clip keeps it finite."""
    np.clip(x, -15, 15, out=x)
    x *= -2
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    x *= 2
    x -= 1
    return x


def new_layer(rng: np.random.Generator, inputs: int, hidden: int) -> dict[str, np.ndarray]:
    """Weights of one direction: W (3H, inputs), U (3H, H), b (3H); rows are z, r, c."""
    return {
        "W": (rng.standard_normal((3 * hidden, inputs)) / np.sqrt(inputs)).astype(np.float32),
        "U": (rng.standard_normal((3 * hidden, hidden)) * 0.5 / np.sqrt(hidden)).astype(np.float32),
        "b": np.zeros((3 * hidden, 1), np.float32),
    }


def step(layer: dict[str, np.ndarray], inner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """inner is W x + b. Returns the next state and z, r, c."""
    n = h.shape[0]
    zr = layer["U"][: 2 * n] @ h
    zr += inner[: 2 * n]
    zr = logistic(zr)
    z, r = zr[:n], zr[n:]
    c = layer["U"][2 * n :] @ (r * h)
    c += inner[2 * n :]
    c = tanh(c)
    return h + z * (c - h), z, r, c


def run(layer: dict[str, np.ndarray], inner, steps: range, batch: int, keep: bool = False):
    """States after each step in the order of steps; inner(t) gives W x_t + b. keep: also what backward needs."""
    h = np.zeros((layer["U"].shape[1], batch), np.float32)
    states, tape = {}, []
    for t in steps:
        after, z, r, c = step(layer, inner(t), h)
        if keep:
            tape.append((t, h, z, r, c))
        states[t] = h = after
    return states, tape


def backward(layer: dict[str, np.ndarray], tape: list, into, inputs) -> dict[str, np.ndarray]:
    """Gradients of the layer. into(t): gradient that reaches the state after step t; inputs(t, g): called with the gradient of W x_t + b, returns x_t for W's gradient or None."""
    grad = {k: np.zeros_like(v) for k, v in layer.items()}
    n = layer["U"].shape[1]
    flow = 0
    for t, h, z, r, c in reversed(tape):
        g = into(t) + flow
        gc = g * z * (1 - c * c)
        gz = g * (c - h) * z * (1 - z)
        grh = layer["U"][2 * n :].T @ gc
        gr = grh * h * r * (1 - r)
        inner = np.concatenate([gz, gr, gc])
        grad["U"][: 2 * n] += inner[: 2 * n] @ h.T
        grad["U"][2 * n :] += gc @ (r * h).T
        grad["b"] += inner.sum(1, keepdims=True)
        x = inputs(t, inner)
        if x is not None:
            grad["W"] += inner @ x.T
        flow = g * (1 - z) + grh * r + layer["U"][: 2 * n].T @ inner[: 2 * n]
    return grad


class Adam:
    """Adaptive steps for a flat dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.n = weights, rate, 0
        self.one = {k: np.zeros_like(v) for k, v in weights.items()}
        self.two = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.n += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        cut = min(1.0, 1.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * cut
            self.one[k] += 0.1 * (g - self.one[k])
            self.two[k] += 0.01 * (g * g - self.two[k])
            self.weights[k] -= (scale * self.rate * (self.one[k] / (1 - 0.9**self.n)) / (np.sqrt(self.two[k] / (1 - 0.99**self.n)) + 1e-8)).astype(np.float32)
