"""Limited-memory BFGS for the small smooth problems of the two classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimize(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 60, memory: int = 8, tolerance: float = 1e-6) -> np.ndarray:
    """The point that ``steps`` quasi-Newton steps with a halving line search reach."""
    x = start.astype(np.float64)
    value, grad = loss(x)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(grad).max(initial=0.0) < tolerance:
            break
        way, used = grad.copy(), []
        for s, y, r in reversed(history):
            a = r * (s @ way)
            used.append(a)
            way -= a * y
        if history:
            s, y, _ = history[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(history, reversed(used)):
            way += (a - r * (y @ way)) * s
        slope, size = -(grad @ way), 1.0 if history else 1.0 / max(1.0, float(np.abs(grad).sum()))
        if slope >= 0:
            way, slope = grad.copy(), -(grad @ grad)
        for _ in range(25):
            new_x = x - size * way
            new_value, new_grad = loss(new_x)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new_x - x, new_grad - grad
        if s @ y > 1e-12:
            history = [*history[-(memory - 1) :], (s, y, 1.0 / (s @ y))]
        x, value, grad = new_x, new_value, new_grad
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def softplus(z: np.ndarray) -> np.ndarray:
    """log(1 + exp(z))."""
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))
