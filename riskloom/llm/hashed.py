"""Hashed n-gram features of texts and linear classifiers on them."""

from __future__ import annotations

import numpy as np

# Non-letters of ASCII as blanks, for features that should see words only.
LETTERS_ONLY = bytes(i if chr(i).isalpha() or i > 127 else 32 for i in range(256))


def byte_ngrams(data: list[bytes], n: int, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bin) of each n-gram of bytes that lies within one text; a blank stands at either end."""
    raw = np.frombuffer(b"".join(b" " + d + b" " for d in data), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 2
    if len(raw) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(data)), sizes)
    h = raw[: len(raw) - n + 1].copy()
    for k in range(1, n):
        h *= np.uint32(0x01000193)
        h += raw[k : len(raw) - n + 1 + k]
    h ^= np.uint32(seed * 0x9E3779B1 & 0xFFFFFFFF)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    inside = doc[: len(h)] == doc[n - 1 :]
    return doc[: len(h)][inside], (h[inside] >> np.uint32(32 - bits)).astype(np.int64)


def frequencies(doc: np.ndarray, bins: np.ndarray, docs: int, bits: int) -> np.ndarray:
    """docs x 2**bits: square roots of the share of each bin, so that each row has length 1 (or 0)."""
    counts = np.bincount((doc << bits) + bins, minlength=docs << bits).reshape(docs, 1 << bits).astype(np.float32)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1))


def rows_of(data: list[bytes]) -> np.ndarray:
    """A matrix from rows of half-precision bytes; `data` is emptied on the way."""
    x = np.empty((len(data), len(data[0]) // 2), np.float32)
    for i in range(len(data)):
        x[i] = np.frombuffer(data[i], np.float16)
        data[i] = b""
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights of logistic regressions, a column per column of y (each -1 or 1), the bias in the last row.

    Accelerated gradient descent with a step from the largest eigenvalue; it has no random part.
    """
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    v, bias = np.ones(x.shape[1], np.float32), np.float32(1)
    for _ in range(20):
        u = weight[:, 0] * (x @ v + bias)
        v, bias = x.T @ u, u.sum()
        top = float(np.sqrt(v @ v + bias * bias))
        v, bias = v / max(top, 1e-30), bias / max(top, 1e-30)
    step = 1 / (0.25 * top * 1.05 + ridge)
    w = last = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    for k in range(rounds):
        at = w + (k / (k + 3)) * (w - last)
        pull = weight * (-y / (1 + np.exp(np.clip(y * linear(x, at), -30, 30))))
        slope = np.concatenate([x.T @ pull + ridge * at[:-1], pull.sum(axis=0, keepdims=True)])
        last, w = w, (at - step * slope).astype(np.float32)
    return w


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
