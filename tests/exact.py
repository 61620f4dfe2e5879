"""Exact single-machine computations on small tables that the distributed models are measured against."""

import numpy as np


def squared_distances(x):
    found = (x ** 2).sum(1)[:, None] + (x ** 2).sum(1) - 2 * x @ x.T
    np.fill_diagonal(found, 0)
    return np.maximum(found, 0)


def nearest(x, k):
    d = squared_distances(x)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def kept(x, plane, k=15):
    """Share of the k nearest that are among the k nearest in the plane too."""
    return np.mean([len(set(a) & set(b)) for a, b in zip(nearest(x, k), nearest(plane, k))]) / k


def neighbour_plane(x, perplexity=30.0, steps=500):
    """Gradient descent on the divergence between all pairs' chances in space and in the plane."""
    n = len(x)
    d = squared_distances(x)
    np.fill_diagonal(d, np.inf)
    beta, low, high = np.ones(n), np.zeros(n), np.full(n, np.inf)
    for _ in range(60):
        p = np.exp(-d * beta[:, None])
        total = p.sum(1)
        entropy = np.log(total) + beta * (np.where(np.isinf(d), 0, d) * p).sum(1) / total
        more = entropy > np.log(min(perplexity, n - 1))
        low, high = np.where(more, beta, low), np.where(more, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = p / p.sum(1, keepdims=True)
    p = (p + p.T) / (2 * n)
    centred = x - x.mean(0)
    plane = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    plane *= 1e-4 / plane[:, 0].std()
    speed, gain = np.zeros_like(plane), np.ones_like(plane)
    for step in range(steps):
        q = 1 / (1 + squared_distances(plane))
        np.fill_diagonal(q, 0)
        w = ((12 if step < 150 else 1) * p - q / q.sum()) * q
        slope = 4 * (w.sum(1)[:, None] * plane - w @ plane)
        gain = np.where(np.sign(slope) != np.sign(speed), gain + 0.2, gain * 0.8).clip(0.01)
        speed = (0.5 if step < 150 else 0.8) * speed - max(n / 48, 50) * gain * slope
        plane = plane + speed
    return plane


def kernel_machine(gram, sign, c, tolerance=1e-6, steps=200_000):
    """Two-class support vector machine by steps on the pair that violates most: (coefficients, offset)."""
    alpha, slope = np.zeros(len(sign)), -np.ones(len(sign))
    for _ in range(steps):
        up = ((sign > 0) & (alpha < c)) | ((sign < 0) & (alpha > 0))
        down = ((sign > 0) & (alpha > 0)) | ((sign < 0) & (alpha < c))
        score = -sign * slope
        i, j = np.where(up, score, -np.inf).argmax(), np.where(down, score, np.inf).argmin()
        if score[i] - score[j] < tolerance:
            break
        step = (score[i] - score[j]) / max(gram[i, i] + gram[j, j] - 2 * gram[i, j], 1e-12)
        step = min(step, c - alpha[i] if sign[i] > 0 else alpha[i], alpha[j] if sign[j] > 0 else c - alpha[j])
        for k, direction in ((i, 1), (j, -1)):
            change = direction * sign[k] * step
            alpha[k] += change
            slope += change * sign[k] * sign * gram[:, k]
    return alpha * sign, (score[i] + score[j]) / 2


def kernel_votes(train, labels, test, gamma, c):
    """One machine per pair of classes, the class with most votes; the smaller class on ties."""
    classes = np.unique(labels)
    votes = np.zeros((len(test), len(classes)))
    for a in range(len(classes)):
        for b in range(a + 1, len(classes)):
            rows = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
            x = train[rows]
            sign = np.where(labels[rows] == classes[a], 1.0, -1.0)
            coefficients, offset = kernel_machine(np.exp(-gamma * squared_distances(x)), sign, c)
            apart = (test ** 2).sum(1)[:, None] + (x ** 2).sum(1) - 2 * test @ x.T
            score = np.exp(-gamma * np.maximum(apart, 0)) @ coefficients + offset
            votes[:, a] += score > 0
            votes[:, b] += score <= 0
    return classes[votes.argmax(1)]
