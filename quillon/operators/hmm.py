"""A Gaussian hidden Markov model."""

from __future__ import annotations

import numpy as np


def _log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covs, strict=True)):
        root = np.linalg.cholesky(c)
        z = np.linalg.solve(root, (x - m).T)
        out[:, k] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class GaussianHmm:
    """Baum-Welch on standardised rows; the best likelihood of several seeds. Full or diagonal covariances."""

    def __init__(
        self, states: int = 3, rounds: int = 100, tolerance: float = 1e-4, floor: float = 1e-3, diagonal: bool = False
    ):
        self.states, self.rounds, self.tolerance, self.floor, self.diagonal = states, rounds, tolerance, floor, diagonal

    def fit(self, x: np.ndarray, seeds: tuple[int, ...] = (7, 17, 29)) -> GaussianHmm:
        best = -np.inf
        for seed in seeds:
            found, likelihood = self._fit_one(x, np.random.default_rng(seed))
            if likelihood > best:
                best, (self.start, self.step, self.means, self.covs) = likelihood, found
        return self

    def _fit_one(self, x, rng):
        n, d, k = len(x), x.shape[1], self.states
        means = x[rng.choice(n, k, replace=False)]
        for _ in range(10):
            own = ((x[:, None] - means) ** 2).sum(axis=2).argmin(axis=1)
            means = np.array([x[own == j].mean(axis=0) if (own == j).any() else means[j] for j in range(k)])
        covs = np.array([np.cov(x.T).reshape(d, d) + self.floor * np.eye(d)] * k)
        start, step, last = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)), -np.inf
        np.fill_diagonal(step, 0.9)
        for _ in range(self.rounds):
            density = _log_density(x, means, covs)
            forward, back, log_step = np.empty((n, k)), np.zeros((n, k)), np.log(step + 1e-300)
            forward[0] = np.log(start + 1e-300) + density[0]
            for t in range(1, n):
                forward[t] = _log_sum(forward[t - 1][:, None] + log_step, 0) + density[t]
            for t in range(n - 2, -1, -1):
                back[t] = _log_sum(log_step + density[t + 1] + back[t + 1], 1)
            total = float(_log_sum(forward[-1], 0))
            gamma = np.exp(forward + back - total)
            xi = np.exp(forward[:-1, :, None] + log_step + (density[1:] + back[1:])[:, None] - total).sum(axis=0)
            weight = gamma.sum(axis=0) + 1e-12
            start, step = gamma[0] / gamma[0].sum(), (xi + 1e-6) / (xi + 1e-6).sum(axis=1, keepdims=True)
            means = gamma.T @ x / weight[:, None]
            for j in range(k):
                z = x - means[j]
                c = (gamma[:, j, None] * z).T @ z / weight[j]
                covs[j] = (np.diag(np.diag(c)) if self.diagonal else c) + self.floor * np.eye(d)
            if total - last < self.tolerance:
                break
            last = total
        return (start, step, means, covs), last

    def decoded(self, x: np.ndarray) -> np.ndarray:
        """The most likely states of all rows together."""
        density, log_step = _log_density(x, self.means, self.covs), np.log(self.step + 1e-300)
        score, back = np.log(self.start + 1e-300) + density[0], []
        for d in density[1:]:
            ways = score[:, None] + log_step
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + d
        states = [int(score.argmax())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return np.array(states[::-1])

    def filtered(self, x: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of the state at each row from that row and those before alone."""
        density, out = _log_density(x, self.means, self.covs), np.empty((len(x), self.states))
        now = np.log((self.start if prior is None else prior @ self.step) + 1e-300)
        for t, d in enumerate(density):
            a = now + d
            out[t] = np.exp(a - _log_sum(a, 0))
            now = np.log(out[t] @ self.step + 1e-300)
        return out
