"""A linear-chain conditional random field over sparse binary features, in numpy batches.

Sequences of a batch stand side by side, padded; every step of a recursion handles one position of all of them.
A position's features are a row of `width` feature numbers, padded with 0, whose weights are held at zero.
"""

from __future__ import annotations

import numpy as np


class Crf:
    def __init__(self, features: int, states: int):
        self.weights = np.zeros((features + 1, states))
        self.moves = np.zeros((states, states))
        self.first = np.zeros(states)

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        """Scores [..., states] of positions with feature numbers [..., width]."""
        return self.weights[rows].sum(-2)

    def _sums(self, e: np.ndarray, lengths: np.ndarray):
        """Forward and backward log sums of [sequence, position, state], and the log normalizer of each sequence."""
        n, t, s = e.shape
        forward, backward = np.empty_like(e), np.zeros_like(e)
        forward[:, 0] = self.first + e[:, 0]
        for k in range(1, t):
            forward[:, k] = np.logaddexp.reduce(forward[:, k - 1, :, None] + self.moves, axis=1) + e[:, k]
        for k in range(t - 2, -1, -1):
            new = np.logaddexp.reduce(self.moves + (e[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where((k + 1 < lengths)[:, None], new, 0.0)
        z = np.logaddexp.reduce(forward[np.arange(n), lengths - 1], axis=1)
        return forward, backward, z

    def marginals(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each state at each position; padding holds no meaning."""
        forward, backward, z = self._sums(e, lengths)
        return np.exp(np.minimum(forward + backward - z[:, None, None], 0.0))

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best state at each position; ties go to the lower state."""
        n, t, _ = e.shape
        best, back = self.first + e[:, 0], np.zeros(e.shape, np.int16)
        for k in range(1, t):
            through = best[:, :, None] + self.moves
            back[:, k] = through.argmax(1)
            best = np.where((k < lengths)[:, None], through.max(1) + e[:, k], best)
        path = np.zeros((n, t), np.int16)
        state = best.argmax(1)
        for k in range(t - 1, -1, -1):
            path[:, k] = state
            inside = (k < lengths) & (k > 0)
            state = np.where(inside, back[np.arange(n), k, state], state)
        return path

    def fit(self, rows: np.ndarray, tags: np.ndarray, lengths: np.ndarray, rounds: int = 200, rate: float = 0.1, l2: float = 1e-3, more: np.ndarray | float = 0.0) -> Crf:
        """Adam on the mean log-likelihood of [sequence, position] tags, less the squared norm; `more` is added to l2 for each feature's weights."""
        n, t, width = rows.shape
        s = self.moves.shape[0]
        inside = np.arange(t) < lengths[:, None]
        total = inside.sum()
        truth = (np.eye(s)[tags] * inside[..., None])
        pair = inside[:, 1:]
        seen_moves = np.einsum("nks,nkr->sr", truth[:, :-1] * pair[..., None], truth[:, 1:])
        params = [self.weights, self.moves, self.first]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        flat_rows = rows[inside]
        for step in range(1, rounds + 1):
            e = self.emissions(rows)
            forward, backward, z = self._sums(e, lengths)
            p = np.exp(np.minimum(forward + backward - z[:, None, None], 0)) * inside[..., None]
            error = (truth - p)[inside]
            grad = np.zeros_like(self.weights)
            for w in range(width):
                np.add.at(grad, flat_rows[:, w], error)
            grad[0] = 0
            moves = np.zeros_like(self.moves)
            for k in range(1, t):
                on = k < lengths
                if on.any():
                    moves += np.exp(forward[on, k - 1, :, None] + self.moves + (e[on, k] + backward[on, k])[:, None, :] - z[on, None, None]).sum(0)
            grads = [grad, seen_moves - moves, (truth[:, 0] - p[:, 0]).sum(0)]
            for i, (param, g) in enumerate(zip(params, grads)):
                g = g / total - (l2 + more if i == 0 else l2) * param
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                param += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
            self.weights[0] = 0
        return self


def padded(sequences: list, width: int, dtype=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """[sequence, position, width] of lists of rows, and their lengths."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    out = np.zeros((len(sequences), int(lengths.max(initial=1)), width), dtype)
    for i, s in enumerate(sequences):
        if len(s):
            out[i, : len(s)] = s
    return out, lengths
