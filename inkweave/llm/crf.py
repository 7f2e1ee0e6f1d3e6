"""A linear-chain conditional random field with two labels.

Label 1 at a position scores the sum of its features' weights there, label 0 scores 0; ``trans[a, b]`` is added for
label b after label a. Training maximises the conditional log-likelihood with an L2 penalty by Adam steps, on padded
sequences; decoding takes numbers only, so it serves any features.
"""

from __future__ import annotations

import numpy as np


class Sequences:
    """Positions of many sequences, laid out for steps that go over all of them at once."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths, dtype=np.int64)
        lengths = lengths[lengths > 0]
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        self.n, sizes = int(lengths.sum()), lengths[order]
        #: Positions at step t, of the sequences longer than t: the longest come first, so these are the first ones.
        self.at = [starts[: np.searchsorted(-sizes, -t, side="left")] + t for t in range(int(sizes[0]) if len(sizes) else 0)]


def marginals(u, trans, seq: Sequences):
    """P(label 1) at each position, expected counts of transitions, and the log of the partition function."""
    forward, backward = np.zeros((seq.n, 2)), np.zeros((seq.n, 2))
    score = np.stack([np.zeros_like(u), u], axis=1)
    log_z = 0.0
    for t, at in enumerate(seq.at):
        if t:
            before = forward[at - 1]
            forward[at] = score[at] + np.logaddexp(before[:, :1] + trans[0], before[:, 1:] + trans[1])
        else:
            forward[at] = score[at]
    pairs = np.zeros((2, 2))
    for t in range(len(seq.at) - 1, -1, -1):
        at = seq.at[t]
        more = len(seq.at[t + 1]) if t + 1 < len(seq.at) else 0
        ends = at[more:]
        log_z += float(np.logaddexp(forward[ends, 0], forward[ends, 1]).sum())
        if more:
            here = at[:more]
            after = score[here + 1] + backward[here + 1]
            backward[here] = np.logaddexp(after[:, :1] + trans[:, 0], after[:, 1:] + trans[:, 1])
            joint = forward[here][:, :, None] + trans[None] + after[:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = forward + backward
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pairs, log_z


def train(scores, pull, size: int, y, seq: Sequences, l2: float = 0.01, steps: int = 150, rate: float = 0.15):
    """Weights and transitions. ``scores(w)`` gives every position's sum of weights, ``pull(g)`` the weights' gradient
    from the positions'; ``y`` has the labels."""
    y = np.asarray(y, dtype=float)
    inner = np.zeros(seq.n, dtype=bool)
    for at in seq.at[1:]:
        inner[at] = True
    here = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[here - 1].astype(int), y[here].astype(int)), 1)
    p, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    n = max(1, seq.n)
    for k in range(1, steps + 1):
        w, trans = p[:size], p[size:].reshape(2, 2)
        prob, pairs, _ = marginals(scores(w), trans, seq)
        g = np.concatenate([pull(prob - y), (pairs - seen).ravel()]) / n + l2 * p / np.sqrt(n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return p[:size], p[size:].reshape(2, 2)


def viterbi(u, trans) -> list[int]:
    """The best labels of one sequence; of two equally good ones, the one with label 0 at the last place they differ."""
    (t00, t01), (t10, t11) = trans.tolist()
    a0, a1, back = 0.0, 0.0, []
    for k, x in enumerate(u.tolist() if hasattr(u, "tolist") else u):
        if k:
            b0, b1 = a1 + t10 > a0 + t00, a1 + t11 > a0 + t01
            a0, a1 = (a1 + t10 if b0 else a0 + t00), (a1 + t11 if b1 else a0 + t01) + x
            back.append((b0, b1))
        else:
            a0, a1 = 0.0, x
    if not len(u):
        return []
    out = [int(a1 > a0)]
    for pair in reversed(back):
        out.append(int(pair[out[-1]]))
    return out[::-1]


class Steps:
    """Powers of what a stretch of positions without features does to (forward, backward) sums: for a stretch of any
    length, forward and backward values and the label-1 marginals that follow from it, in closed form."""

    def __init__(self, trans, bias: float = 0.0):
        """``bias``: a score of label 1 at every position, half of it laid into the step on either side."""
        self.end = np.array([1.0, np.exp(bias / 2)])
        self.m = np.exp(np.asarray(trans) + np.array([[0.0, bias / 2], [bias / 2, bias]]))
        values, left = np.linalg.eig(self.m)
        self.values, self.left, self.right = values.real, left.real, np.linalg.inv(left).real
        top = float(np.abs(self.values).max())
        self.values = self.values / top  # scale cancels in every marginal
        self.m = self.m / top

    def power(self, k):
        """The matrices of ``k`` steps: shape (len(k), 2, 2)."""
        k = np.asarray(k)
        return np.einsum("ij,kj,jl->kil", self.left, self.values[None, :] ** k[:, None], self.right)


def sparse_marginals(n: int, at, u, steps: Steps):
    """P(label 1) at the positions ``at`` (ascending) of a sequence of ``n``, whose other positions have score 0. The
    stretches between are one matrix each, so the work follows ``at`` and not ``n``."""
    gaps = np.diff(np.concatenate([[0], at, [n - 1]]))
    powers = steps.power(gaps)
    weight = np.stack([np.exp(np.minimum(0.0, -np.asarray(u))), np.exp(np.minimum(0.0, np.asarray(u)))], axis=1)
    k = len(at)
    forward, backward = np.empty((k, 2)), np.empty((k, 2))
    f = steps.end @ powers[0]
    for i in range(k):
        f = (f if i == 0 else f @ powers[i]) * weight[i]
        f = f / f.sum()
        forward[i] = f
    b = powers[k] @ steps.end
    for i in range(k - 1, -1, -1):
        b = b / b.sum()
        backward[i] = b
        b = powers[i] @ (weight[i] * b)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)
