"""A linear-chain conditional random field with binary features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Crf:
    """weights[feature, label], first[label], steps[label, next label]; unknown features count nothing."""

    index: dict[str, int]
    weights: np.ndarray
    first: np.ndarray
    steps: np.ndarray

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), self.weights.shape[1]))
        get = self.index.get
        for k, names in enumerate(rows):
            known = [i for i in map(get, names) if i is not None]
            if known:
                out[k] = self.weights[known].sum(axis=0)
        return out

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        """The most probable labels of a chain."""
        if not rows:
            return []
        scores = self.scores(rows)
        best = self.first + scores[0]
        back = np.zeros(scores.shape, np.int64)
        for t in range(1, len(scores)):
            ways = best[:, None] + self.steps
            back[t] = ways.argmax(axis=0)
            best = ways.max(axis=0) + scores[t]
        path = [int(best.argmax())]
        for t in range(len(scores) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return path[::-1]


def train(
    chains: list[tuple[list[list[str]], list[int]]], labels: int = 2, rounds: int = 120, rate: float = 0.3,
    decay: float = 0.02, least: int = 3,
) -> Crf:
    """Maximum likelihood with an L2 penalty by AdaGrad on all chains at once.

    Chains are padded to one length, so each step of the forward and backward recursion handles all
    of them. Features that occur in fewer than ``least`` places are left out.
    """
    seen: dict[str, int] = {}
    for rows, _ in chains:
        for names in rows:
            for n in names:
                seen[n] = seen.get(n, 0) + 1
    index = {n: i for i, n in enumerate(sorted(n for n, c in seen.items() if c >= least))}
    lengths = np.array([len(rows) for rows, _ in chains])
    longest, count = int(lengths.max()), len(chains)
    mask = np.arange(longest)[:, None] < lengths[None, :]
    gold = np.zeros((longest, count), np.int64)
    places, features = [], []
    for c, (rows, truth) in enumerate(chains):
        gold[: len(truth), c] = truth
        for t, names in enumerate(rows):
            known = [index[n] for n in names if n in index]
            places += [t * count + c] * len(known)
            features += known
    place, feature = np.array(places), np.array(features)
    weights = np.zeros((len(index), labels))
    first, steps = np.zeros(labels), np.zeros((labels, labels))
    sums = [np.full_like(x, 1e-6) for x in (weights, first, steps)]
    onehot = np.eye(labels)[gold] * mask[:, :, None]
    pairs = np.einsum("tci,tcj->ij", onehot[:-1], onehot[1:])
    for _ in range(rounds):
        scores = np.zeros((longest * count, labels))
        for y in range(labels):
            scores[:, y] = np.bincount(place, weights[feature, y], longest * count)
        scores = scores.reshape(longest, count, labels)
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[0] = first + scores[0]
        for t in range(1, longest):
            step = _lse(ahead[t - 1][:, :, None] + steps[None], 1) + scores[t]
            ahead[t] = np.where(mask[t][:, None], step, ahead[t - 1])
        for t in range(longest - 2, -1, -1):
            step = _lse(steps[None] + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
            behind[t] = np.where(mask[t + 1][:, None], step, 0)
        total = _lse(ahead[-1], 1)
        single = np.exp(ahead + behind - total[None, :, None]) * mask[:, :, None]
        double = np.zeros((labels, labels))
        for t in range(1, longest):
            joint = ahead[t - 1][:, :, None] + steps[None] + (scores[t] + behind[t])[:, None, :] - total[:, None, None]
            double += (np.exp(joint) * mask[t][:, None, None]).sum(axis=0)
        miss = (onehot - single).reshape(-1, labels)
        grad = np.zeros_like(weights)
        for y in range(labels):
            grad[:, y] = np.bincount(feature, miss[place, y], len(index))
        grads = (grad - decay * weights, (onehot[0] - single[0]).sum(axis=0) - decay * first, pairs - double - decay * steps)
        for x, g, s in zip((weights, first, steps), grads, sums, strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    return Crf(index, weights, first, steps)
