"""Scaled forward and backward recursions over many sequences at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import ragged


@dataclass
class Result:
    loglik: np.ndarray  # natural logarithm, one a sequence
    each: np.ndarray  # its parts: of each token given those before it, in input order
    gamma: np.ndarray | None = None  # state marginals, one row a token, in input order
    xi: np.ndarray | None = None  # expected transitions
    first: np.ndarray | None = None  # expected first states


def recursions(scores: np.ndarray, counts: np.ndarray, step: np.ndarray, start: np.ndarray, backward: bool = True) -> Result:
    """scores: positive weights (token, state), sequences end to end; counts: their lengths, all
    positive; step and start: positive weights. Each place is scaled to sum 1, so nothing
    underflows and the scales' logarithms add up to the exact total.

    Sequences go in step, the longest first, so a place of all of them is one slice.
    """
    counts = np.asarray(counts, dtype=np.int64)
    order = np.argsort(-counts, kind="stable")
    size = counts[order]
    starts = (np.cumsum(counts) - counts)[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # sequences longer than t
    who = ragged(active)
    index = starts[who] + np.repeat(np.arange(longest), active)
    e = scores[index]
    n, s = e.shape
    alpha, scale = np.empty((n, s)), np.empty(n)
    lo = 0
    for t in range(longest):
        hi = lo + active[t]
        cur = (start if t == 0 else cur[: active[t]] @ step) * e[lo:hi]
        c = cur.sum(1)
        cur /= c[:, None]
        alpha[lo:hi], scale[lo:hi] = cur, c
        lo = hi
    loglik, each = np.empty(len(counts)), np.empty(n)
    each[index] = np.log(scale)
    loglik[order] = np.bincount(who, weights=np.log(scale), minlength=len(counts))
    if not backward:
        return Result(loglik, each)
    beta, xi = np.ones((n, s)), np.zeros((s, s))
    hi = n
    for t in range(longest - 1, 0, -1):
        lo = hi - active[t]
        below = lo - active[t - 1]
        msg = e[lo:hi] * beta[lo:hi] / scale[lo:hi, None]
        xi += alpha[below : below + active[t]].T @ msg
        beta[below : below + active[t]] = msg @ step.T
        hi = lo
    gamma = np.empty((n, s))
    gamma[index] = alpha * beta
    return Result(loglik, each, gamma, xi * step, (alpha[: active[0]] * beta[: active[0]]).sum(0) if n else np.zeros(s))


def batches(counts: np.ndarray, limit: int = 400_000) -> list[np.ndarray]:
    """Sequence numbers in groups of about limit tokens, long ones together."""
    order = np.argsort(-np.asarray(counts), kind="stable")
    groups = np.cumsum(np.asarray(counts)[order]) // limit
    return [order[groups == g] for g in np.unique(groups)]


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Token places of the sequences that start and count so."""
    return np.repeat(starts, counts) + ragged(counts)
