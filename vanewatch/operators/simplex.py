"""Derivative-free minimisation of many small problems at once, in numpy inside a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Loss = Callable[[np.ndarray], np.ndarray]


def minimised(
    loss: Loss, start: np.ndarray, step: np.ndarray, lo: np.ndarray, hi: np.ndarray,
    rounds: int = 120, tolerance: float = 1e-10,
) -> tuple[np.ndarray, np.ndarray]:
    """(points, losses): downhill simplex in the box ``lo`` to ``hi``, one simplex per problem.

    ``loss`` maps points (problems x unknowns) to losses. All problems take the same steps side by
    side; each keeps the move that suits it. A result is never worse than its start.
    """
    n, d = start.shape
    boxed = lambda x: np.clip(x, lo, hi)
    points = np.repeat(boxed(start)[:, None, :], d + 1, axis=1)
    for k in range(d):
        ahead = points[:, k + 1, k] + step[k]
        points[:, k + 1, k] = np.where(ahead <= hi[k], ahead, points[:, k + 1, k] - step[k])
    points = boxed(points)
    losses = np.stack([loss(points[:, k]) for k in range(d + 1)], axis=1)
    rows = np.arange(n)
    for _ in range(rounds):
        order = np.argsort(losses, axis=1, kind="stable")
        points, losses = points[rows[:, None], order], losses[rows[:, None], order]
        if np.all(losses[:, -1] - losses[:, 0] <= tolerance * (1 + np.abs(losses[:, 0]))):
            break
        centre, worst = points[:, :-1].mean(axis=1), points[:, -1]
        reflected, expanded = boxed(2 * centre - worst), boxed(3 * centre - 2 * worst)
        at_reflected, at_expanded = loss(reflected), loss(expanded)
        outside = at_reflected < losses[:, -1]
        contracted = np.where(outside[:, None], boxed(1.5 * centre - 0.5 * worst), 0.5 * (centre + worst))
        at_contracted = loss(contracted)
        expand = (at_reflected < losses[:, 0]) & (at_expanded < at_reflected)
        reflect = ~expand & (at_reflected < losses[:, -2])
        contract = ~expand & ~reflect & (at_contracted < np.minimum(at_reflected, losses[:, -1]))
        for chosen, point, value in (
            (expand, expanded, at_expanded), (reflect, reflected, at_reflected), (contract, contracted, at_contracted)
        ):
            points[chosen, -1], losses[chosen, -1] = point[chosen], value[chosen]
        shrink = ~(expand | reflect | contract)
        if shrink.any():
            points[shrink, 1:] = 0.5 * (points[shrink, 1:] + points[shrink, :1])
            for k in range(1, d + 1):
                losses[shrink, k] = loss(points[:, k])[shrink]
    best = np.argmin(losses, axis=1)
    return points[rows, best], losses[rows, best]
