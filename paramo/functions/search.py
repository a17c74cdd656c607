"""Search for least costs of many small problems side by side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Steps of a search, and halvings of a step that are tried together.
STEPS, HALVINGS = 60, 10


def minimise(cost: Callable[[np.ndarray, np.ndarray], np.ndarray], u: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(points, costs) of least cost found from the points ``u`` (problems, dimensions).

    ``cost`` takes numbers of problems and their trial points (problems, trials, dimensions) and gives (problems, trials); what is
    not a number counts as infinite.  A quasi-Newton search: slopes are central differences, and a step is taken only where it
    lowers the cost, so no problem ends above its start.  Problems stop on their own; one that starts at infinity stays.
    """
    s, p = u.shape
    u, h = u.copy(), 1e-4
    probes = np.concatenate([h * np.eye(p), -h * np.eye(p)])

    def costs(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = cost(rows, at)
        return np.where(np.isnan(found), np.inf, found)

    def slope(rows: np.ndarray) -> np.ndarray:
        c = costs(rows, u[rows][:, None, :] + probes)
        with np.errstate(invalid="ignore"):
            out = (c[:, :p] - c[:, p:]) / (2 * h)
        return np.where(np.isfinite(out), out, 0)

    f = costs(np.arange(s), u[:, None, :])[:, 0]
    todo = np.nonzero(np.isfinite(f))[0]
    shape = np.broadcast_to(np.eye(p), (s, p, p)).copy()
    g = np.zeros((s, p))
    if len(todo):
        g[todo] = slope(todo)
    plain = np.ones(s, bool)  # the next step follows the slope itself
    for _ in range(steps):
        todo = todo[np.abs(g[todo]).max(axis=1, initial=0) > 1e-7]
        if not len(todo):
            break
        way = -np.einsum("ijk,ik->ij", shape[todo], g[todo])
        back = (way * g[todo]).sum(axis=1) >= 0
        way[back] = -g[todo][back]
        way *= np.minimum(1, 1.5 / np.maximum(np.abs(way).max(axis=1), 1e-300))[:, None]
        trial = u[todo][:, None, :] + way[:, None, :] * 0.5 ** np.arange(HALVINGS)[None, :, None]
        c = costs(todo, trial)
        best = c.argmin(axis=1)
        better = c[np.arange(len(todo)), best] < f[todo] - 1e-11 * np.maximum(1, np.abs(f[todo]))
        stuck = todo[~better]
        shape[stuck] = np.eye(p)
        stop = stuck[plain[stuck]]
        plain[stuck] = True
        moved = todo[better]
        if len(moved):
            new = trial[np.nonzero(better)[0], best[better]]
            step, old = new - u[moved], g[moved]
            u[moved], f[moved], plain[moved] = new, c[better, best[better]], False
            g[moved] = slope(moved)
            change = g[moved] - old
            curve = (step * change).sum(axis=1)
            fit = curve > 1e-14
            a, y, rho = step[fit], change[fit], 1 / curve[fit]
            left = np.eye(p) - rho[:, None, None] * a[:, :, None] * y[:, None, :]
            shape[moved[fit]] = left @ shape[moved[fit]] @ left.transpose(0, 2, 1) + rho[:, None, None] * a[:, :, None] * a[:, None, :]
        todo = np.setdiff1d(todo, stop)
    return u, f
