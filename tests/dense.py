"""Plain dense forms that the operators are held against: PageRank of a small matrix, its Green matrix, and exact removal losses by it."""

import numpy as np

from loomgraph.operators.pagerank import ALPHA

ROUNDS, TOLERANCE, NOTHING = 200, 1e-9, 1e-12


def dense_pagerank(m: np.ndarray, seed: int, alpha: float = ALPHA, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Personalised PageRank of a small graph, given as counts of edges."""
    n = len(m)
    out = m.sum(axis=1)
    step = m / np.where(out, out, 1)[:, None]
    home = np.zeros(n)
    home[seed] = 1
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        new = alpha * (x @ step + x[out == 0].sum() * home) + (1 - alpha) * home
        if np.abs(new - x).sum() < n * tolerance:
            return new
        x = new
    return x


def green(m: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """(I - alpha P)^-1 of a small graph, given as counts of edges.

    Nodes outside a cover of all links are joined to covering nodes only, so their block is diagonal and what is inverted is as large as the cover.
    """
    n, out = len(m), m.sum(axis=1)
    a = np.eye(n) - alpha * m / np.where(out, out, 1)[:, None]
    link = (m > 0) | (m.T > 0)
    np.fill_diagonal(link, False)
    degree, cover = link.sum(axis=1), np.zeros(n, dtype=bool)
    while (at := int(degree.argmax())) >= 0 and degree[at] > 0:
        cover[at] = True
        degree -= link[at]
        link[at], link[:, at], degree[at] = False, False, 0
    h, rest = np.flatnonzero(cover), np.flatnonzero(~cover)
    own = 1 / a[rest, rest]
    there, back = a[np.ix_(h, rest)] * own, a[np.ix_(rest, h)] * own[:, None]
    inner = np.linalg.inv(a[np.ix_(h, h)] - there @ a[np.ix_(rest, h)])
    g = np.empty((n, n))
    g[np.ix_(h, h)], g[np.ix_(h, rest)], g[np.ix_(rest, h)] = inner, -inner @ there, -back @ inner
    g[np.ix_(rest, rest)] = np.diag(own) + back @ inner @ there
    return g


def removal_losses(m: np.ndarray, g: np.ndarray, s: int, t: int, alpha: float = ALPHA) -> np.ndarray:
    """For each node of a small graph, given as counts of edges and its green(), the share of t's PageRank from s that is lost without it.

    Exact: PageRank from s is row s of G = (I - alpha P)^-1, scaled to sum 1, since rank without a way on returns to the seed. Without node i only
    the rows of P with a step to i change, so the new row s is the old one with a correction as large as their number (Woodbury).
    """
    n, out = len(m), m.sum(axis=1)
    lost = np.zeros(n)
    total = g.sum(axis=1)
    before = g[s, t] / total[s]
    if before <= 1e-9:
        return lost
    for i in range(n):
        into = np.flatnonzero(m[:, i])
        into = into[into != i]
        if i in (s, t) or not len(into):
            continue
        only = m[into, i] == out[into]
        ratio = np.where(only, -1.0, m[into, i] / np.where(only, 1.0, out[into] - m[into, i]))
        back = np.where(only, 0.0, alpha)  # a row that only led to i becomes empty; others are spread over their other steps

        def changed(of_into: np.ndarray, same: np.ndarray | float, of_i: np.ndarray | float, ratio=ratio, back=back) -> np.ndarray:
            r, b = (ratio[:, None], back[:, None]) if of_into.ndim == 2 else (ratio, back)
            return -r * (of_into - same - b * of_i)

        k = np.eye(len(into)) + changed(g[np.ix_(into, into)], np.eye(len(into)), g[i, into])
        c = np.linalg.solve(k.T, g[s, into])
        rank, whole = g[s, t] - c @ changed(g[into, t], into == t, g[i, t]), total[s] - c @ changed(total[into], 1.0, total[i])
        lost[i] = max(0.0, before - rank / whole) / before
    lost[lost < NOTHING] = 0
    return lost
