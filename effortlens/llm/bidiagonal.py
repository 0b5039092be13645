"""Leading right singular vectors of a small square matrix, accurate to double precision.

The matrix is made bidiagonal by Householder reflections, the dqds iteration
finds the squares of its singular values, and twisted factorisations of the
tridiagonal product give a vector for each, where the pivot is least.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny
# Stands for a pivot of zero in a matrix whose entries are about 1.
_PIVOT = 1e-120
# Neighbouring values closer than this, relative to their size, get a representation of their own.
_GAP = 1e-3
_DEEPEST = 8


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V): the matrix is U B V^T for an orthogonal U that is not formed."""
    b = np.array(matrix, float)
    n = len(b)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        scale = np.abs(x).max(initial=0.0)
        if not scale or not np.any(x[1:]):
            return None
        w = x / scale
        w[0] += math.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for j in range(n):
        w = reflector(b[j:, j].copy())
        if w is not None:
            b[j:, j:] -= 2 * np.outer(w, w @ b[j:, j:])
        if j < n - 2:
            w = reflector(b[j, j + 1 :].copy())
            if w is not None:
                b[j:, j + 1 :] -= 2 * np.outer(b[j:, j + 1 :] @ w, w)
                v[:, j + 1 :] -= 2 * np.outer(v[:, j + 1 :] @ w, w)
    return np.diag(b).copy(), np.diag(b, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One dqds transform. (q, e, least d, whether the last d alone is negative)."""
    new_q, new_e = [], []
    d = least = q[0] - shift
    for i in range(len(e)):
        x = d + e[i]
        if d < 0 or x <= 0:
            return new_q, new_e, min(least, d), False
        t = q[i + 1] / x
        new_q.append(x)
        new_e.append(e[i] * t)
        d = d * t - shift
        least = min(least, d)
    new_q.append(d)
    return new_q, new_e, least, True


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squares of the singular values, falling, of the bidiagonal matrix whose squared entries are q > 0 and e >= 0."""
    out: list[float] = []
    pending = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while pending:
        q, e, total = pending.pop()
        if len(q) > 1 and 1.5 * q[0] < q[-1]:
            q, e = q[::-1], e[::-1]
        while len(q) > 1:
            if e[-1] <= EPS**2 * (total + q[-1]):
                out.append(total + q.pop())
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= EPS**2 * (total + min(q[i], q[i + 1]))), None)
            if cut is not None:
                pending.append((q[: cut + 1], e[:cut], total))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            # Least eigenvalue of the last two rows, less their tie to the rest.
            a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), e[-1], q[-1]
            half = (a + b + c) / 2
            root = half + math.sqrt(max(0.0, half * half - a * c))
            shift = max(0.0, (a / root) * c - (e[-2] if len(e) > 1 else 0.0)) if root else 0.0
            if len(q) == 2:
                shift *= 1 - 4 * EPS
            while True:
                new_q, new_e, least, late = _sweep(q, e, shift)
                if late and least >= 0:
                    break
                # With a failure in the last place alone, that place tells a lower bound.
                shift = 0.0 if shift < 1e-30 * (total + q[-1]) else max(0.0, shift + least) * (1 - EPS) if late and shift + least > 0 else shift / 4
            q, e, total = new_q, new_e, total + shift
            q = [max(x, _TINY) for x in q]
        out.append(total + q[0])
    return np.sort(np.array(out))[::-1]


def _stationary(d: np.ndarray, l: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L+ D+ L+^T = L D L^T - shift, for many shifts. (D+, L+, s)."""
    n, k = len(d), len(shift)
    plus, ratio, s = np.empty((n, k)), np.empty((n - 1, k)), np.empty((n, k))
    s[0] = -shift
    for i in range(n - 1):
        x = s[i] + d[i]
        x = np.where(np.abs(x) < _PIVOT, -_PIVOT, x)
        plus[i] = x
        ratio[i] = l[i] * (d[i] / x)
        s[i + 1] = ratio[i] * l[i] * s[i] - shift
    plus[-1] = s[-1] + d[-1]
    return plus, ratio, s


def _refined(d: np.ndarray, l: np.ndarray, low: np.ndarray, high: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Eigenvalue number `index` (from 0, rising) of L D L^T by bisection between bounds that hold it."""
    low, high = low.copy(), high.copy()
    for _ in range(2000):
        middle = low + (high - low) / 2
        if np.all(high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))) or np.all((middle == low) | (middle == high)):
            break
        below = (_stationary(d, l, middle)[0] < 0).sum(axis=0)
        high = np.where(below > index, middle, high)
        low = np.where(below > index, low, middle)
    return low + (high - low) / 2


def _bracketed(d: np.ndarray, l: np.ndarray, near: np.ndarray, slack: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Bounds around `near` are widened until they hold their eigenvalue, then bisected."""
    low, high = near - slack, near + slack
    for _ in range(1100):
        wrong = (_stationary(d, l, low)[0] < 0).sum(axis=0) > index
        short = (_stationary(d, l, high)[0] < 0).sum(axis=0) <= index
        if not (wrong | short).any():
            break
        slack = slack * 2
        low, high = np.where(wrong, near - slack, low), np.where(short, near + slack, high)
    return _refined(d, l, low, high, index)


def _twisted(d: np.ndarray, l: np.ndarray, shift: float, place: int) -> np.ndarray:
    """Unit vector for the eigenvalue `shift` of L D L^T, twisted where the pivot is least, or `place`-th least."""
    n = len(d)
    if n == 1:
        return np.ones(1)
    _, up, s = _stationary(d, l, np.array([shift]))
    up, s = up[:, 0], s[:, 0]
    p, down = np.empty(n), np.empty(n - 1)
    pivots = np.empty(n)
    p[-1] = d[-1] - shift
    pivots[-1] = s[-1] + d[-1]
    for i in range(n - 2, -1, -1):
        x = d[i] * l[i] * l[i] + p[i + 1]
        t = d[i] / (x if abs(x) >= _PIVOT else -_PIVOT)
        down[i] = l[i] * t
        pivots[i] = s[i] + t * p[i + 1]
        p[i] = p[i + 1] * t - shift
    k = int(np.argsort(np.abs(np.nan_to_num(pivots, nan=np.inf)), kind="stable")[place])
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def _vectors(d: np.ndarray, l: np.ndarray, values: np.ndarray, index: np.ndarray, depth: int = 0) -> np.ndarray:
    """Unit eigenvectors, as columns, of L D L^T for its eigenvalues `values` (rising), numbered by `index`."""
    out = np.empty((len(d), len(values)))
    first = 0
    while first < len(values):
        last = first + 1
        while last < len(values) and values[last] - values[last - 1] <= _GAP * max(abs(values[last]), abs(values[last - 1])):
            last += 1
        own = slice(first, last)
        if last - first == 1:
            out[:, first] = _twisted(d, l, values[first], 0)
        elif depth < _DEEPEST:
            # Seen from just below, close values differ by much.
            width = values[last - 1] - values[first]
            base = values[first] - max(width, 4 * EPS * abs(values[first])) / 4
            plus, ratio, _ = _stationary(d, l, np.array([base]))
            plus, ratio = plus[:, 0], ratio[:, 0]
            near = values[own] - base
            exact = _bracketed(plus, ratio, near, 64 * EPS * np.abs(values[own]), index[own])
            out[:, own] = _vectors(plus, ratio, exact, index[own], depth + 1)
        else:  # equal as far as can be told: any basis of their space will do
            for j in range(first, last):
                out[:, j] = _twisted(d, l, values[j], min(j - first, len(d) - 1))
        first = last
    return out


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of the largest singular values, falling; their right singular vectors as columns).

    At most `count`, and only values above rounding error.
    """
    n = len(matrix)
    scale = float(np.abs(matrix).max(initial=0.0))
    if not scale or not count:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, above, v = bidiagonalise(matrix / scale)
    # A zero on the diagonal is moved by less than rounding.
    q = np.maximum(diagonal**2, (EPS / 16) ** 2 * np.max(np.concatenate((diagonal, above)) ** 2))
    e = above**2
    a = np.where(np.abs(diagonal) ** 2 >= q, diagonal, np.sqrt(q))
    cuts = [0, *(np.flatnonzero(e <= EPS**2 * np.minimum(q[:-1], q[1:])) + 1).tolist(), n]
    values, places = [], []
    for block, (first, last) in enumerate(zip(cuts, cuts[1:])):
        found = dqds(q[first:last], e[first : last - 1])
        values += found.tolist()
        places += [(block, last - first - 1 - i) for i in range(last - first)]
    order = np.argsort(-np.array(values), kind="stable")[:count]
    order = order[np.array(values)[order] > (8 * n * EPS) ** 2 * max(values)]
    out = np.zeros((n, len(order)))
    for block in {places[i][0] for i in order}:
        first, last = cuts[block], cuts[block + 1]
        mine = sorted((places[i][1], column, values[i]) for column, i in enumerate(order) if places[i][0] == block)
        index, columns, near = (np.array(x) for x in zip(*mine))
        d, l = q[first:last], above[first : last - 1] / a[first : last - 1]
        exact = near if last - first == 1 else _bracketed(d, l, near, 64 * EPS * near, index)
        out[first:last, columns] = _vectors(d, l, exact, index)
    # What is left of the angles between vectors of nearly equal values.
    for j in range(out.shape[1]):
        for _ in range(2):
            out[:, j] -= out[:, :j] @ (out[:, :j].T @ out[:, j])
            out[:, j] /= np.linalg.norm(out[:, j])
    return np.array(values)[order] * scale**2, v @ out
