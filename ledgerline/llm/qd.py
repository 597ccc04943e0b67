"""Singular values and directions of a small triangular factor by qd algorithms.

Householder reflections make the factor bidiagonal; dqds finds the singular values
to high relative accuracy; twisted factorisations of the shifted Gram matrix of the
bidiagonal give its right singular vectors, one at a time.
"""

import numpy as np

EPS = np.finfo(float).eps
#: Relative gap below which neighbouring vectors are made orthogonal to each other.
CLUSTER_GAP = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with r = U B V', B upper bidiagonal; r is square."""
    a, d = np.array(r, float), r.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max(initial=0.0)
        if size == 0 or not np.abs(x[1:]).max(initial=0.0):
            return None
        u = x / size
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        return u / np.linalg.norm(u)

    for k in range(d):
        u = reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 1 < d:
            w = reflector(a[k, k + 1:])
            if w is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _transform(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One dqds step, or None if the shift was above the least square."""
    m = len(q)
    new_q, new_e = np.empty(m), np.empty(m - 1)
    d = q[0] - shift
    if d < 0:
        return None
    for i in range(m - 1):
        new_q[i] = d + e[i]
        if new_q[i] == 0:
            new_e[i], d = 0.0, q[i + 1] - shift
        else:
            t = q[i + 1] / new_q[i]
            new_e[i], d = e[i] * t, d * t - shift
        if not d >= 0:
            return None
    new_q[-1] = d
    return new_q, new_e, d


def _least_of_two(a: float, b: float, c: float) -> float:
    """The smaller squared singular value of the last two rows: q = a, e = b, q = c."""
    s = a + b + c
    return 0.0 if s == 0 else 2 * a * c / (s + np.sqrt(max(s * s - 4 * a * c, 0.0)))


def squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, by dqds."""
    out, todo = [], [(diagonal.astype(float) ** 2, above.astype(float) ** 2, 0.0)]
    while todo:
        q, e, moved = todo.pop()
        if len(q) == 1:
            out.append(moved + q[0])
            continue
        small = e <= EPS * EPS * (moved + np.minimum(q[1:], q[:-1]))
        small |= e < np.finfo(float).tiny
        if small.any():
            cut = int(np.flatnonzero(small)[-1])
            todo += [(q[:cut + 1], e[:cut], moved), (q[cut + 1:], e[cut + 1:], moved)]
            continue
        if q[0] < q[-1] / 1.5:  # the small end belongs at the bottom
            q, e = q[::-1].copy(), e[::-1].copy()
        # a shift above the least square is refused; zero never is
        shift = _least_of_two(q[-2], e[-1], q[-1]) * (1 - 4 * EPS)
        if e[-1] > q[-1]:
            shift *= 0.25
        while (stepped := _transform(q, e, shift)) is None:
            shift = shift * 0.5 if shift > EPS * q.min() else 0.0
        todo.append((stepped[0], stepped[1], moved + shift))
    return np.sort(np.array(out))[::-1]


def twisted(diagonal: np.ndarray, above: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(stationary multipliers, progressive multipliers, twist values, twist) of B'B - square."""
    m = len(diagonal)
    piv, mult = diagonal**2, np.zeros(max(m - 1, 0))
    tiny = max(np.finfo(float).tiny, EPS * EPS * max(piv.max(), square))
    np.divide(above, diagonal[:-1], out=mult, where=diagonal[:-1] != 0)
    s, p, down, up = np.zeros(m), np.zeros(m), np.zeros(max(m - 1, 0)), np.zeros(max(m - 1, 0))
    s[0] = -square
    for i in range(m - 1):
        t = s[i] + piv[i]
        t = t if abs(t) > tiny else np.copysign(tiny, t)
        down[i] = piv[i] * mult[i] / t
        s[i + 1] = down[i] * mult[i] * s[i] - square
    p[-1] = piv[-1] - square
    for i in range(m - 2, -1, -1):
        t = piv[i] * mult[i] ** 2 + p[i + 1]
        t = piv[i] / (t if abs(t) > tiny else np.copysign(tiny, t))
        up[i] = mult[i] * t
        p[i] = p[i + 1] * t - square
    gamma = s + p + square
    return down, up, gamma, int(np.argmin(np.abs(gamma)))


def _vector(down: np.ndarray, up: np.ndarray, twist: int) -> np.ndarray:
    z = np.zeros(len(down) + 1)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, len(down)):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _apart(z: np.ndarray, others: np.ndarray) -> np.ndarray:
    """z of unit length, orthogonal to the columns of others."""
    for _ in range(3):
        z = z / np.linalg.norm(z)
        z = z - others @ (others.T @ z)
    return z / np.linalg.norm(z)


def _block_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of an unreduced block for falling squares."""
    m = len(diagonal)
    gram = np.diag(diagonal**2) + np.diag(diagonal[:-1] * above, 1) + np.diag(diagonal[:-1] * above, -1)
    gram[np.arange(1, m), np.arange(1, m)] += above**2
    out, first = np.zeros((m, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER_GAP * values[j - 1]:
            first = j
        down, up, gamma, twist = twisted(diagonal, above, value)
        z, others = _vector(down, up, twist), out[:, first:j]
        if first < j:
            z = z - others @ (others.T @ z)
            if np.linalg.norm(z) < 0.5:  # the neighbour's vector again: inverse iteration off the vectors found
                shifted = gram - (value + 64 * EPS * values[0]) * np.eye(m)
                z = np.random.default_rng(j).normal(size=m)
                for _ in range(4):
                    z = np.linalg.solve(shifted, _apart(z, others))
            z = _apart(z, others)
        out[:, j] = z / np.linalg.norm(z)
    return out


def singular_pairs(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns): the largest, at most most of them.

    Values that are zero to the precision of the largest are left out.
    """
    size = np.abs(r).max(initial=0.0)
    if not size:
        return np.zeros(0), np.zeros((r.shape[1], 0))
    diagonal, above, v = bidiagonalise(r / size)
    scale, d = max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0)), len(diagonal)
    above = np.where(np.abs(above) <= EPS * scale, 0.0, above)
    diagonal = np.where(np.abs(diagonal) <= EPS * EPS * scale, EPS * EPS * scale, diagonal)
    ends = [*(np.flatnonzero(above == 0) + 1), d]
    pairs, start = [], 0
    for end in ends:
        b, c = diagonal[start:end], above[start:end - 1]
        pairs += [(value, start, end, i) for i, value in enumerate(squares(b, c))]
        start = end
    pairs.sort(key=lambda t: (-t[0], t[1], t[3]))
    top = pairs[0][0]
    pairs = [t for t in pairs if t[0] > (d * EPS) ** 2 * top][:most]
    vectors = np.zeros((d, len(pairs)))
    for start, end in {(t[1], t[2]) for t in pairs}:
        mine = [k for k, t in enumerate(pairs) if t[1] == start]
        vectors[start:end, mine] = _block_vectors(diagonal[start:end], above[start:end - 1], np.array([pairs[k][0] for k in mine]))
    return np.array([t[0] for t in pairs]) * size * size, v @ vectors
