"""Banded alignment of word sequences: edit distance up to a limit."""

from __future__ import annotations

from collections import Counter

#: Beyond that many edits the diagonals give way to a band of bits.
DIAGONAL_EDITS = 8


def _common(a: list, b: list, i: int, j: int) -> int:
    """Length of the common run of a[i:] and b[j:], by galloping comparison."""
    start, step, end = i, 1, min(len(a) - i, len(b) - j)
    done = 0
    while done < end:
        step = min(step, end - done)
        if a[start + done : start + done + step] == b[j + done : j + done + step]:
            done += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return done


def edit_distance(a: list, b: list, limit: int) -> int:
    """Word edits between a and b, or limit + 1 if there are more than ``limit``."""
    return min(edits(a, b, limit), limit + 1)


def edits(a: list, b: list, limit: int) -> int:
    """Word edits between a and b if they are at most ``limit``, else a lower bound above it."""
    head = _common(a, b, 0, 0)
    a, b = a[head:], b[head:]
    tail = _common(a[::-1], b[::-1], 0, 0)
    if tail:
        a, b = a[:-tail], b[:-tail]
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return abs(n - m)
    if not n or not m:
        return max(n, m)
    left, right = Counter(a), Counter(b)
    least = max((left - right).total(), (right - left).total())  # each edit mends one word a side at most
    if least > limit:
        return least
    found = _diagonals(a, b, min(limit, DIAGONAL_EDITS))
    if found is not None:
        return found
    return limit + 1 if limit <= DIAGONAL_EDITS else _band(a, b, limit)


def _diagonals(a: list, b: list, limit: int) -> int | None:
    """Furthest reaching points on each diagonal of the band, edit by edit."""
    n, m = len(a), len(b)
    goal = m - n
    reach = {0: _common(a, b, 0, 0)}
    if goal == 0 and reach[0] == n:
        return 0
    for d in range(1, limit + 1):
        nxt = {}
        for k in range(-d, d + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            if i < 0:
                continue
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            nxt[k] = i + _common(a, b, i, i + k)
        if nxt.get(goal, -1) >= n:
            return d
        reach = nxt
    return None


def _band(a: list, b: list, limit: int) -> int:
    """Edits by a band of 2 * limit + 1 rows that moves down the diagonal, a column of differences at a time.

    Bit i of a column's words stands for row column - limit + i.  ``up`` and
    ``down`` say where a cell is one more or one less than the cell above it;
    ``more`` and ``less`` where it is one more or one less than the cell to its
    left; ``same`` where it equals the cell up and to its left.
    """
    if len(a) <= limit:  # a common head changes nothing and gives the band its length
        a, b = [None] * limit + a, [None] * limit + b
    n, m = len(a), len(b)
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << (i + limit)
    full, last = (1 << 2 * limit + 1) - 1, 1 << 2 * limit
    up, down = full >> limit << limit, 0
    found, most = limit, 2 * limit + m - n  # D[limit, 0]; it falls by one a column at most once row n is reached
    for j in range(m):
        hit = at.get(b[j], 0) >> j & full
        same = ((((hit & up) + up) ^ up) | hit | down) & full
        more, less = down | full & ~(same | up), same & up
        if j < n - limit:  # along the band's lower edge
            if not same & last:
                found += 1
                if found > most:
                    return limit + 1
        else:  # along row n
            edge = 1 << (n - 1 - j + limit)
            if more & edge:
                found += 1
            elif less & edge:
                found -= 1
        same >>= 1
        up, down = less | full & ~(same | more), same & more
    return min(found, limit + 1)


def allowed(n: int, m: int, least: float) -> int:
    """Edits that leave a similarity, 1 - edits / longer length, of at least ``least``."""
    return int((1 - least) * max(n, m) + 1e-9)
