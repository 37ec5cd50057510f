"""Exact nearest centres with whole groups of centres ruled out by distance bounds.

Unit vectors lie on a sphere, where the angle is a metric. Centres are grouped around
pivots that lie far apart; a group's radius is the largest angle between its pivot and a
centre. No centre of a group is nearer to a vector than the vector's angle to the pivot less
the radius. A batch of vectors first meets each vector's most promising group, and then only
those groups whose bound is not worse than the best centre found: the others are never
compared. Where the bounds rule nothing out, as with directions at random, the work is that
of one matrix product in pieces.
"""

from __future__ import annotations

import numpy as np

#: Similarities are compared after rounding to so many digits, so that ties do not hang on the order of sums.
DIGITS = 12


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class Centres:
    """Centres (ids ascending, unit rows) in groups around about sqrt(k) pivots."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, groups: int | None = None):
        self.ids, self.m, k = ids, m, len(ids)
        self.compared = 0  # pairs of a vector and a centre, pivots included
        count = max(1, min(k, groups or int(np.ceil(np.sqrt(k)))))
        # Pivots one after the other, each the centre that is farthest from those before it.
        chosen, best = [0] if k else [], m @ m[0] if k else np.zeros(0)
        near = np.zeros(k, dtype=np.int64)
        while len(chosen) < count:
            far = int(np.argmin(best))
            sims = m @ m[far]
            near = np.where(sims > best, len(chosen), near)
            best = np.maximum(best, sims)
            chosen.append(far)
        self.pivots = m[chosen] if k else np.zeros((0, m.shape[1]))
        self.members = [np.flatnonzero(near == g) for g in range(len(chosen))]
        angle = np.arccos(np.clip(best, -1.0, 1.0))
        self.radius = np.array([angle[w].max(initial=0.0) for w in self.members])
        # A zero row has no direction; its similarity to all is 0, so its group is always met.
        self.always = np.array([bool((~m[w].any(axis=1)).any()) for w in self.members])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, similarities) of each unit row's best centre; of equal ones the first."""
        n = len(x)
        sims = x @ self.pivots.T
        self.compared += sims.size
        # The best similarity that a centre of each group may have; a little more for rounding.
        roof = np.cos(np.maximum(0.0, np.arccos(np.clip(sims, -1.0, 1.0)) - self.radius)) + 1e-9
        roof[:, self.always] = 1.0
        roof[~x.any(axis=1)] = 1.0
        best, at = np.full(n, -np.inf), np.full(n, len(self.ids), dtype=np.int64)
        first = np.argmax(roof, axis=1)
        for turn in (True, False):
            for g, members in enumerate(self.members):
                rows = np.flatnonzero((first == g) if turn else (first != g) & (roof[:, g] >= best))
                if not len(rows) or not len(members):
                    continue
                found = np.round(x[rows] @ self.m[members].T, DIGITS)
                self.compared += found.size
                place = np.argmax(found, axis=1)
                value, centre = found[np.arange(len(rows)), place], members[place]
                better = (value > best[rows]) | ((value == best[rows]) & (centre < at[rows]))
                best[rows[better]], at[rows[better]] = value[better], centre[better]
        return at, best
