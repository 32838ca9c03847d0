"""Union-find over positions, used inside one task."""

from __future__ import annotations

import numpy as np


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def link(self, x: int, y: int) -> bool:
        """True when x and y were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.parent[y] = x
        return True

    def roots(self, at: np.ndarray) -> np.ndarray:
        return np.array([self.find(int(i)) for i in at], np.intp)
