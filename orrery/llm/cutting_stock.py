"""The cutting-stock problem by column generation: how many stocks to cut by which patterns, from a histogram of lengths.

The master problem is a revised simplex over the patterns found so far; a knapsack by dynamic programming prices new ones,
the best that holds each length. Sums go through ``einsum`` and elementwise products only: the matrices are small, and a
linear algebra library's own threads would wait for cores that Spark's tasks hold.
"""

from __future__ import annotations

import numpy as np

Pattern = dict[int, int]  # length -> pieces of it in one stock


class Knapsack:
    """The most value of pieces, any number of each, within every capacity up to ``capacity``. Weights are rising."""

    def __init__(self, weights: np.ndarray, values: np.ndarray, capacity: int) -> None:
        self.weights, self.capacity = weights, capacity
        self.best, self.took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        fits = np.searchsorted(weights, np.arange(capacity + 1), side="right").tolist()
        for c in range(1, capacity + 1):
            self.best[c] = self.best[c - 1]
            if n := fits[c]:
                total = self.best[c - weights[:n]] + values[:n]
                j = int(total.argmax())
                if total[j] > self.best[c] + 1e-12:
                    self.best[c], self.took[c] = total[j], j

    def counts(self, capacity: int) -> np.ndarray:
        """The pieces of a best filling of ``capacity``."""
        out = np.zeros(len(self.weights))
        c = capacity
        while c > 0:
            if self.took[c] < 0:
                c -= 1
            else:
                out[self.took[c]] += 1
                c -= int(self.weights[self.took[c]])
        return out


def falling(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Stocks filled in falling order, each with the longest pieces that still fit; a filling repeats while there are pieces for it."""
    left = {w: n for w, n in sorted(left.items(), reverse=True) if n}
    out: list[tuple[Pattern, int]] = []
    while left:
        room, own = capacity, {}
        for w, have in left.items():
            if n := min(have, room // w):
                own[w] = n
                room -= n * w
        times = min(left[w] // n for w, n in own.items())
        out.append((own, times))
        for w, n in own.items():
            left[w] -= n * times
            if not left[w]:
                del left[w]
    return out


def relaxed(weights: np.ndarray, demand: np.ndarray, capacity: int, pool: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns (one a row), how often each is used in the linear relaxation, and prices at which no pattern is worth over a stock.

    All pieces at those prices are therefore a lower bound on the number of stocks.

    ``pool`` is patterns to start with. Each round the simplex goes as far as the pool allows. Then the knapsack is asked
    at prices halfway between the present ones and those of the best bound so far, which settles sooner than the present ones
    alone; where that finds nothing it is asked at the present ones. Stops when the bound is within ``gap`` of the number
    of stocks, or no pattern is worth more than a stock.
    """
    own = capacity // weights
    # Slightly different demands, so that no step of the simplex has length 0 and it can't go round in circles.
    wanted = demand * (1 + 1e-7 * np.random.default_rng(3).random(len(demand)))
    patterns, inverse, use = np.diag(own.astype(float)), np.diag(1.0 / own), wanted / own
    best, bound = weights / capacity, float((weights * demand).sum()) / capacity
    while bound < use.sum() * (1 - gap):
        while True:
            worth = np.einsum("ij,j->i", pool, inverse.sum(axis=0))
            some = np.argsort(-worth, kind="stable")[:32]
            some = some[worth[some] > 1 + 1e-9]
            if not len(some):
                break
            for _ in range(len(some)):
                prices = inverse.sum(axis=0)
                worth = np.einsum("ij,j->i", pool[some], prices)
                column = pool[some[int(worth.argmax())]]
                if worth.max() <= 1 + 1e-9:
                    break
                direction = np.einsum("ij,j->i", inverse, column)
                ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
                out = int(ratio.argmin())
                use = np.maximum(use - ratio[out] * direction, 0)
                use[out] = ratio[out]
                pivot = inverse[out] / direction[out]
                inverse -= direction[:, None] * pivot
                inverse[out] = pivot
                patterns[out] = column
        prices, new = inverse.sum(axis=0), []
        for share in (0.5, 0.0):
            asked = np.maximum(share * best + (1 - share) * prices, 0)
            sack = Knapsack(weights, asked, capacity)
            value = max(1.0, float(sack.best[capacity]))
            if (here := float((asked * demand).sum()) / value) > bound:
                best, bound = asked / value, here
            for j, w in enumerate(weights.tolist()):
                column = sack.counts(capacity - w)
                column[j] += 1
                if (column * prices).sum() > 1 + 1e-9:
                    new.append(column)
            if new:
                break
        else:
            break
        pool = np.unique(np.concatenate((pool, np.array(new))), axis=0)
    return patterns.astype(np.int64), use, best


def plan(histogram: dict[int, int], capacity: int, gap: float = 0.002) -> list[tuple[Pattern, int]]:
    """Patterns with how many stocks to cut by each: exactly ``histogram``'s pieces. The list's length depends on the lengths only.

    The relaxation's uses are rounded down and taken; what is left, a few pieces for each length, is relaxed again, and so on.
    Where all uses are under 1, the largest quarter of them is taken once. Ends where falling order needs no more stocks
    for the rest than the relaxation does (as with a handful of pieces). The fewest stocks of all these ways are the plan.
    """
    if any(not 0 < w <= capacity for w in histogram):
        raise ValueError("every length must be over 0 and fit in a stock")
    left = {w: n for w, n in histogram.items() if n > 0}
    alone = [({capacity: 1}, n)] if (n := left.pop(capacity, 0)) else []
    taken: list[tuple[Pattern, int]] = []
    stocks = lambda cuts: sum(x for _, x in cuts)
    best = falling(left, capacity)
    while left:
        weights = np.array(sorted(left))
        at = {w: i for i, w in enumerate(weights.tolist())}
        plain = falling(left, capacity)
        if stocks(taken) + stocks(plain) < stocks(best):
            best = [*taken, *plain]
        pool = np.zeros((len(plain), len(weights)))
        for row, (pattern, _) in zip(pool, plain, strict=True):
            for w, c in pattern.items():
                row[at[w]] = c
        demand = np.array([left[w] for w in weights.tolist()], dtype=np.float64)
        patterns, use, prices = relaxed(weights, demand, capacity, np.unique(pool, axis=0), gap)
        if stocks(plain) <= np.ceil((prices * demand).sum() - 1e-6):
            break
        order = np.argsort(-use, kind="stable")
        times = np.floor(use[order] + 1e-5).astype(np.int64)
        if not times.any():
            times[: -(-int((use > 1e-5).sum()) // 4)] = 1
        for counts, x in zip(patterns[order], times.tolist(), strict=True):
            own = {int(w): int(c) for w, c in zip(weights, counts, strict=True) if c}
            x = min([x, *(left.get(w, 0) // c for w, c in own.items())])
            if x > 0:
                taken.append((own, x))
                for w, c in own.items():
                    left[w] -= c * x
                    if not left[w]:
                        del left[w]
    if not left and stocks(taken) < stocks(best):
        best = taken
    return alone + best
