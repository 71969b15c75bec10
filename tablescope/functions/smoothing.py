"""Additive exponential smoothing of short series, one by one or many side by side."""

from __future__ import annotations

import itertools

import numpy as np


#: Days of a straight line beyond which it is walked in closed form.
_LONG = 64


class _Line:
    """What many days of a straight line do to the state, and to the residuals.

    The state is level, slope, seasons, the day's value and the value's step; ``move`` takes it over the days. Residuals
    are linear in it: ``rows`` are a few forms with the same sum of squares, ``total`` is their sum. Two lines that
    follow one another make one, so ``n`` periods take the logarithm of ``n`` steps.
    """

    def __init__(self, move: np.ndarray, rows: np.ndarray, total: np.ndarray):
        self.move, self.rows, self.total = move, rows, total

    def then(self, other: _Line) -> _Line:
        rows = np.concatenate([self.rows, other.rows @ self.move])
        if len(rows) > len(self.move):
            rows = np.linalg.qr(rows, "r")
        return _Line(other.move @ self.move, rows, self.total + other.total @ self.move)

    def times(self, n: int) -> _Line:
        size = len(self.move)
        out, power = _Line(np.eye(size), np.zeros((0, size)), np.zeros(size)), self
        while n:
            if n & 1:
                out = out.then(power)
            power, n = power.then(power), n >> 1
        return out


def _day(weights, phase: int, period: int, trend: bool) -> _Line:
    """One day at a place in the season."""
    alpha, beta, gamma = weights
    size = 2 + period + 2
    error = np.zeros(size)
    error[[0, 1, -2]] = -1.0, -1.0, 1.0
    if period:
        error[2 + phase] = -1.0
    move = np.eye(size)
    move[0] += alpha * error
    move[0, 1] += 1.0
    if trend:
        move[1] += alpha * beta * error
    if period:
        move[2 + phase] += gamma * (1.0 - alpha) * error
    move[-2, -1] += 1.0
    return _Line(move, error[None, :], error)


class _Fit:
    """Residuals and last state as affine functions of the unknown start state.

    Column 0 holds the constant part, the other columns one unit start value
    each (level, slope, seasons), so the best start is a least-squares problem.
    """

    def __init__(self, y: np.ndarray, length: np.ndarray, rise: np.ndarray, weights, period: int, trend: bool):
        size = 1 + trend + period
        state = np.zeros((2 + period, 1 + size))
        state[0, 1] = 1.0
        if trend:
            state[1, 2] = 1.0
        for j in range(period):
            state[2 + j, 2 + trend + j] = 1.0
        alpha, beta, gamma = weights
        errors, total, days = [], np.zeros(1 + size), 0
        for first, n, step in zip(y.tolist(), length.tolist(), rise.tolist()):
            singles = n if n <= _LONG else 0
            for k in range(singles):
                season = 2 + (days + k) % period if period else None
                error = -(state[0] + state[1])
                if period:
                    error -= state[season]
                error[0] += first + step * k
                errors.append(error)
                total += error
                state[0] += state[1] + alpha * error
                if trend:
                    state[1] += alpha * beta * error
                if period:
                    state[season] += gamma * (1.0 - alpha) * error
            if n > singles:
                with np.errstate(over="ignore", invalid="ignore"):
                    walked = self._straight(state, first, step, n, days, weights, period, trend)
                if walked is None:
                    self.cost = float("inf")
                    return
                state, rows, added = walked
                errors += rows
                total += added
            days += n
        errors = np.array(errors)
        start, *_ = np.linalg.lstsq(errors[:, 1:], -errors[:, 0], rcond=None)
        known = np.concatenate([[1.0], start])
        residuals = errors @ known
        self.cost = float(residuals @ residuals)
        self.spread = float(np.sqrt(max(self.cost / days - (total @ known / days) ** 2, 0.0)))
        self.state, self.days = state @ known, days

    @staticmethod
    def _straight(state, first, step, n, days, weights, period, trend):
        cycle = [_day(weights, (days + k) % period if period else 0, period, trend) for k in range(max(period, 1))]

        def after(parts: list[_Line]) -> _Line:
            line = parts[0]
            for part in parts[1:]:
                line = line.then(part)
            return line

        line = after(cycle).times(n // len(cycle))
        if rest := n % len(cycle):
            line = line.then(after(cycle[:rest]))
        whole = np.zeros((len(state) + 2, state.shape[1]))
        whole[:-2] = state
        whole[-2, 0], whole[-1, 0] = first, step
        if not (np.isfinite(line.rows).all() and np.isfinite(line.move).all()):
            return None  # weights under which errors grow without end
        return (line.move @ whole)[:-2], list(line.rows @ whole), line.total @ whole


def _minimise(cost, start: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Nelder-Mead on a few parameters, kept inside (0, 1)."""
    inside = lambda p: np.clip(p, 1e-4, 1.0 - 1e-4)
    corners = [inside(start)] + [inside(start + step) for step in 0.1 * np.eye(len(start))]
    scored = sorted(((cost(p), tuple(p)) for p in corners))
    for _ in range(rounds):
        if scored[-1][0] - scored[0][0] <= 1e-10 * (abs(scored[0][0]) + 1e-12):
            break
        worst = np.array(scored[-1][1])
        centre = np.mean([p for _, p in scored[:-1]], axis=0)

        def at(factor):
            p = inside(centre + factor * (worst - centre))
            return cost(p), tuple(p)

        trial = at(-1.0)
        if trial[0] < scored[0][0]:
            trial = min(trial, at(-2.0))
        elif trial[0] >= scored[-2][0]:
            trial = at(0.5)
        if trial[0] < scored[-1][0]:
            scored[-1] = trial
        else:
            best = np.array(scored[0][1])
            shrunk = [inside(best + 0.5 * (np.array(p) - best)) for _, p in scored[1:]]
            scored[1:] = [(cost(p), tuple(p)) for p in shrunk]
        scored.sort()
    return np.array(scored[0][1])


def _parts(n: int) -> tuple[int, bool]:
    """The season's length (0: none) and whether there is a trend, for a series of ``n`` days."""
    period = min(7, n // 2) if n // 2 >= 2 else 0
    trend = n > 2 * (period or 2)
    if not (period > 1 and n > 2 * period):
        period = 0
    return period, trend


def _starts(free: list[bool]) -> list[tuple]:
    return list(itertools.product(*[(0.1, 0.5, 0.9) for used in free if used]))


class _Together:
    """The costs of many series of one kind at once, one step of the days for all of them.

    ``days`` holds the series as columns, the longest first.  One season's start value is left out: a shift of the level
    against all seasons changes no residual.
    """

    def __init__(self, days: np.ndarray, length: np.ndarray, period: int, trend: bool):
        self.days, self.length, self.period, self.trend = days, length, period, trend
        self.width = 2 + trend + max(period - 1, 0)

    def costs(self, who: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Least sums of squares of the series ``who`` (ascending) under their weights."""
        n, count, period, width = self.length[who], len(who), self.period, self.width
        chosen = iter(weights.T)
        alpha, beta, gamma = [next(chosen) if used else np.zeros(count) for used in (True, self.trend, period > 0)]
        level, slope = np.zeros((width, count)), np.zeros((width, count))
        seasons = np.zeros((max(period, 1), width, count))
        # the last column is the constant part, so the corner of R is the norm of the residuals
        level[0] = 1.0
        if self.trend:
            slope[1] = 1.0
        for j in range(period - 1):
            seasons[j, 1 + self.trend + j] = 1.0
        errors = np.zeros((max(int(n[0]), width), width, count))
        rise, turn = alpha * beta, gamma * (1.0 - alpha)
        days = self.days[:, who]
        for d, live in enumerate(np.searchsorted(-n, -np.arange(n[0]), "left")):
            part = slice(0, live)
            error = level[:, part] + slope[:, part]
            if period:
                season = seasons[d % period, :, part]
                error += season
            np.negative(error, out=error)
            error[-1] += days[d, part]
            errors[d, :, part] = error
            level[:, part] += slope[:, part] + alpha[part] * error
            if self.trend:
                slope[:, part] += rise[part] * error
            if period:
                season += turn[part] * error
        return np.linalg.qr(np.ascontiguousarray(errors.transpose(2, 0, 1)), "r")[:, -1, -1] ** 2

    def minimise(self) -> tuple[np.ndarray, np.ndarray]:
        """What ``_minimise`` does, for each series its own steps: weights and costs."""
        inside = lambda p: np.clip(p, 1e-4, 1.0 - 1e-4)
        everyone = np.arange(self.days.shape[1])
        grid = np.array(_starts([True, self.trend, self.period > 0]))
        tried = np.stack([self.costs(everyone, np.broadcast_to(g, (len(everyone), len(g)))) for g in grid])
        start = grid[tried.argmin(0)]
        size = start.shape[1]
        points = np.stack([inside(start)] + [inside(start + step) for step in 0.1 * np.eye(size)])
        costs = np.stack([self.costs(everyone, p) for p in points])

        def sort(who):
            p, c = points[:, who], costs[:, who]
            order = np.lexsort([*(p[..., k] for k in reversed(range(size))), c], axis=0)
            points[:, who] = np.take_along_axis(p, order[..., None], 0)
            costs[:, who] = np.take_along_axis(c, order, 0)

        sort(everyone)
        who = everyone
        for _ in range(120):
            who = who[~(costs[-1, who] - costs[0, who] <= 1e-10 * (np.abs(costs[0, who]) + 1e-12))]
            if not len(who):
                break
            worst, centre = points[-1, who], points[:-1, who].mean(0)

            def at(factor, some):
                p = inside(centre[some] + factor * (worst[some] - centre[some]))
                return self.costs(who[some], p), p

            cost, trial = at(-1.0, np.arange(len(who)))
            better, poor = cost < costs[0, who], cost >= costs[-2, who]
            if len(some := np.flatnonzero(better)):
                c, p = at(-2.0, some)
                before = np.lexsort([*(np.stack([trial[some, k], p[:, k]]) for k in reversed(range(size))), np.stack([cost[some], c])], axis=0)
                taken = before[0] == 1
                cost[some[taken]], trial[some[taken]] = c[taken], p[taken]
            if len(some := np.flatnonzero(poor & ~better)):
                cost[some], trial[some] = at(0.5, some)
            won = cost < costs[-1, who]
            points[-1, who[won]], costs[-1, who[won]] = trial[won], cost[won]
            if len(lost := who[~won]):
                for k in range(1, size + 1):
                    points[k, lost] = inside(points[0, lost] + 0.5 * (points[k, lost] - points[0, lost]))
                    costs[k, lost] = self.costs(lost, points[k, lost])
            sort(who)
        return points[0], costs[0]


#: Series that are fitted one by one if there are no more of their kind, and numbers that are fitted at once.
_FEW, _CELLS = 8, 1 << 18


def fit_many(
    series: list[tuple[np.ndarray, np.ndarray, np.ndarray]], horizon: int
) -> list[tuple[np.ndarray, float]]:
    """``fit_additive`` of many series (first values, lengths and daily steps of their runs), side by side.

    Series with a run that is walked in closed form are fitted alone.
    """
    days = [int(length.sum()) for _, length, _ in series]
    kinds: dict[tuple, list[int]] = {}
    for i, (_, length, _) in enumerate(series):
        if length.max() <= _LONG:
            kinds.setdefault(_parts(days[i]), []).append(i)
    found: dict[int, np.ndarray] = {}
    for (period, trend), members in kinds.items():
        members.sort(key=lambda i: -days[i])
        while len(members) >= _FEW:
            n = days[members[0]]
            block = max(_FEW, _CELLS // (n * (3 + period)))
            some, members = members[:block], members[block:]
            daily = np.zeros((n, len(some)))
            for k, i in enumerate(some):
                first, length, rise = series[i]
                past = np.arange(days[i]) - np.repeat(np.cumsum(length) - length, length)
                daily[: days[i], k] = np.repeat(first, length) + np.repeat(rise, length) * past
            with np.errstate(over="ignore", invalid="ignore"):
                weights, costs = _Together(daily, np.array([days[i] for i in some]), period, trend).minimise()
            found |= {i: w for i, w, c in zip(some, weights, costs) if np.isfinite(c)}
    return [fit_additive(y, horizon, length, rise, found.get(i)) for i, (y, length, rise) in enumerate(series)]


def fit_additive(
    y: np.ndarray,
    horizon: int,
    length: np.ndarray | None = None,
    rise: np.ndarray | None = None,
    weights: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """Forecast and residual spread; trend and weekly season are used where the series is long enough.

    ``length`` and ``rise`` give the series as straight runs: ``y`` is the first value of each, ``rise`` its daily step.
    ``weights`` saves the search for the best ones.
    """
    length = np.ones(len(y), np.int64) if length is None else length
    rise = np.zeros(len(y)) if rise is None else rise
    n = int(length.sum())
    period, trend = _parts(n)
    free = [True, trend, period > 0]

    def fit(p) -> _Fit:
        chosen = iter(p)
        return _Fit(y, length, rise, [next(chosen) if used else 0.0 for used in free], period, trend)

    def cost(p):
        return fit(p).cost

    best = fit(_minimise(cost, np.array(min(_starts(free), key=cost))) if weights is None else weights)
    steps = np.arange(1, horizon + 1)
    ahead = best.state[0] + steps * best.state[1]
    if period:
        ahead = ahead + np.array([best.state[2 + (n + h - 1) % period] for h in steps])
    return ahead, best.spread
