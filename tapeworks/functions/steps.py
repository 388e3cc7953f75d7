"""Step functions of the ordered indicators, shared by the batch fold, the table functions and the streams.

A step holds plain numbers and takes one price at a time; ``state()`` and ``load()`` carry it over batches.
"""

from __future__ import annotations

import math
from collections import deque


def rounded(x: float, precision: int) -> float:
    y = x * 10.0**precision
    if not math.isfinite(y):
        return x
    whole = math.trunc(y)
    return (whole + math.copysign(1, y) if abs(y - whole) >= 0.5 else float(whole)) / 10.0**precision


class Step:
    fields: tuple[str, ...] = ()

    def state(self) -> tuple:
        return tuple(getattr(self, f) for f in self.fields)

    def load(self, state) -> "Step":
        for f, v in zip(self.fields, state):
            setattr(self, f, v)
        return self


class Ema(Step):
    """Starts at the first price; rounded at each step, so the recurrence has no closed form."""

    fields = ("value",)

    def __init__(self, period: int, precision: int = 4):
        if period < 1:
            raise ValueError("period must be 1 or more")
        self.weight, self.precision, self.value = 2.0 / (period + 1), precision, None

    def push(self, x: float) -> float:
        self.value = x if self.value is None else rounded((x - self.value) * self.weight + self.value, self.precision)
        return self.value


class Rsi(Step):
    """Wilder's index; 0.0 before ``period`` changes have been seen, 100.0 without any loss."""

    fields = ("count", "last", "gain", "loss")

    def __init__(self, period: int = 14, precision: int = 4):
        if period < 1:
            raise ValueError("period must be 1 or more")
        self.period, self.precision = period, precision
        self.count, self.last, self.gain, self.loss = 0, 0.0, 0.0, 0.0

    def push(self, x: float) -> float:
        move, self.last, self.count = x - self.last, x, self.count + 1
        changes, p = self.count - 1, self.period
        if changes == 0:
            return 0.0
        if changes <= p:
            self.gain, self.loss = (self.gain + move, self.loss) if move > 0 else (self.gain, self.loss - move)
            if changes < p:
                return 0.0
            self.gain, self.loss = self.gain / p, self.loss / p
        else:
            self.gain = (self.gain * (p - 1) + (move if move > 0 else 0.0)) / p
            self.loss = (self.loss * (p - 1) + (-move if move < 0 else 0.0)) / p
        if self.loss == 0.0:
            return 100.0
        return rounded(100.0 - 100.0 / (1.0 + self.gain / self.loss), self.precision)


class Macd(Step):
    """(line, signal, histogram); the histogram is scaled by 1000."""

    fields = ("fast_value", "slow_value", "signal_value")

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9, precision: int = 4):
        self.parts, self.precision = (Ema(fast, precision), Ema(slow, precision), Ema(signal, precision)), precision

    def state(self) -> tuple:
        return tuple(p.value for p in self.parts)

    def load(self, state) -> "Macd":
        for p, v in zip(self.parts, state):
            p.value = v
        return self

    def push(self, x: float) -> tuple[float, float, float]:
        fast, slow, signal = self.parts
        line = rounded(fast.push(x) - slow.push(x), self.precision)
        mean = signal.push(line)
        return line, mean, rounded((line - mean) * 1000.0, self.precision)


class Mean(Step):
    """Moving average; 0.0 before ``period`` values have been seen."""

    def __init__(self, period: int, precision: int = 4):
        if period < 1:
            raise ValueError("period must be 1 or more")
        self.period, self.precision, self.held = period, precision, deque(maxlen=period)

    def state(self) -> tuple:
        return tuple(self.held)

    def load(self, state) -> "Mean":
        self.held = deque(state, self.period)
        return self

    def push(self, x: float) -> float:
        self.held.append(x)
        return rounded(math.fsum(self.held) / self.period, self.precision) if len(self.held) == self.period else 0.0


class Bands(Mean):
    """(upper, middle, lower): the population deviation about the rounded middle, times ``k``."""

    def __init__(self, period: int = 20, k: float = 2.0, precision: int = 4):
        super().__init__(period, precision)
        self.k = k

    def push(self, x: float) -> tuple[float, float, float]:
        middle = super().push(x)
        if len(self.held) < self.period:
            return 0.0, 0.0, 0.0
        width = self.k * math.sqrt(math.fsum((v - middle) ** 2 for v in self.held) / self.period)
        return rounded(middle + width, self.precision), middle, rounded(middle - width, self.precision)
