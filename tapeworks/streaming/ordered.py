"""Stateful operators over rows in event order, whatever order they arrive in.

A key's rows are held in state until the watermark has passed them, and then stepped through in order, so results do not depend on
how rows are spread over micro-batches. A key with up to FEW rows held has them in one value, which is read and written once for each
batch, as most time goes into calls to the state. One with more has them in buckets of time: input is added chunk by chunk
and a timer releases bucket after bucket, so a task holds FEW rows or one bucket of one key, whatever the size of a batch; state is
bounded by the lateness that the watermark allows. Rows behind the watermark are late: they come out at once, marked, and change nothing, and ``lateness`` counts them.

Times inside are microseconds since 1970 (``at``), so the session's time zone plays no part. A stream that ends needs a row behind
all others (``stream.closing_row``), as every watermark does. Needs the RocksDB state store (``stream.use_rocksdb``).
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.steps import Ema, Macd, Mean, Rsi

HOUR = 3600 * 1_000_000
#: Rows of a key that are held together, whatever their times.
FEW = 1024


class Ordered(StatefulProcessor):
    """fields: names to types of a row besides its key, ``at`` first; ``order``: what rows are sorted by; ``out``: the output's columns."""

    fields: dict[str, str] = {"at": "bigint", "seq": "bigint", "price": "double", "volume": "bigint"}
    order: tuple[str, ...] = ("at", "seq")
    out: dict[str, str] = {}

    def __init__(self, width: int = HOUR):
        self.width = width

    def init(self, handle) -> None:
        self.handle = handle
        columns = ", ".join(f"{n} array<{t}>" for n, t in self.fields.items())
        self.held = handle.getMapState("held", "bucket bigint", columns)
        # The timer's time, whether there are buckets, and the rows of a key without.
        self.few = handle.getValueState("few", f"due bigint, spilled boolean, {columns}")

    def begin(self) -> None:
        """Load the key's state."""

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows in order to the output's rows."""
        raise NotImplementedError

    def finish(self) -> None:
        """Save the key's state."""

    def belated(self, rows: pd.DataFrame, watermark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Late rows to those that come out marked, and those that are held after all."""
        return rows, rows.iloc[:0]

    def _load(self) -> None:
        due, spilled, *rows = self.few.get() or (None, False, *[()] * len(self.fields))
        self.due, self.spilled, self.rows = due, bool(spilled), [list(r or ()) for r in rows]

    def _save(self) -> None:
        if self.due is None:
            self.few.clear()
        else:
            self.few.update((self.due, self.spilled, *self.rows))

    def _wake(self, at: int) -> None:
        """A timer for when the watermark has passed ``at``; one that is set already for an earlier time sets the next."""
        ms = at // 1000 + 1
        if self.due is None or ms < self.due:
            self.due = ms
            self.handle.registerTimer(ms)

    def _spill(self, columns: list[list]) -> None:
        """Rows to their buckets of time."""
        self.spilled = True
        frame = pd.DataFrame(dict(zip(self.fields, columns)), dtype=object)
        for bucket, part in frame.groupby(frame["at"].astype("int64") // self.width, sort=False):
            key, new = (int(bucket),), [part[n].tolist() for n in self.fields]
            if self.held.containsKey(key):
                new = [list(old) + more for old, more in zip(self.held.getValue(key), new)]
            self.held.updateValue(key, tuple(new))

    def _hold(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            return
        new = [[None if x is None or x is pd.NA or x != x else x for x in rows[n].tolist()] for n in self.fields]
        if not self.spilled and len(self.rows[0]) + len(rows) <= FEW:
            for old, more in zip(self.rows, new):
                old += more
        else:
            self._spill([old + more for old, more in zip(self.rows, new)])
            self.rows = [[] for _ in self.fields]
        self._wake(int(rows["at"].min()))

    def _marked(self, key: tuple, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        fixed = {"symbol": key[0], "late": late}
        return pd.DataFrame({n: fixed[n] if n in fixed else rows[n] if n in rows else pd.Series([None] * len(rows), rows.index, dtype=object) for n in self.out}, rows.index)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        self._load()
        for chunk in rows:
            late = chunk["at"].to_numpy() < watermark
            if late.any():
                out, held = self.belated(chunk[late], watermark)
                if len(out):
                    yield self._marked(key, out, True)
                chunk = pd.concat([chunk[~late], held]) if len(held) else chunk[~late]
            self._hold(chunk)
        self._save()

    def _step(self, key: tuple, columns: list[list], watermark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Rows that were held to the output of those that the watermark has passed, and the others."""
        rows = pd.DataFrame(dict(zip(self.fields, columns))).sort_values(list(self.order), kind="stable", ignore_index=True)
        n = int(rows["at"].searchsorted(watermark))
        return self.step(key, rows.iloc[:n]) if n else rows.iloc[:0], rows.iloc[n:]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        self._load()
        self.due, few = None, self.rows
        self.rows = [[] for _ in self.fields]
        if few[0] and min(few[0]) >= watermark:  # a timer that an earlier one has overtaken
            self.rows = few
            self._wake(min(few[0]))
            self._save()
            return
        self.begin()
        if few[0]:
            out, rest = self._step(key, few, watermark)
            if len(out):
                yield self._marked(key, out, False)
            self._hold(rest)
        elif self.spilled:
            buckets, self.spilled = sorted(k[0] for k in self.held.keys()), False
            for bucket in buckets:
                if bucket * self.width >= watermark:
                    self.spilled = True
                    self._wake(bucket * self.width)
                    break
                out, rest = self._step(key, self.held.getValue((bucket,)), watermark)
                self.held.removeKey((bucket,))
                if len(rest):
                    self.spilled = True
                    self._hold(rest)
                if len(out):
                    yield self._marked(key, out, False)
        self.finish()
        self._save()

    def close(self) -> None:
        pass


def _run(rows: DataFrame, processor: Ordered, delay: str) -> DataFrame:
    """rows (symbol, ts, the processor's fields but at) through it; ``at`` becomes ts again."""
    # Only ``at`` goes in: a time column would let Spark drop late rows before they are seen and counted.
    fields = [f for f in processor.fields if f != "at"]
    held = rows.withWatermark("ts", delay).select("symbol", F.unix_micros("ts").alias("at"), *fields)
    schema = ", ".join(f"{n} {t}" for n, t in processor.out.items())
    out = held.groupBy("symbol").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return out.select("symbol", F.timestamp_micros("at").alias("ts"), *[n for n in processor.out if n not in ("symbol", "at")])


class Changes(Ordered):
    """The price before each tick; percentages are made of it outside, as a NaN that leaves pandas becomes null."""

    out = {"symbol": "string", "at": "bigint", "seq": "bigint", "price": "double", "volume": "bigint", "before": "double", "change": "double", "late": "boolean"}

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "price double")

    def begin(self) -> None:
        kept = self.last.get()
        self.price = kept[0] if kept else None

    def step(self, key, rows):
        price = rows["price"].astype(float)
        before = price.shift(1)
        if self.price is not None:
            before.iloc[0] = self.price
        self.price = float(price.iloc[-1])
        return rows.assign(before=before, change=price - before)

    def finish(self) -> None:
        if self.price is not None:
            self.last.update((self.price,))


class Live(Ordered):
    """The step functions of the batch fold; their states are kept as one array for each step."""

    out = {"symbol": "string", "at": "bigint", "seq": "bigint", "price": "double", "sma": "double", "ema": "double", "rsi": "double", "macd": "double", "macd_signal": "double", "macd_histogram": "double", "late": "boolean"}
    fields = {"at": "bigint", "seq": "bigint", "price": "double"}

    def __init__(self, window: int, width: int = HOUR):
        super().__init__(width)
        self.window = window

    def init(self, handle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("steps", "states array<array<double>>")

    def begin(self) -> None:
        self.steps = [Mean(self.window), Ema(12), Rsi(14), Macd()]
        kept = self.kept.get()
        if kept:
            for step, state in zip(self.steps, kept[0]):
                step.load(state)

    def step(self, key, rows):
        mean, ema, rsi, macd = (s.push for s in self.steps)
        made = [(mean(p), ema(p), rsi(p), *macd(p)) for p in rows["price"].tolist()]
        values = dict(zip(("sma", "ema", "rsi", "macd", "macd_signal", "macd_histogram"), zip(*made)))
        return pd.DataFrame({n: rows[n] for n in self.fields} | values, rows.index)

    def finish(self) -> None:
        self.kept.update(([[None if x is None else float(x) for x in s.state()] for s in self.steps],))


class _Side:
    """Open alerts of one direction: sorted so that the next to fire is the last. New ones are sorted in before the next tick."""

    def __init__(self, above: bool, targets: list[float], ids: list[str]):
        self.sign = -1.0 if above else 1.0
        self.open, self.new = list(zip((self.sign * t for t in targets), ids)), []

    def add(self, target: float, alert: str) -> None:
        self.new.append((self.sign * target, alert))

    def drop(self, alert: str) -> None:
        self.open = [o for o in self.open + self.new if o[1] != alert]
        self.open.sort()
        self.new = []

    def fired(self, price: float) -> list[tuple[float, str]]:
        if self.new:
            self.open += self.new
            self.open.sort()  # two sorted runs and a few: near linear
            self.new = []
        out = []
        while self.open and self.open[-1][0] >= self.sign * price:
            out.append(self.open.pop())
        return out

    def arrays(self) -> tuple[list[float], list[str]]:
        both = sorted(self.open + self.new)
        return [self.sign * t for t, _ in both], [a for _, a in both]


class Book(Ordered):
    """Ticks, and alerts that are set and cancelled, by event time; at equal times alerts come first. An alert fires once."""

    fields = {"at": "bigint", "turn": "int", "seq": "bigint", "kind": "string", "alert_id": "string", "price": "double"}
    order = ("at", "turn", "seq")
    out = {"alert_id": "string", "symbol": "string", "at": "bigint", "price": "double", "late": "boolean"}

    def init(self, handle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("book", "above array<double>, above_ids array<string>, below array<double>, below_ids array<string>")

    def begin(self) -> None:
        above, above_ids, below, below_ids = self.kept.get() or ([], [], [], [])
        self.sides = {"above": _Side(True, above, above_ids), "below": _Side(False, below, below_ids)}
        self.known = {a: side for side, ids in (("above", above_ids), ("below", below_ids)) for a in ids}

    def step(self, key, rows):
        out = []
        for at, kind, alert, price in zip(rows["at"], rows["kind"], rows["alert_id"], rows["price"]):
            if kind == "tick":
                for side in self.sides.values():
                    for _, fired in side.fired(price):
                        self.known.pop(fired, None)
                        out.append((fired, at, price))
                continue
            if alert in self.known:  # cancelled, or set anew
                self.sides[self.known.pop(alert)].drop(alert)
            if kind in self.sides:
                self.known[alert] = kind
                self.sides[kind].add(price, alert)
        return pd.DataFrame(out, columns=["alert_id", "at", "price"])

    def finish(self) -> None:
        self.kept.update(tuple(x for side in ("above", "below") for x in self.sides[side].arrays()))

    def belated(self, rows, watermark):
        """A late tick comes out marked; a late alert counts from the watermark on."""
        tick = rows["kind"] == "tick"
        return rows[tick], rows[~tick].assign(at=watermark)


def alert_events(ticks: DataFrame, alerts: DataFrame) -> DataFrame:
    """ticks (symbol, ts, seq, price) and alerts (symbol, ts, alert_id, action, target_price) in one stream for ``Book``.

    An alert's action is ``above`` or ``below`` to set it, or ``cancel``. Of several actions of one time the order is by ``seq``, if alerts have it.
    """
    own = ticks.select("symbol", "ts", F.lit(1).alias("turn"), "seq", F.lit("tick").alias("kind"), F.lit(None).cast("string").alias("alert_id"), "price")
    seq = F.col("seq").cast("long") if "seq" in alerts.columns else F.lit(0).cast("long")
    said = alerts.select("symbol", "ts", F.lit(0).alias("turn"), seq.alias("seq"), F.col("action").alias("kind"), "alert_id", F.col("target_price").cast("double").alias("price"))
    return own.unionByName(said)


class Lateness(StreamingQueryListener):
    """Counts of all rows and of late ones by the name of an observation, as queries report them."""

    def __init__(self):
        self.counts: dict[str, tuple[int, int]] = {}
        self._lock = threading.Lock()

    def onQueryProgress(self, event) -> None:
        with self._lock:
            for name, row in event.progress.observedMetrics.items():
                said = row.asDict()
                if {"lateness_rows", "lateness_late"} <= said.keys():
                    rows, late = self.counts.get(name, (0, 0))
                    self.counts[name] = rows + (said["lateness_rows"] or 0), late + (said["lateness_late"] or 0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass


def counted(rows: DataFrame, name: str) -> DataFrame:
    """The output of an ordered operator, observed for a ``Lateness`` listener."""
    return rows.observe(name, F.count(F.lit(1)).alias("lateness_rows"), F.count_if("late").alias("lateness_late"))


def late_counts(rows: DataFrame) -> DataFrame:
    """(symbol, late): late rows by symbol, of a written output or as a streaming count."""
    return rows.filter("late").groupBy("symbol").agg(F.count("*").alias("late"))
