"""State of the live path: a processor an operator, its state in the RocksDB store by asset.

Rings are map states by slot, so a trigger writes the bars it adds and no others. Each processor takes the rows of an asset in
the order of their time, however many triggers they come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from ..functions.expr import EPS

#: What is kept of a bar: flows, path of returns, price and its step.
RING = ("v_buy", "v_sell", "n_buy", "n_sell", "volume", "quote", "abs_r", "rr", "price", "dp")


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("time", kind="stable")


def micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


class Ring:
    """The last `size` rows of numbers of a key: row k is in slot k % size."""

    def __init__(self, handle, name: str, columns: tuple[str, ...], size: int):
        self.columns, self.size = columns, size
        self.slots = handle.getMapState(name, "slot long", ", ".join(f"{c} double" for c in columns))

    def last(self, seen: int) -> np.ndarray:
        """Rows still held when `seen` rows have been added, oldest first."""
        held = {k[0]: v for k, v in self.slots.iterator()} if seen and self.size else {}
        return np.array([held[k % self.size] for k in range(max(0, seen - self.size), seen)], float).reshape(-1, len(self.columns))

    def add(self, rows: np.ndarray, seen: int) -> None:
        """Rows of which the last makes `seen` in all."""
        for k in range(max(seen - len(rows), seen - self.size), seen):
            self.slots.updateValue((k % self.size,), tuple(map(float, rows[k - seen])))


def rolled(rows: np.ndarray, new: int, seen: int, scales: tuple[int, ...], seconds: int) -> dict[str, np.ndarray]:
    """Features of the last `new` of the rows (columns RING); seen: bars of the segment up to the last row."""
    at = {c: k for k, c in enumerate(RING)}
    price, out = rows[-new:, at["price"]], {}
    have = np.arange(seen - new + 1, seen + 1)
    for w in scales:
        name = f"{w * seconds}s"
        wide = np.concatenate([np.zeros((max(0, w - 1 + new - len(rows)), rows.shape[1])), rows])[-(w - 1 + new) :]
        frames = np.lib.stride_tricks.sliding_window_view(wide, w, axis=0)
        s = {c: frames[:, k].sum(axis=1) for c, k in at.items()}
        full = lambda v, w=w: np.where(have >= w, v, np.nan)
        vwap = s["quote"] / (s["volume"] + EPS)
        out |= {
            f"OFI_{name}": full((s["v_buy"] - s["v_sell"]) / (s["v_buy"] + s["v_sell"] + EPS)), f"TCI_{name}": full((s["n_buy"] - s["n_sell"]) / (s["n_buy"] + s["n_sell"] + EPS)), f"intensity_{name}": full((s["n_buy"] + s["n_sell"]) / (w * seconds)),
            f"VWAP_{name}": full(vwap), f"VWAP_dev_{name}": full((price - vwap) / (vwap + EPS)), f"ILLIQ_{name}": full(s["abs_r"] / (s["volume"] + EPS)), f"RV_{name}": full(np.sqrt(s["rr"])),
        }
        if w > 1:
            x, y = frames[:, at["dp"]], frames[:, at["v_buy"]] - frames[:, at["v_sell"]]
            x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
            sx, sy = np.sqrt((x * x).sum(axis=1) / (w - 1)), np.sqrt((y * y).sum(axis=1) / (w - 1))
            ok = (have >= w) & (sx > 1e-12) & (sy > 1e-12)
            out[f"Kyle_lambda_{name}"] = np.where(ok, (x * y).sum(axis=1) / (w - 1) / np.where(ok, sy, 1) / (sy + EPS), 0.0)
    out["n_trades"] = s["n_buy"] + s["n_sell"]
    return out | {"price": price, "volume": rows[-new:, at["volume"]], "rv": np.sqrt(rows[-new:, at["rr"]])}


class Features(StatefulProcessor):
    """All features of each bar; a new month starts anew, bars without trades are filled in when the next one closes."""

    def __init__(self, seconds: int, scales: tuple[int, ...], names: list[str]):
        self.seconds, self.scales, self.names = seconds, scales, names

    def init(self, handle) -> None:
        self.ring = Ring(handle, "bars", RING, max(self.scales) - 1)
        self.carry = handle.getValueState("carry", "seen long, last long, lp double, us long, month string, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        step = self.seconds * 1_000_000
        seen, last, lp, us, month, price = self.carry.get() if self.carry.exists() else (0, None, 0.0, 0, "", None)
        before = self.ring.last(seen)
        made, times, gaps = [], [], []
        for b in in_order(rows).itertuples():
            at = b.time.value // 1000
            if (m := b.time.strftime("%Y-%m")) != month:
                if made:
                    yield self._found(key, before, made, seen, times, gaps)
                before, seen, month, last, made, times, gaps = before[:0], 0, m, None, [], [], []
            while last is not None and last + step < at:
                last, seen = last + step, seen + 1
                made.append([0.0] * 8 + [price, 0.0])
                times.append(last)
                gaps.append(0.0)
            first = last is None
            r = 0.0 if first else min(0.5, max(-0.5, b.lp0 - lp))
            n, s, ss = (b.n_dt, b.s_dt, b.ss_dt) if first else (b.n_dt + 1, b.s_dt + (b.us0 - us), b.ss_dt + (b.us0 - us) ** 2)
            made.append([b.v_buy, b.v_sell, b.n_buy, b.n_sell, b.volume, b.quote, b.abs_r + abs(r), b.rr + r * r, b.price, 0.0 if first else b.price - price])
            times.append(at)
            gaps.append(max(0.0, (ss - s * s / n) / (n - 1)) ** 0.5 / (s / n + EPS) if n > 1 else 0.0)
            last, lp, us, seen, price = at, b.lp1, int(b.us1), seen + 1, b.price
        self.ring.add(np.array(made, float), seen)
        self.carry.update((seen, last, lp, us, month, price))
        yield self._found(key, before, made, seen, times, gaps)

    def _found(self, key, before, made, seen, times, gaps) -> pd.DataFrame:
        of = rolled(np.concatenate([before, np.array(made, float)]), len(made), seen, self.scales, self.seconds)
        found = pd.DataFrame(of | {f"CV_dt_{self.seconds}s": gaps})
        found.insert(0, "time", pd.to_datetime(np.array(times), unit="us"))
        found.insert(0, "asset", key[0])
        found["n_trades"] = found["n_trades"].astype("int64")
        return found[["asset", "time", "n_trades", *self.names]]

    def close(self) -> None:
        pass


class Differenced(StatefulProcessor):
    """S3: the price filtered by a kernel (newest first); the raw price while the month's history is short."""

    def __init__(self, weights: list[float]):
        self.kernel = np.array(weights[::-1])

    def init(self, handle) -> None:
        self.ring = Ring(handle, "prices", ("price",), len(self.kernel) - 1)
        self.carry = handle.getValueState("carry", "seen long, month string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, month = self.carry.get() if self.carry.exists() else (0, "")
        before = self.ring.last(seen)[:, 0]
        x = in_order(rows)
        for m, part in x.groupby(x["time"].dt.strftime("%Y-%m")):
            if m != month:
                before, seen, month = before[:0], 0, m
            new = part["price"].to_numpy(float)
            held, out = np.concatenate([before, new]), new.copy()
            if len(held) >= len(self.kernel):
                done = np.lib.stride_tricks.sliding_window_view(held, len(self.kernel)) @ self.kernel
                done = done[-len(new) :]
                out[len(out) - len(done) :] = np.where(np.isfinite(done), done, out[len(out) - len(done) :])
            seen += len(new)
            self.ring.add(new[:, None], seen)
            before = held[max(0, len(held) - len(self.kernel) + 1) :]
            yield pd.DataFrame({"asset": key[0], "time": part["time"], "price": part["price"], "price_fd": out})
        self.carry.update((seen, month))

    def close(self) -> None:
        pass


class Run:
    """How many bars in a row a probability has been above a bound; a bar that doesn't follow at once starts anew."""

    def __init__(self, handle, above: float, k: int, gap_us: int | None):
        self.above, self.k, self.gap = above, k, gap_us
        self.state = handle.getValueState("run", "n long, last long")

    def add(self, times: np.ndarray, probs) -> list[tuple[int, bool]]:
        n, last = self.state.get() if self.state.exists() else (0, None)
        out = []
        for at, p in zip(times.tolist(), probs, strict=True):
            if self.gap is not None and last is not None and at - last > self.gap:
                n = 0
            n, last = (n + 1 if p is not None and p > self.above else 0), at
            out.append((n, n >= self.k))
        if out:
            self.state.update((n, last))
        return out


class Warnings(StatefulProcessor):
    """S5 on rows of (asset, time, prob)."""

    def __init__(self, above: float, k: int, gap_us: int | None):
        self.how = above, k, gap_us

    def init(self, handle) -> None:
        self.run = Run(handle, *self.how)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = in_order(rows)
        found = self.run.add(micros(x["time"]), x["prob"])
        yield pd.DataFrame({"asset": key[0], "time": x["time"], "prob": x["prob"], "consecutive_bars": [n for n, _ in found], "warning_active": [w for _, w in found]})

    def close(self) -> None:
        pass


class Open:
    """Open warnings and the bars that they may need. A timer at a warning's end resolves it."""

    def __init__(self, handle, span_us: int):
        self.handle, self.span = handle, span_us
        self.open = handle.getListState("open", "at long, price double")
        self.bars = handle.getMapState("bars", "at long", "low double, close double")

    def warn(self, times: list[int], prices: list[float]) -> None:
        for at, price in zip(times, prices, strict=True):
            self.open.appendValue((at, price))
            self.handle.registerTimer((at + self.span) // 1000 + 1)

    def bar(self, times: list[int], lows: list[float], closes: list[float]) -> None:
        for at, low, close in zip(times, lows, closes, strict=True):
            self.bars.updateValue((at,), (low, close))

    def resolve(self, watermark_us: int) -> list[tuple]:
        """(at, price, lowest and last relative change in %) of warnings that ended before the watermark."""
        waiting = list(self.open.get()) if self.open.exists() else []
        ended = [w for w in waiting if w[0] + self.span < watermark_us]
        if not ended:
            return []
        held = sorted((k[0], v) for k, v in self.bars.iterator())
        t, low, close = np.array([h[0] for h in held], np.int64), np.array([h[1][0] for h in held], float), np.array([h[1][1] for h in held], float)
        out = []
        for at, price in ended:
            a, z = np.searchsorted(t, [at, at + self.span], side="right")
            out.append((at, price, (low[a:z].min() / price - 1) * 100 if z > a else None, (close[z - 1] / price - 1) * 100 if z > a else None))
        left = [w for w in waiting if w[0] + self.span >= watermark_us]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        self.forget(min([watermark_us, *(at for at, _ in left)]), t.tolist())
        return out

    def forget(self, until_us: int, times: list[int] | None = None) -> None:
        """Bars that no open or coming warning needs."""
        for at in times if times is not None else [k[0] for k in self.bars.keys()]:
            if at <= until_us:
                self.bars.removeKey((at,))


class Outcomes(StatefulProcessor):
    """S5 and S6 on records of an asset: scored bars (prob, price), warnings given (price alone), and minute bars (low, close).

    A scored bar gives a row of kind "score"; where it starts or continues a warning, the warning is open until the watermark
    is past its span, and then gives a row of kind "outcome".
    """

    def __init__(self, span_us: int, above: float, k: int, gap_us: int | None):
        self.span, self.how = span_us, (above, k, gap_us)

    def init(self, handle) -> None:
        self.handle, self.run, self.waiting = handle, Run(handle, *self.how), Open(handle, self.span)
        self.cleared = handle.getValueState("cleared", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x, mark = in_order(rows), timerValues.getCurrentWatermarkInMs() * 1000
        at = micros(x["time"])
        bar, scored = x["low"].notna().to_numpy(), x["prob"].notna().to_numpy()
        self.waiting.bar(at[bar].tolist(), x["low"][bar].tolist(), x["close"][bar].tolist())
        counts = self.run.add(at[scored], x["prob"][scored])
        warned = x["price"].notna().to_numpy() & ~scored
        warned[scored] = [w for _, w in counts]
        self.waiting.warn(at[warned].tolist(), x["price"][warned].tolist())
        before = self.cleared.get()[0] if self.cleared.exists() else 0
        if mark - before > self.span and not self.waiting.open.exists():  # once in a while, where no warning's end does it
            self.waiting.forget(mark)
            self.cleared.update((mark,))
        s = x[scored]
        yield self._rows(key, "score", s["time"], price=s["price"], prob=s["prob"], consecutive_bars=[n for n, _ in counts], warning_active=[w for _, w in counts])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.waiting.resolve(timerValues.getCurrentWatermarkInMs() * 1000)
        at, price, low, end = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [], [])
        yield self._rows(key, "outcome", pd.to_datetime(np.array(at, np.int64), unit="us"), price=price, min_change_pct=low, end_change_pct=end)

    @staticmethod
    def _rows(key, kind: str, times, **columns) -> pd.DataFrame:
        x = pd.DataFrame({"kind": kind, "asset": key[0], "time": times})
        x = x.assign(**{c: np.array(columns[c], float) if c in columns else np.nan for c in ("price", "prob", "min_change_pct", "end_change_pct")})
        return x.assign(consecutive_bars=pd.array(columns.get("consecutive_bars", [None] * len(x)), dtype="Int64"), warning_active=pd.array(columns.get("warning_active", [None] * len(x)), dtype="boolean"))

    def close(self) -> None:
        pass
