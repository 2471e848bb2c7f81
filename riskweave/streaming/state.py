"""Trailing features of an account, kept as keyed state of a stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskweave.operators.features import FeatureOptions

#: What a row brings along as numbers.
ROW_NUMBERS = {
    "amount_value": "double",
    "_cancel": "int",
    "_offer": "int",
    "_failed": "int",
    "fee_rate": "double",
    "memo_entropy": "double",
    "memo_length": "double",
    "contains_url": "int",
}
#: Columns of a row that state keeps until the row is final.
ROW_FIELDS = ["account", "hash", "ledger_index", "_us", "destination", "_memo", "_numbers"]
WINDOW_FIELDS = ["_us", "hash", "destination", "_numbers"]
#: Numbers that a measured row leaves with, followed by the sorted rates of its last rows.
OUTPUT_NUMBERS = {
    "amount_value": "double",
    "fee_rate": "double",
    "memo_entropy": "double",
    "memo_length": "double",
    "contains_url": "int",
    "total_volume_5m": "double",
    "rolling_tx_count_5m": "double",
    "_dests": "bigint",
    "_cancels": "bigint",
    "_offers": "bigint",
    "_fails": "bigint",
    "_memo_seen": "double",
    "tx_per_minute": "double",
    "_n": "bigint",
    "_volume_mean": "double",
    "_rate_mean": "double",
    "_rate_std": "double",
}
INPUT_FIELDS = ["_group", "close_time", *ROW_FIELDS]
OUTPUT_SCHEMA = (
    "account string, hash string, ledger_index bigint, _us bigint, _previous bigint, _numbers array<double>"
)


#: Groups of accounts whose state lies together. A stream keeps its number for good.
GROUPS = 16_384


def packed(rows: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Input of :class:`TrailingFeatures`, to be grouped by ``_group``.

    Every group of accounts costs calls of the state store and a conversion per column.
    """
    group = F.pmod(F.xxhash64("account"), F.lit(groups)).cast("int")
    numbers = F.array(*[F.col(n).cast("double") for n in ROW_NUMBERS])
    return rows.select(group.alias("_group"), *INPUT_FIELDS[1:-1], numbers.alias("_numbers"))


def unpacked(measured: DataFrame) -> DataFrame:
    """Output of :class:`TrailingFeatures` with a column for each number."""
    at = [F.col("_numbers")[i] for i in range(len(OUTPUT_NUMBERS))]
    return measured.select(
        *[c for c in measured.columns if c != "_numbers"],
        *[
            F.when(~F.isnan(v), v).cast(kind).alias(name)
            for v, (name, kind) in zip(at, OUTPUT_NUMBERS.items(), strict=True)
        ],
        F.slice("_numbers", len(at) + 1, F.size("_numbers") - len(at)).alias("_rates"),
    )


#: Different memos of an account that lie together in one value; more go to a map.
MEMOS_TOGETHER = 256

_AT = {name: i for i, name in enumerate(ROW_FIELDS)}
_NUMBER = {name: i for i, name in enumerate(ROW_NUMBERS)}


class TrailingFeatures(StatefulProcessor):
    """Holds rows until the watermark passes them, then emits their measures.

    A row is final once no row with an equal or earlier time can arrive, so the
    result does not depend on how the stream was cut into batches. State per
    account: rows still open, rows of one time window, the last ``rows`` volumes
    and rates, the previous ledger, and a counter per memo.

    Every call of the state store and every frame that leaves costs far more than a row.
    So accounts are dealt to groups, whose open rows are stored as they arrived together,
    and what the measured accounts of a group leave behind is one value. An account's
    memos are counted in that value too, until there are ``MEMOS_TOGETHER``; then they
    move to a map with an entry each, so that an account with many memos isn't rewritten
    with every batch.
    """

    def __init__(self, opts: FeatureOptions, memo_ttl_ms: int | None = None):
        self.opts, self.memo_ttl_ms = opts, memo_ttl_ms
        # Memos expire one by one: then each has its own entry from the start.
        self.memos_together = 0 if memo_ttl_ms else MEMOS_TOGETHER

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open_rows = handle.getListState("open_rows", "columns binary")
        self.trail = handle.getValueState("trail", "trail binary")
        self.memos = handle.getMapState(
            "memos", "account string, memo string", "seen bigint", ttlDurationMs=self.memo_ttl_ms
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            # Columns come in the order they were selected; Spark rewrites names with a leading underscore.
            columns = [column.tolist() for _, column in pdf.items()][-len(ROW_FIELDS) :]
            # Numbers beside a NULL arrive as floats.
            ledgers = columns[_AT["ledger_index"]]
            columns[_AT["ledger_index"]] = [None if pd.isna(v) else int(v) for v in ledgers]
            columns[_AT["hash"]] = [None if pd.isna(v) else v for v in columns[_AT["hash"]]]
            columns[_AT["_numbers"]] = [v.tolist() for v in columns[_AT["_numbers"]]]
            self.open_rows.appendValue((pickle.dumps(columns),))
            self._wake(columns)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        final_us = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [pickle.loads(columns) for (columns,) in self.open_rows.get()]
        if not parts:
            return
        rows = [[v for part in same for v in part] for same in zip(*parts)]
        times = rows[_AT["_us"]]
        ready = [i for i, us in enumerate(times) if us <= final_us]
        if len(ready) < len(times):
            waiting = [[column[i] for i, us in enumerate(times) if us > final_us] for column in rows]
            self.open_rows.put([(pickle.dumps(waiting),)])
            self._wake(waiting)
        else:
            self.open_rows.clear()
        if ready:
            account, ledger, name = (rows[_AT[n]] for n in ("account", "ledger_index", "hash"))
            place = lambda i: (
                account[i], ledger[i] is None, ledger[i] or 0, times[i], name[i] is None, name[i] or ""
            )
            ready.sort(key=place)
            stored = self.trail.get()
            # The trails of accounts without a row stay as they are stored.
            trails = pickle.loads(stored[0]) if stored else {}
            parts = []
            for of, same in groupby(ready, key=account.__getitem__):
                same = list(same)
                new = {n: [rows[at][i] for i in same] for n, at in _AT.items()}
                trail = pickle.loads(trails[of]) if of in trails else self._start()
                parts.append(self._measure(of, new, trail))
                trails[of] = pickle.dumps(trail)
            self.trail.update((pickle.dumps(trails),))
            ledgers, before, numbers = ([v for part in parts for v in part[k]] for k in range(3))
            columns = {
                "account": [account[i] for i in ready],
                "hash": [name[i] for i in ready],
                "ledger_index": pd.array(ledgers, dtype="Int64"),
                "_us": [times[i] for i in ready],
                "_previous": pd.array(before, dtype="Int64"),
                "_numbers": numbers,
            }
            yield pd.DataFrame(columns)

    def close(self) -> None:
        pass

    def _wake(self, columns: list[list]) -> None:
        """A timer for the earliest open row; those after it are taken along or re-timed."""
        self.handle.registerTimer(-(-min(columns[_AT["_us"]]) // 1000))

    def _start(self) -> dict:
        """The trail of an account without rows."""
        return {
            "window": [[] for _ in WINDOW_FIELDS], "last": ([], []), "previous": None,
            "memos": {}, "in_map": self.memos_together == 0,
        }

    def _measure(self, account: str, new: dict[str, list], trail: dict) -> tuple[list, list, list]:
        """Ledgers, the ledgers before, and numbers of an account's final rows, in their order."""
        numbers = np.array(new["_numbers"], dtype=np.float64)
        out = {n: numbers[:, i] for n, i in _NUMBER.items() if n in OUTPUT_NUMBERS}
        out |= self._time_window(new, trail)
        out["tx_per_minute"] = out["rolling_tx_count_5m"] / self.opts.minutes
        held, rates = self._row_window(out, trail)
        out |= held
        out["_memo_seen"] = self._count_memos(account, new["_memo"], trail)
        together = np.column_stack([*[out[n] for n in OUTPUT_NUMBERS], rates])
        ends = (len(OUTPUT_NUMBERS) + out["_n"]).tolist()
        ledgers, before = new["ledger_index"], trail["previous"]
        trail["previous"] = ledgers[-1]
        return ledgers, [before, *ledgers[:-1]], [line[:end] for line, end in zip(together, ends, strict=True)]

    def _time_window(self, new: dict[str, list], trail: dict) -> dict:
        """Measures over the trailing time window; ``trail`` keeps the rows of the newest one."""
        length = self.opts.window_us
        window = [kept + new[n] for n, kept in zip(WINDOW_FIELDS, trail["window"], strict=True)]
        unsorted = np.array(window[0], dtype=np.int64)
        order = np.argsort(unsorted, kind="stable")
        times, at = unsorted[order], np.array(new["_us"], dtype=np.int64)
        _, hashes, dests, numbers = window
        numbers = np.array(numbers, dtype=np.float64)[order]
        first = np.searchsorted(times, at - length, side="right")
        end = np.searchsorted(times, at, side="right")
        # reduceat needs an element past the last end.
        bounds = np.column_stack([first, end]).ravel()

        def add(values):
            return np.add.reduceat(np.append(values, 0.0), bounds)[::2]

        inside = order[times > times[-1] - length].tolist()
        trail["window"] = [[column[i] for i in inside] for column in window]
        return {
            "total_volume_5m": add(numbers[:, _NUMBER["amount_value"]]),
            "rolling_tx_count_5m": add(np.array([h is not None for h in hashes], dtype=np.float64)[order]),
            "_cancels": add(numbers[:, _NUMBER["_cancel"]]),
            "_offers": add(numbers[:, _NUMBER["_offer"]]),
            "_fails": add(numbers[:, _NUMBER["_failed"]]),
            "_dests": distinct_within([dests[i] for i in order.tolist()], first, end),
        }

    def _row_window(self, out: dict, trail: dict) -> tuple[dict, np.ndarray]:
        """Measures over the last ``rows`` rows, and their sorted rates, a line for each new row.

        ``trail`` keeps the rows before the next one.
        """
        rows, n = self.opts.rows, len(out["tx_per_minute"])
        before = len(trail["last"][0])
        volume, rate = (
            np.concatenate([np.array(kept, dtype=np.float64), fresh])
            for kept, fresh in zip(trail["last"], (out["total_volume_5m"], out["tx_per_minute"]), strict=True)
        )
        trail["last"] = tuple(v[len(v) - min(len(v), rows - 1) :].tolist() for v in (volume, rate))
        held = np.minimum(np.arange(before + 1, before + n + 1), rows)

        def frames(values, fill):
            """A line for each new row: its last ``rows`` values, ``fill`` where there are fewer."""
            padded = np.concatenate([np.full(rows - 1, fill), values])
            return np.lib.stride_tricks.sliding_window_view(padded, rows)[before:]

        rate_mean = frames(rate, 0.0).sum(axis=1) / held
        filled = np.arange(rows) >= rows - held[:, None]
        away = np.where(filled, frames(rate, 0.0) - rate_mean[:, None], 0.0)
        spread = np.sqrt((away * away).sum(axis=1) / np.maximum(held - 1, 1))
        measures = {
            "_n": held,
            "_volume_mean": frames(volume, 0.0).sum(axis=1) / held,
            "_rate_mean": rate_mean,
            "_rate_std": np.where(held > 1, spread, 0.0),
        }
        return measures, np.sort(frames(rate, np.inf), axis=1)

    def _count_memos(self, account: str, memos: list[str], trail: dict) -> list[float]:
        """How often each memo came before; ``trail`` counts on, or the map does."""
        counts, seen = trail["memos"], []
        known = {} if trail["in_map"] else counts
        for memo in memos:
            if memo not in known:
                stored = self.memos.getValue((account, memo)) if trail["in_map"] else None
                known[memo] = stored[0] if stored else 0
            seen.append(float(known[memo]))
            known[memo] += 1
        if len(known) > self.memos_together or trail["in_map"]:
            for memo, n in known.items():
                self.memos.updateValue((account, memo), (n,))
            trail["memos"], trail["in_map"] = {}, True
        return seen


def distinct_within(values: list, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Different values in each span ``values[first:end]``, if later ends never have earlier firsts.

    Each value enters and leaves once, whatever the spans hold.
    """
    found = np.zeros(len(first), dtype=np.int64)
    inside: dict = {}
    low = high = 0
    for i in np.argsort(end, kind="stable").tolist():
        low_to, high_to = int(first[i]), int(end[i])
        for value in values[high:high_to]:
            inside[value] = inside.get(value, 0) + 1
        high = max(high, high_to)
        for value in values[low:low_to]:
            inside[value] -= 1
            if not inside[value]:
                del inside[value]
        low = max(low, low_to)
        found[i] = len(inside)
    return found
