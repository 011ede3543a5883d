"""Footprints of many symbols at once: one step of numpy arrays for all runs and thresholds.

Sessions whose look-back has the same highest high are one run; its cascade begins at that high. All
runs of a stretch of symbols go side by side, so a step costs a few array operations and a session a
few array elements, whatever the look-back. Comparisons are those of Spark: NaN is above all numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of whole symbols that are worked on together; a symbol is bounded by the calendar.
ROWS = 50_000

FIELDS = ("legs", "since", "deepest", "tightest", "pivot")


def whole_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in the order of `symbol` put together into tables that cut no symbol."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < ROWS:
            continue
        table = pa.Table.from_batches(waiting).combine_chunks()
        last = int(symbol_starts(table)[-1])
        if last:
            yield table.slice(0, last)
            waiting = table.slice(last).to_batches()
    if any(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting)


def symbol_starts(table: pa.Table) -> np.ndarray:
    """Where the rows of a symbol begin; NULL is a symbol too."""
    names = table.column("symbol").combine_chunks().dictionary_encode(null_encoding="encode")
    codes = np.asarray(names.indices)
    return np.nonzero(np.diff(codes, prepend=-1))[0]


def _ge(a, b):
    return (a >= b) | np.isnan(a)


def _gt(a, b):
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _with_fall(now: dict, peak, on, depth) -> dict:
    """What is found once this fall is a leg: one at least as deep as the last starts a new base."""
    goes_on = (now["legs"] > 0) & ~_ge(depth, now["tightest"])
    return {
        "legs": np.where(goes_on, now["legs"] + 1, 1), "since": np.where(goes_on, now["since"], on),
        "deepest": np.where(goes_on, now["deepest"], depth), "tightest": depth, "pivot": peak,
    }


def prints(high: np.ndarray, low: np.ndarray, date: np.ndarray, begin: np.ndarray,
           steps: np.ndarray, quiet: np.ndarray, thresholds: tuple[float, ...], ratio: float,
           floor_pct: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """What the cascades of runs have found, by (slot, threshold), and each run's first slot.

    A run begins at place `begin` of the sessions and takes `steps` more; it says what it has found
    after each step from number `quiet` on, in a slot of its own.
    """
    slots = steps - quiet + 1
    first = np.cumsum(slots) - slots
    width = len(thresholds)
    out = {n: np.zeros((int(slots.sum()), width), np.int32 if n in ("legs", "since") else np.float64)
           for n in FIELDS}
    order = np.argsort(-steps, kind="stable")
    begin, steps, quiet, slot = begin[order], steps[order], quiet[order], first[order]
    shape = (len(begin), width)
    falling = np.ones(shape, bool)
    peak, on, trough = (np.repeat(v[begin][:, None], width, 1) for v in (high, date, low))
    pct = np.tile(np.array(thresholds, np.float64), (len(begin), 1))
    found = {n: np.zeros(shape, v.dtype) for n, v in out.items()}
    for step in range(1, int(steps[0]) + 1 if len(steps) else 1):
        n = int(np.searchsorted(-steps, -step, side="right"))  # the longest runs come first
        falling, peak, on, trough, pct = (v[:n] for v in (falling, peak, on, trough, pct))
        found = {k: v[:n] for k, v in found.items()}
        at = begin[:n] + step
        h, lo, day = high[at][:, None], low[at][:, None], date[at][:, None]
        lower = np.fmin(trough, lo)
        done = falling & _gt(peak, 0.0) & _ge(h, lower * (1 + pct / 100.0))
        turns = ~falling & _ge(np.maximum(peak, h) * (1 - pct / 100.0), lo)
        i = np.nonzero(done)
        if len(i[0]):
            depth = (peak[i] - lower[i]) / peak[i] * 100.0
            for k, v in _with_fall({k: v[i] for k, v in found.items()}, peak[i], on[i], depth).items():
                found[k][i] = v
            pct[i] = np.maximum(floor_pct, depth * ratio)
        higher = done | (~falling & _gt(h, peak))
        falls_on = falling & ~done
        peak, on = np.where(higher, h, peak), np.where(higher, day, on)
        trough = np.where(falls_on, lower, lo)
        falling = falls_on | turns
        said = np.nonzero(quiet[:n] <= step)[0]
        if len(said):
            p, low_ = peak[said], trough[said]
            now = {k: v[said] for k, v in found.items()}
            running = falling[said] & _gt(p, low_) & _gt(low_, 0.0)
            with np.errstate(all="ignore"):
                depth = (p - low_) / p * 100.0
            more = _with_fall(now, p, on[said], depth)
            to = slot[said] + step - quiet[said]
            for k, v in now.items():
                out[k][to] = np.where(running, more[k], v)
    return out, first


def _numbers(table: pa.Table, name: str, missing=None) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return (column if missing is None else column.fill_null(missing)).to_numpy(zero_copy_only=False)


def footprints_of(table: pa.Table, thresholds: tuple[float, ...], ratio: float,
                  floor_pct: float) -> Iterator[pa.RecordBatch]:
    """(symbol, session, initial_pct, seen, FIELDS) of the sessions of whole symbols, in order."""
    starts = symbol_starts(table)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    usable = np.asarray(table.column("high").combine_chunks().is_valid())
    places = np.nonzero(usable)[0]
    high, low, date = (_numbers(table, n, m)[places] for n, m in (
        ("high", 0.0), ("low", 0.0), ("day", None)))
    number, since_first, block = (_numbers(table, n) for n in ("u", "first", "block"))
    best, rest = (_numbers(table, n, 0.0) for n in ("best_high", "rest_high"))
    best_at, rest_at = (_numbers(table, n, 0) for n in ("best_u", "rest_u"))  # 0: there is none
    complete = np.bincount(owner, usable, minlength=len(starts)).astype(np.int64)
    before = (np.cumsum(complete) - complete)[owner]
    # The base: the higher one of the block before, from the look-back's first session on, and of
    # the session's own block so far.
    base = best_at.astype(np.int64)
    asks = np.nonzero(since_first <= complete[owner])[0]
    old = places[before[asks] + since_first[asks] - 1]
    older = (block[old] == block[asks] - 1) & (
        (best_at[asks] == 0) | _ge(rest[old], best[asks]))
    base[asks[older]] = rest_at[old[older]]

    change = np.ones(table.num_rows, bool)
    change[1:] = (base[1:] != base[:-1]) | (owner[1:] != owner[:-1])
    begins = np.nonzero(change)[0]
    run = np.cumsum(change) - 1
    upto = number[np.append(begins[1:], table.num_rows) - 1]
    # Two sessions have to follow the highest high.
    since = np.maximum(number[begins], base[begins] + 2)
    asked = (base[begins] > 0) & (upto >= base[begins] + 2)
    some = begins[asked]
    out, first = prints(high, low, date, before[some] + base[some] - 1, upto[asked] - base[some],
                        since[asked] - base[some], thresholds, ratio, floor_pct)
    slot_of_run = np.full(len(begins), -1, np.int64)
    slot_of_run[asked] = first
    told = asked[run] & (number >= since[run])
    slot = np.where(told, slot_of_run[run] + number - since[run], 0)
    width = len(thresholds)
    known = np.repeat(told, width)
    columns = {}
    for name, values in out.items():
        flat = values[slot].ravel() if len(values) else np.zeros(len(known), values.dtype)
        known_here = known & (columns["legs"] > 0) if columns else known
        columns[name] = np.where(known_here, flat, 0)
        if name == "legs":
            continue
        kind = pa.int32() if name == "since" else pa.float64()
        columns[name] = pa.array(columns[name].astype(values.dtype), kind, mask=~known_here)
    every = np.repeat(np.arange(table.num_rows), width)
    columns["legs"] = pa.array(columns["legs"].astype(np.int32))
    taken = table.select(["symbol", "date", "seen"]).combine_chunks().take(pa.array(every))
    yield from pa.table(
        [taken.column("symbol"), taken.column("date"),
         pa.array(np.tile(np.array(thresholds, np.float64), table.num_rows)), taken.column("seen"),
         *[columns[n] if n != "since" else columns[n].cast(pa.date32()) for n in FIELDS]],
        names=["symbol", "session", "initial_pct", "seen", *FIELDS]).to_batches(20_000)
