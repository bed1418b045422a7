"""Parameter sweeps that shuffle bars, never the grid.

Bars are dealt once by series (and slice of the grid); a task holds one series and works out its combinations as a second
axis, a block of them at a time, so memory is a few arrays of ``CELLS`` numbers plus the series. The grid, a configuration table, travels with
the task. Windows of all lengths come from one prefix sum. Results equal those of the window functions in
``positions`` and ``metrics``, which suit few combinations and long series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.scalars import ZERO

#: Numbers in an array of bars x combinations.
CELLS = 1 << 21
#: A grid beyond this is an error: it is no configuration table.
MOST_COMBOS = 1_000_000
STATISTICS = "sharpe double, sortino double, omega double, tail_ratio double, profit double, pain_index double, max_drawdown double, cagr double, trades long, calmar double"

Signals = Callable[[dict[str, np.ndarray], list[dict]], tuple[np.ndarray, np.ndarray]]


def configured(grid: DataFrame) -> list[dict]:
    """The grid's rows; the driver holds a configuration table, not data."""
    rows = grid.limit(MOST_COMBOS + 1).collect()
    if len(rows) > MOST_COMBOS:
        raise ValueError(f"A grid of more than {MOST_COMBOS} combinations")
    return [r.asDict() for r in rows]


def sliced(bars: DataFrame, combos: int, per_task: int) -> DataFrame:
    """Bars with ``_slice``: a copy for each ``per_task`` combinations, not for each combination."""
    slices = max(1, -(-combos // per_task))
    return bars.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))


def windowed_means(close: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Means of the last ``lengths`` values (bars x lengths), of fewer at the start. Sums are of differences from the first
    value, which keeps them exact for longer."""
    shift = close[0] if len(close) else 0.0
    total = np.concatenate([[0.0], np.cumsum(close - shift)])
    end = np.arange(1, len(close) + 1)[:, None]
    start = np.maximum(end - lengths, 0)
    return shift + (total[end] - total[start]) / (end - start)


def sma_signals(series: dict[str, np.ndarray], combos: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Entry while the fast average is over the slow one, exit otherwise; each distinct length is averaged once."""
    lengths, place = np.unique([n for c in combos for n in (int(c["fast"]), int(c["slow"]))], return_inverse=True)
    means = windowed_means(series["close"], lengths)
    entry = means[:, place[0::2]] > means[:, place[1::2]]
    return entry, ~entry


def positions(entry: np.ndarray, exit_: np.ndarray) -> np.ndarray:
    """The state after each bar's signals: entry alone sets, exit alone clears, both toggle."""
    toggles = np.cumsum(entry & exit_, axis=0)
    alone = entry != exit_
    last = np.maximum.accumulate(np.where(alone, np.arange(1, len(entry) + 1)[:, None], 0), axis=0) - 1
    base = np.where(last >= 0, np.take_along_axis(entry, np.maximum(last, 0), 0), False)
    before = np.where(last >= 0, np.take_along_axis(toggles, np.maximum(last, 0), 0), 0)
    return (base + toggles - before) % 2


def curves(close: np.ndarray, after: np.ndarray, fee: float, fill_delay: int = 1) -> tuple[np.ndarray, ...]:
    """(held, returns, equity, drawdown) for each combination; the last bar closes the position."""
    n, c = after.shape
    fee = max(0.0, fee)
    held = after.copy() if fill_delay == 0 else np.concatenate([np.zeros((1, c), after.dtype), after[:-1]])
    held[-1] = 0
    before = np.concatenate([np.zeros((1, c), held.dtype), held[:-1]])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.concatenate([[np.nan], close[1:] / close[:-1] - 1])
    gain[~np.isfinite(gain)] = np.nan
    r = (1 + before * gain[:, None]) * (1 - fee * np.abs(held - before))
    if n > 1:
        r[1] *= 1 - fee * before[1]  # a fill on bar 0 is paid on bar 1
    r = np.where(np.isnan(r), 0.0, r - 1)
    equity = np.cumprod(1 + r, axis=0)
    return held, r, equity, equity / np.maximum.accumulate(equity, axis=0) - 1


def _ratio(excess: np.ndarray, spread: np.ndarray) -> np.ndarray:
    edge = np.where(np.abs(excess) <= ZERO, 0.0, np.where(excess > 0, np.inf, -np.inf))
    return np.where(spread == 0, edge, excess / np.where(spread == 0, 1, spread))


def statistics(ts: np.ndarray, close: np.ndarray, after: np.ndarray, fee: float, fill_delay: int, periods: int) -> dict[str, np.ndarray]:
    """The ten statistics of each combination, as ``metrics`` defines them."""
    held, r, equity, drawdown = curves(close, after, fee, fill_delay)
    n = len(r)
    root, mean = periods**0.5, r.mean(0)
    gains, losses = np.where(r > 0, r, 0).sum(0), -np.where(r < 0, r, 0).sum(0)
    high, low = np.abs(np.quantile(r, [0.95, 0.05], axis=0))
    under = (drawdown < 0).sum(0)
    first, last = equity[0], equity[-1]
    days = int((ts[-1] - ts[0]) // np.timedelta64(1, "D"))
    years = days / 365.25 if days > 0 else n / periods
    worst = drawdown.min(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        growth = np.where((n >= 2) & (first > 0) & (last > 0), np.power(np.maximum(last, 0), 1 / years) - 1, np.nan)
        out = {
            "sharpe": _ratio(mean * periods, r.std(0) * root),
            "sortino": _ratio(mean * periods, np.minimum(r, 0).std(0) * root),
            "omega": np.where(losses <= ZERO, np.where(gains > 0, np.inf, np.nan), gains / np.where(losses <= ZERO, 1, losses)),
            "tail_ratio": np.where(low <= ZERO, np.where(high > 0, np.inf, np.nan), high / np.where(low <= ZERO, 1, low)),
            "profit": last / first - 1,
            "pain_index": -np.where(drawdown < 0, drawdown, 0).sum(0) / np.maximum(under, 1) + 0.0,
            "max_drawdown": worst,
            "cagr": growth,
            "trades": ((held[1:] == 0) & (held[:-1] == 1)).sum(0),
            "calmar": np.where((worst < 0) & np.isfinite(growth), growth / np.where(worst < 0, np.abs(worst), 1), np.nan),
        }
    return out


def sweep_statistics(bars: DataFrame, grid: DataFrame, keys: list[str], signals: Signals = sma_signals, fee: float = 0.001, fill_delay: int = 1, periods: int = 252, columns: tuple[str, ...] = ("close",), per_task: int = 256) -> DataFrame:
    """(keys, combo_id, the ten statistics) of every series and combination; one shuffle, of bars.

    ``grid`` has ``combo_id`` and the strategy's parameters. ``signals`` gets a series' arrays (``ts`` and ``columns``) and a block of
    combinations and gives entries and exits (bars x combinations). A series is sorted by ``ts`` in its task.
    """
    combos = configured(grid)
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields if f.name in keys)
    names = ("ts", *columns)

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        series = {c: table.column(c).to_numpy() for c in names}
        order = np.argsort(series["ts"], kind="stable")
        series = {c: v[order] for c, v in series.items()}
        mine = combos[key[-1].as_py() * per_task : (key[-1].as_py() + 1) * per_task]
        step = max(1, CELLS // max(1, len(order)))
        for at in range(0, len(mine), step):
            block = mine[at : at + step]
            found = statistics(series["ts"], series["close"], positions(*signals(series, block)), fee, fill_delay, periods)
            out = {k: pa.array([v.as_py()] * len(block), v.type) for k, v in zip(keys, key)} | {"combo_id": pa.array([c["combo_id"] for c in block], pa.int32())}
            yield pa.RecordBatch.from_pydict(out | {s.split()[0]: pa.array(found[s.split()[0]]) for s in STATISTICS.split(", ")})

    needed = sliced(bars.select(*keys, *names), len(combos), per_task) if combos else bars.select(*keys, *names).limit(0).withColumn("_slice", F.lit(0))
    return needed.groupBy(*keys, "_slice").applyInArrow(work, f"{key_types}, combo_id int, {STATISTICS}")


def combos_table(spark, pairs: list[tuple[int, int]]) -> DataFrame:
    """A grid of (fast, slow) pairs, numbered in order."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "combo_id int, fast int, slow int")


def pandas_strategy(bars: DataFrame, grid: DataFrame, keys: list[str], generate: Callable[[pd.DataFrame, dict], tuple[pd.Series, pd.Series]], per_task: int = 64) -> DataFrame:
    """Any Python strategy on one series and combination at a time: rows of bars with the combination, entry, exit and error.

    Bars cross the shuffle once for each ``per_task`` combinations; a task gives one combination's rows after another. A combination whose strategy
    raises gives rows with the error and no signals, and the sweep goes on. ``generate`` may be a function, a callable or an object
    with ``generate_signals``; it gets the series in order of ``ts``, with the combination's columns beside it.
    """
    call = getattr(generate, "generate_signals", generate)
    combos = configured(grid)
    fields = [*bars.schema.fields, *grid.schema.fields, *StructType.fromDDL("entry boolean, exit boolean, error string").fields]
    schema = StructType([StructField(f.name, f.dataType, True) for f in fields])
    dealt = sliced(bars, len(combos), per_task)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series = pd.concat(frames).sort_values("ts", kind="stable")
        mine = int(series["_slice"].iloc[0])
        series = series.drop(columns="_slice").reset_index(drop=True)
        for combo in combos[mine * per_task : (mine + 1) * per_task]:
            frame = series.assign(**{c: [v] * len(series) for c, v in combo.items()})
            try:
                entries, exits = call(frame.copy(), dict(combo["params"]))
                yield frame.assign(entry=_flags(entries, frame), exit=_flags(exits, frame), error=None)
            except Exception as error:  # a strategy is the user's code: its failure is a result
                yield frame.assign(entry=False, exit=False, error=f"{type(error).__name__}: {error}")

    return dealt.groupBy(*keys, "_slice").applyInPandas(run, schema)


def _flags(values, frame: pd.DataFrame) -> pd.Series:
    return pd.Series(values, index=frame.index).fillna(False).astype(bool)
