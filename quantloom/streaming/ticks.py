"""Streaming forms: tumbling flow statistics with a watermark, and bars that grow with arriving trades."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_flow(trades: DataFrame, window: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """volume, dollar, n_trades of each ticker and window; trades later than the delay are left out. ts has to be a
    TIMESTAMP column."""
    return trades.withWatermark("ts", delay).groupBy("ticker", F.window("ts", window)).agg(F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("dollar"), F.count("*").alias("n_trades")).select("ticker", F.col("window.start").alias("slot"), "volume", "dollar", "n_trades")


BAR_SCHEMA = "ticker string, bar_id long, t timestamp, t_end timestamp, open double, high double, low double, close double, volume double, vwap double, trade_count long"
_STATE = "bar_id long, t timestamp, t_end timestamp, open double, high double, low double, close double, volume double, dollar double, trade_count long"


def streaming_bars(trades: DataFrame, threshold: float) -> DataFrame:
    """Closed volume bars of each ticker in order of arrival (by ts inside a batch); the open bar is the state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        bar_id, t, t_end, o, h, lo, c, v, d, n = state.get if state.exists else (0, None, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "price", "size"], kind="stable")
        out = []
        for ts, p, s in zip(rows["ts"], rows["price"], rows["size"], strict=True):
            if n == 0:
                t, o, h, lo, v, d = ts, p, p, p, 0.0, 0.0
            t_end, h, lo, c, v, d, n = ts, max(h, p), min(lo, p), p, v + s, d + p * s, n + 1
            if v >= threshold:
                out.append((key[0], bar_id, t, t_end, o, h, lo, c, v, d / v if v else c, n))
                bar_id, n = bar_id + 1, 0
        state.update((bar_id, t, t_end, o, h, lo, c, v, d, n))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in BAR_SCHEMA.split(", ")])

    return trades.select("ticker", "ts", F.col("price").cast("double"), F.col("size").cast("double")).groupBy("ticker").applyInPandasWithState(step, BAR_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)
