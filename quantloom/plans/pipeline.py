"""The two batch pipelines as lazy plans: raw ticks to clean trades, clean trades to labelled bars."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import CleaningConfig, ProcessingConfig
from ..operators import bars as bars_
from ..operators import clean, nbbo
from ..operators.features import engineer_features
from ..operators.labels import label_bars
from ..session import written


def clean_trades(raw: DataFrame, config: CleaningConfig = CleaningConfig(), narrow: bool = False) -> DataFrame:
    """Trades with the quote that held, codes filtered, flags set. All steps are keyed by ticker and date."""
    # Quotes and trades both read these rows; written once, so that raw rows are scanned and deduplicated once.
    rows = written(clean.prepared(raw, config), "prepared")
    book = nbbo.build_nbbo(clean.quotes(rows), config.ffill_cap_seconds)
    out = nbbo.merge_nbbo(clean.trades(rows), book)
    if config.compute_microstructure_flags:
        out = clean.with_micro_flags(out, config.at_bid_ask_tolerance)
    out = clean.apply_cond_filter(out)
    return clean.finalize(out, ("event_id", "date")) if narrow else out


def labelled_bars(trades: DataFrame, threshold: str | float, config: ProcessingConfig = ProcessingConfig(), order: tuple[str, ...] = bars_.ORDER) -> DataFrame:
    made = bars_.with_duration(bars_.volume_bars(trades, threshold, order))
    return label_bars(engineer_features(made, config.features), config.labels)
