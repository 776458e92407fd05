"""The registry: every operator as a query over the test tables, with its SQL where SQL can express it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleaningConfig, FeatureConfig, LabelConfig, ProcessingConfig, config_hash, dump_config, load_config, plain
from ..functions import conditions
from ..functions.timefns import local_to_utc, utc_to_local
from ..models import forest, gbm_data, gmm, metrics, persist, quantile_boost, scaling
from ..operators import backtest, bars, clean, cv, explore, features, labels, nbbo, quality
from ..session import shared_path, written
from ..sources import fixtures, ticks
from . import pipeline
from .sql import BARRIER_MINUTES, CAP_SECONDS, CONTEXT_MINUTES, HALFLIFE, THRESHOLD, query

CLEANING = CleaningConfig(ffill_cap_seconds=CAP_SECONDS)
PROCESSING = ProcessingConfig(features=FeatureConfig(context_window_minutes=CONTEXT_MINUTES), labels=LabelConfig(time_barrier_minutes=BARRIER_MINUTES, ewm_halflife=HALFLIFE))
VECTORS = [f"f{i}" for i in range(9)]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, **replaced: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = query(sql, **replaced)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums of doubles depend on their order."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema])


def _r(columns: str, digits: int = 6) -> str:
    """SQL for columns "a b=expression": each rounded."""
    out = []
    for c in columns.split(";"):
        name, _, expr = c.strip().partition("=")
        out.append(f"round(cast({expr.strip() or name.strip()} as double), {digits}) \"{name.strip()}\"")
    return ", ".join(out)


# --- inputs shared by queries ------------------------------------------------------------------------------


def _raw(s: SparkSession, d: str) -> DataFrame:
    return fixtures.raw_ticks(s, d)


def _ticks(s: SparkSession, d: str) -> DataFrame:
    return clean.prepared(_raw(s, d), CLEANING)


def _quotes(s: SparkSession, d: str) -> DataFrame:
    return clean.quotes(_ticks(s, d))


def _merged(s: SparkSession, d: str) -> DataFrame:
    rows = written(_ticks(s, d), "ticks")
    return nbbo.merge_nbbo(clean.trades(rows), nbbo.build_nbbo(clean.quotes(rows), CAP_SECONDS))


def _cleaned(s: SparkSession, d: str) -> DataFrame:
    return pipeline.clean_trades(_raw(s, d), CLEANING)


def _bars(s: SparkSession, d: str) -> DataFrame:
    return bars.with_duration(bars.volume_bars(_cleaned(s, d), THRESHOLD))


def _features(s: SparkSession, d: str) -> DataFrame:
    return features.engineer_features(_bars(s, d), PROCESSING.features)


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return labels.label_bars(_features(s, d), PROCESSING.labels)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return fixtures.table(s, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(VECTORS)])


def _returns(s: SparkSession, d: str) -> DataFrame:
    return gbm_data.with_forward_return(fixtures.scored(s, d))


def _trades(s: SparkSession, d: str) -> DataFrame:
    rows = backtest.test_day(_returns(s, d), "2025-10-05")
    return backtest.simulate(rows, 0.5, "proba", "pred_q10", "pred_q50")


# --- sources and sinks -------------------------------------------------------------------------------------

_RAW = "event_id, ticker, date, ts, type, " + _r("price") + ", size, exch, cond"


def _two_tables(s: SparkSession, d: str) -> DataFrame:
    """The raw ticks in two Parquet tables with their columns in another order, and a file that isn't Parquet, scanned as one."""
    path, rows = shared_path(s, "union"), _raw(s, d)
    rows.filter("ticker <= 'T1'").write.parquet(f"{path}/a")
    rows.filter("ticker > 'T1'").select(*reversed(rows.columns)).write.parquet(f"{path}/b")
    s.createDataFrame([("not a table",)], "value string").coalesce(1).write.text(f"{path}/c")
    jvm = s.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(jvm.Path(f"{path}/c/part-*")):
        fs.rename(found.getPath(), jvm.Path(f"{path}/b/broken.parquet"))
    return ticks.scan_parquet(s, f"{path}/a", f"{path}/b")


@register("s5_scan_union", f"select {_RAW} from raw")
def s5_scan_union(s, d):
    return rounded(_two_tables(s, d).select("event_id", "ticker", "date", "ts", "type", "price", "size", "exch", "cond"))


@register("s5_skipped_files", "select 'broken.parquet' file, 'failed' status, 'no rows could be read' error")
def s5_skipped_files(s, d):
    return ticks.skipped_files(_two_tables(s, d))


@register("s5_scan_tickers", "select ticker, count(*) n from raw where ticker in ('T0', 'T3') group by ticker")
def s5_scan_tickers(s, d):
    path = shared_path(s, "tickers")
    _raw(s, d).write.parquet(path)
    return ticks.scan_parquet(s, path, tickers=["T0", "T3"]).groupBy("ticker").agg(F.count("*").alias("n"))


@register("s7_config", "select * from (values ('bar_method', true), ('changed', false), ('features', true), ('labels', true)) v(name, equal)")
def s7_config(s, d):
    """The knobs dumped as YAML and loaded again; their hash tells a changed one."""
    with tempfile.TemporaryDirectory() as folder:
        out = dump_config(PROCESSING, f"{folder}/knobs.yaml")
        back = load_config(f"{folder}/knobs.yaml")
    changed = replace(PROCESSING, labels=replace(PROCESSING.labels, k=9.0))
    rows = [("bar_method", plain(back) == plain(PROCESSING)), ("features", back.features == PROCESSING.features), ("labels", back.labels == PROCESSING.labels), ("changed", config_hash(changed) == out["config_hash"])]
    return s.createDataFrame(rows, "name string, equal boolean")


@register("s9_persistence", "select count(*) n, cast(0 as bigint) different from embeddings")
def s9_persistence(s, d):
    """A mixture saved and loaded scores every vector as before."""
    rows, model = _mixture(s, d, "diag", 5)
    path = shared_path(s, "model")
    persist.save_mixture(s, model, path)
    a = gmm.score(rows, model).select("vec_id", F.col("gmm_loglik").alias("a"), F.col("gmm_component").alias("ca"))
    b = gmm.score(rows, persist.load_mixture(s, path)).select(F.col("vec_id").alias("id"), F.col("gmm_loglik").alias("b"), F.col("gmm_component").alias("cb"))
    return a.join(b, F.col("vec_id") == F.col("id")).agg(F.count("*").alias("n"), F.count_if((F.abs(F.col("a") - F.col("b")) > 1e-9) | (F.col("ca") != F.col("cb"))).alias("different"))


@register("s11_copy", "select count(*) n, count(distinct event_id) ids, " + _r("total=sum(price)", 4) + " from raw")
def s11_copy(s, d):
    path = shared_path(s, "copy")
    _raw(s, d).write.parquet(f"{path}/a")
    ticks.copy_table(s, f"{path}/a", f"{path}/b")
    return rounded(s.read.parquet(f"{path}/b").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.sum("price").alias("total")), 4)


@register("s6_parquet_sink", "select ticker, date, count(*) n, " + _r("volume=sum(size)") + " from cleaned group by all")
def s6_parquet_sink(s, d):
    path = shared_path(s, "clean")
    ticks.sink_parquet(_cleaned(s, d), path)
    back = ticks.scan_parquet(s, path)
    return rounded(back.groupBy(F.col("ticker").cast("string").alias("ticker"), F.col("date").cast("date").alias("date")).agg(F.count("*").alias("n"), F.sum("size").cast("double").alias("volume")))


def _exported(s: SparkSession, d: str) -> str:
    path = shared_path(s, "raw")
    ticks.export_raw_csv(_raw(s, d).withColumns({"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "price": F.col("price").cast("string"), "size": F.col("size").cast("string")}), path)
    return path


@register("s2_s3_s4_csv_scan", "select ticker, strftime(date, '%-m-%-d-%y') date_text, count(*) n, " + _r("total=sum(price)", 4) + ", count(distinct ts) times from raw group by all")
def s2_s3_s4_csv_scan(s, d):
    """The raw ticks as files TICKER/TICKER_DATE.csv with junk lines, then scanned."""
    rows = ticks.drop_junk(ticks.scan_raw_csv(s, _exported(s, d), "*.csv"))
    return rounded(rows.groupBy("ticker", "date_text").agg(F.count("*").alias("n"), F.sum(F.col("price").cast("double")).alias("total"), F.countDistinct("ts").alias("times")), 4)


@register("s3_glob", "select ticker, strftime(date, '%-m-%-d-%y') date_text, count(*) n from raw where strftime(date, '%-m') = '1' group by all")
def s3_glob(s, d):
    """Only the files of one month."""
    return ticks.drop_junk(ticks.scan_raw_csv(s, _exported(s, d), "*_1-*.csv")).groupBy("ticker", "date_text").agg(F.count("*").alias("n"))


@register("s8_metadata_sinks", "select ticker, count(*) n from raw group by ticker")
def s8_metadata_sinks(s, d):
    path = shared_path(s, "metadata")
    ticks.sink_metadata(_raw(s, d).groupBy("ticker").agg(F.count("*").alias("n")), path)
    a = s.read.parquet(f"{path}.parquet")
    return a.intersect(s.read.schema("ticker string, n bigint").option("header", "true").csv(f"{path}.csv"))


@register("s10_codebook_scan", "select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in conditions.CODEBOOK.items()) + ") v(code, bucket)")
def s10_codebook_scan(s, d):
    """The codebook as CSV, read back."""
    path = shared_path(s, "codes")
    ticks.codebook_table(s).withColumns({"description": F.lit("of the fixed list"), "source": F.lit("")}).coalesce(1).write.option("header", "true").csv(path)
    return ticks.scan_codebook(s, path).select("code", "bucket")


@register("s10_codebook", "select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in conditions.CODEBOOK.items()) + ") v(code, bucket)")
def s10_codebook(s, d):
    return ticks.codebook_table(s)


# --- cleaning ----------------------------------------------------------------------------------------------


@register("c1_c3_parse", "select event_id, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') + interval 5 hour ts, case when event_id % 7 = 0 then null else round(value, 6) end price, case when event_id % 11 = 0 then null else event_id % 50 end size from events where event_id % 13 <> 0")
def c1_c3_parse(s, d):
    e = fixtures.table(s, d, "events")
    raw = e.select("event_id", F.when(F.col("event_id") % 13 == 0, " Dates ").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"), F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("value").cast("string")).alias("price"), F.when(F.col("event_id") % 11 == 0, "").otherwise((F.col("event_id") % 50).cast("string")).alias("size"))
    return rounded(clean.parse_raw(raw).select("event_id", "ts", "price", "size"))


_ZONE = dict(
    walls="""select event_id, case event_id % 3 when 0 then ts when 1 then timestamp '2025-03-08 22:00:00' + to_minutes(cast(event_id // 3 % 600 as bigint))
      else timestamp '2025-11-01 22:00:00' + to_minutes(cast(event_id // 3 % 600 as bigint)) end "local" from events"""
)


def _walls(s: SparkSession, d: str) -> DataFrame:
    """Local times around both changes of the clocks of 2025, and the events' own (in winter)."""
    minute = F.floor(F.col("event_id") / 3) % 600
    near = lambda t: F.timestamp_add("MINUTE", minute.cast("int"), F.lit(t).cast("timestamp_ntz"))
    kind = F.col("event_id") % 3
    return fixtures.table(s, d, "events").select("event_id", F.when(kind == 0, F.col("ts").cast("timestamp_ntz")).when(kind == 1, near("2025-03-08 22:00:00")).otherwise(near("2025-11-01 22:00:00")).alias("local"))


# The times that come twice count as the first here.
@register("c2_timezones", """select event_id, case when "local" >= timestamp '2025-03-09 02:00:00' and "local" < timestamp '2025-03-09 03:00:00' then timestamp '2025-03-09 07:00:00'
  when "local" >= timestamp '2025-03-09 03:00:00' and "local" < timestamp '2025-11-02 02:00:00' then "local" + interval 4 hour else "local" + interval 5 hour end utc from walls""", **_ZONE)
def c2_timezones(s, d):
    return _walls(s, d).select("event_id", local_to_utc(F.col("local"), "America/New_York").alias("utc"))


@register("c2_inferred", "select place, timestamp '2025-11-02 04:00:00' + to_minutes(place) utc from (select unnest(range(0, 300)) as place) g")
def c2_inferred(s, d):
    """Five hours of one file through the night on which clocks go back: its order tells the second hour from the first."""
    utc = F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit("2025-11-02 04:00:00").cast("timestamp_ntz"))
    wall = F.date_format(utc_to_local(utc, "America/New_York"), "yyyy-MM-dd HH:mm:ss")
    raw = s.range(300).select(F.col("id").alias("place"), wall.alias("ts"), F.lit("T").alias("ticker"), F.lit("11-2-25").alias("date_text"), F.lit("1").alias("price"), F.lit("1").alias("size"))
    return clean.parse_raw(raw, row="place").select("place", F.col("ts").alias("utc"))


@register("c1_c4_file_counts", """select event_id % 5 file, count(*) raw_rows, count(*) filter (where not (event_id % 7 = 0 or event_id % 17 = 0) and event_id % 11 = 0) dropped_invalid_price,
  count(*) filter (where not (event_id % 7 = 0 or event_id % 17 = 0) and event_id % 11 <> 0 and event_id % 19 = 0) dropped_invalid_size, count(*) filter (where event_id % 7 = 0 or event_id % 17 = 0) dropped_nulls from events group by 1""")
def c1_c4_file_counts(s, d):
    """Missing and unparsable times, bad prices and sizes, counted in the file they come from."""
    e, bad = fixtures.table(s, d, "events"), lambda m: F.col("event_id") % m == 0
    ts = F.when(bad(7), F.lit(None).cast("string")).when(bad(17), "12 o'clock").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    raw = e.select(ts.alias("ts"), F.lit("TRADE").alias("type"), F.when(bad(11), "-1").otherwise("2.5").alias("price"), F.when(bad(19), "0").otherwise("3").alias("size"), F.concat(F.lit("T"), (F.col("event_id") % 5).cast("string")).alias("ticker"), F.lit("10-2-25").alias("date_text"))
    out = clean.drop_counts(clean.parse_raw(raw))
    return out.filter("date = date'2025-10-02'").select(F.substring("ticker", 2, 1).cast("bigint").alias("file"), "raw_rows", "dropped_invalid_price", "dropped_invalid_size", "dropped_nulls")


@register("c4_validity", f"select {_RAW} from valid")
def c4_validity(s, d):
    return rounded(clean.valid_rows(_raw(s, d)))


@register("c4_drop_counts", "select ticker, date, count(*) raw_rows, count(*) filter (where not price > 0) dropped_invalid_price, count(*) filter (where price > 0 and not size > 0) dropped_invalid_size, cast(0 as bigint) dropped_nulls from raw group by ticker, date")
def c4_drop_counts(s, d):
    return clean.drop_counts(_raw(s, d))


@register("c6_normalize", "select cond, cond_norm, count(*) n from norm group by all")
def c6_normalize(s, d):
    return clean.with_cond_norm(clean.valid_rows(_raw(s, d))).groupBy("cond", "cond_norm").agg(F.count("*").alias("n"))


@register("c7_classify", "select distinct cond_norm, keep, array_to_string(list_sort(unknown), ',') unknown from judged")
def c7_classify(s, d):
    c = F.col("cond_norm")
    return _merged(s, d).select("cond_norm", conditions.kept(c).alias("keep"), F.array_join(F.array_sort(conditions.unknown_tokens(c)), ",").alias("unknown")).distinct()


@register("c5_c8_dedup", "select event_id, ticker, date, ts, type, " + _r("price") + ", size, exch, cond, cond_norm from ticks")
def c5_c8_dedup(s, d):
    return rounded(_ticks(s, d))


@register("c8_dedup_stats", "select ticker, date, cast(sum(n) as bigint) initial_rows, cast(sum(n) - count(*) as bigint) duplicates_removed, " + _r("dup_pct=100.0 * (sum(n) - count(*)) / sum(n)") + " from (select ticker, date, count(*) n from norm group by ticker, date, ts, type, price, size, exch, cond_norm) group by ticker, date")
def c8_dedup_stats(s, d):
    return rounded(clean.dedup_stats(clean.with_cond_norm(clean.valid_rows(_raw(s, d)))))


@register("c9_split", "select case when type = 'TRADE' then 'trade' else 'quote' end side, count(*) n from ticks group by 1")
def c9_split(s, d):
    rows = _ticks(s, d)
    return clean.trades(rows).select(F.lit("trade").alias("side")).unionAll(clean.quotes(rows).select(F.lit("quote").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


_TRADE = "event_id, ticker, date, ts, type, " + _r("price") + ", size, exch, cond, cond_norm, " + _r("nbb;nbo") + ", nbb_size, nbo_size, " + _r("mid;spread")


@register("c10_condition_filter", f"select {_TRADE}, at_bid, at_ask from cleaned")
def c10_condition_filter(s, d):
    return rounded(_cleaned(s, d))


@register("c10_filter_stats", "select ticker, date, count(*) before, count(*) filter (where keep) after, count(*) filter (where not keep) dropped, " + _r("dropped_pct=100.0 * count(*) filter (where not keep) / count(*)") + ", coalesce(array_to_string(list_sort(list_distinct(flatten(list(unknown)))), ','), '') unknown_codes from judged group by ticker, date")
def c10_filter_stats(s, d):
    return rounded(clean.cond_filter_stats(_merged(s, d)))


@register("c11_finalize", "select event_id, date, ts, ticker, type, cast(price as float) price, cast(size as int) size, cond, cond_norm, exch, cast(nbb as float) nbb, cast(nbo as float) nbo, cast(nbb_size as int) nbb_size, cast(nbo_size as int) nbo_size, cast(mid as float) mid, cast(spread as float) spread, at_bid, at_ask from cleaned")
def c11_finalize(s, d):
    return clean.finalize(_cleaned(s, d), ("event_id", "date"))


@register("c12_flags", "select event_id, at_bid, at_ask from flagged_trades")
def c12_flags(s, d):
    return clean.with_micro_flags(_merged(s, d)).select("event_id", "at_bid", "at_ask")


# --- best bid and offer ------------------------------------------------------------------------------------

_BOOK = "ticker, date, ts, " + _r("nbb") + ", nbb_size, " + _r("nbo") + ", nbo_size"


@register("n1_last_quotes", f"select {_BOOK} from lastq")
def n1_last_quotes(s, d):
    return rounded(nbbo.last_quotes(_quotes(s, d)))


@register("n2_outer_join", f"select {_BOOK} from lastq")
def n2_outer_join(s, d):
    return rounded(nbbo.last_quotes_joined(_quotes(s, d)).select("ticker", "date", "ts", *nbbo.QUOTE_COLUMNS))


@register("n3_capped_ffill", f"select {_BOOK} from filled")
def n3_capped_ffill(s, d):
    return rounded(nbbo.ffill_capped(nbbo.last_quotes(_quotes(s, d)), nbbo.QUOTE_COLUMNS, CAP_SECONDS))


@register("n4_n5_n7_nbbo", f"select {_BOOK}, " + _r("mid;spread") + " from book")
def n4_n5_n7_nbbo(s, d):
    return rounded(nbbo.build_nbbo(_quotes(s, d), CAP_SECONDS))


@register("n5_stats", "select ticker, date, count(*) total_quote_stamps, count(*) filter (where nbb is not null and nbo is not null) complete_stamps, count(*) filter (where nbo < nbb) crossed_quotes, " + _r("crossed_quotes_pct=coalesce(100.0 * count(*) filter (where nbo < nbb) / nullif(count(*) filter (where nbb is not null and nbo is not null), 0), 0)") + " from filled group by ticker, date")
def n5_stats(s, d):
    return rounded(nbbo.nbbo_stats(_quotes(s, d), CAP_SECONDS))


@register("j1_asof_join", f"select {_TRADE} from merged")
def j1_asof_join(s, d):
    return rounded(_merged(s, d))


@register("j1_coverage", "select ticker, date, count(*) before, count(mid) after, " + _r("nbbo_coverage_pct=100.0 * count(mid) / count(*)") + " from met group by ticker, date")
def j1_coverage(s, d):
    rows = written(_ticks(s, d), "ticks")
    return rounded(nbbo.coverage(clean.trades(rows), nbbo.build_nbbo(clean.quotes(rows), CAP_SECONDS)))


# --- bars --------------------------------------------------------------------------------------------------


@register("b0_thresholds", "select ticker, cast(least(greatest(round_even(median(v) / 60 / 10, 0) * 10, 50), 100000) as bigint) threshold from (select ticker, date, sum(size) v from cleaned group by all) group by ticker")
def b0_thresholds(s, d):
    return bars.volume_thresholds(_cleaned(s, d), target_bars=60, least=50, step=10)


@register("b1_segments", "select event_id, ticker, date, bar_id from segmented")
def b1_segments(s, d):
    return bars.segment_by_threshold(_cleaned(s, d), THRESHOLD).select("event_id", "ticker", "date", "bar_id")


_BAR = "ticker, date, bar_id, t, t_end, " + _r('open;high;low;close="close"') + ", volume, " + _r("vwap") + ", trade_count"


@register("b2_b3_volume_bars", f"select {_BAR} from bars")
def b2_b3_volume_bars(s, d):
    return rounded(bars.volume_bars(_cleaned(s, d), THRESHOLD))


@register("b4_validate", """select ticker, date, count(*) n_bars, count(*) filter (where high < low or high < open or high < "close" or low > open or low > "close" or low <= 0) invalid_ohlc, count(*) filter (where volume <= 0) invalid_volume,
  count(*) filter (where trade_count <= 0) invalid_trade_count, cast(0 as bigint) time_backwards, true is_valid from bars group by ticker, date""")
def b4_validate(s, d):
    return bars.validate_bars(_bars(s, d))


@register("b5_statistics", "select ticker, count(*) n_bars, " + _r("mean_volume=avg(volume);median_volume=median(volume);mean_trade_count=avg(trade_count);mean_duration=avg(duration_seconds);median_duration=median(duration_seconds)", 4) + " from timed_bars group by ticker")
def b5_statistics(s, d):
    return rounded(bars.bar_statistics(_bars(s, d)), 4)


_LI = dict(
    li="select l_returnflag || l_linestatus ticker, make_date(cast(year(l_shipdate) as int), 1, 1) date, cast(l_shipdate as timestamp) ts, l_extendedprice / l_quantity price, l_quantity size, l_orderkey k1, l_linenumber k2, l_partkey k3, l_suppkey k4, l_extendedprice k5 from lineitem",
    linum="select *, row_number() over (partition by ticker, date order by ts, k1, k2, k3, k4, k5) rn, sum(size) over (partition by ticker, date) / 300 lim from li",
    liseg="""select ticker, date, rn, size cum, 0 bar_id, size >= lim is_full from linum where rn = 1 union all
      select n.ticker, n.date, n.rn, case when s.is_full then 0 else s.cum end + n.size, s.bar_id + cast(s.is_full as int), case when s.is_full then 0 else s.cum end + n.size >= lim from liseg s join linum n on n.ticker = s.ticker and n.date = s.date and n.rn = s.rn + 1""",
    liall="select n.*, cast(s.bar_id as bigint) bar_id, max(s.is_full) over (partition by n.ticker, n.date, s.bar_id) done from linum n join liseg s on n.ticker = s.ticker and n.date = s.date and n.rn = s.rn",
)
LI_ORDER = ("ts", "k1", "k2", "k3", "k4", "k5")


@register("b6_generic_bars", "select ticker, date, bar_id, min(ts) t, max(ts) t_end, " + _r('open=arg_min(price, rn);high=max(price);low=min(price);close=arg_max(price, rn);volume=sum(size)', 10) + ", " + _r("vwap=sum(price * size) / sum(size) + 2e-7", 6) + ", count(*) num_trades, " + _r("dollar_value=sum(price * size)", 2) + ", " + _r("duration=(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6;return=ln(arg_max(price, rn) / arg_min(price, rn))", 10) + " from liall where done group by ticker, date, bar_id", **_LI)
def b6_generic_bars(s, d):
    # Averages here often end on a five exactly; the small addend rounds them alike on both sides.
    out = bars.generic_bars(fixtures.lineitem_trades(s, d), "volume", 300, LI_ORDER)
    return rounded(out.withColumns({"dollar_value": F.round("dollar_value", 2), "vwap": F.round(F.col("vwap") + 2e-7, 6)}), 10)


# --- features and labels -----------------------------------------------------------------------------------

_FEATS = _r("; ".join(features.FEATURES))


@register("f1_f6_features", f"select ticker, date, bar_id, {_FEATS} from feats")
def f1_f6_features(s, d):
    return rounded(_features(s, d).select("ticker", "date", "bar_id", *features.FEATURES))


@register("f7_narrow", "select ticker, date, bar_id, " + ", ".join(f"cast(round({c}, 4) as float) {c}" for c in features.FEATURES) + " from feats")
def f7_narrow(s, d):
    rows = rounded(_features(s, d).select("ticker", "date", "bar_id", *features.FEATURES), 4)
    return rows.select("ticker", "date", "bar_id", *[F.col(c).cast("float").alias(c) for c in features.FEATURES])


@register("f8_validate", " union all ".join(f"select '{c}' feature, count(*) filter (where {c} is null) nan_count, cast(0 as bigint) inf_count, " + _r(f"min=min({c});max=max({c});mean=avg({c});std=stddev_samp({c})", 5) + " from feats" for c in features.FEATURES))
def f8_validate(s, d):
    return rounded(features.validate_features(_features(s, d)), 5)


@register("l1_l2_volatility", "select ticker, date, bar_id, " + _r("ret;ewm_std", 8) + " from vol")
def l1_l2_volatility(s, d):
    return rounded(labels.barrier_volatility(_features(s, d), HALFLIFE).select("ticker", "date", "bar_id", "ret", "ewm_std"), 8)


@register("l3_l4_triple_barrier", "select ticker, date, bar_id, label, label_t_end, label_barrier_hit, " + _r("label_holding_period_seconds") + " from labelled")
def l3_l4_triple_barrier(s, d):
    return rounded(_labelled(s, d).select("ticker", "date", "bar_id", "label", "label_t_end", "label_barrier_hit", "label_holding_period_seconds"))


_KNOWN = "label_barrier_hit <> ''"
_SUMMARY = f"""count(*) n, count(*) filter (where {_KNOWN}) n_labeled, count(*) filter (where {_KNOWN} and label = 1) n_up, count(*) filter (where {_KNOWN} and label = -1) n_down, count(*) filter (where {_KNOWN} and label = 0) n_zero,
  count(*) filter (where label_barrier_hit = 'upper') hit_upper, count(*) filter (where label_barrier_hit = 'lower') hit_lower, count(*) filter (where label_barrier_hit = 'time') hit_time, """ + _r("; ".join(f"holding_{n}={f}(label_holding_period_seconds) filter (where {_KNOWN})" for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"))), 4) + f""",
  greatest(count(*) filter (where {_KNOWN} and label = 1), count(*) filter (where {_KNOWN} and label = -1), count(*) filter (where {_KNOWN} and label = 0)) > 0.6 * count(*) filter (where {_KNOWN}) imbalanced"""


@register("l5_summary", f"select {_SUMMARY} from labelled")
def l5_summary(s, d):
    return rounded(labels.label_summary(_labelled(s, d)), 4)


@register("l5_holding_by_label", f"select label, count(*) n, {_r('avg_holding=avg(label_holding_period_seconds)', 4)} from labelled where {_KNOWN} group by label")
def l5_holding_by_label(s, d):
    return rounded(labels.holding_by_label(_labelled(s, d)), 4)


@register("l6_grid_search", f"select k, {_SUMMARY} from labelled group by k", ks="select * from (values (0.75::double), (1.0::double), (1.25::double)) v(k)")
def l6_grid_search(s, d):
    return rounded(labels.grid_search_k(_features(s, d), LabelConfig().k_grid, HALFLIFE, BARRIER_MINUTES), 4)


# --- cross-validation --------------------------------------------------------------------------------------


def _roles(s: SparkSession, d: str) -> DataFrame:
    return cv.fold_roles(_labelled(s, d).select("ticker", "date", "bar_id", "t", "t_end", "label_t_end"))


@register("v1_v2_v3_roles", "select ticker, date, bar_id, fold, role from roles")
def v1_v2_v3_roles(s, d):
    return _roles(s, d).select("ticker", "date", "bar_id", "fold", "role")


@register("v4_fold_metadata", "select fold, test_day, val_start, val_end, " + ", ".join(f"count(*) filter (where role = '{r}') n_{r}" for r in ("train", "val", "purged", "embargoed")) + ", val_end + interval 20 minute embargo_cutoff from roles group by all")
def v4_fold_metadata(s, d):
    return cv.fold_metadata(_roles(s, d))


@register("v5_validate", "select fold, cast(0 as bigint) overlap, " + _r("coverage=count(*) filter (where role in ('train', 'val')) / count(*)") + ", count(*) filter (where role in ('train', 'val')) / count(*) < 0.5 low_coverage, true is_valid from roles group by fold")
def v5_validate(s, d):
    return rounded(cv.validate_folds(_roles(s, d), ("ticker", "date", "bar_id")))


@register("v6_split_first_days", "select date, case when no <= 4 then 'train' else 'test' end split, count(*) n from (select date, dense_rank() over (order by date) no from bars) where no <= 5 group by all")
def v6_split_first_days(s, d):
    return cv.split_first_days(written(_bars(s, d), "bars")).groupBy("date", "split").agg(F.count("*").alias("n"))


@register("v7_split_last_day", "select date, case when date = (select max(date) from bars) then 'test' else 'train' end split, count(*) n from bars group by all")
def v7_split_last_day(s, d):
    return cv.split_last_day(written(_bars(s, d), "bars")).groupBy("date", "split").agg(F.count("*").alias("n"))


# --- models ------------------------------------------------------------------------------------------------


@register("m1_m2_finite", "select vec_id, label, " + _r("; ".join(VECTORS)) + " from vectors where vec_id % 17 <> 0")
def m1_m2_finite(s, d):
    odd = F.when(F.col("vec_id") % 34 == 0, float("nan")).otherwise(float("inf"))
    return rounded(scaling.finite_rows(_vectors(s, d).withColumn("f0", F.when(F.col("vec_id") % 17 == 0, odd).otherwise(F.col("f0"))), VECTORS))


@register("m3_scaler", "select vec_id, " + _r("; ".join(f"{c}=({c} - avg({c}) over ()) / stddev_pop({c}) over ()" for c in VECTORS), 5) + " from vectors")
def m3_scaler(s, d):
    return rounded(scaling.scaled(_vectors(s, d), VECTORS).drop("label"), 5)


def _mixture(s: SparkSession, d: str, kind: str, iterations: int = 15) -> tuple[DataFrame, gmm.Mixture]:
    rows = written(scaling.scaled(_vectors(s, d), VECTORS), "gmm")
    return rows, gmm.fit(rows, VECTORS, gmm.GMMParams(3, kind, max_iter=iterations))


@register("m4_m5_m6_gmm_full")
def m4_m5_m6_gmm_full(s, d):
    rows, model = _mixture(s, d, "full")
    return gmm.score(rows, model).select("vec_id", "gmm_loglik", "gmm_component")


@register("m4_gmm_diag")
def m4_gmm_diag(s, d):
    rows, model = _mixture(s, d, "diag")
    return gmm.score(rows, model).select("vec_id", "gmm_loglik", "gmm_component")


@register("m7_gmm_tuning")
def m7_gmm_tuning(s, d):
    rows = written(scaling.scaled(_vectors(s, d), VECTORS).withColumn("day", F.col("vec_id") % 2), "gmm")
    _, results = gmm.tune(rows, VECTORS, "day", [gmm.GMMParams(k, c, max_iter=4) for k in (2, 3) for c in ("full", "diag")])
    return s.createDataFrame([(r["params"].n_components, r["params"].covariance_type, r["mean"], r["std"], r["aic"], r["bic"]) for r in results], "n_components int, covariance_type string, mean double, std double, aic double, bic double")


def _loglik(s: SparkSession, d: str) -> DataFrame:
    return fixtures.scored(s, d).select("id", "date", "ticker", "label", (-F.col("proba") * 10 - F.col("ewm_std")).alias("gmm_loglik"))


_LL = dict(ll="select id, date, ticker, label, -proba * 10 - ewm_std gmm_loglik, case when date = (select max(date) from scored) then 'test' else 'train' end split from scored", thr="select quantile_cont(gmm_loglik, 0.05) threshold, avg(gmm_loglik) mean, stddev_pop(gmm_loglik) std from ll", flagged="select ll.*, gmm_loglik <= threshold gmm_is_candidate from ll, thr t")


@register("m8_threshold", "select " + _r("threshold;mean;std") + " from thr", **_LL)
def m8_threshold(s, d):
    return rounded(gmm.choose_threshold(_loglik(s, d)))


def _flagged(s: SparkSession, d: str, q: float = 0.05) -> DataFrame:
    rows = cv.split_last_day(_loglik(s, d))
    return gmm.flag_candidates(rows, gmm.choose_threshold(rows, q))


_METRIC = "count(*) n, " + _r("mean_loglik=avg(gmm_loglik);candidate_rate=avg(cast(gmm_is_candidate as int))") + ", " + ", ".join(f"count(*) filter (where {'' if f else 'not '}gmm_is_candidate and label = {v}) {'flagged' if f else 'other'}_{w}" for f in (True, False) for v, w in ((1, "up"), (-1, "down"), (0, "zero")))


@register("m9_candidates", f"select split, {_METRIC} from flagged group by split", **_LL)
def m9_candidates(s, d):
    return rounded(gmm.candidate_metrics(_flagged(s, d)))


@register("m10_reflag", f"select split, {_METRIC} from flagged group by split", **(_LL | {"thr": _LL["thr"].replace("0.05", "0.1")}))
def m10_reflag(s, d):
    return rounded(gmm.candidate_metrics(_flagged(s, d, 0.1)))


@register("r1_opportunities", "select id, date, label, cast(label = 1 as int) y, date \"day\" from flagged where gmm_is_candidate", **_LL)
def r1_opportunities(s, d):
    return forest.opportunities(_flagged(s, d)).select("id", "date", "label", "y", "day")


@register("r2_r8_forest")
def r2_r8_forest(s, d):
    rows = _vectors(s, d).withColumn("y", (F.col("label") >= 5).cast("int"))
    model, scaler = forest.fit(rows, VECTORS, trees=20, depth=5, leaf=5, features="sqrt")
    return forest.score(rows, model, scaler, VECTORS).select("vec_id", "y", "rf_proba_reversion")


@register("r2_forest_tuning")
def r2_forest_tuning(s, d):
    rows = _vectors(s, d).withColumns({"y": (F.col("label") >= 5).cast("int"), "day": F.col("vec_id") % 2})
    _, results = forest.tune(rows, VECTORS, grid={"trees": (5,), "depth": (3, 5), "leaf": (5,), "features": ("sqrt",)})
    return s.createDataFrame([(r["depth"], r["accuracy"], r["precision"], r["recall"], r["f1"], r["auc"]) for r in results], "depth int, accuracy double, precision double, recall double, f1 double, auc double")


@register("r8_importances")
def r8_importances(s, d):
    rows = _vectors(s, d).withColumn("y", (F.col("label") >= 5).cast("int"))
    model, _ = forest.fit(rows, VECTORS, trees=10, depth=4)
    return s.createDataFrame(forest.importances(model, VECTORS), "feature string, importance double")


_CONF = dict(conf="select count(*) filter (where y = 0 and proba < 0.5) tn, count(*) filter (where y = 0 and proba >= 0.5) fp, count(*) filter (where y = 1 and proba < 0.5) fn, count(*) filter (where y = 1 and proba >= 0.5) tp from scored", mw="select (sum(case when y = 1 then r end) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0) / (count(*) filter (where y = 1) * count(*) filter (where y = 0)) auc from (select y, rank() over (order by proba) + (count(*) over (partition by proba) - 1) / 2.0 r from scored)")


@register("r3_metrics", "select " + _r("accuracy=(tp + tn) / (tp + tn + fp + fn);precision=tp / (tp + fp);recall=tp / (tp + fn);f1=2 * tp / (2 * tp + fp + fn);auc") + " from conf, mw m", **_CONF)
def r3_metrics(s, d):
    return rounded(metrics.classification_metrics(fixtures.scored(s, d)))


@register("r4_confusion", "select tn, fp, fn, tp from conf", **_CONF)
def r4_confusion(s, d):
    return metrics.confusion(fixtures.scored(s, d).withColumn("pred", (F.col("proba") >= 0.5).cast("int")))


@register("r5_roc_pr", "select " + _r("threshold=proba;tpr=sum(p) over w / sum(p) over ();fpr=(sum(n) over w - sum(p) over w) / (sum(n) over () - sum(p) over ());precision=sum(p) over w / sum(n) over w") + " from (select proba, sum(y) p, count(*) n from scored group by proba) window w as (order by proba desc)")
def r5_roc_pr(s, d):
    return rounded(metrics.roc_pr_curve(fixtures.scored(s, d)))


_SWEEP = "select " + _r("threshold=i / 100.0;precision=coalesce(tp / nullif(tp + fp, 0), 0);recall=tp / (tp + fn);f1=coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0);accuracy=(tp + tn) / (tp + tn + fp + fn)") + " from (select i, count(*) filter (where y = 1 and proba * 100 + 1e-9 >= i) tp, count(*) filter (where y = 0 and proba * 100 + 1e-9 >= i) fp, count(*) filter (where y = 1 and proba * 100 + 1e-9 < i) fn, count(*) filter (where y = 0 and proba * 100 + 1e-9 < i) tn from scored, (select unnest(range(0, 101)) i) g group by i)"


@register("r6_threshold_sweep", _SWEEP)
def r6_threshold_sweep(s, d):
    return rounded(metrics.threshold_sweep(fixtures.scored(s, d)))


@register("r6_best_threshold", f"select * from ({_SWEEP}) s order by f1 desc, threshold limit 1")
def r6_best_threshold(s, d):
    return metrics.best_threshold(rounded(metrics.threshold_sweep(fixtures.scored(s, d))))


@register("r7_calibration", "select cast(len(list_filter(e, lambda x: x < proba)) as int) bin, count(*) n, " + _r("mean_pred=avg(proba);mean_y=avg(y)") + " from scored, (select quantile_cont(proba, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) e from scored) q group by 1")
def r7_calibration(s, d):
    return rounded(metrics.calibration_curve(fixtures.scored(s, d)))


@register("j2_g1_join_volatility", "select s.id, s.date, " + _r("ewm_std=p.v", 8) + " from scored s left join (select ticker, t, arg_min(ewm_std, id) v from scored group by ticker, t) p on s.ticker = p.ticker and s.t = p.t")
def j2_g1_join_volatility(s, d):
    rows = fixtures.scored(s, d)
    return rounded(gbm_data.join_volatility(rows.drop("ewm_std"), rows.withColumn("bar_id", F.col("id"))).select("id", "date", "ewm_std"), 8)


@register("g2_forward_returns", "select label, count(*) n, " + _r("mean=avg(forward_return);std=stddev_samp(forward_return)", 8) + " from returns group by label")
def g2_forward_returns(s, d):
    return rounded(gbm_data.forward_return_stats(_returns(s, d)), 8)


@register("g2_describe", "select count(forward_return) count, " + _r("mean=avg(forward_return);std=stddev_samp(forward_return);min=min(forward_return);p25=quantile_cont(forward_return, 0.25);p50=quantile_cont(forward_return, 0.5);p75=quantile_cont(forward_return, 0.75);max=max(forward_return)", 8) + " from returns")
def g2_describe(s, d):
    return rounded(gbm_data.describe(_returns(s, d), "forward_return"), 8)


@register("g3_dataset", "select id, split, " + _r("feat_vwap_zscore=(feat_vwap_zscore - m) / sd", 5) + " from (select *, case when date = (select max(date) from returns where proba >= 0.3) then 'test' else 'train' end split from returns where proba >= 0.3) a, (select avg(feat_vwap_zscore) m, stddev_pop(feat_vwap_zscore) sd from returns where proba >= 0.3 and date < (select max(date) from returns where proba >= 0.3)) b")
def g3_dataset(s, d):
    return rounded(gbm_data.prepare(_returns(s, d), ["feat_vwap_zscore"], 0.3, "proba").select("id", "split", "feat_vwap_zscore"), 5)


@register("g4_quantile_boost")
def g4_quantile_boost(s, d):
    rows = _vectors(s, d).withColumn("target", F.col("f0") * 2 + F.col("f1"))
    model = quantile_boost.train(rows, VECTORS, "target", 0.5, n_estimators=5, max_depth=3)
    return model.predict(rows, "gbm_pred_q50").select("vec_id", "target", "gbm_pred_q50")


@register("g5_g11_tuning")
def g5_g11_tuning(s, d):
    rows = _vectors(s, d).withColumns({"target": F.col("f0") * 2 + F.col("f1"), "day": F.col("vec_id") % 2})
    _, results = quantile_boost.tune(rows, VECTORS, "target", "day", 0.5, {"n_estimators": (2,), "max_depth": (2, 3), "learning_rate": (0.1,), "min_samples_leaf": (10,)})
    return metrics.summarize_grid(s.createDataFrame([(r["n_estimators"], r["max_depth"], r["learning_rate"], r["min_samples_leaf"], r["mean_pinball"], r["std_pinball"]) for r in results], "n_estimators int, max_depth int, learning_rate double, min_samples_leaf int, mean_pinball double, std_pinball double"))


_Q = " union all ".join(f"select cast({t} as double) tau, {c} pred, forward_return y from returns" for t, c in ((0.1, "pred_q10"), (0.5, "pred_q50")))


@register("g6_g9_quantile_metrics", "select tau, count(*) n, " + _r("y_mean=avg(y);y_std=stddev_pop(y);y_min=min(y);y_max=max(y);pinball=avg(case when y - pred >= 0 then tau * (y - pred) else (tau - 1) * (y - pred) end);coverage=avg(cast(y <= pred as int));calibration_error=abs(avg(cast(y <= pred as int)) - tau);residual_mean=avg(y - pred);residual_std=stddev_pop(y - pred);pred_mean=avg(pred);pred_std=stddev_pop(pred)", 7) + " from quants group by tau", quants=_Q)
def g6_g9_quantile_metrics(s, d):
    return rounded(metrics.quantile_metrics(_returns(s, d), "forward_return", {0.1: "pred_q10", 0.5: "pred_q50"}), 7)


@register("g10_intervals", "select " + _r("mean_width=avg(pred_q50 - pred_q10);coverage=avg(cast(forward_return >= pred_q10 and forward_return <= pred_q50 as int));below=avg(cast(forward_return < pred_q10 as int));above=avg(cast(forward_return > pred_q50 as int))") + " from returns")
def g10_intervals(s, d):
    return rounded(metrics.interval_metrics(_returns(s, d), "forward_return", "pred_q10", "pred_q50"))


# --- back-test ---------------------------------------------------------------------------------------------


@register("t1_t3_simulate", "select id, trade_direction, trade_direction_label, outcome, " + _r("pnl;pred_stop;pred_target", 8) + " from sim")
def t1_t3_simulate(s, d):
    return rounded(_trades(s, d).select("id", "trade_direction", "trade_direction_label", "outcome", "pnl", "pred_stop", "pred_target"), 8)


_BT = "count(*) n_trades, count(*) filter (where outcome = 'WIN') n_wins, count(*) filter (where outcome = 'LOSS') n_losses, count(*) filter (where outcome = 'TIMEOUT') n_timeouts, " + _r("hit_rate=count(*) filter (where outcome = 'WIN') / count(*);avg_win=coalesce(avg(pnl) filter (where outcome = 'WIN'), 0);avg_loss=coalesce(avg(pnl) filter (where outcome = 'LOSS'), 0);win_loss_ratio=abs(avg(pnl) filter (where outcome = 'WIN') / avg(pnl) filter (where outcome = 'LOSS'));total_pnl=sum(pnl);mean_pnl=avg(pnl);std_pnl=stddev_samp(pnl);sharpe=avg(pnl) / stddev_samp(pnl) * sqrt(count(*));max_win=max(pnl) filter (where outcome = 'WIN');max_loss=min(pnl) filter (where outcome = 'LOSS')")


@register("t4_metrics", f"select {_BT} from sim")
def t4_metrics(s, d):
    return rounded(backtest.metrics(_trades(s, d)))


@register("t5_by_ticker", f"select ticker, {_BT} from sim group by ticker")
def t5_by_ticker(s, d):
    return rounded(backtest.metrics_by(_trades(s, d)))


@register("t6_report")
def t6_report(s, d):
    text = backtest.metrics_table(backtest.metrics(_trades(s, d)).first().asDict())
    return s.createDataFrame([(text,)], "report string")


@register("t7_cumulative", "select id, row_number() over w trade_num, " + _r("cum_pnl=sum(pnl) over w") + " from sim window w as (order by t, id rows between unbounded preceding and current row)")
def t7_cumulative(s, d):
    return rounded(backtest.cumulative_pnl(_trades(s, d)).select("id", "trade_num", "cum_pnl"))


@register("t8_by_outcome", "select outcome, count(*) n, " + _r("mean=avg(pnl);std=stddev_samp(pnl);min=min(pnl);max=max(pnl)", 8) + " from sim group by outcome")
def t8_by_outcome(s, d):
    return rounded(backtest.outcome_stats(_trades(s, d)), 8)


@register("t9_correlation", "select " + _r("corr_pred_stop=corr(pnl, pred_stop);corr_pred_target=corr(pnl, pred_target)") + " from sim")
def t9_correlation(s, d):
    return rounded(backtest.prediction_correlation(_trades(s, d)))


@register("t10_top_bottom", "select * from (select ticker, " + _r("total_pnl=sum(pnl)") + ", 'top' side from sim group by ticker order by sum(pnl) desc, ticker limit 3) union all select * from (select ticker, " + _r("total_pnl=sum(pnl)") + ", 'bottom' side from sim group by ticker order by sum(pnl), ticker desc limit 3)")
def t10_top_bottom(s, d):
    return rounded(backtest.top_and_bottom(backtest.metrics_by(_trades(s, d)).select("ticker", "total_pnl")))


# --- exploration and reports -------------------------------------------------------------------------------


@register("e1_stratified_sample", "select event_id, ticker from (select event_id, ticker, row_number() over (partition by ticker order by md5(event_id || ':42'), event_id) n from cleaned) where n <= floor(750 / (select count(distinct ticker) from cleaned))")
def e1_stratified_sample(s, d):
    return explore.stratified_sample(_cleaned(s, d), "event_id").select("event_id", "ticker")


@register("e2_value_counts", "select cond_norm \"value\", count(*) n from ticks group by 1 order by 2 desc, 1 limit 10")
def e2_value_counts(s, d):
    return explore.value_counts(_ticks(s, d), "cond_norm", 10)


@register("e3_describe", " union all ".join(f"select '{c}' \"column\", count({c}) count, " + _r(f"mean=avg({c});std=stddev_samp({c});min=min({c});p25=quantile_cont({c}, 0.25);p50=quantile_cont({c}, 0.5);p75=quantile_cont({c}, 0.75);max=max({c})") + " from scored" for c in ("proba", "ewm_std")))
def e3_describe(s, d):
    return rounded(explore.describe(fixtures.scored(s, d), ["proba", "ewm_std"]))


@register("e4_correlations", " union all ".join(f"select '{a}' a, '{b}' b, " + _r(f"corr=corr({a}, {b})") + " from vectors" for i, a in enumerate(VECTORS) for b in VECTORS[i:]))
def e4_correlations(s, d):
    return rounded(explore.correlation_matrix(_vectors(s, d), VECTORS))


_SLOTS = dict(
    seen="select ticker, date, ts slot, cast(sum(size) as bigint) volume, sum(price * size) dollar, count(*) n_trades from cleaned group by all",
    every="select ticker, date, unnest(generate_series(min(slot), max(slot), interval 1 minute)) slot from seen group by ticker, date",
    slots="select e.ticker, e.date, e.slot, coalesce(volume, 0) volume, coalesce(dollar, 0) dollar, coalesce(n_trades, 0) n_trades from every e left join seen s on e.ticker = s.ticker and e.date = s.date and e.slot = s.slot",
    prof="select ticker, hour(slot) * 60 + minute(slot) minute_of_day, avg(volume) avg_volume from slots group by all",
)


def _slots(s: SparkSession, d: str) -> DataFrame:
    return explore.resample(_cleaned(s, d), 60)


@register("e5_resample", "select ticker, date, slot, volume, " + _r("dollar", 4) + ", n_trades from slots", **_SLOTS)
def e5_resample(s, d):
    return rounded(_slots(s, d), 4)


@register("e6_between_time", "select event_id from cleaned where cast(ts as time) between time '13:35:00' and time '19:35:00'")
def e6_between_time(s, d):
    return explore.between_times(_cleaned(s, d)).select("event_id")


@register("e7_flow_stats", "select ticker, count(*) slots, " + _r("; ".join(f"{c}_mean=avg({c});{c}_std=stddev_samp({c});{c}_cv=stddev_samp({c}) / avg({c});{c}_fano=var_samp({c}) / avg({c});{c}_total=sum({c})" for c in ("volume", "dollar")), 3) + ", count(*) filter (where volume = 0) zero_slots, " + _r("zero_pct=100.0 * count(*) filter (where volume = 0) / count(*)", 3) + " from slots group by ticker", **_SLOTS)
def e7_flow_stats(s, d):
    return rounded(explore.flow_stats(_slots(s, d)), 3)


@register("e8_intraday_profile", "select ticker, count(*) \"minutes\", " + _r("profile_cv=stddev_samp(avg_volume) / avg(avg_volume)", 5) + " from prof group by ticker", **_SLOTS)
def e8_intraday_profile(s, d):
    return rounded(explore.profile_cv(explore.intraday_profile(_slots(s, d))), 5)


@register("e9_moments", "select ticker, count(ret) n, " + _r("skew=avg(pow(ret - m, 3)) / pow(avg(pow(ret - m, 2)), 1.5);kurtosis=avg(pow(ret - m, 4)) / pow(avg(pow(ret - m, 2)), 2) - 3", 5) + " from (select *, avg(ret) over (partition by ticker) m from rets) group by ticker")
def e9_moments(s, d):
    return rounded(explore.moments(labels.with_return(_bars(s, d)), "ret", ("ticker",)), 5)


@register("e10_autocorrelation", "select ticker, date, " + _r("autocorr=corr(ret, l)", 5) + f" from (select *, lag(ret) over (partition by ticker, date order by bar_id) l from rets) group by ticker, date")
def e10_autocorrelation(s, d):
    return rounded(explore.lag1_autocorrelation(labels.with_return(_bars(s, d)), "ret", ("bar_id",), ("ticker", "date")), 5)


_LB = dict(
    dev="select ticker, date, bar_id, ret - avg(ret) over (partition by ticker, date) x from rets where ret is not null",
    lagged="select *, " + ", ".join(f"lag(x, {k}) over (partition by ticker, date order by bar_id) l{k}" for k in range(1, 11)) + " from dev",
    lbq="select ticker, date, count(*) * (count(*) + 2.0) * (" + " + ".join(f"pow(sum(x * l{k}) / sum(x * x), 2) / (count(*) - {k})" for k in range(1, 11)) + ") q from lagged group by ticker, date having count(*) > 10",
)


@register("e11_ljung_box", "select ticker, date, " + _r("q;p_value=exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24)", 5) + " from lbq", **_LB)
def e11_ljung_box(s, d):
    return rounded(explore.ljung_box_10(labels.with_return(_bars(s, d)), "ret", ("bar_id",), ("ticker", "date")), 5)


@register("e12_log_histogram", "select cast(case when log10(size + 1) < 0 then 0 when log10(size + 1) >= 2.5 then 51 else floor(log10(size + 1) / 2.5 * 50) + 1 end as bigint) bin, count(*) n from cleaned group by 1")
def e12_log_histogram(s, d):
    return explore.log_histogram(_cleaned(s, d), "size", 0.0, 2.5)


_CARD = dict(_LI) | dict(
    dnum="select *, row_number() over (partition by ticker, date order by ts, k1, k2, k3, k4, k5) rn, sum(price * size) over (partition by ticker, date) / 300 lim from li",
    dseg="""select ticker, date, rn, price * size cum, 0 bar_id, price * size >= lim is_full from dnum where rn = 1 union all
      select n.ticker, n.date, n.rn, case when s.is_full then 0 else s.cum end + n.price * n.size, s.bar_id + cast(s.is_full as int), case when s.is_full then 0 else s.cum end + n.price * n.size >= lim from dseg s join dnum n on n.ticker = s.ticker and n.date = s.date and n.rn = s.rn + 1""",
    dall="select n.*, cast(s.bar_id as bigint) bar_id, max(s.is_full) over (partition by n.ticker, n.date, s.bar_id) done from dnum n join dseg s on n.ticker = s.ticker and n.date = s.date and n.rn = s.rn",
    kinds="select 'volume' bar_type, ln(arg_max(price, rn) / arg_min(price, rn)) r from liall where done group by ticker, date, bar_id union all select 'dollar', ln(arg_max(price, rn) / arg_min(price, rn)) from dall where done group by ticker, date, bar_id",
    centred="select *, r - avg(r) over (partition by bar_type) x from kinds",
    stats="select bar_type, count(*) n, abs(avg(pow(x, 3)) / pow(avg(x * x), 1.5)) skew, abs(avg(pow(x, 4)) / pow(avg(x * x), 2) - 3) kurtosis from centred group by bar_type",
    goods="select bar_type, 'n' metric, cast(n as double) good from stats union all select bar_type, 'skew', -skew from stats union all select bar_type, 'kurtosis', -kurtosis from stats",
    cards="select *, coalesce((good - min(good) over (partition by metric)) / nullif(max(good) over (partition by metric) - min(good) over (partition by metric), 0), 1) score, row_number() over (partition by metric order by good desc, bar_type) = 1 won from goods",
)


@register("e13_scorecard", "select bar_type, count(*) filter (where won) wins, " + _r("mean_score=avg(score)") + " from cards group by bar_type", **_CARD)
def e13_scorecard(s, d):
    rows = fixtures.lineitem_trades(s, d)
    both = [explore.moments(bars.generic_bars(rows, m, 300, LI_ORDER), "return").withColumn("bar_type", F.lit(m)) for m in ("volume", "dollar")]
    cards = explore.scorecard(both[0].unionByName(both[1]).withColumns({"skew": F.abs("skew"), "kurtosis": F.abs("kurtosis")}), lower_is_better=("skew", "kurtosis"), higher_is_better=("n",))
    return rounded(explore.votes(cards))


@register("e14_pca")
def e14_pca(s, d):
    return explore.pca(_vectors(s, d), VECTORS).select("vec_id", F.col("pca")[0].alias("pc1"), F.col("pca")[1].alias("pc2"))


_META = dict(
    meta="""select r.ticker, r.date, raw_rows, dropped_invalid_size, duplicates_removed, 100.0 * duplicates_removed / initial_rows dup_pct, crossed_quotes, 100.0 * crossed_quotes / nullif(complete_stamps, 0) crossed_quotes_pct,
      trades_n, met, coalesce(final_rows, 0) final_rows, coalesce(codes, '') codes
      from (select ticker, date, count(*) raw_rows, count(*) filter (where not size > 0) dropped_invalid_size from raw group by all) r
      left join (select ticker, date, sum(n) initial_rows, sum(n) - count(*) duplicates_removed from (select ticker, date, count(*) n from norm group by ticker, date, ts, type, price, size, exch, cond_norm) group by all) d using (ticker, date)
      left join (select ticker, date, count(*) filter (where nbb is not null and nbo is not null) complete_stamps, count(*) filter (where nbo < nbb) crossed_quotes from filled group by all) q using (ticker, date)
      left join (select ticker, date, count(*) trades_n, count(mid) met from met group by all) a using (ticker, date)
      left join (select ticker, date, count(*) filter (where keep) final_rows, array_to_string(list_sort(list_distinct(flatten(list(unknown)))), ',') codes from judged group by all) j using (ticker, date)"""
)


@register("q1_metadata", "select ticker, date, raw_rows, cast(0 as bigint) dropped_invalid_price, dropped_invalid_size, cast(0 as bigint) dropped_nulls, cast(duplicates_removed as bigint) duplicates_removed, " + _r("dup_pct") + ", crossed_quotes, " + _r("crossed_quotes_pct=coalesce(crossed_quotes_pct, 0)") + ", final_rows, met - final_rows trades_dropped_by_cond, codes unknown_cond_codes, trades_n - met trades_dropped_no_nbbo, " + _r("nbbo_coverage_pct=100.0 * met / trades_n") + ", case when final_rows > 0 then 'success' else 'failed' end status, case when final_rows > 0 then '' when raw_rows <= dropped_invalid_size then 'no valid rows' when coalesce(trades_n, 0) = 0 then 'no trades' when met = 0 then 'no quotes for any trade' else 'no trades left by the condition filter' end error from meta", **_META)
def q1_metadata(s, d):
    return rounded(quality.clean_metadata(_raw(s, d), CLEANING))


@register("q2_gates", "select ticker, date, " + _r("nbbo_coverage_pct=100.0 * met / trades_n;crossed_quotes_pct=coalesce(crossed_quotes_pct, 0)") + ", 100.0 * met / trades_n < 99 low_coverage, coalesce(crossed_quotes_pct, 0) > 0.5 many_crossed from meta where final_rows > 0 and (100.0 * met / trades_n < 99 or coalesce(crossed_quotes_pct, 0) > 0.5)", **_META)
def q2_gates(s, d):
    return rounded(quality.quality_gates(quality.clean_metadata(_raw(s, d), CLEANING), CLEANING))


@register("q3_summary", "select count(*) n_success, " + ", ".join(f"cast(sum({e}) as bigint) total_{n}" for n, e in (("raw_rows", "raw_rows"), ("final_rows", "final_rows"), ("duplicates_removed", "duplicates_removed"), ("crossed_quotes", "crossed_quotes"), ("trades_dropped_by_cond", "met - final_rows"), ("trades_dropped_no_nbbo", "trades_n - met"))) + ", " + _r("mean_dup_pct=avg(dup_pct);mean_coverage=avg(100.0 * met / trades_n)") + " from meta where final_rows > 0", **_META)
def q3_summary(s, d):
    return rounded(quality.run_summary(quality.clean_metadata(_raw(s, d), CLEANING)))


@register("q4_report", "select ticker, count(*) parts, cast(sum(raw_rows) as bigint) raw_rows, cast(sum(final_rows) as bigint) final_rows, " + _r("mean_dup_pct=avg(dup_pct);mean_coverage=avg(100.0 * met / trades_n);retention_pct=100.0 * sum(final_rows) / sum(raw_rows)", 2) + " from meta group by ticker", **_META)
def q4_report(s, d):
    return quality.metadata_report(quality.clean_metadata(_raw(s, d), CLEANING))


@register("q5_inspect", "select ticker, date, count(*) n, cast(0 as bigint) null_mid, " + _r("min_price=min(price);max_price=max(price);mean_price=avg(price);median_price=median(price);share_at_bid=avg(at_bid);share_at_ask=avg(at_ask)") + ", count(*) filter (where price > nbb and price < nbo) between, count(*) filter (where spread < 0) negative_spreads, count(*) filter (where spread = 0) zero_spreads, true monotonic from cleaned group by ticker, date")
def q5_inspect(s, d):
    return rounded(quality.inspect_sample(_cleaned(s, d)))


@register("q6_processing_summary", "select ticker, date, count(*) n_bars, cast(sum(trade_count) as bigint) n_trades, " + _r("avg_bar_volume=avg(volume);avg_bar_duration_seconds=avg(duration_seconds)", 4) + f", count(*) filter (where {_KNOWN}) n_labeled, count(*) filter (where not {_KNOWN}) n_unlabeled, '{{\"-1\":' || count(*) filter (where label = -1) || ',\"0\":' || count(*) filter (where label = 0) || ',\"1\":' || count(*) filter (where label = 1) || '}}' label_dist from labelled group by ticker, date")
def q6_processing_summary(s, d):
    return rounded(quality.processing_summary(_labelled(s, d)), 4)


@register("q7_crosstab", "select label, gmm_is_candidate, count(*) n, " + _r("share=count(*) / sum(count(*)) over (partition by gmm_is_candidate)") + " from flagged group by label, gmm_is_candidate", **_LL)
def q7_crosstab(s, d):
    return rounded(explore.crosstab_by_column(_flagged(s, d), "label", "gmm_is_candidate"))


@register("q8_rates", "select ticker, count(*) n, " + _r("rate=avg(cast(gmm_is_candidate as int))") + " from flagged group by ticker", **_LL)
def q8_rates(s, d):
    return rounded(explore.rates_by(_flagged(s, d), "ticker", "gmm_is_candidate"))


# --- the flagship ------------------------------------------------------------------------------------------


@register("flagship", f"select {_BAR}, {_FEATS}, label, label_barrier_hit from labelled")
def flagship(s, d):
    """Raw ticks to labelled bars with features."""
    keep = ["ticker", "date", "bar_id", "t", "t_end", "open", "high", "low", "close", "volume", "vwap", "trade_count", *features.FEATURES, "label", "label_barrier_hit"]
    return rounded(pipeline.labelled_bars(_cleaned(s, d), THRESHOLD, PROCESSING).select(*keep))
