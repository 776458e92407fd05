"""Cleaning, quotes and the as-of join against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.functions import conditions, ranks, timefns
from quantloom.operators import clean, nbbo
from quantloom.sources import ticks

T0 = dt.datetime(2025, 10, 2, 13, 35)
DAY = dt.date(2025, 10, 2)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_condition_codes(spark):
    rows = [(None,), ("",), ("0",), (" f , is",), ("R6,IS",), ("F,F",), ("QQ",), ("0,F",), (",",)]
    got = spark.createDataFrame(rows, "cond string").select(conditions.normalized(F.col("cond")).alias("n")).select("n", conditions.kept(F.col("n")).alias("k"), conditions.unknown_tokens(F.col("n")).alias("u")).collect()
    assert [r.n for r in got] == ["", "", "", "F,IS", "IS,R6", "F,F", "QQ", "F", ""]
    assert [r.k for r in got] == [True, True, True, True, False, True, False, True, True]
    assert [r.u for r in got][6] == ["QQ"] and [r.u for r in got][4] == []
    strict = spark.createDataFrame([(None,)], "cond string").select(conditions.normalized(F.col("cond"), True)).first()[0]
    assert strict == "NAN"


def test_parse_and_drop_reasons(spark):
    rows = [
        ("Dates", "TRADE", "1", "1"), ("bad", "TRADE", "1", "1"), ("2025-10-02 09:35:00", "TRADE", "0", "1"), ("2025-10-02 09:35:00", "TRADE", "-1", "0"), ("2025-10-02 09:35:00", "TRADE", "x", "1"),
        ("2025-10-02 09:35:00", "TRADE", "NaN", "1"), ("2025-10-02 09:35:00", "TRADE", "1", "0"), ("2025-10-02 09:35:00", "TRADE", "1", None), ("2025-10-02 09:35:00", None, "1", "1"), ("2025-10-02 09:35:00", "TRADE", "1.5", "7"),
    ]
    raw = spark.createDataFrame(rows, "ts string, type string, price string, size string").withColumn("ticker", F.lit("A"))
    parsed = clean.parse_raw(raw)
    c = clean.drop_counts(parsed.withColumn("date", F.lit(DAY))).first()
    assert (c.raw_rows, c.dropped_invalid_price, c.dropped_invalid_size, c.dropped_nulls) == (9, 4, 2, 2)
    ok = clean.valid_rows(parsed).collect()
    assert len(ok) == 1 and ok[0].ts == T0 and ok[0].price == 1.5 and ok[0]["size"] == 7


def test_dedup_keeps_last_spelling(spark):
    rows = [(1, "A", DAY, at(0), "TRADE", 1.0, 5, "X", "f"), (2, "A", DAY, at(0), "TRADE", 1.0, 5, "X", "F,"), (3, "A", DAY, at(0), "TRADE", 1.0, 5, "Y", "F")]
    df = spark.createDataFrame(rows, "event_id long, ticker string, date date, ts timestamp_ntz, type string, price double, size long, exch string, cond string")
    df = clean.with_cond_norm(df)
    got = sorted(r.event_id for r in clean.dedup_keep_last(df).collect())
    assert got == [1, 3]  # 'f' sorts after 'F,'
    s = clean.dedup_stats(df).first()
    assert (s.initial_rows, s.duplicates_removed) == (3, 1)
    assert clean.last_per_key_window(df).count() == 2


QUOTES = "ticker string, date date, ts timestamp_ntz, type string, exch string, price double, size long"


def test_nbbo_cases(spark):
    rows = [
        ("A", DAY, at(0), "BEST_BID", "P", 10.0, 1), ("A", DAY, at(0), "BEST_BID", "Q", 9.9, 2),  # the last exchange wins, not the best price
        ("A", DAY, at(1), "BEST_ASK", "P", 10.1, 3),
        ("A", DAY, at(2), "BEST_ASK", "P", 9.9, 4),  # locked: kept; the bid is exactly at the cap
        ("A", DAY, at(3), "BEST_ASK", "P", 9.0, 4),  # the bid is too old
        ("A", DAY, at(4), "BEST_BID", "P", 9.5, 4),  # crossed
    ]
    q = spark.createDataFrame(rows, QUOTES)
    got = [(r.ts, r.nbb, r.nbo, r.nbb_size) for r in nbbo.build_nbbo(q, 2).orderBy("ts").collect()]
    assert got == [(at(1), 9.9, 10.1, 2), (at(2), 9.9, 9.9, 2)]
    s = nbbo.nbbo_stats(q, 2).first()
    assert (s.total_quote_stamps, s.complete_stamps, s.crossed_quotes) == (5, 3, 1)
    a, b = nbbo.last_quotes(q), nbbo.last_quotes_joined(q).select(nbbo.last_quotes(q).columns)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_asof_against_loop(spark):
    r = random.Random(1)
    left = [("A" if r.random() < 0.5 else "B", at(r.randint(0, 40)), i) for i in range(120)]
    right = [("A" if r.random() < 0.7 else "B", s, float(s)) for s in r.sample(range(5, 40), 20)]
    l = spark.createDataFrame([(t, DAY, w, i) for t, w, i in left], "ticker string, date date, ts timestamp_ntz, id long")
    q = spark.createDataFrame([(t, DAY, at(s), v) for t, s, v in right], "ticker string, date date, ts timestamp_ntz, v double")
    for tolerance in (None, 3):
        got = {x.id: x.v for x in nbbo.asof_backward(l, q, ("v",), tolerance_seconds=tolerance).collect()}
        for t, w, i in left:
            past = [(s, v) for u, s, v in right if u == t and at(s) <= w and (tolerance is None or (w - at(s)).total_seconds() <= tolerance)]
            assert got[i] == (max(past)[1] if past else None)


def test_empty_inputs(spark):
    q = spark.createDataFrame([], QUOTES)
    assert nbbo.build_nbbo(q).count() == 0
    t = q.withColumns({"cond": F.lit(""), "event_id": F.lit(1)})
    assert clean.prepared(t).count() == 0


def test_csv_scan_and_sinks(spark, tmp_path):
    d = tmp_path / "raw" / "CCL"
    d.mkdir(parents=True)
    (d / "CCL_10-2-25.csv").write_text("junk\njunk,2\nDates,Type,Price,Size,Cond,Exch,a,b\n2025-10-02 09:35:00,TRADE,10.5,100,\"F,IS\",N,,\nDates,Type,Price,Size,Cond,Exch,a,b\n2025-10-02 09:35:01,BEST_BID,10.4,3,,N,,\n")
    (d / "CCL_9-2-25.csv").write_text("junk\njunk\nh\n2025-09-02 09:35:00,TRADE,1,1,,N,,\n")
    raw = ticks.scan_raw_csv(spark, str(tmp_path / "raw"))
    rows = ticks.drop_junk(raw).collect()
    assert len(rows) == 2 and {(r.ticker, r.date_text) for r in rows} == {("CCL", "10-2-25")}
    assert {r.cond for r in rows} == {"F,IS", None}
    (d / "CCL_10-3-25.csv").write_text("junk\njunk,2\nTime,Type,Price,Size,Cond,Exch,a,b\nnot a time,TRADE,10.5,100,,N,,\n,TRADE,1,1,,N,,\n2025-10-03 09:35:00,TRADE,1,x,,N,,\n")
    counts = clean.drop_counts(clean.parse_raw(ticks.drop_junk(ticks.scan_raw_csv(spark, str(tmp_path / "raw"))))).filter("date = date'2025-10-03'").collect()
    assert [(r.raw_rows, r.dropped_nulls, r.dropped_invalid_size) for r in counts] == [(3, 2, 1)]
    (d / "CCL_10-3-25.csv").unlink()
    out = clean.parse_raw(ticks.drop_junk(raw)).drop("date_text")
    ticks.sink_parquet(out, str(tmp_path / "clean"))
    assert ticks.scan_parquet(spark, str(tmp_path / "clean"), tickers=["CCL"]).count() == 2
    ticks.sink_metadata(out.groupBy("ticker").count(), str(tmp_path / "meta"))
    assert spark.read.parquet(str(tmp_path / "meta.parquet")).count() == 1
    ticks.save_json(spark, {"a": [1]}, str(tmp_path / "doc"))
    assert ticks.load_json(spark, str(tmp_path / "doc")) == {"a": [1]}
    (tmp_path / "codes.csv").write_text('code,bucket,description,source\n"",NEUTRAL,blank,x\nF,SOFT_INCLUDE,y,z\n')
    assert {r.code for r in ticks.scan_codebook(spark, str(tmp_path / "codes.csv")).collect()} == {"", "F"}


def test_skipped_files_are_those_that_cannot_be_read(spark, tmp_path):
    """Empty files, as Spark writes them for an empty first task, and files without a row for the filter can be read; a bad
    file counts also where another folder has a good one of its name."""
    rows = spark.range(4).select(F.concat(F.lit("T"), F.col("id")).alias("ticker"), "id").coalesce(1)
    rows.write.parquet(str(tmp_path / "a b"))
    rows.limit(0).write.parquet(str(tmp_path / "none"))
    good = next((tmp_path / "a b").glob("part-*"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / good.name).write_text("not a table")
    scan = ticks.scan_parquet(spark, *[str(tmp_path / x) for x in ("a b", "none", "bad")])
    want = [(good.name, "failed", "no rows could be read")]
    assert len(scan.inputFiles()) == 3 and scan.count() == 4
    assert [tuple(r) for r in ticks.skipped_files(scan).collect()] == want
    assert [tuple(r) for r in ticks.skipped_files(scan.filter("ticker = 'T9'")).collect()] == want
    assert ticks.skipped_files(ticks.scan_parquet(spark, str(tmp_path / "a b"), str(tmp_path / "none"))).count() == 0


def test_clock_changes(spark):
    at = lambda *x: dt.datetime(2025, *x)
    rows = [(at(3, 9, 1, 59), at(3, 9, 6, 59)), (at(3, 9, 2, 0), at(3, 9, 7, 0)), (at(3, 9, 2, 30), at(3, 9, 7, 0)), (at(3, 9, 3, 0), at(3, 9, 7, 0)), (at(11, 2, 0, 59), at(11, 2, 4, 59)), (at(11, 2, 1, 30), at(11, 2, 5, 30)), (at(11, 2, 2, 0), at(11, 2, 7, 0)), (at(7, 4, 9, 30), at(7, 4, 13, 30)), (None, None)]
    df = spark.createDataFrame(rows, "wall timestamp_ntz, utc timestamp_ntz")
    got = df.select("utc", timefns.local_to_utc(F.col("wall"), "America/New_York").alias("got"), timefns.is_ambiguous(F.col("wall"), "America/New_York").alias("twice"), "wall").collect()
    assert all(r.got == r.utc for r in got)
    assert [r.wall for r in got if r.twice] == [at(11, 2, 1, 30)]


def test_ranges_and_percentiles(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.0, 2.0, r.random(), r.gauss(0, 9)])) for _ in range(3000)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    for by in ((), ("g",)):
        want = {tuple(x[c] for c in by): x.q for x in df.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).collect() if x.q is not None}
        got = {tuple(x[c] for c in by): x.q for x in ranks.percentiles(df, "v", qs, by).collect()}
        assert set(got) == set(want) and all(a == pytest.approx(b) for k in want for a, b in zip(got[k], want[k], strict=True))
    assert [x.q for x in ranks.percentiles(df.limit(0), "v", [0.5]).collect()] == [[None]]
    per = spark.createDataFrame([(i, i % 3) for i in range(50)], "k int, n int")
    got = {x.k: (x.cum_n, x.all_n) for x in ranks.running_sums(per, "k", ("n",), descending=True).collect()}
    assert got == {i: (sum(j % 3 for j in range(i, 50)), sum(j % 3 for j in range(50))) for i in range(50)}
