"""DuckDB SQL of the queries, put together from named parts: a query takes the parts it mentions."""

from __future__ import annotations

import re

from ..functions.conditions import CODEBOOK

CAP_SECONDS, THRESHOLD, BARRIER_MINUTES, CONTEXT_MINUTES, HALFLIFE = 14_400, 150, 720, 360, 50
_GOOD = ", ".join(f"'{k}'" for k, v in CODEBOOK.items() if k and v != "HARD_EXCLUDE")
_KNOWN = ", ".join(f"'{k}'" for k in CODEBOOK if k)

_PREV20 = "over (partition by ticker, date order by bar_id rows between 20 preceding and 1 preceding)"
_BARS_W = "over (partition by ticker, date order by bar_id)"

PARTS = {
    "raw": """
      with e as (select *, cast(json_extract_string(props, '$.k') as int) k from events),
      b as (select event_id, 'T' || (user_id % 4) ticker, cast(date_trunc('week', ts) as date) date, date_trunc('minute', ts) ts,
        case event_type when 'view' then 'BEST_BID' when 'signup' then 'BEST_ASK' else 'TRADE' end type,
        case event_type when 'view' then 100.0::double + (value - 50) / 100 when 'signup' then 100.9::double + (value - 50) / 100 else 100.4::double + (value - 50) / 100 end price,
        k size, chr(cast(65 + user_id % 7 as int)) exch,
        case cast(event_id % 10 as int) when 0 then 'I' when 1 then 'F' when 2 then ' f , is' when 3 then '' when 4 then 'T,F' when 5 then 'QQ' else '0' end cond from e)
      select * from b union all select event_id, ticker, date, ts, type, price, size, exch, upper(cond) || ',' from b where event_id % 20 = 1""",
    "valid": "select * from raw where price > 0 and size > 0",
    "norm": """select *, array_to_string(list_sort(list_filter(list_transform(string_split(coalesce(cond, ''), ','), lambda x: upper(trim(x))), lambda x: x <> '' and x <> '0')), ',') cond_norm from valid""",
    "ticks": "select * exclude (rn) from (select *, row_number() over (partition by ticker, date, ts, type, price, size, exch, cond_norm order by cond desc, event_id desc) rn from norm) where rn = 1",
    "lastq": """select ticker, date, ts,
        arg_max(price, {'e': exch, 'p': price, 's': size}) filter (where type = 'BEST_BID') nbb, arg_max(size, {'e': exch, 'p': price, 's': size}) filter (where type = 'BEST_BID') nbb_size,
        arg_max(price, {'e': exch, 'p': price, 's': size}) filter (where type = 'BEST_ASK') nbo, arg_max(size, {'e': exch, 'p': price, 's': size}) filter (where type = 'BEST_ASK') nbo_size
      from ticks where type in ('BEST_BID', 'BEST_ASK') group by ticker, date, ts""",
    "filled": f"""select ticker, date, ts, """ + ", ".join(
        f"case when epoch_us(ts) - epoch_us(last_value(case when {c} is not null then ts end ignore nulls) over w) <= {CAP_SECONDS * 1_000_000} then last_value({c} ignore nulls) over w end {c}" for c in ("nbb", "nbb_size", "nbo", "nbo_size")
    ) + " from lastq window w as (partition by ticker, date order by ts rows between unbounded preceding and current row)",
    "complete": "select * from filled where nbb is not null and nbo is not null and nbb_size is not null and nbo_size is not null",
    "book": "select *, 0.5 * (nbb + nbo) mid, nbo - nbb spread from complete where nbo >= nbb",
    "trades": "select * from ticks where type = 'TRADE'",
    "met": """select t.*, b.nbb, b.nbo, b.nbb_size, b.nbo_size, b.mid, b.spread from trades t asof left join book b on t.ticker = b.ticker and t.date = b.date and t.ts >= b.ts""",
    "merged": "select * from met where mid is not null and spread is not null",
    "flagged_trades": "select *, cast(abs(price - nbb) <= 0.0001 as int) at_bid, cast(abs(price - nbo) <= 0.0001 as int) at_ask from merged",
    "tokens": "select *, list_filter(string_split(cond_norm, ','), lambda x: x <> '') toks from merged",
    "judged": f"select *, len(list_filter(toks, lambda x: x not in ({_GOOD}))) = 0 keep, list_filter(toks, lambda x: x not in ({_KNOWN})) unknown from tokens",
    "cleaned": f"select * from flagged_trades where len(list_filter(list_filter(string_split(cond_norm, ','), lambda x: x <> ''), lambda x: x not in ({_GOOD}))) = 0",
    "numbered": "select *, row_number() over (partition by ticker, date order by ts, exch, price, size, cond_norm, event_id) rn from cleaned",
    "seg": f"""select ticker, date, rn, cast(size as double) cum, 0 bar_id, size >= {THRESHOLD} is_full from numbered where rn = 1
      union all
      select n.ticker, n.date, n.rn, case when s.is_full then 0 else s.cum end + n.size, s.bar_id + cast(s.is_full as int), case when s.is_full then 0 else s.cum end + n.size >= {THRESHOLD}
      from seg s join numbered n on n.ticker = s.ticker and n.date = s.date and n.rn = s.rn + 1""",
    "segmented": "select n.*, cast(s.bar_id as bigint) bar_id from numbered n join seg s on n.ticker = s.ticker and n.date = s.date and n.rn = s.rn",
    "bars": """select ticker, date, bar_id, min(ts) t, max(ts) t_end, arg_min(price, rn) open, max(price) high, min(price) low, arg_max(price, rn) "close",
        cast(sum(size) as bigint) volume, sum(price * size) / sum(size) vwap, count(*) trade_count from segmented group by ticker, date, bar_id""",
    "timed_bars": "select *, (epoch_us(t_end) - epoch_us(t)) / 1e6 duration_seconds from bars",
    "dist": f'select *, "close" - vwap d from timed_bars',
    "feats": f"""select *,
        case when stddev_samp(d) {_PREV20} > 0 then d / stddev_samp(d) {_PREV20} else 0 end feat_vwap_zscore,
        case when stddev_samp("close") {_PREV20} > 0 then least(greatest(("close" - avg("close") {_PREV20}) / (2 * stddev_samp("close") {_PREV20}), -3), 3) else 0 end feat_bollinger_position,
        "close" / lag("close", 3) {_BARS_W} - 1 feat_momentum_3bar, "close" / lag("close", 5) {_BARS_W} - 1 feat_momentum_5bar,
        coalesce(volume / nullif(avg(volume) {_PREV20}, 0), 1) feat_relative_volume,
        least(greatest((hour(t_end - interval 5 hour) * 3600 + minute(t_end) * 60 + second(t_end) - 34500) / 60.0 / 360, 0), 1) feat_time_of_day,
        cast(count(*) over c as double) feat_context_bar_count, coalesce(avg(volume) over c, volume) feat_context_avg_volume, coalesce((max(high) over c - min(low) over c) / "close", 0) feat_context_price_range
      from dist window c as (partition by ticker, date order by t_end range between interval {CONTEXT_MINUTES} minute preceding and interval 1 microsecond preceding)""",
    "rets": f'select *, "close" / lag("close") {_BARS_W} - 1 ret, row_number() {_BARS_W} rno, count(*) over (partition by ticker, date) n from feats',
    "ewm": f"""select a.ticker, a.date, a.bar_id,
        case when count(b.ret) >= 2 then sqrt(greatest((sum(w * b.ret * b.ret) / sum(w) - pow(sum(w * b.ret) / sum(w), 2)) * sum(w) * sum(w) / (sum(w) * sum(w) - sum(w * w)), 0)) end sd
      from rets a join (select *, 0 z from rets where ret is not null) b on a.ticker = b.ticker and a.date = b.date and b.bar_id <= a.bar_id, lateral (select pow(2, (b.rno - a.rno) / {HALFLIFE}.0) w) group by all""",
    "first10": "select ticker, date, stddev_samp(ret) sd from rets where rno <= 10 group by all",
    "vols": f"""select r.*, case when rno = 1 then case when n >= 10 then f.sd else 0.01 end else lag(e.sd) over (partition by r.ticker, r.date order by r.bar_id) end shifted
      from rets r left join ewm e on r.ticker = e.ticker and r.date = e.date and r.bar_id = e.bar_id left join first10 f on r.ticker = f.ticker and r.date = f.date""",
    "vol": "select *, first_value(shifted ignore nulls) over (partition by ticker, date order by bar_id rows between current row and unbounded following) ewm_std from vols",
    "barred": """select v.*, g.k, case when ewm_std > 0 then "close" * (1 + g.k * ewm_std) else "close" * 1.005 end up, case when ewm_std > 0 then "close" * (1 - g.k * ewm_std) else "close" * 0.995 end lo from vol v, ks g""",
    "ks": "select * from (values (1.0::double)) v(k)",
    "hits": f"""select a.ticker, a.date, a.bar_id, a.k, min(b.bar_id) j from barred a join vol b on a.ticker = b.ticker and a.date = b.date and b.bar_id > a.bar_id and b.t < a.t_end + interval {BARRIER_MINUTES} minute and (b.high >= a.up or b.low <= a.lo) group by all""",
    "latest": "select *, max(t) over (partition by ticker, date, k order by bar_id rows between 1 following and unbounded following) later from barred",
    "outcome": f"""select a.*, case when h.j is not null then case when b.high >= a.up then 1 else -1 end else 0 end label,
        case when h.j is not null then b.t when a.later >= a.t_end + interval {BARRIER_MINUTES} minute then a.t_end + interval {BARRIER_MINUTES} minute end label_t_end,
        case when h.j is not null then case when b.high >= a.up then 'upper' else 'lower' end when a.later >= a.t_end + interval {BARRIER_MINUTES} minute then 'time' else '' end label_barrier_hit
      from latest a left join hits h on a.ticker = h.ticker and a.date = h.date and a.bar_id = h.bar_id and a.k = h.k left join vol b on b.ticker = h.ticker and b.date = h.date and b.bar_id = h.j""",
    "labelled": "select *, coalesce((epoch_us(label_t_end) - epoch_us(t_end)) / 1e6, 0) label_holding_period_seconds from outcome",
    "folds": "select date test_day, min(t) val_start, coalesce(max(label_t_end), max(t_end)) val_end, cast(row_number() over (order by date) - 1 as int) fold from labelled group by date",
    "roles": """select l.ticker, l.date, l.bar_id, f.*, case when l.date = f.test_day then 'val' when l.t <= f.val_end and coalesce(l.label_t_end, l.t_end) >= f.val_start then 'purged'
        when l.t > f.val_end and l.t <= f.val_end + interval 20 minute then 'embargoed' else 'train' end role from labelled l, folds f""",
    "scored": """select o_orderkey id, date '2025-10-01' + cast(o_orderkey * 31 % 5 as int) date, 'T' || (o_orderkey * 17 % 7) ticker, (o_orderkey * 7919 % 1000) / 1000.0 proba, cast(o_orderkey * 104729 % 3 - 1 as int) label,
        (o_orderkey * 6151 % 97) / 9700.0 + 0.001 ewm_std, (o_orderkey * 3571 % 200) / 10000.0 - 0.015 pred_q10, (o_orderkey * 2741 % 200) / 10000.0 - 0.01 pred_q50, (o_orderkey * 1543 % 41) / 10.0 - 2.0 feat_vwap_zscore,
        timestamp '2025-10-01 13:35:00' + to_seconds(o_orderkey * 9973 % 100003) t, cast(o_orderkey * 104729 % 3 - 1 = 1 as int) y from orders""",
    "returns": "select *, label * ewm_std forward_return from scored",
    "sim": """select *, case when feat_vwap_zscore < 0 then 1 else -1 end trade_direction, case when feat_vwap_zscore < 0 then 'LONG' else 'SHORT' end trade_direction_label,
        case label when 1 then 'WIN' when -1 then 'LOSS' else 'TIMEOUT' end outcome, forward_return pnl, pred_q10 pred_stop, pred_q50 pred_target from returns where proba >= 0.5 and date = date '2025-10-05'""",
    "vectors": "select vec_id, label, " + ", ".join(f"cast(embedding[{i + 1}] as double) f{i}" for i in range(9)) + " from embeddings",
}


def query(body: str, **replaced: str) -> str:
    """`body` after the parts it mentions, and those that they mention, in order."""
    parts, done, order = PARTS | replaced, set(), []

    def need(text: str, own: str = "") -> None:
        for name in parts:
            if name != own and name not in done and re.search(rf"\b(?:from|join)\s+(?:\([^()]*)?{name}\b|,\s*{name}\s+\w", text):
                done.add(name)
                need(parts[name], name)
                order.append(name)

    need(body)
    if not order:
        return body
    return "with recursive " + ",\n".join(f"{n} as ({parts[n]})" for n in order) + "\n" + body
