"""Adaptors: the given tables seen as trading data.

Each adaptor is one deterministic SQL projection, written once in the dialect-neutral subset both
engines share; the few functions that differ are written as @name(...) and filled in per dialect.
Adaptors scale with the tables: they aggregate before any window, and every window runs over a
calendar (days of one entity), never over raw rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# @ms(x): timestamp -> epoch ms;  @hash(x): md5 of a text as a 48-bit integer;  @each(a, b): one row per item
SPARK = {
    "ms": "unix_millis(cast({0} as timestamp))",
    "hash": "cast(conv(substr(md5({0}), 1, 12), 16, 10) as bigint)",
    "floor": "cast(floor({0}) as bigint)",
    "text": "cast({0} as string)",
    "each": "explode(array({0}))",
}
DUCK = {
    "ms": "(epoch_us({0}) // 1000)",
    "hash": "('0x' || substr(md5({0}), 1, 12))::bigint",
    "floor": "cast(floor({0}) as bigint)",
    "text": "cast({0} as varchar)",
    "each": "unnest([{0}])",
}


def dialect(sql: str, names: dict[str, str]) -> str:
    """Expand @name(arg) (balanced parentheses) in the given dialect."""
    pattern = re.compile(r"@(\w+)\(")
    while True:
        m = pattern.search(sql)
        if not m:
            return sql
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        sql = sql[:m.start()] + names[m.group(1)].format(sql[m.end():i - 1]) + sql[i:]


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

# One line identifies a fill cycle: the tuple is unique in lineitem.
_LINE_KEY = ("concat_ws('|', @text(l_orderkey), @text(l_linenumber), @text(l_partkey), @text(l_suppkey), "
             "@text(@ms(l_shipdate)), @text(@floor(l_quantity * 100 + 0.5)), "
             "@text(@floor(l_extendedprice * 100 + 0.5)))")

FIXTURES: dict[str, str] = {}

# user, period, time_ms, account_value, pnl: equity curves with irregular observations
FIXTURES["fx_equity"] = """
with daily as (
  select concat('w', @text(l_suppkey * 3 + l_linenumber % 3)) as usr, @floor(@ms(l_shipdate) / 86400000) as day,
         sum(l_extendedprice * (l_discount - 0.0503)) / 3.1e0 as x
  from lineitem group by concat('w', @text(l_suppkey * 3 + l_linenumber % 3)), @floor(@ms(l_shipdate) / 86400000)
), curve as (
  select usr, day, sum(x) over (partition by usr order by day rows unbounded preceding) as pnl from daily
), points as (select usr, day, pnl, @each('allTime', 'perpAllTime', 'month') as period from curve)
select usr as user, period, day * 86400000 + 82800000 as time_ms, 50000 + pnl as account_value,
       case when period = 'perpAllTime' then 0.8 * pnl else pnl end as pnl from points
"""

# The fill tape: every line is one cycle of four fills that starts and ends flat. Even cycles go
# long, add, flip short, cover; odd cycles go short, add, take a part off, cover.
FIXTURES["fx_fills"] = f"""
with lines as (
  select concat('w', @text(l_suppkey * 3 + l_linenumber % 3)) as usr, concat('C', @text(l_partkey % 4)) as coin, l_orderkey as oid,
         @ms(l_shipdate) as day_ms, @hash({_LINE_KEY}) as h, l_quantity as q, l_extendedprice / (l_quantity * 1.0000037e0) as px0,
         l_extendedprice as ep, l_tax as tax, l_discount as disc, l_linenumber as ln, @each(0, 1, 2, 3) as k
  from lineitem
), cycles as (
  select usr, coin, oid, h * 4 + k as tid, k, h % 2 as odd, q, ep, tax, disc, ln, h,
         day_ms + (h % 24) * 3600000 + k * (1 + h % 5) * 60000 * (1 + 11 * (h % 3)) as time_ms,
         px0 * (1 + ((h + k * 7) % 11 - 5) * 0.01) as px
  from lines
), sized as (
  select *,
         case when odd = 0 then case k when 0 then q when 1 then q when 2 then -3 * q else q end
              else case k when 0 then -q when 1 then -0.5 * q when 2 then 0.5 * q else q end end as signed,
         case when odd = 0 then case k when 0 then 0 when 1 then q when 2 then 2 * q else -q end
              else case k when 0 then 0 when 1 then -q when 2 then -1.5 * q else -q end end as start_position
  from cycles
)
select usr as user, time_ms, coin, case when signed > 0 then 'B' else 'A' end as side,
       case when odd = 0 and k = 2 then 'Long > Short' when odd = 0 and k < 2 then 'Open Long'
            when k = 3 then 'Close Short' when k = 2 then 'Close Short' else 'Open Short' end as dir,
       px, abs(signed) as sz, start_position,
       case when k >= 2 then (disc - 0.05) * ep else 0e0 end as closed_pnl, 0.01 * tax * ep as fee,
       (ln = 7 and k = 3 and h % 3 = 0) as liquidated, oid, tid
from sized
"""

# coin, time_ms, daily candles in two snapshots ('a' is superseded by 'b')
FIXTURES["fx_candles"] = """
with px as (
  select p_brand as coin, @floor(@ms(l_shipdate) / 86400000) as day,
         sum(l_extendedprice) / (sum(l_quantity) * 1.0000037e0) as close, sum(l_quantity) as volume
  from lineitem join part on l_partkey = p_partkey
  group by p_brand, @floor(@ms(l_shipdate) / 86400000)
)
select 'a' as snapshot_at, coin, '1d' as interval_, day * 86400000 as time_ms, close * 0.99 as close, volume from px
union all
select 'b', coin, '1d', day * 86400000, close, volume from px
"""

# weekly leaderboard snapshots of the equity curves
FIXTURES["fx_leaderboard"] = """
with daily as (
  select l_suppkey * 3 + l_linenumber % 3 as id, @floor((@floor(@ms(l_shipdate) / 86400000) + 3) / 7) as week,
         sum(l_extendedprice * (l_discount - 0.0503)) as pnl, sum(l_quantity) * 1000 as vlm
  from lineitem group by l_suppkey * 3 + l_linenumber % 3, @floor((@floor(@ms(l_shipdate) / 86400000) + 3) / 7)
), curve as (
  select id, week, pnl, vlm, 50000 + sum(pnl) over (partition by id order by week rows unbounded preceding) / 3.1e0 as av,
         sum(vlm) over (partition by id order by week rows unbounded preceding) as all_vlm,
         sum(pnl) over (partition by id order by week rows unbounded preceding) as all_pnl
  from daily
)
select (week * 7 + 4) * 86400000 + 3600000 as snapshot_ms,
       case when week % 3 = 0 then null else (week * 7 + 4) * 86400000 end as data_as_of_ms,
       concat('w', @text(id)) as user, av as account_value,
       0.3 * pnl / av as week_roi, 0.3 * pnl as week_pnl, vlm as week_vlm,
       1.1 * pnl as month_pnl, 0.33 * pnl / av as month_roi, case when id % 5 = 0 then 0e0 else vlm * 4 end as month_vlm,
       all_pnl as alltime_pnl, all_pnl / 50000 as alltime_roi, all_vlm as alltime_vlm
from curve where (id + week) % 17 <> 0
"""

# daily accumulated pnl ratio of the second venue
FIXTURES["fx_ratio"] = """
with daily as (
  select user_id, @floor(@ms(ts) / 86400000) as day, sum(value - 60) as x from events
  group by user_id, @floor(@ms(ts) / 86400000)
)
select @text(user_id) as user, day * 86400000 as time_ms,
       sum(x) over (partition by user_id order by day rows unbounded preceding) as pnl,
       sum(x) over (partition by user_id order by day rows unbounded preceding) / 100000 as pnl_ratio
from daily
"""
FIXTURES["fx_ratio_traders"] = """
select @text(user_id) as user, '2024-01-31' as snapshot_at, 1000.0 + sum(value) as aum from events group by user_id
"""

# user, date (epoch ms), ret: daily returns for correlations
FIXTURES["fx_daily_ret"] = """
select @text(user_id) as user, @floor(@ms(ts) / 86400000) * 86400000 as day_ms, avg(value) / 100 - 0.5 as ret
from events group by user_id, @floor(@ms(ts) / 86400000)
"""

# followed traders: one strategy per event-user group of ten
FIXTURES["fx_chosen"] = """
select distinct concat('s', @text(@floor(user_id / 10))) as strategy, @text(user_id) as user from events
"""

# market snapshot per coin
FIXTURES["fx_markets"] = """
with px as (
  select concat('C', @text(l_partkey % 4)) as coin, l_partkey % 4 as c,
         sum(l_extendedprice) / (sum(l_quantity) * 1.0000037e0) as mid from lineitem group by concat('C', @text(l_partkey % 4)), l_partkey % 4
)
select coin, mid, mid * 1.0005 as oracle, 1.25e-5 as funding, mid * 0.999 as impact_bid,
       case when c = 2 then null else mid * 1.001 end as impact_ask, case when c = 1 then null else c end as sz_decimals from px
"""

# open positions of traders: one row per (user, coin)
FIXTURES["fx_positions"] = """
select @text(l_suppkey) as trader, concat('C', @text(l_partkey % 5)) as coin,
       sum(case when l_linenumber % 2 = 0 then l_quantity else -l_quantity end) / 100 as size
from lineitem group by @text(l_suppkey), concat('C', @text(l_partkey % 5))
"""
# traders' total account values
FIXTURES["fx_trader_equity"] = """
select @text(s_suppkey) as trader, s_acctbal * 3 as trader_equity from supplier
"""
# books: each supplier is copied by the strategy of its nation
FIXTURES["fx_books"] = """
select s_suppkey as book_id, concat('n', @text(s_nationkey)) as strategy, @text(s_suppkey) as trader,
       case when s_suppkey % 11 = 0 then -5e3 else 1e4 end as cash, (s_suppkey % 7 = 0) as closed from supplier
"""
FIXTURES["fx_strategies"] = """
select concat('n', @text(n_nationkey)) as strategy, 1e3 * (1 + n_nationkey) as cash_pool, 2e4 as capital,
       9e4 + 1000 * n_nationkey as peak_equity, case when n_nationkey % 6 = 5 then 'halted' else 'active' end as status
from nation
"""
# positions held by the books: close to, but not exactly, what the trader holds; coin C3 is missing, C9 has no market
FIXTURES["fx_book_positions"] = """
select l_suppkey as book_id, case when l_partkey % 5 = 3 then 'C9' else concat('C', @text(l_partkey % 5)) end as coin,
       sum(case when l_linenumber % 2 = 0 then l_quantity else -l_quantity end) / 150 as size
from lineitem group by l_suppkey, case when l_partkey % 5 = 3 then 'C9' else concat('C', @text(l_partkey % 5)) end
"""
# equity snapshots of books next to the copied trader's numbers
FIXTURES["fx_book_equity"] = """
with hourly as (
  select user_id, @ms(ts) as ts_ms, max(event_id) as event_id, sum(value) as v, max(event_type) as kind
  from events group by user_id, @ms(ts)
)
select user_id as book_id, ts_ms, 3000 + (v - 60) * 2 + user_id % 7 as equity, abs(v - 40) * 30 as gross,
       1000 + v * 3 as trader_equity,
       case when kind = 'error' then null else (v - 50) * 0.5 end as trader_perp_pnl,
       case when kind = 'view' then 5e-1 else null end as leverage_scale from hourly
"""
FIXTURES["fx_event_books"] = """
select distinct user_id as book_id, concat('s', @text(user_id % 6)) as strategy, concat('t', @text(user_id)) as trader from events
"""
# strategy equity snapshots
FIXTURES["fx_strategy_equity"] = """
select concat('s', @text(user_id % 6)) as strategy, @ms(ts) as ts_ms, max(9000 + value * 20) as equity,
       max(value * 50) as gross, count(*) as books
from events group by concat('s', @text(user_id % 6)), @ms(ts)
"""
# audit log
FIXTURES["fx_log"] = """
select event_id as id, @ms(ts) as ts_ms, concat('s', @text(user_id % 6)) as strategy, @text(user_id) as trader,
       case event_type when 'click' then 'trade' when 'view' then 'funding' when 'error' then 'halt'
                       when 'purchase' then 'close_book' else 'open_book' end as kind,
       value * 0.01 as fee, value - 60 as cash_delta, props as detail
from events
"""
# behavior flags raised by the watch
FIXTURES["fx_flags"] = """
select @ms(ts) as ts_ms, @text(user_id) as trader,
       case event_id % 4 when 0 then 'watch:martingale' when 1 then 'liquidated' when 2 then 'leverage' else 'martingale' end as rule,
       value from events where event_type = 'error'
"""
# vault terms
FIXTURES["fx_vaults"] = """
select concat('w', @text(s_suppkey * 3)) as vault_address, s_acctbal * 10 as tvl, (s_suppkey % 4 = 0) as is_closed,
       case when s_suppkey % 3 = 0 then null else 5e-2 + (s_suppkey % 4) * 5e-2 end as leader_commission,
       @each('2001-01-01', '2001-02-01') as snapshot_at from supplier
"""


def spark_fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adaptor as a Spark DataFrame; only the tables it names are opened."""
    sql = dialect(FIXTURES[name], SPARK)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}}", sql)
    return spark.sql(sql, **used)


def duck_fixture(name: str) -> str:
    """The adaptor as DuckDB SQL over the pre-registered views."""
    return dialect(FIXTURES[name], DUCK)
