"""Queries of the raw-record builders, incremental normalization and the streaming jobs.

Raw envelopes are written from the rows of `events`, as the source would answer; the SQL states the
rows the builders must give back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder, path_bytes
from ..sources import raw, tables
from ..streaming import jobs, watch
from .registry import cte, query
from .trading import RULES, recent_sql

MS = "(epoch_us(ts) // 1000)"
FETCHED = "strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')"


def source(t) -> DataFrame:
    """Events with an epoch-ms time and the time of the fetch as text."""
    ts = F.col("ts").cast("timestamp")
    return t.table("events").select(
        "event_id", "user_id", "event_type", "value", F.unix_millis(ts).alias("ms"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("fetched_at"),
        F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("http_date"),
        F.date_format(ts, "yyyy-MM-dd").alias("date"))


def lines(df: DataFrame, request: str, payload: str) -> DataFrame:
    """One envelope line per row; `request` and `payload` are SQL expressions that give JSON text."""
    version = "concat('{\"last_modified\":\"', http_date, '\"}')"
    return df.select("event_id", "date", F.expr(
        "concat('{\"platform\":\"p\",\"dataset\":\"d\",\"fetched_at\":\"', fetched_at, '\",\"request\":', "
        f"{request}, ',\"source_version\":', {version}, ',\"payload\":', {payload}, '}}')").alias("value"))


def records(t, request: str, payload: str) -> DataFrame:
    return raw.parse_records(lines(source(t), request, payload)).filter(F.col("_corrupt").isNull())


USER = "to_json(named_struct('user', concat('0xAb', user_id)))"


@query("I1_raw_scan", "event_id platform fetched_at",
       f"(select event_id, 'p' as platform, {FETCHED} as fetched_at from events where event_id % 10 >= 2)")
def _(t):
    good = lines(source(t), "to_json(named_struct('user', concat('0xAb', user_id), 'id', event_id))", "'{}'")
    damaged = F.when(F.col("event_id") % 10 == 0, F.expr("substr(value, 1, 40)")).when(
        F.col("event_id") % 10 == 1, F.lit("  ")).otherwise(F.col("value"))
    folder = new_folder(t.spark, "raw")
    good.select(damaged.alias("value")).write.option("compression", "gzip").text(folder)
    return raw.raw_scan(t.spark, folder).withColumn("event_id", F.get_json_object("request", "$.id").cast("long"))


@query("I2_leaderboard_rows", "snapshot_at data_as_of user ~account_value ~day_pnl ~week_roi ~month_vlm ~alltime_pnl",
       f"(select {FETCHED} as snapshot_at, {FETCHED} as data_as_of, '0xab' || user_id || '-' || event_id as user, value as account_value, "
       "value * 2 as day_pnl, value * 3 as week_roi, null::double as month_vlm, -value as alltime_pnl from events)")
def _(t):
    window = lambda name, **m: ("concat('[\"" + name + "\",', to_json(named_struct(" + ", ".join(
        f"'{k}', string({v})" for k, v in m.items()) + ")), ']')")
    # A window that comes twice: the last one counts.
    windows = ", ".join([window("day", pnl="value * 9"), window("Day", pnl="value * 2"), window("week", roi="value * 3"), window("month", pnl="1"),
                         window("allTime", pnl="-value")])
    payload = ("concat('{\"leaderboardRows\":[{\"ethAddress\":\"0xAB', user_id, '-', event_id, '\",\"accountValue\":\"', value, "
               f"'\",\"windowPerformances\":[', concat_ws(',', {windows}), ']}}]}}')")
    return raw.leaderboard_rows(records(t, "'{}'", payload))


STATE = """to_json(named_struct('marginSummary', named_struct('accountValue', string(value * 10), 'totalNtlPos', string(value), 'totalMarginUsed', '1'),
  'withdrawable', string(value / 2), 'assetPositions', array(
   named_struct('position', named_struct('coin', concat('C', user_id % 4), 'szi', string(-value), 'entryPx', '2.5',
    'leverage', named_struct('type', 'cross', 'value', 5), 'cumFunding', named_struct('sinceOpen', string(value / 4)))),
   named_struct('position', named_struct('coin', 'BTC', 'szi', string(value), 'entryPx', '1',
    'leverage', named_struct('type', 'isolated', 'value', 3), 'cumFunding', named_struct('sinceOpen', '0'))))))"""
DEX = "if(user_id % 2 = 0, to_json(named_struct('user', concat('u', user_id), 'dex', 'xyz')), to_json(named_struct('user', concat('u', user_id))))"
DEX_SQL = "case when user_id % 2 = 0 then 'xyz' else '' end as dex"


@query("I3_account_rows", "snapshot_at user dex ~account_value ~total_notional ~withdrawable open_positions",
       f"(select {FETCHED} as snapshot_at, 'u' || user_id as user, {DEX_SQL}, value * 10 as account_value, value as total_notional, "
       "value / 2 as withdrawable, 2 as open_positions from events)")
def _(t):
    return raw.account_rows(records(t, DEX, STATE))


@query("I4_position_rows", "snapshot_at user dex coin ~size ~entry_px leverage_type ~leverage ~funding_since_open",
       f"(select {FETCHED} as snapshot_at, 'u' || user_id as user, {DEX_SQL}, 'C' || user_id % 4 as coin, -value as size, 2.5 as entry_px, "
       "'cross' as leverage_type, 5 as leverage, value / 4 as funding_since_open from events union all "
       f"select {FETCHED}, 'u' || user_id, {DEX_SQL}, 'BTC', value, 1, 'isolated', 3, 0 from events)")
def _(t):
    return raw.position_rows(records(t, DEX, STATE))


SERIES = """concat('[["allTime",{"accountValueHistory":[[', ms, ',"', value, '"],[', ms + 1, ',"', value * 2, '"]],"pnlHistory":[[', ms, ',"', value * 7, '"],[', ms, ',"', -value, '"]]}],',
  '["month",{"accountValueHistory":[[', ms, ',"', value, '"]],"pnlHistory":[]}]]')"""
SERIES_SQL = (f"select {{user}} as user, 'allTime' as period, {MS} as time_ms, value as account_value, -value as pnl from events union all "
              f"select {{user}}, 'allTime', {MS} + 1, value * 2, null from events union all select {{user}}, 'month', {MS}, value, null from events")


@query("I5_equity_rows", "user period time_ms ~account_value ~pnl", f"({SERIES_SQL.format(user=chr(39) + '0xAb' + chr(39) + ' || user_id')})")
def _(t):
    return raw.equity_rows(records(t, USER, SERIES))


@query("I6_vault_rows", "snapshot_at vault_address leader name ~tvl ~apr is_closed relationship created_ms",
       f"(select {FETCHED} as snapshot_at, '0xv' || event_id as vault_address, '0xl' || user_id as leader, event_type as name, value as tvl, "
       f"value / 100 as apr, user_id % 3 = 0 as is_closed, case when user_id % 2 = 0 then 'parent' end as relationship, {MS} as created_ms from events)")
def _(t):
    payload = """to_json(array(named_struct('apr', value / 100, 'summary', named_struct('vaultAddress', concat('0xV', event_id),
      'leader', concat('0xL', user_id), 'name', event_type, 'tvl', string(value), 'isClosed', user_id % 3 = 0,
      'relationship', if(user_id % 2 = 0, named_struct('type', 'parent'), null), 'createTimeMillis', ms))))"""
    return raw.vault_rows(records(t, "'{}'", payload))


@query("I7_candle_rows", "snapshot_at coin interval time_ms ~open ~high ~low ~close ~volume",
       f"(select {FETCHED} as snapshot_at, 'C' || user_id % 4 as coin, '1d' as interval, {MS} + k as time_ms, value as open, value + 1 as high, "
       "value - 1 as low, value + k as close, 7 as volume from events, (values (0), (1)) s(k))")
def _(t):
    candle = lambda k: f"named_struct('t', ms + {k}, 'o', string(value), 'h', string(value + 1), 'l', string(value - 1), 'c', string(value + {k}), 'v', '7')"
    return raw.candle_rows(records(t, "to_json(named_struct('coin', concat('C', user_id % 4), 'interval', '1d'))",
                                   f"to_json(array({candle(0)}, {candle(1)}))"))


VAULT = "to_json(named_struct('vaultAddress', concat('0xV', event_id)))"


@query("I8_vault_detail_rows", "snapshot_at vault_address name leader ~leader_commission followers is_closed allow_deposits",
       f"(select {FETCHED} as snapshot_at, '0xv' || event_id as vault_address, event_type as name, "
       "case when user_id % 5 = 0 then '' else '0xl' || user_id end as leader, 0.1 as leader_commission, "
       "case when user_id % 2 = 0 then 2 else 0 end as followers, false as is_closed, true as allow_deposits from events where event_id % 4 <> 0)")
def _(t):
    payload = """if(event_id % 4 = 0, 'null', to_json(named_struct('name', event_type, 'leader', if(user_id % 5 = 0, null, concat('0xL', user_id)),
      'leaderCommission', 0.1, 'followers', if(user_id % 2 = 0, array(named_struct('user', 'a'), named_struct('user', 'b')), null),
      'isClosed', false, 'allowDeposits', true)))"""
    return raw.vault_detail_rows(records(t, VAULT, payload))


@query("I9_vault_equity_rows", "user period time_ms ~account_value ~pnl",
       f"(select * from ({SERIES_SQL.format(user=chr(39) + '0xv' + chr(39) + ' || event_id')}))")
def _(t):
    return raw.vault_equity_rows(records(t, VAULT, f"concat('{{\"name\":\"x\",\"portfolio\":', {SERIES}, '}}')"))


@query("I10_okx_trader_rows", "snapshot_at data_ver user ~aum ~pnl_ratio lead_days n_instruments",
       f"(select {FETCHED} as snapshot_at, 'v1' as data_ver, 'c' || event_id as user, value as aum, value / 10 as pnl_ratio, "
       "case when user_id % 3 = 0 then -1 else user_id end as lead_days, 2 as n_instruments from events)")
def _(t):
    payload = """to_json(array(named_struct('dataVer', 'v1', 'ranks', array(named_struct('uniqueCode', concat('c', event_id), 'aum', string(value),
      'pnlRatio', string(value / 10), 'leadDays', if(user_id % 3 = 0, '', string(user_id)), 'traderInsts', array('a', 'b')))),
      named_struct('dataVer', 'v2', 'ranks', null)))"""
    return raw.okx_trader_rows(records(t, "'{}'", payload)).fillna(-1, ["lead_days"])


@query("I11_okx_pnl_rows", "user time_ms ~pnl ~pnl_ratio",
       f"(select 'c' || user_id as user, {MS} as time_ms, value as pnl, value / 10 as pnl_ratio from events)")
def _(t):
    return raw.okx_pnl_rows(records(t, "to_json(named_struct('uniqueCode', concat('c', user_id)))",
                                    "to_json(array(named_struct('beginTs', string(ms), 'pnl', string(value), 'pnlRatio', string(value / 10))))"))


FILL = """to_json(array(named_struct('time', ms, 'coin', concat('C', user_id % 4), 'side', if(event_id % 2 = 0, 'A', 'B'), 'dir', 'Open Long',
  'px', string(value), 'sz', '2', 'startPosition', '0', 'closedPnl', string(value / 3), 'fee', '0.5', 'crossed', true,
  'liquidation', case event_type when 'error' then named_struct('liquidatedUser', concat('0xAB', user_id))
                                 when 'view' then named_struct('liquidatedUser', '0xother') end, 'oid', event_id, 'tid', event_id * 2, 'hash', 'h')))"""
FILL_COLUMNS = "user time_ms coin side dir ~px ~sz ~closed_pnl ~fee crossed liquidated oid tid"
FILL_SQL = (f"(select '0xAb' || user_id as user, {MS} as time_ms, 'C' || user_id % 4 as coin, case when event_id % 2 = 0 then 'A' else 'B' end as side, "
            "'Open Long' as dir, value as px, 2 as sz, value / 3 as closed_pnl, 0.5 as fee, true as crossed, event_type = 'error' as liquidated, "
            "event_id as oid, event_id * 2 as tid from events)")


@query("I12_fill_rows", FILL_COLUMNS, FILL_SQL)
def _(t):
    return raw.fill_rows(records(t, USER, FILL))


def raw_files(t, dataset: str = "fills") -> str:
    """The events as gzip files raw/<dataset>/date=.../, below the shared folder."""
    root = new_folder(t.spark, "raw")
    lines(source(t), USER, FILL).select("date", "value").write.partitionBy("date").option("compression", "gzip").text(f"{root}/{dataset}")
    return root


@query("I13_normalize_incremental", FILL_COLUMNS, FILL_SQL)
def _(t):
    root, out = raw_files(t), new_folder(t.spark, "processed")
    # The second run finds nothing new: every file is in the ledger.
    for _ in range(2):
        tables.normalize_incremental(t.spark, root, out, ["fills"], settle_seconds=-60)
    return tables.read_table(t.spark, out, "fills")


@query("I14_read_table", "date rows",
       "(select strftime(ts, '%Y-%m-%d') as date, count(*) as rows from events group by all)")
def _(t):
    root, out = raw_files(t), new_folder(t.spark, "processed")
    tables.normalize_incremental(t.spark, root, out, ["fills"], settle_seconds=-60)
    return tables.read_table(t.spark, out, "fills").groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


@query("I14_read_table_range", FILL_COLUMNS, FILL_SQL.replace(" from events", " from events where ts >= '2024-01-10' and ts < '2024-01-21'"))
def _(t):
    root, out = raw_files(t), new_folder(t.spark, "processed")
    tables.normalize_incremental(t.spark, root, out, ["fills"], settle_seconds=-60)
    return tables.read_table(t.spark, out, "fills", "2024-01-10", "2024-01-20")


@query("I15_equity_union", "user period time_ms ~account_value ~pnl", "(select distinct * from fx_equity)")
def _(t):
    census = t.fx_equity.filter("period <> 'month'").withColumn("extra", F.lit(1))
    return tables.equity_union(t.fx_equity, None, census)


# --- streaming -------------------------------------------------------------------------------------

def event_stream(t) -> DataFrame:
    """The events as a file stream, with event time and epoch ms."""
    stream = (t.spark.readStream.schema(t.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir))
    ts = F.col("ts").cast("timestamp")
    return stream.select("event_id", "user_id", "event_type", "value", F.unix_millis(ts).alias("ts_ms"), ts.alias("event_time"))


@query("T1_stream_ingest", FILL_COLUMNS, FILL_SQL)
def _(t):
    root, out, log = raw_files(t), new_folder(t.spark, "processed"), new_folder(t.spark, "checkpoint")
    jobs.stream_ingest(t.spark, f"{root}/fills", "fills", out, log, settle_seconds=-60).awaitTermination()
    return tables.read_table(t.spark, out, "fills")


@query("T2_stream_dedup_fills", "user tid oid ~px",
       "(select user_id as user, event_id as tid, event_id // 3 as oid, value as px from events)")
def _(t):
    fills = event_stream(t).select(F.col("user_id").alias("user"), F.col("event_id").alias("tid"),
                                   F.floor(F.col("event_id") / 3).cast("long").alias("oid"), F.col("value").alias("px"), "event_time")
    again = fills.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    return jobs.run_to_table(jobs.stream_dedup_fills(again), "dedup")


@query("T3_stream_fill_activity", "day_ms user fills too_active",
       f"(select day_ms, user, count(*) as fills, count(*) > 5 as too_active from (select {MS} // 86400000 * 86400000 as day_ms, user_id as user from events) "
       f"where day_ms + 86400000 <= (select max({MS}) - 3600000 from events) group by day_ms, user)")
def _(t):
    fills = event_stream(t).select(F.col("user_id").alias("user"), "event_time")
    return jobs.run_to_table(jobs.stream_fill_activity(fills, max_per_day=5), "activity")


@query("T4_stream_last_hour_equity", "hour_ms book_id ts_ms ~equity",
       f"(select ts_ms // 3600000 * 3600000 as hour_ms, book_id, max(ts_ms) as ts_ms, arg_max(equity, (ts_ms, equity)) as equity from "
       f"(select user_id as book_id, {MS} as ts_ms, value as equity from events) group by 1, 2 "
       f"having hour_ms + 3600000 <= (select max({MS}) - 600000 from events))")
def _(t):
    snaps = event_stream(t).select(F.col("user_id").alias("book_id"), "ts_ms", F.col("value").alias("equity"), "event_time")
    return jobs.run_to_table(jobs.stream_last_hour_equity(snaps), "hourly")


STREAM_FILE_BYTES = 12 << 20       # of lines, some 800,000 of them: four fills each


def fill_stream(t, fills: DataFrame, batches: int) -> DataFrame:
    """The fills as a stream of so many batches, roughly in order of time: a batch of a large table is many files, which are
    written by as many tasks."""
    path = new_folder(t.spark, "fills")
    files = -(-path_bytes(t.spark, f"{t.sf_dir}/lineitem.parquet") // STREAM_FILE_BYTES)
    fills.repartitionByRange(batches * files, "time_ms").write.parquet(path)
    return t.spark.readStream.schema(fills.schema).option("maxFilesPerTrigger", files).parquet(path)


cte(watch_hits=" union all ".join(
    f"select user as trader, '{r}' as rule, '{c}' as feature, {c}::double as value, {x}::double as \"limit\", "
    f"coalesce(n_trades, 0) as n_trades, coalesce(n_trades, 0) >= {n} as actionable from feats30 where {c} > {x}" for r, c, x, n in RULES),
    # The watch compares the last 30 days with the rest of the window.
    **recent_sql(30, "30"))


@query("T5_stream_watch", "trader rule feature ~value ~limit n_trades actionable", "watch_hits")
def _(t):
    from . import trading as W
    # Three batches, each of which finds the fills of the ones before as state.
    out, log = new_folder(t.spark, "watch"), new_folder(t.spark, "checkpoint")
    watch.stream_watch(fill_stream(t, t.fx_fills, 3), lambda: t.fx_equity, out, log, W.NOW, W.WINDOW, W.RULES).awaitTermination()
    return watch.current_hits(t.spark, out)
