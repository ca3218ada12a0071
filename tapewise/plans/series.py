"""Queries of the deduplication, return, signal, score, selection and backtest operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.scan import asof
from ..operators import accumulate as A
from ..operators import backtest as B
from ..operators import latest as K
from ..operators import returns as R
from ..operators import score as C
from ..operators import select as L
from ..operators import signals as S
from ..session import shared
from .registry import cte, query

DAY, WEEK, STEP = X.DAY_MS, X.WEEK_MS, 2 * X.WEEK_MS
MIN_ACCOUNT = 45_000.0      # exercises the null branch on these curves
LOOK, HOLD = 12 * WEEK, 4 * WEEK

# --- deduplication and latest values ---------------------------------------------------------------

cte(
    eq_twice="select * from fx_equity union all select * from fx_equity where period = 'allTime'",
    fills_twice="select * from fx_fills union all select * from fx_fills where side = 'B'",
)


def twice(df, cond):
    return df.unionByName(df.filter(cond))


@query("K1_dedup_equity", "user period time_ms ~account_value ~pnl",
       "(select distinct * from eq_twice)")
def _(t):
    return K.dedup_equity(twice(t.fx_equity, "period = 'allTime'"))


@query("K2_dedup_fills", "user tid oid time_ms coin side dir ~px ~sz ~start_position ~closed_pnl ~fee liquidated",
       "(select distinct * from fills_twice)")
def _(t):
    return K.dedup_fills(twice(t.fx_fills, "side = 'B'"))


@query("K3_latest_by_snapshot", "coin time_ms ~close ~volume", "(select * from fx_candles where snapshot_at = 'b')")
def _(t):
    return K.latest_by_snapshot(t.fx_candles, ["coin", "time_ms"])


@query("K4_latest_value", "user ~account_value",
       "(select user, arg_max(account_value, time_ms) as account_value from fx_equity where period = 'allTime' group by user)")
def _(t):
    return K.latest_value(t.fx_equity.filter("period = 'allTime'"), ["user"], "account_value", "time_ms")


@query("K5_newest_snapshot", "user ~account_value",
       "(select * from fx_leaderboard where coalesce(data_as_of_ms, snapshot_ms) = "
       "(select max(coalesce(data_as_of_ms, snapshot_ms)) from fx_leaderboard))")
def _(t):
    return K.newest_snapshot(t.fx_leaderboard, F.coalesce("data_as_of_ms", "snapshot_ms"))


@query("K6_snapshot_versions", "snap_ms user snapshot_ms ~week_roi",
       "(select *, coalesce(data_as_of_ms, snapshot_ms) as snap_ms from fx_leaderboard)")
def _(t):
    again = t.fx_leaderboard.filter(F.col("data_as_of_ms").isNotNull()).withColumn("snapshot_ms", F.col("snapshot_ms") + X.HOUR_MS)
    return K.snapshot_versions(t.fx_leaderboard.unionByName(again))


@query("K7_last_in_bucket", "book_id bucket_ms ts_ms ~equity",
       "(select book_id, ts_ms // 3600000 * 3600000 as bucket_ms, max(ts_ms) as ts_ms, arg_max(equity, ts_ms) as equity "
       "from fx_book_equity group by all)")
def _(t):
    return K.last_in_bucket(t.fx_book_equity, ["book_id"], "ts_ms", ["equity"], bucket_width_ms=X.HOUR_MS)


# --- grids, as-of joins, returns -------------------------------------------------------------------

SUNDAY = "(({ms} // 86400000) + (((3 - {ms} // 86400000) % 7) + 7) % 7) * 86400000"
cte(
    capital="select user, time_ms, account_value, pnl from fx_equity where period = 'allTime' and not (account_value = 0 and pnl = 0)",
    perp_curve="select user, time_ms, pnl from fx_equity where period = 'perpAllTime' and not (account_value = 0 and pnl = 0)",
    grid_ends=f"select unnest(range({SUNDAY.format(ms='min(time_ms)')}, max(time_ms) + {DAY} + 1, {STEP})) as end_ms from capital",
    user_span="select user, min(time_ms) as lo, max(time_ms) as hi from capital group by user",
    user_grid=f"select user, end_ms from user_span join grid_ends on end_ms between lo and hi + {DAY}",
    snap_capital=f"""select g.user, g.end_ms, case when g.end_ms - c.time_ms <= {STEP + WEEK} then c.time_ms end as ts,
      case when g.end_ms - c.time_ms <= {STEP + WEEK} then c.account_value end as av,
      case when g.end_ms - c.time_ms <= {STEP + WEEK} then c.pnl end as pnl_total
      from user_grid g asof left join capital c on g.user = c.user and g.end_ms >= c.time_ms""",
    snap_all=f"""select g.*, case when g.end_ms - c.time_ms <= {STEP + WEEK} then c.time_ms end as ts_perp,
      case when g.end_ms - c.time_ms <= {STEP + WEEK} then c.pnl end as pnl
      from snap_capital g asof left join perp_curve c on g.user = c.user and g.end_ms >= c.time_ms""",
    snap_lag="""select *, lag(av) over w as p_av, lag(pnl) over w as p_pnl, lag(pnl_total) over w as p_total,
      lag(ts) over w as p_ts, lag(ts_perp) over w as p_perp from snap_all window w as (partition by user order by end_ms)""",
    snap_flow="select *, pnl - p_pnl as dpnl, p_av + greatest(av - p_av - (pnl_total - p_total), 0) as capital_ from snap_lag",
    rets=f"""select user, end_ms, av as account_value, pnl, dpnl,
      case when p_av >= {MIN_ACCOUNT} and capital_ >= {MIN_ACCOUNT / 2} and ts <> p_ts and ts_perp <> p_perp
      then greatest(dpnl / capital_, -1) end as ret from snap_flow""",
)


def returns(t):
    return shared(R.period_returns(t.fx_equity, min_account=MIN_ACCOUNT))


def capital(t):
    return t.fx_equity.filter("period = 'allTime'")


@query("R1_step_grid", "end_ms", "grid_ends")
def _(t):
    return R.step_grid(capital(t))


@query("R2_entity_grid", "user end_ms", "user_grid")
def _(t):
    return R.entity_grid(capital(t))


AS_OF = "fx_fills f asof left join capital c on f.user = c.user and f.time_ms {op} c.time_ms"


def _asof_sql(op):
    near = f"abs(f.time_ms - c.time_ms) <= {15 * DAY}"
    return (f"(select f.user, f.time_ms, f.tid, coalesce(case when {near} then c.time_ms end, -1) as m_time_ms, "
            f"case when {near} then c.account_value end as m_account_value from {AS_OF.format(op=op)})")


@query("R3_asof_backward", "user time_ms tid m_time_ms ~m_account_value", _asof_sql(">="))
def _(t):
    return asof(t.fx_fills.select("user", "time_ms", "tid"), capital(t), ["user"], "time_ms", "time_ms", ["account_value"],
                {"backward": "m_"}, 15 * DAY).fillna(-1, ["m_time_ms"])


@query("R4_asof_forward", "user time_ms tid m_time_ms ~m_account_value", _asof_sql("<="))
def _(t):
    return asof(t.fx_fills.select("user", "time_ms", "tid"), capital(t), ["user"], "time_ms", "time_ms", ["account_value"],
                {"forward": "m_"}, 15 * DAY).fillna(-1, ["m_time_ms"])


@query("R5_period_returns", "user end_ms ~account_value ~pnl ~dpnl ~ret", "rets")
def _(t):
    return R.period_returns(t.fx_equity, min_account=MIN_ACCOUNT)


cte(net_rets="""select r.user, r.end_ms, ret - coalesce(c, 0.1) * greatest(ret, 0) as ret from rets r left join
  (select vault_address as user, arg_max(coalesce(leader_commission, -1), snapshot_at) as c0,
   case when c0 < 0 then null else c0 end as c from fx_vaults group by vault_address) using (user)""")


@query("R6_net_of_commission", "user end_ms ~ret", "net_rets")
def _(t):
    return R.net_of_commission(returns(t), t.fx_vaults)


cte(ratio_weeks=f"""select user, (time_ms + {3 * DAY}) // {WEEK} * {WEEK} - {3 * DAY} + {WEEK} as end_ms,
      arg_max(pnl, time_ms) as pnl, arg_max(pnl_ratio, time_ms) as ratio from fx_ratio group by all""",
    ratio_rets="""select w.user, w.end_ms, aum as account_value, pnl, pnl - lag(pnl) over x as dpnl,
      (1 + ratio) / (1 + lag(ratio) over x) - 1 as ret from ratio_weeks w left join fx_ratio_traders using (user)
      window x as (partition by w.user order by w.end_ms)""")


@query("R7_weekly_returns_from_ratio", "user end_ms ~account_value ~pnl ~dpnl ~ret", "ratio_rets")
def _(t):
    return R.weekly_returns_from_ratio(t.fx_ratio, t.fx_ratio_traders)


BENCH = "Brand#11"
cte(bench_px=f"select time_ms, close from fx_candles where snapshot_at = 'b' and coin = '{BENCH}'",
    bench_snap="""select e.end_ms, c.close from (select distinct end_ms from rets) e
      asof left join bench_px c on e.end_ms >= c.time_ms""",
    bench_rets="select end_ms, close / lag(close) over (order by end_ms) - 1 as btc_ret from bench_snap")


@query("R8_benchmark_step_returns", "end_ms ~btc_ret", "bench_rets")
def _(t):
    return R.benchmark_step_returns(t.fx_candles, returns(t), BENCH)


cte(day_last="""select user, time_ms // 86400000 * 86400000 as day_ms, arg_max(account_value, time_ms) as av,
      arg_max(pnl, time_ms) as pnl from fx_equity where period = 'month' group by all""",
    day_prev="""select user, day_ms, lag(av) over w as prev, pnl - lag(pnl) over w as dpnl from day_last
      window w as (partition by user order by day_ms)""",
    day_rets="select user, day_ms, dpnl / prev as ret from day_prev where prev > 100 and dpnl is not null")


@query("R9_daily_pnl_returns", "user day_ms ~ret", "day_rets")
def _(t):
    return R.daily_pnl_returns(t.fx_equity)


cte(ends="select distinct end_ms from rets",
    cal="""select min(end_ms) as first_ms, max(end_ms) as last_ms,
      (select min(d) from (select end_ms - lag(end_ms) over (order by end_ms) as d from ends)) as step_ms from ends""")


@query("R10_infer_step", "step_ms steps_in_window",
       f"(select step_ms, (select count(*) from rets r cross join cal c where r.end_ms > c.last_ms - {LOOK} and r.end_ms <= c.last_ms) "
       "as steps_in_window from cal)")
def _(t):
    r = returns(t)
    last = r.agg(F.max("end_ms").alias("m")).scalar()
    n = R.steps_in(r, last - LOOK, last).agg(F.count(F.lit(1)).alias("n")).scalar()
    return R.infer_step(r).withColumn("steps_in_window", n)


# --- signals and persistence -----------------------------------------------------------------------

def hash_uniform(*parts):
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::bigint / {float(16 ** 13)}"


def signals_sql(steps: str, out: str) -> dict[str, str]:
    """Signals of step rows (formation_ms, step_ms, user, end_ms, ret, dpnl)."""
    return {
        f"{steps}_curve": f"""select *, product(1 + ret) over w as curve, row_number() over w as rn,
          count(*) over (partition by formation_ms, user) as n from {steps} window w as (partition by formation_ms, user order by end_ms)""",
        f"{steps}_dd": f"""select *, curve / max(curve) over (partition by formation_ms, user order by end_ms) - 1 as dd from {steps}_curve""",
        out: f"""select formation_ms, user, max(step_ms) as step_ms, count(*) as n_obs, max(abs(ret)) as max_abs_ret,
          product(1 + ret) - 1 as ret,
          avg(ret) / nullif(stddev_samp(ret), 0) as sharpe, stddev_samp(ret) as vol, min(dd) as low_dd, sum(dpnl) as pnl_usd,
          avg(case when ret > 0 then 1.0 else 0.0 end) as consistency,
          avg(ret) / nullif(sqrt(avg(least(ret, 0) * least(ret, 0))), 0) as sortino,
          case when min(dd) < 0 then (product(1 + ret) - 1) / -min(dd) end as calmar,
          case when sum(least(ret, 0)) < 0 then sum(greatest(ret, 0)) / -sum(least(ret, 0)) end as profit_factor,
          -abs(avg(ret) filter (rn <= n // 2) - avg(ret) filter (rn > n // 2)) as stability,
          {hash_uniform('user', "'0'", 'formation_ms::varchar')} as random
          from {steps}_dd group by formation_ms, user""",
    }


cte(
    dates=f"""select unnest(range(first_ms + {LOOK}, last_ms - {HOLD} + 1, {HOLD})) as formation_ms, step_ms from cal""",
    look="""select formation_ms, step_ms, r.* from dates join rets r on r.end_ms > formation_ms - %d and r.end_ms <= formation_ms
      where ret is not null""" % LOOK,
    **signals_sql("look", "sig_all"),
    sig=f"select * from sig_all where n_obs >= greatest(2, floor(12 * ({WEEK} / step_ms) * 0.75))",
    hold_steps=f"""select formation_ms, step_ms, r.* from dates join rets r on r.end_ms > formation_ms and r.end_ms <= formation_ms + {HOLD}""",
    fwd=f"""select formation_ms, user, count(*) as fwd_obs, product(1 + ret) - 1 as fwd_ret from hold_steps where ret is not null
      group by formation_ms, user having count(*) >= greatest(1, floor(4 * ({WEEK} / max(step_ms)) * 0.75))""",
)
SIGNAL_COLUMNS = ("formation_ms user n_obs ~max_abs_ret ~ret ~sharpe ~vol ~low_dd ~pnl_usd ~consistency ~sortino ~calmar "
                  "~profit_factor ~stability ~random")


@query("S1_formation_signals", SIGNAL_COLUMNS, "sig")
def _(t):
    return S.formation_signals(returns(t))


@query("S2_forward_outcome", "formation_ms user fwd_obs ~fwd_ret", "fwd")
def _(t):
    return S.forward_outcome(returns(t))


def rank_stats_sql(source: str, keys: str, ent: str = "user") -> dict[str, str]:
    """Rank statistics of (keys, entity, sig, out) rows, as a chain of expressions named after the source."""
    return {
        f"{source}_rk": f"""select *, rank() over (partition by {keys} order by sig) + (count(*) over (partition by {keys}, sig) - 1) / 2 as rs,
          rank() over (partition by {keys} order by out) + (count(*) over (partition by {keys}, out) - 1) / 2 as ro,
          row_number() over (partition by {keys} order by sig desc, {ent}) as pos, count(*) over (partition by {keys}) as n
          from {source} where sig is not null and out is not null""",
        f"{source}_k": f"select *, greatest(1, floor(n * 0.2)) as k, median(out) over (partition by {keys}) as med from {source}_rk",
        f"{source}_st": f"""select {keys}, max(n) as n, case when max(n) >= 10 then corr(rs, ro) end as ic,
          case when max(n) >= 10 then median(out) filter (pos <= k) end as top,
          case when max(n) >= 10 then median(out) filter (pos > n - k) end as bottom,
          case when max(n) >= 10 then max(med) end as "all",
          case when max(n) >= 10 then avg(case when out > med then 1.0 else 0.0 end) filter (pos <= k) end as top_hit
          from {source}_k group by {keys}""",
    }


NAMES = ", ".join(S.SIGNALS)
cte(pers=f"""unpivot (select formation_ms, user, s.ret::double as ret, sharpe, low_dd, pnl_usd, random, fwd_ret as out
      from sig s join fwd f using (formation_ms, user)) on {NAMES} into name signal value sig""",
    **rank_stats_sql("pers", "formation_ms, signal"))
STATS = "n ~ic ~top ~bottom ~all ~top_hit"


@query("S3_rank_stats", f"formation_ms {STATS}", "(select * from pers_st where signal = 'sharpe')")
def _(t):
    r = returns(t)
    joined = S.formation_signals(r).join(S.forward_outcome(r), ["formation_ms", "user"])
    return S.rank_stats(joined, ["formation_ms"], "sharpe", "fwd_ret")


@query("S4_retroactive_persistence", f"formation_ms signal {STATS}", "pers_st")
def _(t):
    return S.retroactive_persistence(returns(t))


cte(
    snaps="select distinct coalesce(data_as_of_ms, snapshot_ms) as snap_ms from fx_leaderboard",
    lb="""select *, coalesce(data_as_of_ms, snapshot_ms) as snap_ms from fx_leaderboard
      where user not in (select vault_address from fx_vaults where is_closed)""",
    pairs_=f"""select a.snap_ms as snapshot_a_ms, arg_min(b.snap_ms, abs(b.snap_ms - a.snap_ms - {WEEK}) * 1e6 + b.snap_ms / 1e9) as snapshot_b_ms
      from snaps a join snaps b on b.snap_ms > a.snap_ms and abs(b.snap_ms - a.snap_ms - {WEEK}) <= {12 * X.HOUR_MS} group by a.snap_ms""",
    lb_pairs="""select snapshot_a_ms, snapshot_b_ms, a.user, a.week_roi, b.week_roi as out from lb a
      join pairs_ on a.snap_ms = snapshot_a_ms left join lb b on b.snap_ms = snapshot_b_ms and b.user = a.user
      where a.account_value >= 10000""",
    fwd_test=f"""select snapshot_a_ms, snapshot_b_ms, user, out, 'week_roi' as signal, week_roi as sig from lb_pairs union all
      select snapshot_a_ms, snapshot_b_ms, user, out, 'random', {hash_uniform('user', "'lb'", 'snapshot_a_ms::varchar')} from lb_pairs""",
    **rank_stats_sql("fwd_test", "snapshot_a_ms, snapshot_b_ms, signal"),
    fwd_table="""select c.snapshot_a_ms, c.snapshot_b_ms, c.signal, dropped, coalesce(n, 0) as n, ic, top, bottom, "all", top_hit from
      (select snapshot_a_ms, snapshot_b_ms, signal, count(*) filter (out is null) as dropped from fwd_test group by all) c
      left join fwd_test_st using (snapshot_a_ms, snapshot_b_ms, signal)""",
)


def forward_table(t):
    return S.leaderboard_persistence(t.fx_leaderboard, exclude=t.fx_vaults.filter("is_closed").select(
        F.col("vault_address").alias("user")))


@query("S5_leaderboard_persistence", f"snapshot_a_ms snapshot_b_ms signal dropped {STATS}", "fwd_table")
def _(t):
    return forward_table(t)


SUMMARY = """count(*) as periods, round_even(avg(n), 0) as wallets_avg, avg(ic) as mean_ic,
  avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) as ic_tstat, avg(case when ic > 0 then 1.0 else 0.0 end) as ic_positive,
  avg(top - "all") as top_minus_all, avg(top - bottom) as top_minus_bottom, avg(top_hit) as top_hit"""
cte(summ=f"select signal, {SUMMARY} from pers_st where ic is not null group by signal")


@query("S6_summarize", "signal periods ~wallets_avg ~mean_ic ~ic_tstat ~ic_positive ~top_minus_all ~top_minus_bottom ~top_hit",
       "summ")
def _(t):
    return S.summarize(S.retroactive_persistence(returns(t)))


cte(views="""select *, case when signal = 'random' then 'random' else 'all_pairs' end as view from fwd_table union all
      select *, 'independent' from fwd_table where signal = 'week_roi' and
      (snapshot_a_ms // 86400000 - (select min(snapshot_a_ms) from fwd_table) // 86400000) % 7 = 0""",
    views_summ=f"""select view, {SUMMARY}, (select min(snapshot_a_ms) from fwd_table) as first_ms,
      (select avg(n) from fwd_table) as wallets, (select median(dropped) from fwd_table) as dropped_median
      from views where ic is not null group by view""")


@query("S7_forward_test", "view periods ~mean_ic ~ic_tstat ~ic_positive first_ms ~wallets ~dropped_median", "views_summ")
def _(t):
    return S.forward_test(shared(forward_table(t)))


cte(beta="""select user, count(*) as n_beta_obs, covar_samp(ret, btc_ret) / nullif(var_samp(btc_ret), 0) as beta,
      covar_samp(ret, btc_ret) / nullif(stddev_samp(ret) * stddev_samp(btc_ret), 0) as btc_corr,
      avg(ret) - covar_samp(ret, btc_ret) / nullif(var_samp(btc_ret), 0) * avg(btc_ret) as alpha
      from rets join bench_rets using (end_ms) where ret is not null and btc_ret is not null group by user having count(*) >= 6""")


@query("S8_trader_beta", "user n_beta_obs ~beta ~btc_corr ~alpha", "beta")
def _(t):
    return S.trader_beta(returns(t), t.fx_candles, BENCH)


@query("S9_ic_error_band", "signal ~mean_ic ~se ~low ~high",
       "(select signal, mean_ic, abs(mean_ic / ic_tstat) as se, mean_ic - 2 * abs(mean_ic / ic_tstat) as low, "
       "mean_ic + 2 * abs(mean_ic / ic_tstat) as high from summ)")
def _(t):
    return S.ic_error_band(S.summarize(S.retroactive_persistence(returns(t))))


# --- backtests -------------------------------------------------------------------------------------

ELIGIBLE = 40_000.0
cte(el_last="""select s.*, r.account_value from sig s join rets r on r.user = s.user and r.end_ms <= s.formation_ms
      qualify row_number() over (partition by s.formation_ms, s.user order by r.end_ms desc) = 1""",
    el=f"select * from el_last where account_value >= {ELIGIBLE} and max_abs_ret <= 1")


def eligible(t, r=None):
    return B.eligible_signals(returns(t) if r is None else r, min_account=ELIGIBLE)


@query("B1_eligible_signals", "formation_ms user n_obs ~ret ~sharpe ~account_value", "el")
def _(t):
    return eligible(t)


def backtest_sql(picks: str, cost: float = B.REBALANCE_COST) -> dict[str, str]:
    """The period table of selections (strategy, formation_ms, user)."""
    return {
        f"{picks}_held": f"""select p.*, coalesce(product(1 + coalesce(h.ret, 0)) - 1, 0) as r, count(h.ret) as steps,
          exists(select 1 from {picks} q where q.strategy = p.strategy and q.user = p.user and q.formation_ms = p.formation_ms - {HOLD}) as kept
          from {picks} p left join hold_steps h on h.formation_ms = p.formation_ms and h.user = p.user group by all""",
        f"{picks}_per": f"""select d.strategy, d.formation_ms, count(h.user) as n_selected, count(*) filter (h.user is not null and steps = 0) as n_missing,
          avg(case when kept then 0.0 else 1.0 end) filter (h.user is not null) as turnover, coalesce(sum(r) / nullif(count(h.user), 0), 0) as gross_ret
          from (select formation_ms, strategy from dates, (select distinct strategy from {picks})) d
          left join {picks}_held h using (strategy, formation_ms) group by all""",
        f"{picks}_net": f"select *, case when n_selected > 0 then (1 + gross_ret) * (1 - {cost}) - 1 else 0 end as net_ret from {picks}_per",
        f"{picks}_bt": f"""select *, formation_ms + {HOLD} as end_ms, product(1 + net_ret) over (partition by strategy order by formation_ms) as equity
          from {picks}_net""",
        **metrics_sql(f"{picks}_bt"),
    }


def metrics_sql(table: str) -> dict[str, str]:
    return {
        f"{table}_dd": f"""select *, row_number() over w as i, max(equity) over w as peak from {table}
          window w as (partition by strategy order by formation_ms)""",
        f"{table}_rec": f"""select *, equity / peak - 1 as dd, i - max(case when equity >= peak then i end)
          over (partition by strategy order by formation_ms) as since from {table}_dd""",
        f"{table}_m": f"""select strategy, count(*) as periods, arg_max(equity, i) - 1 as total_return,
          case when arg_max(equity, i) > 0 then pow(arg_max(equity, i), 1 / (count(*) / 13)) - 1 else -1 end as cagr, min(dd) as max_drawdown,
          case when stddev_samp(net_ret) > 0 then stddev_samp(net_ret) * sqrt(13) end as volatility,
          case when stddev_samp(net_ret) > 0 then avg(net_ret) / stddev_samp(net_ret) * sqrt(13) end as sharpe,
          case when count(*) > 1 and avg(pow(least(net_ret, 0), 2)) > 0 then avg(net_ret) / sqrt(avg(pow(least(net_ret, 0), 2))) * sqrt(13) end as sortino,
          case when min(dd) < 0 then (case when arg_max(equity, i) > 0 then pow(arg_max(equity, i), 1 / (count(*) / 13)) - 1 else -1 end) / -min(dd) end as calmar,
          avg(case when net_ret > 0 then 1.0 else 0.0 end) as hit_rate,
          case when sum(least(net_ret, 0)) < 0 then sum(greatest(net_ret, 0)) / -sum(least(net_ret, 0)) end as profit_factor,
          max(net_ret) as best_period, min(net_ret) as worst_period, max(since) as recovery_periods, avg(turnover) as avg_turnover,
          avg(case when n_selected > 0 then 1.0 else 0.0 end) as time_invested,
          sum(n_missing)::double / greatest(sum(n_selected), 1) as missing_share from {table}_rec group by strategy""",
    }


def top_sql(signal: str, n: int = 10, extra: str = "true") -> str:
    return (f"select formation_ms, user, row_number() over (partition by formation_ms order by {signal} desc, user) as rank "
            f"from el where {signal} is not null and {extra} qualify rank <= {n}")


cte(
    top_sharpe=top_sql("sharpe"),
    top_low_dd=top_sql("low_dd", 10, "ret > 0"),
    random10="""select formation_ms, user, row_number() over (partition by formation_ms order by
      md5(concat_ws('|', user, '0', formation_ms::varchar)), user) as rank from el qualify rank <= 10""",
    picks="""select 'top_sharpe' as strategy, formation_ms, user from top_sharpe union all
      select 'low_dd', formation_ms, user from top_low_dd union all select 'random', formation_ms, user from random10 union all
      select 'everyone', formation_ms, user from el""",
    **backtest_sql("picks"),
)
STRATEGIES = ["top_sharpe", "low_dd", "random", "everyone"]
PERIOD_COLUMNS = "strategy formation_ms end_ms n_selected n_missing ~turnover ~gross_ret ~net_ret ~equity"
METRIC_COLUMNS = ("strategy periods ~total_return ~cagr ~max_drawdown ~volatility ~sharpe ~sortino ~calmar ~hit_rate "
                  "~profit_factor ~best_period ~worst_period recovery_periods ~avg_turnover ~time_invested ~missing_share")


def backtest(t):
    r = returns(t)
    el = shared(eligible(t, r))
    picks = B.stack_selections(top_sharpe=C.top_by(el, "sharpe", 10), low_dd=C.top_by(el, "low_dd", 10, True),
                               random=C.random_pick(el, 10), everyone=C.everyone(el))
    return B.copy_backtest(r, picks, STRATEGIES)


@query("B2_copy_backtest", PERIOD_COLUMNS, "picks_bt")
def _(t):
    return backtest(t)


cte(hold_px="""select 'buy_and_hold' as strategy, formation_ms, formation_ms + %d as end_ms, 1 as n_selected, 0 as n_missing, 0.0 as turnover,
      coalesce(b.close / a.close - 1, 0) as net_ret from dates asof left join bench_px a on formation_ms >= a.time_ms
      asof left join bench_px b on formation_ms + %d >= b.time_ms""" % (HOLD, HOLD),
    hold_bt="select *, net_ret as gross_ret, product(1 + net_ret) over (order by formation_ms) as equity from hold_px",
    **metrics_sql("hold_bt"))


def held_benchmark(t, r):
    px = K.latest_by_snapshot(t.fx_candles.filter(F.col("coin") == BENCH), ["time_ms"])
    dates = S.formation_dates(r).withColumn("end_ms", F.col("formation_ms") + HOLD)
    return B.buy_and_hold(px, dates)


@query("B3_buy_and_hold", "formation_ms end_ms ~net_ret ~equity", "hold_bt")
def _(t):
    return held_benchmark(t, returns(t))


@query("B4_summarize_backtest", METRIC_COLUMNS, "picks_bt_m")
def _(t):
    return B.summarize_backtest(backtest(t))


@query("B5_compare", "strategy ~sharpe ~cagr ~max_drawdown ~calmar",
       "(select * from picks_bt_m union all by name select * from hold_bt_m)")
def _(t):
    return B.compare(shared(backtest(t)).unionByName(held_benchmark(t, returns(t))))


cte(seeded10="""select i::varchar as strategy, formation_ms, user from el, range(20) s(i) qualify row_number() over
      (partition by i, formation_ms order by md5(concat_ws('|', user, i::varchar, formation_ms::varchar)), user) <= 10""",
    **backtest_sql("seeded10"))


def baseline(t):
    r = returns(t)
    return B.random_baseline(r, shared(eligible(t, r)), 10)


@query("B6_random_baseline", "seed " + METRIC_COLUMNS.replace("strategy ", ""),
       "(select *, strategy::int as seed from seeded10_bt_m)")
def _(t):
    return baseline(t)


@query("B7_baseline_quantiles", "metric ~median ~p10 ~p90",
       "(select 'cagr' as metric, median(cagr) as median, list_sort(list(cagr))[floor(19 * 0.1 + 0.5)::int + 1] as p10, "
       "list_sort(list(cagr))[floor(19 * 0.9 + 0.5)::int + 1] as p90 from seeded10_bt_m)")
def _(t):
    return B.baseline_quantiles(shared(baseline(t)))


# --- accumulation ----------------------------------------------------------------------------------

MIN_NOTIONAL = 50_000.0
cte(
    closes="select coin, (time_ms // 86400000)::int as day, close, close * volume as notional from fx_candles where snapshot_at = 'b'",
    days=f"""select unnest(range(min(day) + 182, max(day) - 28 + 1, 28)) as day_at from closes where coin = '{BENCH}'""",
    hist="""select c.coin, d.day_at, d.day_at - c.day as age, c.day, close, notional from closes c join days d on c.day <= d.day_at""",
    coin_at="""select coin, day_at, arg_max(close, day) as now, min(age) as stale, max(age) as born, max(close) as ath,
      arg_max(close, day) filter (age between 182 and 185) as then_, coalesce(max(close) filter (age <= 90), arg_max(close, day)) as high90,
      coalesce(list_sort(list(notional) filter (age <= 30))[(count(*) filter (age <= 30)) // 2 + 1], 0) as vol30
      from hist group by coin, day_at""",
    bench_at=f"select day_at, case when stale <= 3 then now end as b_now, then_ as b_then from coin_at where coin = '{BENCH}'",
    coin_feat=f"""select coin, day_at, (born >= 180 and vol30 >= {MIN_NOTIONAL} and now > ath * (1 - 0.95) and stale <= 3) as eligible,
      (now / then_) / (b_now / b_then) - 1 as momentum, now / high90 - 1 as fall_from_high90 from coin_at left join bench_at using (day_at)""",
)


@query("B8_daily_closes", "coin day ~close ~notional", "closes")
def _(t):
    return A.daily_closes(t.fx_candles)


def features(t):
    return A.coin_features(A.daily_closes(t.fx_candles), BENCH, min_notional=MIN_NOTIONAL)


@query("B9_coin_features_at", "coin day_at eligible ~momentum ~fall_from_high90", "coin_feat")
def _(t):
    return features(t)


RULES = {"strong": ("strong", 5), "fallen": ("fallen", 5), "btc_only": ("btc_only", 1), "random": ("random", 5),
         "everything": ("everything", 0)}
cte(
    coin_picks=f"""select 'strong' as strategy, day_at, coin from coin_feat where eligible and momentum is not null
      qualify row_number() over (partition by day_at order by momentum desc, coin) <= 5 union all
      select 'fallen', day_at, coin from coin_feat where eligible qualify row_number() over (partition by day_at order by fall_from_high90, coin) <= 5 union all
      select 'btc_only', day_at, '{BENCH}' from days union all
      select 'random', day_at, coin from coin_feat where eligible
      qualify row_number() over (partition by day_at order by md5(concat_ws('|', coin, '0', day_at::varchar)), coin) <= 5 union all
      select 'everything', day_at, coin from coin_feat where eligible""",
    coin_px="""select p.*, day_at + 28 as day_end, case when day_at - a.day <= 3 then a.close end as p0 from coin_picks p
      asof left join closes a on p.coin = a.coin and p.day_at >= a.day""",
    coin_px2="""select p.*, case when day_end - b.day <= 3 then b.close end as p1, b.close as p1_last,
      exists(select 1 from coin_picks q where q.strategy = p.strategy and q.coin = p.coin and q.day_at = p.day_at - 28) as kept
      from coin_px p asof left join closes b on p.coin = b.coin and p.day_end >= b.day""",
    coin_per="""select strategy, day_at, count(c.coin) as n_selected, count(*) filter (c.coin is not null and p1 is null) as n_missing,
      avg(case when kept then 0.0 else 1.0 end) filter (c.coin is not null) as turnover,
      coalesce(sum(coalesce(coalesce(p1, p1_last) / p0 - 1, 0)) / nullif(count(c.coin), 0), 0) as gross_ret
      from (select day_at, strategy from days, (select distinct strategy from coin_picks)) left join coin_px2 c using (day_at, strategy) group by all""",
    coin_net="""select *, day_at::bigint * 86400000 as formation_ms, (day_at + 28)::bigint * 86400000 as end_ms,
      case when n_selected > 0 then (1 + gross_ret) * (1 - 0.0015 * turnover) - 1 else 0 end as net_ret from coin_per""",
    coin_bt="select *, product(1 + net_ret) over (partition by strategy order by formation_ms) as equity from coin_net",
    **metrics_sql("coin_bt"),
)


@query("B10_accumulate_backtest", PERIOD_COLUMNS, "coin_bt")
def _(t):
    return A.accumulate_backtest(A.daily_closes(t.fx_candles), RULES, BENCH, min_notional=MIN_NOTIONAL)


START = 946_684_800_000     # 2000-01-01


@query("B11_benchmark_since", "~start ~last ~ret",
       f"(select a as start, b as last, b / a - 1 as ret from (select arg_max(close, time_ms) filter (time_ms <= {START}) as a, "
       "arg_max(close, time_ms) as b from bench_px))")
def _(t):
    return A.benchmark_since(t.fx_candles, START, BENCH)
