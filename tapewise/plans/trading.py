"""Queries of the fill, risk, book, selection and quality operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import behavior as H
from ..operators import books as P
from ..operators import latest as K
from ..operators import quality as Q
from ..operators import risk as G
from ..operators import score as C
from ..operators import select as L
from ..session import shared
from ..sources.layout import Layout, open_layout, write_layout
from . import series as Z
from .registry import cte, query

DAY, HOUR = X.DAY_MS, X.HOUR_MS
NOW = 1_004_918_400_000        # 2001-11-05, a day after the last fill
WINDOW, RECENT = 365, 120
START, CUT = NOW - WINDOW * DAY, NOW - RECENT * DAY

# --- fills -----------------------------------------------------------------------------------------

cte(
    flips="select *, case when side = 'B' then sz else -sz end as signed_sz, start_position + case when side = 'B' then sz else -sz end as after from fx_fills",
    perp="""select user, coin, time_ms, px, signed_sz, start_position, after as position_after, closed_pnl, fee, liquidated, tid, '' as leg
      from flips where dir <> 'Long > Short' union all
      select user, coin, time_ms, px, -start_position, start_position, 0, closed_pnl, fee * (abs(start_position) / abs(signed_sz)), liquidated, tid, 'close'
      from flips where dir = 'Long > Short' union all
      select user, coin, time_ms, px, after, 0, after, 0, fee * (abs(after) / abs(signed_sz)), false, tid, 'open' from flips where dir = 'Long > Short'""",
    win=f"select * from perp where time_ms >= {START}",
)


def trips_sql(src: str) -> dict[str, str]:
    """Round trips of a perp table, named <src>_trips."""
    w = "partition by user, coin order by time_ms, tid, leg"
    wt = "partition by user, coin, trade order by time_ms, tid, leg"
    return {
        f"{src}_t0": f"select *, lag(position_after) over ({w}) as before, abs(position_after) > abs(start_position) as grows from {src}",
        f"{src}_t1": f"select *, before is null or before = 0 or start_position = 0 as opens from {src}_t0",
        f"{src}_t2": f"""select *, sum(opens::int) over ({w}) as trade,
          case when opens or not grows then 1 else abs(start_position) / abs(position_after) end as w_,
          case when opens and grows then px * (abs(start_position) + abs(signed_sz)) / abs(position_after) when opens then px
               when grows then px * abs(signed_sz) / abs(position_after) else 0 end as b_ from {src}_t1""",
        f"{src}_t3": f"select *, product(w_) over ({wt}) as p_, first_value(signed_sz > 0) over ({wt}) as long_ from {src}_t2",
        f"{src}_t4": f"select *, p_ * sum(b_ / p_) over ({wt}) as avg_ from {src}_t3",
        f"{src}_t5": f"select *, lag(avg_) over ({wt}) as avg_before from {src}_t4",
        f"{src}_trips": f"""select user, coin, min(time_ms) as opened_ms, max(time_ms) filter (position_after = 0) as closed_ms,
          case when any_value(long_) then 'long' else 'short' end as side, count(*) as n_fills, count(*) filter (grows and start_position <> 0) as n_adds,
          count(*) filter (not opens and grows and start_position <> 0 and case when long_ then px < avg_before else px > avg_before end) as n_adds_losing,
          count(*) filter (not grows and position_after <> 0) as n_partial_exits, max(abs(signed_sz) * px) filter (opens) as initial_notional,
          max(greatest(abs(position_after) * px, abs(start_position) * px)) as max_notional, arg_max(avg_, (time_ms, tid, leg)) as avg_entry,
          sum(closed_pnl) as realized_pnl, sum(fee) as fees, bool_or(liquidated) as liquidated, sum(closed_pnl) - sum(fee) as pnl_net,
          (max(time_ms) filter (position_after = 0) - min(time_ms)) / 3600000 as duration_h, arg_min(tid, (time_ms, tid, leg)) as open_tid,
          arg_min(leg, (time_ms, tid, leg)) as open_leg from {src}_t5 group by user, coin, trade""",
    }


def exposure_sql(src: str) -> dict[str, str]:
    """Gross exposure of a perp table, named <src>_expo."""
    near = f"abs(e.time_ms - c.time_ms) <= {15 * DAY}"
    return {
        f"{src}_x": f"""select user, time_ms, tid, leg, abs(position_after) * px as x,
          lag(abs(position_after) * px) over (partition by user, coin order by time_ms, tid, leg) as x0 from {src}""",
        f"{src}_g0": f"""select user, time_ms, tid, leg, sum(x - coalesce(x0, 0)) over (partition by user order by time_ms, tid, leg
          rows unbounded preceding) as g from {src}_x""",
        f"{src}_g": f"select user, time_ms, tid, leg, case when abs(g) < 1e-6 then 0 else g end as gross from {src}_g0",
        f"{src}_b": f"""select e.*, case when {near} then c.time_ms end as tb, case when {near} then equity end as eb from {src}_g e
          asof left join equity_curve c on e.user = c.user and e.time_ms >= c.time_ms""",
        f"{src}_f": f"""select e.*, case when {near} then equity end as ef from {src}_b e
          asof left join equity_curve c on e.user = c.user and e.time_ms <= c.time_ms""",
        f"{src}_u": f"""select *, case when eb is null or time_ms - tb > {DAY} then greatest(eb, ef) else eb end as equity from {src}_f""",
        f"{src}_expo": f"""select user, time_ms, tid, leg, gross, equity,
          case when equity > 0 and gross / equity <= 50 then gross / equity end as leverage from {src}_u""",
    }


cte(equity_curve="select user, time_ms, min(account_value) as equity from fx_equity group by user, time_ms",
    **trips_sql("perp"), **trips_sql("win"), **exposure_sql("perp"), **exposure_sql("win"))


@query("H1_perp_fills", "user coin time_ms tid leg ~px ~signed_sz ~start_position ~position_after ~closed_pnl ~fee liquidated", "perp")
def _(t):
    return H.perp_fills(t.fx_fills)


TRIP_COLUMNS = ("user coin opened_ms open_tid open_leg closed_ms side n_fills n_adds n_adds_losing n_partial_exits ~initial_notional "
                "~max_notional ~avg_entry ~realized_pnl ~fees liquidated ~pnl_net ~duration_h")


@query("H2_round_trips", TRIP_COLUMNS, "(select * replace (coalesce(closed_ms, -1) as closed_ms) from perp_trips)")
def _(t):
    counts = H.leg_counts(t.fx_fills)
    return H.round_trips(H.perp_by_user(t.fx_fills, counts), counts=counts).fillna(-1, ["closed_ms"])


@query("H2_round_trips_stored", TRIP_COLUMNS, "(select * replace (coalesce(closed_ms, -1) as closed_ms) from perp_trips)")
def _(t):
    counts = H.leg_counts(t.fx_fills)
    layout = Layout(("user",), H.ORDER, 8).fitting(counts.agg(F.sum("_rows")).first()[0] or 0)
    name = f"perp_{uuid.uuid4().hex[:12]}"
    path = write_layout(H.perp_by_user(t.fx_fills, counts, layout.buckets), name, layout, counts=counts)
    stored = open_layout(t.spark, name, layout, path)
    return H.trips_of(stored.cold, stored.hot).fillna(-1, ["closed_ms"])


@query("H3_equity_points", "user time_ms ~equity", "equity_curve")
def _(t):
    return H.equity_points(t.fx_equity)


@query("H4_gross_exposure", "user time_ms tid leg ~~gross ~equity ~leverage", "perp_expo")
def _(t):
    counts = H.leg_counts(t.fx_fills)
    return H.gross_exposure(H.perp_by_user(t.fx_fills, counts), t.fx_equity, counts=counts)


def style_sql(cut: int, suffix: str = "") -> dict[str, str]:
    """Style change with the recent part starting at `cut`."""
    changes = ", ".join(f"case when o.{c} = 0 and n.{c} > 0 then 'infinity'::double else n.{c} / nullif(o.{c}, 0) end as change_{d}"
                        for c, d in (("size", "size"), ("duration", "duration"), ("lev", "leverage")))
    return {
        f"st{suffix}": f"""select t.*, opened_ms >= {cut} as recent, case when eq > 0 then initial_notional / eq end as size_frac
          from win_trips t left join at_open using (user, opened_ms)""",
        f"st_side{suffix}": f"""select user, recent, median(size_frac) as size, median(duration_h) as duration, list(distinct coin) as coins
          from st{suffix} group by user, recent""",
        f"lev_side{suffix}": f"select user, time_ms >= {cut} as recent, median(leverage) as lev from win_expo where leverage is not null group by all",
        f"side_all{suffix}": f"select * from st_side{suffix} left join lev_side{suffix} using (user, recent)",
        f"style{suffix}": f"""select n.user, {changes},
          len(list_intersect(n.coins, o.coins))::double / len(list_distinct(list_concat(n.coins, o.coins))) as coin_overlap
          from side_all{suffix} n join side_all{suffix} o on n.user = o.user and n.recent and not o.recent""",
    }


FEATURES = """select * from cover left join tf using (user) left join conc using (user) left join mart using (user)
  left join lev using (user) left join style using (user) left join copy_ using (user)"""


def recent_sql(days: int, suffix: str) -> dict[str, str]:
    """The features with another length of the recent part."""
    return {**style_sql(NOW - days * DAY, suffix), f"feats{suffix}": FEATURES.replace("join style ", f"join style{suffix} ")}


cte(
    closed_="select * from win_trips where closed_ms is not null",
    tf=f"""select user, count(*) as n_trades, count(*) / {float(WINDOW)} as trades_per_day, count(distinct coin) as n_coins,
      avg(case when pnl_net > 0 then 1.0 else 0.0 end) as win_rate,
      case when sum(greatest(-pnl_net, 0)) > 0 then sum(greatest(pnl_net, 0)) / sum(greatest(-pnl_net, 0)) end as profit_factor,
      median(duration_h) as median_duration_h, avg(case when n_adds_losing > 0 then 1.0 else 0.0 end) as avg_down_share,
      case when sum(n_adds) > 0 then sum(n_adds_losing)::double / sum(n_adds) end as adds_losing_share, count(*) filter (liquidated) as liquidations,
      case when sum(greatest(pnl_net, 0)) > 0 then max(pnl_net) / sum(greatest(pnl_net, 0)) end as best_trade_share,
      min(pnl_net) as worst_trade_pnl from closed_ group by user""",
    conc="""select user, max(n) / sum(n) as top_coin_share, sum(n * n) / (sum(n) * sum(n)) as hhi from
      (select user, coin, sum(max_notional) as n from win_trips group by user, coin) group by user""",
    seq0="""select user, pnl_net, initial_notional, lag(pnl_net) over w as prev_pnl, lag(initial_notional) over w as prev_notional
      from closed_ window w as (partition by user order by opened_ms, coin, open_tid, open_leg)""",
    seq="select *, initial_notional / prev_notional as ratio from seq0 where prev_notional > 0",
    mart="""select user, median(ratio) filter (prev_pnl < 0) as post_loss_size_ratio, median(ratio) filter (not prev_pnl < 0) as post_win_size_ratio,
      avg(case when ratio >= 1.5 then 1.0 else 0.0 end) filter (prev_pnl < 0) as martingale_share from seq group by user""",
    lev="""select user, median(leverage) as median_leverage,
      list_sort(list(leverage) filter (leverage is not null))[floor((count(leverage) - 1) * 0.95 + 0.5)::int + 1] as p95_leverage,
      max(leverage) as max_leverage, avg(case when leverage is null then 1.0 else 0.0 end) as leverage_unknown_share
      from win_expo group by user""",
    at_open="select user, time_ms as opened_ms, arg_min(coalesce(equity, -1), (tid, leg)) as eq from win_expo group by user, time_ms",
    **style_sql(CUT),
    copy_="""select user, invisible_share, short_trade_share, median_fills_per_trade, median_partial_exits,
      100 * (1 - invisible_share) * (1 - 0.5 * short_trade_share) / (1 + 0.1 * median_partial_exits) as copyability_estimate from
      (select user, avg(case when duration_h < 2 / 60 then 1.0 else 0.0 end) as invisible_share,
       avg(case when duration_h < 0.25 then 1.0 else 0.0 end) as short_trade_share, median(n_fills) as median_fills_per_trade,
       median(n_partial_exits) as median_partial_exits from closed_ group by user)""",
    cover=f"""select user, min(time_ms) as first_fill_ms, count(*) as fills_total, count(*) filter (time_ms >= {START}) / {float(WINDOW)} as fills_per_day,
      count(*) filter (time_ms >= {START} and liquidated) as liquidation_fills, min(time_ms) < {START} as window_complete
      from perp group by user having count(*) filter (time_ms >= {START}) > 0""",
    feats=FEATURES,
)


def window_perp(t):
    return shared(H.perp_fills(t.fx_fills, since_ms=START).filter(F.col("time_ms") >= START))


def window_trades(t):
    return shared(H.round_trips(window_perp(t)))


@query("H5_trade_features", "user n_trades ~trades_per_day n_coins ~win_rate ~profit_factor ~median_duration_h ~avg_down_share "
       "~adds_losing_share liquidations ~best_trade_share ~worst_trade_pnl", "tf")
def _(t):
    return H.trade_features(window_trades(t), WINDOW * DAY)


@query("H6_coin_concentration", "user ~top_coin_share ~hhi", "conc")
def _(t):
    return H.coin_concentration(window_trades(t))


@query("H7_martingale", "user ~post_loss_size_ratio ~post_win_size_ratio ~martingale_share", "mart")
def _(t):
    return H.martingale(window_trades(t))


@query("H8_leverage_stats", "user ~median_leverage ~p95_leverage ~max_leverage ~leverage_unknown_share", "lev")
def _(t):
    return H.leverage_stats(shared(H.gross_exposure(window_perp(t), t.fx_equity, since_ms=START)))


@query("H9_style_change", "user ~change_size ~change_duration ~change_leverage ~coin_overlap", "style")
def _(t):
    perp = window_perp(t)
    return H.style_change(shared(H.round_trips(perp)), shared(H.gross_exposure(perp, t.fx_equity, since_ms=START)), NOW, RECENT)


@query("H10_copyability", "user ~invisible_share ~short_trade_share ~median_fills_per_trade ~median_partial_exits ~copyability_estimate",
       "copy_")
def _(t):
    return H.copyability(window_trades(t))


def features(t, wanted=None):
    return shared(H.behavior_features(t.fx_fills, t.fx_equity, NOW, WINDOW, RECENT, wanted=wanted))


def named(rules):
    """The features that the (feature, ...) rules look at."""
    return [r[0] for r in rules]


@query("H11_behavior_features", "user first_fill_ms fills_total ~fills_per_day liquidation_fills window_complete ~win_rate "
       "~profit_factor ~median_duration_h ~top_coin_share ~hhi ~martingale_share ~median_leverage ~p95_leverage ~change_size "
       "~change_leverage ~coin_overlap ~copyability_estimate", "feats")
def _(t):
    return features(t)


RULES = (("liquidated", "liquidations", 0.0, 1), ("leverage", "p95_leverage", 4.0, 1), ("martingale", "martingale_share", 0.3, 12),
         ("leverage_escalation", "change_leverage", 1.5, 10), ("size_escalation", "change_size", 1.2, 10))
cte(hits=" union all ".join(
    f"select user as trader, '{r}' as rule, '{c}' as feature, {c}::double as value, {x}::double as \"limit\", "
    f"coalesce(n_trades, 0) as n_trades, coalesce(n_trades, 0) >= {n} as actionable from feats where {c} > {x}" for r, c, x, n in RULES))


@query("H12_exit_rules", "trader rule feature ~value ~limit n_trades actionable", "hits")
def _(t):
    return H.exit_rules(features(t, ["n_trades", *(feature for _, feature, _, _ in RULES)]), RULES)


FLAGS_SINCE = 1_705_536_000_000     # 2024-01-18
cte(flagged=f"""select trader, arg_max(rule, (ts_ms, rule)) as rule from fx_flags where ts_ms >= {FLAGS_SINCE} and rule not like 'watch:%'
      group by trader""")


@query("H13_active_flags", "trader rule", "flagged")
def _(t):
    return H.active_flags(t.fx_flags, FLAGS_SINCE)


# --- score, selection, cohorts ---------------------------------------------------------------------

def score_sql(src: str) -> str:
    ok = lambda c: f"(max_abs_ret <= 1 and {c} is not null)"
    pct = " + ".join(
        f"{w} * coalesce(case when {ok(c)} then (rank() over (partition by formation_ms, {ok(c)} order by {c}) + "
        f"(count(*) over (partition by formation_ms, {ok(c)}, {c}) - 1) / 2) / count(*) over (partition by formation_ms, {ok(c)}) end, 0)"
        for c, w in C.WEIGHTS.items())
    return f"select *, case when max_abs_ret <= 1 then 100 * ({pct}) / {sum(C.WEIGHTS.values())} end as raw_score from {src}"


def penalty_sql(src: str) -> str:
    cost = " + ".join(f"case when b.{c} > {x} then {p} else 0 end" for c, x, p in C.PENALTIES)
    reason = "case " + " ".join(f"when b.{c} > {x} then '{c}'" for c, x in C.EXCLUSIONS) + " end"
    return (f"select s.*, greatest(raw_score - ({cost}), 0) as trader_score, ({cost})::double as behavior_penalty, b.liquidations is not null as behavior_known, "
            f"{reason} as exclusion_reason, ({reason}) is not null as behavior_excluded from {src} s left join feats b using (user)")


cte(scored0=score_sql("el"), scored=penalty_sql("scored0"))


@query("C1_score_from_signals", "formation_ms user ~trader_score", "(select *, raw_score as trader_score from scored0)")
def _(t):
    return C.score_from_signals(shared(Z.eligible(t)))


@query("C2_behavior_penalties", "formation_ms user ~trader_score ~behavior_penalty behavior_known", "scored")
def _(t):
    return C.score_from_signals(shared(Z.eligible(t)), features(t, named(C.PENALTIES)))


@query("C3_behavior_exclusions", "formation_ms user exclusion_reason behavior_excluded", "scored")
def _(t):
    return C.behavior_exclusions(Z.eligible(t), features(t, named(C.EXCLUSIONS)))


@query("C4_top_by", "formation_ms user rank", f"({Z.top_sql('low_dd', 10, 'ret > 0')})")
def _(t):
    return C.top_by(Z.eligible(t), "low_dd", 10, True)


@query("C5_random_pick", "formation_ms user rank", "random10")
def _(t):
    return C.random_pick(Z.eligible(t), 10)


@query("C6_everyone", "formation_ms user", "el")
def _(t):
    return C.everyone(Z.eligible(t))


@query("C7_top_by_score", "formation_ms user rank",
       "(select formation_ms, user, row_number() over (partition by formation_ms order by trader_score desc, user) as rank "
       "from scored where trader_score is not null qualify rank <= 10)")
def _(t):
    return C.top_by_score(shared(Z.eligible(t)), 10, features(t, named(C.PENALTIES)))


@query("C8_top_by_sharpe_v2", "formation_ms user rank",
       "(select formation_ms, user, row_number() over (partition by formation_ms order by sharpe desc, user) as rank "
       "from scored where not behavior_excluded and vol >= 0.002 and sharpe is not null qualify rank <= 10)")
def _(t):
    return C.top_by_sharpe_v2(Z.eligible(t), 10, features(t, named(C.EXCLUSIONS)))


ACT_DAYS, ACT_MAX = 60, 0.5
SINCE = NOW - ACT_DAYS * DAY
cte(activity=f"""select user, count(*) filter (time_ms >= {SINCE}) / {float(ACT_DAYS)} as fills_per_day, max(time_ms) as last_fill_ms
      from fx_fills group by user""",
    active=f"""select distinct e.user, fills_per_day, coalesce(last_fill_ms, -1) as last_fill_ms from fx_equity e left join activity using (user)
      where last_fill_ms is null or (fills_per_day <= {ACT_MAX} and last_fill_ms >= {SINCE})""")


@query("C9_activity_filter", "user ~fills_per_day last_fill_ms", "active")
def _(t):
    pool = t.fx_equity.select("user").distinct()
    return L.activity_filter(pool, t.fx_fills, NOW, ACT_MAX, ACT_DAYS).fillna(-1, ["last_fill_ms"])


MIN_EQUITY = 40_000.0
cte(
    last_look=f"""select (select max(end_ms) from rets) as formation_ms, 0 as step_ms, r.* from rets r
      where end_ms > (select max(end_ms) from rets) - {Z.LOOK} and ret is not null""",
    **Z.signals_sql("last_look", "last_sig"),
    acct="select user, arg_max(account_value, time_ms) as account_value from fx_equity where period = 'allTime' group by user",
    busy=f"select user, count(*) filter (time_ms >= {NOW - 30 * DAY}) / 30.0 as fpd, max(time_ms) as last_ms from fx_fills group by user",
    pool0=f"""select s.*, account_value from last_sig s join acct using (user) left join busy using (user) where n_obs >= 4
      and account_value >= {MIN_EQUITY} and max_abs_ret <= 1 and user not in (select vault_address from fx_vaults)
      and (last_ms is null or (fpd <= 500 and last_ms >= {NOW - 30 * DAY}))""",
    pool1=score_sql("pool0"), pool2=penalty_sql("pool1"),
    newest="""select user, month_pnl as leaderboard_month_pnl from fx_leaderboard where coalesce(data_as_of_ms, snapshot_ms) =
      (select max(coalesce(data_as_of_ms, snapshot_ms)) from fx_leaderboard)""",
    pool="select * from pool2 left join newest using (user)",
)


def candidates(t):
    return shared(L.candidate_signals(t.fx_equity, NOW, t.fx_vaults, t.fx_fills, t.fx_leaderboard, MIN_EQUITY,
                                      window_days=WINDOW, min_account=Z.MIN_ACCOUNT))


@query("C10_candidate_signals", "user n_obs ~ret ~sharpe ~low_dd ~vol ~account_value ~trader_score ~behavior_penalty behavior_known "
       "exclusion_reason ~leaderboard_month_pnl", "pool")
def _(t):
    return candidates(t)


PICKS = (("leaderboard_pnl", "leaderboard_month_pnl", "true"), ("top_return", "ret", "true"), ("top_sharpe", "sharpe", "true"),
         ("low_drawdown", "low_dd", "ret > 0"), ("top_score", "trader_score", "true"),
         ("sharpe_v2", "sharpe", "not behavior_excluded and vol >= 0.002"))
cte(chosen_=" union all ".join(
    f"(select '{n}' as strategy, user, {s} as value, row_number() over (order by {s} desc, user) as rank from pool "
    f"where {s} is not null and {c} qualify rank <= 10)" for n, s, c in PICKS)
    + " union all (select 'random', user, 0.0, row_number() over (order by md5(concat_ws('|', user, 'random', '')), user) as rank "
      "from pool qualify rank <= 10)")


@query("C11_select", "strategy user ~value rank", "chosen_")
def _(t):
    return L.select(candidates(t), 10)


cte(
    lbn="""select * from fx_leaderboard where coalesce(data_as_of_ms, snapshot_ms) =
      (select max(coalesce(data_as_of_ms, snapshot_ms)) from fx_leaderboard)""",
    cohort_rows="""(select user, 'top_alltime_pnl' as cohort from lbn order by alltime_pnl desc, user limit 100) union all
      (select user, 'top_month_roi' from lbn where account_value >= 40000 and month_vlm > 0 order by month_roi desc, user limit 100) union all
      (select user, 'random' from lbn where account_value >= 40000 and month_vlm > 0 order by md5(concat_ws('|', user, '0')), user limit 100)""",
    cohorts_="select user, list_sort(list(distinct cohort)) as cohorts from cohort_rows group by user",
    tracked="""select distinct user, '2001-01-01' as added_at, ['candidates', 'random'] as cohorts from fx_equity where user like 'w1%'""",
    merged="""select user, coalesce(added_at, '2001-11-05') as added_at,
      list_sort(list_distinct(list_concat(coalesce(t.cohorts, []), coalesce(c.cohorts, [])))) as cohorts
      from tracked t full join cohorts_ c using (user)""",
)


def newest_board(t):
    return K.newest_snapshot(t.fx_leaderboard, F.coalesce("data_as_of_ms", "snapshot_ms"))


def cohorts(t):
    return L.universe_cohorts(newest_board(t), 0, 100, 100, 100, MIN_EQUITY)


def universe(t):
    old = t.fx_equity.filter(F.col("user").startswith("w1")).select("user").distinct().select(
        "user", F.lit("2001-01-01").alias("added_at"), F.array(F.lit("candidates"), F.lit("random")).alias("cohorts"))
    return L.universe_merge(old, cohorts(t), "2001-11-05")


@query("C12_universe_cohorts", "user cohorts", "(select user, array_to_string(cohorts, ',') as cohorts from cohorts_)")
def _(t):
    return cohorts(t).withColumn("cohorts", F.array_join("cohorts", ","))


@query("C13_universe_merge", "user added_at cohorts", "(select user, added_at, array_to_string(cohorts, ',') as cohorts from merged)")
def _(t):
    return universe(t).withColumn("cohorts", F.array_join("cohorts", ","))


cte(plan_="""select distinct user from lbn where alltime_vlm >= 10000000 and user not in (select vault_address from fx_vaults)
      union select user from fx_equity where user like 'w2%'""")


@query("C14_census_plan", "user position",
       "(select user, row_number() over (order by md5(concat_ws('|', user, '5'))) as position from plan_)")
def _(t):
    before = t.fx_equity.filter(F.col("user").startswith("w2")).select("user").distinct()
    return L.census_plan(newest_board(t), t.fx_vaults, before, 5, 10_000_000.0)


@query("C15_candidate_funnel", "user",
       "((select user from pool where trader_score is not null order by trader_score desc, user limit 100) union "
       "(select user from pool where sharpe is not null order by sharpe desc, user limit 50))")
def _(t):
    return L.candidate_funnel(candidates(t), 100, 50)


@query("C15_ranking_report", "rank user ~trader_score ~sharpe ~consistency ~account_value behavior_known",
       "(select *, row_number() over (order by trader_score desc, user) as rank from pool where trader_score is not null qualify rank <= 20)")
def _(t):
    return L.ranking_report(candidates(t))


# The account that is explained: any fixed member of the pool at every scale
EXPLAINED = "w1"


@query("C16_rank_explain", "user ~trader_score ~sharpe ~low_dd n_obs eligible score_rank sharpe_rank pool",
       f"(select *, max_abs_ret <= 1 as eligible from (select *, row_number() over (order by trader_score desc, user) as score_rank, "
       f"row_number() over (order by sharpe desc, user) as sharpe_rank, count(*) over () as pool from pool) where user = '{EXPLAINED}')")
def _(t):
    return L.rank_explain(candidates(t), EXPLAINED)


cte(vaults_now="""select vault_address, min(first_seen) as first_seen from (
      select vault_address, '2001-11-05' as first_seen from fx_vaults where not is_closed and tvl >= 10000 union all
      select vault_address, '2000-01-01' from fx_vaults where vault_address like 'w3%') group by vault_address""")


@query("C17_vault_universe", "vault_address first_seen", "vaults_now")
def _(t):
    known = t.fx_vaults.filter(F.col("vault_address").startswith("w3")).select("vault_address", F.lit("2000-01-01").alias("first_seen"))
    return L.vault_universe(known, t.fx_vaults, "2001-11-05")


@query("C18_cohort_coverage", "cohort tracked with_history",
       "(select cohort, count(*) as tracked, count(*) filter (user in (select user from fx_equity)) as with_history "
       "from (select user, unnest(cohorts) as cohort from merged) group by cohort)")
def _(t):
    return L.cohort_coverage(universe(t), t.fx_equity)


# --- risk ------------------------------------------------------------------------------------------

cte(
    chosen_ret="select strategy as grp, user, day_ms, ret from fx_chosen join fx_daily_ret using (user)",
    corr_pairs="""select a.grp, a.user as a, b.user as b, count(*) as days, corr(a.ret, b.ret) as corr from chosen_ret a
      join chosen_ret b on a.grp = b.grp and a.day_ms = b.day_ms and a.user < b.user group by all having count(*) >= 10 and corr(a.ret, b.ret) >= 0.3""",
)


def chosen(t):
    return t.fx_chosen.withColumnRenamed("strategy", "grp")


def pairs(t):
    return G.correlated_pairs(t.fx_daily_ret, chosen(t), 0.3, 10)


@query("P1_correlated_pairs", "grp a b days ~corr", "corr_pairs")
def _(t):
    return pairs(t)


cte(crowd_ret="select user, day_ms, ret from fx_daily_ret where ret is not null",
    crowd_pairs="""select 'all' as grp, a.user as a, b.user as b, count(*) as days, corr(a.ret, b.ret) as corr from crowd_ret a
      join crowd_ret b on a.day_ms = b.day_ms and a.user < b.user group by all having count(*) >= 20 and corr(a.ret, b.ret) >= 0.5""")


@query("P1_correlated_crowd", "grp a b days ~corr", "crowd_pairs")
def _(t):
    everyone = t.fx_daily_ret.select(F.lit("all").alias("grp"), "user").distinct()
    return G.correlated_pairs(t.fx_daily_ret, everyone, 0.5, 20, block_users=64, step_ms=DAY)


LINKS = ("select grp, a, b from corr_pairs union all select grp, b, a from corr_pairs union all "
         "select strategy, user, user from fx_chosen")
cte(links=LINKS,
    # At most ten members per group: nine hops reach everyone.
    hop1="select l.grp, l.a, min(l.b) as m from links l group by all",
    **{f"hop{i}": f"select l.grp, l.a, min(h.m) as m from links l join hop{i - 1} h on h.grp = l.grp and h.a = l.b group by all"
       for i in range(2, 11)})


@query("P2_correlation_groups", "grp user component", "(select grp, a as user, m as component from hop10)")
def _(t):
    return G.correlation_groups(pairs(t), chosen(t))


cte(sized="""select grp, a as user, m as component, count(*) over (partition by grp) as n, count(*) over (partition by grp, m) as k from hop10""",
    alloc="select *, least(1 / n, 0.3) * case when least(1 / n, 0.3) * k > 0.5 then 0.5 / (least(1 / n, 0.3) * k) else 1 end as weight from sized")


@query("P3_allocate", "grp user component ~weight", "alloc")
def _(t):
    return G.allocate(G.correlation_groups(pairs(t), chosen(t)))


cte(
    fund="select strategy as grp, user from (select 'g' || (hash_ % 40)::varchar as strategy, user from (select distinct user, substr(user, 2)::bigint as hash_ from fx_equity))",
    fund_ret="select grp, user, day_ms, ret from fund join day_rets using (user)",
    fund_pairs="""select a.grp, a.user as a, b.user as b from fund_ret a
      join fund_ret b on a.grp = b.grp and a.day_ms = b.day_ms and a.user < b.user group by all having count(*) >= 12 and corr(a.ret, b.ret) >= 0.7""",
    fund_links="select grp, a, b from fund_pairs union all select grp, b, a from fund_pairs union all select grp, user, user from fund",
    fh1="select l.grp, l.a, min(l.b) as m from fund_links l group by all",
    **{f"fh{i}": f"select l.grp, l.a, min(h.m) as m from fund_links l join fh{i - 1} h on h.grp = l.grp and h.a = l.b group by all"
       for i in range(2, 11)},
    fund_sized="select grp, a as user, m as component, count(*) over (partition by grp) as n, count(*) over (partition by grp, m) as k from fh10",
)


@query("P4_weights_for", "grp user component ~weight",
       "(select *, least(1 / n, 0.3) * case when least(1 / n, 0.3) * k > 0.5 then 0.5 / (least(1 / n, 0.3) * k) else 1 end as weight from fund_sized)")
def _(t):
    fund = t.fx_equity.select("user").distinct().select(
        F.concat(F.lit("g"), (F.substring("user", 2, 20).cast("long") % 40).cast("string")).alias("grp"), "user")
    return G.weights_for(t.fx_equity, fund)


# --- copy accounting -------------------------------------------------------------------------------

cte(
    open_books="select * from fx_books where not closed",
    mark="""select b.*, cash + coalesce(sum(size * mid), 0) as equity, coalesce(sum(abs(size) * mid), 0) as gross from open_books b
      left join (select p.book_id, size, mid from fx_book_positions p join fx_markets m on p.coin = m.coin) p on p.book_id = b.book_id
      group by b.book_id, b.strategy, b.trader, b.cash, b.closed""",
    expo_="""select trader, coin, size * mid / trader_equity as x from fx_positions join fx_markets using (coin) join fx_trader_equity using (trader)
      where trader_equity > 0 and size * mid <> 0""",
    scales="select trader, least(1, 5 / sum(abs(x))) as scale from expo_ group by trader",
    targets="""select book_id, coin, x * scale * equity as target, scale from mark join scales using (trader) join expo_ using (trader) where equity > 0""",
)


def rounding(x: str) -> str:
    return f"case when sz_decimals is null then {x} else round_even({x} * pow(10, sz_decimals), 0) / pow(10, sz_decimals) end"


cte(
    gap0="""select book_id, coin, coalesce(target, 0) as target, coalesce(size, 0) as size, mid, sz_decimals
      from (select book_id, coin, target from targets) full join fx_book_positions using (book_id, coin) join fx_markets using (coin)""",
    gap1="select *, size * mid as cur, target - size * mid as gap, target = 0 and size * mid <> 0 as closing from gap0",
    gap2=f"""select *, case when closing then -size else {rounding('gap / mid')} end as delta from gap1
      where (closing or abs(gap) >= 10) and (closing or cur * target < 0 or abs(gap) > 0.1 * greatest(abs(target), abs(cur)))""",
    gaps="select book_id, coin, target, size as current, delta, mid from gap2 where delta <> 0 and (closing or abs(delta) * mid >= 10)",
)


def open_books(t):
    return t.fx_books.filter(~F.col("closed"))


def marked(t):
    return P.book_mark(open_books(t), t.fx_book_positions, t.fx_markets)


def targets(t):
    return P.copy_targets(marked(t), t.fx_positions, t.fx_trader_equity, t.fx_markets)


def gaps(t):
    return P.rebalance_gaps(targets(t), t.fx_book_positions, t.fx_markets)


@query("P5_copy_targets", "book_id coin ~target ~scale", "targets")
def _(t):
    return targets(t)


@query("P6_rebalance_gaps", "book_id coin ~target ~current ~delta", "gaps")
def _(t):
    return gaps(t)


@query("P7_unreplicable", "book_id coin ~target",
       f"(select book_id, coin, target from targets join fx_markets using (coin) where target <> 0 and "
       f"(abs(target) < 100 or {rounding('target / mid')} = 0))")
def _(t):
    return P.unreplicable(targets(t), t.fx_markets, 100.0)


cte(priced="""select g.*, case when delta > 0 then greatest(coalesce(impact_ask, m.mid * 1.0002), m.mid * 1.0002)
      else least(coalesce(impact_bid, m.mid * 0.9998), m.mid * 0.9998) end as price from gaps g join fx_markets m using (coin)""")


@query("P8_trade_cost", "book_id coin ~delta ~price ~fee ~slippage_usd ~cash_delta",
       "(select *, abs(delta) * price * 0.00045 as fee, abs(price - mid) * abs(delta) as slippage_usd, "
       "-(delta * price + abs(delta) * price * 0.00045) as cash_delta from priced)")
def _(t):
    return P.trade_cost(gaps(t), t.fx_markets)


@query("P9_funding_charges", "book_id coin ~payment hours",
       "(select book_id, coin, size * oracle * funding * 8 as payment, 8 as hours from fx_book_positions join fx_markets using (coin))")
def _(t):
    return P.funding_charges(t.fx_book_positions, t.fx_markets, 8)


@query("P10_book_mark", "book_id strategy trader ~cash ~equity ~gross", "mark")
def _(t):
    return marked(t)


@query("P11_strategy_equity", "strategy ~cash_pool ~equity ~gross ~leverage books",
       "(select s.strategy, cash_pool, cash_pool + coalesce(sum(m.equity), 0) as equity, coalesce(sum(m.gross), 0) as gross, "
       "coalesce(coalesce(sum(m.gross), 0) / nullif(cash_pool + coalesce(sum(m.equity), 0), 0), 0) as leverage, count(m.book_id) as books "
       "from fx_strategies s left join mark m on m.strategy = s.strategy group by s.strategy, cash_pool)")
def _(t):
    return P.strategy_equity(t.fx_strategies, marked(t))


cte(peaks="select *, max(equity) over (partition by strategy order by ts_ms) as peak from fx_strategy_equity",
    under="select *, 1 - equity / peak as drawdown from peaks where equity < peak * (1 - 0.15)")


@query("P12_drawdown_halts", "strategy ts_ms ~equity ~peak ~drawdown",
       "(select * from under qualify row_number() over (partition by strategy order by ts_ms) = 1)")
def _(t):
    return P.drawdown_halts(t.fx_strategy_equity, 0.15)


cte(
    day_eq="""select strategy, ts_ms // 86400000 * 86400000 as day_ms, arg_min(equity, ts_ms) as first_, arg_max(equity, ts_ms) as last_,
      arg_min(equity, ts_ms) filter (ts_ms % 86400000 = 0) as mid_ from fx_strategy_equity group by all""",
    day_base="""select *, coalesce(mid_, lag(last_) over (partition by strategy order by day_ms), first_) as base from day_eq""",
    paused_="""select b.strategy, b.day_ms, base, min(equity) as low, bool_or(equity < base * 0.95) as paused,
      coalesce(min(ts_ms) filter (equity < base * 0.95), -1) as paused_at_ms
      from fx_strategy_equity e join day_base b on b.strategy = e.strategy and b.day_ms = e.ts_ms // 86400000 * 86400000 group by all""",
)


@query("P13_daily_loss_pause", "strategy day_ms ~base ~low paused paused_at_ms", "paused_")
def _(t):
    return P.daily_loss_pause(t.fx_strategy_equity).fillna(-1, ["paused_at_ms"])


cte(
    plan_books="select strategy, trader, equity, book_id % 3 <> 0 as closable from mark",
    plan_w="""select strategy, trader, least(1 / count(*) over (partition by strategy), 0.3) as weight from fx_books where book_id % 5 <> 0""",
    plan_both="select * from plan_books full join plan_w using (strategy, trader)",
    plan_alloc="""select s.strategy, cash_pool + coalesce(sum(equity), 0) - coalesce(sum(equity) filter (weight is null and not closable), 0) as allocatable
      from fx_strategies s join plan_both b on b.strategy = s.strategy group by s.strategy, cash_pool""",
    plan_act="""select *, case when weight is null and not closable then 'stuck' when weight is null then 'close' when equity is null then 'open' else 'resize' end as action
      from plan_both join plan_alloc using (strategy)""",
    plan_out="select *, case when action = 'stuck' then equity else allocatable * coalesce(weight, 0) end as target_cash from plan_act",
)


@query("P14_rebalance_plan", "strategy trader action ~weight ~allocatable ~target_cash ~cash_delta",
       "(select *, target_cash - coalesce(equity, 0) as cash_delta from plan_out)")
def _(t):
    books = marked(t).select("strategy", "trader", "equity", (F.col("book_id") % 3 != 0).alias("closable"))
    kept = t.fx_books.filter(F.col("book_id") % 5 != 0)
    n = kept.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    weights = kept.join(n, "strategy").select("strategy", "trader", F.least(1 / F.col("n"), F.lit(0.3)).alias("weight"))
    return P.rebalance_plan(t.fx_strategies, books, weights)


cte(
    track0="""select book_id, ts_ms // 3600000 as h, max(ts_ms) as ts_ms, arg_max(equity, ts_ms) as equity, arg_max(trader_equity, ts_ms) as te,
      arg_max(trader_perp_pnl, ts_ms) as tp, arg_max(coalesce(leverage_scale, 1), ts_ms) as sc from fx_book_equity
      where trader_perp_pnl is not null and trader_equity > 0 and equity > 0 group by all""",
    track1="""select *, equity / lag(equity) over w - 1 as br, (tp - lag(tp) over w) / lag(te) over w as tr, lag(sc) over w as s from track0
      window w as (partition by book_id order by h)""",
    track2="""select book_id, count(br) as hours, product(coalesce(1 + br, 1)) - 1 as book_ret, product(coalesce(1 + tr, 1)) - 1 as trader_ret,
      product(coalesce(1 + tr * s, 1)) - 1 as target_ret, min(s) as min_scale, avg(br - tr * s) * 24 as gap_per_day, max(abs(br - tr * s)) as md,
      stddev_samp(br - tr * s) as tracking_error_hourly, min(ts_ms) as since_ms, max(ts_ms) as until_ms from track1 group by book_id having count(br) >= 2""",
    track="""select *, book_ret - target_ret as gap, md > 1e-9 or abs(trader_ret) > 1e-4 as active from track2 join fx_event_books using (book_id)""",
)


def tracking(t):
    return P.tracking_report(t.fx_book_equity, t.fx_event_books)


@query("P15_tracking_report", "strategy trader hours ~book_ret ~trader_ret ~target_ret ~gap active ~min_scale ~gap_per_day "
       "~tracking_error_hourly since_ms until_ms", "track")
def _(t):
    return tracking(t)


@query("P16_copying_cost", "books ~median_gap_per_day ~p25 ~p75 max_hours",
       "(select count(*) as books, median(gap_per_day) as median_gap_per_day, list_sort(list(gap_per_day))[count(*) // 4 + 1] as p25, "
       "list_sort(list(gap_per_day))[3 * count(*) // 4 + 1] as p75, max(hours) as max_hours from track where active)")
def _(t):
    return P.copying_cost(tracking(t))


cte(
    held_="""select strategy, coin, sum(size) as size, mid from fx_book_positions join open_books using (book_id) join fx_markets using (coin) group by all""",
    strat_eq="""select s.strategy, cash_pool + coalesce((select sum(cash) from open_books b where b.strategy = s.strategy), 0)
      + coalesce((select sum(size * mid) from held_ h where h.strategy = s.strategy), 0) as eq from fx_strategies s""",
    net="select strategy, coin, size, size * mid / eq as fraction from held_ join strat_eq using (strategy) where eq > 0 and size <> 0",
)


def exposure(t):
    return P.net_exposure(t.fx_strategies, open_books(t), t.fx_book_positions, t.fx_markets)


@query("P17_net_exposure", "strategy coin ~size ~fraction", "net")
def _(t):
    return exposure(t)


cte(
    guard0="select strategy, coin, fraction * 8000 as target from net",
    guard1="select *, sum(abs(target)) over (partition by strategy) as g from guard0",
    guard="select strategy, coin, case when g > 16000 then target * 16000 / g else target end as target from guard1",
    acct_pos="select strategy, coin, sum(size) / 20 as size from fx_book_positions join fx_books using (book_id) group by all",
    og0="""select strategy, coin, coalesce(target, 0) as target, coalesce(size, 0) as size, mid, sz_decimals
      from guard full join acct_pos using (strategy, coin) join fx_markets using (coin)""",
    og1="select *, size * mid as cur, target - size * mid as gap, target = 0 and size * mid <> 0 as closing from og0",
    og2=f"""select *, case when closing then -size else {rounding('gap / mid')} end as delta from og1
      where (closing or abs(gap) >= 10) and (closing or cur * target < 0 or abs(gap) > 0.1 * greatest(abs(target), abs(cur)))""",
    og3="select * from og2 where delta <> 0 and (closing or abs(delta) * mid >= 10)",
    orders_=f"""select strategy, coin, target, size as current, abs(delta) * mid > 500 as capped,
      abs(size + delta) < abs(size) and size * (size + delta) >= 0 as reduce_only,
      case when abs(delta) * mid > 500 then {rounding('500 / mid')} * sign(delta) else delta end as "order", mid from og3""",
)


@query("P18_guarded_targets", "strategy coin ~target ~current ~order capped reduce_only",
       '(select * from orders_ where "order" <> 0 and abs("order") * mid >= 10)')
def _(t):
    accounts = t.fx_strategies.select("strategy", F.lit(8000.0).alias("account_equity"))
    goal = P.guarded_targets(exposure(t), accounts, t.fx_markets)
    held = t.fx_book_positions.join(t.fx_books, "book_id").groupBy("strategy", "coin").agg((F.sum("size") / 20).alias("size"))
    return P.guarded_orders(goal, held, t.fx_markets)


cte(status_strats="""select distinct 's' || (user_id % 8)::varchar as strategy, 20000.0 as capital, 12000.0 as peak_equity,
      case when user_id % 8 = 5 then 'halted' else 'active' end as status from events""",
    status="""select s.*, coalesce(max(ts_ms), -1) as ts_ms, coalesce(arg_max(e.equity, ts_ms), capital) as equity,
      coalesce(arg_max(e.gross, ts_ms), 0) as gross, coalesce(arg_max(e.books, ts_ms), 0) as books from status_strats s
      left join fx_strategy_equity e using (strategy) group by s.strategy, capital, peak_equity, status""")


@query("P19_strategy_status", "strategy status ts_ms ~equity ~return ~drawdown ~leverage books",
       "(select *, equity / capital - 1 as \"return\", 1 - equity / peak_equity as drawdown, gross / equity as leverage from status)")
def _(t):
    s = t.table("events").select((F.col("user_id") % 8).alias("k")).distinct().select(
        F.concat(F.lit("s"), F.col("k").cast("string")).alias("strategy"), F.lit(20000.0).alias("capital"),
        F.lit(12000.0).alias("peak_equity"), F.when(F.col("k") == 5, "halted").otherwise("active").alias("status"))
    return P.strategy_status(s, t.fx_strategy_equity).fillna(-1, ["ts_ms"])


@query("P19_log_totals", "trades ~fees ~funding",
       "(select count(*) filter (kind = 'trade') as trades, sum(fee) filter (kind = 'trade') as fees, "
       "sum(cash_delta) filter (kind = 'funding') as funding from fx_log)")
def _(t):
    return P.log_totals(t.fx_log)


@query("P20_recent_events", "ts_ms strategy trader kind detail",
       "(select *  replace (json_extract_string(detail, '$.k') as detail) from fx_log where kind in ('halt', 'close_book', 'open_book') "
       "order by ts_ms desc, id desc limit 12)")
def _(t):
    return P.recent_events(t.fx_log, field="$.k")


CURVE_NOW = 1_706_659_200_000      # 2024-01-31


@query("P20_equity_curve", "strategy ts_ms ~equity",
       f"(select * from fx_strategy_equity where ts_ms >= {CURVE_NOW - 7 * DAY})")
def _(t):
    return P.equity_curve(t.fx_strategy_equity, CURVE_NOW)


cte(watch="""select b.book_id, b.strategy, b.trader, case when f.rule is not null then 'behavior: ' || f.rule
      when coalesce(trader_equity, 0) < 1000 then 'trader equity below minimum' end as reason
      from open_books b left join fx_trader_equity using (trader) left join flagged f using (trader)""")


@query("P21_book_target_watch", "book_id strategy trader reason", "(select * from watch where reason is not null)")
def _(t):
    return P.book_target_watch(open_books(t), t.fx_trader_equity, H.active_flags(t.fx_flags, FLAGS_SINCE))


# --- data quality ----------------------------------------------------------------------------------

cte(batches="""select user, time_ms // 2592000000 as batch, min(time_ms) as first_ms, max(time_ms) as last_ms from fx_fills group by all""",
    cursors="""select *, coalesce(max(last_ms) over (partition by user order by batch rows between unbounded preceding and 1 preceding), 0) as cursor_ms from batches""")


@query("Q1_fill_gaps", "user batch first_ms cursor_ms gap_suspected",
       "(select *, cursor_ms > 0 and first_ms > cursor_ms as gap_suspected from cursors)")
def _(t):
    month = F.floor(F.col("time_ms") / 2_592_000_000).cast("long")
    return Q.fill_gaps(t.fx_fills.withColumn("batch", month))


JOBS = {"trade": 2 * HOUR, "funding": HOUR, "halt": HOUR // 4, "never": HOUR}


@query("Q2_job_freshness", "job ~age_h level",
       f"(select job, ({CURVE_NOW} - max(ts_ms)) / 3600000 as age_h, case when {CURVE_NOW} - max(ts_ms) <= max_age then 'OK' else 'FAIL' end as level "
       f"from (values {', '.join(f'({j!r}, {a})' for j, a in JOBS.items())}) s(job, max_age) left join fx_log on kind = job group by job, max_age)")
def _(t):
    return Q.job_freshness(t.fx_log.select(F.col("kind").alias("job"), F.col("ts_ms").alias("finished_ms")), CURVE_NOW, JOBS)


@query("Q3_failure_rate", "run items failures gaps ~rate level gap_level",
       "(select ts_ms // 86400000 as run, count(*) as items, count(*) filter (kind = 'halt') as failures, count(*) filter (fee > 0.98) as gaps, "
       "count(*) filter (kind = 'halt') / count(*) as rate, case when count(*) filter (kind = 'halt') / count(*) <= 0.2 then 'OK' else 'FAIL' end as level, "
       "case when count(*) filter (fee > 0.98) > 0 then 'WARN' else 'OK' end as gap_level from fx_log group by all)")
def _(t):
    runs = t.fx_log.select(F.floor(F.col("ts_ms") / DAY).cast("long").alias("run"), (F.col("kind") == "halt").alias("failed"),
                           (F.col("fee") > 0.98).alias("gap_suspected"))
    return Q.failure_rate(runs, 0.2)


cte(seen="select strategy as source, kind as etag, ts_ms, lag(kind) over (partition by strategy order by ts_ms) as before from fx_log")


@query("Q4_version_changes", "source etag first_seen_ms",
       "(select source, etag, ts_ms as first_seen_ms from seen where before is null or before <> etag)")
def _(t):
    return Q.version_changes(t.fx_log.select(F.col("strategy").alias("source"), F.col("kind").alias("etag"), F.col("ts_ms").alias("seen_ms"), "id"),
                             ("id",))
