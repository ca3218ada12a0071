"""Behavior features from fills: round trips, leverage path, sizing, style, copyability.

One user may own a third of all fills, so the fills of a hot user are processed in slices of time: the
state before a slice comes from one summary row per earlier slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DAY_MS, HOUR_MS, ratio
from ..functions.ranks import ROWS_PER_GROUP, collected_quantiles, exact_quantiles, split_large
from ..functions.scan import BUCKET, ROWS_PER_BUCKET, SEED, affine_scan, asof, previous, split_hot
from ..session import shared
from .latest import dedup_fills

# How the source marks spot fills and fills that cross from long to short.
SPOT_DIRS = ("Buy", "Sell", "Spot Dust Conversion")
FLIP_DIRS = ("Long > Short", "Short > Long")
MAX_PLAUSIBLE_LEVERAGE = 50.0
EQUITY_TOLERANCE_MS = 15 * DAY_MS
RELATIVE_DUST = 1e-12
SUB_POLL_HOURS = 2 / 60
SHORT_TRADE_HOURS = 0.25
# (rule, feature, limit, closed trades needed to act on it)
EXIT_RULES = (("liquidated", "liquidations", 0.0, 1), ("leverage", "p95_leverage", 15.0, 1),
              ("martingale", "martingale_share", 0.6, 12), ("leverage_escalation", "change_leverage", 2.0, 10),
              ("size_escalation", "change_size", 3.0, 10))

ORDER = ("time_ms", "tid", "leg")

# What the features need of trades and exposure.
TRADE_COLUMNS = ("user", "coin", "opened_ms", "open_tid", "open_leg", "closed_ms", "n_fills", "n_adds", "n_adds_losing", "n_partial_exits",
                 "initial_notional", "max_notional", "liquidated", "pnl_net", "duration_h")
EXPOSURE_COLUMNS = ("user", "time_ms", "equity", "leverage")
# The columns of each part of the features.
TRADE_FEATURES = ("n_trades", "trades_per_day", "win_rate", "profit_factor", "avg_down_share", "adds_losing_share", "liquidations",
                  "best_trade_share", "worst_trade_pnl", "n_coins", "median_duration_h")
COIN_FEATURES = ("top_coin_share", "hhi")
SIZING_FEATURES = ("martingale_share", "post_loss_size_ratio", "post_win_size_ratio")
LEVERAGE_FEATURES = ("max_leverage", "leverage_unknown_share", "median_leverage", "p95_leverage")
STYLE_FEATURES = ("change_size", "change_duration", "change_leverage", "coin_overlap")
COPY_FEATURES = ("invisible_share", "short_trade_share", "median_fills_per_trade", "median_partial_exits", "copyability_estimate")


def leg_counts(fills: DataFrame) -> DataFrame:
    """At most how many rows `perp_fills` makes of these fills: (user, coin, `_rows`), two legs for each fill, copies and spot
    counted. Written once; needs users and coins only."""
    return shared(fills.groupBy("user", "coin").agg((2 * F.count(F.lit(1))).alias("_rows")))


def _ordinary(counts: DataFrame, rows: int = ROWS_PER_BUCKET) -> bool:
    """Whether no user is hot."""
    return counts.groupBy("user").agg(F.sum("_rows").alias("_n")).filter(F.col("_n") > rows).isEmpty()


def perp_by_user(fills: DataFrame, counts: DataFrame, parts: int | None = None, rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """`perp_fills` for what follows per user. Where no user is hot by `counts` (see `leg_counts`), a user's fills meet in
    one task (of `parts`): the deduplication, and round trips or gross notional of these fills, take one shuffle and
    nothing is written. Otherwise they are dealt out finely and written once, since hot users' slices are sorted from them."""
    return perp_fills(fills, whole_users=True, parts=parts) if _ordinary(counts, rows) else shared(perp_fills(fills))


def perp_fills(fills: DataFrame, unique: bool = False, since_ms: int | None = None, whole_users: bool = False,
               parts: int | None = None) -> DataFrame:
    """Deduplicated perp fills with signed sizes; a fill that crosses zero becomes a closing and an
    opening leg: fee split by size, realized PnL and a liquidation belong to the closing leg.
    Fills that are known to be `unique` are not deduplicated again. Of fills before `since_ms` only user, coin, time, tid and
    leg need be right: they are there to be counted."""
    f = fills if unique else dedup_fills(fills, since_ms, whole_users, parts)
    size, start = F.col("sz").cast("double"), F.col("start_position").cast("double")
    signed = F.when(F.col("side") == "B", size).otherwise(-size)
    f = (f.filter(~F.col("dir").isin(*SPOT_DIRS) & ~F.col("coin").contains("/") & ~F.col("coin").startswith("@"))
         .withColumn("_signed", signed).withColumn("_start", start).withColumn("_after", start + signed)
         .withColumn("_liq", F.coalesce(F.col("liquidated"), F.lit(False)) if "liquidated" in fills.columns else F.lit(False)))
    pnl, fee = F.col("closed_pnl").cast("double"), F.col("fee").cast("double")

    def leg(name, signed_sz, start_position, after, closed_pnl, fee_part, liquidated):
        return F.struct(F.lit(name).alias("leg"), signed_sz.alias("signed_sz"), start_position.alias("start_position"),
                        after.alias("position_after"), closed_pnl.alias("closed_pnl"), fee_part.alias("fee"),
                        liquidated.alias("liquidated"))

    s, st, af, zero = F.col("_signed"), F.col("_start"), F.col("_after"), F.lit(0.0)
    share = lambda part: fee * ratio(F.abs(part), F.abs(s))
    plain = leg("", s, st, af, pnl, fee, F.col("_liq"))
    closing = leg("close", -st, st, zero, pnl, share(st), F.col("_liq"))
    opening = leg("open", af, zero, af, zero, share(af), F.lit(False))
    legs = F.when(F.col("dir").isin(*FLIP_DIRS), F.array(closing, opening)).otherwise(F.array(plain))
    return f.withColumn("_l", F.explode(legs)).select(
        "user", "coin", "time_ms", F.col("px").cast("double").alias("px"), "_l.signed_sz", "_l.start_position",
        "_l.position_after", "_l.closed_pnl", "_l.fee", "_l.liquidated", "tid", "_l.leg")


def _marked(rows: DataFrame, here) -> DataFrame:
    """Fills with what the recurrence of the average entry needs: y = w * y + b. An add mixes its price in, a
    reduction changes nothing, an opening starts afresh (`_open_b`)."""
    start, after, px, size = F.col("start_position"), F.col("position_after"), F.col("px"), F.abs(F.col("signed_sz"))
    grows = F.abs(after) > F.abs(start)
    rows = rows.withColumn("_before", F.lag("position_after").over(here)).withColumn("_first", F.row_number().over(here) == 1)
    return (rows.withColumn("_opens", (start == 0) | F.coalesce(F.col("_before") == 0, F.lit(False)))
            .withColumn("_grows", grows)
            .withColumn("_w", F.when(grows, F.abs(start) / F.abs(after)).otherwise(1.0))
            .withColumn("_b", F.when(grows, px * size / F.abs(after)).otherwise(0.0))
            .withColumn("_open_b", F.when(grows, px * (F.abs(start) + size) / F.abs(after)).otherwise(px))
            .withColumn("_long", F.col("signed_sz") > 0))


def _opening() -> Column:
    return F.struct(*ORDER, F.col("_long").alias("long"))


# What a trade is made of, per fill.
TRIP_ROW = ("user", "coin", *ORDER, "px", "signed_sz", "start_position", "position_after", "closed_pnl", "fee", "liquidated",
            "_grows", "_opens", "_avg", "_avg_before", "_trade")


def _whole_trips(perp: DataFrame, keys: list[str]) -> DataFrame:
    """Fills of ordinary users with their trade and average entry: one sort, no join. A user's first fill opens."""
    here = Window.partitionBy(*keys).orderBy(*ORDER)
    rows = _marked(perp, here)
    rows = rows.withColumn("_opens", F.col("_opens") | F.col("_first"))
    rows = affine_scan(rows, keys, list(ORDER), F.when(F.col("_opens"), 0.0).otherwise(F.col("_w")),
                       F.when(F.col("_opens"), F.col("_open_b")).otherwise(F.col("_b")), "_avg")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_avg_before", F.lag("_avg").over(here)).withColumn(
        "_trade", F.last(F.when(F.col("_opens"), _opening()), ignorenulls=True).over(upto)).select(*TRIP_ROW)


def _sliced_trips(perp: DataFrame, keys: list[str]) -> DataFrame:
    """The same for hot users, whose fills come in slices: the recurrence is scanned inside each (user, coin, slice),
    and slices are chained through one summary row each."""
    order = list(ORDER)
    here = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    rows = _marked(perp, here)
    rows = rows.withColumn("_rw", F.when(F.col("_opens"), 0.0).otherwise(F.col("_w")))
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    # Product of the weights after the slice's first row: what is left of anything injected there.
    rows = rows.withColumn("_left", F.product(F.when(F.col("_first"), 1.0).otherwise(F.col("_rw"))).over(upto))
    rows = shared(affine_scan(rows, [*keys, BUCKET], order, F.col("_rw"),
                              F.when(F.col("_opens"), F.col("_open_b")).otherwise(F.col("_b")), "_own"))
    summary = rows.groupBy(*keys, BUCKET).agg(
        F.min_by(F.struct("_opens", "_w", "_b", "_open_b", _opening().alias("opening")), F.struct(*ORDER)).alias("f"),
        F.max_by(F.struct(F.col("position_after").alias("after"), F.col("_own").alias("own"), F.col("_left").alias("left")), F.struct(*ORDER)).alias("l"),
        F.max(F.when(F.col("_opens"), _opening())).alias("opening"))
    chain = Window.partitionBy(*keys).orderBy(BUCKET)
    ended = F.coalesce(F.lag("l.after").over(chain) == 0, F.lit(True))
    summary = summary.withColumn("_new", ~F.col("f._opens") & ended)
    summary = summary.withColumn("_W", F.when(F.col("_new") | F.col("f._opens"), 0.0).otherwise(F.col("f._w") * F.col("l.left")))
    summary = summary.withColumn("_B", F.col("l.own") + F.when(
        F.col("_new"), F.col("l.left") * (F.col("f._open_b") - F.col("f._b"))).otherwise(0.0))
    summary = affine_scan(summary, keys, [BUCKET], F.col("_W"), F.col("_B"), "_end")
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce("opening", F.when(F.col("_new"), F.col("f.opening")))
    carry = summary.withColumn("_opened", opened).select(
        *keys, BUCKET, "_new", F.lag("_end").over(chain).alias("_avg_in"),
        F.last("_opened", ignorenulls=True).over(earlier).alias("_trade_in"))
    rows = rows.join(carry, [*keys, BUCKET])
    inject = F.when(F.col("_new"), F.first(F.col("_open_b") - F.col("_b")).over(upto)).when(
        F.first("_opens").over(upto), 0.0).otherwise(F.first("_w").over(upto) * F.coalesce("_avg_in", F.lit(0.0)))
    rows = rows.withColumn("_opens", F.col("_opens") | (F.col("_first") & F.col("_new")))
    rows = rows.withColumn("_avg", F.col("_own") + F.col("_left") * inject).withColumn(
        "_trade", F.coalesce(F.last(F.when(F.col("_opens"), _opening()), ignorenulls=True).over(upto), F.col("_trade_in")))
    return rows.withColumn("_avg_before", F.when(F.col("_first"), F.col("_avg_in")).otherwise(F.lag("_avg").over(here))).select(*TRIP_ROW)


def round_trips(perp: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, counts: DataFrame | None = None) -> DataFrame:
    """One row per trade, from flat to flat (still open: closed_ms is null).

    Adds are compared with the average entry before them: an add at a worse price averages down. The
    average entry is a linear recurrence over the fills of a trade. `counts` (see `leg_counts`) spare computing the fills
    once more to count them."""
    return trips_of(*split_hot(perp, ["user", "coin"], ORDER, rows_per_bucket, counts))


def trips_of(cold: DataFrame, hot: DataFrame | None) -> DataFrame:
    """`round_trips` of fills that come as ordinary users' and hot ones' slices, as a stored layout by user has them."""
    keys = ["user", "coin"]
    rows = _whole_trips(cold, keys)
    if hot is not None:
        rows = rows.unionByName(_sliced_trips(hot, keys))
    start, after, px, size = F.col("start_position"), F.col("position_after"), F.col("px"), F.abs(F.col("signed_sz"))
    adds = F.col("_grows") & (start != 0)
    worse = ~F.col("_opens") & adds & F.when(F.col("_trade.long"), px < F.col("_avg_before")).otherwise(px > F.col("_avg_before"))
    out = rows.groupBy(*keys, F.col("_trade.time_ms").alias("opened_ms"), F.col("_trade.tid").alias("_tid"),
                       F.col("_trade.leg").alias("_leg"), F.col("_trade.long").alias("_is_long")).agg(
        F.max(F.when(after == 0, F.col("time_ms"))).alias("closed_ms"),
        F.count(F.lit(1)).alias("n_fills"), F.count_if(adds).alias("n_adds"), F.count_if(worse).alias("n_adds_losing"),
        F.count_if(~F.col("_grows") & (after != 0)).alias("n_partial_exits"),
        F.max(F.when(F.col("_opens"), size * px)).alias("initial_notional"),
        F.max(F.greatest(F.abs(after) * px, F.abs(start) * px)).alias("max_notional"),
        F.max_by("_avg", F.struct(*ORDER)).alias("avg_entry"), F.sum("closed_pnl").alias("realized_pnl"), F.sum("fee").alias("fees"),
        F.max("liquidated").alias("liquidated"))
    return out.select(
        "user", "coin", "opened_ms", "closed_ms", F.when(F.col("_is_long"), "long").otherwise("short").alias("side"),
        "n_fills", "n_adds", "n_adds_losing", "n_partial_exits", "initial_notional", "max_notional", "avg_entry",
        "realized_pnl", "fees", "liquidated", (F.col("realized_pnl") - F.col("fees")).alias("pnl_net"),
        ((F.col("closed_ms") - F.col("opened_ms")) / HOUR_MS).alias("duration_h"),
        F.col("_tid").alias("open_tid"), F.col("_leg").alias("open_leg"))


def equity_points(equity: DataFrame) -> DataFrame:
    """The finest account-value curve: every period's samples, one per (user, time)."""
    return equity.groupBy("user", "time_ms").agg(F.min("account_value").alias("equity"))


def _gross(rows: DataFrame, w_coin, w_user, first: Column) -> DataFrame:
    """Adds `gross`, a running sum of what each fill changes in its coin's notional, and `_peak`, the largest notional so far."""
    rows = rows.withColumn("_last", F.lag("x").over(w_coin))
    return rows.withColumn("_d", F.when(F.col(SEED) == 1, F.col("x") - F.coalesce("_last", F.lit(0.0))).otherwise(first)).select(
        "*", F.sum("_d").over(w_user).alias("gross"), F.max("x").over(w_user).alias("_peak"))


def gross_notional(perp: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, dust: float = RELATIVE_DUST,
                   counts: DataFrame | None = None) -> DataFrame:
    """Gross notional across coins after every fill: each position at its own last fill price.

    The gross is a running sum of changes per coin. Ordinary users take two windows over one shuffle; a slice of a hot
    user starts from what the coins were worth at the end of earlier slices. What a sum leaves below `dust` times the
    largest notional so far is rounding and counts as flat. With `counts`, fills are taken as `perp_by_user` deals them out."""
    order = list(ORDER)
    cold, hot = split_hot(perp.select("user", "coin", *order, (F.abs(F.col("position_after")) * F.col("px")).alias("x")),
                          ["user"], order, rows_per_bucket, counts)
    shown = ("user", *order, "gross", "_peak")
    upto = Window.unboundedPreceding, 0
    # One shuffle by user serves both windows; ordinary users' fills that `perp_by_user` deals out have had it.
    dealt = counts is not None and hot is None
    out = _gross((cold if dealt else cold.repartition("user")).withColumn(SEED, F.lit(1)), Window.partitionBy("user", "coin").orderBy(*order),
                 Window.partitionBy("user").orderBy(*order).rowsBetween(*upto), F.lit(0.0)).select(*shown)
    if hot is not None:
        per = hot.groupBy("user", "coin", BUCKET).agg(F.max_by("x", F.struct(*order)).alias("x"), F.max("x").alias("top"))
        before = F.lag("x").over(Window.partitionBy("user", "coin").orderBy(BUCKET))
        per = per.withColumn("x_in", before)
        total = per.groupBy("user", BUCKET).agg(F.sum(F.col("x") - F.coalesce("x_in", F.lit(0.0))).alias("d"), F.max("top").alias("top"))
        earlier = Window.partitionBy("user").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        coin_seeds = per.filter(F.col("x_in").isNotNull()).select("user", "coin", BUCKET, F.lit(0).alias(SEED), F.col("x_in").alias("x"))
        user_seeds = total.select("user", BUCKET, F.lit(0).alias(SEED), F.coalesce(F.sum("d").over(earlier), F.lit(0.0)).alias("gross_in"),
                                  F.max("top").over(earlier).alias("x"))
        rows = (hot.withColumn(SEED, F.lit(1)).unionByName(coin_seeds, allowMissingColumns=True)
                .unionByName(user_seeds, allowMissingColumns=True).repartition("user", BUCKET))
        rows = _gross(rows, Window.partitionBy("user", BUCKET, "coin").orderBy(SEED, *order),
                      Window.partitionBy("user", BUCKET).orderBy(SEED, *order).rowsBetween(*upto), F.coalesce("gross_in", F.lit(0.0)))
        out = out.unionByName(rows.filter(F.col(SEED) == 1).select(*shown))
    flat = F.abs("gross") <= F.lit(dust) * F.col("_peak")
    return out.select("user", *order, F.when(flat, 0.0).otherwise(F.col("gross")).alias("gross"))


def gross_exposure(perp: DataFrame, equity: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, since_ms: int | None = None,
                   counts: DataFrame | None = None) -> DataFrame:
    """Gross notional with the equity of that moment. Equity is the sample at or before the fill; if
    that is over a day old (or missing) the larger of it and the next sample. Leverage is null when
    equity is not positive or the leverage is impossible.

    Where all fills are of `since_ms` or later, samples out of their reach are left out. With `counts` (see `leg_counts`), fills
    are taken as `perp_by_user` deals them out, and of ordinary users they are not shuffled to meet the equity."""
    points = equity_points(equity)
    if since_ms is not None:
        points = points.filter(F.col("time_ms") >= since_ms - EQUITY_TOLERANCE_MS)
    points = shared(points)
    gross = gross_notional(perp, rows_per_bucket, counts=counts)
    known = points.filter(F.col("time_ms").isNotNull())
    if counts is None:
        counted = perp.select("user").unionByName(known.select("user"))
    else:
        counted = counts.select("user", "_rows").unionByName(known.groupBy("user").agg(F.count(F.lit(1)).alias("_rows")))
        if _ordinary(counted, rows_per_bucket):
            points = points.repartition("user")
        else:
            gross = shared(gross)
    both = asof(gross, points, ["user"], "time_ms", "time_ms", ["equity"],
                {"backward": "b_", "forward": "f_"}, EQUITY_TOLERANCE_MS, rows_per_bucket, counted=counted)
    stale = F.col("b_equity").isNull() | (F.col("time_ms") - F.col("b_time_ms") > DAY_MS)
    used = F.when(stale, F.greatest("b_equity", "f_equity")).otherwise(F.col("b_equity"))
    rows = both.withColumn("equity", used)
    lev = F.when(F.col("equity") > 0, F.col("gross") / F.col("equity"))
    return rows.select("user", "time_ms", "tid", "leg", "gross", "equity",
                       F.when(lev <= MAX_PLAUSIBLE_LEVERAGE, lev).alias("leverage"))


# --- features -------------------------------------------------------------------------------------

def medians_by_user(df: DataFrame, values: dict[str, Column], nearest: dict[str, float] | None = None,
                    by: Sequence[str] = ("user",), rows: int = ROWS_PER_GROUP) -> DataFrame:
    """Exact medians (and nearest-rank quantiles named "<value>_<name>") of several columns per user in one pass. The values
    of ordinary users are sorted in memory, those of users with over `rows` rows spread over a grid."""
    by = list(by)
    small, large = split_large(df, by, rows)
    out = collected_quantiles(small, by, values, nearest)
    if large is None:
        return out
    long = large.select(*by, F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), v.cast("double").alias("v")) for n, v in values.items()])).alias("p")).select(
        *by, "p.metric", "p.v")
    q = exact_quantiles(long, [*by, "metric"], "v", nearest=nearest)
    return out.unionByName(q.groupBy(*by).agg(
        *[F.max(F.when(F.col("metric") == n, F.col("median"))).alias(n) for n in values],
        *[F.max(F.when(F.col("metric") == n, F.col(c))).alias(f"{n}_{c}") for c in (nearest or {}) for n in values]))


def _closed(trades: DataFrame) -> DataFrame:
    return trades.filter(F.col("closed_ms").isNotNull())


def _share(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).when(~cond, 0.0))


def trade_features(trades: DataFrame, window_ms: int) -> DataFrame:
    """Counts, win rate, profit factor and loss habits of closed trades per user."""
    closed = _closed(trades)
    pnl, adds, losing = F.col("pnl_net"), F.sum("n_adds"), F.sum("n_adds_losing")
    wins, losses = F.sum(F.greatest(pnl, F.lit(0.0))), F.sum(F.greatest(-pnl, F.lit(0.0)))
    # Distinct coins are counted on top of (user, coin) pairs combined on the map side.
    per = closed.groupBy("user").agg(
        F.count(F.lit(1)).alias("n_trades"), (F.count(F.lit(1)) / (window_ms / DAY_MS)).alias("trades_per_day"),
        _share(pnl > 0).alias("win_rate"), F.when(losses > 0, wins / losses).alias("profit_factor"),
        _share(F.col("n_adds_losing") > 0).alias("avg_down_share"),
        F.when(adds > 0, losing / adds).alias("adds_losing_share"), F.count_if("liquidated").alias("liquidations"),
        F.when(wins > 0, F.max(pnl) / wins).alias("best_trade_share"), F.min(pnl).alias("worst_trade_pnl"))
    coins = closed.groupBy("user", "coin").agg(F.lit(1).alias("_x")).groupBy("user").agg(F.count(F.lit(1)).alias("n_coins"))
    med = medians_by_user(closed, {"median_duration_h": F.col("duration_h")})
    return per.join(coins, "user").join(med, "user", "left")


def coin_concentration(trades: DataFrame) -> DataFrame:
    """Share of the most traded coin and Herfindahl index of traded notional (open trades included)."""
    by_coin = trades.groupBy("user", "coin").agg(F.sum("max_notional").alias("n"))
    total = F.sum("n")
    return by_coin.groupBy("user").agg(ratio(F.max("n"), total).alias("top_coin_share"),
                                       ratio(F.sum(F.col("n") * F.col("n")), total * total).alias("hhi"))


def size_sequence(trades: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Each closed trade with the size ratio to the user's previous closed trade and that one's PnL."""
    order = ["opened_ms", "coin", "open_tid", "open_leg"]
    seq = previous(_closed(trades).select("user", *order, "pnl_net", "initial_notional"), ["user"], order,
                   {"prev_pnl": F.col("pnl_net"), "prev_notional": F.col("initial_notional")}, rows_per_bucket)
    return seq.filter(F.col("prev_notional") > 0).withColumn("ratio", F.col("initial_notional") / F.col("prev_notional"))


def martingale(trades: DataFrame) -> DataFrame:
    """Sizing after losses: median size ratios after a loss / a win, share of at least 1.5x after a loss."""
    seq = shared(size_sequence(trades).select("user", "prev_pnl", "ratio"))
    lost = F.col("prev_pnl") < 0
    share = seq.groupBy("user").agg(_share(F.when(lost, F.col("ratio")) >= 1.5).alias("martingale_share"))
    med = medians_by_user(seq, {"post_loss_size_ratio": F.when(lost, F.col("ratio")),
                                "post_win_size_ratio": F.when(~lost, F.col("ratio"))})
    return share.join(med, "user", "left")


def leverage_stats(exposure: DataFrame) -> DataFrame:
    """Median, 95th percentile (nearest rank) and maximum leverage, share of unknown leverage."""
    per = exposure.groupBy("user").agg(F.max("leverage").alias("max_leverage"),
                                       _share(F.col("leverage").isNull()).alias("leverage_unknown_share"))
    q = medians_by_user(exposure, {"leverage": F.col("leverage")}, {"p95": 0.95})
    return per.join(q.select("user", F.col("leverage").alias("median_leverage"), F.col("leverage_p95").alias("p95_leverage")), "user", "left")


def _growth(now: Column, prior: Column) -> Column:
    """now / prior where a rise from zero is infinite (it must trip the escalation rules)."""
    return F.when((prior == 0) & (now > 0), F.lit(float("inf"))).otherwise(ratio(now, prior))


def style_change(trades: DataFrame, exposure: DataFrame, now_ms: int, recent_days: int = 30) -> DataFrame:
    """Last `recent_days` against the rest of the window: ratios of median relative size, duration and
    leverage, and the overlap of the coins traded."""
    cut = now_ms - recent_days * DAY_MS
    # All fills of a user's instant have the same equity.
    at_open = exposure.groupBy("user", F.col("time_ms").alias("opened_ms")).agg(F.max("equity").alias("_eq"))
    t = shared(trades.select("user", "coin", "opened_ms", "initial_notional", "duration_h").join(
        at_open, ["user", "opened_ms"], "left").select(
        "user", "coin", "duration_h", (F.col("opened_ms") >= cut).alias("recent"),
        F.when(F.col("_eq") > 0, F.col("initial_notional") / F.col("_eq")).alias("size")))
    med = medians_by_user(t, {"size": F.col("size"), "duration": F.col("duration_h")}, by=("user", "recent"))
    lev = medians_by_user(exposure.select("user", (F.col("time_ms") >= cut).alias("recent"), "leverage"), {"lev": F.col("leverage")},
                          by=("user", "recent"))
    per = (t.select("user", "recent").distinct().join(med, ["user", "recent"], "left").join(lev, ["user", "recent"], "left"))
    part = lambda c, r: F.max(F.when(F.col("recent") == r, F.col(c)))
    sides = per.groupBy("user").agg(
        F.count(F.lit(1)).alias("_sides"),
        *[part(c, r).alias(f"{c}_{'now' if r else 'old'}") for c in ("size", "duration", "lev") for r in (True, False)])
    coins = t.groupBy("user", "coin").agg(F.max("recent").alias("in_now"), F.min("recent").alias("all_now"))
    overlap = coins.groupBy("user").agg(
        (F.count_if(F.col("in_now") & ~F.col("all_now")) / F.count(F.lit(1))).alias("coin_overlap"))
    grow = lambda c: _growth(F.col(f"{c}_now"), F.col(f"{c}_old")).alias(
        {"size": "change_size", "duration": "change_duration", "lev": "change_leverage"}[c])
    return (sides.filter(F.col("_sides") == 2).join(overlap, "user")
            .select("user", grow("size"), grow("duration"), grow("lev"), "coin_overlap"))


def copyability(trades: DataFrame) -> DataFrame:
    """How much of a user's trading a 60-second poll can reproduce, 0 to 100."""
    closed = _closed(trades)
    per = closed.groupBy("user").agg(_share(F.col("duration_h") < SUB_POLL_HOURS).alias("invisible_share"),
                                     _share(F.col("duration_h") < SHORT_TRADE_HOURS).alias("short_trade_share"))
    med = medians_by_user(closed, {"median_fills_per_trade": F.col("n_fills"), "median_partial_exits": F.col("n_partial_exits")})
    estimate = (100 * (1 - F.col("invisible_share")) * (1 - 0.5 * F.col("short_trade_share"))
                / (1 + 0.1 * F.col("median_partial_exits")))
    return per.join(med, "user", "left").withColumn("copyability_estimate", estimate)


def behavior_features(fills: DataFrame, equity: DataFrame, now_ms: int, window_days: int = 90,
                      recent_days: int = 30, unique: bool = False, wanted: Sequence[str] | None = None) -> DataFrame:
    """One row per user with every behavior feature over the last `window_days`, or at least those in `wanted`.

    Trades belong to the window by their opening fill; open trades count in activity only. Fills before the window are
    only counted, so nothing but their user and time is stored."""
    start_ms = now_ms - window_days * DAY_MS
    inside = F.col("time_ms") >= start_ms
    perp = perp_fills(fills, unique, start_ms)
    perp = shared(perp.select("user", "time_ms", *[F.when(inside, F.col(c)).alias(c) for c in perp.columns if c not in ("user", "time_ms")],
                              F.when(inside, 1).otherwise(0).alias("_in")), ["_in"])
    cover = perp.groupBy("user").agg(
        F.min("time_ms").alias("first_fill_ms"), F.count(F.lit(1)).alias("fills_total"),
        F.sum("_in").alias("_n"), F.count_if((F.col("_in") == 1) & F.col("liquidated")).alias("liquidation_fills"))
    cover = cover.filter(F.col("_n") > 0).withColumn("fills_per_day", F.col("_n") / window_days).drop("_n")
    window = perp.filter(F.col("_in") == 1).drop("_in")
    trades = shared(round_trips(window).select(*TRADE_COLUMNS))
    exposed = wanted is None or not {*LEVERAGE_FEATURES, *STYLE_FEATURES}.isdisjoint(wanted)
    exposure = shared(gross_exposure(window, equity, since_ms=start_ms).select(*EXPOSURE_COLUMNS)) if exposed else None
    parts = ((TRADE_FEATURES, lambda: trade_features(trades, window_days * DAY_MS)), (COIN_FEATURES, lambda: coin_concentration(trades)),
             (SIZING_FEATURES, lambda: martingale(trades)), (LEVERAGE_FEATURES, lambda: leverage_stats(exposure)),
             (STYLE_FEATURES, lambda: style_change(trades, exposure, now_ms, recent_days)), (COPY_FEATURES, lambda: copyability(trades)))
    out = cover
    for names, part in parts:
        if wanted is None or not set(names).isdisjoint(wanted):
            out = out.join(part(), "user", "left")
    return out.withColumn("window_complete", F.col("first_fill_ms") < start_ms)


def exit_rules(features: DataFrame, rules: Sequence[tuple] = EXIT_RULES) -> DataFrame:
    """One row per (user, rule) whose feature exceeds its limit; actionable with enough closed trades."""
    hits = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("feature"), F.col(column).cast("double").alias("value"),
                 F.lit(float(limit)).alias("limit"), F.lit(least).alias("least"))
        for rule, column, limit, least in rules if column in features.columns]))
    n = F.coalesce("n_trades", F.lit(0)).cast("long")
    return (features.select(F.col("user").alias("trader"), n.alias("n_trades"), hits.alias("h"))
            .filter(F.col("h.value") > F.col("h.limit"))
            .select("trader", "h.rule", "h.feature", "h.value", "h.limit", "n_trades",
                    (F.col("n_trades") >= F.col("h.least")).alias("actionable")))


def active_flags(flags: DataFrame, since_ms: int) -> DataFrame:
    """The latest actionable rule per trader raised since a time; `watch:` observations do not block."""
    live = flags.filter((F.col("ts_ms") >= since_ms) & ~F.col("rule").startswith("watch:"))
    return live.groupBy("trader").agg(F.max(F.struct("ts_ms", "rule")).alias("m")).select("trader", F.col("m.rule").alias("rule"))
