"""Copy accounting over tables of books, positions and markets; equity curves, limits and reports.

Markets are one row per listed coin; Spark decides by size whether to broadcast them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DAY_MS, HOUR_MS, day_ms, ratio, round_even
from ..functions.ranks import exact_quantiles, top_n
from ..functions.scan import running_max
from ..session import shared
from .latest import last_in_bucket

# Fixed values
TAKER_FEE = 0.00045
MIN_SLIPPAGE = 0.0002
REBALANCE_BAND = 0.10
MIN_TRADE_USD = 10.0
MIN_ORDER_USD = 10.0
MAX_LEVERAGE = 5.0
HALT_DRAWDOWN = 0.30
DAILY_LOSS_PAUSE = 0.05
MIN_BOOK_TRADER_EQUITY = 1_000.0
MAX_GROSS_LEVERAGE = 2.0
MAX_ORDER_USD = 500.0


def _lot(size: Column) -> Column:
    return round_even(size, F.col("sz_decimals"))


def book_mark(books: DataFrame, positions: DataFrame, markets: DataFrame) -> DataFrame:
    """Equity (cash + size x mid over priced coins) and gross notional per book."""
    value = positions.join(markets.select("coin", "mid"), "coin").groupBy("book_id").agg(
        F.sum(F.col("size") * F.col("mid")).alias("v"), F.sum(F.abs("size") * F.col("mid")).alias("g"))
    return books.join(value, "book_id", "left").select(
        *[books[c] for c in books.columns], (F.col("cash") + F.coalesce("v", F.lit(0.0))).alias("equity"),
        F.coalesce("g", F.lit(0.0)).alias("gross"))


def copy_targets(marked: DataFrame, trader_positions: DataFrame, trader_equity: DataFrame, markets: DataFrame,
                 max_leverage: float = MAX_LEVERAGE) -> DataFrame:
    """Target notional per (book, coin): the trader's exposure as a share of their equity times the
    book's equity, shrunk to the leverage cap. Nothing where either equity is not positive.

    marked: book_id, trader, equity. trader_positions: trader, coin, size."""
    exposure = (trader_positions.join(markets.select("coin", "mid"), "coin").join(trader_equity, "trader")
                .filter((F.col("trader_equity") > 0) & (F.col("size") * F.col("mid") != 0))
                .select("trader", "coin", (F.col("size") * F.col("mid") / F.col("trader_equity")).alias("x")))
    gross = exposure.groupBy("trader").agg(F.sum(F.abs("x")).alias("lev"))
    scale = F.least(F.lit(1.0), F.lit(max_leverage) / F.col("lev"))
    books = marked.filter(F.col("equity") > 0).select("book_id", "trader", F.col("equity").alias("book_equity"))
    return (books.join(gross, "trader").withColumn("scale", scale).join(exposure, "trader")
            .select("book_id", "coin", (F.col("x") * F.col("scale") * F.col("book_equity")).alias("target"), "scale"))


def rebalance_gaps(targets: DataFrame, positions: DataFrame, markets: DataFrame, key: str = "book_id",
                   band: float = REBALANCE_BAND, min_trade: float = MIN_TRADE_USD,
                   min_order: float = MIN_ORDER_USD) -> DataFrame:
    """Trades worth making: closing, changing side, or a gap above both the band and the minimum.
    Sizes are rounded to lots; small orders are skipped except closes; unpriced coins stay as they are."""
    both = targets.select(key, "coin", "target").join(positions.select(key, "coin", "size"), [key, "coin"], "full_outer")
    rows = both.join(markets.select("coin", "mid", "sz_decimals"), "coin").withColumn(
        "size", F.coalesce("size", F.lit(0.0))).withColumn("target", F.coalesce("target", F.lit(0.0)))
    current = F.col("size") * F.col("mid")
    gap = F.col("target") - current
    closing = (F.col("target") == 0) & (current != 0)
    flipping = current * F.col("target") < 0
    wide = F.abs(gap) > band * F.greatest(F.abs("target"), F.abs(current))
    rows = rows.filter((closing | (F.abs(gap) >= min_trade)) & (closing | flipping | wide))
    delta = F.when(closing, -F.col("size")).otherwise(_lot(gap / F.col("mid")))
    rows = rows.withColumn("closing", closing).withColumn("delta", delta)
    rows = rows.filter((F.col("delta") != 0) & (F.col("closing") | (F.abs("delta") * F.col("mid") >= min_order)))
    return rows.select(key, "coin", "target", F.col("size").alias("current"), "delta", "mid")


def unreplicable(targets: DataFrame, markets: DataFrame, min_order: float = MIN_ORDER_USD) -> DataFrame:
    """Targets that the order minimum or the lot size make impossible to hold."""
    rows = targets.join(markets.select("coin", "mid", "sz_decimals"), "coin").filter(F.col("target") != 0)
    return rows.filter((F.abs("target") < min_order) | (_lot(F.col("target") / F.col("mid")) == 0)).select(
        "book_id", "coin", "target")


def trade_cost(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Fill price (impact price, never better than the mid plus slippage), fee, slippage and cash effect
    of each trade (coin, delta)."""
    m = markets.select("coin", F.col("mid").alias("_mid"), "impact_bid", "impact_ask")
    buy = F.col("delta") > 0
    ask, bid = F.col("_mid") * (1 + MIN_SLIPPAGE), F.col("_mid") * (1 - MIN_SLIPPAGE)
    price = F.when(buy, F.greatest(F.coalesce("impact_ask", ask), ask)).otherwise(F.least(F.coalesce("impact_bid", bid), bid))
    rows = trades.join(m, "coin").withColumn("price", price)
    fee = F.abs("delta") * F.col("price") * TAKER_FEE
    return rows.select(*[F.col(c) for c in trades.columns], "price", fee.alias("fee"),
                       (F.abs(F.col("price") - F.col("_mid")) * F.abs("delta")).alias("slippage_usd"),
                       (-(F.col("delta") * F.col("price") + fee)).alias("cash_delta"))


def funding_charges(positions: DataFrame, markets: DataFrame, hours: int | Column = 1) -> DataFrame:
    """Funding per (book, coin): size x oracle price x hourly rate x hours; positive = the book pays."""
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return positions.join(markets.select("coin", "oracle", "funding"), "coin").select(
        "book_id", "coin", (F.col("size") * F.col("oracle") * F.col("funding") * hours).alias("payment"),
        hours.cast("long").alias("hours"))


def strategy_equity(strategies: DataFrame, marked: DataFrame) -> DataFrame:
    """Cash pool plus the equity of the open books, gross, leverage and number of books per strategy."""
    per = marked.groupBy("strategy").agg(F.sum("equity").alias("e"), F.sum("gross").alias("g"), F.count(F.lit(1)).alias("n"))
    equity = F.col("cash_pool") + F.coalesce("e", F.lit(0.0))
    gross = F.coalesce("g", F.lit(0.0))
    return strategies.select("strategy", "cash_pool").join(per, "strategy", "left").select(
        "strategy", "cash_pool", equity.alias("equity"), gross.alias("gross"),
        F.coalesce(ratio(gross, equity), F.lit(0.0)).alias("leverage"), F.coalesce("n", F.lit(0)).cast("long").alias("books"))


def drawdown_halts(snapshots: DataFrame, halt_drawdown: float = HALT_DRAWDOWN) -> DataFrame:
    """First snapshot per strategy that lies more than the limit under the running peak.

    Peaks of a long history are chained slice by slice, never sorted in one task."""
    peaks = running_max(snapshots, ["strategy"], ["ts_ms"], {"peak": F.col("equity")})
    under = peaks.filter(F.col("equity") < F.col("peak") * (1 - halt_drawdown))
    return under.groupBy("strategy").agg(F.min(F.struct("ts_ms", "equity", "peak")).alias("f")).select(
        "strategy", "f.ts_ms", "f.equity", "f.peak", (1 - ratio(F.col("f.equity"), F.col("f.peak"))).alias("drawdown"))


def daily_loss_pause(snapshots: DataFrame, limit: float = DAILY_LOSS_PAUSE) -> DataFrame:
    """Per (strategy, UTC day): the equity at the day's start and the first snapshot that lost more than
    the limit. The start is the last snapshot at or before midnight, else the day's first."""
    rows = snapshots.select("strategy", "ts_ms", "equity", day_ms(F.col("ts_ms")).alias("day_ms"))
    per = rows.groupBy("strategy", "day_ms").agg(
        F.max_by("equity", "ts_ms").alias("last"), F.min(F.struct("ts_ms", "equity")).alias("first"))
    before = F.lag("last").over(Window.partitionBy("strategy").orderBy("day_ms"))
    at_midnight = F.when(F.col("first.ts_ms") == F.col("day_ms"), F.col("first.equity"))
    base = per.select("strategy", "day_ms", F.coalesce(at_midnight, before, F.col("first.equity")).alias("base"))
    lost = F.col("equity") < F.col("base") * (1 - limit)
    return rows.join(base, ["strategy", "day_ms"]).groupBy("strategy", "day_ms").agg(
        F.max("base").alias("base"), F.min("equity").alias("low"), F.max(lost).alias("paused"),
        F.min(F.when(lost, F.col("ts_ms"))).alias("paused_at_ms"))


def rebalance_plan(strategies: DataFrame, marked: DataFrame, weights: DataFrame) -> DataFrame:
    """What a rebalance does with every book: close dropped ones, resize kept ones, open new ones.

    marked: strategy, trader, equity, closable. weights: strategy, trader, weight. Books that cannot be
    closed keep their equity, which is not allocated again."""
    both = marked.select("strategy", "trader", "equity", "closable").join(weights, ["strategy", "trader"], "full_outer")
    stuck = F.col("weight").isNull() & ~F.col("closable")
    sums = both.groupBy("strategy").agg(F.sum("equity").alias("e"), F.sum(F.when(stuck, F.col("equity"))).alias("left"))
    total = F.col("cash_pool") + F.coalesce("e", F.lit(0.0)) - F.coalesce("left", F.lit(0.0))
    alloc = strategies.join(sums, "strategy").select("strategy", total.alias("allocatable"))
    action = (F.when(stuck, "stuck").when(F.col("weight").isNull(), "close")
              .when(F.col("equity").isNull(), "open").otherwise("resize"))
    target = F.when(action == "stuck", F.col("equity")).otherwise(F.col("allocatable") * F.coalesce("weight", F.lit(0.0)))
    return both.join(alloc, "strategy").select(
        "strategy", "trader", action.alias("action"), "weight", "equity", "allocatable", target.alias("target_cash"),
        (target - F.coalesce("equity", F.lit(0.0))).alias("cash_delta"))


def tracking_report(book_equity: DataFrame, books: DataFrame) -> DataFrame:
    """Cost of mirroring per book from hourly steps: compounded book, trader and target returns, their
    gap, the hourly tracking error. Books with three clean hours or more.

    Snapshots are reduced to the last of each hour before the per-book windows."""
    clean = book_equity.filter(F.col("trader_perp_pnl").isNotNull() & (F.col("trader_equity") > 0) & (F.col("equity") > 0))
    clean = clean.withColumn("scale", F.coalesce("leverage_scale", F.lit(1.0)))
    hourly = last_in_bucket(clean, ["book_id"], "ts_ms", ["equity", "trader_equity", "trader_perp_pnl", "scale"],
                            bucket_name="hour_ms", bucket_width_ms=HOUR_MS)
    w = Window.partitionBy("book_id").orderBy("hour_ms")
    prev = lambda c: F.lag(c).over(w)
    book = ratio(F.col("equity"), prev("equity")) - 1
    trader = ratio(F.col("trader_perp_pnl") - prev("trader_perp_pnl"), prev("trader_equity"))
    steps = hourly.select("book_id", "ts_ms", book.alias("book"), trader.alias("trader"), prev("scale").alias("s"))
    steps = steps.withColumn("goal", F.col("trader") * F.col("s")).withColumn("diff", F.col("book") - F.col("goal"))
    grow = lambda c: F.product(F.coalesce(1 + F.col(c), F.lit(1.0))) - 1
    out = steps.groupBy("book_id").agg(
        F.count("diff").alias("hours"), grow("book").alias("book_ret"), grow("trader").alias("trader_ret"),
        grow("goal").alias("target_ret"), F.max(F.abs("diff")).alias("_d"), F.min("s").alias("min_scale"),
        (F.avg("diff") * 24).alias("gap_per_day"), F.stddev_samp("diff").alias("tracking_error_hourly"),
        F.min("ts_ms").alias("since_ms"), F.max("ts_ms").alias("until_ms"))
    return out.filter(F.col("hours") >= 2).join(books.select("book_id", "strategy", "trader"), "book_id").select(
        "strategy", "trader", "hours", "book_ret", "trader_ret", "target_ret",
        (F.col("book_ret") - F.col("target_ret")).alias("gap"),
        ((F.col("_d") > 1e-9) | (F.abs("trader_ret") > 1e-4)).alias("active"), "min_scale", "gap_per_day",
        "tracking_error_hourly", "since_ms", "until_ms")


def copying_cost(report: DataFrame) -> DataFrame:
    """Median and quartile gaps per day over active books. Quartiles are the values at 0-based index
    n div 4 and 3 n div 4 of the sorted gaps."""
    active = shared(report.filter("active").withColumn("all", F.lit("all")))
    med = exact_quantiles(active, ["all"], "gap_per_day", medians="median_gap_per_day", size="books")
    quart = _at_index(active, "gap_per_day", {"p25": 1, "p75": 3})
    hours = active.groupBy("all").agg(F.max("hours").alias("max_hours"))
    return med.join(quart, "all").join(hours, "all").select("books", "median_gap_per_day", "p25", "p75", "max_hours")


def _at_index(df: DataFrame, value: str, quarters: dict[str, int]) -> DataFrame:
    """Values at 0-based index (q n) div 4 of the sorted values of each group in `all`."""
    from ..functions.ranks import _cumulative, value_counts
    cum = _cumulative(value_counts(df, ["all"], value), ["all"], value)
    at = lambda q: F.floor(F.col("_n") * q / 4) + 1
    covers = lambda q: (F.col("_cum") >= at(q)) & (F.col("_cum") - F.col("_c") < at(q))
    return cum.groupBy("all").agg(*[F.max(F.when(covers(q), F.col(value))).alias(n) for n, q in quarters.items()])


def net_exposure(strategies: DataFrame, books: DataFrame, positions: DataFrame, markets: DataFrame) -> DataFrame:
    """Signed notional per (strategy, coin) over open books as a share of the strategy's equity."""
    open_books = books.select("book_id", "strategy", "cash")
    held = positions.join(open_books.select("book_id", "strategy"), "book_id").groupBy("strategy", "coin").agg(
        F.sum("size").alias("size")).join(markets.select("coin", "mid"), "coin")
    cash = open_books.groupBy("strategy").agg(F.sum("cash").alias("c"))
    value = held.groupBy("strategy").agg(F.sum(F.col("size") * F.col("mid")).alias("v"))
    equity = strategies.join(cash, "strategy", "left").join(value, "strategy", "left").select(
        "strategy", (F.col("cash_pool") + F.coalesce("c", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))).alias("equity"))
    return held.filter(F.col("size") != 0).join(equity.filter(F.col("equity") > 0), "strategy").select(
        "strategy", "coin", "size", (F.col("size") * F.col("mid") / F.col("equity")).alias("fraction"))


def guarded_targets(exposure: DataFrame, accounts: DataFrame, markets: DataFrame, main_dex_only: bool = True,
                    max_gross_leverage: float = MAX_GROSS_LEVERAGE) -> DataFrame:
    """Exposure scaled to a real account: coins of other venues dropped, gross capped.

    exposure: strategy, coin, fraction. accounts: strategy, account_equity."""
    rows = exposure.join(markets.select("coin"), "coin", "left_semi")
    if main_dex_only:
        rows = rows.filter(~F.col("coin").contains(":"))
    rows = rows.join(accounts, "strategy").withColumn("target", F.col("fraction") * F.col("account_equity"))
    gross = rows.groupBy("strategy").agg(F.sum(F.abs("target")).alias("g"))
    cap = F.lit(max_gross_leverage) * F.col("account_equity")
    scaled = F.when((F.col("g") > cap) & (cap > 0), F.col("target") * cap / F.col("g")).otherwise(F.col("target"))
    return rows.join(gross, "strategy").select("strategy", "coin", scaled.alias("target"))


def guarded_orders(targets: DataFrame, positions: DataFrame, markets: DataFrame, max_order: float = MAX_ORDER_USD,
                   min_order: float = MIN_ORDER_USD) -> DataFrame:
    """Orders towards guarded targets: larger ones are cut to the cap (the rest follows next step);
    reduce_only marks orders that only shrink a position."""
    plan = rebalance_gaps(targets, positions, markets, key="strategy", min_order=min_order).join(
        markets.select("coin", "sz_decimals"), "coin")
    after = F.col("current") + F.col("delta")
    reduce_only = (F.abs(after) < F.abs("current")) & (F.col("current") * after >= 0)
    over = F.abs("delta") * F.col("mid") > max_order
    cut = round_even(F.lit(max_order) / F.col("mid"), F.col("sz_decimals")) * F.signum("delta")
    rows = plan.withColumn("reduce_only", reduce_only).withColumn("capped", over).withColumn(
        "order", F.when(over, cut).otherwise(F.col("delta")))
    return rows.filter((F.col("order") != 0) & (F.abs("order") * F.col("mid") >= min_order)).select(
        "strategy", "coin", "target", "current", "order", "capped", "reduce_only")


def strategy_status(strategies: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Latest equity of every strategy (its capital before the first snapshot), return, drawdown, leverage."""
    last = snapshots.groupBy("strategy").agg(F.max(F.struct("ts_ms", "equity", "gross", "books")).alias("e"))
    rows = strategies.join(last, "strategy", "left").withColumn("_eq", F.coalesce("e.equity", "capital"))
    return rows.select(
        "strategy", "status", F.col("e.ts_ms").alias("ts_ms"), F.col("_eq").alias("equity"),
        (ratio(F.col("_eq"), F.col("capital")) - 1).alias("return"),
        (1 - ratio(F.col("_eq"), F.col("peak_equity"))).alias("drawdown"),
        F.coalesce(ratio(F.coalesce("e.gross", F.lit(0.0)), F.col("_eq")), F.lit(0.0)).alias("leverage"),
        F.coalesce("e.books", F.lit(0)).cast("long").alias("books"))


def log_totals(log: DataFrame) -> DataFrame:
    """Number of trades, fees and funding over the whole log."""
    return log.agg(F.count_if(F.col("kind") == "trade").alias("trades"),
                   F.coalesce(F.sum(F.when(F.col("kind") == "trade", F.col("fee"))), F.lit(0.0)).alias("fees"),
                   F.coalesce(F.sum(F.when(F.col("kind") == "funding", F.col("cash_delta"))), F.lit(0.0)).alias("funding"))


EVENT_KINDS = ("halt", "risk_pause", "close_book", "open_book", "rebalance")


def recent_events(log: DataFrame, n: int = 12, kinds: Sequence[str] = EVENT_KINDS, field: str = "$.reason") -> DataFrame:
    """The newest n events of the given kinds with one field of their JSON detail."""
    rows = log.filter(F.col("kind").isin(*kinds))
    return top_n(rows, [], [F.col("ts_ms").desc(), F.col("id").desc()], n).select(
        "ts_ms", "strategy", "trader", "kind", F.get_json_object("detail", field).alias("detail"))


def equity_curve(snapshots: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Equity snapshots of the last days."""
    return snapshots.filter(F.col("ts_ms") >= now_ms - days * DAY_MS).select("strategy", "ts_ms", "equity")


def book_target_watch(books: DataFrame, trader_equity: DataFrame, flags: DataFrame,
                      min_equity: float = MIN_BOOK_TRADER_EQUITY) -> DataFrame:
    """Books to close: the trader's account became too small, or behavior rules flagged the trader.

    flags: trader, rule (see active_flags)."""
    rows = books.join(trader_equity, "trader", "left").join(flags.select("trader", "rule"), "trader", "left")
    small = F.coalesce("trader_equity", F.lit(0.0)) < min_equity
    reason = F.when(F.col("rule").isNotNull(), F.concat(F.lit("behavior: "), F.col("rule"))).when(small, "trader equity below minimum")
    return rows.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("book_id", "strategy", "trader", "reason")
