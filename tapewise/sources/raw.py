"""Raw JSON records (gzip lines of envelopes) to rows of the processed tables.

A record is one API response: {platform, dataset, fetched_at, request, payload}. The payload stays
text until a builder parses it with its own explicit schema; numbers are read as text and cast, since
the source sends them as strings or numbers. An array of mixed types is read as array<array<string>>:
nested objects inside it stay JSON text for a second parse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .members import listed, read_members, scan

ENVELOPE = ("platform string, dataset string, fetched_at string, request string, payload string, "
            "source_version string, _corrupt string")


def gzip_state(content: bytes) -> str:
    """whole, truncated (the content breaks off inside a member) or damaged (anything else that is no gzip)."""
    members = scan(lambda offset, n: content[offset:offset + n], len(content), 0, len(content))
    while content:
        try:
            next(members)
        except StopIteration as end:
            return end.value[0]
    return "truncated"


def from_the_beginning(files: DataFrame) -> DataFrame:
    return files.withColumn("start", F.lit(0).cast("long")).withColumn("before", F.lit(None).cast("binary"))


def gzip_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, state) of every gzip file below a path."""
    return read_members(from_the_beginning(listed(spark, path)))[1].select("path", "state")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of gzip files with the file's path and the offset `at` of the member they start in. A file that breaks off (its
    writer was stopped) ends quietly: every complete record before is kept. Files with any other damage give no lines;
    `gzip_states` names them. Every file is read once, long ones by several tasks."""
    return read_members(from_the_beginning(listed(spark, path)))[0]


def parse_records(lines: DataFrame) -> DataFrame:
    """Envelopes of the lines (column `value`); blank lines are skipped. `_corrupt` holds the text of a
    line that is not one complete JSON object."""
    rest = [c for c in lines.columns if c != "value"]
    e = F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.filter(F.trim("value") != "").withColumn("e", e)
    return parsed.select(*rest, "e.platform", "e.dataset", "e.fetched_at", "e.request", "e.payload",
                         "e.source_version", "e._corrupt")


def raw_scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Complete records below a path."""
    return parse_records(read_lines(spark, path)).filter(F.col("_corrupt").isNull()).drop("_corrupt")


# --- helpers --------------------------------------------------------------------------------------

def _num(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("long")


def _bool(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("boolean")


def _request(field: str) -> Column:
    return F.get_json_object("request", f"$.{field}")


def http_date(text: Column) -> Column:
    """HTTP date -> ISO 8601 UTC text; the weekday is redundant and dropped."""
    t = F.try_to_timestamp(F.substring(text, 6, 100), F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _last_entries(entries: Column, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """Map of an array's entries; of a key that comes again the last value counts."""
    ordered = F.array_sort(F.transform(F.filter(entries, lambda e: key(e).isNotNull()),
                                       lambda e, i: F.struct(key(e).alias("k"), i.alias("i"), value(e).alias("v"))))
    after = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1)))
    marked = F.zip_with(ordered, after, lambda e, f: F.struct(e["k"].alias("k"), e["v"].alias("v"), F.coalesce(f["k"] != e["k"], F.lit(True)).alias("last")))
    return F.map_from_entries(F.transform(F.filter(marked, lambda m: m["last"]), lambda m: F.struct(m["k"], m["v"])))


FILE_COLUMNS = ("date", "run", "at")


def _keep(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Select, keeping the columns that tell where in which raw file a row comes from (where present)."""
    return df.select(*columns, *[c for c in FILE_COLUMNS if c in df.columns])


# --- row builders ---------------------------------------------------------------------------------

LEADERBOARD = ("leaderboardRows array<struct<ethAddress:string, accountValue:string, displayName:string, "
               "windowPerformances:array<array<string>>>>")


def leaderboard_rows(records: DataFrame) -> DataFrame:
    """One row per account and snapshot, the four windows and three metrics side by side."""
    rows = records.withColumn("r", F.explode(F.from_json("payload", LEADERBOARD)["leaderboardRows"]))
    rows = rows.withColumn("w", _last_entries(F.col("r.windowPerformances"), lambda p: F.lower(p[0]), lambda p: p[1]))
    metric = lambda window, name: _num(F.get_json_object(F.try_element_at("w", F.lit(window)), f"$.{name}")).alias(f"{window}_{name}")
    return _keep(rows, F.col("fetched_at").alias("snapshot_at"),
        http_date(F.get_json_object("source_version", "$.last_modified")).alias("data_as_of"),
        F.lower("r.ethAddress").alias("user"), F.col("r.displayName").alias("display_name"),
        _num("r.accountValue").alias("account_value"),
        *[metric(w, m) for w in ("day", "week", "month", "alltime") for m in ("pnl", "roi", "vlm")])


ACCOUNT = ("marginSummary struct<accountValue:string, totalNtlPos:string, totalMarginUsed:string>, withdrawable string, "
           "assetPositions array<struct<position:struct<coin:string, szi:string, entryPx:string, positionValue:string, "
           "unrealizedPnl:string, leverage:struct<type:string, value:string>, liquidationPx:string, marginUsed:string, "
           "cumFunding:struct<sinceOpen:string>>>>")


def _dex() -> Column:
    return F.coalesce(_request("dex"), F.lit("")).alias("dex")


def account_rows(records: DataFrame) -> DataFrame:
    """One row per account state."""
    rows = records.withColumn("p", F.from_json("payload", ACCOUNT))
    return _keep(rows, F.col("fetched_at").alias("snapshot_at"), _request("user").alias("user"), _dex(),
        _num("p.marginSummary.accountValue").alias("account_value"), _num("p.marginSummary.totalNtlPos").alias("total_notional"),
        _num("p.marginSummary.totalMarginUsed").alias("total_margin_used"), _num("p.withdrawable").alias("withdrawable"),
        F.size("p.assetPositions").cast("long").alias("open_positions"))


def position_rows(records: DataFrame) -> DataFrame:
    """One row per open position; size is signed."""
    rows = records.withColumn("a", F.explode(F.from_json("payload", ACCOUNT)["assetPositions"])).withColumn("x", F.col("a.position"))
    return _keep(rows, F.col("fetched_at").alias("snapshot_at"), _request("user").alias("user"), _dex(), F.col("x.coin").alias("coin"),
        _num("x.szi").alias("size"), _num("x.entryPx").alias("entry_px"), _num("x.positionValue").alias("position_value"),
        _num("x.unrealizedPnl").alias("unrealized_pnl"), F.col("x.leverage.type").alias("leverage_type"),
        _num("x.leverage.value").alias("leverage"), _num("x.liquidationPx").alias("liquidation_px"),
        _num("x.marginUsed").alias("margin_used"), _num("x.cumFunding.sinceOpen").alias("funding_since_open"))


SERIES = "accountValueHistory array<array<string>>, pnlHistory array<array<string>>"


def _portfolio(rows: DataFrame, user: Column, portfolio: Column) -> DataFrame:
    """[[period, {accountValueHistory, pnlHistory}], ...] -> one row per period and time; the PnL of a
    time without one is null."""
    periods = _keep(rows, user.alias("user"), F.explode(F.from_json(portfolio, "array<array<string>>")).alias("p"))
    s = _keep(periods, "user", F.col("p")[0].alias("period"), F.from_json(F.col("p")[1], SERIES).alias("s"))
    s = s.withColumn("pnl", _last_entries(F.col("s.pnlHistory"), lambda x: x[0], lambda x: x[1]))
    points = _keep(s, "user", "period", "pnl", F.explode("s.accountValueHistory").alias("v"))
    return _keep(points, "user", "period", _long(F.col("v")[0]).alias("time_ms"), _num(F.col("v")[1]).alias("account_value"),
                         _num(F.try_element_at("pnl", F.col("v")[0])).alias("pnl"))


def equity_rows(records: DataFrame) -> DataFrame:
    """Account value and PnL histories per period."""
    return _portfolio(records, _request("user"), F.col("payload"))


def vault_equity_rows(records: DataFrame) -> DataFrame:
    """A vault's histories in the same shape (user = vault address); vaults without one give no rows."""
    return _portfolio(records, F.lower(_request("vaultAddress")), F.get_json_object("payload", "$.portfolio"))


VAULTS = ("array<struct<apr:string, summary:struct<vaultAddress:string, leader:string, name:string, tvl:string, "
          "isClosed:string, relationship:struct<type:string>, createTimeMillis:string>>>")


def vault_rows(records: DataFrame) -> DataFrame:
    """One row per vault of a listing."""
    rows = records.withColumn("v", F.explode(F.from_json("payload", VAULTS))).withColumn("s", F.col("v.summary"))
    return _keep(rows, F.col("fetched_at").alias("snapshot_at"), F.lower("s.vaultAddress").alias("vault_address"),
        F.lower("s.leader").alias("leader"), F.col("s.name").alias("name"), _num("s.tvl").alias("tvl"),
        _num("v.apr").alias("apr"), _bool("s.isClosed").alias("is_closed"),
        F.col("s.relationship.type").alias("relationship"), _long("s.createTimeMillis").alias("created_ms"))


CANDLES = "array<struct<t:string, o:string, h:string, l:string, c:string, v:string>>"


def candle_rows(records: DataFrame) -> DataFrame:
    """One row per candle."""
    rows = records.withColumn("c", F.explode(F.from_json("payload", CANDLES)))
    return _keep(rows, F.col("fetched_at").alias("snapshot_at"), _request("coin").alias("coin"), _request("interval").alias("interval"),
        _long("c.t").alias("time_ms"), _num("c.o").alias("open"), _num("c.h").alias("high"), _num("c.l").alias("low"),
        _num("c.c").alias("close"), _num("c.v").alias("volume"))


VAULT_DETAIL = ("name string, leader string, leaderCommission string, leaderFraction string, followers array<string>, "
                "apr string, isClosed string, allowDeposits string, alwaysCloseOnWithdraw string")


def vault_detail_rows(records: DataFrame) -> DataFrame:
    """Terms of a vault; an empty answer gives no row."""
    rows = records.filter(F.col("payload").isNotNull() & ~F.trim("payload").isin("", "null", "{}", "[]"))
    rows = rows.withColumn("d", F.from_json("payload", VAULT_DETAIL))
    return _keep(rows, F.col("fetched_at").alias("snapshot_at"), F.lower(_request("vaultAddress")).alias("vault_address"),
        F.col("d.name").alias("name"), F.lower(F.coalesce("d.leader", F.lit(""))).alias("leader"),
        _num("d.leaderCommission").alias("leader_commission"), _num("d.leaderFraction").alias("leader_fraction"),
        F.coalesce(F.size("d.followers"), F.lit(0)).cast("long").alias("followers"), _num("d.apr").alias("apr"),
        _bool("d.isClosed").alias("is_closed"), _bool("d.allowDeposits").alias("allow_deposits"),
        _bool("d.alwaysCloseOnWithdraw").alias("always_close_on_withdraw"))


OKX_PAGES = ("array<struct<dataVer:string, ranks:array<struct<uniqueCode:string, nickName:string, aum:string, pnl:string, "
             "pnlRatio:string, winRatio:string, leadDays:string, copyTraderNum:string, traderInsts:array<string>>>>>")


def okx_trader_rows(records: DataFrame) -> DataFrame:
    """One row per lead trader of a ranking (pages of ranks); empty numbers are null."""
    pages = _keep(records, "fetched_at", F.explode(F.from_json("payload", OKX_PAGES)).alias("g"))
    rows = _keep(pages, "fetched_at", "g.dataVer", F.explode("g.ranks").alias("r"))
    return _keep(rows, F.col("fetched_at").alias("snapshot_at"), F.col("dataVer").alias("data_ver"), F.col("r.uniqueCode").alias("user"),
        F.col("r.nickName").alias("nickname"), _num("r.aum").alias("aum"), _num("r.pnl").alias("pnl"),
        _num("r.pnlRatio").alias("pnl_ratio"), _num("r.winRatio").alias("win_ratio"), _long("r.leadDays").alias("lead_days"),
        _long("r.copyTraderNum").alias("copy_traders"),
        F.coalesce(F.size("r.traderInsts"), F.lit(0)).cast("long").alias("n_instruments"))


OKX_PNL = "array<struct<beginTs:string, pnl:string, pnlRatio:string>>"


def okx_pnl_rows(records: DataFrame) -> DataFrame:
    """Accumulated daily PnL and ratio of a lead trader."""
    rows = _keep(records, _request("uniqueCode").alias("user"), F.explode(F.from_json("payload", OKX_PNL)).alias("p"))
    return _keep(rows, "user", _long("p.beginTs").alias("time_ms"), _num("p.pnl").alias("pnl"), _num("p.pnlRatio").alias("pnl_ratio"))


FILLS = ("array<struct<time:string, coin:string, side:string, dir:string, px:string, sz:string, startPosition:string, "
         "closedPnl:string, fee:string, feeToken:string, crossed:string, liquidation:struct<liquidatedUser:string>, "
         "builderFee:string, oid:string, tid:string, hash:string>>")


def fill_rows(records: DataFrame) -> DataFrame:
    """One row per fill. A liquidation fill names the liquidated party, which may be the other side."""
    rows = _keep(records, _request("user").alias("user"), F.explode(F.from_json("payload", FILLS)).alias("f"))
    mine = F.coalesce(F.lower("f.liquidation.liquidatedUser") == F.lower("user"), F.lit(False))
    return _keep(rows, "user", _long("f.time").alias("time_ms"), F.col("f.coin").alias("coin"), F.col("f.side").alias("side"),
        F.col("f.dir").alias("dir"), _num("f.px").alias("px"), _num("f.sz").alias("sz"),
        _num("f.startPosition").alias("start_position"), _num("f.closedPnl").alias("closed_pnl"), _num("f.fee").alias("fee"),
        F.col("f.feeToken").alias("fee_token"), _bool("f.crossed").alias("crossed"), mine.alias("liquidated"),
        _num("f.builderFee").alias("builder_fee"), _long("f.oid").alias("oid"), _long("f.tid").alias("tid"),
        F.col("f.hash").alias("hash"))


# raw dataset -> the tables it feeds
BUILDERS: dict[str, list[tuple[str, Callable[[DataFrame], DataFrame]]]] = {
    "leaderboard": [("leaderboard", leaderboard_rows)],
    "clearinghouse_state": [("account_snapshots", account_rows), ("positions", position_rows)],
    "portfolio": [("equity_history", equity_rows)],
    "portfolio_census": [("equity_census", equity_rows)],
    "fills": [("fills", fill_rows)],
    "vaults": [("vaults", vault_rows)],
    "candles": [("candles", candle_rows)],
    "vault_details": [("vault_meta", vault_detail_rows), ("vault_equity", vault_equity_rows)],
    "okx_lead_traders": [("okx_traders", okx_trader_rows)],
    "okx_pnl": [("okx_pnl", okx_pnl_rows)],
}
