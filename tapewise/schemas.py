"""Fixed schemas of the processed tables (DDL). Columns are nullable: drift becomes nulls."""

TABLES = {
    "leaderboard": (
        "snapshot_at string, data_as_of string, user string, display_name string, account_value double, "
        "day_pnl double, day_roi double, day_vlm double, week_pnl double, week_roi double, week_vlm double, "
        "month_pnl double, month_roi double, month_vlm double, alltime_pnl double, alltime_roi double, alltime_vlm double"),
    "account_snapshots": (
        "snapshot_at string, user string, dex string, account_value double, total_notional double, "
        "total_margin_used double, withdrawable double, open_positions long"),
    "positions": (
        "snapshot_at string, user string, dex string, coin string, size double, entry_px double, position_value double, "
        "unrealized_pnl double, leverage_type string, leverage double, liquidation_px double, margin_used double, "
        "funding_since_open double"),
    "equity_history": "user string, period string, time_ms long, account_value double, pnl double",
    "equity_census": "user string, period string, time_ms long, account_value double, pnl double",
    "vault_equity": "user string, period string, time_ms long, account_value double, pnl double",
    "vaults": (
        "snapshot_at string, vault_address string, leader string, name string, tvl double, apr double, is_closed boolean, "
        "relationship string, created_ms long"),
    "vault_meta": (
        "snapshot_at string, vault_address string, name string, leader string, leader_commission double, "
        "leader_fraction double, followers long, apr double, is_closed boolean, allow_deposits boolean, "
        "always_close_on_withdraw boolean"),
    "candles": (
        "snapshot_at string, coin string, interval string, time_ms long, open double, high double, low double, "
        "close double, volume double"),
    "fills": (
        "user string, time_ms long, coin string, side string, dir string, px double, sz double, start_position double, "
        "closed_pnl double, fee double, fee_token string, crossed boolean, liquidated boolean, builder_fee double, "
        "oid long, tid long, hash string"),
    "okx_traders": (
        "snapshot_at string, data_ver string, user string, nickname string, aum double, pnl double, pnl_ratio double, "
        "win_ratio double, lead_days long, copy_traders long, n_instruments long"),
    "okx_pnl": "user string, time_ms long, pnl double, pnl_ratio double",
}
