"""Account replays over the panel: a grid of rules, windows and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import factors
from tidemark.operators.replay import Rules, replay_accounts, tradable
from tidemark.plans.factors import shown
from tidemark.plans.registry import query
from tidemark.session import materialise
from tidemark.sources.market import panel, with_

#: Rules by candidate, and windows as first and last day.
CANDIDATES = {
    "F1": Rules(10, 16, 5), "F2": Rules(10, 16, 10), "F3": Rules(20, 30, 10), "V1": Rules(10, 16, 5, "inverse_vol", 0.2),
    "C1": Rules(10, 10, 1_000),
}
WINDOWS = (("w1", "1996-06-01", "1996-06-30"), ("w2", "1996-08-01", "1996-08-30"), ("w3", "1996-10-01", "1996-10-30"))
COSTS = (0, 10, 20)


def ranked_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel with yesterday's volatility and rank by 20-day return: what was known before the open."""
    rows = panel(spark, d)
    by = Window.partitionBy("symbol").orderBy("trade_date")
    risk = factors.risk_factors(rows).select("symbol", "trade_date", "realized_vol_20")
    moved = factors.momentum_factors(rows).select("symbol", "trade_date", "ret_20")
    known = rows.join(risk, ["symbol", "trade_date"]).join(moved, ["symbol", "trade_date"])
    known = known.withColumns({"vol": F.lag("realized_vol_20").over(by), "signal": F.lag("ret_20").over(by), "risk": F.lit(False), "growth": F.col("symbol").endswith("7")})
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc_nulls_last("signal"), "symbol"))
    return known.withColumn("rank", F.when(F.col("signal").isNotNull(), place)).select("symbol", "trade_date", "open", "high", "low", "close", "pre_close", "volume", "risk", "growth", "vol", "rank")


def accounts(spark: SparkSession, d: str, candidates: tuple[str, ...]) -> DataFrame:
    """Each account's rows: a day belongs to its window, and is repeated for each rule and cost of the plan.

    The windows' rows are written once and cut to the symbols that can be held
    before they are repeated, so an account's group does not grow with the
    number of symbols.
    """
    at, window = F.col("trade_date"), F.lit(None).cast("string")
    for name, a, b in WINDOWS:
        window = F.when((at >= F.lit(a).cast("date")) & (at <= F.lit(b).cast("date")), name).otherwise(window)
    rows = ranked_panel(spark, d).withColumn("window", window).where(F.col("window").isNotNull())
    rows = tradable(materialise(rows, "replay-rows"), max(CANDIDATES[c].positions for c in candidates))
    plan = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(k).alias("cost_bps")) for c in candidates for k in COSTS])
    rows = rows.select("*", F.explode(plan).alias("plan")).select("*", "plan.candidate", "plan.cost_bps").drop("plan")
    return rows.withColumns({"account": F.concat_ws("/", "candidate", "window", F.col("cost_bps").cast("string")), "exposure": F.lit(1.0)})


@query("rule_replay")
def rule_replay(spark: SparkSession, d: str) -> DataFrame:
    """Retention, rebalancing and weighting rules over all windows and costs."""
    return shown(replay_accounts(accounts(spark, d, ("F1", "F2", "F3", "V1")), CANDIDATES))


@query("account_replay", with_("panel") + """,
lagged9 AS (SELECT *, close / nullif(lag(close, 20) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS ret_20 FROM panel),
known9 AS (SELECT *, lag(ret_20) OVER (PARTITION BY symbol ORDER BY trade_date) AS signal FROM lagged9),
ranked9 AS (SELECT *, CASE WHEN signal IS NOT NULL THEN row_number() OVER (PARTITION BY trade_date ORDER BY signal DESC NULLS LAST, symbol) END AS rank FROM known9),
w(name, a, b) AS (VALUES """ + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in WINDOWS) + """),
entry9 AS (SELECT w.name, a, b, r.symbol, r.open, row_number() OVER (PARTITION BY w.name ORDER BY r.rank) AS nth FROM w JOIN ranked9 r ON r.trade_date = w.a
  WHERE r.rank IS NOT NULL AND r.volume > 0 AND NOT (r.open / r.pre_close - 1 >= CASE WHEN r.symbol LIKE '%7' THEN 0.195 ELSE 0.095 END)),
cyc AS (SELECT name, avg(p.close / e.open) AS gross FROM entry9 e JOIN panel p ON p.symbol = e.symbol AND p.trade_date = e.b WHERE nth <= 10 GROUP BY 1)
SELECT 'C1/' || name || '/' || cost AS account, round(gross * (1 - cost / 10000.0::DOUBLE) / (1 + cost / 10000.0::DOUBLE) - 1, 6) + 0.0 AS net_return, 20 AS orders FROM cyc, (VALUES (0), (10), (20)) c(cost)""")
def account_replay(spark: SparkSession, d: str) -> DataFrame:
    """One cycle of ten names held from the first open to the last close. Nothing is blocked, so the closed form checks the replay."""
    return shown(replay_accounts(accounts(spark, d, ("C1",)), CANDIDATES).select("account", "net_return", "orders"))
