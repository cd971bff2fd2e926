"""Scores within a pool, their explanation, and the daily price plan."""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, count_true, pct_rank, true, weighted_mean

#: Factors that filter but never rank.
POSITION_FACTORS = ("close_position_20", "close_position_60", "close_position_250", "dist_to_52w_high")
#: The members of each category, all of them directional.
MEMBERS = {
    "industry": ("industry_score", "industry_leader_score"),
    "growth": ("profit_yoy", "eps_yoy", "revenue_yoy", "profit_acceleration", "eps_acceleration", "positive_profit_streak", "positive_growth_streak"),
    "quality": ("roe_avg", "gross_profit_margin", "net_profit_margin", "current_ratio", "quick_ratio", "cash_ratio", "ebit_to_interest", "cfo_to_or", "cfo_to_np", "cfo_to_gr", "financial_safety_value"),
    "valuation": ("pe_ttm_value", "pe_industry_value"),
    "momentum": ("ret_20", "ret_60", "ret_since_base", "relative_ret_20", "relative_ret_60", "volume_trend_20"),
    "risk": ("volatility_value", "drawdown_value", "downside_volatility_value"),
    "theme": ("theme_heat_max", "theme_days_20"),
    "capital": ("lhb_net_buy_rel", "main_net_inflow", "net_chg_20"),
    "liquidity": ("turnover_value_20",),
}
WEIGHTS = {"industry": 0.20, "growth": 0.18, "quality": 0.15, "valuation": 0.15, "momentum": 0.15, "risk": 0.08, "theme": 0.02, "capital": 0.02, "liquidity": 0.05}


class WeightError(ValueError):
    """A weight table that names a position factor or something unknown, or does not add up."""


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    if set(weights) & set(POSITION_FACTORS):
        raise WeightError("position factors filter but never rank")
    if unknown := sorted(set(weights) - set(MEMBERS)):
        raise WeightError(f"unknown categories: {', '.join(unknown)}")
    out = {k: float(v) for k, v in weights.items()}
    if any(not isfinite(v) or v < 0 for v in out.values()) or sum(out.values()) <= 0:
        raise WeightError("weights are finite, not negative, and not all zero")
    return out


def member_ranks(pool: DataFrame, weights: dict[str, float], *partition: str) -> DataFrame:
    """``symbol, category, member, nth, pct``: the long form, ranked by member in one window.

    Ranks run within the pool, or within each of its partitions, such as the
    dates of a backtest; the shuffle is by member, not one for each member.
    """
    members = [F.struct(F.lit(c).alias("category"), F.lit(m).alias("member"), F.lit(i).alias("nth"), F.col(m).cast("double").alias("value")) for c in checked_weights(weights) for i, m in enumerate(MEMBERS[c]) if m in pool.columns]
    long = pool.select("symbol", *partition, F.explode(F.array(*members)).alias("x")).select("symbol", *partition, "x.*")
    return long.withColumn("pct", pct_rank(F.col("value"), F.col("member"), *[F.col(p) for p in partition])).drop("value")


def pool_scores(pool: DataFrame, weights: dict[str, float], *partition: str) -> DataFrame:
    """Category scores, their weighted mean and the share of weight that was present, by symbol."""
    weights = checked_weights(weights)
    by = member_ranks(pool, weights, *partition).groupBy("symbol", *partition).agg(*[F.avg(F.when(F.col("category") == c, F.col("pct"))).alias(f"score_{c}") for c in weights])
    score, coverage = weighted_mean(weights, "score_")
    return by.withColumns({"score": score, "score_coverage": coverage})


def explain_scores(pool: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row per symbol and category: what it adds to the score, and which members were there."""
    weights = checked_weights(weights)
    names = lambda test: F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("nth", "member")))), lambda x: x["member"]))
    by = member_ranks(pool, weights).groupBy("symbol", "category").agg(F.avg("pct").alias("value"), names(F.col("pct").isNotNull()).alias("present"), names(F.col("pct").isNull()).alias("absent"))
    own = Window.partitionBy("symbol")
    weight = F.create_map(*[F.lit(v) for c, w in weights.items() for v in (c, w)])[F.col("category")]
    seen = F.sum(F.when(F.col("value").isNotNull(), weight)).over(own)
    return by.withColumn("contribution", F.col("value") * weight / seen)


# The states and signals of the price plan.
REALISED, REALISING, AHEAD, WEAK, UNKNOWN = "短期兑现较充分", "正在兑现", "基本面尚未充分反映", "兑现偏弱", "暂无明确代理"
HOLD, CONFIRM, WAIT, BUY = "暂缓", "暂缓，先确认", "等回落再买", "今天可分批"


@dataclass(frozen=True)
class PlanRules:
    """The thresholds of the price plan and of the expectation state."""

    # What counts as high, and how many such signs make a move realised.
    high_return: float = 0.12
    high_position: float = 0.85
    near_high: float = -0.05
    high_volume: float = 1.5
    many_theme_days: int = 4
    signs: int = 2
    steady_volume: float = 1.0
    falling_return: float = -0.08
    # The buffer around the close, from the volatility.
    default_volatility: float = 0.02
    volatility_factor: float = 1.8
    least_buffer: float = 0.02
    most_buffer: float = 0.08
    # Too far above the means, too weak, too little known.
    over_mean: float = 0.06
    over_return: float = 0.08
    weak_return: float = -0.12
    weak_mean: float = -0.06
    least_coverage: float = 0.6
    # Anchors and targets, as shares and multiples of the close.
    anchor_share: float = 0.9
    most_discount: float = 3.0
    anchor_reach: float = 2.0
    high_reach: float = 3.0
    far: float = 1.02
    first_step: float = 0.04
    second_step: float = 0.08
    first_buffers: float = 2.0
    second_buffers: float = 4.0
    most_target: float = 2.0
    target_gap: float = 1.05
    # Orders: how far above the support to buy, where not to chase, where the plan ends.
    wait_buffers: float = 0.75
    least_wait: float = 0.01
    chase_buffers: float = 0.5
    least_chase: float = 0.01
    most_chase: float = 0.03
    least_stop: float = 0.025


RULES = PlanRules()


def expectation_state(rules: PlanRules = RULES) -> Column:
    """Ordered rules over what is present; a missing value meets none of them."""
    c, r = F.col, rules
    high = count_true(c("ret_20") >= r.high_return, c("close_position_20") >= r.high_position, c("dist_to_52w_high") >= r.near_high, c("volume_trend_20") >= r.high_volume, c("theme_days_20") >= r.many_theme_days)
    rising = true(c("ret_20") > 0) & true(c("relative_ret_20") > 0) & F.coalesce(c("volume_trend_20") >= r.steady_volume, F.lit(True))
    growing = (true(c("profit_yoy") > 0) | true(c("revenue_yoy") > 0)) & true(c("ret_20") <= 0) & F.coalesce(c("pe_industry_value") >= 0, F.lit(True))
    falling = true(c("ret_20") <= r.falling_return) | true(c("relative_ret_20") <= r.falling_return)
    return F.when(high >= r.signs, REALISED).when(rising, REALISING).when(growing, AHEAD).when(falling, WEAK).otherwise(UNKNOWN)


def price_plan(rows: DataFrame, rules: PlanRules = RULES) -> DataFrame:
    """Reference prices of the day for each row with a positive close; others are put on hold."""
    c, r, one = F.col, rules, F.lit(1.0)
    rows = rows.withColumn("expectation_state", expectation_state(r))
    rows = rows.withColumn("buffer", clamp(F.coalesce(c("realized_vol_20"), F.lit(r.default_volatility)) * r.volatility_factor, r.least_buffer, r.most_buffer))

    def mean(n: int) -> Column:
        level = F.when(c(f"ma{n}_dev") > -1, c("close") / (one + c(f"ma{n}_dev")))
        return F.when((level > 0) & (level <= c("close")), level)

    rows = rows.withColumn("support", F.greatest(c("close") * (one - c("buffer")), mean(20), mean(60)))
    over = true(c("ma20_dev") >= r.over_mean) | (true(c("close_position_20") >= r.high_position) & true(c("ret_20") >= r.over_return))
    weak = true(c("ret_20") <= r.weak_return) & true(c("ma60_dev") <= r.weak_mean)
    state = c("expectation_state")
    signal = (
        F.when(~true(c("close") > 0), HOLD)
        .when(true(c("score_coverage") < r.least_coverage), HOLD)
        .when(weak | (state == WEAK), CONFIRM)
        .when(over | (state == REALISED), WAIT)
        .otherwise(BUY)
    )
    priced = true(c("close") > 0)
    eps = F.col("eps_ttm")
    anchor = F.when((eps > 0) & (c("pe_ttm") > 0) & c("pe_industry_value").isNotNull(), eps * c("pe_ttm") * F.exp(clamp(c("pe_industry_value"), -r.most_discount, r.most_discount)) * r.anchor_share)
    anchor = F.when((anchor > c("close")) & (anchor <= c("close") * r.anchor_reach), anchor)
    top = F.when((c("dist_to_52w_high") < 0) & (c("dist_to_52w_high") > -1), c("close") / (one + c("dist_to_52w_high")))
    top = F.when((top > c("close")) & (top <= c("close") * r.high_reach), top)
    rows = rows.withColumns({"operation_signal": signal, "valuation_anchor": F.when(priced, anchor), "high_anchor": F.when(priced, top)})
    far = lambda x: F.when(x >= c("close") * r.far, x)
    near_1, near_2 = (c("close") * (one + F.greatest(F.lit(step), c("buffer") * n)) for step, n in ((r.first_step, r.first_buffers), (r.second_step, r.second_buffers)))
    rows = rows.withColumns({
        "target_1": F.when(priced, F.least(near_1, far(c("valuation_anchor")), far(c("high_anchor")))),
        "target_2": F.when(priced, F.least(F.greatest(near_2, far(c("valuation_anchor")), far(c("high_anchor"))), c("close") * r.most_target)),
    })
    wait_high = F.least(c("close"), c("support") * (one + F.greatest(c("buffer") * r.wait_buffers, F.lit(r.least_wait))))
    return rows.withColumns({
        "target_2": F.when(c("target_2") <= c("target_1"), c("target_1") * r.target_gap).otherwise(c("target_2")),
        "buy_low": F.when(priced, c("support")),
        "buy_high": F.when(priced, F.greatest(c("support"), F.when(c("operation_signal") == WAIT, wait_high).otherwise(c("close")))),
        "no_chase_price": F.when(priced, c("close") * (one + F.least(F.greatest(c("buffer") * r.chase_buffers, F.lit(r.least_chase)), F.lit(r.most_chase)))),
        "invalidation_price": F.when(priced, c("support") * (one - F.greatest(c("buffer"), F.lit(r.least_stop)))),
    })


# Title phrases by category, in order, and terms that need a reader.
TITLE_RULES = (
    ("shareholder_reduction", ("减持",)),
    ("shareholder_increase", ("增持",)),
    ("unlock", ("解除限售", "限售股上市流通", "解禁")),
    ("regulatory", ("立案", "行政处罚", "监管措施", "问询函", "关注函", "纪律处分", "退市风险")),
    ("earnings", ("业绩预告", "业绩快报", "业绩说明会", "年度报告", "半年度报告", "季度报告", "年报", "半年报", "一季报", "三季报")),
    ("dividend", ("利润分配", "现金分红", "权益分派", "派息", "分红")),
    ("repurchase", ("回购",)),
    ("pledge", ("质押",)),
    ("index_change", ("指数样本", "指数成份", "成份股调整", "样本股调整")),
    ("major_contract", ("重大合同", "中标", "重大项目")),
    ("major_event", ("重大资产重组", "控制权变更", "签署协议", "重大诉讼", "资金占用", "重大事项", "违规担保")),
)
AMBIGUOUS = ("股份变动", "股份转让", "股权转让", "实际控制人变更", "合同终止", "终止合作", "诉讼", "仲裁", "冻结", "异常波动", "关联交易", "重大变更", "承诺", "对外担保", "资金拆借", "募集资金用途变更")


def classify(title: Column, rules=TITLE_RULES, ambiguous=AMBIGUOUS) -> tuple[Column, Column]:
    """Category (NULL while pending) and status of a title; the first rule with a phrase in it wins."""
    compact = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", "")
    has = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: compact.contains(p))
    category, status = F.when(has(ambiguous), F.lit(None).cast("string")).otherwise("ignore"), F.when(has(ambiguous), "pending").otherwise("ignored")
    for name, phrases in reversed(rules):
        category, status = F.when(has(phrases), name).otherwise(category), F.when(has(phrases), "classified").otherwise(status)
    return category, status
