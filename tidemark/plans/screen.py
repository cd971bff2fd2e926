"""Screen queries: funnel, scores, explanation, price plan, announcements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import reports
from tidemark.operators import scores as ops
from tidemark.operators.daily import daily_name
from tidemark.operators.funnel import Spec, funnel, rejection, risk_name
from tidemark.operators.keyed import latest_per_key
from tidemark.plans.factors import FACTOR_CTES, WIDE_NAMES, day, factor_table, shown, sql6, sql_mean, sql_rank
from tidemark.plans.registry import query
from tidemark.session import materialise
from tidemark.sources.market import bars, instruments, with_
from tidemark.sources.tables import table

#: The low-position screen, with thresholds for the synthetic tables.
LOW_POSITION = {
    "close_position_250": [None, 0.6], "dist_to_52w_high": [None, -0.05], "history_days": [250, None], "listed_days": [365, None],
    "volume_trend_20": [0.7, None], "turnover_value_20": [10_000, None], "limit": 25,
}
PRESETS = {
    "low-position": LOW_POSITION,
    "low-position-trend": LOW_POSITION | {"ma20_dev": [0, None], "ma60_dev": [0, None]},
    "theme-watch": {"theme_days_20": [1, None], "volume_trend_20": [0.9, None], "history_days": [60, None], "limit": 25},
    "recent-ipo": {"listed_days": [None, 2188], "history_days": [60, None], "volume_trend_20": [1.0, None], "limit": 25},
    "behind-base-day": {"ret_since_base": [None, 0.30], "history_days": [250, None], "turnover_value_20": [10_000, None], "limit": 25},
}
FIELDS = {*WIDE_NAMES, "history_days", "listed_days", "theme_days_20", "theme_heat_max", "lhb_count_20", "positive_profit_streak", "positive_growth_streak"}


def spec(name: str, **more) -> Spec:
    return Spec.from_dict(PRESETS[name] | more, FIELDS, set(ops.POSITION_FACTORS))


def sql_reason(filters: dict, first: str = "") -> str:
    """The SQL of the first failing reason."""
    cases = [first] if first else []
    for name, (low, high) in filters.items():
        cases.append(f"WHEN {name} IS NULL THEN '{name}: missing'")
        out = [f"{name} < {low}"] if low is not None else []
        out += [f"{name} > {high}"] if high is not None else []
        cases.append(f"WHEN {' OR '.join(out)} THEN '{name}: out of range'")
    return f"CASE {' '.join(cases)} END"


RISK_FIRST = "WHEN contains(coalesce(name, ''), 'ST') OR contains(coalesce(name, ''), '退') THEN 'risk name'"


@query("screen_funnel", FACTOR_CTES + f" SELECT coalesce({sql_reason(spec('low-position').filters, RISK_FIRST)}, 'kept') AS reason, count(*) AS n FROM wide GROUP BY 1")
def screen_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Rows by their first failing reason; with ``kept`` they add up to the universe."""
    wanted = spec("low-position")
    return funnel(factor_table(spark, d, "name", *wanted.filters), wanted)


def sql_preset(name: str) -> str:
    reason = sql_reason(spec(name).filters, RISK_FIRST)
    return f"SELECT '{name}' AS preset, count(*) AS universe, count(*) FILTER (WHERE reason IS NULL) AS pool, least(count(*) FILTER (WHERE reason IS NULL), 25) AS kept FROM (SELECT {reason} AS reason FROM wide)"


@query("preset_sizes", FACTOR_CTES + " " + " UNION ALL ".join(map(sql_preset, PRESETS)))
def preset_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Universe, pool and kept rows of every preset, in one pass over the columns that they filter by."""
    rows = factor_table(spark, d, "name", *[c for n in PRESETS for c in spec(n).filters])
    tests = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), rejection(spec(n), rows.columns).isNull().alias("ok")) for n in PRESETS])).alias("x")).select("x.*")
    by = tests.groupBy("preset").agg(F.count(F.lit(1)).alias("universe"), F.count_if("ok").alias("pool"))
    return by.withColumn("kept", F.least("pool", F.lit(25)))


@query("theme_filter", FACTOR_CTES + " SELECT symbol, theme_tags FROM wide WHERE len(list_intersect(string_split(theme_tags, '|'), ['ECONOMY', 'PROMO'])) > 0 AND NOT coalesce(len(list_intersect(string_split(theme_tags, '|'), ['Brand#13'])) > 0, false)")
def theme_filter(spark: SparkSession, d: str) -> DataFrame:
    """Whole tags, never parts of tags: any of the wanted, none of the unwanted."""
    rows = factor_table(spark, d, "theme_tags")
    return rows.where(rejection(Spec(themes_any=("ECONOMY", "PROMO"), themes_none=("Brand#13",), exclude_risk_names=False), rows.columns).isNull()).select("symbol", "theme_tags")


NAMES_SQL = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN replace(c_name, '#', ' ST') WHEN c_custkey % 11 = 0 THEN c_name || '退' WHEN c_custkey % 13 = 0 THEN replace(c_name, '#', ' *st') WHEN c_custkey % 17 <> 0 THEN c_name END AS name FROM customer"


@query("name_filter", f"SELECT c_custkey, name, c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AS passes_screen, c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND NOT (name IS NULL OR regexp_matches(name, '(?i)st')) AS passes_daily FROM (SELECT c_custkey, replace(name, 'Customer', 'Cu.') AS name FROM ({NAMES_SQL}))")
def name_filter(spark: SparkSession, d: str) -> DataFrame:
    """The two name rules: literal with missing names passing, and case-blind with missing names failing."""
    key, c_name = F.col("c_custkey"), F.col("c_name")
    name = F.when(key % 7 == 0, F.replace(c_name, F.lit("#"), F.lit(" ST"))).when(key % 11 == 0, F.concat(c_name, F.lit("退"))).when(key % 13 == 0, F.replace(c_name, F.lit("#"), F.lit(" *st"))).when(key % 17 != 0, c_name)
    rows = table(spark, d, "customer").select("c_custkey", F.replace(name, F.lit("Customer"), F.lit("Cu.")).alias("name"))
    return rows.select("c_custkey", "name", (~risk_name(F.col("name"))).alias("passes_screen"), daily_name(F.col("name")).alias("passes_daily"))


def with_risk_values(rows: DataFrame) -> DataFrame:
    """Risk factors with the sign that makes more better."""
    return rows.withColumns({"volatility_value": -F.col("realized_vol_20"), "drawdown_value": F.col("max_drawdown_60"), "downside_volatility_value": -F.col("downside_vol_20")})


SCREEN_POOL = {"history_days": [250, None], "volume_trend_20": [0.7, None], "turnover_value_20": [10_000, None]}
POOL_SPEC = Spec.from_dict(SCREEN_POOL, FIELDS)
_members = {c: ms for c, ms in ops.MEMBERS.items()}
SCORE_CTES = FACTOR_CTES + f""",
pool AS (SELECT *, -realized_vol_20 AS volatility_value, max_drawdown_60 AS drawdown_value, -downside_vol_20 AS downside_volatility_value FROM wide WHERE {sql_reason(POOL_SPEC.filters, RISK_FIRST)} IS NULL),
pranks AS (SELECT *, {', '.join(f'{sql_rank(m)} AS rank_{m}' for ms in _members.values() for m in ms)} FROM pool),
cats AS (SELECT *, {', '.join(f"{sql_mean(*[f'rank_{m}' for m in ms])} AS score_{c}" for c, ms in _members.items())} FROM pranks),
seen AS (SELECT *, ({' + '.join(f'CASE WHEN score_{c} IS NOT NULL THEN {w} ELSE 0 END' for c, w in ops.WEIGHTS.items())})::DOUBLE AS seen, ({' + '.join(f'coalesce(score_{c}, 0) * {w}::DOUBLE' for c, w in ops.WEIGHTS.items())}) AS total FROM cats),
scored AS (SELECT *, total / nullif(seen, 0) AS score, nullif(seen, 0) / {sum(ops.WEIGHTS.values())}::DOUBLE AS score_coverage FROM seen)"""


def pool(spark: SparkSession, d: str) -> DataFrame:
    rows = factor_table(spark, d)
    return with_risk_values(rows.where(rejection(POOL_SPEC, rows.columns).isNull()))


@query("score_rank", SCORE_CTES + f" SELECT symbol, {sql6('score', 'score_coverage', *['score_' + c for c in ops.WEIGHTS])}, row_number() OVER (ORDER BY round(score, 6) DESC, symbol)::INT AS place, count(*) OVER () AS pool_size FROM scored WHERE score IS NOT NULL ORDER BY place LIMIT 25")
def score_rank(spark: SparkSession, d: str) -> DataFrame:
    """Top 25 of the pool by score, ties to the smaller symbol, with the pool's size."""
    rows = shown(ops.pool_scores(pool(spark, d), ops.WEIGHTS).where(F.col("score").isNotNull()).select("symbol", "score", "score_coverage", *[f"score_{c}" for c in ops.WEIGHTS]))
    rows = materialise(rows, "scores")  # one row a symbol, for the report and for the pool's size
    top = rows.withColumn("pool_size", F.lit(rows.count())).orderBy(F.desc("score"), "symbol").limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "symbol")))


def _sql_names(c: str, test: str) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN rank_{m} IS {test} THEN '{m}' END" for m in _members[c]) + ")"


@query("score_explain", SCORE_CTES + " " + " UNION ALL ".join(f"SELECT symbol, '{c}' AS category, round(score_{c}, 6) + 0.0 AS value, round(score_{c} * {w} / (score_coverage * {sum(ops.WEIGHTS.values())}), 6) + 0.0 AS contribution, {_sql_names(c, 'NOT NULL')} AS present, {_sql_names(c, 'NULL')} AS absent FROM scored" for c, w in ops.WEIGHTS.items()))
def score_explain(spark: SparkSession, d: str) -> DataFrame:
    return shown(ops.explain_scores(pool(spark, d), ops.WEIGHTS))


PLAN_NAMES = ("buy_low", "buy_high", "no_chase_price", "invalidation_price", "valuation_anchor", "target_1", "target_2")
PLAN_CTES = SCORE_CTES + f""",
eps AS (SELECT *, close / nullif(pe_ttm, 0) AS eps_ttm FROM scored),
states AS (SELECT *, CASE WHEN coalesce((ret_20 >= 0.12)::INT, 0) + coalesce((close_position_20 >= 0.85)::INT, 0) + coalesce((dist_to_52w_high >= -0.05)::INT, 0) + coalesce((volume_trend_20 >= 1.5)::INT, 0) + coalesce((theme_days_20 >= 4)::INT, 0) >= 2 THEN '{ops.REALISED}'
  WHEN ret_20 > 0 AND relative_ret_20 > 0 AND coalesce(volume_trend_20 >= 1, true) THEN '{ops.REALISING}'
  WHEN (profit_yoy > 0 OR revenue_yoy > 0) AND ret_20 <= 0 AND coalesce(pe_industry_value >= 0, true) THEN '{ops.AHEAD}'
  WHEN ret_20 <= -0.08 OR relative_ret_20 <= -0.08 THEN '{ops.WEAK}' ELSE '{ops.UNKNOWN}' END AS expectation_state,
  greatest(least(coalesce(realized_vol_20, 0.02) * 1.8, 0.08), 0.02)::DOUBLE AS buffer,
  CASE WHEN ma20_dev > -1 THEN close / (1 + ma20_dev) END AS m20, CASE WHEN ma60_dev > -1 THEN close / (1 + ma60_dev) END AS m60 FROM eps),
supports AS (SELECT *, greatest(close * (1 - buffer), CASE WHEN m20 <= close THEN m20 END, CASE WHEN m60 <= close THEN m60 END) AS support,
  CASE WHEN coalesce(score_coverage < 0.6, false) THEN '{ops.HOLD}' WHEN coalesce(ret_20 <= -0.12 AND ma60_dev <= -0.06, false) OR expectation_state = '{ops.WEAK}' THEN '{ops.CONFIRM}'
  WHEN coalesce(ma20_dev >= 0.06, false) OR coalesce(close_position_20 >= 0.85 AND ret_20 >= 0.08, false) OR expectation_state = '{ops.REALISED}' THEN '{ops.WAIT}' ELSE '{ops.BUY}' END AS operation_signal,
  CASE WHEN eps_ttm > 0 AND pe_ttm > 0 THEN eps_ttm * pe_ttm * exp(greatest(least(pe_industry_value, 3.0), -3.0)) * 0.9 END AS anchor0, CASE WHEN dist_to_52w_high < 0 AND dist_to_52w_high > -1 THEN close / (1 + dist_to_52w_high) END AS top0 FROM states),
anchors AS (SELECT *, CASE WHEN anchor0 > close AND anchor0 <= close * 2 THEN anchor0 END AS valuation_anchor, CASE WHEN top0 > close AND top0 <= close * 3 THEN top0 END AS high_anchor FROM supports),
targets AS (SELECT *, least(close * (1 + greatest(0.04, buffer * 2)), CASE WHEN valuation_anchor >= close * 1.02 THEN valuation_anchor END, CASE WHEN high_anchor >= close * 1.02 THEN high_anchor END) AS target_1,
  least(greatest(close * (1 + greatest(0.08, buffer * 4)), CASE WHEN valuation_anchor >= close * 1.02 THEN valuation_anchor END, CASE WHEN high_anchor >= close * 1.02 THEN high_anchor END), close * 2) AS target_2a FROM anchors),
plans AS (SELECT symbol, expectation_state, operation_signal, support AS buy_low, greatest(support, CASE WHEN operation_signal = '{ops.WAIT}' THEN least(close, support * (1 + greatest(buffer * 0.75, 0.01))) ELSE close END) AS buy_high,
  close * (1 + least(greatest(buffer * 0.5, 0.01), 0.03)) AS no_chase_price, support * (1 - greatest(buffer, 0.025)) AS invalidation_price, valuation_anchor, target_1, CASE WHEN target_2a <= target_1 THEN target_1 * 1.05 ELSE target_2a END AS target_2 FROM targets)"""


@query("operation_plan", PLAN_CTES + f" SELECT symbol, expectation_state, operation_signal, {', '.join(f'round({n} + 1e-9, 6) + 0.0 AS {n}' for n in PLAN_NAMES)} FROM plans")
def operation_plan(spark: SparkSession, d: str) -> DataFrame:
    kept = materialise(pool(spark, d), "pool")  # one row a symbol, for the scores and for the plan
    rows = kept.join(ops.pool_scores(kept, ops.WEIGHTS), "symbol").withColumn("eps_ttm", F.col("close") / F.nullif("pe_ttm", F.lit(0.0)))
    # Parts of a mean over 60 closes end on a five in the seventh place now and then; those halves go up.
    return shown(ops.price_plan(rows).select("symbol", "expectation_state", "operation_signal", *[(F.col(n) + 1e-9).alias(n) for n in PLAN_NAMES]))


#: Phrases for the synthetic titles, in the same shape as the fixed rules.
DEMO_RULES = (("shareholder_reduction", ("the",)), ("earnings", ("tion", "ción")), ("dividend", ("und", "les")), ("repurchase", ("ing",)))
DEMO_AMBIGUOUS = ("que", "der")


def _sql_has(phrases) -> str:
    return "(" + " OR ".join(f"contains(title, '{p}')" for p in phrases) + ")"


@query("title_classify", "WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS title FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN {_sql_has(p)} THEN '{n}'" for n, p in DEMO_RULES) + f" WHEN {_sql_has(DEMO_AMBIGUOUS)} THEN NULL ELSE 'ignore' END AS category, CASE WHEN {' OR '.join(_sql_has(p) for _, p in DEMO_RULES)} THEN 'classified' WHEN {_sql_has(DEMO_AMBIGUOUS)} THEN 'pending' ELSE 'ignored' END AS status FROM t")
def title_classify(spark: SparkSession, d: str) -> DataFrame:
    category, status = ops.classify(F.col("text"), DEMO_RULES, DEMO_AMBIGUOUS)
    return table(spark, d, "documents").select("doc_id", category.alias("category"), status.alias("status"))


#: Titles, and by hand what the fixed rules make of them.
TITLES = (
    ("关于股东减持股份计划的公告", "shareholder_reduction", "classified"), ("控股股东增 持 公司股份", "shareholder_increase", "classified"), ("首次公开发行限售股上市流通提示", "unlock", "classified"),
    ("关于收到行政处罚决定书的公告", "regulatory", "classified"), ("2025年第三季度报告", "earnings", "classified"), ("2025年度业绩预告", "earnings", "classified"), ("年度利润分配方案", "dividend", "classified"),
    ("关于回购股份的进展", "repurchase", "classified"), ("部分股份解除质押", "pledge", "classified"), ("入选指数样本的提示", "index_change", "classified"), ("重大合同中标公示", "major_contract", "classified"),
    ("重大资产重组停牌", "major_event", "classified"), ("减持期间回购股份", "shareholder_reduction", "classified"), ("股票交易异常波动公告", None, "pending"), ("关于累计诉讼的公告", None, "pending"),
    ("关联交易及诉讼进展中的分红", "dividend", "classified"), ("董事会会议决议", "ignore", "ignored"), ("", "ignore", "ignored"), (None, "ignore", "ignored"),
)


@query("title_rules", "WITH t(i, category, status) AS (VALUES " + ", ".join(f"({i}, {'NULL' if c is None else repr(c)}, '{s}')" for i, (_, c, s) in enumerate(TITLES)) + f") SELECT doc_id, category, status FROM documents JOIN t ON i = doc_id % {len(TITLES)}")
def title_rules(spark: SparkSession, d: str) -> DataFrame:
    """The fixed title rules on titles of announcements, against verdicts written by hand."""
    titles = F.array(*[F.lit(t) for t, _, _ in TITLES])
    category, status = ops.classify(F.get(titles, (F.col("doc_id") % len(TITLES)).cast("int")))
    return table(spark, d, "documents").where("doc_id is not null").select("doc_id", category.alias("category"), status.alias("status"))


@query("pending_update", """WITH a AS (SELECT doc_id, source AS exchange, CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'classified' END AS status FROM documents),
r AS (SELECT doc_id, CASE quality WHEN 1 THEN 'earnings' ELSE 'pledge' END AS category, (doc_id % 10) / 10.0::DOUBLE AS confidence FROM labels)
SELECT a.doc_id, exchange, CASE WHEN status = 'pending' AND r.doc_id IS NOT NULL THEN 'classified' ELSE status END AS status,
  CASE WHEN status = 'pending' AND r.doc_id IS NOT NULL THEN CASE WHEN confidence < 0.65 THEN 'uncertain' ELSE category END END AS category FROM a LEFT JOIN r USING (doc_id)""")
def pending_update(spark: SparkSession, d: str) -> DataFrame:
    """Answers reach only rows that are still pending; one of little confidence is marked uncertain."""
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("exchange"), F.when(F.col("doc_id") % 4 == 0, "pending").otherwise("classified").alias("status"))
    answers = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "earnings").otherwise("pledge").alias("answer"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"))
    hit = (F.col("status") == "pending") & F.col("answer").isNotNull()
    return rows.join(answers, "doc_id", "left").select("doc_id", "exchange", F.when(hit, "classified").otherwise(F.col("status")).alias("status"), F.when(hit, F.when(F.col("confidence") < 0.65, "uncertain").otherwise(F.col("answer"))).alias("category"))


@query("alert_top2", """SELECT symbol, string_agg(txt, '；' ORDER BY rn) AS alerts FROM (SELECT lpad(user_id::VARCHAR, 6, '0') AS symbol, event_type || '@' || strftime(ts, '%m-%d') AS txt,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('error', 'purchase')) WHERE rn <= 2 GROUP BY 1""")
def alert_top2(spark: SparkSession, d: str) -> DataFrame:
    """The two latest alerts of each symbol in one text."""
    rows = table(spark, d, "events").where(F.col("event_type").isin("error", "purchase"))
    rows = rows.select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol"), "ts", "event_id", F.concat("event_type", F.lit("@"), F.date_format("ts", "MM-dd")).alias("txt"))
    top = latest_per_key(rows, ["symbol"], [F.desc("ts"), F.desc("event_id")], keep=2)
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("ts", "event_id", "txt"))))
    return top.groupBy("symbol").agg(F.array_join(F.transform(newest, lambda x: x["txt"]), "；").alias("alerts"))


#: Fixed windows of the demonstration calendar: label, first day, last day.
HOLIDAYS = (("new year", "1996-12-28", "1997-01-03"), ("spring", "1996-02-10", "1996-02-25"), ("autumn", "1996-09-28", "1996-10-08"))


@query("holiday_notes", "WITH h(label, a, b) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in HOLIDAYS) + ") SELECT o_orderdate::DATE AS trade_date, max(label) AS note, count(*) AS n_orders FROM orders LEFT JOIN h ON o_orderdate::DATE BETWEEN a AND b GROUP BY 1", dates="trade_date")
def holiday_notes(spark: SparkSession, d: str) -> DataFrame:
    """Days within fixed windows get the window's label; the few windows are a CASE, no join."""
    at = F.to_date("o_orderdate")
    return table(spark, d, "orders").groupBy(at.alias("trade_date")).agg(F.count(F.lit(1)).alias("n_orders")).withColumn("note", note_of("trade_date"))


def note_of(column: str):
    found = F.lit(None).cast("string")
    for label, a, b in HOLIDAYS:
        found = F.when((F.col(column) >= day(a)) & (F.col(column) <= day(b)), label).otherwise(found)
    return found


@query("display_table", FACTOR_CTES + " SELECT symbol, coalesce((round(ret_20 * 100, 1) + 0.0)::VARCHAR || '%', '') AS ret_shown, coalesce(printf('%.4f', close), '') AS close_shown FROM wide")
def display_table(spark: SparkSession, d: str) -> DataFrame:
    """Printed values; a missing one is an empty text."""
    rows = factor_table(spark, d, "ret_20", "close")
    return rows.select("symbol", F.coalesce(F.concat((F.round(F.col("ret_20") * 100, 1) + 0.0).cast("string"), F.lit("%")), F.lit("")).alias("ret_shown"), F.coalesce(F.format_string("%.4f", "close"), F.lit("")).alias("close_shown"))



@query("ordered_report", with_("bars", "instruments") + """ SELECT 'symbol|name|industry|history_days|market|last_volume' AS header, concat_ws('|', i.symbol, name, industry, count(*)::VARCHAR, market, arg_max(volume, trade_date)::VARCHAR) AS line
FROM instruments i JOIN bars b ON b.symbol = i.symbol GROUP BY i.symbol, name, industry, market""")
def ordered_report(spark: SparkSession, d: str) -> DataFrame:
    """A report's lines and header with the preferred columns first and the others after them."""
    by = bars(spark, d).groupBy("symbol").agg(F.max_by("volume", "trade_date").alias("last_volume"), F.count(F.lit(1)).alias("history_days"))
    rows = reports.in_preferred_order(instruments(spark, d).select("market", "symbol", "industry", "name").join(by, "symbol").select("market", "last_volume", "history_days", "industry", "symbol", "name"))
    return rows.select(F.lit("|".join(rows.columns)).alias("header"), F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns]).alias("line"))
