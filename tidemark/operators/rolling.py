"""Rolling technical features by symbol: five windows, at least one observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import change, rounded
from tidemark.operators.ordered import with_order
from tidemark.session import small_methods

#: The windows of all families, and the guard of their divisions.
WINDOWS = (5, 10, 20, 30, 60)
EPS = 1e-12


def _columns() -> tuple[Column, ...]:
    """Open, high, low, close and volume."""
    return *(F.col(c) for c in ("open", "high", "low", "close")), F.col("volume").cast("double")


#: Rows of a chunk of one symbol's history. A chunk starts with the rows before it that its windows reach.
CHUNK = 256
REACH = max(WINDOWS)


def order():
    """A symbol's whole history."""
    return Window.partitionBy("symbol").orderBy("trade_date")


def chunk():
    """One chunk of a symbol's history; partitioning by symbol serves it too, so it costs no shuffle of its own."""
    return Window.partitionBy("symbol", "chunk").orderBy("trade_date")


def base(panel: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The panel in chunks, with the daily steps that the families share and the columns to ``keep``.

    Row ``n`` of a symbol belongs to chunk ``(n - 1) div CHUNK``; the last rows
    of a chunk are in the next one as well, where they only lead in
    (``leads``). Sums run from the start of the chunk, so their size, and the
    loss of digits in their differences, does not grow with the history.
    """
    _, _, _, C, V = _columns()
    before, prior = F.lag("close").over(order()), F.lag("volume").over(order()).cast("double")
    at = F.floor((F.col("n") - 1) / CHUNK).cast("int")
    rows = panel.select(
        "symbol", "trade_date", "n", "open", "high", "low", "close", V.alias("volume"), (C - before).alias("delta"), (V - prior).alias("vdelta"), (C / before).alias("ret"),
        (F.abs(C / before - 1) * V).alias("weighted"), F.ln(V + 1).alias("log_v"), F.ln(V / F.nullif(prior, F.lit(0.0)) + 1).alias("log_ratio"),
        F.when(C > before, 1.0).otherwise(0.0).alias("up"), F.when(C < before, 1.0).otherwise(0.0).alias("down"), at.alias("own"), *keep,
    )
    late = (F.col("n") - 1) % CHUNK >= CHUNK - REACH
    rows = rows.withColumn("chunk", F.explode(F.when(late, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array(F.col("own")))))
    first = F.first("close", ignorenulls=True).over(chunk().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("*", (F.col("chunk") != F.col("own")).alias("leads"), (F.col("n") - F.col("chunk") * CHUNK).cast("double").alias("x"), (C - first).alias("y"))


class Sums:
    """Window sums as differences of running sums: each term is summed once for all windows, in constant time a row."""

    def __init__(self) -> None:
        self.terms: dict[str, Column] = {}
        self.wanted: dict[str, tuple[str, int]] = {}

    def __call__(self, name: str, term: Column, n: int) -> Column:
        """The sum of ``term`` over the last ``n`` rows; NULL terms add nothing."""
        self.terms[name] = term
        self.wanted[f"in_{name}_{n}"] = (name, n)
        return F.col(f"in_{name}_{n}")

    def count(self, name: str, term: Column, n: int) -> Column:
        return self(f"n_{name}", F.when(term.isNotNull(), 1.0).otherwise(0.0), n)

    def mean(self, name: str, term: Column, n: int) -> Column:
        return self(name, term, n) / F.nullif(self.count(name, term, n), F.lit(0.0))

    def squares(self, name: str, term: Column, n: int) -> Column:
        """The sum of squared deviations; what is within rounding of zero is zero."""
        total, square = self(name, term, n), self(f"{name}_square", term * term, n)
        found = square - total * total / F.nullif(self.count(name, term, n), F.lit(0.0))
        return F.when(found > square * 1e-13, found).otherwise(F.when(found.isNotNull(), 0.0))

    def spread(self, name: str, term: Column, n: int) -> Column:
        """Sample deviation; NULL for fewer than two values."""
        return F.sqrt(self.squares(name, term, n) / F.when(self.count(name, term, n) > 1, self.count(name, term, n) - 1))

    def add_to(self, rows: DataFrame) -> DataFrame:
        run = chunk().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({f"sum_{k}": F.sum(F.coalesce(t, F.lit(0.0))).over(run) for k, t in self.terms.items()})
        back = {k: F.lag(f"sum_{name}", n, 0.0).over(chunk()) for k, (name, n) in self.wanted.items()}
        return rows.withColumns(back).withColumns({k: F.col(f"sum_{name}") - F.col(k) for k, (name, _) in self.wanted.items()})


#: How each window's extremes come from a shorter window and the same one further back: window, shorter, rows back.
STEPS = ((10, 5, 5), (20, 10, 10), (30, 20, 10), (60, 30, 30))


def with_extremes(rows: DataFrame) -> DataFrame:
    """``top_n`` and ``bottom_n``: value and row of the first highest high and the first lowest low of each window."""
    w = chunk().rowsBetween(1 - WINDOWS[0], 0)
    high, low = F.struct(F.col("high").alias("v"), (-F.col("n")).alias("at")), F.struct((-F.col("low")).alias("v"), (-F.col("n")).alias("at"))
    rows = rows.withColumns({"top_5": F.max(F.when(F.col("high").isNotNull(), high)).over(w), "bottom_5": F.max(F.when(F.col("low").isNotNull(), low)).over(w)})
    for n, m, back in STEPS:
        rows = rows.withColumns({f"{k}_{n}": F.greatest(f"{k}_{m}", F.lag(f"{k}_{m}", back).over(chunk())) for k in ("top", "bottom")})
    return rows


def kbar() -> dict[str, Column]:
    O, H, L, C, _ = _columns()
    top, bottom, span = F.greatest(O, C), F.least(O, C), H - L + EPS
    return {
        "KMID": (C - O) / O, "KLEN": (H - L) / O, "KMID2": (C - O) / span, "KUP": (H - top) / O, "KUP2": (H - top) / span,
        "KLOW": (bottom - L) / O, "KLOW2": (bottom - L) / span, "KSFT": (2 * C - H - L) / O, "KSFT2": (2 * C - H - L) / span,
        "OPEN0": O / C, "HIGH0": H / C, "LOW0": L / C,
    }


def stats(n: int, sums: Sums) -> dict[str, Column]:
    C, y = F.col("close"), F.col("y")
    mean = C - y + sums.mean("y", y, n)
    return {"ROC": F.lag("close", n).over(chunk()) / C, "MA": mean / C, "STD": sums.spread("y", y, n) / C, "MAX": F.col(f"top_{n}.v") / C, "MIN": -F.col(f"bottom_{n}.v") / C}


def ols(n: int, sums: Sums) -> dict[str, Column]:
    """Least squares of the close on its position; the origins of both do not matter."""
    C, y = F.col("close"), F.col("y")
    x = F.when(y.isNotNull(), F.col("x"))
    sx, sy, m = sums("x", x, n), sums("y", y, n), F.nullif(sums.count("y", y, n), F.lit(0.0))
    sxx, syy, sxy = sums.squares("x", x, n), sums.squares("y", y, n), sums("xy", x * y, n) - sx * sy / m
    slope = sxy / F.nullif(sxx, F.lit(0.0))
    level = sy / m + slope * (F.col("x") - sx / m)
    return {"BETA": slope / C, "RSQR": F.when(syy > EPS, sxy * sxy / F.nullif(sxx * syy, F.lit(0.0))), "RESI": (y - level) / C}


#: Shares of the quantiles.
UPPER, LOWER = 0.8, 0.2


def quantiles(n: int, _sums: Sums) -> dict[str, Column]:
    """Interpolated quantiles of the window."""
    return {"QTLU": F.col(f"share_0_{n}") / F.col("close"), "QTLD": F.col(f"share_1_{n}") / F.col("close")}


def ranks(n: int, _sums: Sums) -> dict[str, Column]:
    """Midrank of the current close within its window."""
    return {"RANK": F.col(f"rank_{n}")}


def extremes(n: int, _sums: Sums) -> dict[str, Column]:
    """Place in the range, and where in the window its first extremes stand."""
    begin = F.greatest(F.col("n") - n, F.lit(0))
    high, low = F.col(f"top_{n}.v"), -F.col(f"bottom_{n}.v")
    top, bottom = (-F.col(f"top_{n}.at") - begin) / float(n), (-F.col(f"bottom_{n}.at") - begin) / float(n)
    return {"RSV": (F.col("close") - low) / (high - low + EPS), "IMAX": top, "IMIN": bottom, "IMXD": top - bottom}


def correlations(n: int, sums: Sums) -> dict[str, Column]:
    def corr(name: str, a: Column, b: Column) -> Column:
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        m = F.nullif(sums.count(f"{name}_a", a, n), F.lit(0.0))
        joint = sums(f"{name}_ab", a * b, n) - sums(f"{name}_a", a, n) * sums(f"{name}_b", b, n) / m
        scale = F.sqrt(sums.squares(f"{name}_a", a, n) / m) * F.sqrt(sums.squares(f"{name}_b", b, n) / m)
        return rounded(joint / m, 12) / F.nullif(rounded(scale, 12), F.lit(0.0))

    return {"CORR": corr("c", F.col("y"), F.col("log_v")), "CORD": corr("d", F.col("ret") - 1, F.col("log_ratio"))}


def _shares(step: str, n: int, sums: Sums) -> tuple[Column, Column, Column]:
    """Shares of the rises, of the falls and of their difference in all movement."""
    d = F.col(step)
    total = sums(f"{step}_all", F.abs(d), n)
    total = F.when(sums.count(step, d, n) > 0, total) + EPS
    up, down = sums(f"{step}_up", F.greatest(d, F.lit(0.0) * d), n), sums(f"{step}_down", F.greatest(-d, F.lit(0.0) * d), n)
    return up / total, down / total, (up - down) / total


def counts(n: int, sums: Sums) -> dict[str, Column]:
    up, down = (sums.mean(k, F.col(k), n) for k in ("up", "down"))
    gain, loss, net = _shares("delta", n, sums)
    return {"CNTP": up, "CNTN": down, "CNTD": up - down, "SUMP": gain, "SUMN": loss, "SUMD": net}


def volumes(n: int, sums: Sums) -> dict[str, Column]:
    V, weighted = F.col("volume"), F.col("weighted")
    gain, loss, net = _shares("vdelta", n, sums)
    return {
        "VMA": sums.mean("volume", V, n) / (V + EPS), "VSTD": sums.spread("volume", V, n) / (V + EPS),
        "WVMA": sums.spread("weighted", weighted, n) / (sums.mean("weighted", weighted, n) + EPS), "VSUMP": gain, "VSUMN": loss, "VSUMD": net,
    }


FAMILIES = (stats, ols, quantiles, ranks, extremes, correlations, counts, volumes)
#: Those that need the order of a window's values.
ORDERED = (quantiles, ranks)


def features(panel: DataFrame, families=FAMILIES, windows=WINDOWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``symbol, trade_date``, the columns of the panel to ``keep`` and the features; all windows share one sort by symbol, chunk and date.

    Ranks and quantiles, which go through Python, come last: rows that have
    been there must be dealt out again for a window. The other features pass
    as one array.
    """
    small_methods(panel.sparkSession)
    sums = Sums()
    columns = dict(kbar()) if families is FAMILIES else {}
    columns |= {f"{name}{n}": c for family in families for n in windows for name, c in family(n, sums).items()}
    late = {f"{name}{n}" for family in families if family in ORDERED for n in windows for name in family(n, sums)}
    rows = base(panel, keep)
    if {stats, extremes} & set(families):
        rows = with_extremes(rows)
    rows = sums.add_to(rows) if sums.wanted else rows
    if late:
        early = [k for k in columns if k not in late]
        made = [F.array(*[columns[k] for k in early]).alias("made")] if early else []
        rows = rows.select("symbol", "trade_date", "n", "chunk", "leads", "close", *keep, *made)  # nothing else goes through Python
        rows = with_order(rows, "close", tuple(windows), (UPPER, LOWER))
        columns |= {k: F.col("made")[i] for i, k in enumerate(early)}
    named = rows.select("symbol", "trade_date", "leads", *keep, *[c.alias(k) for k, c in columns.items()])
    return named.where(~F.col("leads")).drop("leads")


def label_columns(ahead: int = 5) -> dict[str, Column]:
    """Return from the next open to the open ``ahead`` days later, its last date, and eligibility by recent bars."""
    by = order()
    later = F.lead("open", ahead + 1).over(by)
    return {
        "label": change(later, F.lead("open", 1).over(by)), "label_end": F.lead("trade_date", ahead + 1).over(by),
        "eligible": F.count("close").over(by.rowsBetween(-64, 0)) >= 60,
    }


def forward_labels(panel: DataFrame, ahead: int = 5) -> DataFrame:
    """``symbol, trade_date`` and the label's columns."""
    return panel.select("symbol", "trade_date", *[c.alias(k) for k, c in label_columns(ahead).items()])
