"""Factor formulas as text, compiled to columns over one sort of the panel.

A formula is a Python expression over fields (``$close``), numbers, ``+ - * /``,
``<`` and ``>``, and the functions of ``FUNCTIONS``; Python's own parser reads
it, and whatever is not on the list is refused. Equal parts of all formulas are
computed once.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators.rolling import CHUNK, EPS, WINDOWS, Sums, chunk, order
from tidemark.session import small_methods

#: Fields of a bar that formulas may name.
FIELDS = ("open", "high", "low", "close", "volume", "amount")
#: Functions and their arguments: e for an expression, n for a number of rows, q for a share.
FUNCTIONS = {
    "Ref": "en", "Mean": "en", "Sum": "en", "Std": "en", "Max": "en", "Min": "en", "IdxMax": "en", "IdxMin": "en", "Rank": "en", "Quantile": "enq",
    "Slope": "en", "Rsquare": "en", "Resi": "en", "Corr": "een", "Greater": "ee", "Less": "ee", "Abs": "e", "Log": "e",
}
POINTWISE = ("Greater", "Less", "Abs", "Log")
MAX_ROWS = 2_000
#: Parts of one formula; deeper nesting is refused before anything is planned.
MAX_PARTS = 500

OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Lt: "<", ast.Gt: ">"}

#: A formula's part: a tuple of its kind, its parameters and its parts, so that equal parts are equal.
Part = tuple


class FormulaError(ValueError):
    """A formula that is not within the language."""


def parse(text: str, fields: tuple[str, ...] = FIELDS) -> Part:
    """The parts of a formula, checked against the fields, functions and bounds above."""
    try:
        tree = ast.parse(re.sub(r"\$(?=[A-Za-z_])", "", text.strip()), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as wrong:
        raise FormulaError(f"not an expression: {text!r}") from wrong
    if sum(1 for _ in ast.walk(tree)) > 6 * MAX_PARTS:
        raise FormulaError(f"over {MAX_PARTS} parts")
    return _part(tree, fields)


def _number(node: ast.expr) -> float | int | None:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        value = _number(node.operand)
        return None if value is None else -value
    return node.value if isinstance(node, ast.Constant) and type(node.value) in (int, float) else None


def _part(node: ast.expr, fields: tuple[str, ...]) -> Part:
    if (value := _number(node)) is not None:
        if not abs(value) < 1e300:
            raise FormulaError(f"number out of range: {value}")
        return ("number", float(value))
    if isinstance(node, ast.Name):
        if node.id not in fields:
            raise FormulaError(f"unknown field: {node.id}")
        return ("field", node.id)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        inner = _part(node.operand, fields)
        return ("-", ("number", 0.0), inner) if isinstance(node.op, ast.USub) else inner
    if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
        return (OPERATORS[type(node.op)], _part(node.left, fields), _part(node.right, fields))
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in OPERATORS:
        return (OPERATORS[type(node.ops[0])], _part(node.left, fields), _part(node.comparators[0], fields))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords and node.func.id in FUNCTIONS:
        return _call(node.func.id, node.args, fields)
    raise FormulaError(f"not allowed: {ast.unparse(node)}")


def _call(name: str, args: list[ast.expr], fields: tuple[str, ...]) -> Part:
    kinds = FUNCTIONS[name]
    if len(args) != len(kinds):
        raise FormulaError(f"{name} takes {len(kinds)} arguments")
    parts, params = [], []
    for kind, arg in zip(kinds, args, strict=True):
        if kind == "e":
            parts.append(_part(arg, fields))
            continue
        value = _number(arg)
        if kind == "n" and not (type(value) is int and 1 <= value <= MAX_ROWS):
            raise FormulaError(f"{name} needs a number of rows from 1 to {MAX_ROWS}")
        if kind == "q" and not (value is not None and 0 <= value <= 1):
            raise FormulaError(f"{name} needs a share from 0 to 1")
        params.append(value)
    return (name, *params, *parts)


def _inner(part: Part) -> list[Part]:
    return [x for x in part[1:] if isinstance(x, tuple)]


def _windowed(part: Part) -> bool:
    return part[0] in FUNCTIONS and part[0] not in POINTWISE


def depth(part: Part) -> int:
    """How many windows lie inside one another."""
    return max((depth(x) for x in _inner(part)), default=0) + _windowed(part)


def reach(part: Part) -> int:
    """How many rows before its own a value needs."""
    own = (part[1] if part[0] == "Ref" else part[1] - 1) if _windowed(part) else 0
    return own + max((reach(x) for x in _inner(part)), default=0)


def _all(parts: list[Part]) -> list[Part]:
    """All different parts, inner ones first."""
    seen: dict[Part, None] = {}

    def visit(part: Part) -> None:
        if part not in seen:
            for x in _inner(part):
                visit(x)
            seen[part] = None

    for part in parts:
        visit(part)
    return list(seen)


class Compiler:
    """Columns for parts; each windowed part becomes a column of the rows, level by level."""

    def __init__(self, parts: list[Part]) -> None:
        self.windowed = [p for p in _all(parts) if _windowed(p)]
        self.names = {p: f"w_{k}" for k, p in enumerate(self.windowed)}
        arguments = dict.fromkeys(x for p in self.windowed for x in _inner(p))
        self.args = {x: f"a_{k}" for k, x in enumerate(arguments)}

    def column(self, part: Part) -> Column:
        """A part over fields and windowed columns that are there already. A comparison is 1 or 0, also beside a missing value."""
        kind = part[0]
        if kind == "number":
            return F.lit(part[1])
        if kind == "field":
            return F.col(part[1]).cast("double")
        if part in self.names:
            return F.col(self.names[part])
        a, *more = (self.column(x) for x in _inner(part))
        b = more[0] if more else None
        pointwise: dict[str, Callable[[], Column]] = {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / F.nullif(b, F.lit(0.0)),
            "<": lambda: F.when(a < b, 1.0).otherwise(0.0), ">": lambda: F.when(a > b, 1.0).otherwise(0.0),
            "Greater": lambda: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), "Less": lambda: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
            "Abs": lambda: F.abs(a), "Log": lambda: F.ln(a),
        }
        return pointwise[kind]()

    def add_level(self, rows: DataFrame, level: int) -> DataFrame:
        """The windowed parts of one depth, from arguments that are plain columns."""
        parts = [p for p in self.windowed if depth(p) == level]
        fresh = [x for x in dict.fromkeys(x for p in parts for x in _inner(p)) if self.args[x] not in rows.columns]
        rows = rows.withColumns({self.args[x]: self.column(x) for x in fresh})
        run = chunk().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # Sums are of differences from a chunk's first value, which keeps their digits.
        rows = rows.withColumns({f"{self.args[x]}_from": F.first(self.args[x], ignorenulls=True).over(run) for x in fresh})
        rows = self._extremes(self._lists(rows, parts), parts)
        sums = Sums()
        made = {self.names[p]: self._value(p, sums) for p in parts}
        return sums.add_to(rows).withColumns(made) if sums.wanted else rows.withColumns(made)

    def _lists(self, rows: DataFrame, parts: list[Part]) -> DataFrame:
        longest: dict[str, int] = {}
        for p in parts:
            if p[0] in ("Rank", "Quantile"):
                name = self.args[_inner(p)[0]]
                longest[name] = max(longest.get(name, 0), p[1])
        return rows.withColumns({f"{x}_seen": F.collect_list(x).over(chunk().rowsBetween(1 - n, 0)) for x, n in longest.items()})

    def _extremes(self, rows: DataFrame, parts: list[Part]) -> DataFrame:
        """Value and row of the first highest and lowest value of each window, from those of shorter windows."""
        wanted: dict[tuple[str, str], set[int]] = {}
        for p in parts:
            if p[0] in ("Max", "IdxMax", "Min", "IdxMin"):
                wanted.setdefault((self.args[_inner(p)[0]], "top" if "Max" in p[0] else "low"), set()).add(p[1])
        chains = {key: _chain(sizes) for key, sizes in wanted.items()}
        for step in range(max(map(len, chains.values()), default=0)):
            new = {}
            for (name, kind), chain in chains.items():
                if step < len(chain):
                    n, m = chain[step]
                    value = F.col(name) if kind == "top" else -F.col(name)
                    own = F.when(F.col(name).isNotNull(), F.struct(value.alias("v"), (-F.col("n")).alias("at")))
                    shorter = f"{name}_{kind}_{m}"
                    new[f"{name}_{kind}_{n}"] = F.greatest(shorter, F.lag(shorter, n - m).over(chunk())) if m else own
            rows = rows.withColumns(new)
        return rows

    def _value(self, part: Part, sums: Sums) -> Column:
        kind, n = part[0], part[1]
        name = self.args[_inner(part)[0]]
        x, origin = F.col(name), F.col(f"{name}_from")
        y = x - origin
        if kind == "Ref":
            return F.lag(name, n).over(chunk())
        if kind in ("Max", "IdxMax"):
            best = F.col(f"{name}_top_{n}")
            return best["v"] if kind == "Max" else self._place(best, n)
        if kind in ("Min", "IdxMin"):
            best = F.col(f"{name}_low_{n}")
            return -best["v"] if kind == "Min" else self._place(best, n)
        if kind in ("Rank", "Quantile"):
            seen = F.col(f"{name}_seen")
            return _rank(x, seen, n) if kind == "Rank" else _quantile(seen, n, part[2])
        if kind == "Mean":
            return origin + sums.mean(name, y, n)
        if kind == "Sum":
            return F.when(sums.count(name, y, n) > 0, sums(f"{name}_raw", x, n))
        if kind == "Std":
            return sums.spread(name, y, n)
        if kind == "Corr":
            other = self.args[_inner(part)[-1]]
            return _corr(sums, f"{name}_{other}", y, F.col(other) - F.col(f"{other}_from"), n)
        return _line(kind, sums, name, y, n)

    @staticmethod
    def _place(best: Column, n: int) -> Column:
        """From 1: where in the window the value stands, counted from its first row that there is."""
        return (-best["at"] - F.greatest(F.col("n") - n, F.lit(0))).cast("double")


def _chain(sizes: set[int]) -> list[tuple[int, int]]:
    """(size, shorter size) in an order in which each size is at most twice a shorter one; from single rows up."""
    chain, have = [(1, 0)], 1
    for n in sorted(sizes):
        while n > have:
            step = n if n <= 2 * have else 2 * have
            chain.append((step, have))
            have = step
    return chain


def _last(seen: Column, n: int) -> Column:
    size = F.least(F.size(seen), F.lit(n))
    return F.slice(seen, F.size(seen) - size + 1, size)


def _rank(x: Column, seen: Column, n: int) -> Column:
    """Midrank of the current value as a share of the window's values. Expects a list without gaps."""
    values = _last(seen, n)
    less, same = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
    return F.when(x.isNotNull(), (less + (same + 1) / 2) / F.size(values))


def _quantile(seen: Column, n: int, share: float) -> Column:
    ordered = F.array_sort(_last(seen, n))
    place = (F.size(ordered) - 1) * share
    low = F.floor(place).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return below + (above - below) * (place - low)


def _corr(sums: Sums, name: str, a: Column, b: Column, n: int) -> Column:
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    m = F.nullif(sums.count(f"{name}_a", a, n), F.lit(0.0))
    joint = sums(f"{name}_ab", a * b, n) - sums(f"{name}_a", a, n) * sums(f"{name}_b", b, n) / m
    scale = F.sqrt(sums.squares(f"{name}_a", a, n) / m) * F.sqrt(sums.squares(f"{name}_b", b, n) / m)
    return rounded(joint / m, 12) / F.nullif(rounded(scale, 12), F.lit(0.0))


def _line(kind: str, sums: Sums, name: str, y: Column, n: int) -> Column:
    """Least squares of the values on their rows; a window without spread has no share explained."""
    x = F.when(y.isNotNull(), F.col("x"))
    sx, sy, m = sums(f"{name}_x", x, n), sums(name, y, n), F.nullif(sums.count(name, y, n), F.lit(0.0))
    sxx, syy, sxy = sums.squares(f"{name}_x", x, n), sums.squares(name, y, n), sums(f"{name}_xy", x * y, n) - sx * sy / m
    slope = sxy / F.nullif(sxx, F.lit(0.0))
    if kind == "Slope":
        return slope
    if kind == "Rsquare":
        return F.when(syy > EPS, sxy * sxy / F.nullif(sxx * syy, F.lit(0.0)))
    return y - (sy / m + slope * (F.col("x") - sx / m))


def in_chunks(panel: DataFrame, columns: list[str], lead: int) -> DataFrame:
    """The panel's rows in chunks of one symbol's history, each led in by the ``lead`` rows before it."""
    size = max(CHUNK, lead)
    numbered = panel.withColumn("n", F.row_number().over(order()))
    own = F.floor((F.col("n") - 1) / size).cast("int")
    late = (F.col("n") - 1) % size >= size - lead
    rows = numbered.select("symbol", "trade_date", "n", *columns, own.alias("own"), F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("chunk"))
    return rows.select("*", (F.col("chunk") != F.col("own")).alias("leads"), (F.col("n") - F.col("chunk") * size).cast("double").alias("x"))


def evaluate(panel: DataFrame, formulas: dict[str, str], keep: tuple[str, ...] = (), fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``symbol, trade_date``, the columns in ``keep``, and one column for each formula.

    ``panel`` has one row for each symbol and date. Windows count a symbol's
    rows and need one value at least; a division by zero gives NULL, and so
    does a value that has no rows to come from. All windows share one
    partitioning and sort by symbol, and sums over them cost the same whatever
    their length. Equal parts, within a formula or in several, are one column.
    """
    parts = {name: parse(text, fields) for name, text in formulas.items()}
    compiler = Compiler(list(parts.values()))
    used = list(dict.fromkeys([*(p[1] for p in _all(list(parts.values())) if p[0] == "field"), *keep]))
    if not compiler.windowed:
        return panel.select("symbol", "trade_date", *keep, *[compiler.column(p).alias(name) for name, p in parts.items()])
    small_methods(panel.sparkSession)
    rows = in_chunks(panel, used, max(map(reach, parts.values())))
    for level in range(1, max(map(depth, parts.values())) + 1):
        rows = compiler.add_level(rows, level)
    named = rows.select("symbol", "trade_date", "leads", *keep, *[compiler.column(p).alias(name) for name, p in parts.items()])
    return named.where(~F.col("leads")).drop("leads")


def matching(panel: DataFrame, formula: str, keep: tuple[str, ...] = (), fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``symbol, trade_date`` and ``keep`` of the rows for which a formula, as a rule a comparison, is neither 0 nor missing."""
    found = evaluate(panel, {"formula_value": formula}, keep, fields)
    return found.where((F.col("formula_value") != 0) & ~F.isnan("formula_value")).drop("formula_value")


def feature_formulas(windows: tuple[int, ...] = WINDOWS) -> dict[str, str]:
    """The formulas of the features that ``tidemark.operators.rolling`` builds."""
    span, top, bottom = "($high-$low+1e-12)", "Greater($open,$close)", "Less($open,$close)"
    out = {
        "KMID": "($close-$open)/$open", "KLEN": "($high-$low)/$open", "KMID2": f"($close-$open)/{span}", "KUP": f"($high-{top})/$open", "KUP2": f"($high-{top})/{span}",
        "KLOW": f"({bottom}-$low)/$open", "KLOW2": f"({bottom}-$low)/{span}", "KSFT": "(2*$close-$high-$low)/$open", "KSFT2": f"(2*$close-$high-$low)/{span}",
        "OPEN0": "$open/$close", "HIGH0": "$high/$close", "LOW0": "$low/$close",
    }
    move, flow = "($close-Ref($close,1))", "($volume-Ref($volume,1))"
    weighted = "Abs($close/Ref($close,1)-1)*$volume"
    by_window = {
        "ROC": "Ref($close,{n})/$close", "MA": "Mean($close,{n})/$close", "STD": "Std($close,{n})/$close", "MAX": "Max($high,{n})/$close", "MIN": "Min($low,{n})/$close",
        "BETA": "Slope($close,{n})/$close", "RSQR": "Rsquare($close,{n})", "RESI": "Resi($close,{n})/$close", "QTLU": "Quantile($close,{n},0.8)/$close", "QTLD": "Quantile($close,{n},0.2)/$close",
        "RANK": "Rank($close,{n})", "RSV": "($close-Min($low,{n}))/(Max($high,{n})-Min($low,{n})+1e-12)", "IMAX": "IdxMax($high,{n})/{n}", "IMIN": "IdxMin($low,{n})/{n}", "IMXD": "(IdxMax($high,{n})-IdxMin($low,{n}))/{n}",
        "CORR": "Corr($close,Log($volume+1),{n})", "CORD": "Corr($close/Ref($close,1),Log($volume/Ref($volume,1)+1),{n})",
        "CNTP": "Mean($close>Ref($close,1),{n})", "CNTN": "Mean($close<Ref($close,1),{n})", "CNTD": "Mean($close>Ref($close,1),{n})-Mean($close<Ref($close,1),{n})",
        "VMA": "Mean($volume,{n})/($volume+1e-12)", "VSTD": "Std($volume,{n})/($volume+1e-12)", "WVMA": f"Std({weighted},{{n}})/(Mean({weighted},{{n}})+1e-12)",
    }
    for name, step in (("SUM", move), ("VSUM", flow)):
        up, down, total = f"Sum(Greater({step},0),{{n}})", f"Sum(Greater(0-{step},0),{{n}})", f"(Sum(Abs({step}),{{n}})+1e-12)"
        by_window |= {f"{name}P": f"{up}/{total}", f"{name}N": f"{down}/{total}", f"{name}D": f"({up}-{down})/{total}"}
    return out | {f"{k}{n}": text.replace("{n}", str(n)) for k, text in by_window.items() for n in windows}
