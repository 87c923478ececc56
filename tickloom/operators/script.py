"""Indicator scripts as a table: inputs, levels, plots and search spaces by regular expressions.

scripts: (script, body). Lines that are comments do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_DISPLAY = "(?i)show|display|color|style|size|line"
#: Parts of the names of inputs that only change how a script looks.
_LOOKS = ("color", "show", "display", "plot", "line", "fill", "style", "width", "offset", "transp", "opacity")
_NUMBER = r"-?\d+(?:\.\d+)?"


def script_lines(scripts: DataFrame) -> DataFrame:
    rows = scripts.select("script", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    return rows.where(~F.trim("line").startswith("//"))


def _named(line: Column, name: str) -> Column:
    return F.regexp_extract(line, rf"{name}\s*=\s*({_NUMBER})", 1).try_cast("double")


def parameters(scripts: DataFrame) -> DataFrame:
    """(script, name, kind, default_value, title, min_value, max_value, step): one row per input.

    A missing minimum is 0, a missing maximum five times the default (100 for none); steps are 1 for
    whole numbers and a hundredth of the range for others."""
    pattern = r"^\s*(?:\w+\s+)?(\w+)\s*=\s*input\.(int|float|bool)\s*\((.*)$"
    rows = script_lines(scripts).where(F.col("line").rlike(pattern))
    rows = rows.select("script", "line_no", *[F.regexp_extract("line", pattern, k).alias(n) for k, n in ((1, "name"), (2, "kind"), (3, "rest"))])
    first = F.regexp_extract("rest", rf"^\s*(?:defval\s*=\s*)?({_NUMBER}|true|false)", 1)
    default = F.when(first == "true", F.lit(1.0)).when(first == "false", F.lit(0.0)).otherwise(first.try_cast("double"))
    title = F.regexp_extract("rest", r"""title\s*=\s*["']([^"']*)["']""", 1)
    rows = rows.withColumns({"default_value": default, "title": F.when(title == "", F.col("name")).otherwise(title)})
    low = F.coalesce(_named(F.col("rest"), "minval"), F.lit(0.0))
    high = F.coalesce(_named(F.col("rest"), "maxval"), F.when(F.col("default_value") == 0, F.lit(100.0)).otherwise(F.col("default_value") * 5))
    rows = rows.withColumns({"min_value": low, "max_value": high})
    step = F.coalesce(_named(F.col("rest"), "step"), F.when(F.col("kind") == "int", F.lit(1.0)).otherwise((F.col("max_value") - F.col("min_value")) / 100))
    return rows.withColumn("step", step).select("script", "line_no", "name", "kind", "default_value", "title", "min_value", "max_value", "step")


def optimizable(params: DataFrame) -> DataFrame:
    return params.where(~F.col("name").rlike(_DISPLAY) & ~F.col("title").rlike(_DISPLAY))


def member_inputs(params: DataFrame) -> DataFrame:
    """Inputs that a member brings into an ensemble: all but those of its looks."""
    return params.where(~F.lower("name").rlike("|".join(_LOOKS)))


def eligible(params: DataFrame, least: int = 2) -> DataFrame:
    """Scripts with enough parameters to search."""
    return optimizable(params).groupBy("script").agg(F.count("*").alias("n_params")).where(F.col("n_params") >= least)


def space_size(params: DataFrame) -> DataFrame:
    """Number of parameter vectors; a parameter without a step counts 100 values."""
    steps = F.when(F.col("kind") == "bool", F.lit(2.0)).when(F.col("step") > 0, F.floor((F.col("max_value") - F.col("min_value")) / F.col("step") + 1e-9) + 1).otherwise(F.lit(100.0))
    return params.groupBy("script").agg(F.round(F.exp(F.sum(F.ln(F.greatest(steps.cast("double"), F.lit(1.0)))))).cast("long").alias("space"))


def signals(scripts: DataFrame) -> DataFrame:
    """(script, version, title, n_levels, signal_type): discrete shapes, threshold levels, or a
    direction."""
    body = F.col("body")
    shape = r"(?i)plotshape\s*\([^\n]*(?:buy|bull|long|up|sell|bear|short|down)"
    version = F.regexp_extract(body, r"//@version=(\d+)", 1).try_cast("int")
    title = F.regexp_extract(body, r"""indicator\s*\(\s*(?:title\s*=\s*)?["']([^"']*)["']""", 1)
    levels = F.size(F.regexp_extract_all(body, F.lit(rf"hline\s*\(\s*({_NUMBER})"), F.lit(1)))
    return scripts.select(
        "script", F.coalesce(version, F.lit(5)).alias("version"), title.alias("title"), levels.alias("n_levels"),
        F.when(body.rlike(shape), "discrete").when(levels > 0, "threshold").otherwise("directional").alias("signal_type"),
    )


def rewrite_default(body: Column, name: Column, value: Column) -> Column:
    """The script with the default of one input replaced."""
    pattern = F.concat(F.lit(r"(\b"), name, F.lit(rf"\s*=\s*input\.(?:int|float)\s*\(\s*(?:defval\s*=\s*)?){_NUMBER}"))
    return F.regexp_replace(body, pattern, F.concat(F.lit("$1"), value.cast("string")))


def number_text(x: Column) -> Column:
    """A number as a script's default: more digits the smaller it is."""
    size = F.abs(x)
    return F.when(size < 0.01, F.format_string("%.6f", x)).when(size < 1, F.format_string("%.4f", x)).otherwise(F.format_string("%.2f", x))


def optimised(body: Column, values: Column, header: Column) -> Column:
    """The script with the defaults of a map (name to double), its header after the version line (or
    before all) and `Optimised` before its title. Names without an input change nothing."""

    def replaced(text: Column, kv: Column) -> Column:
        for kind, value in (("int", kv["value"].cast("long").cast("string")), ("float", number_text(kv["value"])), ("bool", F.when(kv["value"] != 0, "true").otherwise("false"))):
            pattern = F.concat(F.lit(r"(\b\Q"), kv["key"], F.lit(rf"\E\s*=\s*input\.{kind}\s*\(\s*(?:defval\s*=\s*)?)(?:{_NUMBER}|true|false)"))
            text = F.regexp_replace(text, pattern, F.concat(F.lit("$1"), value))
        return text

    text = F.aggregate(F.map_entries(F.coalesce(values, F.create_map().cast("map<string,double>"))), body, replaced)
    text = F.regexp_replace(text, r"""(indicator\s*\(\s*(?:title\s*=\s*)?["'])(?!Optimised )""", "$1Optimised ")
    version = F.regexp_extract(text, r"//@version=\d+", 0)
    at = F.instr(text, "//@version=") - 1 + F.length(version)
    return F.when(version == "", F.concat(header, F.lit("\n"), text)).otherwise(F.concat(F.substring(text, F.lit(1), at), F.lit("\n"), header, F.substring(text, at + 1, F.length(text))))


def calculations(scripts: DataFrame) -> DataFrame:
    """(script, line_no, name, expression) of assignments that call the series or number functions."""
    pattern = r"^\s*(?:var\s+)?(?:\w+\s+)?(\w+)\s*:?=\s*(.*\b(?:ta|math)\.\w+.*)$"
    rows = script_lines(scripts).where(F.col("line").rlike(pattern))
    return rows.select("script", "line_no", F.regexp_extract("line", pattern, 1).alias("name"), F.trim(F.regexp_extract("line", pattern, 2)).alias("expression"))


def described(scripts: DataFrame) -> DataFrame:
    """(script, overlay, functions): whether it draws on the prices, and the functions it defines."""
    body = F.col("body")
    named = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*(\w+)\s*\([^)\n]*\)\s*=>"), F.lit(1))
    return scripts.select("script", body.rlike(r"(?i)overlay\s*=\s*true").alias("overlay"), named.alias("functions"))


#: Inputs that a script with too few gets, and the two lines before its first plot.
_SMOOTHING = ('smooth_len = input.int(5, title="Smooth Len", minval=1, maxval=50)', 'scale_mult = input.float(1.0, title="Scale Mult", minval=0.1, maxval=3.0)')
_PLOT = r"(?m)^[ \t]*plot\s*\(\s*([^,)\n]+)"


def widened(scripts: DataFrame, least: int = 2) -> DataFrame:
    """scripts in which those with fewer than `least` numeric inputs to search get two more, a length
    and a factor: what they plot first is smoothed by the one and scaled by the other. A script that
    plots nothing, or a number, plots the close so; one that has such an input keeps it."""
    counts = optimizable(parameters(scripts)).where("kind <> 'bool'").groupBy("script").agg(F.count("*").alias("__n"))
    rows = scripts.join(counts, "script", "left")
    body = F.col("body")
    plotted = F.trim(F.regexp_extract(body, _PLOT, 1))
    base = F.when((plotted == "") | plotted.rlike(rf"^{_NUMBER}$"), "close").otherwise(plotted)
    lines = F.concat(F.lit("smoothed = ta.sma("), base, F.lit(", smooth_len)\nscaled = smoothed * scale_mult\n"))
    at = F.instr(body, F.regexp_extract(body, r"(?m)^[ \t]*plot\s*\(", 0))
    before, after = F.substring(body, F.lit(1), at - 1), F.substring(body, at, F.length(body))
    replaced = F.concat(before, lines, F.regexp_extract(after, r"^[ \t]*plot\s*\(\s*", 0), F.lit("scaled"), F.substring(after, F.length(F.regexp_extract(after, r"^[ \t]*plot\s*\(\s*[^,)\n]+", 0)) + 1, F.length(after)))
    logic = F.when(plotted == "", F.concat(lines, F.lit('plot(scaled, "Signal")\n'), body)).otherwise(replaced)
    inputs = F.concat(*[F.when(body.contains(f"{x.split(' ')[0]} = input"), "").otherwise(x + "\n") for x in _SMOOTHING])
    head = F.regexp_extract(logic, r"(?s)^(.*?indicator\s*\([^\n]*\n)", 1)
    text = F.concat(head, inputs, F.substring(logic, F.length(head) + 1, F.length(logic)))
    return rows.withColumn("body", F.when(F.coalesce("__n", F.lit(0)) < least, text).otherwise(body)).drop("__n")


#: Expressions of a member's value around zero, by its kind.
_VALUES = {
    "rsi": "ta.rsi(close, {n}) - 50", "cci": "ta.cci(hlc3, {n})", "mfi": "ta.mfi(hlc3, {n}) - 50", "macd": "ta.ema(close, 12) - ta.ema(close, 26)", "roc": "ta.roc(close, {n})",
}


def ensemble_scripts(members: DataFrame, by: list[str], rule: str = "majority", threshold: float = 0.5) -> DataFrame:
    """(by, body): one script a group of members (by, rank, name, score, kind, length): an input to
    switch each on and one for its length, their crossings of zero as votes, and the vote's signals
    and alerts. Members come in the order of rank and name; other kinds are rates of change."""
    value = F.coalesce(*[F.when(F.col("kind") == k, F.replace(F.lit(text), F.lit("{n}"), F.concat(F.lit("m"), F.col("__k"), F.lit("_length")))) for k, text in _VALUES.items()], F.concat(F.lit("ta.roc(close, m"), F.col("__k"), F.lit("_length)")))
    order = Window.partitionBy(*by).orderBy("rank", "name")
    m = members.withColumn("__k", F.row_number().over(order).cast("string"))
    k = F.concat(F.lit("m"), F.col("__k"))
    parts = {
        "source": F.concat(F.lit("//   "), F.col("__k"), F.lit(". "), "name", F.lit(": "), F.format_string("%.4f", F.col("score"))),
        "inputs": F.concat(k, F.lit('_on = input.bool(true, "'), "name", F.lit('")\n'), k, F.lit("_length = input.int("), F.greatest("length", F.lit(1)).cast("string"), F.lit(', "Length", minval=1)')),
        "lines": F.concat(k, F.lit(" = "), value, F.lit("\n"), k, F.lit("_buy = "), k, F.lit("_on and ta.crossover("), k, F.lit(", 0)\n"), k, F.lit("_sell = "), k, F.lit("_on and ta.crossunder("), k, F.lit(", 0)")),
        "on": F.concat(F.lit("("), k, F.lit("_on ? 1 : 0)")), "buys": F.concat(F.lit("("), k, F.lit("_buy ? 1 : 0)")), "sells": F.concat(F.lit("("), k, F.lit("_sell ? 1 : 0)")),
    }
    rows = m.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("__k").cast("int").alias("k"), *[x.alias(c) for c, x in parts.items()]))).alias("m"))
    each = lambda c, between="\n": F.array_join(F.transform("m", lambda x: x[c]), between)
    held = {"majority": "{x} > 0.5", "unanimous": "{x} >= 1", "weighted": f"{{x}} >= {threshold}"}[rule]
    body = F.concat(
        F.lit("//@version=6\n// Ensemble by "), F.lit(rule), F.lit(" of\n"), each("source"), F.lit('\nindicator("Ensemble", overlay=false)\n'), each("inputs"), F.lit("\n"), each("lines"),
        F.lit("\nvoters = math.max("), each("on", " + "), F.lit(", 1)\nbuys = ("), each("buys", " + "), F.lit(") / voters\nsells = ("), each("sells", " + "), F.lit(") / voters\n"),
        F.lit(f"buy = {held.format(x='buys')}\nsell = {held.format(x='sells')}\nplot(buys - sells, \"Strength\")\nplotshape(buy, \"Buy\")\nplotshape(sell, \"Sell\")\nalertcondition(buy, \"Buy\")\nalertcondition(sell, \"Sell\")\n"),
    )
    return rows.select(*by, body.alias("body"))
