"""Queries of the adaptive averages, Fisher's transform, volume indexes and streaks."""

from __future__ import annotations

from tickloom.operators import adaptive, fold
from tickloom.plans.evaluation_queries import KEY, shown
from tickloom.plans.registry import register
from tickloom.plans.series_queries import bars
from tickloom.plans.sql import BARS, LAG, O, rows


def _path(n: int) -> str:
    return f"CASE WHEN count(step) OVER {rows(n)} = {n} THEN CASE WHEN sum(abs(step)) OVER {rows(n)} > 0 THEN abs(sum(step) OVER {rows(n)}) / sum(abs(step)) OVER {rows(n)} ELSE 0 END END"


def _spread(first: int, last: int) -> str:
    frame = f"({O} ROWS BETWEEN {first} PRECEDING AND {last} PRECEDING)"
    return f"(max(high) OVER {frame} - min(low) OVER {frame}) / {first - last + 1}"


def _follow(name: str, first: int) -> str:
    return f"""{name} AS (SELECT symbol, bar_index, close AS y FROM g WHERE bar_index = {first} UNION ALL
SELECT g.symbol, g.bar_index, p.y + g.{name}_gain * (g.close - p.y) FROM {name} p JOIN g ON g.symbol = p.symbol AND g.bar_index = p.bar_index + 1)"""


_GAINS = f"""t AS (SELECT *, close - lag(close) OVER {LAG} AS step, {_spread(7, 0)} + {_spread(15, 8)} AS halves, {_spread(15, 0)} AS whole FROM b),
g AS (SELECT *, pow(({_path(10)}) * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2) AS kama_gain, ({_path(9)}) * (2.0::DOUBLE / 10) AS vidya_gain,
CASE WHEN bar_index >= 15 THEN greatest(least(exp(-4.6::DOUBLE * (CASE WHEN halves > 0 AND whole > 0 THEN ln(halves / whole) / ln(2.0::DOUBLE) ELSE 1 END - 1)), 1), 0.01::DOUBLE) END AS frama_gain FROM t)"""
_DYNAMIC = """mg AS (SELECT symbol, bar_index, close AS y FROM b WHERE bar_index = 0 UNION ALL
SELECT b.symbol, b.bar_index, CASE WHEN p.y <= 0 THEN b.close ELSE p.y + (b.close - p.y) / greatest(14 * pow(b.close / p.y, 4), 1) END FROM mg p JOIN b ON b.symbol = p.symbol AND b.bar_index = p.bar_index + 1)"""
register("f08_adaptive_averages", lambda s, d: shown(adaptive.averages(bars(s, d)), *KEY, "kama", "vidya", "frama", "mcginley", digits=4),
         f"""WITH RECURSIVE {BARS}, {_GAINS}, {_follow('kama', 10)}, {_follow('vidya', 9)}, {_follow('frama', 15)}, {_DYNAMIC}
SELECT b.symbol, b.bar_index, round(kama.y, 4) AS kama, round(vidya.y, 4) AS vidya, round(frama.y, 4) AS frama, round(mg.y, 4) AS mcginley
FROM b LEFT JOIN kama USING (symbol, bar_index) LEFT JOIN vidya USING (symbol, bar_index) LEFT JOIN frama USING (symbol, bar_index) LEFT JOIN mg USING (symbol, bar_index)""")  # fmt: skip

_HELD = "greatest(least(0.33::DOUBLE * pl.place + 0.67::DOUBLE * {}, 0.999::DOUBLE), -0.999::DOUBLE)"
_FISHER = f"""m AS (SELECT *, (high + low) / 2 AS mid FROM b),
pl AS (SELECT *, CASE WHEN max(mid) OVER {rows(9)} > min(mid) OVER {rows(9)} THEN 2 * (mid - min(mid) OVER {rows(9)}) / (max(mid) OVER {rows(9)} - min(mid) OVER {rows(9)}) - 1 ELSE 0 END AS place FROM m),
fi AS (SELECT symbol, bar_index, {_HELD.format('0.0::DOUBLE')} AS v, 0.5::DOUBLE * ln((1 + {_HELD.format('0.0::DOUBLE')}) / (1 - {_HELD.format('0.0::DOUBLE')})) AS y FROM pl WHERE bar_index = 0 UNION ALL
SELECT pl.symbol, pl.bar_index, {_HELD.format('p.v')}, 0.5::DOUBLE * ln((1 + {_HELD.format('p.v')}) / (1 - {_HELD.format('p.v')})) + 0.5::DOUBLE * p.y FROM fi p JOIN pl ON pl.symbol = p.symbol AND pl.bar_index = p.bar_index + 1)"""
register("f08_fisher", lambda s, d: shown(fold.fold(adaptive.with_place(bars(s, d)), lambda b: {"fisher": adaptive.fisher(b["place"])}, ["fisher"]), *KEY, "fisher", digits=4),
         f"WITH RECURSIVE {BARS}, {_FISHER} SELECT symbol, bar_index, round(y, 4) AS fisher FROM fi")

_SOUND = "was > 0 AND close > 0"
_CUM = f"({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
register("f08_volume_indexes", lambda s, d: shown(adaptive.with_volume_indexes(bars(s, d)), *KEY, "pvt", "nvi_log", "pvi_log", digits=4),
         f"""WITH {BARS}, t AS (SELECT *, lag(close) OVER {LAG} AS was, lag(volume) OVER {LAG} AS vol FROM b)
SELECT symbol, bar_index, round(coalesce(sum(CASE WHEN {_SOUND} THEN volume * (close - was) / was END) OVER {_CUM}, 0), 4) AS pvt,
round(coalesce(sum(CASE WHEN {_SOUND} AND volume < vol THEN ln(close / was) END) OVER {_CUM}, 0), 4) AS nvi_log,
round(coalesce(sum(CASE WHEN {_SOUND} AND volume > vol THEN ln(close / was) END) OVER {_CUM}, 0), 4) AS pvi_log FROM t""")  # fmt: skip
register("f08_streak", lambda s, d: adaptive.with_streak(bars(s, d)).select(*KEY, "streak"),
         f"""WITH RECURSIVE {BARS}, t AS (SELECT *, coalesce(sign(close - lag(close) OVER {LAG}), 0)::BIGINT AS s FROM b),
k AS (SELECT symbol, bar_index, s, s AS streak FROM t WHERE bar_index = 0 UNION ALL
SELECT t.symbol, t.bar_index, t.s, CASE WHEN t.s = k.s THEN k.streak + t.s ELSE t.s END FROM k JOIN t ON t.symbol = k.symbol AND t.bar_index = k.bar_index + 1)
SELECT symbol, bar_index, streak FROM k""")  # fmt: skip

register("f08_swings", lambda s, d: shown(adaptive.with_swings(bars(s, d)), *KEY, "swing", "swings", digits=4),
         f"""WITH {BARS}, t AS (SELECT *, lag(close) OVER {LAG} AS was, lag(open) OVER {LAG} AS opened FROM b),
u AS (SELECT *, greatest(abs(high - was), abs(low - was)) AS reach FROM t),
v AS (SELECT *, CASE WHEN was IS NULL THEN 0 ELSE 50 * ((close - was) + 0.5::DOUBLE * (close - open) + 0.25::DOUBLE * (was - opened)) / CASE WHEN reach = 0 THEN 1 ELSE reach END END AS swing FROM u)
SELECT symbol, bar_index, round(swing, 4) AS swing, round(sum(swing) OVER {_CUM}, 4) AS swings FROM v""")  # fmt: skip
_STEP = "0.5::DOUBLE * b.close + 0.5::DOUBLE * {0} AS a0, {0} + 0.5::DOUBLE * ({1} - a0) AS a1, {1} + 0.5::DOUBLE * ({2} - a1) AS a2, {2} + 0.5::DOUBLE * ({3} - a2) AS a3"
register("f08_laguerre", lambda s, d: shown(fold.fold(bars(s, d), lambda b: {"laguerre": adaptive.laguerre(b["close"])}, ["laguerre"]), *KEY, "laguerre", digits=4),
         f"""WITH RECURSIVE {BARS}, la(symbol, bar_index, n0, n1, n2, n3) AS (SELECT symbol, bar_index, {_STEP.format(*["0.0::DOUBLE"] * 4)} FROM b WHERE bar_index = 0 UNION ALL
SELECT b.symbol, b.bar_index, {_STEP.format("p.n0", "p.n1", "p.n2", "p.n3")} FROM la p JOIN b ON b.symbol = p.symbol AND b.bar_index = p.bar_index + 1),
st AS (SELECT symbol, bar_index, greatest(n0 - n1, 0) + greatest(n1 - n2, 0) + greatest(n2 - n3, 0) AS up, greatest(n1 - n0, 0) + greatest(n2 - n1, 0) + greatest(n3 - n2, 0) AS down FROM la)
SELECT symbol, bar_index, round(CASE WHEN up + down = 0 THEN 0 ELSE up / (up + down) END, 4) AS laguerre FROM st""")  # fmt: skip
