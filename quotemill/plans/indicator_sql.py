"""States indicators in SQL, so that the presets' rows can be compared: windows as they are, folds as recursive queries.

The lines below restate each operation in terms of its inputs; nothing of the Spark expressions is used.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from quotemill.operators.indicators import Ind, INPUTS

_RUN = "OVER (PARTITION BY inst_id ORDER BY bar_time)"
_PAST = "OVER (PARTITION BY inst_id ORDER BY bar_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _rows(n: float, skip: int = 0) -> str:
    end = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"OVER (PARTITION BY inst_id ORDER BY bar_time ROWS BETWEEN {int(n) - 1 + skip} PRECEDING AND {end})"


def _number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _list(body: str, a: str, n: float) -> str:
    """`body` over the list l of the last n values."""
    return f"(SELECT {body} FROM (SELECT {a} AS l))"


def _lag(a: str, n: float) -> str:
    return f"lag({a}, {int(n)}) {_RUN}"


def _first_lag(a: str, n: float) -> str:
    return f"coalesce({_lag(a, n)}, first_value({a}) {_RUN})"


def _fitted(value: str, otherwise: str) -> str:
    """A statistic of two variables, where it is defined."""
    return f"coalesce(CASE WHEN NOT isnan({value}) THEN {value} END, {otherwise})"


def _exceeds(a: str, b: str) -> str:
    return f"{a} - {b} > greatest(abs({a}), abs({b}), 1.0::DOUBLE) * 1e-9::DOUBLE"


def _moment(a: str, n: float, k: int) -> str:
    return f"list_avg(list_transform(list({a}) {_rows(n)}, lambda x: x ** {k}))"


def _central(a: str, n: float) -> tuple[str, str, str]:
    m1, m2, m3, m4 = (_moment(f"({a} - first_{a})", n, k) for k in (1, 2, 3, 4))
    return (f"({m2} - {m1} ** 2)", f"({m3} - 3 * {m1} * {m2} + 2 * {m1} ** 3)", f"({m4} - 4 * {m1} * {m3} + 6 * {m1} ** 2 * {m2} - 3 * {m1} ** 4)")


def _expression(op: str, args: list[str], params: tuple) -> str:
    a, b, c = [*args, "", "", ""][:3]
    p = [*params, 0, 0]
    values = f"list({a}) {_rows(p[0])}" if params and a else ""
    table = {
        "add": lambda: f"({a} + {b})", "sub": lambda: f"({a} - {b})", "mul": lambda: f"({a} * {b})", "div": lambda: f"coalesce({a} / nullif({b}, 0), 0)",
        "and": lambda: f"({a} AND {b})", "or": lambda: f"({a} OR {b})", "not": lambda: f"(NOT {a})", "abs": lambda: f"abs({a})",
        "larger": lambda: f"greatest({', '.join(args)})", "smaller": lambda: f"least({', '.join(args)})",
        "over": lambda: f"coalesce({_exceeds(a, b)}, false)", "under": lambda: f"coalesce({_exceeds(b, a)}, false)",
        "sign": lambda: f"CASE WHEN {_exceeds(a, b)} THEN 1 WHEN {_exceeds(b, a)} THEN -1 END",
        "crossed": lambda: f"coalesce({a} = {b} AND last_value({a} IGNORE NULLS) {_PAST} = -{b}, false)",
        "at_least": lambda: f"({' + '.join(f'CAST({x} AS INTEGER)' for x in args)}) >= {params[0]}",
        "lag": lambda: _lag(a, p[0]), "lag_or_self": lambda: f"coalesce({_lag(a, p[0])}, {a})",
        "sma": lambda: f"avg({a}) {_rows(p[0])}", "total": lambda: f"sum({a}) {_rows(p[0])}", "sd": lambda: f"stddev_pop({a}) {_rows(p[0])}", "variance": lambda: f"var_pop({a}) {_rows(p[0])}",
        "highest": lambda: f"max({a}) {_rows(p[0])}", "lowest": lambda: f"min({a}) {_rows(p[0])}",
        "wma": lambda: f"list_sum(list_transform({values}, lambda x, i: x * i)) / (len({values}) * (len({values}) + 1) / 2)",
        "cumulative": lambda: f"sum({a}) {_RUN}", "compounded": lambda: f"{b} * exp(sum(ln(1 + {a})) {_RUN})",
        "percentile": lambda: f"list_sort({values})[CAST(greatest(ceil({p[1]} * len({values}) / 100.0), 1) AS INTEGER)]",
        "percent_rank": lambda: f"len(list_filter({values}, lambda x: x <= {a})) * 100.0::DOUBLE / len({values})",
        "bar_number": lambda: f"CAST(row_number() {_RUN} AS DOUBLE)",
        "slope": lambda: _fitted(f"regr_slope({a}, {b}) {_rows(p[0])}", "0"), "r_squared": lambda: _fitted(f"regr_r2({a}, {b}) {_rows(p[0])}", "0"),
        "trend_value": lambda: _fitted(f"avg({a}) {_rows(p[0])} + regr_slope({a}, {b}) {_rows(p[0])} * ({b} + {p[1]} - avg({b}) {_rows(p[0])})", a),
        "correlation": lambda: _fitted(f"corr({a}, {b}) {_rows(p[0])}", "0"),
        "skewness": lambda: f"coalesce(CASE WHEN {_central(a, p[0])[0]} > 1e-12 THEN {_central(a, p[0])[1]} / {_central(a, p[0])[0]} ** 1.5 END, 0)",
        "kurtosis": lambda: f"coalesce(CASE WHEN {_central(a, p[0])[0]} > 1e-12 THEN {_central(a, p[0])[2]} / {_central(a, p[0])[0]} ** 2 - 3 END, 0)",
        "mean_deviation": lambda: f"list_avg(list_transform({values}, lambda x: abs(x - avg_{a})))",
        "mean_of_last": lambda: f"list_avg(list_slice({f'list({a}) {_rows(p[0])}'}, -CAST(least(floor({b}), len(list({a}) {_rows(p[0])})) AS INTEGER), -1))",
        "arctan": lambda: f"degrees(atan({a}))", "log": lambda: f"CASE WHEN {a} > 0 THEN ln({a}) ELSE 0 END", "root": lambda: f"sqrt(greatest({a}, 0))",
        "choose": lambda: f"CASE WHEN {a} THEN {b} ELSE {c} END",
        "since_extreme": lambda: f"CAST(list_position(list_reverse({values}), list_{'max' if p[1] else 'min'}({values})) - 1 AS DOUBLE)",
    }
    return table[op]()


def _fold(op: str, args: list[str], p: tuple, v: str) -> tuple[list[dict[str, str]], dict[str, tuple[str, str]], str]:
    """(columns to make before, one table after the other; state: (first value, next value); the result).

    In the state, s. is the row before and n. the row itself; v begins the names of all columns.
    """
    x = args[0]
    ema = lambda alpha, at=x: {v: (f"n.{at}", f"s.{v} + {_number(alpha)} * (n.{at} - s.{v})")}
    if op in ("ema", "wilder", "ema_alpha"):
        return [], ema({"ema": lambda n: 2 / (n + 1), "wilder": lambda n: 1 / n, "ema_alpha": lambda n: n}[op](p[0])), f"s.{v}"
    if op == "zlema":
        return [{f"{v}y": f"2 * {x} - {_first_lag(x, (p[0] - 1) // 2)}"}], ema(2 / (p[0] + 1), f"{v}y"), f"s.{v}"
    if op == "kama":
        n, fast, slow = p
        moves = {f"{v}m": f"abs({x} - coalesce({_lag(x, 1)}, {x}))", f"{v}c": f"abs({x} - {_first_lag(x, n)})"}
        ratio = {f"{v}w": f"(coalesce({v}c / nullif(sum({v}m) {_rows(n)}, 0), 0) * {2 / (fast + 1) - 2 / (slow + 1)!r}::DOUBLE + {2 / (slow + 1)!r}::DOUBLE) ** 2"}
        return [moves, ratio], {v: (f"n.{x}", f"s.{v} + n.{v}w * (n.{x} - s.{v})")}, f"s.{v}"
    if op == "streak":
        step = f"CASE WHEN n.{x} > n.{v}l THEN greatest(s.{v}, 0) + 1 ELSE least(s.{v}, 0) - 1 END"
        return [{f"{v}l": _lag(x, 1)}], {v: ("0::DOUBLE", step)}, f"s.{v}"
    if op in ("two_pole", "super_smoother"):
        root = math.sqrt(2) if op == "two_pole" else 1.414
        a = math.exp(-root * math.pi / p[0])
        b = 2 * a * math.cos(root * math.pi / p[0])
        mean = f"({x} + 2 * {_lag(x, 1)} + {_lag(x, 2)}) / 4" if op == "two_pole" else f"({x} + {_lag(x, 1)}) / 2"
        step = f"CASE WHEN n.r > 2 THEN {_number(1 - b + a * a)} * n.{v}y + {_number(b)} * s.{v} - {_number(a * a)} * s.{v}b ELSE n.{x} END"
        return [{f"{v}y": mean}], {v: (f"n.{x}", step), f"{v}b": (f"n.{x}", f"s.{v}")}, f"s.{v}"
    if op == "cyber_cycle":
        a = p[0]
        smooth = {f"{v}y": f"CASE WHEN r > 3 THEN ({x} + 2 * {_lag(x, 1)} + 2 * {_lag(x, 2)} + {_lag(x, 3)}) / 6 ELSE {x} END"}
        bend = {f"{v}d": f"{v}y - 2 * {_lag(f'{v}y', 1)} + {_lag(f'{v}y', 2)}"}
        step = f"CASE WHEN n.r > 2 THEN {_number((1 - a / 2) ** 2)} * n.{v}d + {_number(2 * (1 - a))} * s.{v} - {_number((1 - a) ** 2)} * s.{v}b ELSE 0 END"
        return [smooth, bend], {v: ("0::DOUBLE", step), f"{v}b": ("0::DOUBLE", f"s.{v}")}, f"s.{v}"
    if op == "gaussian":
        beta = (1 - math.cos(2 * math.pi / p[0])) / (2 ** (1 / p[1]) - 1)
        alpha = min(-beta + math.sqrt(beta * beta + 2 * beta), 1.0)
        return [], {v: (f"n.{x}", f"CASE WHEN n.r > {int(p[0])} THEN s.{v} + {_number(alpha ** p[1])} * (n.{x} - s.{v}) ELSE n.{x} END")}, f"s.{v}"
    if op == "one_pole_slope":
        rise = " + ".join(f"{3 - k} * {_lag(x, k)}" for k in range(1, 7))
        pull = f"least(abs(n.{v}y) * {p[0]} / 4.0::DOUBLE, {p[1]})"
        return [{f"{v}y": f"CASE WHEN r > 7 THEN (3 * {x} + {rise}) / 28 ELSE 0 END"}], ema(2 / (p[0] + 1)) | {f"{v}p": ("0::DOUBLE", pull), f"{v}x": (f"n.{x}", f"n.{x}")}, f"s.{v} + s.{v}p * (s.{v}x - s.{v})"
    if op == "laguerre_rsi":
        g = _number(p[0])
        new = [f"((1 - {g}) * n.{x} + {g} * s.{v}0)"]
        for k in range(1, 4):
            new.append(f"(-{g} * {new[-1]} + s.{v}{k - 1} + {g} * s.{v}{k})")
        state = {f"{v}{k}": (f"n.{x}", new[k]) for k in range(4)}
        steps = [f"(s.{v}{k} - s.{v}{k + 1})" for k in range(3)]
        gain, loss = (" + ".join(f"greatest({sign}{d}, 0)" for d in steps) for sign in ("", "-"))
        return [], state, f"coalesce(({gain}) / nullif(({gain}) + ({loss}), 0), 0)"
    if op == "fractal_mean":
        n, (h, lo) = int(p[0]), args[1:3]
        half = n // 2
        span = lambda m, skip: f"(max({h}) {_rows(m, skip)} - min({lo}) {_rows(m, skip)})"
        parts = {f"{v}y": f"({span(half, half)} + {span(half, 0)}) / {half} / ({span(n, 0)} / {n} + 1e-300::DOUBLE)"}
        weight = {f"{v}w": f"CASE WHEN {v}y > 0 THEN least(greatest(exp(-4.6::DOUBLE * (least(greatest(log2({v}y), 1), 2) - 1)), 0.01::DOUBLE), 1) ELSE 0 END"}
        return [parts, weight], {v: (f"n.{x}", f"CASE WHEN n.r > {n} THEN s.{v} + n.{v}w * (n.{x} - s.{v}) ELSE n.{x} END")}, f"s.{v}"
    if op == "sar":
        h, lo = args[:2]
        before = {f"{v}h1": _lag(h, 1), f"{v}l1": _lag(lo, 1), f"{v}h2": f"coalesce({_lag(h, 2)}, {_lag(h, 1)})", f"{v}l2": f"coalesce({_lag(lo, 2)}, {_lag(lo, 1)})"}
        moved = f"(s.{v} + s.{v}a * (s.{v}e - s.{v}))"
        stop = f"(CASE WHEN s.{v}u THEN least({moved}, n.{v}l1, n.{v}l2) ELSE greatest({moved}, n.{v}h1, n.{v}h2) END)"
        turn = f"(CASE WHEN s.{v}u THEN n.{lo} < {stop} ELSE n.{h} > {stop} END)"
        further = f"(CASE WHEN s.{v}u THEN n.{h} > s.{v}e ELSE n.{lo} < s.{v}e END)"
        state = {
            v: (f"n.{lo}", f"CASE WHEN {turn} THEN s.{v}e ELSE {stop} END"),
            f"{v}u": ("true", f"s.{v}u <> {turn}"),
            f"{v}e": (f"n.{h}", f"CASE WHEN {turn} THEN (CASE WHEN s.{v}u THEN n.{lo} ELSE n.{h} END) WHEN {further} THEN (CASE WHEN s.{v}u THEN n.{h} ELSE n.{lo} END) ELSE s.{v}e END"),
            f"{v}a": (_number(p[0]), f"CASE WHEN {turn} THEN {_number(p[0])} WHEN {further} THEN least(s.{v}a + {_number(p[0])}, {_number(p[1])}) ELSE s.{v}a END"),
        }
        return [before], state, f"s.{v}"
    raise KeyError(op)


FOLDS = frozenset("ema wilder ema_alpha zlema kama streak two_pole super_smoother cyber_cycle gaussian one_pole_slope laguerre_rsi fractal_mean sar".split())


def indicator_tables(wanted: Iterable[Ind], bars: str) -> tuple[str, str]:
    """(common table expressions, the last one's name): `bars` with r and a column per node that `wanted` needs."""
    level: dict[Ind, int] = {}

    def visit(node: Ind) -> int:
        if node not in level:
            below = [visit(x) for x in node.inputs if isinstance(x, Ind)]
            level[node] = 0 if node.op in INPUTS else 1 + max(below, default=0)
        return level[node]

    for node in wanted:
        visit(node)
    tables, at = [f"t0 AS MATERIALIZED (SELECT *, row_number() {_RUN} AS r FROM {bars})"], 0

    def add(columns: dict[str, str]) -> None:
        nonlocal at
        if columns:
            tables.append(f"t{at + 1} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM t{at})")
            at += 1

    name = lambda x: x.column if isinstance(x, Ind) else _number(x)
    waiting = [n for n in sorted(level, key=lambda n: (level[n], n.column)) if level[n]]
    ready = {n for n in level if not level[n]}
    while waiting:
        able = [n for n in waiting if n.op not in FOLDS and all(x in ready for x in n.inputs if isinstance(x, Ind))]
        if able:
            add({f"first_{name(n.inputs[0])}": f"first_value({name(n.inputs[0])}) {_RUN}" for n in able if n.op in ("skewness", "kurtosis")} | {f"avg_{name(n.inputs[0])}": f"avg({name(n.inputs[0])}) {_rows(n.params[0])}" for n in able if n.op == "mean_deviation"})
            add({n.column: _expression(n.op, [name(x) for x in n.inputs], n.params) for n in able})
        else:
            able = [n for n in waiting if all(x in ready for x in n.inputs if isinstance(x, Ind))]
            made = {n: _fold(n.op, [name(x) for x in n.inputs], n.params, n.column) for n in able}
            for k in range(max(len(m[0]) for m in made.values())):
                add({c: e for m in made.values() for c, e in (m[0][k] if k < len(m[0]) else {}).items()})
            state = {c: e for m in made.values() for c, e in m[1].items()}
            first, following = (", ".join(f"CAST({e[k]} AS {'BOOLEAN' if e[0] == 'true' else 'DOUBLE'}) AS {c}" for c, e in state.items()) for k in (0, 1))
            tables.append(f"f{at} AS (SELECT n.inst_id, n.r, {first} FROM t{at} n WHERE n.r = 1 UNION ALL SELECT n.inst_id, n.r, {following} FROM f{at} s JOIN t{at} n ON n.inst_id = s.inst_id AND n.r = s.r + 1)")
            out = ", ".join(f"{m[2]} AS {n.column}_" for n, m in made.items())
            tables.append(f"t{at + 1} AS MATERIALIZED (SELECT n.*, {', '.join(f'o.{n.column}_ AS {n.column}' for n in made)} FROM t{at} n JOIN (SELECT inst_id, r, {out} FROM f{at} s) o USING (inst_id, r))")
            at += 1
        ready.update(able)
        waiting = [n for n in waiting if n not in ready]
    return ", ".join(tables), f"t{at}"


def preset_rows(rules: dict[str, tuple[Ind, Ind]], bars: str) -> str:
    """(inst_id, bar_time, r, preset, signal_type) of each bar but an instrument's first, as common table expressions ending in `signals`."""
    tables, last = indicator_tables([x for pair in rules.values() for x in pair], "bars")
    kind = lambda a, b: f"CASE WHEN {a.column} THEN 'BUY' WHEN {b.column} THEN 'SELL' ELSE 'HOLD' END"
    rows = " UNION ALL ".join(f"SELECT inst_id, bar_time, r, '{n}' AS preset, {kind(*pair)} AS signal_type FROM {last} WHERE r > 1" for n, pair in rules.items())
    return f"WITH RECURSIVE {bars}, {tables}, signals AS ({rows})"
