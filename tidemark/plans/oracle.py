"""Independent DuckDB SQL for the registered queries, with default parameters.

Each entry is written from the operator's definition: columns in stages, the
last of which are the results. ``@p`` is a frame of the last p bars, ``@@`` all
bars up to the current one, ``@`` the order alone.
"""

from __future__ import annotations

import re

from tidemark.plans import oracle_windows, pipes

BARS = """SELECT event_type AS pair, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l,
  arg_max(value, (ts, event_id)) AS c, CAST(count(*) AS DOUBLE) AS v FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL"""
LAGS = "SELECT *, row_number() @ - 1 AS i, lag(c) @ AS pc, lag(h) @ AS ph, lag(l) @ AS pl, lag(v) @ AS pv FROM bars"


def windows(sql: str) -> str:
    sql = sql.replace("@@", "OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING)")
    sql = re.sub(r"@(\d+)", lambda m: f"OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN {int(m[1]) - 1} PRECEDING AND CURRENT ROW)", sql)
    return sql.replace("@", "OVER (PARTITION BY pair ORDER BY ts)")


def query(*stages: dict[str, str], extra: str = "") -> str:
    """The last stage names the results; ``extra`` are CTEs after the stages, the last named ``last``."""
    *before, final = stages
    ctes, at = [f"bars AS ({BARS})", f"s0 AS ({LAGS})"], "s0"
    for k, stage in enumerate(before, 1):
        ctes.append(f"s{k} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {at})")
        at = f"s{k}"
    recursive = ""
    if extra:
        ctes.append(extra.replace("$at", at))
        at, recursive = "last", "RECURSIVE "
    ctes.append(f"res AS (SELECT pair, ts, {', '.join(f'{e} AS {n}' for n, e in final.items())} FROM {at})")
    tidy = lambda n: f"CASE WHEN isfinite(CAST({n} AS DOUBLE)) THEN round(CAST({n} AS DOUBLE) * 1.000000000001, CASE WHEN abs({n}) >= 1e6 THEN 0 WHEN abs({n}) >= 1e3 THEN 3 ELSE 6 END) + 0.0 END AS {n}"
    return windows(f"WITH {recursive}" + ",\n".join(ctes) + f"\nSELECT pair, ts, {', '.join(map(tidy, final))} FROM res")


def full(p: int, e: str, start: int | None = None) -> str:
    return f"CASE WHEN i >= {p - 1 if start is None else start} THEN {e} END"


def avg(x: str, p: int, start: int | None = None) -> str:
    return full(p, f"avg({x}) @{p}", start)


def total(x: str, p: int, start: int | None = None) -> str:
    return full(p, f"sum({x}) @{p}", start)


def recursion(x: str, a: float, s: int, seed: str) -> str:
    """y = a x + (1 - a) y from ``seed`` at row ``s``, in closed form."""
    d = 1 - a
    return f"CASE WHEN i >= {s} THEN pow({d!r}, i) * sum(CASE WHEN i = {s} THEN {seed} WHEN i > {s} THEN {a!r} * ({x}) END * pow({d!r}, -i)) @@ END"


def emas(name: str, x: str, span: int, first: int = 0) -> tuple[dict, dict]:
    """Stages that add ``name``: the average of ``span`` whose seed is the mean of its first ``span`` values from row ``first`` on."""
    s = first + span - 1
    return {f"{name}_seed": f"avg({x}) @{span}"}, {name: recursion(x, 2 / (span + 1), s, f"{name}_seed")}


def rmas(name: str, x: str, p: int) -> tuple[dict, dict]:
    return {f"{name}_seed": f"avg({x}) @{p}"}, {name: recursion(x, 1 / p, p - 1, f"{name}_seed")}


def first(x: str, span: float, s: int = 0) -> str:
    return recursion(x, 2 / (span + 1), s, x)


def both(*pairs: tuple[dict, ...]) -> list[dict]:
    """Several helpers' stages side by side."""
    out = []
    for stages in zip(*pairs):
        out.append({k: v for s in stages for k, v in s.items()})
    return out


TR = "greatest(h - l, coalesce(abs(h - pc), 0), coalesce(abs(l - pc), 0))"
D = "coalesce(c - pc, 0)"
V = "CASE WHEN c > 0 AND pc > 0 THEN ln(c / pc) END"
TP = "(h + l + c) / 3"
CLV = "coalesce(((c - l) - (h - c)) / nullif(h - l, 0), 0)"
PCTV = "coalesce((c - pc) / nullif(pc, 0), 0)"
LIST = lambda p, x="c": f"CASE WHEN i >= {p - 1} THEN list({x}) @{p} END"
DISP = {"m50": avg("c", 50)}, {"d": "CASE WHEN m50 IS NOT NULL THEN ln(greatest(c, 1e-10)) - ln(greatest(m50, 1e-10)) END", "vv": V}
MOTION = {"vel": V}, {"acc": "vel - lag(vel) @"}


def dot(lst: str, weights: list[float]) -> str:
    return f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda k: {lst}[k] * ({[float(w) for w in weights]!r})[k]))"


def line(p: int, at: int) -> list[float]:
    t = [k - (p - 1) / 2 for k in range(p)]
    s = sum(x * x for x in t)
    return [1 / p + t[at] * x / s for x in t]


def varying(gain: str, seed: str, start: int) -> str:
    return (
        f"g AS (SELECT *, {gain} AS g, {seed} AS seed FROM $at),\n"
        f"r AS (SELECT pair, i, seed AS y FROM g WHERE i = {start} UNION ALL SELECT g.pair, g.i, g.g * g.c + (1 - g.g) * r.y FROM r JOIN g ON g.pair = r.pair AND g.i = r.i + 1),\n"
        "last AS (SELECT g.*, r.y FROM g LEFT JOIN r ON r.pair = g.pair AND r.i = g.i)"
    )


def z(x: str, w: int) -> str:
    return f"CASE WHEN i >= {w - 1} AND count({x}) @{w} > 1 AND stddev_samp({x}) @{w} > 1e-10 THEN ({x} - avg({x}) @{w}) / stddev_samp({x}) @{w} END"


def preset(q: dict[str, str], features: list, size: int = 24) -> str:
    """The results of several operators side by side, each worked out by itself; joined ``size`` at a time, as planning many joins takes long."""
    parts, held, names = [], {}, []
    for k, f in enumerate(features):
        changed = [str(v) for p, v in f.params.items() if v != f.spec.defaults[p]]
        parts.append(f"q{k} AS MATERIALIZED ({q['/'.join([f.spec.name, *changed])]})")
        held |= {o: k for o in f.outputs}  # an output named twice is the later operator's
    for at in range(0, len(features), size):
        names.append(f"g{at // size}")
        own = range(at, min(at + size, len(features)))
        cols = ", ".join(f"q{k}.{o}" for o, k in held.items() if k in own)
        parts.append(f"{names[-1]} AS MATERIALIZED (SELECT pair, ts, {cols} FROM q{at} {' '.join(f'JOIN q{k} USING (pair, ts)' for k in own[1:])})")
    joins = " ".join(f"JOIN {g} USING (pair, ts)" for g in names[1:])
    return "WITH " + ",\n".join(parts) + f"\nSELECT pair, ts, {', '.join(held)} FROM {names[0]} {joins}"


def build() -> dict[str, str]:
    q = {}
    # momentum
    rsi = both(rmas("up", f"greatest({D}, 0)", 14), rmas("dn", f"greatest(-({D}), 0)", 14))
    RSI = "100 - 100 / (1 + up / (dn + 1e-10))"
    q["momentum/rsi"] = query(*rsi, {"rsi_14": RSI})
    q["momentum/roc"] = query({"roc_10": "100 * (c - lag(c, 10) @) / nullif(lag(c, 10) @, 0)"})
    q["momentum/mom"] = query({"mom_10": "c - lag(c, 10) @"})
    q["momentum/cmo"] = query({"dd": D}, {"g": total("greatest(dd, 0)", 14), "b": total("greatest(-dd, 0)", 14)}, {"cmo_14": "100 * (g - b) / nullif(g + b, 0)"})
    q["momentum/acceleration"] = query({"vel": V}, {"close_accel_1": "vel - lag(vel) @"})
    q["momentum/jerk"] = query(*MOTION, {"close_jerk_1": "acc - lag(acc) @"})
    ang = (*DISP, {"pr": "d * vv"}, {"ang": full(0, "avg(pr) @20", 50)})
    q["momentum/angular_momentum"] = query(*ang, {"close_angmom_20": "ang"})
    q["momentum/torque"] = query(*ang, {"close_torque_20": "(ang - lag(ang, 5) @) / 5"})
    two = both(emas("f", "c", 12), emas("s", "c", 26))
    q["momentum/macd"] = query(*two, {"m": "f - s"}, *emas("sig", "m", 9, 25), {"macd_12_26": "m", "macd_signal_9": "sig", "macd_hist_12_26": "m - sig"})
    q["momentum/ppo"] = query(*two, {"m": "100 * (f - s) / (s + 1e-10)"}, *emas("sig", "m", 9, 25), {"ppo_12_26": "m", "ppo_signal_9": "sig", "ppo_hist_12_26": "m - sig"})
    q["momentum/tsi"] = query({"dd": D}, *both(emas("a1", "dd", 25), emas("b1", "abs(dd)", 25)), *both(emas("a2", "a1", 13, 24), emas("b2", "b1", 13, 24)), {"t": "100 * a2 / (b2 + 1e-10)"}, *emas("sig", "t", 13, 36), {"tsi_13_25": "t", "tsi_signal_13": "sig"})
    q["momentum/trix"] = query(*emas("e1", "c", 18), *emas("e2", "e1", 18, 17), *emas("e3", "e2", 18, 34), {"t": "100 * (e3 / nullif(lag(e3) @, 0) - 1)"}, *emas("sig", "t", 9, 52), {"trix_18": "t", "trix_signal_9": "sig"})
    raw = {"hh": full(14, "max(h) @14"), "ll": full(14, "min(l) @14")}, {"raw": "CASE WHEN hh > ll THEN 100 * (c - ll) / (hh - ll) WHEN hh IS NOT NULL THEN 50 END"}
    q["momentum/stoch"] = query(*raw, {"k": avg("raw", 3, 15)}, {"stoch_k_14": "k", "stoch_d_14": avg("k", 3, 17)})
    q["momentum/stochrsi"] = query(*rsi, {"r": RSI}, {"hh": "max(r) @14", "ll": "min(r) @14"}, {"raw": "CASE WHEN i >= 26 THEN CASE WHEN hh > ll THEN 100 * (r - ll) / (hh - ll) ELSE 50 END END"}, {"k": avg("raw", 3, 28)}, {"stochrsi_k_14": "k", "stochrsi_d_14": avg("k", 3, 30)})
    q["momentum/willr"] = query(raw[0], {"willr_14": "CASE WHEN hh > ll THEN -100 * (hh - c) / (hh - ll) WHEN hh IS NOT NULL THEN -50 END"})
    q["momentum/cci"] = query({"tp": TP}, {"a": LIST(20, "tp"), "m": avg("tp", 20)}, {"mad": "list_avg(list_transform(a, lambda x: abs(x - m)))"}, {"cci_20": "CASE WHEN mad > 0 THEN (tp - m) / (0.015 * mad) END"})
    uo = {"bp": "c - least(l, coalesce(pc, c))", "tr": "greatest(h, coalesce(pc, c)) - least(l, coalesce(pc, c))"}, {f"{n}{p}": total(n, p, 27) for n in ("bp", "tr") for p in (7, 14, 28)}
    q["momentum/uo"] = query(*uo, {"uo_7_14_28": "CASE WHEN tr7 > 0 AND tr14 > 0 AND tr28 > 0 THEN 100 * (4 * bp7 / tr7 + 2 * bp14 / tr14 + bp28 / tr28) / 7 END"})
    q["momentum/ao"] = query({"ao_5_34": full(34, "avg((h + l) / 2) @5 - avg((h + l) / 2) @34")})
    # smoothers
    er = "coalesce(abs(c - lag(c, 10) @) / nullif(sum(abs(c - pc)) @10, 0), 0)"
    q["smooth/kama"] = query({"er": er}, {"close_kama_10": "y"}, extra=varying("pow(er * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2)", "avg(c) @10", 9))
    up, dn = "greatest(c - pc, 0)", "greatest(pc - c, 0)"
    vid = {"us": f"sum({up}) @14", "ds": f"sum({dn}) @14"}
    q["smooth/vidya"] = query(vid, {"close_vidya_14": "y"}, extra=varying("(2.0 / 15) * coalesce(abs((us - ds) / nullif(us + ds, 0)), 0)", "avg(c) @15", 14))
    fr = lambda p: ({"h8": f"max(c) @{p // 2}", "l8": f"min(c) @{p // 2}", "r16": f"(max(c) @{p} - min(c) @{p}) / {p}"}, {"n12": f"(h8 - l8) / {p // 2} + (lag(h8, {p // 2}) @ - lag(l8, {p // 2}) @) / {p // 2}"})
    dim = "CASE WHEN n12 > 0 AND r16 > 0 THEN (ln(n12) - ln(r16)) / ln(2) ELSE 1 END"
    frama = lambda p: query(*fr(p), {f"close_frama_{p}": "y"}, extra=varying(f"least(greatest(exp(-4.6 * (({dim}) - 1)), 0.01), 1)", "c", p - 1))
    mcginley = lambda p: query({f"close_mcg_{p}": "y"}, extra=f"r AS (SELECT pair, i, c AS y FROM $at WHERE i = 0 UNION ALL SELECT s.pair, s.i, CASE WHEN r.y = 0 THEN s.c ELSE r.y + (s.c - r.y) / ({0.6 * p!r} * pow(s.c / r.y, 4)) END FROM r JOIN $at s ON s.pair = r.pair AND s.i = r.i + 1), last AS (SELECT s.*, r.y FROM $at s LEFT JOIN r ON r.pair = s.pair AND r.i = s.i)")
    import math

    gauss = lambda p: [math.exp(-((k - 0.85 * (p - 1)) ** 2) / (2 * (p / 6) ** 2)) for k in range(p)]
    alma = lambda p: query({"a": LIST(p)}, {f"close_alma_{p}": dot("a", [g / sum(gauss(p)) for g in gauss(p)])})
    t3s = lambda p: [s for k in range(6) for s in emas(f"e{k + 1}", f"e{k}" if k else "c", p, (p - 1) * k)]
    t3 = lambda p: query(*t3s(p), {f"close_t3_{p}": "-0.343 * e6 + 2.499 * e5 - 6.069 * e4 + 4.913 * e3"})
    for name, made, own, tuned in (("frama", frama, 16, 20), ("mcginley", mcginley, 10, 20), ("alma", alma, 10, 9), ("t3", t3, 10, 5)):
        q[f"smooth/{name}"], q[f"smooth/{name}/{tuned}"] = made(own), made(tuned)
    q["smooth/zlma"] = query({"x": "2 * c - lag(c, 9) @"}, {"close_zlma_20": first("x", 20, 9)})
    q["smooth/sma"] = query({"close_sma_20": avg("c", 20)})
    q["smooth/ema"] = query({"close_ema_20": first("c", 20)})
    q["smooth/rma"] = query({"close_rma_14": recursion("c", 1 / 14, 0, "c")})
    q["smooth/dema"] = query({"e1": first("c", 20)}, {"e2": first("e1", 20)}, {"close_dema_20": "2 * e1 - e2"})
    q["smooth/tema"] = query({"e1": first("c", 20)}, {"e2": first("e1", 20)}, {"e3": first("e2", 20)}, {"close_tema_20": "3 * e1 - 3 * e2 + e3"})
    w20 = [k / 210 for k in range(1, 21)]
    q["smooth/wma"] = query({"a": LIST(20)}, {"close_wma_20": dot("a", w20)})
    q["smooth/hma"] = query({"a": LIST(20), "b": LIST(10)}, {"x": f"2 * {dot('b', [k / 55 for k in range(1, 11)])} - {dot('a', w20)}"}, {"d4": "CASE WHEN i >= 22 THEN list(x) @4 END"}, {"close_hma_20": dot("d4", [0.1, 0.2, 0.3, 0.4])})
    q["smooth/trima"] = query({"m": avg("c", 11)}, {"close_trima_20": avg("m", 11, 20)})
    q["smooth/swma"] = query({"a": LIST(4)}, {"close_swma_4": dot("a", [1 / 6, 2 / 6, 2 / 6, 1 / 6])})
    a0 = math.exp(-math.pi * math.sqrt(2) / 10)
    b1, a1 = 2 * a0 * math.cos(math.pi * math.sqrt(2) / 10), -a0 * a0
    q["smooth/ssf"] = query({"close_ssf_10": "CASE WHEN i >= 9 THEN y END"}, extra=f"r AS (SELECT pair, i, c AS y, pc AS y1 FROM $at WHERE i = 1 UNION ALL SELECT s.pair, s.i, {1 - a1 - b1!r} * s.c + {b1!r} * r.y + {a1!r} * r.y1, r.y FROM r JOIN $at s ON s.pair = r.pair AND s.i = r.i + 1), last AS (SELECT s.*, r.y FROM $at s LEFT JOIN r ON r.pair = s.pair AND r.i = s.i)")
    # prices
    for n, e in {"hl2": "(h + l) / 2", "hlc3": TP, "ohlc4": "(o + h + l + c) / 4", "wcp": "(h + l + 2 * c) / 4", "typical": TP}.items():
        q[f"price/{n}"] = query({n: e})
    q["price/midpoint"] = query({"close_midpoint_14": full(14, "(max(c) @14 + min(c) @14) / 2")})
    q["price/midprice"] = query({"midprice_14": full(14, "(max(h) @14 + min(l) @14) / 2")})
    q["price/log_price"] = query({"close_log": "CASE WHEN c > 0 THEN ln(c) END"})
    q["price/pct_from_high"] = query({"close_pct_from_high_20": full(20, "(c - max(c) @20) / max(c) @20 * 100")})
    q["price/pct_from_low"] = query({"close_pct_from_low_20": full(20, "(c - min(c) @20) / min(c) @20 * 100")})
    # volatility
    q["volatility/bollinger"] = query({"m": avg("c", 20), "s": full(20, "stddev_pop(c) @20")}, {"u": "m + 2 * s", "d": "m - 2 * s"}, {"bb_upper_20": "u", "bb_middle_20": "m", "bb_lower_20": "d", "bb_width_20": "100 * (u - d) / m", "bb_pct_20": "(c - d) / (u - d + 1e-10)"})
    q["volatility/keltner"] = query({"tr": TR}, {"m": first("c", 20), "w": first("tr", 20)}, {"kc_upper_20": "m + 2 * w", "kc_basis_20": "m", "kc_lower_20": "m - 2 * w"})
    q["volatility/donchian"] = query({"u": full(20, "max(h) @20"), "d": full(20, "min(l) @20")}, {"dc_upper_20": "u", "dc_middle_20": "(u + d) / 2", "dc_lower_20": "d"})
    q["volatility/accbands"] = query({"r": "4 * (h - l) / (h + l + 1e-10)"}, {"accb_upper_20": avg("h * (1 + r)", 20), "accb_middle_20": avg("c", 20), "accb_lower_20": avg("l * (1 - r)", 20)})
    ke = {"ke": f"0.5 * pow({V}, 2)"}
    q["volatility/kinetic_energy"] = query(ke, {"ke_20": full(0, "avg(ke) @20", 20)})
    pe = (*DISP, {"pe": "d * d", "ke": "0.5 * vv * vv"})
    q["volatility/potential_energy"] = query(*pe, {"pe_20_50": full(0, "avg(pe) @20", 49)})
    q["volatility/total_energy"] = query(*pe, {"te": "ke + pe"}, {"te_20_50": full(0, "avg(te) @20", 49)})
    q["volatility/energy_flow"] = query(*pe, {"te": "ke + pe"}, {"tm": full(0, "avg(te) @20", 49)}, {"eflow_20_50": "tm - lag(tm, 5) @"})
    q["volatility/elastic_strain"] = query({"m": avg("c", 50)}, {"s": "(c - m) / greatest(m, 1e-10)"}, {"strain_20_50": full(0, "avg(s) @20", 49)})
    temp = {"vel": V}, {"t": full(0, "var_samp(vel) @20 * 20", 20), "e": full(0, "avg(0.5 * vel * vel) @20", 20)}
    q["volatility/temperature"] = query(*temp, {"mtemp_20": "t"})
    q["volatility/heat_capacity"] = query(*temp, {"de": "e - lag(e, 5) @", "dt": "t - lag(t, 5) @"}, {"heatcap_20": "CASE WHEN abs(de) > 1e-20 THEN dt / de END"})
    hist = "list_transform(range(10), lambda k: len(list_filter(a, lambda x: least(CAST(floor((x - list_min(a)) / ((list_max(a) - list_min(a)) / 10)) AS INTEGER), 9) = k)))"
    q["volatility/free_energy"] = query(*temp, {"a": "CASE WHEN i >= 20 THEN list(vel) @20 END"}, {"cnt": hist}, {"fenergy_20": "e - t * -list_sum(list_transform(list_filter(cnt, lambda n: n > 0), lambda n: n / 20 * ln(n / 20)))"})
    gap = {"p": "coalesce(pc, o)"}, {"g": "o - p"}, {"sf": "CASE WHEN abs(g) < 1e-10 THEN 1e-10 ELSE g END"}
    q["volatility/gap"] = query(*gap, {"gap_val": "g", "gap_pct": "100 * g / p", "gap_fill_pct": "CASE WHEN g > 0 THEN 100 * (o - l) / sf WHEN g < 0 THEN 100 * (h - o) / abs(sf) ELSE 0 END", "gap_run_ratio": "(c - o) / sf", "gap_range_ratio": "abs(g) / CASE WHEN h = l THEN 1e-10 ELSE h - l END", "is_gap_up": "CASE WHEN 100 * g / p > 0 THEN 1.0 ELSE 0.0 END", "is_gap_down": "CASE WHEN 100 * g / p < 0 THEN 1.0 ELSE 0.0 END"})
    q["volatility/mass_index"] = query({"r": "h - l"}, {"e1": first("r", 9)}, {"e2": first("e1", 9)}, {"massi_9_25": total("e1 / (e2 + 1e-10)", 25)})
    q["volatility/ulcer_index"] = query({"a": LIST(14)}, {"ulcer_14": "sqrt(list_avg(list_transform(range(1, 15), lambda k: pow(100 * (a[k] / list_max(a[1:k]) - 1), 2))))"})
    rvi = {"s": full(10, "stddev_samp(c) @10")}, {"us": "CASE WHEN i >= 9 THEN CASE WHEN c > pc THEN s ELSE 0 END END", "ds": "CASE WHEN i >= 9 THEN CASE WHEN c > pc THEN 0 ELSE s END END"}
    q["volatility/rvi"] = query(*rvi, *both(emas("u", "us", 14, 9), emas("d", "ds", 14, 9)), {"rvi_14": "100 * u / (u + d + 1e-10)"})
    q["volatility/historical_vol"] = query({"r": "coalesce(ln(c / pc), 0)"}, {"hv_20": full(20, "stddev_samp(r) @20 * sqrt(252)")})
    atr = lambda p: ({"tr": TR}, *rmas("atr", "tr", p))
    q["volatility/atr_percent"] = query(*atr(14), {"atr_pct_14": "100 * atr / c"})
    q["volatility/true_range"] = query({"true_range": TR})
    q["volatility/atr"] = query(*atr(14), {"atr_14": "atr"})
    q["volatility/natr"] = query(*atr(14), {"natr_14": "100 * atr / c"})
    # volume
    q["volume/obv"] = query({"x": f"sign({D}) * v"}, {"obv": "sum(x) @20"})
    q["volume/ad"] = query({"x": f"{CLV} * v"}, {"ad": "sum(x) @20"})
    q["volume/pvt"] = query({"x": f"{PCTV} * v"}, {"pvt": "sum(x) @20"})
    q["volume/nvi"] = query({"x": f"CASE WHEN v < pv THEN 100 * {PCTV} ELSE 0 END"}, {"nvi": "sum(x) @255"})
    q["volume/pvi"] = query({"x": f"CASE WHEN v > pv THEN 100 * {PCTV} ELSE 0 END"}, {"pvi": "sum(x) @255"})
    q["volume/market_force"] = query(*MOTION, {"mforce_14": full(0, "avg(v * acc) @14", 15)})
    q["volume/impulse"] = query(*MOTION, {"impulse_14": full(0, "sum(v * acc) @14", 15)})
    q["volume/market_momentum"] = query(*MOTION, {"mmom_14": full(0, "avg(v * vel) @14", 14)})
    q["volume/market_power"] = query(*MOTION, {"mpower_14": full(0, "avg(v * acc * vel) @14", 15)})
    q["volume/market_capacitance"] = query({"dd": "abs(c - lag(c, 19) @)"}, {"mcap_20": "CASE WHEN dd > 1e-10 THEN sum(v) @20 / dd END"})
    pull = "list_sum(list_transform(range(1, 20), lambda k: CASE WHEN abs(ln(c / a[k])) > 1e-10 THEN b[k] / pow(ln(c / a[k]), 2) ELSE 0 END))"
    q["volume/gravitational_pull"] = query({"a": LIST(20), "b": LIST(20, "v")}, {"gpull_20": f"CASE WHEN i >= 19 THEN {pull} END"})
    q["volume/mfi"] = query({"tp": TP}, {"dt": "coalesce(tp - lag(tp) @, 0)"}, {"p": total("CASE WHEN dt > 0 THEN tp * v ELSE 0 END", 14), "n": total("CASE WHEN dt < 0 THEN tp * v ELSE 0 END", 14)}, {"mfi_14": "100 * p / nullif(p + n, 0)"})
    q["volume/cmf"] = query({"x": f"{CLV} * v"}, {"cmf_20": full(20, "sum(x) @20 / nullif(sum(v) @20, 0)")})
    q["volume/efi"] = query({"x": f"{D} * v"}, *emas("e", "x", 13), {"efi_13": "e"})
    q["volume/eom"] = query({"x": "coalesce(((h + l) - (ph + pl)) / 2, 0) / ((v / 1e8) / (h - l + 1e-10) + 1e-10)"}, {"eom_14": avg("x", 14)})
    q["volume/kvo"] = query({"tp": TP}, {"x": "v * coalesce(sign(tp - lag(tp) @), 0)"}, *both(emas("f", "x", 34), emas("s", "x", 55)), {"k": "f - s"}, *emas("sig", "k", 13, 54), {"kvo_34_55": "k", "kvo_signal_13": "sig"})
    vw = "sum(tp * v) @@ / (sum(v) @@ + 1e-10)"
    q["volume/vwap"] = query({"tp": TP}, {"vwap": vw})
    q["volume/vwap_bands"] = query({"tp": TP}, {"w": vw, "s": full(20, "stddev_samp(tp) @20")}, {"vwap": "w", "vwap_upper_20": "w + 2 * s", "vwap_lower_20": "w - 2 * s"})
    # trend
    mid = lambda p: full(p, f"(max(h) @{p} + min(l) @{p}) / 2")
    q["trend/ichimoku"] = query({"t": mid(9), "k": mid(26), "s": mid(52)}, {"tenkan_sen": "t", "kijun_sen": "k", "senkou_a": "lag((t + k) / 2, 26) @", "senkou_b": "lag(s, 26) @"})
    q["trend/dpo"] = query({"m": avg("c", 20)}, {"dpo_20": "c - lag(m, 11) @"})
    q["trend/qstick"] = query({"qstick_10": avg("c - o", 10)})
    q["trend/ttm"] = query({"m": avg("(h + l) / 2", 6)}, {"ttm_trend_6": "CASE WHEN c > m THEN 1.0 WHEN m IS NOT NULL THEN -1.0 END"})
    q["trend/atr_trailing"] = query(*atr(14), {"lo": full(14, "max(c) @14 - 3 * atr"), "sh": full(14, "min(c) @14 + 3 * atr")}, {"sd": "CASE WHEN c > sh THEN 1.0 WHEN c < lo THEN -1.0 END"}, {"atr_trail_long_14": "lo", "atr_trail_short_14": "sh", "atr_trail_dir_14": "coalesce(last_value(sd IGNORE NULLS) @@, 0)"})
    bands = (*atr(10), {"tp": "(h + l) / 2 + 3 * atr", "bt": "(h + l) / 2 - 3 * atr"})
    st = (
        "r AS (SELECT pair, i, tp AS u, bt AS d, 1 AS w, CAST(NULL AS DOUBLE) AS y FROM $at WHERE i = 9 UNION ALL SELECT pair, i, u, d, w, CASE WHEN w = 1 THEN d ELSE u END FROM ("
        "SELECT s.pair, s.i, CASE WHEN s.tp < r.u OR s.pc > r.u THEN s.tp ELSE r.u END AS u, CASE WHEN s.bt > r.d OR s.pc < r.d THEN s.bt ELSE r.d END AS d,"
        " CASE WHEN s.c > r.u THEN 1 WHEN s.c < r.d THEN -1 ELSE r.w END AS w FROM r JOIN $at s ON s.pair = r.pair AND s.i = r.i + 1)), last AS (SELECT s.*, r.y, coalesce(r.w, 1) AS w FROM $at s LEFT JOIN r ON r.pair = s.pair AND r.i = s.i)"
    )
    q["trend/supertrend"] = query(*bands, {"supertrend_10": "y", "supertrend_dir_10": "w"}, extra=st)
    q["trend/chandelier"] = query({"tr": TR}, {"chandelier_long_22": full(22, "max(h) @22 - 3 * avg(tr) @22"), "chandelier_short_22": full(22, "min(l) @22 + 3 * avg(tr) @22")})
    q["trend/hilo"] = query({"hm": avg("h", 13), "lm": avg("l", 21)}, {"sd": "CASE WHEN i >= 21 THEN CASE WHEN c > lag(hm) @ THEN 1.0 WHEN c < lag(lm) @ THEN -1.0 END END"}, {"ln": "CASE WHEN sd = 1 THEN lm WHEN sd = -1 THEN hm END"}, {"hilo": "last_value(ln IGNORE NULLS) @@", "hilo_dir": "coalesce(last_value(sd IGNORE NULLS) @@, 0)"})
    q["trend/cksp"] = query(*atr(10), {"lo": full(10, "max(h) @10 - atr"), "sh": full(10, "min(l) @10 + atr")}, {"cksp_long": full(0, "max(lo) @9", 17), "cksp_short": full(0, "min(sh) @9", 17)})
    moves = {"tr": TR, "u": "coalesce(h - ph, 0)", "w": "coalesce(pl - l, 0)"}, {"pd": "CASE WHEN u > w AND u > 0 THEN u ELSE 0 END", "md": "CASE WHEN w > u AND w > 0 THEN w ELSE 0 END"}
    adx = (*moves, *both(rmas("atr", "tr", 14), rmas("ps", "pd", 14), rmas("ms", "md", 14)), {"dp": "100 * ps / nullif(atr, 0)", "dm": "100 * ms / nullif(atr, 0)"}, {"dx": "100 * abs(dp - dm) / (dp + dm + 1e-10)"}, {"seed": "avg(dx) @14"})
    q["trend/adx"] = query(*adx, {"adx_14": recursion("dx", 1 / 14, 27, "seed"), "dmp_14": "dp", "dmn_14": "dm"})
    q["trend/aroon"] = query({"a": LIST(26, "h"), "b": LIST(26, "l")}, {"u": "100.0 * (list_position(list_reverse(a), list_max(a)) - 1) / 25", "d": "100.0 * (list_position(list_reverse(b), list_min(b)) - 1) / 25"}, {"aroon_up_25": "u", "aroon_dn_25": "d", "aroon_osc_25": "u - d"})
    q["trend/vortex"] = query({"tr": TR, "p": "coalesce(abs(h - pl), 0)", "m": "coalesce(abs(l - ph), 0)"}, {"vi_plus_14": full(14, "sum(p) @14 / nullif(sum(tr) @14, 0)"), "vi_minus_14": full(14, "sum(m) @14 / nullif(sum(tr) @14, 0)")})
    q["trend/vhf"] = query({"a": f"abs({D})"}, {"vhf_28": full(28, "(max(c) @28 - min(c) @28) / nullif(sum(a) @28, 0)")})
    q["trend/chop"] = query({"tr": TR}, {"r": full(14, "max(h) @14 - min(l) @14"), "s": total("tr", 14)}, {"chop_14": "CASE WHEN r > 0 THEN 100 * log10(s / r) / log10(14) END"})
    q["trend/viscosity"] = query(*MOTION, {"w": "avg(abs(vel)) @20"}, {"viscosity_20": "CASE WHEN i >= 21 AND w > 1e-10 THEN avg(abs(acc)) @20 / w END"})
    q["trend/reynolds"] = query({"vel": V}, {"s": "stddev_samp(vel) @20"}, {"reynolds_20": "CASE WHEN i >= 20 AND s > 1e-10 THEN abs(avg(vel) @20) * 20 / s END"})
    q["trend/rotational_inertia"] = query({"a": LIST(20), "b": LIST(20, "v"), "m": avg("c", 20)}, {"rot_inertia_20": "CASE WHEN m > 1e-10 THEN list_sum(list_transform(range(1, 21), lambda k: b[k] * pow(ln(greatest(a[k], 1e-10) / m), 2))) END"})
    q["trend/market_impedance"] = query({"impedance_20": full(20, "sum(h - l) @20 / nullif(sum(v) @20, 0)")})
    q["trend/rc_time_constant"] = query({"dd": "abs(c - lag(c, 19) @)"}, {"rc_tau_20": "CASE WHEN dd > 1e-10 THEN sum(h - l) @20 / dd END"})
    q["trend/snr"] = query({"vel": V}, {"s": "var_samp(vel) @20"}, {"snr_20": "CASE WHEN i >= 20 AND s > 1e-15 THEN pow(avg(vel) @20, 2) / s END"})
    op = {"sg": "CASE WHEN pc > 0 THEN sign(c - pc) END"}, {"op": full(0, "abs(avg(sg) @20)", 20)}
    q["trend/order_parameter"] = query(*op, {"order_param_20": "op"})
    q["trend/susceptibility"] = query(*op, {"susceptibility_20": full(0, "var_samp(op) @50 * 20", 69)})
    # statistics
    S = lambda tag, p=30: f"close_{tag}_{p}"
    a30 = {"a": LIST(30), "m": avg("c", 30)}
    srt = {"a": LIST(30)}, {"s": "list_sort(a)"}, {"md": "(s[15] + s[16]) / 2"}
    q["stat/variance"] = query({S("var"): full(30, "var_samp(c) @30")})
    q["stat/std"] = query({S("std"): full(30, "stddev_samp(c) @30")})
    q["stat/mad"] = query(a30, {S("mad"): "list_avg(list_transform(a, lambda x: abs(x - m)))"})
    q["stat/zscore"] = query({S("zscore"): full(30, "(c - avg(c) @30) / nullif(stddev_samp(c) @30, 0)")})
    q["stat/cv"] = query({S("cv"): full(30, "stddev_samp(c) @30 / abs(avg(c) @30)")})
    q["stat/range"] = query({S("range"): full(30, "max(c) @30 - min(c) @30")})
    q["stat/iqr"] = query(*srt, {S("iqr"): "s[23] - s[8]"})
    q["stat/aad"] = query(*srt, {S("aad"): "list_avg(list_transform(a, lambda x: abs(x - md)))"})
    q["stat/robust_zscore"] = query(*srt, {"k": "1.4826 * list_median(list_transform(a, lambda x: abs(x - md)))"}, {S("robz"): "CASE WHEN k > 1e-10 THEN (c - md) / k END"})
    q["stat/median"] = query({S("median"): full(30, "median(c) @30")})
    q["stat/quantile"] = query(*srt, {"close_q05_30": "s[16]"})
    q["stat/pctrank"] = query(a30, {S("pctrank"): "len(list_filter(a, lambda x: x < c)) / 30 * 100"})
    q["stat/minmax"] = query({S("minmax"): full(30, "(c - min(c) @30) / nullif(max(c) @30 - min(c) @30, 0)")})
    q["stat/skew"] = query({S("skew"): full(30, "skewness(c) @30")})
    q["stat/kurtosis"] = query({S("kurt"): full(30, "kurtosis_pop(c) @30")})
    ent = "-list_sum(list_transform(list_filter(list_transform(a, lambda x: x / list_sum(a)), lambda y: y > 0), lambda y: y * log2(y)))"
    q["stat/entropy"] = query({"a": LIST(10)}, {S("entropy", 10): f"CASE WHEN i >= 9 THEN {ent} END"})
    q["stat/entropy_rate"] = query({"a": LIST(10)}, {"e": f"CASE WHEN i >= 9 THEN {ent} END"}, {S("entropy_rate", 10): "(e - lag(e, 5) @) / 5"})
    jb = {"a": LIST(30), "m": avg("c", 30), "s": full(30, "stddev_samp(c) @30")}, {"s3": "list_avg(list_transform(a, lambda x: pow((x - m) / s, 3)))", "s4": "list_avg(list_transform(a, lambda x: pow((x - m) / s, 4))) - 3"}
    q["stat/jarque_bera"] = query(*jb, {S("jb"): "CASE WHEN s > 1e-10 THEN 5.0 * (s3 * s3 + s4 * s4 / 4) END"})
    q["stat/above_mean_ratio"] = query(a30, {S("above_mean"): "len(list_filter(a, lambda x: x > m)) / 30"})
    hurst = {"a": LIST(100), "m": avg("c", 100), "s": full(100, "stddev_samp(c) @100")}, {"y": "list_transform(range(1, 101), lambda k: list_sum(a[1:k]) - k * m)"}
    q["stat/hurst"] = query(*hurst, {S("hurst", 100): "CASE WHEN s >= 1e-10 THEN ln((list_max(y) - list_min(y)) / s) / ln(100) END"})
    q["stat/autocorr"] = query({"close_acf1_30": full(0, "coalesce(CASE WHEN isfinite(corr(c, pc) @30) THEN corr(c, pc) @30 END, 0)", 30)})
    vr = {"r1": "ln(c / pc)", "r5": "ln(c / lag(c, 5) @)"}, {"v1": "var_samp(r1) @50", "v5": "var_samp(r5) @45"}
    q["stat/variance_ratio"] = query(*vr, {"close_vr5_50": "CASE WHEN i >= 54 AND v1 > 1e-10 THEN v5 / (5 * v1) END"})
    q["stat/diffusion_coeff"] = query({"vel": V}, {S("diffcoeff"): full(0, "var_samp(vel) @30 / 2", 30)})
    d2 = lambda k: f"pow(ln(greatest(c, 1e-10)) - ln(greatest(lag(c, {k}) @, 1e-10)), 2)"
    q["stat/anomalous_diffusion"] = query({"x": d2(1), "y": d2(10)}, {"s": "avg(x) @59", "t": "avg(y) @50"}, {S("adiff", 60): "CASE WHEN i >= 69 AND s > 1e-20 AND t > 1e-20 THEN ln(t / s) / ln(10) END"})
    q["stat/msd_ratio"] = query({"x": d2(5), "y": d2(10)}, {"s": "avg(x) @55", "t": "avg(y) @50"}, {S("msdr", 60): "CASE WHEN i >= 69 AND s > 1e-20 THEN t / s END"})
    osc = (*DISP, {"od": "lag(d) @"}, {"dd": "d - od"}, {"n": "regr_count(dd, od) @59", "sxx": "regr_sxx(dd, od) @59", "sl": "regr_slope(dd, od) @59"}, {"k": "CASE WHEN i >= 60 AND n > 5 AND sxx > 1e-20 THEN -sl END"})
    q["stat/spring_constant"] = query(*osc, {S("spring_k", 60): "k"})
    q["stat/plastic_strain"] = query(*osc, {"r": "corr(-dd, od) @59"}, {S("plastic", 60): "CASE WHEN i >= 60 AND n > 5 AND isfinite(r) THEN 1 - greatest(r, 0) END"})
    q["stat/escape_velocity"] = query(*osc, {"ev": "sqrt(2 * greatest(k, 1e-20) * abs(d))"}, {S("vesc", 60): "CASE WHEN k IS NOT NULL AND abs(d) > 1e-10 AND ev > 1e-20 THEN abs(vv) / ev END"})
    nat = {"m50": avg("c", 50)}, {"sg": "sign(c - m50)"}, {"cr": "CASE WHEN sg <> lag(sg) @ THEN 1 ELSE 0 END", "kn": "CASE WHEN sg IS NOT NULL THEN 1 END"}
    q["stat/natural_frequency"] = query(*nat, {S("natfreq", 60): "CASE WHEN i >= 60 AND count(kn) @60 >= 4 THEN pi() * sum(cr) @59 / count(kn) @60 END"})
    ann = "sqrt(252)"
    q["stat/realized_vol"] = query({"r": "pow(ln(c / pc), 2)"}, {"realized_vol_30": full(0, f"sqrt(sum(r) @30 / 30) * {ann}", 30)})
    q["stat/parkinson_vol"] = query({"parkinson_vol_30": full(30, f"sqrt(sum(pow(ln(h / l), 2)) @30 / (4 * ln(2) * 30)) * {ann}")})
    q["stat/garman_klass_vol"] = query({"gk_vol_30": full(30, f"sqrt(greatest(avg(0.5 * pow(ln(h / l), 2) - (2 * ln(2) - 1) * pow(ln(c / o), 2)) @30, 0)) * {ann}")})
    RS = "ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o)"
    q["stat/rogers_satchell_vol"] = query({"rs_vol_30": full(30, f"sqrt(greatest(avg({RS}) @30, 0)) * {ann}")})
    k = 0.34 / (1.34 + 31 / 29)
    q["stat/yang_zhang_vol"] = query({"n": "ln(o / pc)", "d": "ln(c / o)", "rs": RS}, {"yz_vol_30": full(0, f"sqrt(var_samp(n) @30 + {k!r} * var_samp(d) @30 + {1 - k!r} * greatest(avg(rs) @30, 0)) * {ann}", 30)})
    q["stat/correlation"] = query({"close_volume_corr_30": full(30, "coalesce(CASE WHEN isfinite(corr(c, v) @30) THEN corr(c, v) @30 END, 0)")})
    q["stat/beta"] = query({"bm": "avg(c) OVER (PARTITION BY ts)"}, {"rx": "c / pc - 1", "ry": "bm / lag(bm) @ - 1"}, {"n": "regr_count(rx, ry) @30", "vr": "var_samp(CASE WHEN rx IS NOT NULL THEN ry END) @30"}, {"close_beta_30": "CASE WHEN i >= 29 AND n > 2 AND vr > 1e-10 THEN covar_samp(rx, ry) @30 / vr END"})
    q["stat/rsquared"] = query({"close_r2_30": full(30, "CASE WHEN var_pop(c) @30 * 30 > 1e-10 THEN regr_r2(c, i) @30 END")})
    q["stat/linreg_slope"] = query({"close_slope_30": full(30, "regr_slope(c, i) @30")})
    q["stat/linreg_intercept"] = query({"close_intercept_30": full(30, "regr_intercept(c, i) @30 + regr_slope(c, i) @30 * (i - 29)")})
    q["stat/linreg_residual"] = query({"close_residual_30": full(30, "c - regr_intercept(c, i) @30 - regr_slope(c, i) @30 * i")})
    q["perf/log_ret"] = query({"logret_1_close": "ln(c) - ln(pc)"})
    q["perf/pct_ret"] = query({"pct_ret_1_close": "c / pc - 1"})
    ar = {"vel": V}, {"pv1": "lag(vel) @"}
    q["stat/ar_coefficient"] = query(*ar, {"close_ar_coeff_100": full(0, "sum(vel * pv1) @99 / nullif(sum(pv1 * pv1) @99, 0)", 100)})
    # cycles: the analytic signal's last sample from its definition as sums over the detrended window
    for p in (20, 40, 50):
        fit = [line(p, j) for j in range(p)]
        gain = [1.0] + [2.0] * ((p - 1) // 2) + [1.0] + [0.0] * ((p - 1) // 2)
        re = [sum(g * math.cos(2 * math.pi * f * (p - 1 - j) / p) for f, g in enumerate(gain)) / p for j in range(p)]
        im = [sum(g * math.sin(2 * math.pi * f * (p - 1 - j) / p) for f, g in enumerate(gain)) / p for j in range(p)]
        off = lambda w: [w[j] - sum(w[m] * fit[m][j] for m in range(p)) for j in range(p)]  # noqa: B023, E731
        globals()[f"_CYCLE_{p}"] = ({f"a{p}": LIST(p)}, {f"re{p}": dot(f"a{p}", off(re)), f"im{p}": dot(f"a{p}", off(im))})
    c40, c20, c50 = (globals()[f"_CYCLE_{p}"] for p in (40, 20, 50))
    amp, ang_, wrap = "sqrt(re40 * re40 + im40 * im40)", "atan2(im{0}, re{0})", "CASE WHEN {0} > pi() THEN {0} - 2 * pi() WHEN {0} < -pi() THEN {0} + 2 * pi() ELSE {0} END"
    q["stat/inst_amplitude"] = query(*c40, {S("hamp", 40): amp})
    q["stat/inst_phase"] = query(*c40, {S("hphase", 40): ang_.format(40)})
    freq = lambda p: ({f"ph{p}": ang_.format(p)}, {f"dp{p}": f"ph{p} - lag(ph{p}) @"}, {f"fq{p}": wrap.format(f"dp{p}")})
    q["stat/inst_frequency"] = query(*c40, *freq(40), {S("hfreq", 40): "fq40"})
    q["stat/phase_acceleration"] = query(*c40, *freq(40), {S("phaseaccel", 40): "fq40 - lag(fq40) @"})
    q["stat/constructive_interference"] = query(*both(c20, c50), {"x": "sqrt(re20 * re20 + im20 * im20) * sqrt(re50 * re50 + im50 * im50) * cos(atan2(im20, re20) - atan2(im50, re50))"}, {"close_cinterf_20_50": full(0, "avg(x) @5", 53)})
    q["stat/beat_frequency"] = query(*both(c20, c50), *both(freq(20), freq(50)), {"close_beatfreq_20_50": "abs(fq20 - fq50)"})
    q["stat/standing_wave_ratio"] = query(*c40, {"am": amp}, {"lo": "min(am) @20", "hi": "max(am) @20"}, {S("swr", 40): "CASE WHEN i >= 58 AND lo > 1e-10 THEN hi / lo END"})
    # spectra of order: patterns of three returns
    pat = {"vel": V}, {"x1": "lag(vel, 2) @", "x2": "lag(vel, 1) @"}, {"pt": "CASE WHEN x1 IS NOT NULL THEN CAST(x1 > x2 AS INTEGER) * 4 + CAST(x1 > vel AS INTEGER) * 2 + CAST(x2 > vel AS INTEGER) END"}, {"a": "CASE WHEN i >= 100 THEN list(pt) @98 END"}
    pent = "-list_sum(list_transform(range(8), lambda k: CASE WHEN len(list_filter(a, lambda x: x = k)) > 0 THEN len(list_filter(a, lambda x: x = k)) / 98 * log2(len(list_filter(a, lambda x: x = k)) / 98) ELSE 0 END)) / log2(6)"
    q["stat/permutation_entropy"] = query(*pat, {S("perm_entropy", 100): f"CASE WHEN i >= 100 THEN {pent} END"})
    q["stat/zero_crossing_rate"] = query({"a": LIST(64)}, {"mn": "list_avg(a)", "sl": dot("a", [(k - 31.5) / sum((j - 31.5) ** 2 for j in range(64)) for k in range(64)])}, {"d": "list_transform(range(1, 65), lambda k: a[k] - mn - sl * (k - 32.5) >= 0)"}, {S("zcr", 64): "CASE WHEN i >= 63 THEN len(list_filter(range(2, 65), lambda k: d[k] <> d[k - 1])) / 63 END"})
    q["stat/cross_sectional"] = query({"n": "count(c) OVER (PARTITION BY ts)"}, {"close_cs_rank": "(rank() OVER (PARTITION BY ts ORDER BY c) + (count(*) OVER (PARTITION BY ts, c) - 1) / 2) / n", "close_cs_zscore": "(c - avg(c) OVER (PARTITION BY ts)) / nullif(stddev_samp(c) OVER (PARTITION BY ts), 0)", "close_cs_mean": "avg(c) OVER (PARTITION BY ts)"})
    oracle_windows.add(q, query, DISP)
    own = oracle_windows.strength("0", "100")
    extreme = "15 * CASE WHEN f0 > 0 AND ind < 30 THEN (30 - ind) / 30 ELSE 0 END + 15 * CASE WHEN f1 > 0 AND ind > 70 THEN (ind - 70) / 30 ELSE 0 END"
    div = lambda tag: {f"{tag}_div_{kind}": f"f{k}" for k, kind in enumerate(("bullish", "bearish", "hidden_bullish", "hidden_bearish"))}
    q["divergence/rsi"] = query(*rsi, {"ind": RSI}, {"rsi_14": "ind"} | div("rsi") | {"rsi_div_strength": f"least({own} + {extreme}, 100)"}, extra=oracle_windows.divergence())
    lines = (*two, {"m": "f - s"}, *emas("sig", "m", 9, 25), {"ind": "m - sig", "om": "lag(m) @", "os": "lag(sig) @"}, {"up": "CAST(coalesce(m > sig AND om <= os, false) AS INT)", "dn": "CAST(coalesce(m < sig AND om >= os, false) AS INT)"})
    own = oracle_windows.strength("min(ind) @100", "max(ind) @100")
    crossed = "10 * CASE WHEN f0 > 0 AND max(up) @6 > 0 THEN 1 ELSE 0 END + 10 * CASE WHEN f1 > 0 AND max(dn) @6 > 0 THEN 1 ELSE 0 END"
    q["divergence/macd"] = query(*lines, {"macd_12_26": "m", "macd_signal_9": "sig", "macd_hist_12_26": "ind"} | div("macd") | {"macd_div_strength": f"least({own} + {crossed}, 100)"}, extra=oracle_windows.divergence())
    for name, make in pipes.MODULES.items():
        q[f"pipe/{name}"] = preset(q, make())
    for k in [k for k in q if k.count("/") > 1]:  # periods that only presets have
        del q[k]
    out = {k.replace("/", "_"): v for k, v in q.items()}
    out["flagship"] = query({"tr": TR}, *both(rmas("up", f"greatest({D}, 0)", 14), rmas("dn", f"greatest(-({D}), 0)", 14)), {"m": avg("c", 20), "s": full(20, "stddev_pop(c) @20")}, {"close_sma_20": "m", "true_range": "tr", "rsi_14": RSI, "bb_upper_20": "m + 2 * s", "bb_middle_20": "m", "bb_lower_20": "m - 2 * s", "bb_width_20": "100 * 4 * s / m", "bb_pct_20": "(c - m + 2 * s) / (4 * s + 1e-10)"})
    out["normalized_roc"] = query({"x": "100 * (c - lag(c, 10) @) / nullif(lag(c, 10) @, 0)"}, {"roc_10_norm": z("x", 60)})
    out["normalized_sma"] = query({"m": avg("c", 20)}, {"close_sma_20_norm": "CASE WHEN m IS NOT NULL THEN greatest(least((c - m) / (c + 1e-10), 1), -1) END"})
    out["bars"] = query({"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"})
    return out
