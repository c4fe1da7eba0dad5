"""DuckDB SQL for operators whose windows need lists: histograms, complexity, control and spectra.

As in :mod:`tidemark.plans.oracle`, each entry is written from the operator's
definition with its default parameters. ``a`` is a window's list of values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

RETURN = "CASE WHEN c > 0 AND pc > 0 THEN ln(c / pc) END"


def returns(p: int) -> tuple[dict, dict]:
    return {"vel": RETURN}, {"a": f"CASE WHEN i >= {p} THEN list(vel) @{p} END"}


def prices(p: int) -> tuple[dict]:
    return ({"a": f"CASE WHEN i >= {p - 1} THEN list(c) @{p} END"},)


def each(n: str | int, body: str, var: str = "k", first: int = 1) -> str:
    """A list of ``body`` for ``var`` from ``first`` to ``n``."""
    return f"list_transform(range({first}, CAST({n} AS BIGINT) + 1), lambda {var}: {body})"


def total(n: str | int, body: str, var: str = "k", first: int = 1) -> str:
    return f"list_sum({each(n, body, var, first)})"


def edges(lst: str, tag: str = "") -> dict:
    """The first edge and the spread of a list's equal bins; a flat list has one unit around it."""
    lo, hi = f"list_min({lst})", f"list_max({lst})"
    return {f"lo{tag}": f"CASE WHEN {lo} = {hi} THEN {lo} - 0.5 ELSE {lo} END", f"wd{tag}": f"CASE WHEN {lo} = {hi} THEN 1.0 ELSE {hi} - {lo} END"}


def bin_of(x: str, bins: int, tag: str = "") -> str:
    """How many inner edges lie at or below ``x``."""
    return f"len(list_filter(range(1, {bins}), lambda e: {x} >= lo{tag} + e * (wd{tag} / {bins})))"


def codes(lst: str, bins: int, tag: str = "") -> str:
    return f"list_transform({lst}, lambda x: {bin_of('x', bins, tag)})"


def counts(coded: str, bins: int) -> str:
    return f"list_transform(range({bins}), lambda b: len(list_filter({coded}, lambda x: x = b)))"


def smooth(cnt: str, n: str | int) -> str:
    """Shares that are nowhere zero."""
    raw = f"list_transform({cnt}, lambda x: x / {n} + 1e-10)"
    return f"list_transform({raw}, lambda x: x / list_sum({raw}))"


def relative(p: str, q: str, bins: int) -> str:
    return total(bins, f"{p}[k] * log2({p}[k] / {q}[k])")


def line_rest(n: int) -> dict:
    """``d``: the window ``a`` of ``n`` values less its line, null where that is flat."""
    t = [k - (n - 1) / 2 for k in range(n)]
    sxx = sum(x * x for x in t)
    slope = total(n, f"a[k] * (k - {(n + 1) / 2})")
    return {"mn": "list_avg(a)", "sl": f"{slope} / {sxx!r}"}, {"d0": each(n, f"a[k] - mn - sl * (k - {(n + 1) / 2})")}, {"d": "CASE WHEN list_stddev_pop(d0) >= 1e-10 THEN d0 END"}


def spectrum(n: int) -> tuple[dict, ...]:
    """``p``: the power at the frequencies k / n, k from 1 to n / 2."""
    wave = lambda f: total(n, f"d[j] * {f}(2 * pi() * f * (j - 1) / {n})", "j")
    power = f"pow({wave('cos')}, 2) + pow({wave('sin')}, 2)"
    return (*prices(n), *line_rest(n), {"p0": each(n // 2, power, "f")}, {"p": "CASE WHEN list_sum(p0) >= 1e-10 THEN p0 END", "pt": "CASE WHEN list_sum(p0) >= 1e-10 THEN list_sum(p0) END"})


def moment(n: int, k: int) -> str:
    return total(n // 2, f"pow(k / {n}.0 - ct, {k}) * p[k]") + " / pt"


def filters(n: int, count: int) -> list[list[float]]:
    """Triangles over the frequencies k / n, their corners evenly spaced in the logarithm."""
    f = [k / n for k in range(1, n // 2 + 1)]
    lo, hi = math.log(f[0]), math.log(f[-1])
    mid = [f[0], *(math.exp(lo + (hi - lo) * k / (count + 1)) for k in range(1, count + 1)), f[-1]]
    return [[max(0.0, min((x - mid[m]) / (mid[m + 1] - mid[m]), (mid[m + 2] - x) / (mid[m + 2] - mid[m + 1]))) for x in f] for m in range(count)]


def psar(af: float = 0.02, step: float = 0.02, most: float = 0.2) -> str:
    """A row of state a bar: the side, the stop, the extreme it follows and its speed."""
    start = "lead(c) OVER (PARTITION BY pair ORDER BY ts) > c"
    return f"""b AS (SELECT *, coalesce({start}, false) AS rises, lag(h, 2) OVER (PARTITION BY pair ORDER BY ts) AS ph2, lag(l, 2) OVER (PARTITION BY pair ORDER BY ts) AS pl2 FROM $at),
r AS (SELECT pair, i, rises AS up, CASE WHEN rises THEN l ELSE h END AS sar, CASE WHEN rises THEN h ELSE l END AS far, CAST({af!r} AS DOUBLE) AS speed FROM b WHERE i = 0
UNION ALL SELECT pair, i, up <> crossed, CASE WHEN crossed THEN far ELSE stop END,
  CASE WHEN crossed THEN CASE WHEN up THEN l ELSE h END WHEN up THEN greatest(far, h) ELSE least(far, l) END,
  CASE WHEN crossed THEN {af!r} WHEN (up AND h > far) OR (NOT up AND l < far) THEN least(speed + {step!r}, {most!r}) ELSE speed END
FROM (SELECT *, CASE WHEN up THEN l < stop ELSE h > stop END AS crossed FROM (
  SELECT b.pair, b.i, b.h, b.l, r.up, r.far, r.speed,
    CASE WHEN r.up THEN least(r.sar + r.speed * (r.far - r.sar), b.pl, coalesce(b.pl2, b.pl)) ELSE greatest(r.sar + r.speed * (r.far - r.sar), b.ph, coalesce(b.ph2, b.ph)) END AS stop
  FROM r JOIN b ON b.pair = r.pair AND b.i = r.i + 1))),
last AS (SELECT b.*, r.up, r.sar FROM b JOIN r ON r.pair = b.pair AND r.i = b.i)"""


def lempel_ziv(n: int) -> str:
    """The string is cut into the shortest words not found before their own last letter; a last word that is cut short doesn't count."""
    return f"""t AS (SELECT *, list_aggregate(list_transform(a, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS s FROM $at),
r AS (SELECT pair, i, s, 1 AS pos, 1 AS words FROM t WHERE s IS NOT NULL
UNION ALL SELECT pair, i, s, pos + size, words + 1 FROM (
  SELECT *, list_filter(range(1, {n} - pos + 1), lambda z: NOT contains(substr(s, 1, pos + z - 1), substr(s, pos + 1, z)))[1] AS size FROM r WHERE pos < {n}) WHERE size IS NOT NULL),
last AS (SELECT t.*, w.words FROM t LEFT JOIN (SELECT pair, i, max(words) AS words FROM r GROUP BY ALL) w ON w.pair = t.pair AND w.i = t.i)"""


def jma(period: int = 7, phase: float = 0.0) -> str:
    """Bands around the price, their relative volatility, and three smoothing stages, a row of state a bar."""
    half = (period - 1) / 2
    size = max(math.log(math.sqrt(half)) / math.log(2) + 2, 0)
    power = max(size - 2, 0.5)
    reach = size * math.sqrt(half)
    narrow, beta = reach / (reach + 1), 0.45 * (period - 1) / (0.45 * (period - 1) + 2)
    ratio, most = 1.5 + phase / 100, size ** (1 / power)
    none = f"list_transform(range({period}), lambda k: CAST(0 AS DOUBLE))"
    return f"""m AS (SELECT *, avg(c) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW) AS seed FROM $at),
r AS (SELECT pair, i, seed AS y, seed AS s1, seed AS up, seed AS dn, CAST(0 AS DOUBLE) AS drift, CAST(0 AS DOUBLE) AS pull, {none} AS moves, {none} AS sums FROM m WHERE i = {period - 1}
UNION ALL SELECT pair, i, y + pull2, s2, CASE WHEN du > 0 THEN c ELSE c - k * du END, CASE WHEN dd < 0 THEN c ELSE c - k * dd END, drift2, pull2, moves2, sums2 FROM (
 SELECT *, (s2 + {ratio!r} * drift2 - y) * pow(1 - al, 2) + al * al * pull AS pull2 FROM (
  SELECT *, (c - s2) * (1 - {beta!r}) + {beta!r} * drift AS drift2 FROM (
   SELECT *, (1 - al) * c + al * s1 AS s2 FROM (
    SELECT *, pow({beta!r}, rv) AS al, pow({narrow!r}, sqrt(rv)) AS k FROM (
     SELECT *, pow(greatest(1.0, least({most!r}, CASE WHEN tail > 0 THEN move / tail ELSE 0 END)), {power!r}) AS rv FROM (
      SELECT *, list_sum(list_slice(sums2, greatest(len(sums2) - 65, 1), len(sums2))) / least(i + 1, 66) AS tail FROM (
       SELECT *, list_append(sums, sums[len(sums)] + (moves2[len(moves2)] - moves2[greatest(len(moves2) - 10, 1)]) / 10) AS sums2 FROM (
        SELECT *, list_append(moves, move) AS moves2 FROM (
         SELECT *, CASE WHEN abs(du) <> abs(dd) THEN greatest(abs(du), abs(dd)) ELSE 0 END AS move FROM (
          SELECT m.pair, m.i, m.c, r.y, r.s1, r.drift, r.pull, r.moves, r.sums, m.c - r.up AS du, m.c - r.dn AS dd FROM r JOIN m ON m.pair = r.pair AND m.i = r.i + 1))))))))))),
last AS (SELECT m.*, r.y FROM m LEFT JOIN r ON r.pair = m.pair AND r.i = m.i)"""


def divergence(w: int = 5, spacing: int = 10, lookback: int = 100, least: float = 0.02, tolerance: int = 5) -> str:
    """Rows at which close and ``ind`` are first seen moving apart, as ``f0`` to ``f3``: bullish, bearish, hidden bullish, hidden bearish.

    A pivot beats the ``w`` rows before it and is not beaten by the ``w`` after;
    pivots too near the last kept one are passed over. Two neighbouring pivots of
    the close are held against the indicator's pivots nearest to them that are
    known by then, until the close's next pivot is known.
    """
    before, after = (f"OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN {x})" for x in (f"{w} PRECEDING AND 1 PRECEDING", f"1 FOLLOWING AND {w} FOLLOWING"))
    sides = " UNION ALL ".join(
        f"SELECT pair, i, '{src}' AS src, '{kind}' AS kind FROM (SELECT pair, i, {x} AS x, {f}({x}) {before} AS b, {f}({x}) {after} AS n, count({x}) {before} AS cb, count({x}) {after} AS cn FROM base) WHERE cb = {w} AND cn = {w} AND x {beats} b AND x {beats}= n"
        for src, x in (("p", "c"), ("i", "ind"))
        for kind, f, beats in (("hi", "max", ">"), ("lo", "min", "<"))
    )
    fired = lambda name, kind, up, ind: f"(CASE WHEN kind = '{kind}' AND pb {'>' if up else '<'} pa AND iy {'>' if ind else '<'} ix THEN '{name}' END)"
    names = [fired("f0", "lo", False, True), fired("f1", "hi", True, False), fired("f2", "lo", True, False), fired("f3", "hi", False, True)]
    flags = ", ".join(f"CAST(coalesce(bool_or(name = 'f{k}'), false) AS DOUBLE) AS f{k}" for k in range(4))
    return f"""base AS (SELECT *, max(i) OVER (PARTITION BY pair) AS top FROM $at),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair, src, kind ORDER BY i) AS rn FROM ({sides})),
kept AS (SELECT pair, src, kind, rn, i, i AS held, true AS own FROM ranked WHERE rn = 1
  UNION ALL SELECT r.pair, r.src, r.kind, r.rn, r.i, CASE WHEN r.i - k.held >= {spacing} THEN r.i ELSE k.held END, r.i - k.held >= {spacing}
  FROM kept k JOIN ranked r ON r.pair = k.pair AND r.src = k.src AND r.kind = k.kind AND r.rn = k.rn + 1),
pv AS (SELECT *, count(*) OVER (PARTITION BY pair, src, kind) AS many FROM kept WHERE own),
two AS (SELECT pair, kind, i AS a, lead(i) OVER o AS b, lead(i, 2) OVER o AS later FROM pv WHERE src = 'p' WINDOW o AS (PARTITION BY pair, kind ORDER BY i)),
seen AS (SELECT t.*, x.c AS pa, y.c AS pb, unnest(range(b + {w}, least(x.top, a + {lookback}, coalesce(later + {w - 1}, x.top)) + 1)) AS at_row
  FROM two t JOIN base x ON x.pair = t.pair AND x.i = t.a JOIN base y ON y.pair = t.pair AND y.i = t.b WHERE abs(y.c - x.c) / x.c >= {least!r}),
held AS (SELECT s.pair, s.kind, s.a, s.pa, s.pb, s.at_row,
    arg_min(p.i, abs(p.i - s.a) * 1000000 + p.i) FILTER (WHERE abs(p.i - s.a) <= {tolerance}) AS kx, arg_min(p.i, abs(p.i - s.b) * 1000000 + p.i) FILTER (WHERE abs(p.i - s.b) <= {tolerance}) AS ky
  FROM seen s JOIN pv p ON p.pair = s.pair AND p.kind = s.kind AND p.src = 'i' AND p.many >= 2 AND p.i <= s.at_row - {w} GROUP BY ALL),
told AS (SELECT h.*, x.ind AS ix, y.ind AS iy FROM held h JOIN base x ON x.pair = h.pair AND x.i = h.kx JOIN base y ON y.pair = h.pair AND y.i = h.ky),
fires AS (SELECT pair, name, min(at_row) AS i FROM (SELECT pair, a, at_row, unnest([{", ".join(names)}]) AS name FROM told) WHERE name IS NOT NULL GROUP BY pair, name, a),
last AS (SELECT b.*, {flags.replace("bool_or(name", "bool_or(f.name")} FROM base b LEFT JOIN fires f ON f.pair = b.pair AND f.i = b.i GROUP BY ALL)"""


def strength(lo: str, hi: str) -> str:
    """How far the close has moved in 15 rows and how extreme the indicator is, from 50 up, where anything fired."""
    place = f"CASE WHEN {hi} > {lo} AND ind IS NOT NULL THEN (ind - {lo}) / ({hi} - {lo}) ELSE 0.5 END"
    return f"CASE WHEN f0 + f1 + f2 + f3 > 0 AND i >= 14 THEN least(greatest(50 + least(100 * (max(c) @15 - min(c) @15) / avg(c) @15, 25) + 25 * least({place}, 1 - ({place})), 0), 100) ELSE 0.0 END"


def add(q: dict[str, str], query: Callable, disp: tuple[dict, ...]) -> None:
    """Entries by operator name; ``query`` and ``disp`` (``d``, the displacement) are the oracle's."""
    # histograms
    a30 = prices(30)[0]
    q["stat/mode_distance"] = query(a30, edges("a"), {"z": codes("a", 10)}, {"n": counts("z", 10)}, {"k": "list_position(n, list_max(n))"}, {"close_mode_dist_30": "CASE WHEN i >= 29 THEN c - (lo + (k - 0.5) * (wd / 10)) END"})
    r100 = (*returns(100), edges("a"), {"z": codes("a", 20)}, {"n": counts("z", 20)})
    q["stat/fisher_information"] = query(*r100, {"dx": "wd / 20", "e": "list_transform(n, lambda x: x / 100 / (wd / 20))"}, {"close_fisher_info_100": f"CASE WHEN i >= 100 AND dx >= 1e-20 THEN {total(19, 'CASE WHEN e[k] + e[k + 1] > 2e-20 THEN pow(e[k + 1] - e[k], 2) / ((e[k + 1] + e[k]) / 2) ELSE 0 END')} / dx END"})
    q["stat/renyi_entropy"] = query(*r100, {"close_renyi_100": "CASE WHEN i >= 100 THEN -log2(list_sum(list_transform(n, lambda x: pow(x / 100, 2)))) / log2(20) END"})
    halves = (*returns(100), edges("a"), {"z": codes("a", 20)}, {"n1": counts("z[1:50]", 20), "n2": counts("z[51:100]", 20)}, {"p": smooth("n1", 50), "q": smooth("n2", 50)}, {"m": each(20, "(p[k] + q[k]) / 2")})
    q["stat/info_gain"] = query(*halves, {"close_info_gain_100": f"CASE WHEN i >= 100 THEN ({relative('p', 'm', 20)} + {relative('q', 'm', 20)}) / 2 END"})
    recent = (*returns(200), edges("a"), {"z": codes("a", 20)}, {"n1": counts("z[151:200]", 20), "n2": counts("z", 20)}, {"p": smooth("n1", 50), "q": smooth("n2", 200)}, {"m": each(20, "(p[k] + q[k]) / 2")})
    q["stat/kl_divergence"] = query(*recent, {"close_kl_div_200": f"CASE WHEN i >= 200 THEN {relative('p', 'q', 20)} END"})
    q["stat/js_divergence"] = query(*recent, {"close_js_div_200": f"CASE WHEN i >= 200 THEN ({relative('p', 'm', 20)} + {relative('q', 'm', 20)}) / 2 END"})
    now = {"x": "a[2:100]", "y": "a[1:99]"}, edges("x", "x") | edges("y", "y"), {"bx": codes("x", 15, "x"), "b2": codes("y", 15, "y")}
    joint = {"j": each(99, "bx[k] * 15 + b2[k]")}, {"hx": "list_transform(range(15), lambda b: len(list_filter(bx, lambda v: v = b)) / 99)", "hy": "list_transform(range(15), lambda b: len(list_filter(b2, lambda v: v = b)) / 99)", "hj": "list_transform(range(225), lambda b: len(list_filter(j, lambda v: v = b)) / 99)"}
    info = total(224, "CASE WHEN hj[k + 1] > 1e-10 THEN hj[k + 1] * log2(hj[k + 1] / (hx[k // 15 + 1] * hy[k % 15 + 1])) ELSE 0 END", first=0)
    q["stat/auto_mutual_info"] = query(*returns(100), *now, *joint, {"close_ami_100": f"CASE WHEN i >= 100 THEN {info} END"})
    # order and memory
    same = lambda m: f"len(list_filter(range(k + 1, 79), lambda j: {' AND '.join(f'abs(a[k + {s}] - a[j + {s}]) <= r' for s in range(m))}))"
    q["stat/sample_entropy"] = query(*returns(80), {"s": "list_stddev_samp(a)"}, {"r": "0.2 * s"}, {"n2": total(77, same(2)), "n3": total(77, same(3))}, {"close_sampen_80": "CASE WHEN s >= 1e-10 AND n2 > 0 THEN CASE WHEN n3 > 0 THEN -ln(n3 / n2) ELSE ln(n2) END END"})
    q["stat/lempel_ziv"] = query(*returns(100), {"close_lzc_100": "words / (100 / log2(100))"}, extra=lempel_ziv(100))
    sizes = sorted({int(10 ** (math.log10(4) + (math.log10(50) - math.log10(4)) * k / 14)) for k in range(15)} - {0})
    sizes = [s for s in sizes if 4 <= s <= 50]

    def fluctuation(s: int) -> str:
        boxes, sxx = 200 // s, sum((k - (s - 1) / 2) ** 2 for k in range(s))
        part = f"y[b * {s} + 1 : b * {s} + {s}]"
        held = f"list_sum(list_transform({part}, lambda v: v * v)) - pow(list_sum({part}), 2) / {s} - pow({total(s, f'y[b * {s} + k] * (k - {(s + 1) / 2})')}, 2) / {sxx!r}"
        return f"ln(sqrt({total(boxes - 1, held, 'b', 0)} / {boxes * s}))"

    x = [math.log(s) for s in sizes]
    mx = sum(x) / len(x)
    sxx = sum((v - mx) ** 2 for v in x)
    q["stat/dfa"] = query(*returns(200), {"m": "list_avg(a)"}, {"y": each(200, "list_sum(a[1:k]) - k * m")}, {f"f{s}": fluctuation(s) for s in sizes}, {"close_dfa_200": "CASE WHEN i >= 200 THEN " + " + ".join(f"f{s} * {(v - mx) / sxx!r}" for s, v in zip(sizes, x)) + " END"})
    later, before = "a[l + 1 : 100]", "a[1 : 100 - l]"
    mean = {"z": "list_transform(a, lambda v: v - list_avg(a))"}
    later, before = "z[l + 1 : 100]", "z[1 : 100 - l]"
    falls = f"list_filter(range(1, 21), lambda l: {total('100 - l', 'z[k + l] * z[k]')} - list_sum({later}) * list_sum({before}) / (100 - l) <= 0)"
    q["stat/correlation_length"] = query({"vel": RETURN}, {"a": "CASE WHEN i >= 119 THEN list(vel) @100 END"}, mean, {"close_corrlen_100": f"CASE WHEN i >= 119 THEN coalesce(CAST({falls}[1] AS DOUBLE), 20.0) END"})
    peaks = {"a": "CASE WHEN i >= 60 THEN list(abs(d)) FILTER (WHERE d IS NOT NULL) @60 END"}, {"pk": "list_transform(list_filter(range(2, len(a)), lambda k: a[k] > a[k - 1] AND a[k] > a[k + 1]), lambda k: a[k])"}
    logs = {"g": "list_transform(list_filter(range(1, len(pk)), lambda k: pk[k] > 1e-10 AND pk[k + 1] > 1e-10), lambda k: ln(pk[k] / pk[k + 1]))"}, {"dl": "CASE WHEN len(g) > 0 THEN list_avg(g) END"}
    q["stat/damping_ratio"] = query(*disp, *peaks, *logs, {"close_damping_60": "dl / sqrt(4 * pi() * pi() + dl * dl)"})
    near = "list_min(list_transform(list_filter(range(1, 189), lambda j: abs(j - k) > 1), lambda j: {'d': CASE WHEN g2(k, j) <= 1e-40 THEN CAST('inf' AS DOUBLE) ELSE g2(k, j) END, 'j': j}))['j']"
    gap = lambda m, n: " + ".join(f"pow(a[{m} + {s}] - a[{n} + {s}], 2)" for s in range(3))
    near = near.replace("g2(k, j)", f"({gap('k', 'j')})")
    paths = {"nn": each(188, near)}, {f"g{t}": f"list_avg(list_filter(list_transform(range(1, 189), lambda k: ln(sqrt({gap(f'(k + {t})', f'(nn[k] + {t})')}))), lambda v: isfinite(v)))" for t in range(10)}
    q["stat/lyapunov_exponent"] = query(*returns(200), *paths, {"close_lyapunov_200": "CASE WHEN i >= 200 THEN " + " + ".join(f"g{t} * {(t - 4.5) / 82.5!r}" for t in range(10)) + " END"})
    # control
    steps = {"r": "list_var_pop(a)"}, {"st": "list_reduce(list_transform(range(1, 101), lambda k: {'x': a[k], 'e': a[1], 'p': r, 't': CAST(0 AS DOUBLE), 'k': k}), lambda s, y: {'x': y.x, 'e': s.e + (s.p + 0.01 * r) / (s.p + 1.01 * r) * (y.x - s.e), 'p': (1 - (s.p + 0.01 * r) / (s.p + 1.01 * r)) * (s.p + 0.01 * r), 't': s.t + CASE WHEN y.k >= 51 THEN pow(y.x - s.e, 2) / (s.p + 1.01 * r) ELSE 0 END, 'k': y.k})"}
    q["stat/kalman_innovation"] = query(*returns(100), *steps, {"close_kalman_innov_100": "CASE WHEN r >= 1e-20 THEN st.t / 50 END"})
    held = total("t", "pow(0.95, t - k) * e[k]")
    q["stat/pid_error"] = query(*returns(100), {"m": "list_avg(a)"}, {"e": "list_transform(a, lambda v: v - m)"}, {"close_pid_error_100": f"sqrt({total(100, f'pow(e[t] + 0.1 * {held} + 0.05 * CASE WHEN t > 1 THEN e[t] - e[t - 1] ELSE 0 END, 2)', 't')} / 100)"})
    sxx66 = sum((k - 32.5) ** 2 for k in range(66))
    q["stat/prediction_error_decomp"] = query(*returns(100), {"m": "list_avg(a[1:66])", "s": f"{total(66, 'a[k] * (k - 33.5)')} / {sxx66!r}"}, {"e": each(100, "a[k] - m - s * (k - 33.5)", first=67)}, {"bias": "pow(list_avg(e), 2)", "spread": "list_var_samp(e)"}, {"close_pred_err_decomp_100": "CASE WHEN bias + spread >= 1e-20 THEN bias / (bias + spread) END"})
    # spectra
    sp = (*spectrum(64), {"ct": total(32, "k / 64.0 * p[k]") + " / pt"})
    S = lambda tag: f"close_{tag}_64"
    q["stat/spectral_centroid"] = query(*sp, {S("scentroid"): "ct"})
    q["stat/spectral_bandwidth"] = query(*sp, {S("sbw"): f"sqrt({moment(64, 2)})"})
    q["stat/spectral_kurtosis"] = query(*sp, {"m2": moment(64, 2), "m4": moment(64, 4)}, {S("skurt"): "CASE WHEN m2 >= 1e-20 THEN m4 / pow(m2, 2) END"})
    q["stat/spectral_entropy"] = query(*sp, {S("sentropy"): "-list_sum(list_transform(p, lambda x: CASE WHEN x / pt > 1e-15 THEN x / pt * ln(x / pt) ELSE 0 END)) / ln(32)"})
    q["stat/spectral_rolloff"] = query(*sp, {S("srolloff"): "CASE WHEN p IS NOT NULL THEN list_filter(range(1, 33), lambda k: list_sum(p[1:k]) >= 0.85 * pt OR k = 32)[1] / 64.0 END"})
    q["stat/spectral_flatness"] = query(*spectrum(64), {S("sflat"): "CASE WHEN list_avg(p0) >= 1e-20 THEN exp(list_avg(list_transform(p0, lambda x: ln(x + 1e-20)))) / list_avg(p0) END"})
    low, high = "ln(1e-20)", "ln(p[32] + 1e-20)"
    cep = f"list_max({each(31, f'abs({low} + {high} * cos(pi() * n) + 2 * ' + total(31, 'ln(p[k] + 1e-20) * cos(2 * pi() * k * n / 64)') + ') / 64', 'n', 2)})"
    q["stat/power_cepstrum"] = query(*sp, {S("cepstrum"): f"CASE WHEN p IS NOT NULL THEN {cep} END"})
    f_sxx = sum(((k - 16.5) / 64) ** 2 for k in range(1, 33))
    q["stat/spectral_slope"] = query(*sp, {S("sslope"): f"{total(32, 'ln(p[k] + 1e-20) * (k - 16.5) / 64.0')} / {f_sxx!r}"})
    q["stat/spectral_contrast"] = query(*sp, {S("scontrast"): f"{total(3, 'ln(list_max(p[8 * k + 1 : 8 * k + 8]) + 1e-20) - ln(list_min(p[8 * k + 1 : 8 * k + 8]) + 1e-20)', first=0)} / 4"})
    bank = filters(64, 20)
    mel = {"g": "[" + ", ".join(f"ln({' + '.join(f'{w!r} * p[{k + 1}]' for k, w in enumerate(row) if w > 0) or '0.0'} + 1e-20)" for row in bank) + "]"}
    q["stat/mfcc_band_energy"] = query(*sp, mel, {S("mfccbe"): f"CASE WHEN p IS NOT NULL THEN sqrt({total(8, 'pow(2 * ' + total(20, 'g[j] * cos(pi() * k * (2 * j - 1) / 40)', 'j') + ', 2)')}) END"})
    q["stat/spectral_flux"] = query(*sp, {"u": "CASE WHEN sqrt(list_sum(list_transform(p, lambda x: x * x))) >= 1e-10 THEN list_transform(p, lambda x: x / sqrt(list_sum(list_transform(p, lambda y: y * y)))) END"}, {"w": "lag(u) @"}, {S("sflux"): f"CASE WHEN w IS NOT NULL AND u IS NOT NULL THEN {total(32, 'pow(u[k] - w[k], 2)')} END"})
    # recursions
    q["trend/psar"] = query({"psar": "sar", "psar_dir": "CASE WHEN up THEN 1.0 ELSE -1.0 END"}, extra=psar())
    q["smooth/jma"] = query({"close_jma_7": "y"}, extra=jma())
    # the window's line and the lowest frequencies of what is left, at the last row
    n, keep = 64, max(1, round(32 * 0.1))
    last = "mn + sl * 31.5"
    wave = " + ".join(f"2 * ({total(64, f'd0[j] * cos(2 * pi() * {f} * (64 - j) / 64)', 'j')}) / 64" for f in range(1, keep + 1))
    q["smooth/fft"] = query(*prices(n), *line_rest(n), {"close_fft_64": f"{last} + {wave}"})
