"""Expressions over ordered bars that know when their columns exist.

An expression is SQL text plus the stage at which the columns it names are
there. A window function can't stand inside another, so each becomes a named
column of the next stage; the same text is never computed twice. Kernels
(Python over one series) open a new level: all that can be done before them is
done natively, then all kernels of a level run in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

#: Filled in by the plan: the columns that part the bars into series, and the one that orders them.
KEYS, ORDER = "@keys@", "@order@"


def literal(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"{v}"
    return f"{float(v)!r}D"


class X:
    """An expression; arithmetic on it gives null where SQL would divide by zero."""

    __slots__ = ("b", "sql", "level", "depth")

    def __init__(self, b: Builder, sql: str, level: int = 0, depth: int = 0):
        self.b, self.sql, self.level, self.depth = b, sql, level, depth

    def _mix(self, sql: str, *others) -> X:
        level, depth = max((x.level, x.depth) for x in (self, *others) if isinstance(x, X))
        return X(self.b, sql, level, depth)

    def _two(self, op: str, o, swap: bool = False) -> X:
        a, b = self.sql, o.sql if isinstance(o, X) else literal(o)
        a, b = (b, a) if swap else (a, b)
        return self._mix(f"try_divide({a}, {b})" if op == "/" else f"({a} {op} {b})", o)

    def __add__(self, o):
        return self._two("+", o)

    def __radd__(self, o):
        return self._two("+", o, True)

    def __sub__(self, o):
        return self._two("-", o)

    def __rsub__(self, o):
        return self._two("-", o, True)

    def __mul__(self, o):
        return self._two("*", o)

    def __rmul__(self, o):
        return self._two("*", o, True)

    def __truediv__(self, o):
        return self._two("/", o)

    def __rtruediv__(self, o):
        return self._two("/", o, True)

    def __gt__(self, o):
        return self._two(">", o)

    def __ge__(self, o):
        return self._two(">=", o)

    def __lt__(self, o):
        return self._two("<", o)

    def __le__(self, o):
        return self._two("<=", o)

    def __and__(self, o):
        return self._two("AND", o)

    def __or__(self, o):
        return self._two("OR", o)

    def __neg__(self):
        return self._mix(f"(- {self.sql})")

    def eq(self, o):
        return self._two("=", o)

    def f(self, name: str, *args) -> X:
        rest = [a.sql if isinstance(a, X) else literal(a) for a in args]
        return self._mix(f"{name}({', '.join([self.sql, *rest])})", *args)

    def sq(self) -> X:
        return self * self

    def abs(self) -> X:
        return self.f("abs")

    def ln(self) -> X:
        return self.f("ln")

    def sqrt(self) -> X:
        return self._mix(f"CASE WHEN {self.sql} >= 0 THEN sqrt({self.sql}) END")

    def known(self) -> X:
        return self._mix(f"({self.sql} IS NOT NULL)")

    def or_else(self, o) -> X:
        return self.f("coalesce", o)

    def when(self, cond: X, other=None) -> X:
        """This where ``cond`` holds, else ``other``."""
        tail = "" if other is None else f" ELSE {other.sql if isinstance(other, X) else literal(other)}"
        return self._mix(f"CASE WHEN {cond.sql} THEN {self.sql}{tail} END", cond, other)

    def column(self) -> X:
        """A column of the next stage that holds this."""
        return self.b.place(self.sql, self.level, self.depth) if not self.sql.isidentifier() else self

    # windows

    def over(self, calls: str, p: int | None, back: int = 0) -> X:
        """``calls`` (SQL with ``{w}`` for the frame of the last ``p`` rows, all if None) as a column."""
        start = "UNBOUNDED" if p is None else p - 1 + back
        end = f"{back} PRECEDING" if back else "CURRENT ROW"
        w = f"(PARTITION BY {KEYS} ORDER BY {ORDER} ROWS BETWEEN {start} PRECEDING AND {end})"
        return self.b.place(calls.replace("{w}", w), self.level, self.depth)

    def agg(self, name: str, p: int | None, least: int | None = None, *more: X) -> X:
        """``name`` over the last ``p`` rows where at least ``least`` (all, by default) are known."""
        need = p if least is None else least
        args = ", ".join([self.sql, *(x.sql for x in more)])
        call = f"{name}({args}) OVER {{w}}"
        if name == "corr":  # the built-in one fails on a column without variance
            a, o = self.sql, more[0].sql
            spread = " * ".join(f"stddev_pop(CASE WHEN {q} IS NOT NULL THEN {p} END) OVER {{w}}" for p, q in ((a, o), (o, a)))
            call = f"try_divide(covar_pop({args}) OVER {{w}}, {spread})"
        x = self._mix(self.sql, *more)
        if not need:
            return x.over(call, p)
        known = args if len(more) == 0 else f"CASE WHEN {' AND '.join(f'{y.sql} IS NOT NULL' for y in (self, *more))} THEN 1 END"
        return x.over(f"CASE WHEN count({known}) OVER {{w}} >= {need} THEN {call} END", p)

    def lag(self, k: int = 1) -> X:
        return self.b.place(f"lag({self.sql}, {k}) OVER (PARTITION BY {KEYS} ORDER BY {ORDER})", self.level, self.depth) if k else self

    def mean(self, p, least=None):
        return self.agg("avg", p, least)

    def sum(self, p, least=None):
        return self.agg("sum", p, least)

    def min(self, p, least=None):
        return self.agg("min", p, least)

    def max(self, p, least=None):
        return self.agg("max", p, least)

    def std(self, p, least=None):
        return self.agg("stddev_samp", p, least)

    def var(self, p, least=None):
        return self.agg("var_samp", p, least)

    def count(self, p):
        return self.agg("count", p, 0)

    def array(self, p) -> X:
        """The last ``p`` values, oldest first, where all are known."""
        return self.agg("collect_list", p)

    def sorted(self, p) -> X:
        return self.array(p).f("array_sort")

    def each(self, lam: str, *refs: X) -> X:
        """transform; ``lam`` is SQL of ``v`` (and of the ``refs``)."""
        return self._mix(f"transform({self.sql}, v -> {lam})", *refs)

    def total(self) -> X:
        return self._mix(f"aggregate({self.sql}, 0D, (s, t) -> s + t)")

    def dot(self, weights: Sequence[float]) -> X:
        """The sum of products with constant weights."""
        own = ", ".join(literal(float(w)) for w in weights)
        return self._mix(f"aggregate(zip_with({self.sql}, array({own}), (s, t) -> s * t), 0D, (s, t) -> s + t)")

    def fir(self, weights: Sequence[float]) -> X:
        return self.array(len(weights)).dot(weights)


@dataclass
class Kernel:
    fn: Callable
    inputs: list[str]
    outputs: list[str]
    params: dict


@dataclass
class Builder:
    """Collects the columns that a set of operators needs."""

    stages: dict[tuple[int, int], dict[str, str]] = field(default_factory=dict)
    kernels: dict[int, list[Kernel]] = field(default_factory=dict)
    names: dict[tuple, str | list[str]] = field(default_factory=dict)

    def place(self, sql: str, level: int, depth: int) -> X:
        key = (sql, level)
        if key not in self.names:
            self.names[key] = f"_w{len(self.names)}"
            self.stages.setdefault((level, depth + 1), {})[self.names[key]] = sql
        return X(self, self.names[key], level, depth + 1)

    def col(self, name: str) -> X:
        return X(self, f"`{name}`" if not name.isidentifier() else name)

    def const(self, v) -> X:
        return X(self, literal(v))

    def sql(self, text: str, *refs: X) -> X:
        return self.const(0)._mix(text, *refs)

    @property
    def i(self) -> X:
        """The row number in its series, from 0."""
        return self.place(f"row_number() OVER (PARTITION BY {KEYS} ORDER BY {ORDER}) - 1", 0, 0)

    def kernel(self, fn: Callable, inputs: Sequence[X], outputs: int = 1, **params) -> list[X] | X:
        """Columns that ``fn(*arrays, **params)`` makes of the series of ``inputs``."""
        cols = [x.column() for x in inputs]
        level = max(x.level for x in cols)
        key = (fn.__module__, fn.__qualname__, tuple(x.sql for x in cols), tuple(sorted(params.items())), outputs)
        if key not in self.names:
            self.names[key] = [f"_k{len(self.names)}_{j}" for j in range(outputs)]
            self.kernels.setdefault(level, []).append(Kernel(fn, [x.sql for x in cols], self.names[key], params))
        made = [X(self, name, level + 1, 0) for name in self.names[key]]
        return made[0] if outputs == 1 else made

    def greatest(self, *xs) -> X:
        return xs[0].f("greatest", *xs[1:])

    def least(self, *xs) -> X:
        return xs[0].f("least", *xs[1:])

    # what many operators share

    @property
    def o(self):
        return self.col("open")

    @property
    def h(self):
        return self.col("high")

    @property
    def l(self):  # noqa: E743
        return self.col("low")

    @property
    def c(self):
        return self.col("close")

    @property
    def vol(self):
        return self.col("volume")

    @property
    def tr(self) -> X:
        pc = self.c.lag()
        return self.greatest(self.h - self.l, (self.h - pc).abs(), (self.l - pc).abs())

    def log_return(self, x: X, k: int = 1) -> X:
        old = x.lag(k)
        return (x / old).ln().when((x > 0) & (old > 0))

    def log_floor(self, x: X) -> X:
        return self.greatest(x, 1e-10).ln().when(x.known())

    def change(self, x: X) -> X:
        """The difference to the row before, 0 in the first."""
        return (x - x.lag()).or_else(0.0)
