"""How an operator is declared, and the feature objects users make of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.functions.expr import Builder, X

#: Declared operators by name, and their classes by class name.
SPECS: dict[str, Spec] = {}
CLASSES: dict[str, type[Feature]] = {}


@dataclass(frozen=True)
class Spec:
    cls: str
    name: str
    outputs: tuple[str, ...]
    defaults: dict
    build: Callable
    #: "z:<window base>", "pct", or a divisor for a plain rescale; None where there is no normalised form
    norm: str | float | Callable | None
    warmup: str
    requires: tuple[str, ...]
    #: outputs (by place) that the normalised form leaves as they are
    plain: tuple[int, ...]
    check: Callable | None
    doc: str


def norm_window(p: int) -> int:
    return max(int(3 * p), 60)


class Feature:
    """An operator with its parameters."""

    spec: Spec

    def __init__(self, *args, normalized: bool = False, norm_period: int | None = None, **params):
        names = list(self.spec.defaults)
        if len(args) > len(names):
            raise TypeError(f"{self.spec.cls} takes at most {len(names)} parameters")
        given = dict(zip(names, args))
        if twice := given.keys() & params.keys():
            raise TypeError(f"{self.spec.cls}: {sorted(twice)} given twice")
        given |= params
        if unknown := given.keys() - self.spec.defaults.keys():
            raise TypeError(f"{self.spec.cls} has no parameters {sorted(unknown)}")
        if normalized and self.spec.norm is None:
            raise TypeError(f"{self.spec.cls} has no normalised form")
        self.params = self.spec.defaults | given
        self.normalized, self.norm_period = normalized, norm_period
        if self.spec.check:
            self.spec.check(**self.params)

    def __getattr__(self, name):
        try:
            return self.__dict__["params"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __repr__(self):
        own = ", ".join(f"{k}={v!r}" for k, v in self.params.items() if v != self.spec.defaults[k])
        return f"{self.spec.cls}({own}{', normalized=True' if self.normalized else ''})"

    def _eval(self, text: str) -> int:
        return int(eval(text, {"max": max, "min": min, "__builtins__": {}}, self.params))  # noqa: S307 - texts of this library only

    @property
    def requires(self) -> list[str]:
        return [r.format(**self.params) for r in self.spec.requires]

    @property
    def outputs(self) -> list[str]:
        shown = {k: str(v).replace(".", "") if isinstance(v, float) else v for k, v in self.params.items()}
        return [o.format(**shown) + ("_norm" if self.normalized and k not in self.spec.plain else "") for k, o in enumerate(self.spec.outputs)]

    @property
    def window(self) -> int | None:
        """Rows of the normalised form's rolling window."""
        n = self.spec.norm
        return (self.norm_period or norm_window(self._eval(n[2:]))) if isinstance(n, str) and n.startswith("z:") else None

    @property
    def warmup(self) -> int:
        """Rows after which results no longer depend on where the series starts."""
        return self._eval(self.spec.warmup) + ((self.window or 0) if self.normalized else 0)

    def columns(self, b: Builder) -> list[X]:
        made = self.spec.build(b, **self.params)
        made = list(made) if isinstance(made, tuple | list) else [made]
        if not self.normalized:
            return made
        return [x if k in self.spec.plain else self._normal(b, x) for k, x in enumerate(made)]

    def _normal(self, b: Builder, x: X) -> X:
        n = self.spec.norm
        if n == "pct":
            src = b.col(self.params.get("source_col", "close"))
            return b.greatest(b.least((src - x) / (src + 1e-10), 1.0), -1.0).when(x.known() & src.known())
        if callable(n):
            return n(x)
        if isinstance(n, float):
            return x / n
        return zscore(b, x, self.window)

    def transform(self, bars: DataFrame, **places) -> DataFrame:
        """``bars`` with this operator's columns added."""
        from tidemark.plans.engine import Pipeline

        return Pipeline([self], **places).transform(bars)


def zscore(b: Builder, x: X, w: int) -> X:
    """Distance from the mean of the last ``w`` rows in standard deviations, over what is known of them."""
    x = x.column()
    sd = x.std(w, 2)
    return ((x - x.mean(w, 1)) / sd).when((b.i >= w - 1) & (sd > 1e-10))


def operator(cls: str, name: str, *outputs: str, norm=None, warmup: str = "period*5", requires: tuple[str, ...] = ("{source_col}",), plain: tuple[int, ...] = (), check: Callable | None = None, **defaults):
    """Declare an operator: its build function takes a Builder and the parameters and returns its columns."""

    def declare(build: Callable) -> Callable:
        if requires == ("{source_col}",):
            defaults.setdefault("source_col", "close")
        spec = Spec(cls, name, outputs, defaults, build, norm, warmup, requires, plain, check, (build.__doc__ or "").strip())
        SPECS[name] = spec
        CLASSES[cls] = type(cls, (Feature,), {"spec": spec, "__doc__": spec.doc, "__module__": build.__module__})
        return build

    return declare


def need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)
