"""What users plug in: representations, prediction backends, data fetchers, design engines and tools, by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Registry:
    """Names, in any case, and what stands for them."""

    def __init__(self, what: str):
        self.what, self.known = what, {}

    def register(self, name: str, value) -> None:
        self.known[name.lower()] = value

    def names(self) -> list[str]:
        return sorted(self.known)

    def get(self, name: str):
        if (name or "").lower() not in self.known:
            raise KeyError(f"no {self.what} {name!r}; known: {self.names()}")
        return self.known[name.lower()]


@dataclass(frozen=True)
class Capabilities:
    """What a backend can do."""

    tasks: tuple[str, ...] = ("regression",)
    representations: tuple[str, ...] = ()
    uncertainty: bool = False
    several_targets: bool = False
    needs: tuple[str, ...] = ()

    def takes(self, task: str, representation: str | None = None) -> bool:
        return task in self.tasks and (representation is None or not self.representations or representation in self.representations)


@runtime_checkable
class Backend(Protocol):
    """Models of one kind: fit gives a model, predict adds prediction columns to a frame."""

    capabilities: Capabilities

    def fit(self, df: DataFrame, target: str, **options): ...

    def predict(self, model, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class Fetcher(Protocol):
    """A source of assays and activities as frames."""

    def assays(self, keyword: str, organism: str | None = None) -> DataFrame: ...

    def activities(self, assays: DataFrame, kinds: list[str] | None = None) -> DataFrame: ...


@runtime_checkable
class Engine(Protocol):
    """A generator of candidates from a seed: dicts with structure, score and rationale."""

    name: str

    def propose(self, seed: str | None, n: int) -> Iterable[dict]: ...


@dataclass(frozen=True)
class Tool:
    """A function under a name, with arguments that callers cannot change."""

    name: str
    function: Callable
    forced: dict = field(default_factory=dict)

    def __call__(self, **arguments):
        known = inspect.signature(self.function).parameters
        unknown = [k for k in arguments if k not in known and not any(p.kind is p.VAR_KEYWORD for p in known.values())]
        if unknown:
            raise TypeError(f"{self.name} has no arguments {unknown}; it has {[k for k in known if k not in self.forced]}")
        if clash := [k for k in arguments if k in self.forced]:
            raise TypeError(f"{self.name} fixes {clash}")
        return self.function(**{**arguments, **self.forced})


def metrics_by(df: DataFrame, status: str, metric: Callable[[], list[Column]]) -> DataFrame:
    """Metrics by status and over all (status 'all') in one pass: metric gives the aggregate columns."""
    out = df.rollup(status).agg(F.grouping(status).alias("_all"), F.count("*").alias("n"), *metric())
    return out.withColumn(status, F.when(F.col("_all") == 1, "all").otherwise(F.col(status).cast("string"))).drop("_all")


REPRESENTATIONS, BACKENDS, FETCHERS, ENGINES, TOOLS = (Registry(x) for x in ("representation", "backend", "fetcher", "engine", "tool"))


class Trees:
    """The built-in backend: boosted trees on numeric features and categories."""

    capabilities = Capabilities(("regression", "classification"), several_targets=True)

    def fit(self, df: DataFrame, target: str, **options):
        from tessera.operators.models import Boosted

        order = options.pop("order", None)
        return Boosted(options.pop("features"), target, **options).fit(df, order)

    def predict(self, model, df: DataFrame) -> DataFrame:
        return model.predict(df)


BACKENDS.register("trees", Trees())
