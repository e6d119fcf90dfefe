"""Design columns of the deterministic signal over decimal years.

A term is ``name`` or ``name:argument``.  Trend and acceleration are centred on the mean of the whole axis, so every
series shares one design; harmonics, offsets and rate changes use absolute time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class SignalError(ValueError):
    """A signal term that is unknown, deferred or badly written."""


def _none(name: str, argument: str | None) -> None:
    if argument is not None:
        raise SignalError(f"{name} takes no argument, got {argument!r}")


def _number(name: str, argument: str | None) -> float:
    try:
        value = float(argument)
    except (TypeError, ValueError):
        raise SignalError(f"{name} needs a number, got {argument!r}") from None
    if not math.isfinite(value):
        raise SignalError(f"{name} needs a finite number, got {argument!r}")
    return value


Columns = Callable[[Column, Column], list[Column]]


def constant(argument: str | None = None) -> Columns:
    _none("constant", argument)
    return lambda t, mean: [F.lit(1.0)]


def trend(argument: str | None = None) -> Columns:
    _none("trend", argument)
    return lambda t, mean: [t - mean]


def accel(argument: str | None = None) -> Columns:
    _none("accel", argument)
    return lambda t, mean: [(t - mean) * (t - mean) * 0.5]


def harmonic(argument: str | None = None) -> Columns:
    period = _number("harmonic", argument)
    if period <= 0:
        raise SignalError("the period of a harmonic is positive")
    return lambda t, mean: [F.cos(t * (2 * math.pi / period)), F.sin(t * (2 * math.pi / period))]


def annual(argument: str | None = None) -> Columns:
    _none("annual", argument)
    return harmonic("1.0")


def semiannual(argument: str | None = None) -> Columns:
    _none("semiannual", argument)
    return harmonic("0.5")


def offset(argument: str | None = None) -> Columns:
    epoch = _number("offset", argument)
    return lambda t, mean: [(t >= epoch).cast("double")]


def rate_change(argument: str | None = None) -> Columns:
    epoch = _number("rate_change", argument)
    return lambda t, mean: [F.greatest(t - epoch, F.lit(0.0))]


def regressor(argument: str | None = None) -> Columns:
    if not argument:
        raise SignalError("regressor needs the name of a column of the axis")
    return lambda t, mean: [F.col(f"`{argument}`").cast("double")]


#: Terms by name; register more under a new name.
TERMS: dict[str, Callable[[str | None], Columns]] = {"constant": constant, "trend": trend, "accel": accel, "annual": annual, "semiannual": semiannual, "harmonic": harmonic, "offset": offset, "rate_change": rate_change, "regressor": regressor}
DEFERRED = {"exp_decay", "log_decay"}


PER_POINT = "regressor_field:"


def per_point(terms: list[str]) -> list[str]:
    """The names of fields that have a value for each series and time, without their prefix, in order."""
    return [t.strip()[len(PER_POINT) :].strip() for t in terms if t.strip().startswith(PER_POINT)]


def columns_of(terms: list[str]) -> list[str]:
    """The columns of the axis that the terms read."""
    return [t.partition(":")[2].strip() for t in terms if t.partition(":")[0].strip() == "regressor"]


def register(name: str, term: Callable[[str | None], Columns]) -> None:
    if name in TERMS:
        raise SignalError(f"the signal term {name!r} is registered already")
    TERMS[name] = term


def parse(term: str) -> Columns:
    """The column builder of one written term."""
    name, _, argument = term.partition(":")
    if per_point([term]):
        raise SignalError(f"{term} has a value for each series; one design is shared by all of them")
    if name.strip() in DEFERRED:
        raise SignalError(f"{name} is not linear in its parameters and is not supported")
    if name.strip() not in TERMS:
        raise SignalError(f"unknown signal term {name!r}; known: {', '.join(sorted(TERMS))}")
    return TERMS[name.strip()](argument.strip() if _ else None)


def design(terms: list[str], t: Column, mean: Column) -> list[Column]:
    """All design columns in the order of the terms; a harmonic has two."""
    if not terms:
        raise SignalError("a signal needs a term")
    return [c for term in terms for c in parse(term)(t, mean)]
