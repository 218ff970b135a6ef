"""Predicates and scalar rules of the domain as Column factories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(values: dict, key: Column, default: Column) -> Column:
    """A small constant map with a default."""
    if not values:
        return default
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def canonical(sym: Column, names: dict[str, str]) -> Column:
    return lookup(names, sym, sym)


def venue_of(sym: Column) -> Column:
    """The order matters: -USDT also ends in what a looser -USD rule would match."""
    return F.when(sym.endswith("-USDT"), "OKX").when(sym.endswith("-USD"), "COINBASE").otherwise("BINANCE")


def threshold(sym: Column, by_sym: dict[str, float], default: float, mult: float = 1.0) -> Column:
    return F.lit(mult) * lookup(by_sym, sym, F.lit(default))


def valid_book(bid: Column, ask: Column) -> Column:
    return F.coalesce(bid < ask, F.lit(False))


def signed_notional(px: Column, qty: Column, side: Column) -> Column:
    return px * qty * F.when(side == "B", 1.0).otherwise(-1.0)


def comparable(mode: str, a_venue: Column, a_inst: Column, b_venue: Column, b_inst: Column) -> Column:
    """Whether two legs of a symbol are compared."""
    rules = {
        "crossVenue": (a_inst == b_inst) & (a_venue != b_venue),
        "crossInst": (a_venue == b_venue) & (a_inst != b_inst),
        "both": (a_venue != b_venue) != (a_inst != b_inst),
        "all": (a_venue != b_venue) | (a_inst != b_inst),
    }
    if mode not in rules:
        raise ValueError(f"unknown pair mode: {mode}")
    return rules[mode]


def change(basis: str, a: Column, b: Column) -> Column:
    """Return from a to b; null where it is undefined."""
    if basis == "abs":
        return b - a
    if basis == "rel":
        return F.try_divide(b - a, a)
    if basis == "log":
        return F.when((a > 0) & (b > 0), F.ln(b / F.when(a > 0, a)))
    raise ValueError(f"unknown basis: {basis}")


def lag_clock(kind: str) -> Column:
    if kind == "recv":
        return F.col("recv_us")
    if kind == "event":
        return F.col("event_us")
    if kind == "cal":
        return F.col("event_us") + F.coalesce(F.col("offset_us"), F.lit(0))
    raise ValueError(f"unknown lag clock: {kind}")
