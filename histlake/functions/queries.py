"""What a user types, as plain values: search terms with their aliases, times, windows, ranges."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, datetime, time, timedelta, timezone

from histlake.functions.constants import QUERY_TERM, WINDOW_DAYS


def parse_terms(query: str, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Wanted and unwanted terms, quoted phrases whole, in order and once each."""
    signed = [("-", term.strip()) for term in exclude]
    signed += [(token[0], token.removeprefix("-").strip('" \t\n')) for token in re.findall(QUERY_TERM, query)]
    sides: tuple[list[str], list[str]] = [], []
    for sign, term in signed:
        side = sides[sign == "-"]
        if term and term not in side:
            side.append(term)
    return sides


def alias_groups(terms: list[str], aliases: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Each term with what the alias pairs that hold it name: the term first, the rest by key."""
    edges = [{side.casefold(): side for side in pair} for pair in aliases]
    spelling = {key: side for edge in edges for key, side in edge.items()}

    def group(term: str) -> list[str]:
        keys = set().union(*(edge for edge in edges if term.casefold() in edge))
        return [term, *(spelling[k] for k in sorted(keys) if spelling[k] != term)]

    return [group(term) for term in terms]


def parse_time(value: str, *, end_of_day: bool = False) -> datetime:
    """A date alone is its first (or last) moment; a time without an offset is in UTC."""
    day, _, clock = value.strip().replace(" ", "T", 1).partition("T")
    whole_day = time.max if end_of_day else time.min
    at = time.fromisoformat(clock) if clock else whole_day
    moment = datetime.combine(date.fromisoformat(day), at, at.tzinfo or timezone.utc)
    return moment.astimezone(timezone.utc)


def recent_since(value: str, now: datetime) -> datetime:
    """The beginning of a window that ends now: a number and one of h, d, w, m, y."""
    number, unit = value.strip()[:-1], value.strip()[-1:].lower()
    if unit not in WINDOW_DAYS or not re.fullmatch(r"\d+", number):
        raise ValueError(f"not a window such as 12h or 30d: {value!r}")
    return now - timedelta(days=WINDOW_DAYS[unit]) * int(number)


def parse_turn_range(value: str | None) -> tuple[int | None, int | None]:
    """'7', '4:12', ':5' and '8:' as inclusive bounds from 1."""
    if value is None or not value.strip():
        return None, None
    low, colon, high = value.strip().partition(":")
    try:
        bounds = (int(low) if low else None, (int(high) if high else None) if colon else int(low))
    except ValueError:
        raise ValueError(f"not a turn range: {value}") from None
    if any(b is not None and b < 1 for b in bounds) or (None not in bounds and bounds[0] > bounds[1]) or value.strip() == ":":
        raise ValueError(f"not a turn range: {value}")
    return bounds
