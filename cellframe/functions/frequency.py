"""Time bins on the driver. Frames are few beside cells, so their bins are found once and sent as a small table."""

from __future__ import annotations

from datetime import datetime

import pandas as pd

# Old names of frequencies and those of now.
RENAMED = {"M": "ME", "BM": "BME", "Q": "QE", "BQ": "BQE", "A": "YE", "Y": "YE", "BA": "BYE", "H": "h", "BH": "bh", "T": "min", "S": "s", "L": "ms", "U": "us", "N": "ns"}


def normalise(frequency: str | None) -> str | None:
    """The offset's name of now; None stays None. ValueError if pandas has no such offset."""
    if frequency is None:
        return None
    head = frequency.lstrip("0123456789")
    base, dash, anchor = head.partition("-")
    text = frequency[: len(frequency) - len(head)] + RENAMED.get(base, base) + dash + anchor
    return pd.tseries.frequencies.to_offset(text).freqstr


def zone(name: str) -> str:
    import zoneinfo

    zoneinfo.ZoneInfo(name)
    return name


def closes_right(frequency: str) -> bool:
    """Ends of months, quarters and years, and weeks, close and label their bins on the right; all others on the left."""
    return normalise(frequency).lstrip("0123456789").partition("-")[0] in ("ME", "BME", "QE", "BQE", "YE", "BYE", "W")


def bins(times: list[datetime], frequency: str, closed: str | None = None, label: str | None = None, timezone: str = "UTC") -> tuple[list[datetime], list[datetime]]:
    """(label of each frame, all labels from the first to the last, gaps included), naive UTC; bins are made in the zone's local time."""
    frequency = normalise(frequency)
    side = "right" if closes_right(frequency) else "left"
    index = pd.DatetimeIndex(times).tz_localize("UTC").tz_convert(timezone)
    grouped = pd.Series(range(len(times)), index=index).resample(frequency, closed=closed or side, label=label or side)
    axis = grouped.size().index
    which: list = [None] * len(times)
    for name, members in grouped:
        for k in members:
            which[k] = _naive(name)
    return which, [_naive(x) for x in axis]


def _naive(x: pd.Timestamp) -> datetime:
    return x.tz_convert("UTC").tz_localize(None).to_pydatetime()


def axis(times: list[datetime], frequency: str, direction: str, timezone: str = "UTC") -> list[datetime]:
    """Labels that reach a frame, and those between: forward from t on, backward up to t, nearest to half-way on both sides."""
    ends = [times[0], times[-1]] if len(times) > 1 else [times[0]]
    if direction in ("forward", "backward"):
        side = "left" if direction == "forward" else "right"
        return bins(ends, frequency, side, side, timezone)[1]
    low, high = bins(ends, frequency, "left", "left", timezone)[1], bins(ends, frequency, "right", "right", timezone)[1]
    every = sorted({*low, *high})

    def reached(t):
        after = [x for x in every if x > t]
        before = [x for x in every if x <= t]
        if not after or not before:
            return (before or after)[-1 if before else 0]
        return before[-1] if t - before[-1] < after[0] - t else after[0]

    first, last = reached(times[0]), reached(times[-1])
    return [x for x in every if first <= x <= last]


def step(frequency: str | None):
    """The timedelta of a fixed frequency, else None."""
    if frequency is None:
        return None
    offset = pd.tseries.frequencies.to_offset(normalise(frequency))
    try:
        return pd.Timedelta(offset).to_pytimedelta()
    except ValueError:
        return None
