"""Column expressions of the domain: time, text, boxes, scores and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Time


def micros(ts: Column | str) -> Column:
    """Microseconds of a wall-clock time since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _c(ts))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / 1e6


def wall_clock(text: Column | str) -> Column:
    """The yard's own clock in an ISO text with an offset; null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(F.substring(_c(text), 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def parse_instant(text: Column | str) -> Column:
    """An ISO text as an instant; without an offset the session's time zone holds; null where it can't be read."""
    return F.try_to_timestamp(_c(text))


def as_date(text: Column | str) -> Column:
    return F.try_to_timestamp(F.substring(_c(text), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def night_key(ts: Column | str, shift_hours: int = 12) -> Column:
    """The date on which the night began: the clock turned back by ``shift_hours``."""
    return F.to_date(_c(ts) - F.expr(f"INTERVAL {shift_hours} HOURS"))


def iso_week(ts: Column | str) -> Column:
    """Like 2024-W05."""
    day = F.to_date(_c(ts))
    year = F.extract(F.lit("YEAROFWEEK"), day)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def overlap_seconds(a0, a1, b0, b1) -> Column:
    return F.greatest(F.lit(0.0), seconds_between(F.greatest(_c(a0), _c(b0)), F.least(_c(a1), _c(b1))))


def spans_overlap(a0, a1, b0, b1) -> Column:
    """Closed at both ends; false where a bound is missing."""
    return F.coalesce((_c(a0) <= _c(b1)) & (_c(a1) >= _c(b0)), F.lit(False))


def hour_label(hour: Column | str) -> Column:
    """12am, 1am, ... 11pm."""
    h = _c(hour)
    return F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.when(h < 12, "am").otherwise("pm"))


def clock_label(ts: Column | str) -> Column:
    """Like 7:05 PM."""
    h = F.hour(_c(ts))
    return F.concat(
        F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.lit(":"), F.lpad(F.minute(_c(ts)).cast("string"), 2, "0"), F.when(h < 12, " AM").otherwise(" PM")
    )


def days_since(then: Column | str, now: Column | str) -> Column:
    return F.round(seconds_between(then, now) / 86400, 1)


# Text and names


def web_path(path: Column | str) -> Column:
    return F.replace(_c(path), F.lit("\\"), F.lit("/"))


def is_group_label(name: Column | str) -> Column:
    return F.contains(_c(name), F.lit(" + "))


def is_placeholder(name: Column | str) -> Column:
    return _c(name).rlike("_c[0-9]+$")


def label(species: Column | str, detection_class: Column | str) -> Column:
    """The species, or the class where it is empty."""
    return F.coalesce(F.nullif(_c(species), F.lit("")), _c(detection_class))


def name_key(names: Column | str) -> Column:
    """An order-free, case-free key of a list of names."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(_c(names), lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def json_names(text: Column | str) -> Column:
    """The names of a JSON list; none where it can't be read."""
    return F.coalesce(F.from_json(_c(text), "array<string>"), F.array().cast("array<string>"))


def capitalised(text: Column | str) -> Column:
    """The first letter of each blank-separated word in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(_c(text), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")


# Boxes: columns x1, y1, x2, y2 with a prefix


def _box(p: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(p: str = "") -> Column:
    x1, y1, x2, y2 = _box(p)
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def intersection(p: str, q: str) -> Column:
    (a1, b1, a2, b2), (c1, d1, c2, d2) = _box(p), _box(q)
    return F.greatest(F.lit(0.0), F.least(a2, c2) - F.greatest(a1, c1)) * F.greatest(F.lit(0.0), F.least(b2, d2) - F.greatest(b1, d1))


def iou(p: str, q: str) -> Column:
    both = intersection(p, q)
    union = area(p) + area(q) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def containment(inner: str, outer: str) -> Column:
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def centre_distance(p: str, q: str) -> Column:
    """Distance of the centres over the mean diagonal; infinite for degenerate boxes."""
    (a1, b1, a2, b2), (c1, d1, c2, d2) = _box(p), _box(q)
    diagonal = (F.hypot(a2 - a1, b2 - b1) + F.hypot(c2 - c1, d2 - d1)) / 2
    between = F.hypot((a1 + a2 - c1 - c2) / 2, (b1 + b2 - d1 - d2) / 2)
    return F.when(diagonal > 0, between / diagonal).otherwise(F.lit(float("inf")))


def shot_score(quality, confidence, size, centre) -> Column:
    """How good a picture is: by measured quality, or by confidence where there is none."""
    good = _c(quality) * (0.6 + F.least(_c(size), F.lit(0.4))) * (0.7 + 0.3 * _c(centre))
    return F.coalesce(good, F.coalesce(_c(confidence), F.lit(0.0)) * (1 + F.least(_c(size), F.lit(0.25))))


def size_term(size: Column | str) -> Column:
    """Rises as a root up to 0.35 of the frame, then falls off."""
    s = _c(size)
    return F.when(s <= 0, 0.0).when(s <= 0.35, F.sqrt(s / 0.35)).otherwise(F.pow(F.lit(0.35) / s, F.lit(0.75)))


# Labels of behaviour


def behaviour_tag(minutes, moving_frac, straightness) -> Column:
    m, f, s = _c(minutes), _c(moving_frac), _c(straightness)
    return F.when((m >= 2) & (f < 0.5), "fed here").when((f >= 0.5) & (s >= 0.5), "passed through").otherwise("lingered")


def approach_label(trend: Column | str) -> Column:
    t = _c(trend)
    return F.when(t.isNull(), None).when(t > 1.15, "approaching").when(t < 0.85, "retreating").otherwise("steady")


def in_window(hour, start, end) -> Column:
    """Whether an hour lies in a window that may wrap midnight; any hour does where there is no window."""
    h, s, e = _c(hour), _c(start), _c(end)
    return F.when(s.isNull() | e.isNull(), True).when(s <= e, h.between(s, e)).otherwise((h >= s) | (h <= e))


def moon_light(phase: Column | str) -> Column:
    """Percent of the disc that is lit, for a phase of 0 to 28."""
    return F.round(50 * (1 - F.cos(2 * F.pi() * _c(phase) / 28)))


def expected_top1(days: Column | str, points: list[tuple[float, float]]) -> Column:
    """Linear between the points, flat before the first and after the last."""
    d = _c(days)
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(d <= x1, y0 + (d - x0) * (y1 - y0) / (x1 - x0)).otherwise(out)
    return F.when(d <= points[0][0], F.lit(points[0][1])).otherwise(out)


def lapse_state(days, templates, stale_days: float = 14) -> Column:
    """none, fresh, fading or lapsed, by the age of a name's newest template."""
    d, n = _c(days), _c(templates)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "none").when(d >= stale_days, "lapsed").when(d >= stale_days / 2, "fading").otherwise("fresh")


# Order statistics with fixed ties, and means with a fixed order


def mean_in_order(x: Column | str, *by: str) -> Column:
    """The mean of a group's numbers, added up in the order of ``by``: its last bit, and so a label at a border, doesn't depend on how rows are dealt.

    Null where there is none. A group comes as one array: for visits and the like.
    """
    x = _c(x).cast("double")
    held = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(*by, x.alias("__x")))))
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda s, r: s + r["__x"]) / F.size(held))


def upper_median(x: str) -> Column:
    """The upper-middle element of a group's numbers in column ``x``, from counts by value that are summed before the shuffle."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{x}` desc)")
