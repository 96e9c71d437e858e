"""How a console shows values: durations, ranges, changes, plans and ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.scalars import date_key, half_up

# What the plans include. plan, initial credits, free searches a day, included credits a month, dollars for 1,000 credits.
PLANS = (("free", 100, 10, 0, 8.0), ("payg", 100, 10, 0, 8.0), ("pro", 100, 10, 5000, 8.0), ("enterprise", None, None, None, None))
TOP_UP_STEP, TOP_UP_LEAST, CREDIT_USD = 100, 1000, 0.008
IMAGE_BYTES = 10 * 2**20


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def duration_ms(started: Column, completed: Column, updated: Column) -> Column:
    """From the start to the end, or else the last change; never below 0, null if it has not started."""
    ms = F.unix_millis(F.coalesce(completed, updated).cast("timestamp")) - F.unix_millis(started.cast("timestamp"))
    return F.when(ms.isNotNull(), F.greatest(F.lit(0), ms))


def _clock(seconds: Column) -> tuple[Column, Column, Column]:
    return F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60


def job_duration_text(ms: Column, ended: Column) -> Column:
    """Hours, minutes and seconds, of at least one second; "so far" unless it has ended."""
    h, m, s = _clock(F.greatest(F.lit(1), half_up(ms / 1000)))
    text = F.when(h > 0, _text(h, "h ", m, "m ", s, "s")).when(m > 0, _text(m, "m ", s, "s")).otherwise(_text(s, "s"))
    return F.when(ms.isNull(), "Not started").otherwise(F.when(ended, text).otherwise(_text(text, " so far")))


def step_duration_text(ms: Column) -> Column:
    seconds = F.greatest(F.lit(1), half_up(ms / 1000))
    m, s = F.floor(seconds / 60), seconds % 60
    return F.when(ms.isNull(), "Not recorded").when(m > 0, _text(m, "m ", s, "s")).otherwise(_text(s, "s"))


def live_duration_text(ms: Column) -> Column:
    """The two largest units; whole seconds that have passed."""
    h, m, s = _clock(F.greatest(F.floor(ms / 1000), F.lit(0)))
    text = F.when(h > 0, _text(h, "h ", m, "m")).when(m > 0, _text(m, "m ", s, "s")).otherwise(_text(s, "s"))
    return F.when(ms.isNotNull(), text)


def media_duration_text(seconds: Column) -> Column:
    """h:mm:ss or m:ss, a dash for none."""
    h, m, s = _clock(seconds)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(seconds.isNull(), "—").when(h > 0, _text(h, ":", two(m), ":", two(s))).otherwise(_text(m, ":", two(s)))


def metric_duration_text(ms: Column) -> Column:
    """Milliseconds, seconds with a decimal below ten, or minutes and seconds."""
    return (
        F.when(ms >= 60_000, _text(F.floor(ms / 60_000), "m ", half_up(ms % 60_000 / 1000), "s"))
        .when(ms >= 10_000, _text(half_up(ms / 1000), "s"))
        .when(ms >= 1000, _text(F.format_string("%.1f", F.floor(ms / 100 + 0.5) / 10), "s"))
        .otherwise(_text(ms, "ms"))
    )


def request_latency_text(ms: Column) -> Column:
    return F.when(ms.isNull(), "—").when(ms < 1000, _text(half_up(ms), "ms")).otherwise(F.format_string("%.2fs", F.floor(ms / 10 + 0.5) / 100))


def time_range_label(start: Column, end: Column) -> Column:
    one = lambda x: F.format_string("%.1fs", x.cast("double"))
    return F.when(start.isNull() & end.isNull(), "—").when(start.isNotNull() & end.isNotNull(), _text(one(start), "-", one(end))).otherwise(one(F.coalesce(start, end)))


def delta_badge(current: Column, previous: Column) -> Column:
    """The signed change; nothing where there is and was nothing."""
    delta = current - previous
    return F.when((delta != 0) | (current != 0), F.concat(F.when(delta > 0, "+").otherwise(""), delta.cast("string")))


def top_up_credits(quantity: Column) -> Column:
    """Whole hundreds, a thousand at least; a thousand where nothing is asked."""
    asked = F.greatest(half_up(quantity / TOP_UP_STEP) * TOP_UP_STEP, F.lit(TOP_UP_LEAST))
    return F.when(quantity.isNull() | F.isnan(quantity.cast("double")), F.lit(TOP_UP_LEAST)).otherwise(asked).cast("long")


def billing_action(tier: Column, has_customer: Column) -> Column:
    t = F.lower(tier)
    return F.when(t == "free", "checkout").when((t != "enterprise") & has_customer, "portal")


def is_admin(role: Column, email: Column, admins: Column) -> Column:
    """By role, whatever its case, or by an email of the list."""
    return (F.lower(F.trim(F.coalesce(role, F.lit("user")))) == "admin") | F.coalesce(F.array_contains(admins, F.lower(F.trim(email))), F.lit(False))


def effective_period_end(end: Column, reference: Column) -> Column:
    """The earlier of two days as texts; an invalid reference does not clip, an invalid end is null."""
    return F.when(date_key(end).isNotNull(), F.least(date_key(end), date_key(reference)))


def day_labels(day: Column) -> tuple[Column, Column]:
    return F.date_format(day, "M/d"), F.date_format(day, "MMM d")


def step_label(name: Column, labels: dict[str, str]) -> Column:
    """The known label, or the name without a last "Step"."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, name), F.regexp_replace(name, "Step$", ""))


def tracked_suffix(parts: Column) -> Column:
    """The path behind a short id: nothing, /detail or /go, or /request/rank with one of these; null for others."""
    n = F.size(F.coalesce(parts, F.array().cast("array<string>")))
    part = lambda k: F.try_element_at(parts, F.lit(k))
    tail = lambda x: x.isin("detail", "go")
    return (
        F.when(n == 0, "")
        .when((n == 1) & tail(part(1)), _text("/", part(1)))
        .when(n == 2, _text("/", part(1), "/", part(2)))
        .when((n == 3) & tail(part(3)), _text("/", part(1), "/", part(2), "/", part(3)))
    )


def tracked_event(path: Column) -> dict[str, Column]:
    """short_id, request_id, rank and kind of a tracking path /v/short[/request/rank][/detail|/go]."""
    p = r"^/v/([^/]+)(?:/([^/]+)/(\d+))?(?:/(detail|go))?$"
    of = lambda k: F.nullif(F.regexp_extract(path, p, k), F.lit(""))
    kind = F.when(of(4) == "detail", "page_view").when(of(4) == "go", "outbound_click").otherwise("redirect")
    return {"short_id": of(1), "request_id": of(2), "rank": of(3).try_cast("int"), "kind": F.when(of(1).isNotNull(), kind)}


def image_problem(url: Column, base64: Column) -> Column:
    """What is wrong with an image query, null if nothing: one of url and base64 (with or without a data prefix), of at
    most 10 MB, and JPEG, PNG or WebP by its first bytes."""
    given = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    raw = F.try_to_binary(F.regexp_replace(base64, "^data:[^,]*,", ""), F.lit("base64"))
    head = F.hex(F.substring(raw, 1, 12))
    known = head.startswith("FFD8FF") | head.startswith("89504E470D0A1A0A") | head.rlike("^52494646.{8}57454250")
    return (
        F.when(given(url) & given(base64), "both given").when(~given(url) & ~given(base64), "none given")
        .when(given(url), F.when(~url.rlike("^https?://[^/\\s]+"), "invalid url"))
        .when(raw.isNull(), "invalid base64").when(F.length(raw) > IMAGE_BYTES, "too large").when(~known, "unknown format")
    )
