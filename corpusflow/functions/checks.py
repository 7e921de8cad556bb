"""Data-quality rules as columns: each gives a score; a score table turns them into statuses and messages.

A check yields a struct (score, failed, warning). Records are checked by a rule table (field, kind, bounds) and come out
as a long table (entity, field, score, failed, warning), so one aggregation gives record and corpus scores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SENTINEL, number_in

PERCENT = r"^\d+\.?\d*%?$"
SIGNED_PERCENT = r"^[+-]?\d+\.?\d*%?$"
CURRENCY = r"^₹\d+(?:,\d{3})*(?:\.\d{1,2})?$"
URL = r"^https?://[^\s/$.?#].[^\s]*$"
TIMESTAMPS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def verdict(score: Column, failed: Column, warning: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), F.coalesce(failed, F.lit(False)).alias("failed"), F.coalesce(warning, F.lit(False)).alias("warning"))


def percentage(value: Column, least: float, most: float, pattern: str = PERCENT) -> Column:
    """0 if it is no percentage, 50 if out of range; both fail."""
    good, inside = value.rlike(pattern), F.regexp_extract(value, r"([+-]?\d+\.?\d*)", 1).try_cast("double").between(least, most)
    return verdict(F.when(~good, 0).when(~inside, 50).otherwise(100), ~good | ~inside, F.lit(False))


def currency(value: Column, least: float, most: float, pattern: str = CURRENCY) -> Column:
    """0 and failed if it is no amount, 75 and a warning if out of range."""
    good, inside = value.rlike(pattern), number_in(value).between(least, most)
    return verdict(F.when(~good, 0).when(~inside, 75).otherwise(100), ~good, good & ~inside)


def enum(value: Column, allowed: tuple[str, ...]) -> Column:
    good = F.trim(value).isin(*allowed)
    return verdict(F.when(good, 100).otherwise(0), ~good, F.lit(False))


def url(value: Column, domains: tuple[str, ...] = (), pattern: str = URL) -> Column:
    """0 and failed if it is no URL, 75 and a warning if its host is not among the domains."""
    good = F.trim(value).rlike(pattern)
    known = F.lower(F.try_parse_url(F.trim(value), F.lit("HOST"))).isin(*domains) if domains else F.lit(True)
    return verdict(F.when(~good, 0).when(~F.coalesce(known, F.lit(False)), 75).otherwise(100), ~good, good & ~F.coalesce(known, F.lit(False)))


def text(value: Column, least: int = 0, most: int = 1000, pattern: str | None = None, forbidden: tuple[str, ...] = ()) -> Column:
    """Too short fails with 0; too long or odd characters warn with 75; a forbidden word warns with 50. The last wins."""
    v = F.trim(value)
    n = F.length(v)
    score = F.when(n < least, 0).when(n > most, 75).otherwise(100)
    warning = n > most
    if pattern:
        odd = ~v.rlike(pattern)
        score, warning = F.when(odd, 75).otherwise(score), warning | odd
    if forbidden:
        bad = F.exists(F.array(*map(F.lit, forbidden)), lambda w: F.contains(F.lower(v), w))
        score, warning = F.when(bad, 50).otherwise(score), warning | bad
    return verdict(score, n < least, warning)


def timestamp(value: Column) -> Column:
    good = F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in TIMESTAMPS)).isNotNull()
    return verdict(F.when(good, 100).otherwise(0), ~good, F.lit(False))


def percentage_map(values: Column, periods: tuple[str, ...], least: float = -50, most: float = 100) -> Column:
    """Mean of the periods' scores; a missing period has 75 and warns. Signs are allowed."""
    at = lambda p: F.try_element_at(values, F.lit(p))
    scores = [F.when(at(p).isNull(), 75.0).otherwise(percentage(at(p), least, most, SIGNED_PERCENT)["score"]) for p in periods]
    failed = F.lit(False)
    for p in periods:
        failed |= F.coalesce(percentage(at(p), least, most, SIGNED_PERCENT)["failed"] & at(p).isNotNull(), F.lit(False))
    return verdict(sum(scores, F.lit(0.0)) / len(periods), failed, F.size(values) < len(periods))


def allocation_map(values: Column, tolerance: float = 5) -> Column:
    """75 and a warning if the shares do not add up to 100 within the tolerance."""
    total = F.aggregate(F.map_values(values), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    off = (total > 0) & (F.abs(total - 100) > tolerance)
    return verdict(F.when(off, 75).otherwise(100), F.lit(False), off)


def renormalised(values: Column, tolerance: float = 5) -> Column:
    """Shares that add up to 100 within the tolerance, scaled to 100; others as they are."""
    total = F.aggregate(F.map_values(values), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    near = (total > 0) & (F.abs(total - 100) <= tolerance)
    return F.when(near, F.transform_values(values, lambda _, v: F.round(v * 100 / total, 6))).otherwise(values)


@dataclass(frozen=True)
class Check:
    """A row of a rule table."""

    field: str
    kind: str
    required: bool = False
    least: float = 0
    most: float = 1000
    pattern: str | None = None
    allowed: tuple[str, ...] = ()


def dispatched(check: Check, value: Column) -> Column:
    """By the rule's kind; the sentinel fails a required field and warns for an optional one."""
    kinds = {
        "percentage": lambda: percentage(value, check.least, check.most, check.pattern or PERCENT),
        "currency": lambda: currency(value, check.least, check.most, check.pattern or CURRENCY),
        "enum": lambda: enum(value, check.allowed),
        "url": lambda: url(value, check.allowed, check.pattern or URL),
        "timestamp": lambda: timestamp(value),
        "text": lambda: text(value, int(check.least), int(check.most), check.pattern, check.allowed),
    }
    own = kinds[check.kind]()
    absent = value.isNull() | (F.trim(value) == SENTINEL)
    missing = verdict(F.lit(0.0 if check.required else 100.0), F.lit(check.required), F.lit(not check.required))
    return F.when(absent, missing).otherwise(own)


def checked(records: DataFrame, key: str, rules: tuple[Check, ...]) -> DataFrame:
    """(key, field, score, failed, warning) of each record and rule."""
    each = F.array(*(F.struct(F.lit(r.field).alias("field"), dispatched(r, F.col(r.field)).alias("v")) for r in rules))
    return records.select(key, F.explode(each).alias("x")).select(key, "x.field", "x.v.score", "x.v.failed", "x.v.warning")


def scored(long: DataFrame, key: str) -> DataFrame:
    """Record score (mean of fields) and status: any failure or under 50 failed, under 80 warning, else passed."""
    score = F.round(F.avg("score"), 4)
    out = long.groupBy(key).agg(score.alias("score"), F.max(F.col("failed").cast("int")).alias("any_failed"), F.sum(F.col("warning").cast("long")).alias("warnings"))
    status = F.when((F.col("any_failed") == 1) | (F.col("score") < 50), "failed").when(F.col("score") < 80, "warning").otherwise("passed")
    return out.select(key, "score", "warnings", status.alias("status"))


def freshness(as_of: Column, at: Column, labels: tuple[str, ...] = ("fresh", "recent", "acceptable", "stale"), days: tuple[int, ...] = (1, 7, 30)) -> Column:
    """Label of the age in whole days; ``unknown`` without a date."""
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86_400)
    out = F.when(at.isNull(), "unknown")
    for label, limit in zip(labels, days, strict=False):
        out = out.when(age <= limit, label)
    return out.otherwise(labels[min(len(days), len(labels) - 1)])


def ladder(score: Column, steps: tuple[tuple[float, str], ...], otherwise: str) -> Column:
    """Label of the first step whose bound the score reaches."""
    out = F.when(score >= steps[0][0], steps[0][1])
    for bound, label in steps[1:]:
        out = out.when(score >= bound, label)
    return out.otherwise(otherwise)


def recommendations(rules: tuple[tuple[Column, Column], ...], otherwise: str) -> Column:
    """Texts of the rules whose condition holds, joined; or a default."""
    found = F.array_compact(F.array(*(F.when(c, t) for c, t in rules)))
    return F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(otherwise)


# Checks of extracted values: true or false, for a pick that takes the first valid value.


def valid_percentage(value: Column, most: float = 100) -> Column:
    """A percentage from 0 to ``most``, or the sentinel."""
    number = F.regexp_extract(value, r"([0-9]+\.?[0-9]*)%", 1).try_cast("double")
    return (value == SENTINEL) | F.coalesce(number.between(0, most), F.lit(False))


def valid_load(value: Column) -> Column:
    """No load in words, or a percentage up to 10."""
    return F.lower(value).isin("no exit load", "nil exit load", "nil", "0%") | valid_percentage(value, 10)


def valid_amount(value: Column, least: float = 100, most: float = 1_000_000) -> Column:
    number = F.regexp_replace(F.regexp_extract(value, r"₹?\s*([0-9,]+)", 1), ",", "").try_cast("double")
    return (value == SENTINEL) | F.coalesce(number.between(least, most), F.lit(False))


def valid_length(value: Column, least: int, most: int) -> Column:
    return F.coalesce(F.length(value).between(least, most), F.lit(False))


def valid_member(value: Column, allowed: tuple[str, ...]) -> Column:
    return (value == SENTINEL) | value.isin(*allowed)


def first_valid(*pairs: tuple[Column, Column]) -> Column:
    """First value whose check holds."""
    return F.coalesce(*(F.when(good, value) for value, good in pairs))


# Scores of whole stages.


def returns_consistency(values: Column) -> Column:
    """100, less 20 for each odd format and each value over 100 in size, at least 0."""
    v = F.filter(F.map_values(values), lambda x: x.isNotNull() & (x != SENTINEL))
    odd = F.size(F.filter(v, lambda x: ~x.rlike(r"^[+-]?\d+\.?\d*%?$")))
    large = F.size(F.filter(v, lambda x: F.regexp_extract(x, r"(\d+\.?\d*)", 1).try_cast("double") > 100))
    return F.greatest(F.lit(0.0), 100.0 - 20 * (odd + large))


def range_score(value: Column, least: float, most: float) -> Column:
    """100 in range, 50 outside; null without a number."""
    n = number_in(value)
    return F.when(n.between(least, most), 100.0).when(n.isNotNull(), 50.0)


def post_clean_score(critical: list[Column], parts: list[Column]) -> Column:
    """0 if a critical value is missing, else the mean of the parts that are there, or 100."""
    missing = F.lit(False)
    for c in critical:
        missing |= c.isNull() | (c == "")
    there = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.when(missing, 0.0).when(there == 0, 100.0).otherwise(F.round(total / there, 4))


def storage_score(dimension_share: Column, missing_fields: Column, bad_labels: Column) -> Column:
    """0.4 dimension consistency + 0.3 metadata (25 less a missing field) + 0.3 labels (15 less a bad one)."""
    return dimension_share * 0.4 + F.greatest(F.lit(0), 100 - 25 * missing_fields) * 0.3 + F.greatest(F.lit(0), 100 - 15 * bad_labels) * 0.3


def combined(cleaning: Column, extraction: Column, validation: Column) -> tuple[Column, Column, Column]:
    """Confidence (0.4, 0.6), quality (0.3, 0.3, 0.4) and status of a cleaned record."""
    confidence = cleaning * 0.4 + extraction * 0.6
    quality = cleaning * 0.3 + validation * 0.4 + extraction * 0.3
    every = (cleaning >= 80) & (extraction >= 80) & (validation >= 80)
    status = F.when(every, "excellent").when(confidence >= 70, "good").when(confidence >= 50, "acceptable").otherwise("needs_improvement")
    return confidence, quality, status
