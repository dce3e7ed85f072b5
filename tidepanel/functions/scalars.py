"""Column functions: tolerant parsing of raw payload fields and small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_jsonish(value, schema: str = "array<string>") -> Column:
    """A string that holds JSON, as an array; empty or broken text gives an empty array."""
    return F.coalesce(F.from_json(F.trim(_c(value)), schema), F.array().cast(schema))


def safe_float(value) -> Column:
    return F.nullif(_c(value).cast("string"), F.lit("")).try_cast("double")


def yes_position(outcomes) -> Column:
    """One-based place of the first outcome equal to "yes", null if there is none."""
    place = F.array_position(F.transform(_c(outcomes), lambda o: F.lower(F.trim(o))), F.lit("yes"))
    return F.nullif(place, F.lit(0).cast("bigint")).cast("int")


def at_yes(values, outcomes) -> Column:
    return F.try_element_at(_c(values), yes_position(outcomes))


def resolved_outcome(outcomes, prices) -> Column:
    """Outcome with the highest price if that is at least 0.99; the first one on ties."""
    top = F.array_max(_c(prices))
    place = F.nullif(F.array_position(_c(prices), top), F.lit(0).cast("bigint")).cast("int")
    same = (F.size(_c(prices)) == F.size(_c(outcomes))) & (F.size(_c(outcomes)) > 0)
    return F.when(same & (top >= 0.99), F.try_element_at(_c(outcomes), place))


def tag_names(tags) -> Column:
    """Label, else slug, of each tag object; blank ones dropped."""
    names = F.transform(_c(tags), lambda t: F.coalesce(F.nullif(t["label"], F.lit("")), F.nullif(t["slug"], F.lit(""))))
    return F.coalesce(F.array_compact(names), F.array().cast("array<string>"))


def collect_tags(tags, events) -> Column:
    """Tags of the market and of its events, distinct and sorted."""
    nested = F.flatten(F.transform(F.coalesce(_c(events), F.array()), lambda e: tag_names(e["tags"])))
    return F.array_sort(F.array_distinct(F.concat(tag_names(tags), nested)))


def first_category(category, events) -> Column:
    own = F.nullif(_c(category), F.lit(""))
    given = F.filter(F.transform(_c(events), lambda e: e["category"]), lambda c: c.isNotNull() & (c != ""))
    return F.coalesce(own, F.try_element_at(given, F.lit(1)))


def first_event_id(events) -> Column:
    return F.try_element_at(_c(events), F.lit(1))["id"]


def is_binary_yes_no(outcomes) -> Column:
    lowered = F.array_sort(F.transform(_c(outcomes), lambda o: F.lower(o)))
    return (F.size(_c(outcomes)) == 2) & (lowered == F.array(F.lit("no"), F.lit("yes")))


def first_nonzero(a, b) -> Column:
    """The first value unless it is missing or zero."""
    return F.coalesce(F.nullif(_c(a), F.lit(0.0)), _c(b))


def epoch_to_ts(seconds) -> Column:
    return F.timestamp_seconds(_c(seconds)).cast("timestamp_ntz")


def trade_to_yes_price(price, asset, outcome, yes_token, no_token) -> Column:
    price, asset, side = safe_float(price), _c(asset), F.lower(F.trim(F.coalesce(_c(outcome), F.lit(""))))
    return (
        F.when((asset != "") & (asset == _c(yes_token)), price)
        .when((asset != "") & (asset == _c(no_token)), 1.0 - price)
        .when(side == "yes", price)
        .when(side == "no", 1.0 - price)
    )


# Date layouts met in the raw payloads beside the standard one (fixed values).
DATE_LAYOUTS = ("MM/dd/yyyy",)


def tolerant_timestamp(text, layouts: tuple[str, ...] = DATE_LAYOUTS) -> Column:
    """A date, or a date and time with or without fraction, `Z` or offset, as UTC; the named layouts; else null."""
    standard = F.when(F.trim(_c(text)).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.trim(_c(text))))
    return F.coalesce(standard, *[F.try_to_timestamp(_c(text), F.lit(x)) for x in layouts]).cast("timestamp_ntz")


def label_map(outcome) -> Column:
    return F.when(_c(outcome) == "Yes", 1).when(_c(outcome) == "No", 0)


def clean_value(value) -> Column:
    """Infinite and not-a-number to null, the rest clipped to [0, 1]."""
    v = _c(value)
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def probability_clip(p, eps: float = EPS) -> Column:
    """`p` held inside [eps, 1 - eps]; null stays null."""
    return F.when(_c(p).isNotNull(), F.greatest(F.lit(eps), F.least(F.lit(1 - eps), _c(p))))


def log_loss(y, p) -> Column:
    q = probability_clip(p)
    return -(_c(y) * F.log(q) + (1 - _c(y)) * F.log(1 - q))


def binary_entropy(p) -> Column:
    p = _c(p)
    inside = (p > 0) & (p < 1)
    safe = F.when(inside, p)
    return F.when(inside, -(safe * F.log2(safe) + (1 - safe) * F.log2(1 - safe))).otherwise(F.lit(0.0))


def window_from_name(name) -> Column:
    found = F.regexp_extract(_c(name), r"_(\d+)h", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("int"), F.lit(0))
