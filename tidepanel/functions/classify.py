"""Ordered text rules that give a market its family, asset, domain and quality flags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and labels below decide which label a market gets and must not change.

CANDIDATE_WORDS = [
    "bitcoin", "btc", "ethereum", "eth", "microstrategy", "mstr", "etf", "reserve", "stablecoin", "crypto",
]
EXCLUDED_PHRASES = ["insider trading", "accused", "satoshi move"]
BELOW_WORDS = ["dip", "below", "under", "less than"]
ABOVE_WORDS = ["reach", "hit", "above", "all time high", "ath", "greater than"]
THRESHOLD_DOLLAR = r"\$([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)\s*(k|m|b)?"
THRESHOLD_UNIT = r"\b([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)\s*(k|m|b)\b"
UNIT_SCALE = {"k": 1e3, "m": 1e6, "b": 1e9}
BTC_WORDS = ["bitcoin", "btc"]
ETH_WORDS = ["ethereum", "eth"]
MSTR_WORDS = ["microstrategy", "mstr"]
SELECTION_POLICY_WORDS = [
    "reserve", "stablecoin", "regulation", "bill", "senate", "congress", "sec", "cftc", "policy",
]
DEGRADED_PHRASES = ["source degraded", "degraded source", "data source degraded"]
WEATHER_SOURCE_WORDS = [
    "wunderground", "national weather service", "nws", "daily climate report", "cli", "clinyc", "clisfo",
    "climia", "climdw", "clilax", "knyc", "klga", "ksfo", "kmia", "kmdw", "klax",
]
WEATHER_TITLE_WORDS = [
    "highest temperature", "lowest temperature", "temperature in", "global heat", "weather protocol",
    "snowfall", "rainfall", "hurricane",
]
CRYPTO_ASSET_WORDS = [
    "bitcoin", "btc", "ethereum", "eth", "crypto", "stablecoin", "tether", "microstrategy", "mstr",
    "coinbase", "binance", "solana", "xrp", "doge", "blockchain",
]
CRYPTO_CONTEXT_WORDS = [
    "etf", "reserve", "stablecoin", "regulation", "regulatory", "bill", "senate", "congress", "sec", "cftc",
    "approve", "approval", "policy", "law", "executive order",
]
CRYPTO_REGULATION_WORDS = ["regulation", "regulatory", "bill", "senate", "congress", "sec", "cftc", "law", "policy"]
STABLECOIN_TITLE_WORDS = ["stablecoin", "tether", "usdt", "usdc"]
FED_WORDS = ["fed", "federal reserve", "interest rate", "rates", "bps", "rate cut", "rate hike", "fed chair"]
INFLATION_WORDS = ["inflation", "cpi", "pce", "consumer price"]
GROWTH_WORDS = [
    "recession", "gdp", "unemployment", "jobs report", "payroll", "treasury", "yield", "tariff",
    "debt ceiling", "economy",
]
ELECTION_WORDS = [
    "election", "presidential", "president", "senate race", "house race", "electoral", "republican",
    "democrat", "primary",
]
SPORT_WORDS = [
    "nba", "nfl", "mlb", "nhl", "uefa", "champions league", "super bowl", "world cup", "premier league", "fifa",
    "ufc", "wimbledon", "olympics", "cricket", "baseball", "basketball", "football", "soccer", "tennis",
    "formula 1", "f1",
]
OTHER_POLICY_WORDS = ["policy", "bill", "law", "regulation", "senate", "congress", "supreme court", "tariff"]

# ---------------------------------------------------------------------------------------------


def word_pattern(words: list[str]) -> str:
    return r"\b(" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + r")\b"


def has_word(text: Column, words: list[str]) -> Column:
    return text.rlike(word_pattern(words))


def match_text(*fields: str, tags: str | None = None) -> Column:
    """Lower-case text of the fields and tags; missing fields count as empty."""
    parts = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    if tags:
        parts.append(F.coalesce(F.array_join(tags, " "), F.lit("")))
    return F.lower(F.concat_ws(" ", *parts))


def keyword_pattern(keywords: list[str]) -> str:
    """Short alphabetic terms must stand alone; longer ones may sit inside a word."""
    parts = []
    for term in (k.lower().strip() for k in keywords):
        if term:
            safe = re.escape(term).replace(r"\ ", " ")
            parts.append(rf"\b{safe}\b" if term.isalpha() and len(term) <= 4 else safe)
    return "|".join(parts)


def keyword_filter(text: Column, keywords: list[str]) -> Column:
    return text.rlike(keyword_pattern(keywords)) if keywords else F.lit(True)


def extract_threshold(question: Column) -> Column:
    """Dollar amount, else an amount with a unit, scaled by k, m or b."""

    def amount(pattern: str) -> Column:
        text = F.lower(question)
        digits = F.nullif(F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ""), F.lit(""))
        unit = F.regexp_extract(text, pattern, 2)
        scale = F.lit(1.0)
        for letter, factor in UNIT_SCALE.items():
            scale = F.when(unit == letter, factor).otherwise(scale)
        return digits.cast("double") * scale

    return F.coalesce(amount(THRESHOLD_DOLLAR), amount(THRESHOLD_UNIT))


def infer_direction(question: Column) -> Column:
    text = F.lower(question)
    return F.when(has_word(text, BELOW_WORDS), "below").when(has_word(text, ABOVE_WORDS), "above")


def classify_selection(text: Column, question: Column) -> Column:
    """Family, asset, threshold, direction, core and satellite flags and the reason, as one struct."""
    threshold, direction = extract_threshold(question), infer_direction(question)
    priced = threshold.isNotNull() & direction.isNotNull()
    btc, eth = has_word(text, BTC_WORDS), has_word(text, ETH_WORDS)
    etf_asset = F.when(btc, "BTC").when(eth, "ETH")

    def label(family, asset, core, satellite, chosen, left_out, measured=True):
        return F.struct(
            F.lit(family).alias("market_family"),
            (asset if isinstance(asset, Column) else F.lit(asset)).cast("string").alias("asset"),
            (threshold if measured else F.lit(None).cast("double")).alias("threshold"),
            (direction if measured else F.lit(None).cast("string")).alias("direction"),
            F.lit(core).alias("is_core"), F.lit(satellite).alias("is_satellite"),
            F.lit(chosen).cast("string").alias("selection_reason"),
            F.lit(left_out).cast("string").alias("exclusion_reason"),
        )

    rules = [
        (~has_word(text, CANDIDATE_WORDS), label("excluded", None, False, False, None, "not_crypto_candidate", False)),
        (has_word(text, EXCLUDED_PHRASES),
         label("excluded", None, False, False, None, "crypto_news_or_identity_false_positive", False)),
        (btc & priced, label("btc_price", "BTC", True, False, "btc_price_threshold", None)),
        (eth & priced, label("eth_price", "ETH", True, False, "eth_price_threshold", None)),
        (has_word(text, MSTR_WORDS), label("microstrategy", "MSTR", False, True, "microstrategy_crypto_exposure", None)),
        (has_word(text, ["etf"]), label("crypto_etf", etf_asset, False, True, "crypto_etf_policy", None)),
        (has_word(text, SELECTION_POLICY_WORDS), label("crypto_policy", None, False, True, "crypto_policy", None)),
    ]
    return first_match(rules, label("excluded", None, False, False, None, "generic_crypto_not_core_or_satellite"))


def first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for when, then in rules:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(default)


def classify_domain(text: Column, title: Column) -> Column:
    """Broad domain and family by the first rule that fits, as one struct."""
    def label(domain, family):
        return F.struct(F.lit(domain).alias("broad_domain"), F.lit(family).alias("broad_family"))

    # Rules that share a condition sit under it, so each pattern is tried at most once per text.
    # Bitcoin and ethereum words are asset words, so their rules can only fire under `asset`.
    in_crypto = first_match([
        (has_word(text, ["etf"]), label("crypto", "crypto_etf")),
        (has_word(text, CRYPTO_CONTEXT_WORDS), first_match(
            [(has_word(text, CRYPTO_REGULATION_WORDS), label("crypto", "crypto_regulation"))], label("crypto", "crypto_policy"))),
        (has_word(text, BTC_WORDS), label("crypto", "crypto_btc")),
        (has_word(text, ETH_WORDS), label("crypto", "crypto_eth")),
    ], label("crypto", "crypto_other"))
    return first_match([
        (has_word(text, WEATHER_SOURCE_WORDS) | has_word(title, WEATHER_TITLE_WORDS), label("weather", "weather")),
        (has_word(text, MSTR_WORDS), label("crypto", "crypto_microstrategy")),
        (has_word(title, STABLECOIN_TITLE_WORDS), label("crypto", "crypto_stablecoin")),
        (has_word(text, CRYPTO_ASSET_WORDS), in_crypto),
        (has_word(text, FED_WORDS), label("macro", "macro_fed_rates")),
        (has_word(text, INFLATION_WORDS), label("macro", "macro_inflation")),
        (has_word(text, GROWTH_WORDS), label("macro", "macro_growth_policy")),
        (has_word(text, ELECTION_WORDS), label("elections", "elections")),
        (has_word(text, SPORT_WORDS), label("sports", "sports")),
        (has_word(text, OTHER_POLICY_WORDS), label("policy_other", "policy_other")),
    ], label("other", "other"))


def source_quality(text: Column, title: Column) -> Column:
    """Whether a market leans on a degraded or weather source, and why."""
    def label(flag, reason):
        return F.struct(F.lit(flag).alias("exclude_source_quality"), F.lit(reason).cast("string").alias("source_quality_reason"))

    return first_match([
        (has_word(text, DEGRADED_PHRASES), label(True, "explicit_source_degraded_notice")),
        (has_word(text, WEATHER_SOURCE_WORDS) | has_word(title, WEATHER_TITLE_WORDS),
         label(True, "external_weather_source_dependency")),
    ], label(False, None))
