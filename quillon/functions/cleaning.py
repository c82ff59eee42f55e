"""Scalar clean-up of venue names, money, products, tags and intents: column functions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENCY = "[£$€¥,\\s]"
#: Currencies without minor units (fixed values).
ZERO_DECIMAL = ("JPY", "KRW", "VND", "CLP", "ISK", "HUF", "TWD", "UGX", "XAF", "XOF", "XPF")
#: Pints in a keg by its litres (fixed values); other kegs and casks hold the default.
PINTS_BY_LITRES, DEFAULT_PINTS = {30: 52.8, 50: 88.0}, 88.0
#: Price regime break and the weekdays (Monday 0) of happy hour and of no trade (fixed values).
PRICE_BREAK, HAPPY_HOUR, NO_TRADE = "2025-07-01", (2, 4), (0, 1)


def clean_string(c: Column) -> Column:
    """Trimmed and unquoted; empty becomes null."""
    return F.nullif(F.trim(F.btrim(F.trim(c), F.lit('"'))), F.lit(""))


def canonical_venue(c: Column, known: dict[str, str]) -> Column:
    """A venue's slug by its name, whatever its case, quotes and spaces; null if it is not known."""
    name = F.lower(F.trim(F.regexp_replace(F.btrim(F.trim(c), F.lit('"')), r"\s+", " ")))
    out = F.lit(None).cast("string")
    for given, slug in known.items():
        out = F.when(name == given, slug).otherwise(out)
    return out


def parse_currency(c: Column) -> Column:
    """"£5.00", "-£5", "(£5)" as a double; what can't be read is null."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[£$€¥,\s]", ""), r"^\((.*)\)$", "-$1")
    return bare.try_cast("double")


def stripped_number(c: Column) -> Column:
    """A cell without currency signs, commas and spaces as a number; null if it is empty or none."""
    return F.nullif(F.regexp_replace(c, CURRENCY, ""), F.lit("")).try_cast("double")


def parse_when(date: Column, time: Column, zone: str) -> Column:
    """The UTC time of a local date and time (missing time: midnight); null if it can't be read."""
    text = F.concat_ws(" ", date, F.coalesce(F.nullif(F.trim(time), F.lit("")), F.lit("00:00:00")))
    return F.to_utc_timestamp(F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm:ss"))), zone)


def without_vat(net: Column, venue: Column, inclusive: tuple[str, ...], rate: float = 0.2) -> Column:
    return F.when(venue.isin(*inclusive), net / (1 + rate)).otherwise(net)


def canonical_product(c: Column) -> Column:
    """Lower case, without sizes and punctuation: "Hop & Co: Session IPA 30L" and "hop co session ipa" are one product."""
    low = F.lower(c)
    bare = F.regexp_replace(low, r"\b[0-9]+(\.[0-9]+)?\s*(ml|cl|l|ltr|litres?|g|kg|pk|pack)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9]+", " "), r"\s+", " "))


def keg_litres(c: Column) -> Column:
    """The litres that a name states, else null."""
    return F.nullif(F.regexp_extract(F.lower(c), r"([0-9]+)\s*l(?:tr|itres?)?\b", 1), F.lit("")).cast("int")


def pints_per_keg(litres: Column, unit: Column) -> Column:
    known = F.lit(None).cast("double")
    for size, pints in PINTS_BY_LITRES.items():
        known = F.when(litres == size, pints).otherwise(known)
    return F.coalesce(known, F.when(unit.isin("keg", "cask"), DEFAULT_PINTS))


def date_in(name: Column) -> Column:
    """The date that a file's name holds, as yyyy-mm-dd or dd-mm-yyyy."""
    iso = F.try_to_date(F.regexp_extract(name, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    return F.coalesce(iso, F.try_to_date(F.regexp_extract(name, r"([0-9]{2}-[0-9]{2}-[0-9]{4})", 1), "dd-MM-yyyy"))


def contains_any(c: Column, markers: list[str]) -> Column:
    low, out = F.lower(c), F.lit(False)
    for m in markers:
        out = out | low.contains(m.lower())
    return F.coalesce(out, F.lit(False))


def first_tag(c: Column, keywords: list[tuple[str, str]], default: str) -> Column:
    """The tag of the first keyword in list order that the text holds."""
    out, low = F.lit(default), F.lower(c)
    for word, tag in reversed(keywords):
        out = F.when(low.contains(word.lower()), tag).otherwise(out)
    return out


def substantive(c: Column) -> Column:
    """Four words or more, or a question."""
    return F.coalesce((F.size(F.split(F.trim(c), r"\s+")) >= 4) | F.trim(c).endswith("?"), F.lit(False))


def criticality(c: Column) -> Column:
    """Weight of a checklist step: conditional steps count 0, safety and cash 5, cleaning and stock 3, others 1."""
    low = F.lower(c)
    return F.when(low.rlike(r"\b(if|when|unless|where applicable)\b"), 0).when(low.rlike(r"alarm|lock|cash|safe|fire|gas|till"), 5).when(low.rlike(r"clean|stock|fridge|temperature|bin"), 3).otherwise(1)


def stock_status(current: Column, par: Column) -> Column:
    return F.when(current <= 0, "OUT_OF_STOCK").when(current < par, "BELOW_PAR").when(current >= 1.5 * par, "OVERSTOCKED").otherwise("OK")


def tender(c: Column) -> Column:
    return F.when(c.isin("CARD", "1-URGENT", "2-HIGH"), "CARD").when(c.isin("CASH", "3-MEDIUM"), "CASH").otherwise("OTHER")


def money(minor: Column, currency: Column) -> Column:
    """Minor units as a number of the currency's main unit."""
    return F.when(F.upper(currency).isin(*ZERO_DECIMAL), minor.cast("double")).otherwise(minor / 100)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def sanitise(c: Column, limit: int) -> Column:
    """White space collapsed; cut at the last word boundary before the limit."""
    bare = F.trim(F.regexp_replace(c, r"\s+", " "))
    cut = F.substring(bare, 1, limit)
    return F.when(F.length(bare) <= limit, bare).otherwise(F.regexp_replace(cut, r"\s+\S*$", ""))


def route(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern that a query meets."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(F.lower(c).rlike(pattern), name).otherwise(out)
    return out


def intent_score(query: Column, title_tokens: Column, bucket: Column) -> Column:
    """0.9 if the query names a checklist, 0.15 for each title token, 0.6 for its bucket, 0.1 for any hit: at most 1, and 0 under 0.3."""
    words = F.split(F.lower(query), r"[^a-z0-9]+")
    hits = F.size(F.array_intersect(words, title_tokens))
    score = F.when(F.array_contains(words, "checklist"), 0.9).otherwise(0.0) + 0.15 * hits + F.when(F.array_contains(words, bucket), 0.6).otherwise(0.0) + F.when(hits > 0, 0.1).otherwise(0.0)
    capped = F.least(score, F.lit(1.0))
    return F.when(capped >= 0.3, capped).otherwise(0.0)


def llm_cost(tier: Column, tokens: list[Column], rates: dict[str, tuple[float, float, float, float]]) -> Column:
    """Dollars of a turn: four token channels, each at its tier's rate for a million tokens, rounded to 6 places."""
    out = F.lit(None).cast("double")
    for name, each in rates.items():
        out = F.when(tier == name, sum((t * r for t, r in zip(tokens, each, strict=True)), F.lit(0.0)) / 1_000_000).otherwise(out)
    return F.round(out, 6)
