"""Column expressions shared by the operators. All stay inside Catalyst; there is no Python UDF here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import policy


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- numbers ---------------------------------------------------------------------------------------------------------

def finite(col) -> Column:
    """Parse to double; text that is not a number, NaN and infinities become NULL."""
    v = _c(col).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)


def positive(col) -> Column:
    v = finite(col)
    return F.when(v > 0, v)


def non_negative(col) -> Column:
    v = finite(col)
    return F.when(v >= 0, v)


def clamp(col, low: float, high: float) -> Column:
    v = _c(col)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def ratio(a, b) -> Column:
    """a / b, NULL when b is zero or NULL."""
    return _c(a) / F.nullif(_c(b), F.lit(0.0))


def signed_log10(col) -> Column:
    v = _c(col)
    return F.signum(v) * F.log10(F.lit(1.0) + F.abs(v))


def clip_probability(col, floor: float = policy.PROBABILITY_FLOOR) -> Column:
    return F.least(F.greatest(_c(col), F.lit(floor)), F.lit(1 - floor))


def logit(col, floor: float = policy.PROBABILITY_FLOOR) -> Column:
    p = clip_probability(col, floor)
    return F.log(p / (1 - p))


def sigmoid(col, bound: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-clamp(col, -bound, bound)))


def annualise(wealth, periods, per_year: float = 12.0) -> Column:
    return F.pow(_c(wealth), F.lit(per_year) / _c(periods)) - 1


def qoq_annualised(current, previous) -> Column:
    return F.pow(ratio(current, previous), F.lit(4.0)) - 1


def discount_sum(cash, growth, rate, years: int) -> Column:
    """Present value of ``years`` cash amounts growing by ``growth`` and discounted at ``rate``."""
    step = (1 + _c(growth)) / (1 + _c(rate))
    return reduce(lambda a, b: a + b, [_c(cash) * F.pow(step, F.lit(float(y))) for y in range(1, years + 1)])


def weighted_available(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are present; NULL when none is."""
    num = reduce(lambda a, b: a + b, [F.coalesce(_c(v) * w, F.lit(0.0)) for v, w in parts])
    den = reduce(lambda a, b: a + b, [F.when(_c(v).isNotNull(), F.lit(abs(w))).otherwise(0.0) for v, w in parts])
    return num / F.nullif(den, F.lit(0.0))


def step_score(col, steps: list[tuple[float, float]], floor: float) -> Column:
    """Score of the first threshold the value reaches (thresholds descending), else ``floor``; NULL stays NULL."""
    v = _c(col)
    out = F.when(v.isNull(), F.lit(None).cast("double"))
    for threshold, score in steps:
        out = out.when(v >= threshold, F.lit(float(score)))
    return out.otherwise(F.lit(float(floor)))


def band(col, edges: tuple[tuple[float, str], ...], above: str, unknown: str = "unknown") -> Column:
    """Label of the first edge the value lies strictly below, else ``above``; NULL becomes ``unknown``."""
    v = _c(col)
    out = F.when(v.isNull(), F.lit(unknown))
    for edge, name in edges:
        out = out.when(v < edge, F.lit(name))
    return out.otherwise(F.lit(above))


def volatility_band(col) -> Column:
    return band(col, policy.VOLATILITY_BANDS, "wild")


def verdict(excess_percent, cost: float = policy.COST_BAND_PERCENT) -> Column:
    v = _c(excess_percent)
    return (F.when(v > cost, "outperformed").when(v < -cost, "underperformed").when(v.isNotNull(), "neutral"))


# --- text ------------------------------------------------------------------------------------------------------------

def symbol(col) -> Column:
    v = F.upper(F.trim(_c(col)))
    return F.when(v != "", v)


def squeeze(col) -> Column:
    """Collapse every whitespace run to one blank and trim."""
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def sentences(col) -> Column:
    return F.filter(F.split(squeeze(col), r"(?<=[.!?;])\s+"), lambda s: s != "")


def stable_id(share_figi, composite_figi, cik, crypto=None) -> Column:
    """First identifier present, tagged with its scheme."""
    def tagged(prefix, value):
        v = F.trim(_c(value))
        return F.when((v != ""), F.concat(F.lit(prefix), v))
    parts = [tagged("FIGI:", share_figi), tagged("FIGI:", composite_figi), tagged("CIK:", cik)]
    return F.coalesce(*parts, *([tagged("CRYPTO:", crypto)] if crypto is not None else []))


# Fixed value: legal-form words dropped from the end of an issuer name.
LEGAL_SUFFIXES = ("INC", "CORP", "CORPORATION", "PLC", "LTD", "LIMITED", "CO", "COMPANY")


def company_key(name, fallback=None, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    """Issuer name without punctuation and without trailing legal-form words, however many there are."""
    words = F.trim(F.regexp_replace(F.upper(_c(name)), "[^A-Z0-9]+", " "))
    either = "|".join(suffixes)
    stripped = F.regexp_replace(words, r"(^| )(%s)( (%s))*$" % (either, either), "")
    key = F.nullif(stripped, F.lit(""))
    return F.coalesce(key, _c(fallback)) if fallback is not None else key


def domain_allowed(url, domains: list[str]) -> Column:
    """True when the host equals an allowed domain or lies under one."""
    host = F.lower(F.try_parse_url(_c(url), F.lit("HOST")))
    return F.coalesce(reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in domains]), F.lit(False))


# Words of a rating, tested in this order because "underperform" contains "perform".
RATING_WORDS = {
    "negative": ("sell", "underperform", "underweight", "reduce", "negative"),
    "positive": ("buy", "outperform", "overweight", "accumulate", "positive"),
    "neutral": ("hold", "neutral", "equal weight", "market perform", "sector perform", "peer perform"),
}


def rating_direction(col) -> Column:
    text = F.regexp_replace(F.lower(F.trim(_c(col))), "_", " ")
    out = F.when(text.isNull(), F.lit("unknown"))
    for label, words in RATING_WORDS.items():
        out = out.when(text.rlike("|".join(words)), F.lit(label))
    return out.otherwise(F.lit("unknown"))


def is_hash(col) -> Column:
    return F.coalesce(_c(col).rlike("^[0-9a-f]{64}$"), F.lit(False))


def currency_clean(col) -> Column:
    v = F.upper(F.trim(_c(col)))
    return F.when(v.rlike("^[A-Z]{3}$"), v)


def utc_clean(col) -> Column:
    """Timestamp of a text that carries a zone; a naive or unreadable text is NULL."""
    v = F.trim(_c(col))
    return F.when(v.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(v))


def canonical(*cols) -> Column:
    """Stable text of typed fields: name-free, separator and NULL marked, so equal rows always hash equal."""
    return F.concat_ws("\x1f", *[F.coalesce(_c(c).cast("string"), F.lit("\\N")) for c in cols])


def content_address(*cols) -> Column:
    return F.sha2(canonical(*cols), 256)


# --- time ------------------------------------------------------------------------------------------------------------

def session_cutoff(date, hour: int = 16, minute: int = 15, zone: str = "America/New_York") -> Column:
    """UTC instant at which the decision for a session is frozen."""
    local = F.to_timestamp(F.concat(_c(date).cast("date").cast("string"), F.lit(" %02d:%02d:00" % (hour, minute))))
    return F.to_utc_timestamp(local, zone)


def friday_on_or_after(date) -> Column:
    return F.next_day(F.date_sub(_c(date), 1), "FRI")


def is_weekday(date) -> Column:
    return F.weekday(_c(date)) < 5


def next_weekday(date) -> Column:
    d = F.date_add(_c(date), 1)
    return F.when(F.weekday(d) == 5, F.date_add(d, 2)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def after_close(ts, zone: str = "America/New_York", hour: int = 16) -> Column:
    return F.hour(F.from_utc_timestamp(_c(ts), zone)) >= hour


def months_before(date, months: int) -> Column:
    return F.add_months(F.trunc(_c(date), "MM"), -months)


def visible(published, available, cutoff) -> Column:
    """Both clocks present and not after the cutoff."""
    return F.coalesce((_c(published) <= _c(cutoff)) & (_c(available) <= _c(cutoff)), F.lit(False))
