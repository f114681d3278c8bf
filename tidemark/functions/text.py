"""Text extraction as column expressions: visible text and management guidance.

Every pattern runs over the whole text. Ambiguity is rejected with a reason; nothing is inferred or converted.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import canonical
from tidemark.session import spread

# --- visible text ----------------------------------------------------------------------------------------------------

# Script and style bodies are character data, so they are matched first and kept whole; comments and tags vanish.
MARKUP = (r"""(?is)<script\b[^>]*>(.*?)</script\s*>|<style\b[^>]*>(.*?)</style\s*>|<!--.*?-->|<[/!?a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
# Named character references of the HTML standard, as the standard library lists them; some are read without semicolon.
_NAMES = json.dumps(html5)
_BARE = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
# Code points 128 to 159 stand for the characters that Windows gives these bytes.
_WINDOWS = json.dumps({str(i): bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)})
REPLACEMENT = "\ufffd"


def _character(code: Column) -> Column:
    """Text of a numeric reference: a surrogate pair beyond the first plane, the replacement character for what is no
    character, nothing for control codes and non-characters."""
    def hexadecimal(number):
        return F.lpad(F.hex(number), 4, "0")
    rest = code - 0x10000
    pair = F.concat(hexadecimal(0xD800 + F.shiftright(rest, 10)), hexadecimal(0xDC00 + rest.bitwiseAND(0x3FF)))
    text = F.decode(F.unhex(F.when(code < 0x10000, hexadecimal(code)).otherwise(pair)), "UTF-16BE")
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | code.between(127, 159) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    windows = F.try_element_at(F.from_json(F.lit(_WINDOWS), "map<string,string>"), code.cast("string"))
    bad = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(bad, REPLACEMENT).when(windows.isNotNull(), windows).when(control, "").otherwise(text)


def _decoded(piece: Column) -> Column:
    """A piece of text that starts at an ampersand, with the reference there decoded; without one it stays as it is."""
    names = F.from_json(F.lit(_NAMES), "map<string,string>")

    def rest(pattern):
        return F.regexp_replace(piece, pattern, "")
    # Leading zeros carry no value; what is longer than the largest code point has no character.
    digits = F.regexp_extract(piece, r"^&#0*([0-9]*)", 1)
    sixteens = F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]*)", 1)
    decimal = F.when(digits == "", F.lit(0)).when(F.length(digits) <= 7, digits.try_cast("bigint"))
    hexa = F.when(sixteens == "", F.lit(0)).when(F.length(sixteens) <= 6, F.conv(sixteens, 16, 10).try_cast("bigint"))
    name = F.regexp_extract(piece, r"^&([^\t\n\f <&#;]{1,32};?)", 1)
    bare = F.regexp_extract(piece, rf"^&({_BARE})", 1)
    whole = F.try_element_at(names, name)
    return (F.when(piece.rlike("^&#[xX][0-9a-fA-F]"), F.concat(_character(hexa), rest("^&#[xX][0-9a-fA-F]+;?")))
            .when(piece.rlike("^&#[0-9]"), F.concat(_character(decimal), rest("^&#[0-9]+;?")))
            .when(whole.isNotNull(), F.concat(whole, F.substring(piece, F.length(name) + 2, F.length(piece))))
            .when(bare != "", F.concat(F.try_element_at(names, bare), F.substring(piece, F.length(bare) + 2, F.length(piece)))).otherwise(piece))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read; without it every reading would repeat the patterns."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescape(col: Column) -> Column:
    """Decode numeric and named references in one pass over the pieces between ampersands, so nothing is decoded twice."""
    return let(col, lambda c: F.when(c.contains("&"), F.array_join(F.transform(F.split(c, "(?=&)"), _decoded), "")).otherwise(c))


def html_to_text(col) -> Column:
    """Visible text: markup becomes a blank, references are decoded twice, whitespace runs collapse."""
    c = F.col(col) if isinstance(col, str) else col
    plain = F.regexp_replace(c, MARKUP, " $1$2 ")
    return F.trim(F.regexp_replace(unescape(unescape(plain)), r"(?U)\s+", " "))


# --- guidance --------------------------------------------------------------------------------------------------------

# Metrics and the words that name them, most specific first where one contains another.
METRICS = {
    "revenue": ("revenue", "revenues", "net sales"),
    "adjusted_eps": ("adjusted diluted eps", "adjusted eps", "non-gaap diluted eps"),
    "diluted_eps": ("diluted eps", "diluted earnings per share"),
    "adjusted_operating_income": ("adjusted operating income",),
    "operating_income": ("operating income",),
    "free_cash_flow": ("free cash flow",),
    "capital_expenditure": ("capital expenditures", "capital expenditure", "capex"),
    "gross_margin": ("gross margin",),
    "operating_margin": ("operating margin",),
}
# Words before a metric that make it another one, words that look ahead, and what quantities are written with.
QUALIFIERS = ("adjusted", "non-gaap", "organic", "constant currency")
OUTLOOK = ("expect", "expects", "forecast", "forecasts", "guidance", "outlook", "project", "projects", "anticipate", "anticipates")
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
CODES = ("usd", "eur", "gbp", "jpy", "cad", "chf", "twd")
SIGNS = ("$", "€", "£", "¥")
ORDINALS = {"first": "1", "1st": "1", "second": "2", "2nd": "2", "third": "3", "3rd": "3", "fourth": "4", "4th": "4"}

# Tokens: record numbers, dates and identifiers whole, then ordinals, numbers, words and the signs that matter.
TOKEN = r"(?i)\d{10}-\d\d-\d{6}|20\d\d-\d\d-\d\d|(?:figi|cik):[a-z0-9._-]*[a-z0-9]|u\.s\.|\d(?:st|nd|rd|th)\b|\d+(?:,\d{3})*(?:\.\d+)?|[a-z]+(?:['-][a-z]+)*|[$€£¥%:;.–—-]"


def lexed(col: Column, kinds: dict[str, tuple[str, ...]], other: str = "W") -> Column:
    """Tokens of a text in lower case, and its shape: one letter per token that names its kind. Rules are then written over
    the shape, where every kind of token is one character, and read their values from the tokens at the same places."""
    tokens = F.transform(F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0)), F.lower)

    def kind(t):
        out = (F.when(t.rlike(r"^\d{10}-\d\d-\d{6}$"), "A").when(t.rlike(r"^20\d\d-\d\d-\d\d$"), "D").when(t.rlike("^(?:figi|cik):"), "I").when(t.rlike(r"^\d[\d,]*(?:\.\d+)?$"), "N"))
        for letter, words in kinds.items():
            out = out.when(t.isin(*words), letter)
        return out.otherwise(other)
    return F.struct(tokens.alias("t"), F.array_join(F.transform(tokens, kind), "").alias("shape"))


COMPARABLE = ["metric", "definition", "period_type", "year", "quarter", "unit", "currency"]


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed exactly once per row. The optimizer would otherwise copy a pattern into every place
    that reads one of its fields; a one-element generator keeps it where it is."""
    cells = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_once")
    return df.select(*df.columns, cells).select(*df.columns, "_once.*")


def statements(col) -> Column:
    """Sentences and list items: blanks collapse, and a mark is set behind closing points and in place of bullets."""
    marked = F.regexp_replace(F.regexp_replace(col, r"\s+", " "), r"(?:([.;]) | [•|] )+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


QUANTITY = {"S": SIGNS, "K": tuple(SCALES), "P": ("%", "percent"), "C": CODES, "J": ("to", "through", "-", "–", "—"), "M": ("midpoint",), "O": ("of", "is")}
_ONE = "S?NK?P?C?"


def _metric(line: Column) -> Column:
    """The first metric named, by the order of the list, in a line of tokens with a blank on either side of each."""
    chain = None
    for metric, aliases in METRICS.items():
        for alias in aliases:
            before = F.rtrim(F.substring_index(line, f" {alias} ", 1))
            qualified = F.lit(False)
            for word in QUALIFIERS:
                qualified = qualified | before.endswith(f" {word}")
            hit = F.struct(F.lit(metric).alias("metric"), F.lit(alias).alias("definition"), qualified.alias("qualified"))
            chain = F.when(line.contains(f" {alias} "), hit) if chain is None else chain.when(line.contains(f" {alias} "), hit)
    return chain


def _period(line: Column) -> Column:
    def group(pattern, i):
        return F.regexp_extract(line, pattern, i)
    year, named, short = r" (?:full[ -]year|fiscal[ -]year|fy) (20\d\d) ", rf" ({'|'.join(ORDINALS)}) quarter (?:of )?(20\d\d) ", r" q ([1-4]) (20\d\d) "
    number = F.try_element_at(F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair]), group(named, 1))

    def period(kind, y, q):
        return F.struct(F.lit(kind).alias("type"), y.alias("year"), q.cast("string").alias("quarter"))
    return (F.when(line.rlike(year), period("fiscal_year", group(year, 1), F.lit(None)))
            .when(line.rlike(named), period("fiscal_quarter", group(named, 2), number))
            .when(line.rlike(short), period("fiscal_quarter", group(short, 2), group(short, 1))))


def _quantity(x: str, before: Column, part: Column, codes: Column) -> Column:
    """(value, unit, currency) of the quantity whose tokens have the shape ``part`` behind the shape ``before``; a bare
    dollar or yen sign names no currency."""
    def token(letter):
        at = F.instr(part, letter)
        return F.when(at > 0, F.get(F.col(f"{x}.t"), F.length(before) + at - 1))
    sign, percent = token("S"), F.instr(part, "P") > 0
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for pair in SCALES.items() for y in pair]), token("K")), F.lit(1.0))
    amount = F.replace(token("N"), F.lit(",")).try_cast("double")
    currency = F.coalesce(F.when(sign == "€", "EUR").when(sign == "£", "GBP"), F.upper(token("C")), F.when(F.size(codes) == 1, F.upper(F.get(codes, F.lit(0)))))
    return F.struct(F.when(percent, amount).otherwise(amount * factor).alias("value"), F.when(percent, "percent").when(currency.isNotNull() | sign.isNotNull(), "currency").otherwise("number").alias("unit"),
                    F.when(~percent, currency).alias("currency"))


def extract_guidance(documents: DataFrame, text="text", key: list[str] | None = None) -> DataFrame:
    """One row per statement that names a metric and looks ahead, with the verdict verified, rejected or conflict.

    ``documents`` should only hold sources whose authority and publication time were checked.
    """
    key = key or [c for c in documents.columns if c != text]
    s = spread(documents).select(*key, F.explode(statements(F.col(text))).alias("statement"))
    # A token that looks ahead stands in the text as it is, so statements without any such word need no tokens.
    s = s.filter(F.col("statement").rlike(rf"(?i){'|'.join(OUTLOOK)}"))
    s = once(s, _x=lexed(F.col("statement"), QUANTITY))
    ahead = F.array(*[F.lit(w) for w in OUTLOOK])
    s = once(s.filter(F.arrays_overlap("_x.t", ahead)), _line=F.concat(F.lit(" "), F.array_join("_x.t", " "), F.lit(" ")))
    s = once(s, _m=_metric(F.col("_line"))).filter(F.col("_m").isNotNull() & ~F.col("_m.qualified"))
    shape, codes = F.col("_x.shape"), F.array_distinct(F.filter("_x.t", lambda t: t.isin(*CODES)))
    span, middle = rf"^(.*?)({_ONE})J({_ONE})", rf"^(.*?MO?)({_ONE})"
    cut = [F.regexp_extract(shape, span, i) for i in (1, 2, 3)]
    s = once(s, _p=_period(F.col("_line")), _b=cut[0], _l=cut[1], _h=cut[2], _bm=F.regexp_extract(shape, middle, 1), _md=F.regexp_extract(shape, middle, 2), _codes=codes)
    s = s.withColumn("_has", F.col("_l") != "").withColumn("_lo", _quantity("_x", F.col("_b"), F.col("_l"), F.col("_codes")))
    s = s.withColumn("_hi", _quantity("_x", F.concat("_b", "_l", F.lit("J")), F.col("_h"), F.col("_codes")))
    s = s.withColumn("_mid", F.when(F.col("_md") != "", _quantity("_x", F.col("_bm"), F.col("_md"), F.col("_codes"))))
    same = (F.col("_lo.unit") == F.col("_hi.unit")) & F.col("_lo.currency").eqNullSafe(F.col("_hi.currency")) & (F.col("_lo.value") <= F.col("_hi.value"))
    named = (F.col("_lo.unit") != "currency") | F.col("_lo.currency").isNotNull()
    middle = F.col("_mid").isNull() | ((F.col("_mid.unit") == F.col("_lo.unit")) & F.col("_mid.currency").eqNullSafe(F.col("_lo.currency")) & F.col("_mid.value").between(F.col("_lo.value"), F.col("_hi.value")))
    ok = F.coalesce(F.col("_p").isNotNull() & F.col("_has") & same & named & middle, F.lit(False))
    out = s.select(*key, "statement", ok.alias("_ok"), F.col("_m.metric").alias("metric"), F.col("_m.definition").alias("definition"), F.col("_p.type").alias("period_type"), F.col("_p.year").alias("year"), F.col("_p.quarter").alias("quarter"),
                   F.col("_lo.value").alias("low"), F.col("_hi.value").alias("high"), F.col("_lo.unit").alias("unit"), F.col("_lo.currency").alias("currency"), F.col("_mid.value").alias("midpoint"))
    # Accepted ranges have both ends, so two different ones differ in their least and greatest; the texts are read once.
    near, ends = Window.partitionBy(canonical(*key, *COMPARABLE)), F.when(F.col("_ok"), F.struct("low", "high"))
    j = out.withColumn("_clash", F.min(ends).over(near) != F.max(ends).over(near))
    return j.withColumn("verdict", F.when(~F.col("_ok"), "rejected").when(F.col("_clash"), "conflict").otherwise("verified")).drop("_ok", "_clash")


def guidance_view(observations: DataFrame, cutoff: Column, published="published_at", issuer="issuer") -> DataFrame:
    """Latest range of each comparable key at the cutoff against the one before it.

    A publication whose copies disagree is dropped whole; identical copies count once. The labels overlap, so their
    order decides: reiterated, raised, lowered, narrowed, widened, changed.
    """
    rows = observations.filter((F.col("verdict") == "verified") & (F.col(published) <= cutoff))
    key = [issuer, *COMPARABLE]
    one = rows.groupBy(*key, published).agg(F.count_distinct("low", "high").alias("_n"), F.min("low").alias("low"), F.min("high").alias("high")).filter("_n = 1").drop("_n")
    w = Window.partitionBy(*key).orderBy(published)
    one = one.withColumn("prev_low", F.lag("low").over(w)).withColumn("prev_high", F.lag("high").over(w)).withColumn("_next", F.lead(published).over(w)).filter("_next IS NULL").drop("_next")
    lo, hi, pl, ph = F.col("low"), F.col("high"), F.col("prev_low"), F.col("prev_high")
    change = (F.when(pl.isNull(), F.lit(None)).when((lo == pl) & (hi == ph), "reiterated").when((lo >= pl) & (hi > ph), "raised").when((lo < pl) & (hi <= ph), "lowered").when((lo > pl) & (hi <= ph), "narrowed")
              .when((lo <= pl) & (hi > ph), "widened").otherwise("changed"))
    return one.withColumn("change", change)


def range_position(value: Column, low: Column, high: Column) -> Column:
    return F.when(value > high, "above").when(value < low, "below").when(value.isNotNull(), "within")
