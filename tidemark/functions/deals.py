"""Terms of mergers and delistings in filings, and whether a filing may be believed at all.

A term is a *value* (a day, an identity, a record number, an amount) that stands near a *role word* in the same statement, with
nothing but known connecting words between. Every pattern is one pass over the text. A term counts only if the text gives it exactly
one distinct value; the rest is refused with a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import canonical
from tidemark.functions.text import html_to_text, once
from tidemark.session import spread

# Month names and the ways to write a currency.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONEY = {"usd": "USD", "u.s. dollar": "USD", "u.s. dollars": "USD", "eur": "EUR", "euro": "EUR", "euros": "EUR", "gbp": "GBP", "pound sterling": "GBP", "pounds sterling": "GBP",
         "cad": "CAD", "canadian dollar": "CAD", "canadian dollars": "CAD", "jpy": "JPY", "japanese yen": "JPY"}
# Words that make a text one about a merger or a delisting.
NATURES = {"merger": ("merger", "acquisition", "business combination"), "delisting": ("delist", "delisted", "delisting")}

DAY = rf"20\d\d-\d\d-\d\d|(?:{'|'.join(MONTHS)})\s\d\d?,\s20\d\d"
IDENTITY, RECORD, NUMBER = r"(?:figi|cik):[a-z0-9._-]*[a-z0-9]|\d{1,10}", r"\d{10}-\d\d-\d{6}", r"\d+(?:,\d{3})*(?:\.\d+)?"
CURRENCY = "|".join(sorted((k.replace(".", r"\.") for k in MONEY), key=len, reverse=True))


def _any(words) -> str:
    return "|".join(words)


@dataclass(frozen=True)
class Role:
    """Words that give a value its role, a word that must follow them, and words that may stand anywhere between."""
    value: str
    words: tuple[str, ...]
    needed: tuple[str, ...] = ()
    between: tuple[str, ...] = ()

    @property
    def pattern(self) -> str:
        """Group 1 is the value. At most three connecting words on either side of the needed one."""
        step = rf"(?:\s(?:{_any(self.between)})|\s?:){{0,3}}"
        middle = rf"{step}\s(?:{_any(self.needed)}){step}" if self.needed else step
        return rf"(?i)\b(?:{_any(self.words)}){middle}\s?({self.value})\b"


LINK = ("is", "was")
ROLES = {
    "closing": Role(DAY, ("effective", "completed", "closed"), ("on", "date"), LINK),
    "closing of the merger": Role(DAY, ("merger",), ("effective", "completed", "closed"), (*LINK, "became", "on")),
    "successor": Role(IDENTITY, ("successor", "acquirer", "surviving company"), ("identity", "identifier", "cik"), (*LINK, "stable", "security", "sec")),
    "target": Role(IDENTITY, ("target", "issuer", "subject company"), ("identity", "identifier", "cik"), (*LINK, "stable", "security", "sec")),
    "amended": Role(RECORD, ("amends", "amending", "supersedes"), (), ("and", "supplements", "accession", "number")),
}
#: What an amount is paid for, and the two orders of amount and currency.
PER_SHARE = r"(?:\sin\scash)?\s(?:for|per)(?:\seach)?\sshare\b"
CASH = rf"(?i)(?:\b{NUMBER}\s?(?:{CURRENCY})|\b(?:{CURRENCY})\s?{NUMBER}){PER_SHARE}"
#: Shares received for a share: the received ones are counted, and may be named.
STOCK = rf"(?i)\b({NUMBER})\sshares?(?:\sof\s[^.;]{{1,100}}?\sshares?)?\s(?:for|per)(?:\seach)?\sshare\b"


def identifier(c: Column) -> Column:
    """FIGI:x or CIK:n without leading zeros."""
    t = F.upper(F.trim(c))
    number = F.regexp_extract(t, r"^(?:CIK:)?0*(\d+)$", 1)
    return F.when(t.rlike(r"^(?:CIK:)?\d+$"), F.concat(F.lit("CIK:"), number)).when(t.rlike(r"^(FIGI|CIK):.+$"), t)


def _found(x: Column, *roles: str) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(x, F.lit(ROLES[r].pattern), F.lit(1)) for r in roles]))


def _distinct(a: Column) -> Column:
    return F.array_distinct(F.array_compact(a))


def _day(c: Column) -> Column:
    return F.when(c.startswith("20"), F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))).otherwise(F.to_date(F.try_to_timestamp(F.initcap(c), F.lit("MMMM d, yyyy"))))


def _amount(c: Column) -> Column:
    codes = F.create_map(*[F.lit(y) for pair in MONEY.items() for y in pair])
    number = F.regexp_extract(c, rf"(?:^|\s|(?i:[a-z.]))({NUMBER})", 1)
    return F.struct(F.replace(number, F.lit(",")).try_cast("double").alias("amount"), F.try_element_at(codes, F.lower(F.regexp_extract(c, rf"(?i)({CURRENCY})", 1))).alias("currency"))


def nature(x: Column) -> Column:
    """merger or delisting, in this order, by the words of a text."""
    out = None
    for name, words in NATURES.items():
        here = x.rlike(rf"(?i)\b(?:{_any(words)})\b")
        out = F.when(here, name) if out is None else out.when(here, name)
    return out


def terminal_terms(documents: DataFrame, text="text", target="target_id") -> DataFrame:
    """Merger or delisting terms, accepted only when every term has exactly one distinct value; else the reason why not."""
    return _judged(spread(documents), text, target)


def _judged(documents: DataFrame, text: str, target: str) -> DataFrame:
    x = F.col("_x")
    d = once(documents, _x=F.trim(F.regexp_replace(F.col(text), r"\s+", " ")))
    cash = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(x, F.lit(CASH), F.lit(0)), _amount), lambda r: (r["amount"] > 0) & r["currency"].isNotNull()))
    ratios = _distinct(F.transform(F.regexp_extract_all(x, F.lit(STOCK), F.lit(1)), lambda n: F.replace(n, F.lit(",")).try_cast("double")))
    about = nature(x)
    # A text about neither is refused whatever it says, so nothing is looked for in it.
    d = once(d, _about=about, _terms=F.when(about.isNotNull(), F.struct(
        _distinct(F.transform(_found(x, "closing", "closing of the merger"), _day)).alias("days"), cash.alias("cash"), ratios.alias("ratios"),
        _distinct(F.transform(_found(x, "successor"), identifier)).alias("successors"), _distinct(F.transform(_found(x, "target"), identifier)).alias("targets"), F.array_distinct(_found(x, "amended")).alias("amended"))))
    t, zero = F.col("_terms"), F.lit(0)
    one_cash, one_ratio, own = F.get(t["cash"], zero), F.get(t["ratios"], zero), identifier(F.col(target))
    n = {k: F.size(t[k]) for k in ("days", "cash", "ratios", "successors", "targets", "amended")}
    reason = (F.when(F.col("_about").isNull(), "not a merger or delisting").when((n["targets"] > 0) & ~((n["targets"] == 1) & F.coalesce(F.get(t["targets"], zero) == own, F.lit(False))), "target identity")
              .when(n["days"] != 1, "effective date").when((n["cash"] > 1) | (n["ratios"] > 1) | (n["successors"] > 1), "ambiguous terms").when((n["cash"] == 0) & (n["ratios"] == 0), "no consideration")
              .when((n["ratios"] == 1) & ((one_ratio <= 0) | (n["successors"] == 0)), "stock terms").when(n["amended"] > 1, "ambiguous amendment"))
    kind = F.when((n["cash"] == 1) & (n["ratios"] == 1), "mixed").when(n["cash"] == 1, "cash").otherwise("stock")
    d = d.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    keep = [c for c in documents.columns if c != text]
    return d.select(*keep, F.when(ok, "accepted").otherwise("rejected").alias("status"), "reason", F.when(ok, F.col("_about")).alias("nature"), F.when(ok, kind).alias("kind"), F.when(ok, F.get(t["days"], zero)).alias("effective_on"),
                    F.when(ok, one_cash["amount"]).alias("cash"), F.when(ok, one_cash["currency"]).alias("currency"), F.when(ok, one_ratio).alias("ratio"),
                    F.when(ok & (n["ratios"] == 1), F.get(t["successors"], zero)).alias("successor_id"), F.when(ok, F.get(t["amended"], zero)).alias("supersedes"))


# --- whether a filing counts as evidence -----------------------------------------------------------------------------

#: Forms that may state such terms, hosts and folder of the regulator's archive, and how the sources are named.
FORMS = ("8-K", "8-K/A", "6-K", "6-K/A", "DEFM14A", "S-4", "S-4/A", "25-NSE")
ARCHIVE_HOSTS, ARCHIVE_FOLDER = ("sec.gov", "www.sec.gov"), "/Archives/edgar/data/"
FILING, RELEASE = "sec_filing", "official_issuer"
SHA256 = "^[0-9a-f]{64}$"


def source_authority(kind: Column, url: Column, issuer_domains: Column) -> Column:
    """True for a filing in the regulator's archive, and for a release on a host that is or lies under a domain of the issuer."""
    part = {p: F.try_parse_url(url, F.lit(p)) for p in ("PROTOCOL", "HOST", "PATH")}
    secure = F.lower(part["PROTOCOL"]) == "https"
    host = F.rtrim(F.lower(part["HOST"]), F.lit("."))
    archive = (kind == FILING) & F.lower(part["HOST"]).isin(*ARCHIVE_HOSTS) & part["PATH"].startswith(ARCHIVE_FOLDER)
    domains = F.filter(F.transform(F.coalesce(issuer_domains, F.array().cast("array<string>")), lambda d: F.rtrim(F.lower(F.trim(d)), F.lit("."))), lambda d: d != "")
    return F.coalesce(secure & (archive | ((kind == RELEASE) & F.exists(domains, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d))))), F.lit(False))


def evidence_reason(authority: Column, published: Column, available: Column, retrieved: Column, record_id: Column, hashes: Column, target: Column, expected: Column) -> Column:
    """Why a record is no evidence whatever it says, or NULL: source, clocks, identity of the record, identity of the issuer."""
    clocks = published.isNotNull() & available.isNotNull() & retrieved.isNotNull() & (published <= available) & (available <= retrieved)
    record = (F.coalesce(F.trim(record_id), F.lit("")) != "") & (F.size(hashes) > 0) & F.forall(hashes, lambda h: h.rlike(SHA256))
    own = identifier(target).isNotNull() & identifier(target).eqNullSafe(identifier(expected))
    return (F.when(~authority, "source authority").when(~F.coalesce(clocks, F.lit(False)), "evidence clocks").when(~F.coalesce(record, F.lit(False)), "record identity").when(~own, "issuer identity"))


def terminal_records(records: DataFrame) -> DataFrame:
    """Terms of records as they were retrieved: accession, ticker, cik, source_kind, source_url, issuer_domains, the three clocks, target_id,
    expected_id, documents (array of raw texts) and record_hash, which may be missing. Adds document_hashes, the status and the terms.

    A record without a hash of its own gets that of its canonical content, retrieval time and documents left out.
    """
    content = canonical("accession", "ticker", "cik", "source_kind", "source_url", "published_at", "available_at", "target_id", "expected_id")
    given = F.lower(F.coalesce("record_hash", F.lit("")))
    r = once(spread(records), _hashes=F.transform("documents", lambda d: F.sha2(F.encode(d, "UTF-8"), 256)), _hash=F.when(given.rlike(SHA256), given).otherwise(F.sha2(content, 256)))
    unread = F.when(F.coalesce(F.size("documents"), F.lit(0)) <= 0, "no documents").when(F.exists("documents", lambda d: d.isNull()), "unreadable document")
    authority = source_authority(F.col("source_kind"), F.col("source_url"), F.col("issuer_domains"))
    before = F.coalesce(unread, evidence_reason(authority, F.col("published_at"), F.col("available_at"), F.col("retrieved_at"), F.col("accession"), F.col("_hashes"), F.col("target_id"), F.col("expected_id")))
    attributed = (F.coalesce(F.trim("ticker"), F.lit("")) != "") & F.coalesce(identifier(F.concat(F.lit("CIK:"), F.col("cik").cast("string"))) == identifier(F.col("expected_id")), F.lit(False))
    r = r.withColumn("document_hashes", F.col("_hashes")).withColumn("record_hash", F.col("_hash")).withColumn("_before", before)
    # Only documents that count as evidence are read for terms.
    body = F.when(F.col("_before").isNull(), F.array_join(F.transform("documents", html_to_text), " "))
    out = _judged(r.select(*records.columns, "document_hashes", "_before", attributed.alias("_attributed"), body.alias("_text")).drop("documents"), "_text", "target_id")
    reason = F.coalesce("_before", "reason", F.when(~F.col("_attributed"), "ticker attribution"))
    ok = reason.isNull()
    terms = ("nature", "kind", "effective_on", "cash", "currency", "ratio", "successor_id", "supersedes")
    out = out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))
    return out.select(*[c for c in out.columns if c not in (*terms, "_before", "_attributed")], *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in terms])


def terminal_event_rows(terms: DataFrame, existing: DataFrame) -> DataFrame:
    """Accepted terms as event rows; a record whose hashes are stored already is unchanged and not written again."""
    rows = terms.filter("status = 'accepted'").withColumn("event_type", F.concat_ws("_", "nature", "kind"))
    return rows.join(existing.select("accession", "record_hash", "document_hashes").distinct(), ["accession", "record_hash", "document_hashes"], "left_anti")


def new_filings(filings: DataFrame, checked: DataFrame, now: Column, most: int = 12, hours: int = 20) -> DataFrame:
    """The filings to read in a refresh: of the forms that may state terms, the newest per symbol, for symbols not checked within so many hours."""
    from pyspark.sql import Window
    recent = checked.where(F.col("checked_at").between(now - F.expr(f"INTERVAL {hours} HOURS") + F.expr("INTERVAL 1 MICROSECOND"), now)).select("ticker")
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("accepted_at"), F.desc("accession")))
    return filings.where(F.col("form").isin(*FORMS)).join(recent, "ticker", "left_anti").withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
