"""Queries over text extraction, document loaders and the streaming jobs. Documents are written from the given tables."""

from html.entities import html5

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import view
from tidemark.functions import deals, text
from tidemark.functions.scalars import company_key, domain_allowed, friday_on_or_after, next_weekday, rating_direction, sentences, session_cutoff, signed_log10, squeeze, stable_id, verdict
from tidemark.operators import league
from tidemark.session import scratch_dir, spread
from tidemark.sources import documents as doc, filings, store
from tidemark.streaming import state, streams

def _quoted(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_BARE = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
_WINDOWS = {i: bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_CHAR = f"""CASE WHEN code IS NULL OR code = 0 OR code BETWEEN 55296 AND 57343 OR code > 1114111 THEN chr(65533)
 WHEN code IN ({", ".join(str(i) for i in _WINDOWS)}) THEN list_extract({_quoted(_WINDOWS.values())}, list_position([{",".join(str(i) for i in _WINDOWS)}], code))
 WHEN code BETWEEN 1 AND 8 OR code = 11 OR code BETWEEN 14 AND 31 OR code BETWEEN 127 AND 159 OR code BETWEEN 64976 AND 65007 OR code & 65534 = 65534 THEN '' ELSE chr(CAST(code AS INTEGER)) END"""


def _decoded_sql(source: str) -> str:
    """The references of one text column (r, t) decoded once: pieces that start at an ampersand, each by the rule of the HTML standard."""
    return f"""SELECT r, string_agg(CASE WHEN i = 1 THEN piece WHEN numeric THEN ({_CHAR}) || regexp_replace(piece, '^#([xX][0-9a-fA-F]+|[0-9]+);?', '')
 WHEN w.value IS NOT NULL THEN w.value || substr(piece, length(name) + 1) WHEN b.value IS NOT NULL THEN b.value || substr(piece, length(bare) + 1) ELSE '&' || piece END, '' ORDER BY i) AS t FROM (
 SELECT *, regexp_matches(piece, '^#([xX][0-9a-fA-F]|[0-9])') AS numeric, regexp_extract(piece, '^([^\t\n\f <&#;]{{1,32}};?)', 1) AS name, regexp_extract(piece, '^({_BARE})', 1) AS bare,
  CASE WHEN regexp_matches(piece, '^#[xX]') THEN CASE WHEN length(hexa) <= 6 THEN CAST('0x' || lpad(hexa, 6, '0') AS BIGINT) END WHEN length(digits) <= 7 THEN CAST('0' || digits AS BIGINT) END AS code FROM (
  SELECT r, i, piece, regexp_extract(piece, '^#[xX]0*([0-9a-fA-F]*)', 1) AS hexa, regexp_extract(piece, '^#0*([0-9]*)', 1) AS digits FROM (SELECT r, unnest(string_split(t, '&')) AS piece, generate_subscripts(string_split(t, '&'), 1) AS i FROM ({source}))))
 LEFT JOIN (SELECT unnest({_quoted(html5)}) AS key, unnest({_quoted(html5.values())}) AS value) w ON w.key = name LEFT JOIN (SELECT unnest({_quoted(html5)}) AS key, unnest({_quoted(html5.values())}) AS value) b ON b.key = bare GROUP BY r"""


_TAGS = r"""(?s)<[sS][cC][rR][iI][pP][tT]\b[^>]*>(.*?)</[sS][cC][rR][iI][pP][tT][\t-\r ]*>|<[sS][tT][yY][lL][eE]\b[^>]*>(.*?)</[sS][tT][yY][lL][eE][\t-\r ]*>|<!--.*?-->|<[/!?a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
_SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PAGES = "SELECT row_number() OVER () AS r, page_id, html FROM pages"


@query("html_to_text", "page_id:l text:s", rf"""
WITH numbered AS MATERIALIZED ({_PAGES}), decoded AS ({_decoded_sql(_decoded_sql(rf"SELECT r, regexp_replace(html, '{_TAGS}', ' \1\2 ', 'g') AS t FROM numbered"))})
SELECT page_id, trim(regexp_replace(t, '{_SPACES}', ' ', 'g')) AS text FROM numbered LEFT JOIN decoded ON decoded.r = numbered.r""")
def _(v):
    return spread(v.table("pages")).select("page_id", text.html_to_text("html").alias("text"))


# --- guidance --------------------------------------------------------------------------------------------------------

_METRIC = ["revenue", "adjusted eps", "gross margin", "capex", "free cash flow", "organic revenue"]


@view("guide_src", """
SELECT o_orderkey AS k, 'I' || o_custkey AS issuer, CAST(o_orderdate AS TIMESTAMP) AS published_at, list_extract(['revenue','adjusted eps','gross margin','capex','free cash flow','organic revenue'], CAST(o_orderkey % 6 + 1 AS BIGINT)) AS metric,
 2020 + o_orderkey % 3 AS y, CAST(floor(o_totalprice) AS BIGINT) % 850 + 100 AS lo, CAST(floor(o_totalprice) AS BIGINT) % 850 + 100 + o_orderkey % 40 AS hi FROM orders""")
def _guide_src(v):
    k, n = F.col("o_orderkey"), F.floor("o_totalprice") % 850 + 100
    return v.table("orders").select(k.alias("k"), F.concat(F.lit("I"), F.col("o_custkey").cast("string")).alias("issuer"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
                                    F.get(F.array(*[F.lit(m) for m in _METRIC]), (k % 6).cast("int")).alias("metric"), (2020 + k % 3).alias("y"), n.alias("lo"), (n + k % 40).alias("hi"))


@view("guide_docs", "SELECT 1 AS unused")
def _guide_docs(v):
    """A release per order. Some ranges are stated twice and differently, some name no currency, some no period."""
    k, lo, hi = F.col("k"), F.col("lo").cast("string"), F.col("hi").cast("string")
    unit = F.when(F.col("metric") == "gross margin", "%").when(k % 7 == 0, " million").otherwise(" million USD")
    sign = F.when((F.col("metric") != "gross margin") & (k % 7 == 0), "$").otherwise("")
    when = F.when(k % 11 == 0, "").when(k % 2 == 0, F.concat(F.lit("fiscal year "), F.col("y").cast("string"))).otherwise(F.concat(F.lit("second quarter of "), F.col("y").cast("string")))
    say = lambda low: F.concat(F.lit("We expect "), when, F.lit(" "), F.col("metric"), F.lit(" of "), sign, low, unit, F.lit(" to "), sign, hi, unit, F.lit("."))
    body = F.concat_ws(" ", F.lit("Results were strong."), say(lo), F.when(k % 13 == 0, say(F.lit("1"))), F.lit("This statement is final; no revenue figure follows."))
    return v.guide_src.select("k", "issuer", "published_at", body.alias("text"))


_GOOD = "k % 11 <> 0 AND NOT (metric <> 'gross margin' AND k % 7 = 0)"


@view("guided", f"""
SELECT *, CASE WHEN NOT ok THEN 'rejected' WHEN k % 13 = 0 AND lo <> 1 THEN 'conflict' ELSE 'verified' END AS verdict FROM (
SELECT k, issuer, published_at, CASE metric WHEN 'adjusted eps' THEN 'adjusted_eps' WHEN 'gross margin' THEN 'gross_margin' WHEN 'capex' THEN 'capital_expenditure' WHEN 'free cash flow' THEN 'free_cash_flow' ELSE 'revenue' END AS metric, metric AS definition,
 CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'fiscal_year' ELSE 'fiscal_quarter' END END AS period_type, CASE WHEN k % 11 <> 0 THEN CAST(y AS VARCHAR) END AS year, CASE WHEN k % 11 <> 0 AND k % 2 = 1 THEN '2' END AS quarter, lo, hi AS h, {_GOOD} AS ok,
 low*CASE WHEN metric = 'gross margin' THEN 1e0 ELSE 1e6 END AS low, hi*CASE WHEN metric = 'gross margin' THEN 1e0 ELSE 1e6 END AS high, CASE metric WHEN 'gross margin' THEN 'percent' ELSE 'currency' END AS unit, CASE WHEN metric <> 'gross margin' AND k % 7 <> 0 THEN 'USD' END AS currency
FROM (SELECT *, unnest(CASE WHEN k % 13 = 0 THEN [lo, 1] ELSE [lo] END) AS low FROM guide_src) WHERE metric <> 'organic revenue')""")
def _guided(v):
    return text.extract_guidance(v.guide_docs, key=["k", "issuer", "published_at"])


@query("guidance_extraction", "k:l metric:s definition:s period_type:s year:s quarter:s low:f0 high:f0 unit:s currency:s verdict:s", "SELECT * FROM guided")
def _(v):
    return v.guided


@view("guide_view", """
SELECT issuer, metric, definition, period_type, year, quarter, unit, currency, published_at, low, high, pl AS prev_low, ph AS prev_high, CASE WHEN pl IS NULL THEN NULL WHEN low = pl AND high = ph THEN 'reiterated' WHEN low >= pl AND high > ph THEN 'raised'
 WHEN low < pl AND high <= ph THEN 'lowered' WHEN low > pl AND high <= ph THEN 'narrowed' WHEN low <= pl AND high > ph THEN 'widened' ELSE 'changed' END AS change FROM (
SELECT *, lag(low) OVER w AS pl, lag(high) OVER w AS ph, lead(published_at) OVER w AS nx FROM (
 SELECT issuer, metric, definition, period_type, year, quarter, unit, currency, published_at, min(low) AS low, min(high) AS high FROM guided WHERE verdict = 'verified' AND published_at <= TIMESTAMP '2000-06-30' GROUP BY ALL HAVING count(DISTINCT (low, high)) = 1)
 WINDOW w AS (PARTITION BY issuer, metric, definition, period_type, year, quarter, unit, currency ORDER BY published_at)) WHERE nx IS NULL""")
def _guide_view(v):
    return text.guidance_view(v.guided, F.lit("2000-06-30").cast("timestamp"))


@query("guidance_view", "issuer:s metric:s year:s quarter:s low:f0 high:f0 prev_low:f0 change:s", "SELECT * FROM guide_view")
def _(v):
    return v.guide_view


@query("guidance_change", "change:s n:l", "SELECT change, count(*) AS n FROM guide_view GROUP BY 1")
def _(v):
    return v.guide_view.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("guidance_documents", "issuer:l accession:l rank:l source:s", """
SELECT f.issuer, f.accession, f.rank, d.source FROM (SELECT cik AS issuer, accession, row_number() OVER (PARTITION BY cik ORDER BY filed_on DESC, accession DESC) AS rank FROM filing_rows
 WHERE form IN ('8-K','6-K') AND filed_on <= DATE '2000-03-01' AND (items LIKE '%2.02%' OR items LIKE '%7.01%' OR items LIKE '%8.01%')) f JOIN documents d ON d.doc_id = f.accession // 10 WHERE f.rank <= 8""")
def _(v):
    rows = v.filing_rows.withColumnRenamed("cik", "issuer").withColumn("accepted_at", F.col("filed_on"))
    texts = v.filing_rows.select("accession", F.floor(F.col("accession") / 10).alias("doc_id")).join(v.table("documents").select("doc_id", "source"), "doc_id").drop("doc_id")
    return filings.guidance_documents(rows, texts, F.lit("2000-03-01").cast("date"))


# --- merger terms ----------------------------------------------------------------------------------------------------

@view("deal_docs", "SELECT 1 AS unused")
def _deal_docs(v):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    when = F.date_format(F.timestamp_add("YEAR", F.lit(20), F.col("o_orderdate").cast("timestamp")), "MMMM d, yyyy")
    cash = F.concat(F.lit("Holders receive "), (k % 200 + 1).cast("string"), F.when(k % 8 == 1, " dollars").otherwise(" USD"), F.lit(" in cash per share."))
    stock = F.concat(F.lit("Each receives 0."), (k % 9 + 1).cast("string"), F.lit(" shares for each share. Successor security identity: FIGI:N"), (k % 50).cast("string"), F.lit("."))
    body = F.concat_ws(" ", F.concat(F.lit("Issuer SEC CIK: "), F.when(k % 17 == 0, F.lit("999999")).otherwise(c), F.lit(".")),
                       F.when(k % 10 == 9, F.concat(F.lit("The delisting became effective on "), when, F.lit("."))).otherwise(F.concat(F.lit("The  merger\n was completed on "), when, F.lit("."))),
                       F.when(k % 3 != 0, cash), F.when(k % 3 != 1, stock), F.when(k % 19 == 0, F.lit("Others receive 7 EUR per share.")),
                       F.when(k % 6 == 0, F.lit("This supersedes accession 0000000001-25-000001.")))
    return v.table("orders").select(k.alias("accession"), F.concat(F.lit("CIK:"), c).alias("target_id"), body.alias("text"))


@view("deals", """
SELECT k AS accession, CASE WHEN why IS NULL THEN 'accepted' ELSE 'rejected' END AS status, why AS reason, CASE WHEN why IS NULL THEN CASE WHEN k % 10 = 9 THEN 'delisting' ELSE 'merger' END END AS nature, CASE WHEN why IS NULL THEN CASE WHEN hc AND hs THEN 'mixed' WHEN hc THEN 'cash' ELSE 'stock' END END AS kind,
 CASE WHEN why IS NULL THEN d END AS effective_on, CASE WHEN why IS NULL AND hc THEN CASE WHEN c1 THEN k % 200 + 1 ELSE 7 END END AS cash, CASE WHEN why IS NULL AND hc THEN CASE WHEN c1 THEN 'USD' ELSE 'EUR' END END AS currency, CASE WHEN why IS NULL AND hs THEN (k % 9 + 1)/10e0 END AS ratio,
 CASE WHEN why IS NULL AND hs THEN 'FIGI:N' || k % 50 END AS successor_id, CASE WHEN why IS NULL AND k % 6 = 0 THEN '0000000001-25-000001' END AS supersedes FROM (
SELECT *, CASE WHEN k % 17 = 0 THEN 'target identity' WHEN c1 AND k % 19 = 0 THEN 'ambiguous terms' WHEN NOT hc AND NOT hs THEN 'no consideration' END AS why FROM (
SELECT o_orderkey AS k, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS d, o_orderkey % 3 <> 0 AND o_orderkey % 8 <> 1 AS c1, (o_orderkey % 3 <> 0 AND o_orderkey % 8 <> 1) OR o_orderkey % 19 = 0 AS hc, o_orderkey % 3 <> 1 AS hs FROM orders))""")
def _deals(v):
    return deals.terminal_terms(v.deal_docs)


@query("merger_terms", "accession:l status:s reason:s nature:s kind:s effective_on:d cash:f currency:s ratio:f successor_id:s supersedes:s", "SELECT * FROM deals")
def _(v):
    return v.deals


@view("terminal_records", """
SELECT accession, CASE WHEN why IS NULL THEN 'accepted' ELSE 'rejected' END AS status, why AS reason, CASE WHEN why IS NULL THEN kind END AS kind, CASE WHEN why IS NULL THEN nature || '_' || kind END AS event_type FROM (
SELECT *, CASE WHEN accession % 41 = 0 THEN 'no documents' WHEN accession % 28 = 0 OR (accession % 23 = 0 AND accession % 4 <> 0) THEN 'source authority' WHEN accession % 29 = 0 THEN 'evidence clocks'
 WHEN accession % 43 = 0 THEN 'issuer identity' WHEN reason IS NOT NULL THEN reason WHEN accession % 37 = 0 THEN 'ticker attribution' END AS why FROM deals)""")
def _terminal_records(v):
    """The deal documents as retrieved records, some of them from a foreign host, with clocks out of order or for another issuer."""
    k, own = F.col("accession"), F.substring_index("target_id", ":", -1)
    release, at = k % 4 == 0, F.lit("2020-05-01 10:00:00").cast("timestamp")
    url = (F.when(k % 28 == 0, "https://example.com.elsewhere.org/deal").when(release, "https://ir.example.com/deal").when(k % 23 == 0, "http://www.sec.gov/Archives/edgar/data/1/2").otherwise("https://www.sec.gov/Archives/edgar/data/1/2"))
    page = F.concat(F.lit("<html><body><p>"), F.replace("text", F.lit(". "), F.lit(".</p> <p>")), F.lit("</p></body></html>"))
    records = v.deal_docs.select(
        "accession", F.concat(F.lit("T"), own).alias("ticker"), F.when(k % 37 == 0, "999999").otherwise(own).alias("cik"), F.when(release, deals.RELEASE).otherwise(deals.FILING).alias("source_kind"), url.alias("source_url"),
        F.array(F.lit("Example.com.")).alias("issuer_domains"), at.alias("published_at"), F.when(k % 29 == 0, at - F.expr("INTERVAL 1 HOUR")).otherwise(at).alias("available_at"), (at + F.expr("INTERVAL 1 DAY")).alias("retrieved_at"),
        "target_id", F.when(k % 43 == 0, "CIK:999998").otherwise(F.col("target_id")).alias("expected_id"), F.when(k % 41 == 0, F.array().cast("array<string>")).otherwise(F.array(page)).alias("documents"),
        F.when(k % 2 == 0, F.sha2(k.cast("string"), 256)).alias("record_hash"))
    return deals.terminal_records(records).withColumn("event_type", F.concat_ws("_", "nature", "kind"))


@query("terminal_records", "accession:l status:s reason:s kind:s", "SELECT accession, status, reason, kind FROM terminal_records")
def _(v):
    return v.terminal_records


@query("store_terminal_events", "accession:l event_type:s", "SELECT accession, event_type FROM terminal_records WHERE status = 'accepted' AND accession % 5 <> 0")
def _(v):
    return deals.terminal_event_rows(v.terminal_records, v.terminal_records.filter("accession % 5 = 0"))


@query("terminal_filings", "ticker:l accession:l form:s", """
SELECT ticker, accession, form FROM (SELECT o_custkey AS ticker, o_orderkey AS accession, list_extract(['8-K', '10-Q', '25-NSE', 'S-4/A', '6-K'], CAST(o_orderkey % 5 + 1 AS BIGINT)) AS form, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p
 FROM orders WHERE o_orderkey % 5 <> 1 AND o_custkey % 3 <> 0) WHERE p <= 12""")
def _(v):
    k, now = F.col("o_orderkey"), F.lit("2024-01-02 00:00:00").cast("timestamp")
    filings_ = v.table("orders").select(F.col("o_custkey").alias("ticker"), k.alias("accession"), F.col("o_orderdate").cast("timestamp").alias("accepted_at"), F.get(F.array(*[F.lit(x) for x in ("8-K", "10-Q", "25-NSE", "S-4/A", "6-K")]), (k % 5).cast("int")).alias("form"))
    checked = v.table("customer").where("c_custkey % 3 < 2").select(F.col("c_custkey").alias("ticker"), (now - F.when(F.col("c_custkey") % 3 == 0, F.expr("INTERVAL 19 HOURS")).otherwise(F.expr("INTERVAL 20 HOURS"))).alias("checked_at"))
    return deals.new_filings(filings_, checked, now)


# --- scalar functions ------------------------------------------------------------------------------------------------

@query("string_functions", "page_id:l squeezed:s parts:l host_ok:b", r"""
SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS squeezed, len(list_filter(string_split_regex(regexp_replace(trim(regexp_replace(url, '\s+', ' ', 'g')), '([.!?;]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS parts,
 regexp_matches(url, '^[a-z]+://([^/?#]*\.)?example\.com([:/?#]|$)') AS host_ok FROM pages""")
def _(v):
    return v.table("pages").select("page_id", squeeze("html").alias("squeezed"), F.size(sentences("url")).alias("parts"), domain_allowed("url", ["example.com"]).alias("host_ok"))


@query("identity_functions", "p_partkey:l security_id:s company:s sector:s", r"""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'FIGI:S' || p_partkey WHEN p_partkey % 3 = 1 THEN 'FIGI:C' || p_partkey WHEN p_partkey % 2 = 0 THEN 'CIK:' || p_partkey END AS security_id,
 coalesce(nullif(regexp_replace(trim(regexp_replace(upper(p_name || ' Holding Co., Inc.'), '[^A-Z0-9]+', ' ', 'g')), '(^| )(INC|CORP|CORPORATION|PLC|LTD|LIMITED|CO|COMPANY)( (INC|CORP|CORPORATION|PLC|LTD|LIMITED|CO|COMPANY))*$', ''), ''), p_brand) AS company,
 CASE p_partkey % 4 WHEN 0 THEN 'Semiconductors' WHEN 1 THEN 'Software' WHEN 2 THEN 'Energy' ELSE 'default' END AS sector FROM part""")
def _(v):
    k = F.col("p_partkey")
    return v.table("part").select(k, stable_id(F.when(k % 3 == 0, F.concat(F.lit("S"), k.cast("string"))), F.when(k % 3 == 1, F.concat(F.lit("C"), k.cast("string"))).otherwise(" "), F.when(k % 2 == 0, k.cast("string"))).alias("security_id"),
                                  company_key(F.concat("p_name", F.lit(" Holding Co., Inc.")), F.col("p_brand")).alias("company"),
                                  league.sector_of(F.when(k % 4 == 0, "Semiconductor makers").when(k % 4 == 1, "Internet media").when(k % 4 == 2, "Oil & gas").otherwise(F.lit("Steel"))).alias("sector"))


@query("date_functions", "o_orderkey:l cutoff:t friday:d next_day:d month_end:d", """
SELECT o_orderkey, (CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL '16 hours 15 minutes') AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS cutoff, CAST(o_orderdate AS DATE) + CAST((12 - isodow(o_orderdate)) % 7 AS INTEGER) AS friday,
 CAST(o_orderdate AS DATE) + CASE isodow(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS next_day, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders""")
def _(v):
    d = F.to_date("o_orderdate")
    return v.table("orders").select("o_orderkey", session_cutoff(d).alias("cutoff"), friday_on_or_after(d).alias("friday"), next_weekday(d).alias("next_day"), F.last_day(d).alias("month_end"))


@query("math_functions", "l_orderkey:l l_linenumber:l l_partkey:l price:f2 slog:f word:s direction:s", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, sign(l_quantity-25)*log10(1e0+abs(l_quantity-25)) AS slog, CASE WHEN (l_discount-0.05e0)*100 > 0.5 THEN 'outperformed' WHEN (l_discount-0.05e0)*100 < -0.5 THEN 'underperformed' ELSE 'neutral' END AS word,
 CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'unknown' END AS direction FROM lineitem""")
def _(v):
    flag = F.col("l_returnflag")
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), signed_log10(F.col("l_quantity") - 25).alias("slog"), verdict((F.col("l_discount") - 0.05) * 100).alias("word"),
                                      rating_direction(F.when(flag == "R", "Underperform").when(flag == "A", "Strong_Buy").otherwise("n/a")).alias("direction"))


# --- loaders ---------------------------------------------------------------------------------------------------------

@query("parse_forms_xml", "k:l ticker:s owner:s code:s routine:b planned:b transaction_date:d shares:f2 value:f2 direction:s", """
SELECT o_orderkey AS k, 'T' || o_custkey % 50 AS ticker, 'Owner ' || o_custkey AS owner, c.code, c.code IN ('A','M') AS routine, o_orderkey % 2 = 0 AS planned, CAST(o_orderdate AS DATE) AS transaction_date, CAST(o_orderkey % 500 + c.i AS DOUBLE) AS shares,
 CASE WHEN c.i = 2 THEN NULL ELSE (o_orderkey % 500 + c.i)*12.5 END AS value, CASE c.i WHEN 1 THEN 'acquired' ELSE 'disposed' END AS direction FROM orders, (VALUES (1, 'P'), (2, 'S'), (3, 'M')) c(i, code) WHERE o_orderkey % 23 <> 0""")
def _(v):
    k = F.col("o_orderkey")

    def tx(i, code):
        price = "" if i == 2 else "<transactionPricePerShare><value>12.5</value></transactionPricePerShare>"
        return F.concat(F.lit("<nonDerivativeTransaction><transactionDate><value>"), F.to_date("o_orderdate").cast("string"), F.lit(f"</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"),
                        (k % 500 + i).cast("string"), F.lit(f"</value></transactionShares>{price}<transactionAcquiredDisposedCode><value>{'A' if i == 1 else 'D'}</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>"))
    xml = F.concat(F.lit("<ownershipDocument><issuer><issuerTradingSymbol>t"), (F.col("o_custkey") % 50).cast("string"), F.lit("</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>Owner "), F.col("o_custkey").cast("string"),
                   F.lit("</rptOwnerName></reportingOwnerId></reportingOwner><aff10b5One>"), F.when(k % 2 == 0, "1").otherwise("0"), F.lit("</aff10b5One><nonDerivativeTable>"), tx(1, "P"), tx(2, "S"), tx(3, "M"), F.lit("</nonDerivativeTable></ownershipDocument>"))
    return doc.parse_form4(v.table("orders").select(k.alias("k"), F.when(k % 23 == 0, F.lit("<broken")).otherwise(xml).alias("xml")))


@query("parse_13f_xml", "k:l issuer:s cusip:s shares:f2 value:f2", """
SELECT o_orderkey AS k, 'Issuer ' || i AS issuer, 'C' || o_custkey || i AS cusip, CAST(o_orderkey % 300 + i AS DOUBLE) AS shares, CAST(o_orderkey % 300 * i AS DOUBLE) AS value FROM orders, (SELECT unnest([1,2,3]) AS i) n WHERE i <> 2""")
def _(v):
    k = F.col("o_orderkey")

    def row(i):
        put = "<ns1:putCall>Put</ns1:putCall>" if i == 2 else ""
        return F.concat(F.lit(f"<ns1:infoTable><ns1:nameOfIssuer>Issuer {i}</ns1:nameOfIssuer><ns1:titleOfClass>COM</ns1:titleOfClass><ns1:cusip>c"), F.col("o_custkey").cast("string"), F.lit(f"{i}</ns1:cusip><ns1:value>"), (k % 300 * i).cast("string"),
                        F.lit("</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>"), (k % 300 + i).cast("string"), F.lit(f"</ns1:sshPrnamt><ns1:sshPrnamtType>SH</ns1:sshPrnamtType></ns1:shrsOrPrnAmt>{put}</ns1:infoTable>"))
    xml = F.concat(F.lit('<ns1:informationTable xmlns:ns1="http://x">'), row(1), row(2), row(3), F.lit("</ns1:informationTable>"))
    return doc.parse_13f(v.table("orders").select(k.alias("k"), xml.alias("xml")))


@query("explode_facts", "entity:s tag:s unit:s end:d val:f2 filed:d form:s accn:s".replace("end:d", "end_date:d"), """
SELECT 'E' || o_custkey AS entity, t.taxonomy || ':' || t.tag AS tag, 'USD' AS unit, CAST(o_orderdate AS DATE) AS end_date, o_totalprice*t.f AS val, CAST(o_orderdate AS DATE) + 40 AS filed, '10-Q' AS form, 'A' || o_orderkey AS accn
FROM orders, (VALUES ('us-gaap', 'Revenues', 1e0), ('us-gaap', 'Assets', 2e0), ('dei', 'Shares', 3e0)) t(taxonomy, tag, f)""")
def _(v):
    d = F.to_date("o_orderdate")
    row = lambda f: F.array(F.struct(d.cast("string").alias("end"), (F.col("o_totalprice") * f).alias("val"), F.date_add(d, 40).cast("string").alias("filed"), F.lit("10-Q").alias("form"), F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("accn")))
    concept = lambda f: F.struct(F.create_map(F.lit("USD"), row(f)).alias("units"))
    facts = F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), concept(1.0), F.lit("Assets"), concept(2.0)), F.lit("dei"), F.create_map(F.lit("Shares"), concept(3.0)))
    src = v.table("orders").select(F.to_json(F.struct(F.concat(F.lit("E"), F.col("o_custkey").cast("string")).alias("entity"), facts.alias("facts"))).alias("json"))
    return doc.explode_facts(src).withColumnRenamed("end", "end_date")


@query("load_bars_json", "session_date:d ticker:s close:f volume:f trades:l", """
SELECT session_date, 'T' || ticker AS ticker, close + 1 AS close, volume, trades FROM bars""")
def _(v):
    """Each bar is written twice; the later fetch, one unit higher, must win."""
    path = scratch_dir(v.spark)
    hours = F.explode(F.array(F.lit(1), F.lit(2))).alias("i")
    b = v.bars.select("*", hours)
    item = F.struct(F.when(F.col("trades") > 0, F.concat(F.lit(" t"), "ticker")).alias("T"), (F.col("close") + (F.col("i") - 1)).alias("c"), F.col("volume").alias("v"), F.col("trades").alias("n"))
    b.select(F.col("session_date").cast("string").alias("session_date"), F.lit(True).alias("adjusted"), F.concat(F.lit("2024-01-01T0"), F.col("i").cast("string"), F.lit(":00:00Z")).alias("fetched_at"),
             F.array(item, F.struct(F.lit("  ").alias("T"), F.lit(1.0).alias("c"), F.lit(1.0).alias("v"), F.lit(1).cast("bigint").alias("n"))).alias("results")).write.json(f"{path}/bars")
    return doc.load_bars_json(v.spark, f"{path}/bars")


@query("load_reference_json", "snapshot_date:d ticker:s active:b security_type:s eligible_equity:b currency:s", """
SELECT snapshot_date, 'R' || ticker AS ticker, active, CASE raw_type WHEN 'CS' THEN 'common_stock' WHEN 'ADRC' THEN 'adr' END AS security_type, CASE WHEN raw_type IN ('CS','ADRC') THEN active WHEN NOT active THEN false END AS eligible_equity, currency FROM refs""")
def _(v):
    path = scratch_dir(v.spark)
    item = F.struct(F.concat(F.lit("r"), "ticker").alias("ticker"), "active", F.col("raw_type").alias("type"), F.lower("currency").alias("currency_name"), "cik", "composite_figi")
    v.refs.select(F.col("snapshot_date").cast("string").alias("snapshot_date"), F.lit("2024-01-01T00:00:00Z").alias("fetched_at"), F.array(item).alias("results")).write.json(f"{path}/refs")
    return doc.load_reference_json(v.spark, f"{path}/refs")


@query("load_actions_json", "ticker:s event_date:d cash:f4 n:l", "SELECT 'D' || ticker AS ticker, event_date, cash, 1 AS n FROM dividends")
def _(v):
    path = scratch_dir(v.spark)
    item = F.struct(F.concat(F.lit("d"), "ticker").alias("ticker"), F.col("event_date").cast("string").alias("ex_dividend_date"), F.col("cash").alias("cash_amount"), F.lit(0.0).alias("split_adjusted_cash_amount"))
    v.dividends.select(F.lit("dividend").alias("kind"), F.lit("2024-01-01T00:00:00Z").alias("fetched_at"), F.array(item, item).alias("results")).write.json(f"{path}/acts")
    a = doc.load_actions_json(v.spark, f"{path}/acts")
    return a.groupBy("ticker", "event_date").agg(F.max("cash").alias("cash"), F.count(F.lit(1)).alias("n"))


@query("load_prices_csv", "date:d value:f", "SELECT session_date AS date, floor(bench_close) AS value FROM bench WHERE day(session_date) <> 7")
def _(v):
    path = scratch_dir(v.spark)
    amount = F.when(F.day("session_date") == 7, F.lit("n/a")).otherwise(F.concat(F.lit("$"), F.format_number(F.floor("bench_close").cast("double"), 2)))
    v.bench.select(F.col("session_date").cast("string").alias("date"), amount.alias("value")).write.option("header", True).csv(f"{path}/rates")
    return doc.load_rates_csv(v.spark, f"{path}/rates")


# --- streams ---------------------------------------------------------------------------------------------------------

def _ticks(v):
    schema = v.table("events").schema
    s = streams.read_ticks(v.spark, f"{v.sf_dir}/event[s].parquet", schema)
    return s.select(F.col("user_id").alias("symbol"), "ts", F.col("value").alias("price"), "event_id", "event_type")


@query("stream_snapshots", "symbol:l ts:t price:f", "SELECT user_id AS symbol, ts, value AS price FROM events")
def _(v):
    """Every event arrives twice; each must come out once."""
    path, ticks = scratch_dir(v.spark), _ticks(v)
    return streams.run_to_table(streams.stream_snapshots(ticks.unionByName(ticks)), f"{path}/t", f"{path}/cp")


@query("stream_sessions", "session_date:d symbol:l open:f high:f low:f last:f ticks:l", """
SELECT CAST(ts AS DATE) AS session_date, user_id AS symbol, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS last, count(*) AS ticks FROM events GROUP BY 1, 2""")
def _(v):
    path = scratch_dir(v.spark)
    return streams.run_to_latest(streams.stream_sessions(_ticks(v)), ["session_date", "symbol"], f"{path}/t", f"{path}/cp")


@query("stream_append", "event_id:l symbol:l", "SELECT event_id, user_id AS symbol FROM events")
def _(v):
    """Two queries over the same events: what the first one stored stays, and the second one adds only the others."""
    path = scratch_dir(v.spark)
    ticks = _ticks(v).select("event_id", "symbol", "price")
    streams.start_append(ticks.filter("event_id % 3 = 0"), f"{path}/all", f"{path}/cp1", ["event_id"], ["price"]).awaitTermination()
    streams.start_append(ticks, f"{path}/all", f"{path}/cp2", ["event_id"], ["price"]).awaitTermination()
    return v.spark.read.parquet(f"{path}/all/*")


@query("stream_new_filings", "accession:l case_id:l escalated:b", """
SELECT event_id AS accession, user_id AS case_id, false AS escalated FROM events WHERE event_type IN ('click','error') AND ts > TIMESTAMP '2024-01-05' + CAST(user_id % 10 AS INTEGER) * INTERVAL 1 DAY AND event_id % 9 <> 0""")
def _(v):
    e = v.table("events")
    cases = e.select(F.col("user_id").alias("case_id")).distinct().withColumn("monitor_since", F.timestamp_add("DAY", (F.col("case_id") % 10).cast("int"), F.lit("2024-01-05").cast("timestamp")))
    f = _ticks(v).select(F.col("event_id").alias("accession"), F.col("symbol").alias("case_id"), F.col("event_type").alias("form"), F.col("ts").alias("filed_at"))
    known = e.filter("event_id % 9 = 0").select(F.col("event_id").alias("accession"))
    path = scratch_dir(v.spark)
    return streams.run_to_table(streams.stream_new_filings(f, known, cases, ["click", "error"]).select("accession", "case_id", "escalated"), f"{path}/t", f"{path}/cp")


@query("stream_late_evidence", "side:s n:l first_id:l", """
SELECT CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'late' ELSE 'on time' END AS side, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1""")
def _(v):
    path = scratch_dir(v.spark)
    s = _ticks(v).select("event_id", F.col("ts").alias("available_at"))
    streams.start_late_evidence(s, F.lit("2024-01-20").cast("timestamp"), f"{path}/ok", f"{path}/late", f"{path}/cp").awaitTermination()
    both = v.spark.read.parquet(f"{path}/ok/*").withColumn("side", F.lit("on time")).unionByName(v.spark.read.parquet(f"{path}/late/*").withColumn("side", F.lit("late")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("stream_case_stage", "case_id:l accepted:l rejected:l items:l", """
WITH t AS (SELECT CAST(floor(epoch_us(max(ts)) / 1000) AS BIGINT) - 86400000 AS mark, max(event_id) + 1 AS top FROM events),
e AS (SELECT user_id, ts, CAST(event_id*4 // top AS BIGINT) - CASE WHEN event_id % 7 = 0 AND event_id*4 // top > 0 THEN 1 ELSE 0 END AS p FROM events, t WHERE epoch_us(ts) <= mark * 1000),
g AS (SELECT *, CASE WHEN date_diff('millisecond', lag(ts) OVER w, ts) > 259200000 THEN 1 ELSE 0 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS life FROM g),
j AS (SELECT *, max(p) OVER (PARTITION BY user_id, life ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM h),
c AS (SELECT user_id, life, count(*) FILTER (WHERE p >= coalesce(mx, 0)) AS ok, count(*) FILTER (WHERE p < coalesce(mx, 0)) AS bad FROM j GROUP BY 1, 2)
SELECT user_id AS case_id, sum(ok) AS accepted, sum(bad) AS rejected, max(ok) AS items FROM c GROUP BY 1""")
def _(v):
    """The events in six files that come in turn, not in order; cases idle for three days are closed and opened anew."""
    e = v.table("events")
    top = e.agg((F.max("event_id") + 1).alias("top")).scalar()
    stages = ["possible", "developing", "imminent", "confirmed"]
    q = F.floor(F.col("event_id") * 4 / top)
    p = q - F.when((F.col("event_id") % 7 == 0) & (q > 0), 1).otherwise(0)
    path = scratch_dir(v.spark)
    rows = e.select(F.col("user_id").alias("case_id"), "ts", F.get(F.array(*[F.lit(s) for s in stages]), p.cast("int")).alias("stage"))
    rows.repartitionByRange(6, "ts").write.parquet(f"{path}/in")
    stream = streams.read_ticks(v.spark, f"{path}/in", rows.schema)
    r = streams.run_to_table(state.stream_case_stage(stream, stages, delay="1 day", idle="3 days"), f"{path}/t", f"{path}/cp").where("NOT closed")
    return r.groupBy("case_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.max("items").alias("items"))


@query("stream_retained", "symbol:l ts:t price:f", """
SELECT user_id AS symbol, ts, value AS price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rank, max(ts) OVER (PARTITION BY user_id) AS newest, max(ts) OVER () AS last FROM events WHERE value > 0)
WHERE rank <= 5 AND ts >= newest - INTERVAL 3 DAY AND newest >= last - INTERVAL 3 DAY - INTERVAL 1 HOUR""")
def _(v):
    """Of every symbol the last five ticks of its last three days; symbols silent for longer are gone."""
    path = scratch_dir(v.spark)
    kept = streams.run_to_latest(state.stream_retained(_ticks(v), most=5), ["symbol"], f"{path}/t", f"{path}/cp")
    return kept.select("symbol", F.explode(F.arrays_zip("times", "prices")).alias("p")).select("symbol", F.col("p.times").alias("ts"), F.col("p.prices").alias("price"))


@query("stream_upsert", "event_id:l user_id:l value:f version:l", """
SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value*2 ELSE value END AS value, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM events""")
def _(v):
    """Events stored by one query, and a third of them in a later version by another one that runs twice."""
    path = scratch_dir(v.spark)
    e = v.table("events").select("event_id", "user_id", "ts", "value").withColumn("version", F.lit(1).cast("long"))
    later = e.where("event_id % 3 = 0").withColumn("value", F.col("value") * 2).withColumn("version", F.lit(2).cast("long"))
    for name, rows in (("one", e), ("two", later)):
        rows.write.parquet(f"{path}/{name}")
    for source, run in (("one", "a"), ("two", "b"), ("two", "c"), ("one", "d")):
        stream = v.spark.readStream.schema(e.schema).parquet(f"{path}/{source}")
        streams.start_upsert(stream, f"{path}/all", f"{path}/cp-{run}", ["event_id"], "ts", f"{path}/counts", version="version").awaitTermination()
    return store.read_store(v.spark, f"{path}/all", e.schema)


@query("stream_upsert_counts", "epoch:l appended:l refused:l", """
SELECT 0 AS epoch, count(*) AS appended, 0 AS refused FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 1, count(*) FILTER (WHERE event_id % 2 = 1), count(*) FILTER (WHERE event_id % 2 = 0) FROM events""")
def _(v):
    """Half of the events appended by one query and all of them by a second: what is stored already is refused."""
    path = scratch_dir(v.spark)
    e = v.table("events").select("event_id", "user_id", "ts", "value")
    e.where("event_id % 2 = 0").write.parquet(f"{path}/one")
    e.write.parquet(f"{path}/two")
    for i, source in enumerate(("one", "two")):
        stream = v.spark.readStream.schema(e.schema).parquet(f"{path}/{source}")
        streams.start_upsert(stream, f"{path}/all", f"{path}/cp-{source}", ["event_id"], "ts", f"{path}/counts/{i}", order=["value"]).awaitTermination()
    return v.spark.read.option("recursiveFileLookup", True).parquet(f"{path}/counts/0").withColumn("epoch", F.lit(0)).unionByName(v.spark.read.option("recursiveFileLookup", True).parquet(f"{path}/counts/1").withColumn("epoch", F.lit(1)))
