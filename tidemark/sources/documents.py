"""Bulk loaders for JSON, CSV and XML documents. Schemas are explicit; unreadable records yield no rows, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import policy
from tidemark.functions import finite, symbol
from tidemark.operators.events import OPEN_MARKET_BUY, OPEN_MARKET_SELL, ROUTINE_CODES


def explode_positions(reports: DataFrame, key="report_id", positions="positions") -> DataFrame:
    """One row per position of a report, with its ordinal."""
    return reports.select(key, F.posexplode(positions).alias("ordinal", "p")).select(key, "ordinal", "p.*")


# The rows of a grouped-daily file have keys that differ only in case (T and t), so they are read as maps.
_GROUPED = "session_date STRING, adjusted BOOLEAN, fetched_at STRING, raw_sha256 STRING, results ARRAY<MAP<STRING, STRING>>"


def load_bars_json(spark: SparkSession, path: str) -> DataFrame:
    """Grouped-daily files to bars: tickers upper-cased, blank ones dropped, the latest fetch of a key wins."""
    raw = spark.read.schema(_GROUPED).json(path)
    rows = raw.select(F.to_date("session_date").alias("session_date"), "adjusted", F.try_to_timestamp("fetched_at").alias("fetched_at"), "raw_sha256", F.explode("results").alias("r"))

    def at(k):
        return F.try_element_at("r", F.lit(k))
    numbers = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "volume_weighted": "vw"}
    rows = rows.select("session_date", symbol(at("T")).alias("ticker"), *[finite(at(k)).alias(n) for n, k in numbers.items()], at("n").try_cast("bigint").alias("trades"),
                       at("t").try_cast("bigint").alias("window_start_ms"), "adjusted", "fetched_at", "raw_sha256").filter("ticker IS NOT NULL")
    rest = [c for c in rows.columns if c not in ("session_date", "ticker")]
    return rows.groupBy("session_date", "ticker").agg(F.max_by(F.struct(*rest), "fetched_at").alias("b")).select("session_date", "ticker", "b.*")


_REFERENCE = T.StructType([T.StructField("snapshot_date", T.StringType()), T.StructField("fetched_at", T.StringType()), T.StructField("results", T.ArrayType(T.StructType(
    [T.StructField(n, T.StringType()) for n in ("ticker", "name", "market", "locale", "primary_exchange", "type", "currency_name", "cik", "composite_figi", "share_class_figi", "delisted_utc", "last_updated_utc")]
    + [T.StructField("active", T.BooleanType())])))])


def load_reference_json(spark: SparkSession, path: str) -> DataFrame:
    """Identity vintages with the mapped security type and the hint whether it can be eligible equity at all."""
    raw = spark.read.schema(_REFERENCE).json(path)
    r = raw.select(F.to_date("snapshot_date").alias("snapshot_date"), F.try_to_timestamp("fetched_at").alias("fetched_at"), F.explode("results").alias("r")).select("snapshot_date", "fetched_at", "r.*")
    kinds = F.create_map(*[F.lit(x) for kv in policy.SECURITY_TYPES.items() for x in kv])
    r = r.withColumn("ticker", symbol("ticker")).filter("ticker IS NOT NULL").withColumn("currency", F.upper("currency_name")).withColumn("security_type", F.try_element_at(kinds, F.upper("type")))
    r = r.withColumn("eligible_equity", F.col("security_type").isin(*policy.INVESTABLE_TYPES) & F.col("active")).withColumn("delisted_utc", F.try_to_timestamp("delisted_utc"))
    rest = [c for c in r.columns if c not in ("snapshot_date", "ticker", "active")]
    return r.groupBy("snapshot_date", "ticker", "active").agg(F.max_by(F.struct(*rest), "fetched_at").alias("b")).select("snapshot_date", "ticker", "active", "b.*")


_ACTIONS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("fetched_at", T.StringType()), T.StructField("results", T.ArrayType(T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "ticker", "execution_date", "ex_dividend_date")] + [T.StructField(n, T.DoubleType()) for n in ("split_from", "split_to", "cash_amount", "split_adjusted_cash_amount")])))])


def load_actions_json(spark: SparkSession, path: str) -> DataFrame:
    """Splits and dividends; an action without an id is keyed by a hash of its content. A zero adjusted amount is absent."""
    raw = spark.read.schema(_ACTIONS).json(path)
    r = raw.select("kind", F.try_to_timestamp("fetched_at").alias("fetched_at"), F.explode("results").alias("r")).select("kind", "fetched_at", "r.*")
    content = F.sha2(F.concat_ws("\x1f", "kind", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("ticker", "execution_date", "ex_dividend_date", "split_from", "split_to", "cash_amount")]), 256)
    r = (r.withColumn("event_id", F.coalesce(F.nullif("id", F.lit("")), content)).withColumn("ticker", symbol("ticker")).withColumn("event_date", F.to_date(F.coalesce("execution_date", "ex_dividend_date")))
         .withColumn("cash", F.coalesce(F.nullif("split_adjusted_cash_amount", F.lit(0.0)), F.col("cash_amount"))).withColumn("split_ratio", F.col("split_to") / F.nullif("split_from", F.lit(0.0))))
    return r.groupBy("kind", "event_id").agg(F.max_by(F.struct("ticker", "event_date", "cash", "split_ratio", "fetched_at"), "fetched_at").alias("b")).select("kind", "event_id", "b.*")


def load_rates_csv(spark: SparkSession, path: str, date="date", value="value", date_format="yyyy-MM-dd") -> DataFrame:
    """Daily rates or prices from text: currency marks and separators are stripped, only positive values stay."""
    raw = spark.read.option("header", True).schema(f"{date} string, {value} string").csv(path)
    return raw.select(F.to_date(F.try_to_timestamp(F.col(date), F.lit(date_format))).alias("date"), finite(F.regexp_replace(value, "[$,]", "")).alias("value")).filter("date IS NOT NULL AND value > 0")


_FORM4 = """issuer STRUCT<issuerTradingSymbol: STRING>, reportingOwner STRUCT<reportingOwnerId: STRUCT<rptOwnerName: STRING>, reportingOwnerRelationship: STRUCT<isDirector: STRING, isOfficer: STRING, isTenPercentOwner: STRING, officerTitle: STRING>>,
 periodOfReport STRING, aff10b5One STRING, nonDerivativeTable STRUCT<nonDerivativeTransaction: ARRAY<STRUCT<transactionDate: STRUCT<value: STRING>, transactionCoding: STRUCT<transactionCode: STRING>,
 transactionAmounts: STRUCT<transactionShares: STRUCT<value: STRING>, transactionPricePerShare: STRUCT<value: STRING>, transactionAcquiredDisposedCode: STRUCT<value: STRING>>>>>"""


def _flag(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1"), F.lit(False))


def parse_form4(filings: DataFrame, xml="xml", key: list[str] | None = None) -> DataFrame:
    """Ownership filings to transactions with the code that explains them; unreadable XML gives no rows."""
    key = key or [c for c in filings.columns if c != xml]
    d = filings.withColumn("_x", F.from_xml(F.col(xml), _FORM4)).filter(F.col("_x").isNotNull())
    rows = d.select(*key, symbol("_x.issuer.issuerTradingSymbol").alias("ticker"), F.trim("_x.reportingOwner.reportingOwnerId.rptOwnerName").alias("owner"), _flag(F.col("_x.reportingOwner.reportingOwnerRelationship.isDirector")).alias("director"),
                    _flag(F.col("_x.reportingOwner.reportingOwnerRelationship.isOfficer")).alias("officer"), _flag(F.col("_x.aff10b5One")).alias("planned"), F.explode("_x.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    shares, price = finite("t.transactionAmounts.transactionShares.value"), finite("t.transactionAmounts.transactionPricePerShare.value")
    code = F.nullif(F.trim("t.transactionCoding.transactionCode"), F.lit(""))
    meaning = F.create_map(*[F.lit(x) for kv in ROUTINE_CODES.items() for x in kv])
    side = F.upper("t.transactionAmounts.transactionAcquiredDisposedCode.value")
    out = rows.select(*key, "ticker", "owner", "director", "officer", "planned", code.alias("code"), shares.alias("shares"), price.alias("price"), F.to_date("t.transactionDate.value").alias("transaction_date"),
                      F.when(side == "A", "acquired").when(side == "D", "disposed").alias("direction")).filter("code IS NOT NULL AND shares IS NOT NULL")
    return (out.withColumn("routine", F.col("code").isin(*ROUTINE_CODES)).withColumn("value", F.round(F.col("shares") * F.nullif("price", F.lit(0.0)), 2))
            .withColumn("meaning", F.when(F.col("code") == OPEN_MARKET_BUY, "Open-market purchase").when(F.col("code") == OPEN_MARKET_SELL, "Open-market sale").otherwise(F.coalesce(F.try_element_at(meaning, F.col("code")), F.lit("Other transaction")))))


_INFO = "infoTable ARRAY<STRUCT<nameOfIssuer: STRING, titleOfClass: STRING, cusip: STRING, value: STRING, putCall: STRING, shrsOrPrnAmt: STRUCT<sshPrnamt: STRING, sshPrnamtType: STRING>>>"


def parse_13f(filings: DataFrame, xml="xml", key: list[str] | None = None) -> DataFrame:
    """Information tables to long holdings: options, rows without a cusip and rows without shares are left out."""
    key = key or [c for c in filings.columns if c != xml]
    d = filings.withColumn("_x", F.from_xml(F.col(xml), _INFO, {"ignoreNamespace": "true"})).filter(F.col("_x").isNotNull()).select(*key, F.explode("_x.infoTable").alias("h"))
    put = F.coalesce(F.trim("h.putCall"), F.lit(""))
    return d.select(*key, F.trim("h.nameOfIssuer").alias("issuer"), F.trim("h.titleOfClass").alias("class"), symbol("h.cusip").alias("cusip"), finite("h.shrsOrPrnAmt.sshPrnamt").alias("shares"), finite("h.value").alias("value"),
                    put.alias("_put"), F.upper(F.trim("h.shrsOrPrnAmt.sshPrnamtType")).alias("unit")).filter("_put = '' AND cusip IS NOT NULL AND shares > 0 AND value IS NOT NULL").drop("_put")


_FACTS = "entity STRING, facts MAP<STRING, MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<STRUCT<start: STRING, `end`: STRING, val: DOUBLE, filed: STRING, form: STRING, accn: STRING>>>>>>"


def explode_facts(documents: DataFrame, json="json") -> DataFrame:
    """Nested company-facts documents to one row per fact."""
    d = documents.select(F.from_json(json, _FACTS).alias("d")).select("d.entity", F.explode("d.facts").alias("taxonomy", "tags")).select("entity", "taxonomy", F.explode("tags").alias("tag", "c"))
    d = d.select("entity", "taxonomy", "tag", F.explode("c.units").alias("unit", "rows")).select("entity", "taxonomy", "tag", "unit", F.explode("rows").alias("r"))
    return d.select("entity", "taxonomy", F.concat_ws(":", "taxonomy", "tag").alias("tag"), "unit", F.to_date("r.start").alias("start"), F.to_date("r.end").alias("end"), "r.val", F.to_date("r.filed").alias("filed"), "r.form", "r.accn")


def explode_facts_variant(documents: DataFrame, json="json") -> DataFrame:
    """Company facts of any taxonomy, tag and unit, one row per fact, with the fact itself as VARIANT.

    No schema is fixed: what a document says beyond the known fields stays in ``fact`` and is read by path. A document that is no JSON, or a
    level that is no object, gives no rows.
    """
    def level(column, kind, *names):
        return F.explode(F.try_variant_get(column, "$", kind)).alias(*names)
    d = documents.select(F.try_parse_json(json).alias("v"))
    d = d.select(F.try_variant_get("v", "$.entity", "string").alias("entity"), F.explode(F.try_variant_get("v", "$.facts", "map<string,variant>")).alias("taxonomy", "tags"))
    d = d.select("entity", "taxonomy", level("tags", "map<string,variant>", "tag", "body"))
    units = F.explode(F.try_variant_get("body", "$.units", "map<string,variant>")).alias("unit", "rows")
    d = d.select("entity", "taxonomy", "tag", F.try_variant_get("body", "$.label", "string").alias("label"), units)
    return d.select("entity", F.concat_ws(":", "taxonomy", "tag").alias("tag"), "label", "unit", F.explode(F.try_variant_get("rows", "$", "array<variant>")).alias("fact"))


def fact_fields(facts: DataFrame) -> DataFrame:
    """Facts with their usual fields read from the VARIANT; a field of another type is NULL."""
    def field(name, kind):
        return F.try_variant_get("fact", f"$.{name}", kind)
    day = {n: F.to_date(F.try_to_timestamp(field(n, "string"), F.lit("yyyy-MM-dd"))).alias(n) for n in ("start", "end", "filed")}
    return facts.select(*[c for c in facts.columns if c != "fact"], day["start"], day["end"], field("val", "double").alias("val"), day["filed"], field("form", "string").alias("form"), field("accn", "string").alias("accn"), "fact")


def json_schema(documents: DataFrame, json="json", by: list[str] = ()) -> DataFrame:
    """The schema that holds all documents (of a group), by one aggregation."""
    return documents.select(*by, F.try_parse_json(json).alias("v")).groupBy(*by).agg(F.schema_of_variant_agg("v").alias("schema"))
