"""Filing indexes and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Item numbers of the current report and what they announce.
ITEM_MEANINGS = {
    "1.01": "Material agreement entered",
    "1.02": "Material agreement terminated",
    "1.03": "Bankruptcy or receivership",
    "2.01": "Assets acquired or disposed",
    "2.02": "Results of operations",
    "2.03": "Material financial obligation",
    "2.04": "Obligation accelerated",
    "2.05": "Costs from exit or disposal",
    "2.06": "Material impairment",
    "3.01": "Delisting or listing-rule failure",
    "3.02": "Unregistered equity sale",
    "4.01": "Auditor changed",
    "4.02": "Prior statements not reliable",
    "5.01": "Change in control",
    "5.02": "Director or officer change",
    "5.07": "Shareholder vote results",
    "7.01": "Regulation FD disclosure",
    "8.01": "Other material event",
    "9.01": "Financial statements and exhibits",
}
ROUTINE_ITEMS = ("9.01", "5.07")
GUIDANCE_FORMS, GUIDANCE_ITEMS = ("8-K", "6-K"), ("2.02", "7.01", "8.01")


def explode_filings(index: DataFrame, forms: list[str], key: str, arrays: list[str], form="form") -> DataFrame:
    """One row per filing from parallel arrays; only the wanted forms survive."""
    rows = index.select(key, F.explode(F.arrays_zip(*[F.col(a) for a in arrays])).alias("f")).select(key, "f.*")
    return rows.filter(F.col(form).isin(*forms))


def filing_items(filings: DataFrame, items="items") -> DataFrame:
    """One row per item code with its meaning. An item is material unless it is one of the routine ones."""
    meaning = F.create_map(*[F.lit(x) for kv in ITEM_MEANINGS.items() for x in kv])
    rows = filings.withColumn("item", F.explode(F.filter(F.transform(F.split(items, ","), lambda x: F.trim(x)), lambda x: x != "")))
    return (rows.withColumn("meaning", F.coalesce(F.try_element_at(meaning, F.col("item")), F.concat(F.lit("Item "), F.col("item"))))
            .withColumn("material", ~F.col("item").isin(*ROUTINE_ITEMS)).withColumn("results", F.col("item") == "2.02"))


def scan_events(events: DataFrame, tickers: list[str] | None = None, results_only: bool = False) -> DataFrame:
    out = events if tickers is None else events.filter(F.col("ticker").isin(tickers))
    return out.filter("event_type = 'results'") if results_only else out


def guidance_documents(filings: DataFrame, documents: DataFrame, cutoff, newest: int = 8, issuer="issuer") -> DataFrame:
    """Text of the newest guidance-bearing filings of each issuer that were accepted by the cutoff."""
    from tidemark.operators.sets import latest_n_per_key
    wanted = F.arrays_overlap(F.transform(F.split("items", ","), lambda x: F.trim(x)), F.array(*[F.lit(i) for i in GUIDANCE_ITEMS]))
    rows = filings.filter(F.col("form").isin(*GUIDANCE_FORMS) & wanted & (F.col("accepted_at") <= cutoff))
    rows = latest_n_per_key(rows, [issuer], [F.desc("accepted_at"), F.desc("accession")], newest)
    return rows.join(documents, "accession")
