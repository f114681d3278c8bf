"""Terms of deals: what is accepted, what is refused and why, and that the cost follows the text."""

import datetime as dt
import time

from pyspark.sql import functions as F

from tidemark.functions import deals

HEAD = "Issuer SEC CIK: 0001. The merger completed on June 2, 2025. "
CASES = {
    "cash": (HEAD + "Each share was converted into the right to receive USD 1,150.50 in cash per share.", "cash"),
    "dollars": (HEAD + "Holders receive 12 U.S. dollars in cash for each share.", "cash"),
    "stock": ("Target security identifier: CIK:1. The merger became effective 2025-06-02. Each holder receives 0.5 shares of New Co. Class A shares for each share. Acquirer stable security identity is FIGI:bbg1.", "no consideration"),
    "named": (HEAD + "Each holder receives 0.5 shares of New Co common shares for each share. Acquirer stable security identity is FIGI:bbg1.", "stock"),
    "mixed": (HEAD + "Paid 3 EUR per share and 2 shares per share. Surviving company identity: 77.", "mixed"),
    "twice the same": (HEAD + "Paid 3 EUR per share; that is 3 euros for each share.", "cash"),
    "two days": (HEAD + "It was effective on 2025-06-03. Paid 3 EUR per share.", "effective date"),
    "no such day": ("The merger closed on February 31, 2025. Paid 3 EUR per share.", "effective date"),
    "two sums": (HEAD + "Paid 3 EUR per share or 4 EUR per share.", "ambiguous terms"),
    "dollar of no country": (HEAD + "Paid 3 dollars per share.", "no consideration"),
    "no successor": (HEAD + "2 shares for each share.", "stock terms"),
    "other issuer": ("Target identity: CIK:9. " + HEAD + "Paid 3 EUR per share.", "target identity"),
    "delisting": ("The shares were delisted. Effective date: 2025-06-02. Paid 3 CAD per share. It supersedes accession number 0000000001-25-000001.", "cash"),
    "two amended": (HEAD + "Paid 3 EUR per share. Amends 0000000001-25-000001. Amends and supplements accession 0000000001-25-000002.", "ambiguous amendment"),
    "nothing": ("The company completed on June 2, 2025 a sale for 3 EUR per share.", "not a merger or delisting"),
    "missing": (None, "not a merger or delisting"),
}


def test_terms_and_refusals(spark):
    df = spark.createDataFrame([(k, "CIK:0001", t) for k, (t, _) in CASES.items()], "k string, target_id string, text string")
    got = {r.k: r for r in deals.terminal_terms(df).collect()}
    assert {k: r.kind or r.reason for k, r in got.items()} == {k: want for k, (_, want) in CASES.items()}
    assert (got["cash"].cash, got["cash"].currency, got["cash"].effective_on) == (1150.5, "USD", dt.date(2025, 6, 2))
    assert got["named"].successor_id == "FIGI:BBG1" and got["mixed"].successor_id == "CIK:77" and got["mixed"].ratio == 2.0
    assert got["delisting"].nature == "delisting" and got["delisting"].supersedes == "0000000001-25-000001"


RECORD = dict(accession="a1", ticker="AAA", cik="1", source_kind="sec_filing", source_url="https://www.sec.gov/Archives/edgar/data/1/a1/", issuer_domains=["aaa.example"], published_at=dt.datetime(2025, 6, 2),
              available_at=dt.datetime(2025, 6, 2), retrieved_at=dt.datetime(2025, 6, 3), target_id="CIK:1", expected_id="1", documents=["<p>" + HEAD + "</p><p>Paid 3 EUR per share.</p>"], record_hash=None)
SCHEMA = ("accession string, ticker string, cik string, source_kind string, source_url string, issuer_domains array<string>, published_at timestamp, available_at timestamp, retrieved_at timestamp, target_id string, expected_id string, "
          "documents array<string>, record_hash string")


CHANGES = [
    ({}, None), (dict(source_url="http://www.sec.gov/Archives/edgar/data/1/"), "source authority"), (dict(source_url="https://sec.gov.evil.example/Archives/edgar/data/1/"), "source authority"), (dict(source_url=None), "source authority"),
    (dict(source_kind="official_issuer", source_url="https://ir.AAA.example/x"), None), (dict(source_kind="official_issuer", source_url="https://notaaa.example/x"), "source authority"), (dict(source_kind="blog"), "source authority"),
    (dict(source_kind="official_issuer", source_url="https://aaa.example/x", issuer_domains=None), "source authority"), (dict(available_at=dt.datetime(2025, 6, 1)), "evidence clocks"), (dict(retrieved_at=None), "evidence clocks"),
    (dict(accession=" "), "record identity"), (dict(expected_id="CIK:2"), "issuer identity"), (dict(target_id="x", expected_id="x"), "issuer identity"), (dict(cik="2"), "ticker attribution"), (dict(ticker=None), "ticker attribution"),
    (dict(documents=[]), "no documents"), (dict(documents=None), "no documents"), (dict(documents=[None]), "unreadable document"), (dict(documents=["merger"]), "effective date")]


def test_records_need_authority_clocks_and_identity(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [tuple((RECORD | dict(change))[n] for n in names) + (i,) for i, (change, _) in enumerate(CHANGES)]
    got = {r.i: r for r in deals.terminal_records(spark.createDataFrame(rows, SCHEMA + ", i int")).collect()}
    assert {i: r.reason for i, r in got.items()} == {i: want for i, (_, want) in enumerate(CHANGES)}
    assert all((r.status == "accepted") == (r.reason is None) == (r.kind == "cash") for r in got.values())


def test_a_stored_record_is_unchanged_and_a_new_version_is_not(spark):
    rows = [tuple((RECORD | c)[n.split()[0]] for n in SCHEMA.split(", ")) for c in ({}, dict(retrieved_at=dt.datetime(2025, 7, 1)), dict(documents=[RECORD["documents"][0] + " "]))]
    got = deals.terminal_records(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", i int")).cache()
    assert [r.i for r in deals.terminal_event_rows(got.where("i > 0"), got.where("i = 0")).collect()] == [2]


def test_cost_follows_the_text(spark):
    def seconds(n):
        body = "The merger agreement says that shares effective on many dates of USD 7 in cash and issuer security. " * (n // 17)
        df = spark.createDataFrame([(i, "CIK:1", HEAD + body + "Paid 3 EUR per share.") for i in range(8)], "k int, target_id string, text string")
        start = time.perf_counter()
        assert deals.terminal_terms(df).where("kind = 'cash'").agg(F.count("k")).first()[0] == 8
        return time.perf_counter() - start
    seconds(4000)
    assert seconds(64000) < 16 * max(seconds(4000), 1.0)
