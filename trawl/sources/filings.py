"""Finding and fetching a company's latest annual report."""

import time

from pyspark.sql import DataFrame, functions as F

from trawl.operators.html import html_to_text, item_slices, target_sections
from trawl.sources.readers import SUBMISSIONS_SCHEMA, TICKERS_SCHEMA

ARCHIVE = "https://www.sec.gov/Archives/edgar/data"


def ticker_map(files: DataFrame) -> DataFrame:
    """Rows of idx, cik_str, ticker, title from the JSON ticker file (value)."""
    return files.select(
        F.explode(F.from_json("value", TICKERS_SCHEMA)).alias("idx", "entry")
    ).select(F.col("idx").cast("int").alias("idx"), "entry.*")


def resolve_tickers(wanted: DataFrame, mapping: DataFrame) -> DataFrame:
    """ticker, cik padded to ten digits, company_name; an unknown ticker fails
    the job. Of entries with the same ticker the last one counts."""
    latest = mapping.groupBy("ticker").agg(
        F.max_by(F.struct("cik_str", "title"), "idx").alias("entry")
    )
    cik = F.col("entry.cik_str").cast("string")
    padded = F.when(F.length(cik) < 10, F.lpad(cik, 10, "0")).otherwise(cik)
    missing = F.raise_error(F.concat(F.lit("unknown ticker: "), "ticker")).cast("string")
    return (
        wanted.select(F.upper("ticker").alias("ticker"))
        .join(latest, "ticker", "left")
        .select(
            "ticker",
            F.when(F.col("entry").isNull(), missing).otherwise(padded).alias("cik"),
            F.col("entry.title").alias("company_name"),
        )
    )


def submissions(files: DataFrame) -> DataFrame:
    """The parallel arrays of a submissions file as rows, newest first:
    cik, position, form, accession_number, primary_doc, filing_date."""
    recent = F.from_json("value", SUBMISSIONS_SCHEMA).getField("filings").getField("recent")
    rows = files.select("cik", recent.alias("r")).select(
        "cik",
        F.posexplode(
            F.arrays_zip(
                F.col("r.form").alias("form"),
                F.col("r.accessionNumber").alias("accession_number"),
                F.col("r.primaryDocument").alias("primary_doc"),
                F.col("r.filingDate").alias("filing_date"),
            )
        ).alias("position", "f"),
    )
    return rows.select("cik", "position", "f.*")


def latest_annual_report(companies: DataFrame, filed: DataFrame) -> DataFrame:
    """The first filing of exactly form 10-K per company, with its address.

    A company without one fails the job.
    """
    first = (
        filed.filter(F.col("form") == "10-K")
        .groupBy("cik")
        .agg(
            F.min_by(
                F.struct("accession_number", "primary_doc", "filing_date"), "position"
            ).alias("f")
        )
    )
    joined = companies.join(first, "cik", "left")
    missing = F.raise_error(F.concat(F.lit("no 10-K found for "), "ticker")).cast("string")
    return joined.select(
        "ticker",
        "cik",
        "company_name",
        F.lit("10-K").alias("filing_type"),
        "f.filing_date",
        F.when(F.col("f").isNull(), missing)
        .otherwise(F.col("f.accession_number"))
        .alias("accession_number"),
        "f.primary_doc",
        F.concat_ws(
            "/",
            F.lit(ARCHIVE),
            F.col("cik").cast("bigint").cast("string"),
            F.replace("f.accession_number", F.lit("-"), F.lit("")),
            "f.primary_doc",
        ).alias("source_url"),
    )


def fetch_pages(missing: DataFrame, settings) -> DataFrame:
    """Download pages that the cache lacks, politely.

    One partition, because the site's request limit is for the whole job; the
    list is one row per company, never the corpus.
    """
    if not settings.user_agent or "your_email" in settings.user_agent:
        raise ValueError("set a user agent that names you before fetching")

    def fetch(batches):
        import requests

        last = 0.0
        for pdf in batches:
            pages = []
            for url in pdf["source_url"]:
                time.sleep(max(0.0, last + settings.fetch_delay - time.monotonic()))
                last = time.monotonic()
                reply = requests.get(
                    url,
                    headers={"User-Agent": settings.user_agent},
                    timeout=settings.fetch_timeout,
                )
                reply.raise_for_status()
                pages.append(reply.text)
            yield pdf.assign(html=pages)

    schema = missing.select("accession_number", "source_url").schema.add("html", "string")
    return missing.select("accession_number", "source_url").coalesce(1).mapInPandas(fetch, schema)


def cache_misses(reports: DataFrame, cached: DataFrame) -> DataFrame:
    return reports.join(cached, "accession_number", "left_anti")


def parse_filings(pages: DataFrame, settings) -> DataFrame:
    """Add sections to pages with html; other columns are carried along."""
    return (
        pages.withColumn("clean", html_to_text(F.col("html")))
        .drop("html")
        .withColumn("slices", item_slices(F.col("clean")))
        .drop("clean")
        .withColumn("sections", target_sections(F.col("slices"), settings.section_min_chars))
        .drop("slices")
    )
