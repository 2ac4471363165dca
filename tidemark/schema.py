"""Schemas of the stored tables."""

from __future__ import annotations

# The sources that a listing may come from.
SOURCES = ("olx", "pakwheels", "zameen")

LISTINGS = (
    "id long, source string, source_listing_id string, fingerprint string, city string, area string, category string, "
    "title string, description string, price double, price_currency string, price_raw string, phone string, seller_name string, "
    "ad_date date, url string, url_canonical string, first_seen_at timestamp, last_seen_at timestamp, scraped_at timestamp"
)
RUNS = "id long, started_at timestamp, finished_at timestamp, sources string, cities string, inserted long, updated long, skipped long, errors long, notes string"
REJECTS = "source string, url string, reasons string, payload string, rejected_at timestamp"
CAPTURES = "url string, status int, text string, fetched_at timestamp"
OUTCOMES = "city string, source string, category string, status string, reason string, search_url string, matched string, pages_read long, listings long, foreign_ads long, out_of_window long, page_budget long, dated boolean, budget_spent boolean"
LOCATIONS = "source string, name string, identifier string, province string, level string, pos long"

#: Columns of a record as a collector hands it over.
RECORD = (
    "source string, source_listing_id string, city string, area string, category string, title string, description string, "
    "price decimal(38,6), price_currency string, price_raw string, phone string, seller_name string, ad_date date, url string, located_in array<string>"
)
