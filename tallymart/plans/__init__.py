"""The queries of the library. Importing them registers them."""

from . import baskets, catalog, details, exchange, extraction, history, matching, normalise, pages, phrases, rebuild, reports, searches, streams, streams_keyed, streams_offers, tables, text_sets  # noqa: F401
