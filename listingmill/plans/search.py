"""Search: facets, text, order in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from listingmill.operators.browse import Facets, faceted_filter, sort_exhibitions, text_search


def search(
    catalogue: DataFrame,
    facets: Facets = Facets(),
    query: str = "",
    order: str = "recommended",
    here: tuple[float, float] | None = None,
) -> DataFrame:
    return sort_exhibitions(text_search(faceted_filter(catalogue, facets), query), order, here)
