"""Job documents, their compilation into DataFrame plans, reports, tools and the query catalogue."""
