"""All core queries; modules are added here."""

from webloom.plans import analysis_queries, corpus_queries, page_queries, url_queries

MODULES = [corpus_queries, url_queries, analysis_queries, page_queries]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
