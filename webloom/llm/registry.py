"""All queries of this subpackage; modules are added here."""

from webloom.llm import document_queries, page_queries, record_queries, text_queries, vector_queries

MODULES = [document_queries, page_queries, record_queries, text_queries, vector_queries]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
