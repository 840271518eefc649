"""Schemas of the tables, as DDL; readers never infer them."""

from __future__ import annotations

HIT = "array<struct<vendor: string, category: string, identifier: string, evidence_type: string, evidence_snippet: string, confidence: double>>"
SNAPSHOT = (
    "run_id string, url_id long, url string, kind string, final_url string, initial_status_code int, final_status_code int, fetched_at long, title string, meta_description string, h1_tags string, h2_tags string, word_count int, html_lang string, "
    "content_length long, content_hash_sha256 string, content_hash_simhash long, html_meta_allows boolean, http_header_allows boolean, overall_indexable boolean, challenge string, skip_reason string, ttfb_seconds double, total_duration_seconds double, "
    f"lcp_ms double, cls double, inp_ms double, canonical_urls array<string>, hreflang array<struct<hreflang: string, href: string, source: string>>, links array<struct<href: string, anchor_text: string, xpath: string>>, analytics {HIT}, amphtml_url string, variant_kind string"
)
LINKS = "array<struct<href: string, anchor_text: string, xpath: string, is_image: boolean, fragment: string, url_parameters: string, original_href: string>>"
RESULT = (
    "requested_url string, final_url string, status int, headers map<string, string>, content_type string, fetch_backend string, raw_html string, content_hash_sha256 string, content_hash_simhash decimal(20, 0), "
    f"discovered_links {LINKS}, allowed_by_robots boolean, skip_reason string, persist_error string, challenge string, ttfb_seconds double, total_duration_seconds double, lcp_ms double, cls double, inp_ms double, "
    f"redirect_chain array<struct<url: string, status: int>>, custom_data string, detected_cms struct<cms_name: string, confidence: double, indicators: array<string>>, detected_analytics {HIT}, "
    "extracted struct<title: string, meta_description: string, meta_robots: array<string>, x_robots_tag: array<string>, canonical: string, x_canonical: string, hreflang_links: array<struct<hreflang: string, href: string, source: string>>, "
    "html_lang: string, headings: map<string, array<string>>, text: string, word_count: int, metadata: string, schema_data: array<struct<format: string, type: string, raw_data: string, parsed_data: string, position: string, is_valid: boolean, "
    "validation_errors: array<string>, severity: string, content_hash: string>>>"
)
FRONTIER = "run_id string, url_id long, url string, parent_id long, depth int, priority_score double, event string, at timestamp"
