"""Record schemas of the stages. Names and types."""

from __future__ import annotations

_DATES = "issue_date string, publish_date string, submission_date string"
_COUNTS = "total_page_count int, text_page_count int, pdf_size_bytes long, pdf_sha256 string, text_character_count int, pages array<string>, text string"
METADATA = f"ada string, protocol_number string, subject string, {_DATES}, organization_id string, unit_ids array<string>, signer_ids array<string>, decision_type_id string, thematic_category_ids array<string>, status string, private_data boolean, version_id string, document_url string, api_url string, source string"
REJECTED = "reason string, ada string, raw_date string, organization_id string, subject string"
DATASET = f"{METADATA}, {_COUNTS}"
FAILED = "ada string, subject string, issue_date string, document_url string, reason string, error string, source string"
QUALITY = "ada string, subject string, status string, text_length int, letter_ratio double, word_count int, corrupted_accent_count int, symbol_ratio double, reasons array<string>"
REPAIRED = f"{DATASET}, extraction_method string, repaired boolean"
EXTERNAL = f"ada string, source_id string, subject string, document_title string, organization string, source string, document_url string, issue_date string, organization_id string, decision_type_id string, {_COUNTS}"
CORPUS = f"{REPAIRED}, source_id string, document_title string, organization string"
CHUNK = "page_content string, chunk_id long, ada string, source_id string, subject string, document_title string, issue_date string, organization_id string, organization string, decision_type_id string, document_url string, source string"
CASE = "question string, expected_answer string, expected_adas array<string>, expected_source_ids array<string>, category string, answerable boolean"
