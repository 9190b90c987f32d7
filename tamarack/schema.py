"""Schemas of the tables the engine reads and of the package record all sources end in."""

from __future__ import annotations

# column -> the field's usual key in extraction output
RECORD_FIELDS = {
    "package_name": "Package Name",
    "package_manager": "Package Manager",
    "version": "Version",
    "discovery_date": "Date of Discovery",
    "repository_url": "Repository URL",
    "attack_method": "Method of Attack",
    "discoverer": "Discoverer",
    "impacted_systems": "Impacted Systems",
    "attack_vector": "Attack Vector",
    "iocs": "Indicators of Compromise",
}

PACKAGES = (
    "package_name string, package_manager string, version array<string>, discovery_date array<string>, repository_url array<string>, attack_method array<string>, discoverer array<string>, "
    "impacted_systems array<string>, attack_vector array<string>, iocs array<string>, source string, model string, prompt string, file_timestamp string, post_date string, source_link string, ingest_seq long"
)
LINKS = "timestamp string, source string, date string, link string"
SEARCH_RESULTS = "manager string, package string, result_index string, title string, link string, display_link string, snippet string, date string, links string"
ADVISORY_LINKS = "manager string, package string, advisory_url string, ref_index string, ref_name string, first_url string, second_urls string"
OSV = "published string, affected array<struct<package: struct<name: string>>>"
REGISTRY = "name string, version string, upload_time string"
