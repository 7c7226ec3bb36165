"""Sources, sinks and the content-addressed store."""

from tidemark.sources.artifacts import Store
from tidemark.sources.files import read_documents, read_json, read_wav, sniff, unzipped, write_html, write_json, zipped
from tidemark.sources.models import ordered_map, rules_backend, with_model

__all__ = ["Store", "ordered_map", "read_documents", "read_json", "read_wav", "rules_backend", "sniff", "unzipped", "with_model", "write_html", "write_json", "zipped"]
