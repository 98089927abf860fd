"""Column functions: native Spark expressions only (no Python per row)."""

from .urls import (  # noqa: F401
    netloc, strip_query, cache_key, url_hash, page_url_from_pattern,
    page_url_with_param, page_url, storage_label, storage_prefix,
)
from .text import (  # noqa: F401
    strip_ws, collapse_ws, normalize_text, strip_title_number, clean_field,
    money_silver, money_report, decode_entities, words, keep_word,
)
from .jsonpath import json_path, json_path_text  # noqa: F401
