"""sitesift: schema-driven web-record extraction and market analytics on Spark.

Every public function takes and returns DataFrames (or Columns). The data work
runs in executors: native Spark expressions wherever possible, Arrow-batched
``mapInPandas`` only where HTML has to be parsed.

Main entry points::

    from sitesift import (load_site_schema, resolve_site, extract_records,
                          soft_validate_sites, to_silver, publish_silver,
                          run_crawl, market_brief, ship_package)
"""

__version__ = "0.1.0"

_EXPORTS = {
    "load_site_schema": "sources.site_schema",
    "site_schema_df": "sources.site_schema",
    "resolve_site": "operators.resolve",
    "extract_records": "operators.route",
    "extract_html": "operators.extract_html",
    "extract_links": "operators.extract_html",
    "extract_json": "operators.extract_json",
    "extract_rss": "operators.extract_xml",
    "soft_validate": "operators.validate",
    "soft_validate_sites": "operators.validate",
    "required_keys": "operators.validate",
    "dedup_first": "operators.merge",
    "dedup_newest": "operators.merge",
    "merge_history": "operators.merge",
    "to_silver": "plans.silver_flow",
    "publish_silver": "plans.silver_flow",
    "run_crawl": "plans.run",
    "crawl_run": "plans.crawl",
    "market_brief": "operators.analytics",
    "write_brief": "operators.analytics",
    "ship_package": "session",
}


def __getattr__(name):  # lazy, so importing the package does not import pyspark eagerly
    if name in _EXPORTS:
        import importlib
        return getattr(importlib.import_module(f".{_EXPORTS[name]}", __name__), name)
    raise AttributeError(name)


__all__ = sorted(_EXPORTS)
