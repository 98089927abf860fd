"""S6 + X6: the site-schema source.

A site schema is a small, hand-written table: one row per target domain, in
insertion order (``ordinal``). Field rules come in three spellings (a selector
string, a list of selectors, or ``{selector, attribute}``) and are normalised
once, on load, to ``STRUCT<name, selectors ARRAY<STRING>, attribute STRING>``.
``fields`` is an ARRAY, not a MAP: the first field is the primary key.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.html_tree import compile_list, split_selector

FIELD_TYPE = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("selectors", T.ArrayType(T.StringType(), False), False),
    T.StructField("attribute", T.StringType(), True),
])

SITE_SCHEMA_TYPE = T.StructType([
    T.StructField("domain", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("strategy", T.StringType(), False),
    T.StructField("container", T.StringType(), True),
    T.StructField("fields", T.ArrayType(FIELD_TYPE, False), False),
    T.StructField("strip_url_query", T.BooleanType(), True),
    T.StructField("dedup_keys", T.ArrayType(T.StringType(), False), False),
    T.StructField("start_page", T.IntegerType(), False),
    T.StructField("pagination_param", T.StringType(), True),
    T.StructField("pagination_pattern", T.StringType(), True),
])


@dataclass(frozen=True)
class FieldRule:
    name: str
    selectors: tuple[str, ...]
    attribute: str | None = None


@dataclass(frozen=True)
class SiteConfig:
    domain: str
    ordinal: int
    strategy: str = "detail"
    container: str | None = None
    fields: tuple[FieldRule, ...] = field(default_factory=tuple)
    strip_url_query: bool | None = None
    dedup_keys: tuple[str, ...] = field(default_factory=tuple)
    start_page: int = 1
    pagination_param: str | None = "page"
    pagination_pattern: str | None = None

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def primary_key(self) -> str | None:
        return self.fields[0].name if self.fields else None


def normalize_field(name: str, rule: Any) -> FieldRule:
    """Any spelling of a field rule -> its alternatives and attribute.

    A rule is what to select, or a mapping that also names an attribute; what
    to select is one selector text or several. All texts are cut at their
    commas into one list of alternatives, in order. None at all means the
    container itself.
    """
    if isinstance(rule, FieldRule):
        return rule
    spec = rule if isinstance(rule, dict) else {"selector": rule}
    texts = spec.get("selector") or ()
    texts = (texts,) if isinstance(texts, str) else texts
    alternatives = tuple(part for text in texts for part in split_selector(text))
    return FieldRule(name, alternatives, spec.get("attribute") or None)


def site_config(domain: str, cfg: dict, ordinal: int) -> SiteConfig:
    fields = cfg.get("fields") or {}
    if isinstance(fields, dict):
        rules = tuple(normalize_field(k, v) for k, v in fields.items())
    else:  # already a list of {name, selectors, attribute}
        rules = tuple(FieldRule(f["name"], tuple(f.get("selectors") or ()), f.get("attribute"))
                      for f in fields)
    return SiteConfig(
        domain=domain,
        ordinal=ordinal,
        strategy=cfg.get("strategy", "detail"),
        container=cfg.get("container"),
        fields=rules,
        strip_url_query=cfg.get("strip_url_query"),
        dedup_keys=tuple(cfg.get("dedup_keys") or ()),
        start_page=int(cfg.get("start_page", 1)),
        pagination_param=cfg.get("pagination_param", "page"),
        pagination_pattern=cfg.get("pagination_pattern"),
    )


def load_site_schema(source: dict | list | str) -> list[SiteConfig]:
    """Load a schema map: a dict (insertion order is the match order), a list
    of dicts each with ``domain``, a JSON text, or a path to a JSON file."""
    if isinstance(source, str):
        text = source
        if not source.lstrip().startswith(("{", "[")):
            with open(source, encoding="utf-8") as fh:
                text = fh.read()
        source = json.loads(text)
    if isinstance(source, dict):
        items: Iterable = source.items()
    else:
        items = ((d["domain"], d) for d in source)
    configs = [site_config(dom, cfg, i) for i, (dom, cfg) in enumerate(items)]
    for c in configs:
        check_selectors(c)
    return configs


def check_selectors(cfg: SiteConfig) -> None:
    """Reject an unsupported selector when the schema is loaded, not in a
    worker: every container and field selector of an HTML site must compile.
    (JSON paths and feed tags are not selectors.)"""
    if cfg.strategy in ("json", "rss"):
        return
    for text in [*split_selector(cfg.container), *(s for f in cfg.fields for s in f.selectors)]:
        try:
            compile_list(text)
        except ValueError as e:
            raise ValueError(f"{cfg.domain}: {e}") from None


def site_schema_df(spark: SparkSession, configs: list[SiteConfig]) -> DataFrame:
    """The site schema as a small DataFrame with the declared type."""
    rows = [(
        c.domain, c.ordinal, c.strategy, c.container,
        [(f.name, list(f.selectors), f.attribute) for f in c.fields],
        c.strip_url_query, list(c.dedup_keys), c.start_page,
        c.pagination_param, c.pagination_pattern,
    ) for c in configs]
    return spark.createDataFrame(rows, SITE_SCHEMA_TYPE)

