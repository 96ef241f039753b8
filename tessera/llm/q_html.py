"""Query over ``pages``: main text."""

from __future__ import annotations

from tessera.llm.common import read
from tessera.llm.html_extract import extract
from tessera.llm.registry import register


@register("op5_html")
def op5_html(spark, sf_dir):
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages"), ["page_id", "url"])
