"""Page queries over the test tables; visible text is tested by example, as SQL has no HTML parser."""

from __future__ import annotations

from tallyloom.operators import pages as op

_PAGES = lambda s, d: s.read.parquet(f"{d}/pages.parquet")

QUERIES = {
    "extract_page_meta": lambda s, d: op.extract_page_meta(_PAGES(s, d)).select("page_id", "page_title", "image_url"),
    "clean_visible_text": lambda s, d: op.clean_visible_text(_PAGES(s, d).select("page_id", "html")),
}

ORACLE_SQL = {
    "extract_page_meta": r"""select page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as page_title, cast(null as varchar) as image_url from pages""",
}
