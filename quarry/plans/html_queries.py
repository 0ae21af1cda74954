"""Registered HTML queries (rows 7, 75-78 of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import html_jobs
from quarry.operators.partitioning import fan_out
from quarry.plans.registry import register
from quarry.sources.tables import table


def _pages(spark, sf):
    return fan_out(table(spark, sf, "pages"), "page_id")


@register("page_entries")
def q_page_entries(spark, sf):
    e = html_jobs.page_entries(_pages(spark, sf), "h1", ("article",), "h1")
    return e.select("page_id", "title", "content", "file_name")


@register("strip_html_noise")
def q_strip_html_noise(spark, sf):
    return html_jobs.strip_html_noise(_pages(spark, sf), "html").select("page_id", "html_clean", "malformed")


@register("html_to_markdown")
def q_html_to_markdown(spark, sf):
    return html_jobs.html_to_markdown(_pages(spark, sf), "html").select("page_id", "markdown")


_UNESCAPE = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"


@register("html_select_text", sql=f"""
SELECT page_id,
       nullif(trim({_UNESCAPE.format(x="regexp_extract(html, '<title>([^<]*)</title>', 1)")}), '') AS title,
       nullif(trim({_UNESCAPE.format(x="regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}), '') AS h1
FROM pages
""")
def q_html_select_text(spark, sf):
    return html_jobs.select_text(_pages(spark, sf), "html", {"title": "title", "h1": "h1"}) \
        .select("page_id", "title", "h1")


@register("extract_links", sql="""
WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base,
                  unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
a AS (SELECT page_id, base, CASE WHEN starts_with(href, '/') THEN base || href ELSE href END AS link FROM l)
SELECT page_id, link FROM a WHERE starts_with(link, base || '/')
""")
def q_extract_links(spark, sf):
    return html_jobs.extract_links(table(spark, sf, "pages")).select("page_id", "link")
