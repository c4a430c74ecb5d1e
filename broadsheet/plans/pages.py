"""Queries over raw pages: articles, links, crawl de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.operators import pages as pg
from broadsheet.plans.base import query, table


@query()
def page_articles(spark, folder):
    return pg.articles(pg.parse_pages(table(spark, folder, "pages"), ["title", "text"]))


@query("""
SELECT page_id, len(regexp_extract_all(html, '<p[ >]'))::INT AS paragraphs,
  len(regexp_extract_all(html, '<a [^>]*href='))::INT AS hrefs FROM pages
""")
def page_shape(spark, folder):
    parsed = pg.parse_pages(table(spark, folder, "pages"), ["paragraphs", "hrefs"])
    return parsed.drop("url")


# The first heading of a page, without tags; the data has no heading with markup but entities.
_HEADING = r"regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)"


@query(rf"""
SELECT page_id, url AS source, trim(replace(replace(replace(regexp_replace({_HEADING}, '<[^>]*>', '', 'g'),
  '&quot;', '"'), '&lt;', '<'), '&amp;', '&')) AS title FROM pages
""")
def page_titles(spark, folder):
    parsed = pg.parse_pages(table(spark, folder, "pages"), ["title"])
    return parsed.select("page_id", F.col("url").alias("source"), F.coalesce("title", F.lit("No Title")).alias("title"))


_HREFS = r"""(SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, url_scheme, href FROM (
  SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS url_scheme,
    unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages))"""
_LINKS = rf"""(SELECT page_id, CASE WHEN href LIKE 'http%' THEN href
    ELSE url_scheme || '://' || host || href END AS link FROM {_HREFS}
  WHERE href LIKE '/%' OR regexp_extract(href, '^[a-z]+://([^/?#]*)', 1) LIKE '%' || host || '%')"""


@query(f"SELECT page_id, link, count(*) AS n FROM {_LINKS} GROUP BY 1, 2")
def page_links(spark, folder):
    found = pg.links(pg.parse_pages(table(spark, folder, "pages"), ["links"]))
    return found.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT link FROM {_LINKS} WHERE link NOT IN (SELECT url FROM pages)")
def link_frontier(spark, folder):
    pages = table(spark, folder, "pages")
    return pg.frontier(pg.links(pg.parse_pages(pages, ["links"])), pages)


@query("""
SELECT url, min(page_id) AS page_id, count(*) AS copies
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages) GROUP BY 1
""")
def first_visits(spark, folder):
    bare = F.regexp_replace("url", r"[?#].*$", "").alias("url")
    return pg.first_visits(table(spark, folder, "pages").select("page_id", bare))
