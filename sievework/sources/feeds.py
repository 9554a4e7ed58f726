"""Sources and sinks: feeds as XML, registries as CSV, partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEED = "title string, link string, guid string, description string, pubDate string"
REGISTRY = "name string, platform string, url string, language string, role string, notes string"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of feeds; a missing guid is the link; a time that can't be read is null."""
    items = spark.read.format("xml").option("rowTag", "item").schema(FEED).load(path)
    published = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return items.select(F.coalesce("guid", "link").alias("external_key"), F.col("link").alias("url"), "title", F.col("description").alias("text"), published.alias("published_at"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a registry that name a source; one for each platform and url."""
    rows = spark.read.option("header", True).option("multiLine", True).schema(REGISTRY).csv(path)
    return rows.where("trim(name) <> ''").dropDuplicates(["platform", "url"])


def write_table(df: DataFrame, path: str, by: list[str]) -> None:
    """A Parquet table in folders of ``by``; only the folders that df has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def rss_item(base: str, slug: Column, headline: Column, lead: Column, published: Column) -> Column:
    """SNK-02: a story as an item of an RSS 2.0 channel."""
    url = F.concat(F.lit(base.rstrip("/") + "/story/"), _escaped(slug))
    return F.concat(F.lit("<item><title>"), _escaped(headline), F.lit("</title><link>"), url, F.lit("</link><guid>"), url, F.lit("</guid><pubDate>"), _escaped(published), F.lit("</pubDate><description>"), _escaped(lead), F.lit("</description></item>"))


def sitemap_entry(base: str, slug: Column, changed: Column) -> Column:
    """SNK-03: a story's address, with the time of its last change if there is one."""
    return F.concat(F.lit("<url><loc>" + base.rstrip("/") + "/story/"), _escaped(slug), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), _escaped(changed), F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))


def article_node(base: str, publisher: str, language: str, slug: Column, headline: Column, lead: Column, published: Column) -> Column:
    """SNK-04: a story as a NewsArticle of a JSON-LD graph."""
    base = base.rstrip("/")
    url = F.concat(F.lit(f"{base}/story/"), slug)
    org = F.struct(F.lit(f"{base}/#organization").alias("@id"))
    author = F.struct(F.lit("Organization").alias("@type"), F.lit(f"{base}/#organization").alias("@id"), F.lit(publisher).alias("name"))
    return F.to_json(F.struct(
        F.lit("NewsArticle").alias("@type"), F.concat(url, F.lit("#article")).alias("@id"), headline.alias("headline"), lead.alias("description"), F.lit(language).alias("inLanguage"),
        published.alias("datePublished"), F.struct(F.lit("WebPage").alias("@type"), url.alias("@id")).alias("mainEntityOfPage"), url.alias("url"), org.alias("publisher"), author.alias("author"), F.lit(True).alias("isAccessibleForFree"),
    ))


def write_channel(items: DataFrame, path: str, title: str, link: str, item: str = "item", newest: str = "published", many: int = 50) -> None:
    """SNK-02: a channel of the newest stories, so many at most, as one text file."""
    rows = items.orderBy(F.desc(newest)).limit(many).select(item).collect()
    text = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><link>{link}</link>{"".join(r[0] for r in rows)}</channel></rss>'
    items.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_sitemaps(entries: DataFrame, path: str, entry: str = "entry", each: int = 50_000) -> None:
    """SNK-03: sitemaps of so many addresses at most, one for each file that tasks write."""
    head = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    entries.select(F.col(entry).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", each).option("lineSep", "\n").text(path)
    entries.sparkSession.createDataFrame([(head, "</urlset>")], "head string, tail string").coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "-frame")


def append_metrics(rows: DataFrame, path: str) -> None:
    """SNK-05: rows as lines of JSON, behind those that are there."""
    rows.write.mode("append").json(path)


def message_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """SRC-04: external key, text, time and links of each message block (data-post) of channel previews."""
    parts = F.filter(F.split(F.coalesce(html, F.lit("")), r"(?=<div[^>]*data-post=)"), lambda p: F.contains(p, F.lit("data-post=")))
    block = F.explode(parts).alias("block")
    rows = pages.select(*[F.col(c) for c in pages.columns if c != html], block)
    text = F.regexp_extract("block", r'(?s)class="[^"]*message_text[^"]*"[^>]*>(.*?)</div>', 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"<br\s*/?>", "\n"), "<[^>]+>", ""))
    return rows.select("*", F.regexp_extract("block", r'data-post="([^"]+)"', 1).alias("external_key"), plain.alias("text"), F.try_to_timestamp(F.regexp_extract("block", r'<time[^>]*datetime="([^"]+)"', 1)).alias("published_at")).drop("block")


def after_checkpoint(messages: DataFrame, checkpoint: Column, each: int = 20) -> DataFrame:
    """SRC-05, FLT-18: of each channel's messages behind its checkpoint the oldest, so many a pass."""
    number = F.regexp_extract("external_key", r"(\d+)$", 1).try_cast("long")
    rows = messages.withColumns({"channel": F.regexp_extract("external_key", r"^(.*?)/?\d+$", 1), "number": number}).where(F.col("number") > checkpoint)
    nth = F.row_number().over(Window.partitionBy("channel").orderBy("number"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= each).drop("_nth")


def linked_feeds(html: Column) -> Column:
    """SRC-12: addresses of the feeds that a page links to."""
    tags = F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)application/(rss|atom)\+xml"))
    return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"""(?i)href=["']([^"']+)""", 1)), lambda u: u != "")


def open_graph(html: Column, name: str = "image", first: int = 60_000) -> Column:
    """SRC-13: a page's og: property, attributes in either order, from its first characters as a head goes."""
    head = F.substring(F.coalesce(html, F.lit("")), 1, first)
    one = F.regexp_extract(head, rf"""(?is)<meta[^>]*property=["']og:{name}["'][^>]*content=["']([^"']*)""", 1)
    two = F.regexp_extract(head, rf"""(?is)<meta[^>]*content=["']([^"']*)["'][^>]*property=["']og:{name}["']""", 1)
    return F.nullif(F.coalesce(F.nullif(one, F.lit("")), two), F.lit(""))
