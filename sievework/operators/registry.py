"""Source registries: what their texts say of speed and trust, endpoints in one form, imports that repeat without effect, and
keys of page views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
PLATFORMS = {"website": "website", "web": "website", "rss": "rss", "telegram": "telegram", "x": "x", "twitter": "x", "truth social": "x", "threads": "x"}
SPEEDS = [(2, "FAST", 120), (5, "MID", 240), (15, "SLOW", 600)]
DB_ROLES = {"INDEPENDENT_NEWSROOM": "MAJOR_NEWSROOM", "OFFICIAL_PRIMARY": "OFFICIAL_PRIMARY", "PERSON_STATEMENT": "JOURNALIST", "OSINT_DATA": "AGGREGATOR", "ANALYSIS": "AGGREGATOR"}
NO_HANDLES = ["s", "joinchat", "c"]
PATHS = {"/": "home", "/latest": "latest", "/feed.xml": "rss", "/sitemap.xml": "sitemap", "/news-sitemap.xml": "news_sitemap", "/robots.txt": "robots"}
FEEDS = [".xml", ".rss", "/feed", "/rss", "/atom"]
CHANNEL_URL = r"^(?:https?://)?t\.me/(?:s/)?@?([A-Za-z0-9_]{4,64})/?$"
PRIVATE_HOST = r"(?i)^(?:localhost|metadata\.google\.internal|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(?:1[6-9]|2\d|3[01])\..*|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\..*|(?:22[4-9]|23\d|24\d|25[0-5])\..*|\[.*)$"
UPDATED = ["source_role", "role_detail", "verification_allowed", "can_increase", "polling_seconds", "endpoint_state", "speed_tier", "focus"]


def _low(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def speed(text: Column) -> Column:
    """TXT-55: struct<tier, seconds> of words on speed, by the largest number of minutes in them."""
    t = _low(text)
    most = F.array_max(F.transform(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("long")))
    most = F.when(~t.rlike(r"\d"), F.lit(5)).otherwise(most)

    def is_(tier: str, seconds: int) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.lit(seconds).alias("seconds"))

    out = F.when(t == "", is_("MID", 300)).when(F.contains(t, F.lit("real")), is_("FAST", 120)).when(t.rlike("event|daily|document"), is_("EVENT", 1800))
    for bound, tier, seconds in SPEEDS:
        out = out.when(most <= bound, is_(tier, seconds))
    return out.otherwise(is_("SLOW", 900))


def trust(use: Column, independent: Column, kind: Column) -> Column:
    """TXT-56: struct<role, verification_allowed, can_increase>; how fast a source is says nothing about truth."""
    u, i, k = _low(use), _low(independent), _low(kind)
    no = F.startswith(i, F.lit("no"))
    mirror = no & F.contains(i, F.lit("same"))

    def is_(role: str, allowed: Column = F.lit(False), increases: Column = F.lit(False)) -> Column:  # noqa: B008
        return F.struct(F.lit(role).alias("role"), allowed.alias("verification_allowed"), increases.alias("can_increase"))

    return (
        F.when(F.contains(u, F.lit("official")) | k.rlike("institution|government"), is_("OFFICIAL_PRIMARY"))
        .when(u.rlike("person|figure") | F.contains(k, F.lit("reporter")), is_("PERSON_STATEMENT"))
        .when(u.rlike("osint|specialist") | k.rlike("osint|data"), is_("OSINT_DATA", increases=~no))
        .when(F.contains(u, F.lit("analysis")), is_("ANALYSIS"))
        .otherwise(is_("INDEPENDENT_NEWSROOM", ~mirror, ~mirror))
    )


def channel_handle(url: Column) -> Column:
    """TXT-57: the handle in a channel's address, empty for links that name none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"t\.me/(?:s/)?([A-Za-z0-9_]{3,64})", 1)
    return F.when(F.lower(found).isin(NO_HANDLES), "").otherwise(found)


def endpoint(raw: Column) -> Column:
    """TXT-58: struct<platform, external_id, url> of an address or handle; null for what is none, or is at a private address.

    Names of hosts aren't looked up: only addresses written as numbers, and names known to be private, are refused.
    """
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", "")
    handle = F.when(t.rlike("^@[A-Za-z0-9_]{4,64}$"), F.substring(t, 2, 64)).otherwise(F.regexp_extract(t, CHANNEL_URL, 1))
    parts = r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:@]*|\[[^\]]*\])(:\d+)?([^?#]*)"
    host, netloc = F.regexp_extract(t, parts, 1), F.regexp_extract(t, r"^(?i)https?://([^/?#]*)", 1)
    path = F.lower(F.regexp_extract(t, parts, 3))
    feed = path.rlike("(?:" + "|".join(f.replace(".", r"\.") for f in FEEDS) + ")$")

    def is_(platform: Column, ident: Column, url: Column) -> Column:
        return F.struct(platform.alias("platform"), ident.alias("external_id"), url.alias("url"))

    return F.when(handle != "", is_(F.lit("telegram"), handle, F.concat(F.lit("https://t.me/s/"), handle))).when((host != "") & ~host.rlike(PRIVATE_HOST), is_(F.when(feed, "rss").otherwise("website"), netloc, t))


def endpoint_rows(rows: DataFrame) -> DataFrame:
    """OPS-16: canonical rows of a registry's endpoints (entity, name, platform, url, language, kind, trust_use, independent, speed, focus);
    rows without an entity or address are left out."""
    raw = _low(F.trim("platform"))
    platform = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PLATFORMS.items() for x in p]), raw), F.lit("website"))
    role, pace = trust(F.col("trust_use"), F.col("independent"), F.col("kind")), speed(F.col("speed"))
    base = rows.select("*", F.trim(F.coalesce("entity", F.lit(""))).alias("identity"), F.trim(F.coalesce("url", F.lit(""))).alias("address"), platform.alias("medium"), role.alias("r"), pace.alias("s"), raw.alias("raw"))
    base = base.where("identity <> '' AND address <> ''")
    kind = F.when(F.col("medium") == "telegram", "telegram_web_preview").when(F.contains("raw", F.lit("truth")), "truthsocial_endpoint").when(F.col("medium") == "rss", "rss_feed").otherwise("website_endpoint")
    state = F.when(F.col("medium") == "x", "BLOCKED_AUTH").when(F.col("medium") == "website", "UNSUPPORTED").otherwise("ACTIVE")
    language = F.trim(F.coalesce("language", F.lit("")))
    return base.select(
        "identity", F.col("medium").alias("platform"), F.col("address").alias("url"), F.substring(F.trim(F.coalesce(F.nullif("name", F.lit("")), "identity")), 1, 120).alias("name"), F.substring(F.lower(F.when(language == "", "en").otherwise(language)), 1, 3).alias("language"), kind.alias("source_type"),
        F.when(F.col("medium") == "telegram", channel_handle(F.col("address"))).otherwise("").alias("external_id"), F.element_at(F.create_map(*[F.lit(x) for p in DB_ROLES.items() for x in p]), F.col("r.role")).alias("source_role"), F.col("r.role").alias("role_detail"),
        "r.verification_allowed", "r.can_increase", F.col("s.seconds").alias("polling_seconds"), state.alias("endpoint_state"), F.col("s.tier").alias("speed_tier"), F.substring(F.coalesce("focus", F.lit("")), 1, 300).alias("focus"),
    )


def imported(table: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """OPS-16, OPS-17, DML-05: the table of sources after an import, known by identity, platform and url.

    A new key's first row (by ``order``) makes a source; what the last row of a key says of role, speed and state is what stays, also
    for sources that were there, whose names, languages and kinds are left as they are.  The same import again changes nothing.
    """
    keys = ["identity", "platform", "url"]
    new = endpoint_rows(rows.withColumn("focus", F.coalesce("focus", F.lit("")))) if "identity" not in rows.columns else rows
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    made = [c for c in table.columns if c not in keys and c not in UPDATED]
    ranked = new.withColumns({"_first": first, "_last": last})
    head = ranked.where("_first = 1").select(*keys, *[F.col(c).alias(f"n_{c}") for c in made])
    tail = ranked.where("_last = 1").select(*keys, *[F.col(c).alias(f"n_{c}") for c in UPDATED], F.lit(True).alias("_hit"))
    both = table.join(head.join(tail, keys), keys, "full_outer")
    old = F.col("name").isNull()
    return both.select(*keys, *[F.when(old, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in made], *[F.when(F.col("_hit"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in UPDATED])


def view_keys(path: Column, referrer: Column, source: Column, medium: Column, campaign: Column) -> Column:
    """TXT-59: struct<path_class, referrer_host, utm> of a view: no person, no page but its class."""
    p = F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path)
    known = F.element_at(F.create_map(*[F.lit(x) for q in PATHS.items() for x in q]), p)
    second = F.coalesce(F.get(F.split(p, "/"), 1), F.lit(""))
    page = F.concat(F.lit("page:"), F.when(F.substring(second, 1, 20) == "", "other").otherwise(F.substring(second, 1, 20)))
    story = F.concat(F.lit("story:"), F.substring(F.coalesce(F.get(F.split(p, "/"), 2), F.lit("")), 1, 40))
    r = F.coalesce(referrer, F.lit(""))
    host = F.when(F.startswith(r, F.lit("http")), F.coalesce(F.get(F.split(r, "/"), 2), F.lit(""))).when(r == "", "-").otherwise(r)
    dash = [F.when(F.coalesce(x, F.lit("")) == "", "-").otherwise(x) for x in (source, medium, campaign)]
    return F.struct(F.when(F.startswith(p, F.lit("/story/")), story).otherwise(F.coalesce(known, page)).alias("path_class"), F.substring(host, 1, 60).alias("referrer_host"), F.substring(F.concat_ws("|", *dash), 1, 80).alias("utm"))


def counted_views(table: DataFrame, views: DataFrame, day: str) -> DataFrame:
    """DML-02: views of each day and key (columns of ``view_keys``) added to those that are counted; partial sums do it before the shuffle."""
    keys = [day, "path_class", "referrer_host", "utm"]
    new = views.groupBy(*keys).agg(F.count("*").alias("views"))
    return table.select(*keys, "views").unionByName(new).groupBy(*keys).agg(F.sum("views").alias("views"))
