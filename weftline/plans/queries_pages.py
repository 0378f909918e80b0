"""Queries on pages: native extraction, classification, URLs, links, endpoints, DOM fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import classify, text, urls
from ..operators import endpoints as ep
from ..operators import extract as ex
from . import pipeline
from .registry import any_of, clean, extract, has, q, query, table, words

# ---------------------------------------------------------------- SQL of the shared expressions
S_TITLE = clean(extract("html", r"(?is)<title[^>]*>(.*?)</title"))
S_LANG = "coalesce(" + ", ".join(f"nullif(trim({extract('substr(html, 1, 4096)', p)}), '')" for p in (C.LANG_ATTRIBUTE, C.LANG_META, C.LANG_META_REVERSED)) + ")"


def s_part(url: str, k: int) -> str:
    return extract(url, urls.SPLIT, k)


def s_host(url: str) -> str:
    return f"regexp_replace(regexp_replace(lower({s_part(url, 2)}), '^[^@]*@', ''), ':\\d*$', '')"


def s_domain(url: str) -> str:
    return f"regexp_replace({s_host(url)}, '^www\\.', '')"


def s_page_type(url: str = "url", html: str = "html") -> str:
    og, ld = extract(html, C.OG_TYPE), extract(html, C.LD_TYPE)
    return f"""CASE WHEN coalesce({url}, '') = '' THEN 'unknown'
      WHEN contains({og}, 'article') THEN 'article' WHEN contains({og}, 'product') THEN 'product' WHEN {og} IN ('website', 'website:home') THEN 'homepage'
      WHEN {ld} IN ('Article', 'BlogPosting', 'NewsArticle') THEN 'article' WHEN {ld} = 'Product' THEN 'product' WHEN {ld} IN ('WebPage', 'HomePage', 'WebSite') THEN 'homepage'
      WHEN {has(url, C.PAGE_HOME)} THEN 'homepage' WHEN {has(url, C.PAGE_BLOG)} THEN 'blog_post' WHEN {has(url, C.PAGE_PRODUCT)} THEN 'product'
      WHEN {has(url, C.PAGE_SEARCH)} THEN 'search_results' WHEN {has(url, C.PAGE_CONTACT)} THEN 'contact'
      WHEN {has(f"substr({html}, 1, 8192)", C.PAGE_ARTICLE)} THEN 'article' ELSE 'unknown' END"""


S_SPA = any_of("lower(html)", C.SPA_SIGNATURES)
S_API = any_of("lower(html)", C.API_SIGNATURES)
S_SITE = f"CASE WHEN {S_SPA} THEN 'spa' WHEN {S_API} THEN 'mixed' ELSE 'static' END"
_LINK = r"""(?is)<a\s(?:[^>]*\s)?href\s*=\s*["']([^"'>]*)["'][^>]*>(.*?)</a>"""


def s_resolve(base: str, href: str) -> str:
    root = f"{s_part(base, 1)} || '://' || {s_part(base, 2)}"
    folder = f"regexp_replace({s_part(base, 3)}, '[^/]*$', '')"
    return f"""CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {href}
      WHEN starts_with({href}, '//') THEN {s_part(base, 1)} || ':' || {href} WHEN starts_with({href}, '/') THEN {root} || {href}
      WHEN starts_with({href}, '?') THEN {root} || {s_part(base, 3)} || {href} WHEN {href} = '' OR starts_with({href}, '#') THEN regexp_replace({base}, '#.*$', '') || {href}
      ELSE {root} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {href} END"""


S_LINKS = f"""
raw AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, {q(_LINK)}, 1)) AS href, unnest(regexp_extract_all(html, {q(_LINK)}, 2)) AS txt,
         generate_subscripts(regexp_extract_all(html, {q(_LINK)}, 1), 1) AS pos FROM pages
),
kept AS (SELECT page_id, url, trim(href) AS h, trim(regexp_replace(regexp_replace(txt, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text, pos FROM raw
         WHERE trim(href) <> '' AND NOT regexp_matches(trim(href), {q(C.LINK_SKIP)})),
links AS (
  SELECT page_id, url, {s_resolve('url', 'h')} AS href, text, pos FROM kept
  QUALIFY row_number() OVER (PARTITION BY page_id, {s_resolve('url', 'h')} ORDER BY pos) = 1
)"""


def page_link_rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, href, text, pos): the first link of a page to each resolved target."""
    rows = pages.select("page_id", "url", F.posexplode(ex.native_links(F.col("html"))).alias("pos", "l"))
    rows = rows.where((F.col("l.href") != "") & ~text.rx(F.col("l.href"), C.LINK_SKIP))
    rows = rows.select("page_id", "url", urls.resolve(F.col("url"), F.col("l.href")).alias("href"), F.col("l.text").alias("text"), (F.col("pos") + 1).cast("long").alias("pos"))
    first = rows.groupBy("page_id", "url", "href").agg(F.min(F.struct("pos", "text")).alias("f"))
    return first.select("page_id", "url", "href", F.col("f.text").alias("text"), F.col("f.pos").alias("pos"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


# ---------------------------------------------------------------- native extraction
@query(f"SELECT page_id, {S_TITLE} AS title FROM pages")
def page_title(spark, d):
    return pages(spark, d).select("page_id", classify.title(F.col("html")).alias("title"))


@query(f"SELECT page_id, coalesce({S_LANG}, '') AS language FROM pages")
def page_language(spark, d):
    return pages(spark, d).select("page_id", F.coalesce(classify.language(F.col("html")), F.lit("")).alias("language"))


@query(f"SELECT page_id, {s_page_type()} AS page_type FROM pages")
def page_type(spark, d):
    return pages(spark, d).select("page_id", classify.page_type(F.col("url"), F.col("html")).alias("page_type"))


@query(f"SELECT page_id, {S_SPA} AS is_spa, {S_API} AS has_api_calls, {S_SITE} AS site_type FROM pages")
def site_type(spark, d):
    h = F.col("html")
    return pages(spark, d).select("page_id", classify.is_spa(h).alias("is_spa"), classify.has_api_calls(h).alias("has_api_calls"), classify.site_type(h).alias("site_type"))


_ENGINES = f"""CASE WHEN {S_SPA} OR {S_API} THEN {words([*C.SELECT_ALWAYS, *C.SELECT_JS, "visual_ocr", "crawl_discovery"])} ELSE {words([*C.SELECT_ALWAYS, "visual_ocr", "crawl_discovery"])} END"""


@query(f"SELECT page_id, array_to_string({_ENGINES}, ',') AS engines FROM pages")
def engine_selection(spark, d):
    h = F.col("html")
    chosen = classify.selected_engines(classify.site_type(h), classify.is_spa(h), classify.has_api_calls(h))
    return pages(spark, d).select("page_id", F.array_join(chosen, ",").alias("engines"))


_CLOUD = " + ".join(f"{has('html', p)}::INT" for p in C.CAPTCHA_CLOUDFLARE)
# one page in seven gets a challenge widget, so that the classifier has something to find
_MARKED = """CASE page_id % 7 WHEN 1 THEN html || '<div class="g-recaptcha" data-sitekey="6LcAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"></div>' WHEN 2 THEN html || '<div class="cf-turnstile"></div>' WHEN 3 THEN html || '<div class="h-captcha"></div>' WHEN 4 THEN '<title>Just a moment...</title><form id="challenge-form">' ELSE html END"""


@query(
    f"""WITH m AS (SELECT page_id, {_MARKED} AS html FROM pages)
SELECT page_id, CASE WHEN {_CLOUD} >= 2 THEN 'cloudflare' WHEN {has('html', C.CAPTCHA_TURNSTILE)} THEN 'turnstile' WHEN {has('html', C.CAPTCHA_HCAPTCHA)} THEN 'hcaptcha'
  WHEN {has('html', C.CAPTCHA_V3)} THEN 'recaptcha_v3' WHEN {has('html', C.CAPTCHA_V2)} THEN 'recaptcha_v2' END AS captcha,
  coalesce({', '.join(f"nullif({extract('html', p)}, '')" for p in C.SITEKEYS)}, '') AS sitekey FROM m"""
)
def captcha_label(spark, d):
    m = pages(spark, d).select("page_id", F.expr(_MARKED).alias("html"))
    return m.select("page_id", classify.captcha(F.col("html")).alias("captcha"), classify.sitekey(F.col("html")).alias("sitekey"))


@query(f"WITH {S_LINKS[1:]} SELECT page_id, href, text, pos FROM links")
def page_links(spark, d):
    return page_link_rows(pages(spark, d)).select("page_id", "href", "text", "pos")


@query(
    f"""WITH {S_LINKS[1:]} SELECT page_id, count(*) FILTER ({s_part('url', 2)} = {s_part('href', 2)}) AS internal,
  count(*) FILTER ({s_part('url', 2)} <> {s_part('href', 2)}) AS external FROM links GROUP BY page_id"""
)
def internal_external_links(spark, d):
    rows = page_link_rows(pages(spark, d))
    inside = urls.same_host(F.col("url"), F.col("href"))
    return rows.groupBy("page_id").agg(F.count_if(inside).alias("internal"), F.count_if(~inside).alias("external"))


# one page in five names a canonical URL, in either attribute order
_CANON = """CASE page_id % 5 WHEN 1 THEN '<link rel="canonical" href="/canon/' || page_id || '">' || html WHEN 2 THEN '<link href="http://canon.example.com/' || page_id || '" rel="canonical">' || html ELSE html END"""
_CANON_HREF = f"coalesce(nullif({extract('h', C.CANONICAL)}, ''), nullif({extract('h', C.CANONICAL_REVERSED)}, ''))"


@query(
    f"""WITH m AS (SELECT page_id, url, substr({_CANON}, 1, 16384) AS h FROM pages), c AS (SELECT page_id, url, {_CANON_HREF} AS href FROM m)
SELECT page_id, CASE WHEN href IS NOT NULL THEN {s_resolve('url', 'href')} END AS canonical FROM c"""
)
def canonical_url(spark, d):
    m = pages(spark, d).select("page_id", "url", F.expr(_CANON).alias("html"))
    return m.select("page_id", classify.canonical(F.col("url"), F.col("html")).alias("canonical"))


@query(
    f"""WITH b AS (SELECT page_id, string_split_regex(regexp_replace(html, {q(ex.SCRIPTS)}, ' ', 'g'), {q(ex.PARAGRAPH_START)})[2:] AS ps FROM pages),
p AS (SELECT page_id, regexp_replace(unnest(ps), {q(ex.PARAGRAPH_END)}, '') AS t FROM b),
c AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS t FROM p)
SELECT page_id, count(*) AS paragraphs, count(*) FILTER (length(t) <= 3 OR {has('t', C.NOISE_LINE)}) AS noise FROM c WHERE t <> '' GROUP BY page_id"""
)
def page_noise_filter(spark, d):
    rows = pages(spark, d).select("page_id", F.explode(ex.native_paragraphs(F.col("html"))).alias("t"))
    return rows.groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.count_if(text.is_noise(F.col("t"))).alias("noise"))


@query("SELECT page_id, strlen(html) AS bytes FROM pages WHERE strlen(html) <= 8192")
def html_size_cap(spark, d):
    return pages(spark, d).where(F.octet_length("html") <= 8192).select("page_id", F.octet_length("html").cast("long").alias("bytes"))


_VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({_VISIBLE}) AS chars, length({_VISIBLE}) < {C.THIN_BODY} AS is_empty, length({_VISIBLE}) >= {C.THIN_HYBRID} AS enough FROM pages")
def page_body_size(spark, d):
    v = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</(script|style)>", " "), "<[^>]*>", " ")
    n = F.char_length(F.trim(F.regexp_replace(v, r"\s+", " "))).cast("long")
    return pages(spark, d).select("page_id", n.alias("chars"), (n < C.THIN_BODY).alias("is_empty"), (n >= C.THIN_HYBRID).alias("enough"))


@query(
    f"""WITH m AS (SELECT url, {S_TITLE} AS title, length({_VISIBLE}) AS n, html FROM pages)
SELECT url, CASE WHEN n < {C.THIN_BODY} THEN 'dynamic' ELSE 'static' END AS fetched, CASE WHEN title <> '' THEN title ELSE {clean(extract('html', '(?is)<h1[^>]*>(.*?)</h1'))} END AS title FROM m"""
)
def title_chain(spark, d):
    """Pages with little visible text go to a browser; the title, or else the first heading."""
    h = F.col("html")
    visible = F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)\b.*?</(script|style)>", " "), "<[^>]*>", " ")
    chars = F.char_length(F.trim(F.regexp_replace(visible, r"\s+", " ")))
    h1 = text.sanitize(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1", 1))
    return pages(spark, d).select(
        "url", F.when(chars < C.THIN_BODY, "dynamic").otherwise("static").alias("fetched"), F.coalesce(text.nonempty(classify.title(h)), h1).alias("title")
    )


# ---------------------------------------------------------------- URLs
def s_query(url: str, drop) -> str:
    keep = f"regexp_matches(p, '^[^=]*=.+$')" + (f" AND NOT list_contains({words(drop)}, split_part(p, '=', 1))" if drop else "")
    return f"array_to_string(list_sort(list_filter(string_split({s_part(url, 4)}, '&'), lambda p: {keep})), '&')"


def s_normal(url: str, path: str, drop) -> str:
    qs = s_query(url, drop)
    return f"lower({s_part(url, 1)}) || '://' || lower({s_part(url, 2)}) || {path} || CASE WHEN {qs} <> '' THEN '?' || {qs} ELSE '' END"


S_CRAWL_KEY = s_normal("url", f"CASE WHEN rtrim({s_part('url', 3)}, '/') = '' THEN '/' ELSE rtrim({s_part('url', 3)}, '/') END", C.TRACKING_PARAMETERS)


@query(f"SELECT page_id, {S_CRAWL_KEY} AS key FROM pages")
def url_normalize_crawl(spark, d):
    return pages(spark, d).select("page_id", urls.normalize_crawl(F.col("url")).alias("key"))


@query(f"SELECT page_id, {s_normal('url', s_part('url', 3), ())} AS key FROM pages")
def url_normalize_probe(spark, d):
    return pages(spark, d).select("page_id", urls.normalize_probe(F.col("url"), F.col("url")).alias("key"))


@query(f"SELECT page_id, {s_domain('url')} AS domain FROM pages")
def url_domain(spark, d):
    return pages(spark, d).select("page_id", urls.domain(F.col("url")).alias("domain"))


_TAIL = "CASE page_id % 4 WHEN 0 THEN '/about' WHEN 1 THEN '/login/x' WHEN 2 THEN '/api/v1/users.json' ELSE '/news/config' END"
_SECTIONED = f"split_part(split_part(url, '#', 1), '?', 1) || {_TAIL}"
_DEPTH = f"(length({s_part('url', 3)}) - length(replace({s_part('url', 3)}, '/', '')))"


@query(
    f"""WITH m AS (SELECT page_id, {_SECTIONED} AS url FROM pages)
SELECT page_id, {_DEPTH} - CASE WHEN {has('url', C.PATH_HIGH_VALUE)} THEN 2.0::DOUBLE ELSE 0.0 END + CASE WHEN {has('url', C.PATH_LOW_VALUE)} THEN 3.0::DOUBLE ELSE 0.0 END AS priority FROM m"""
)
def url_priority(spark, d):
    m = _sectioned(spark, d)
    p = urls.path(F.col("url"))
    return m.select("page_id", urls.crawl_priority(F.col("url"), F.char_length(p) - F.char_length(F.replace(p, F.lit("/"), F.lit("")))).alias("priority"))


def _sectioned(spark, d) -> DataFrame:
    """Pages with a second path section, so that path rules apply."""
    return pages(spark, d).select("page_id", F.expr(_SECTIONED).alias("url"))


_API_SQL = " + ".join(f"CASE WHEN {has('lower(' + s_part('url', 3) + ')', p)} THEN {n} ELSE 0 END" for p, n in C.API_PATHS)


@query(f"WITH m AS (SELECT page_id, {_SECTIONED} AS url FROM pages) SELECT page_id, ({_DEPTH} + {_API_SQL})::BIGINT AS score FROM m")
def api_score(spark, d):
    return _sectioned(spark, d).select("page_id", urls.api_score(F.col("url")).cast("long").alias("score"))


_CANDIDATES = """CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'http://10.0.' || (page_id % 256) || '.7/x' WHEN 2 THEN 'http://localhost/a' WHEN 3 THEN 'ftp://files.example.com/a'
  WHEN 4 THEN 'http://203.0.113.9:80/' WHEN 5 THEN 'https://8.8.8.8/dns' WHEN 6 THEN '' ELSE 'http://user@172.20.1.1/' END"""


def s_ip(host: str) -> str:
    o = [f"split_part({host}, '.', {k})::BIGINT" for k in (1, 2, 3, 4)]
    return f"CASE WHEN regexp_matches({host}, '^(25[0-5]|2[0-4]\\d|1?\\d?\\d)(\\.(25[0-5]|2[0-4]\\d|1?\\d?\\d)){{3}}$') THEN {o[0]} * 16777216 + {o[1]} * 65536 + {o[2]} * 256 + {o[3]} END"


_PRIVATE = " OR ".join(f"coalesce(ip BETWEEN {lo} AND {hi}, false)" for _, lo, hi in urls.net_ranges())


@query(
    f"""WITH c AS (SELECT page_id, trim({_CANDIDATES}) AS u FROM pages), h AS (SELECT page_id, u, {s_host('u')} AS host FROM c), i AS (SELECT *, {s_ip('host')} AS ip FROM h)
SELECT page_id, CASE WHEN u = '' THEN 'empty' WHEN length(u) > {C.MAX_URL_LENGTH} THEN 'too_long' WHEN lower({s_part('u', 1)}) NOT IN ('http', 'https') THEN 'bad_scheme' WHEN host = '' THEN 'no_host'
  WHEN list_contains({words(C.BLOCKED_HOSTS)}, host) THEN 'blocked_host' WHEN {_PRIVATE} THEN 'private_address' ELSE 'ok' END AS reason FROM i"""
)
def url_validate(spark, d):
    return pages(spark, d).select("page_id", urls.invalid_reason(F.expr(_CANDIDATES)).alias("reason"))


@query(
    f"""WITH c AS (SELECT page_id, trim({_CANDIDATES}) AS u FROM pages), i AS (SELECT page_id, {s_ip(s_host('u'))} AS ip FROM c),
n(cidr, lo, hi) AS (VALUES {', '.join(f"('{c}', {lo}::BIGINT, {hi}::BIGINT)" for c, lo, hi in urls.net_ranges())})
SELECT page_id, cidr FROM i JOIN n ON ip BETWEEN lo AND hi"""
)
def private_address_ranges(spark, d):
    nets = spark.createDataFrame(urls.net_ranges(), "cidr string, lo long, hi long")  # fourteen fixed rows
    hosts = pages(spark, d).select("page_id", urls.ip_number(urls.host(F.expr(_CANDIDATES))).alias("ip")).where("ip IS NOT NULL")
    return hosts.join(F.broadcast(nets), F.col("ip").between(F.col("lo"), F.col("hi"))).select("page_id", "cidr")


@query(
    f"""WITH {S_LINKS[1:]} SELECT page_id, href, {s_part('url', 2)} = {s_part('href', 2)} AS same_host,
  lower({s_part('url', 1)}) = lower({s_part('href', 1)}) AND lower({s_part('url', 2)}) = lower({s_part('href', 2)}) AS same_origin FROM links"""
)
def same_origin(spark, d):
    rows = page_link_rows(pages(spark, d))
    return rows.select("page_id", "href", urls.same_host(F.col("url"), F.col("href")).alias("same_host"), urls.same_origin(F.col("url"), F.col("href")).alias("same_origin"))


_ROBOTS = (("en", "/en/1", False), ("en", "/en/12", True), ("fr", "/fr/", False), ("de", "/", True), ("de", "/de/5", False))
_ROBOTS_SQL = ", ".join(f"('{g}', '{p}', {str(a).lower()})" for g, p, a in _ROBOTS)


@query(
    f"""WITH r(grp, prefix, allow) AS (VALUES {_ROBOTS_SQL}), p AS (SELECT page_id, split_part({s_part('url', 3)}, '/', 2) AS grp, {s_part('url', 3)} AS path FROM pages),
m AS (SELECT p.page_id, allow FROM p JOIN r ON r.grp = p.grp AND starts_with(p.path, r.prefix) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC, allow DESC) = 1)
SELECT p.page_id, coalesce(m.allow, true) AS allowed FROM p LEFT JOIN m USING (page_id)"""
)
def robots_filter(spark, d):
    return robots_allowed(
        pages(spark, d).select("page_id", F.split_part(urls.path(F.col("url")), F.lit("/"), F.lit(2)).alias("grp"), urls.path(F.col("url")).alias("path")),
        spark.createDataFrame(_ROBOTS, "grp string, prefix string, allow boolean"),
    ).select("page_id", "allowed")


def robots_allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(page_id, grp, path) with ``allowed``: the longest rule(grp, prefix, allow) that is a prefix decides; no rule allows.

    A path meets rules by equal prefixes of the lengths that its group's rules have, so a host with many rules and
    pages makes no pairs beyond those that match.
    """
    r = rules.withColumn("n", F.char_length("prefix"))
    lengths = r.groupBy("grp").agg(F.collect_set("n").alias("lengths"))  # as many as a path has characters at most
    heads = paths.join(lengths, "grp").select("page_id", "grp", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.char_length("path")), lambda n: F.left("path", n))).alias("prefix"))
    hit = heads.join(r, ["grp", "prefix"])
    best = hit.groupBy("page_id").agg(F.max(F.struct("n", "allow")).alias("b")).select("page_id", F.col("b.allow").alias("allow"))
    return paths.join(best, "page_id", "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


# ---------------------------------------------------------------- domain reports
_FACTS = f"""facts AS (
  SELECT {s_domain('url')} AS domain, {s_page_type()} AS page_type, coalesce({S_LANG}, '') AS language,
         len(regexp_extract_all(html, {q(_LINK)}, 1)) AS links, length({_VISIBLE}) < {C.THIN_BODY} AS thin FROM pages
)"""


def page_facts(pages_: DataFrame) -> DataFrame:
    v = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</(script|style)>", " "), "<[^>]*>", " ")
    return pages_.select(
        urls.domain(F.col("url")).alias("domain"),
        classify.page_type(F.col("url"), F.col("html")).alias("page_type"),
        F.coalesce(classify.language(F.col("html")), F.lit("")).alias("language"),
        F.regexp_count("html", F.lit(_LINK)).alias("links"),
        (F.char_length(F.trim(F.regexp_replace(v, r"\s+", " "))) < C.THIN_BODY).alias("thin"),
    )


@query(f"WITH {_FACTS} SELECT domain, page_type, language, count(*) AS pages, avg(links) AS mean_links, avg(thin::INT) AS thin_share FROM facts GROUP BY ALL")
def flagship_domain_rollup(spark, d):
    """Per domain, page type and language: pages, mean outgoing links, share of pages without much text. One shuffle of pre-aggregated rows."""
    return page_facts(pages(spark, d)).groupBy("domain", "page_type", "language").agg(F.count("*").alias("pages"), F.avg("links").alias("mean_links"), F.avg(F.col("thin").cast("int")).alias("thin_share"))


@query(f"WITH {_FACTS} SELECT domain, page_type, count(*) AS pages, sum(links)::BIGINT AS links FROM facts GROUP BY ROLLUP (domain, page_type)")
def domain_rollup_totals(spark, d):
    return page_facts(pages(spark, d)).rollup("domain", "page_type").agg(F.count("*").alias("pages"), F.sum("links").alias("links"))


@query(f"WITH {_FACTS} SELECT language, page_type, grouping(language) AS g1, grouping(page_type) AS g2, count(*) AS pages FROM facts GROUP BY CUBE (language, page_type)")
def domain_cube(spark, d):
    out = page_facts(pages(spark, d)).cube("language", "page_type").agg(F.grouping("language").cast("long").alias("g1"), F.grouping("page_type").cast("long").alias("g2"), F.count("*").alias("pages"))
    return out


@query(f"WITH {_FACTS} SELECT domain, count(*) AS pages FROM facts GROUP BY domain ORDER BY pages DESC, domain LIMIT 10")
def top_domains(spark, d):
    return page_facts(pages(spark, d)).groupBy("domain").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "domain").limit(10)


# ---------------------------------------------------------------- search segments
_SEGS = f"""segs AS (
  SELECT page_id, 'title' AS field, {S_TITLE} AS content, 10.0::DOUBLE AS weight, 0::BIGINT AS pos FROM pages
  UNION ALL SELECT page_id, 'heading', trim(regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1', 1)), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), 6.0, generate_subscripts(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1', 1), 1) FROM pages
  UNION ALL SELECT page_id, 'list_item', trim(regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li', 1)), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), 0.8, generate_subscripts(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li', 1), 1) FROM pages
)"""


def segment_rows(pages_: DataFrame) -> DataFrame:
    """(page_id, field, content, weight, pos) of titles, first-level headings and list items, by pattern."""
    plain = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"\s+", " "))

    def found(field: str, tag: str, weight: float):
        hits = F.regexp_extract_all("html", F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}"), F.lit(1))
        return F.transform(hits, lambda t, i: F.struct(F.lit(field).alias("field"), plain(t).alias("content"), F.lit(weight).alias("weight"), (i + 1).alias("pos")))

    head = F.array(F.struct(F.lit("title").alias("field"), classify.title(F.col("html")).alias("content"), F.lit(10.0).alias("weight"), F.lit(0).alias("pos")))
    return pages_.select("page_id", F.inline(F.concat(head, found("heading", "h1", 6.0), found("list_item", "li", 0.8)))).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_SEGS} SELECT page_id, field, content, weight, pos FROM segs")
def segments_weighted(spark, d):
    return segment_rows(pages(spark, d))


@query(f"WITH {_SEGS} SELECT page_id, field, content, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, pos) AS rank FROM segs) WHERE rank <= 5")
def top_segments(spark, d):
    """Five heaviest segments a page (a page's segments are one row's, so no key is hot)."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy(F.desc("weight"), "pos")
    return segment_rows(pages(spark, d)).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("page_id", "field", "content", "rank")


@query(f"WITH {_SEGS} SELECT field, count(*) AS segments, sum(length(content))::BIGINT AS chars, sum(weight) AS weight FROM segs GROUP BY field")
def segment_stats(spark, d):
    return segment_rows(pages(spark, d)).groupBy("field").agg(F.count("*").alias("segments"), F.sum(F.char_length("content")).alias("chars"), F.sum("weight").alias("weight"))


# ---------------------------------------------------------------- link graph
_EDGES = f"{S_LINKS[1:]}, edges AS (SELECT DISTINCT {s_domain('url')} AS src, split_part({s_part('href', 3)}, '/', 2) AS dst FROM links)"


def site_edges(pages_: DataFrame) -> DataFrame:
    """Distinct (domain, first path section) edges."""
    rows = page_link_rows(pages_)
    return rows.select(urls.domain(F.col("url")).alias("src"), F.split_part(urls.path(F.col("href")), F.lit("/"), F.lit(2)).alias("dst")).distinct()


@query(f"WITH {_EDGES} SELECT src, dst FROM edges")
def link_edges(spark, d):
    return site_edges(pages(spark, d))


@query(f"WITH {_EDGES} SELECT coalesce(o.node, i.node) AS node, coalesce(o.n, 0)::BIGINT AS out_degree, coalesce(i.n, 0)::BIGINT AS in_degree FROM (SELECT src AS node, count(*) AS n FROM edges GROUP BY src) o FULL JOIN (SELECT dst AS node, count(*) AS n FROM edges GROUP BY dst) i ON o.node = i.node")
def page_degree(spark, d):
    e = site_edges(pages(spark, d))
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


# domains reach each other through the sections that they link to
_BFS = f"""WITH RECURSIVE {_EDGES}, b AS (SELECT 'domain ' || src AS x, 'section ' || dst AS y FROM edges), e AS (SELECT x AS src, y AS dst FROM b UNION ALL SELECT y, x FROM b),
r AS (SELECT min(x) AS node, 0 AS depth FROM b UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 10)
SELECT node, min(depth) AS depth FROM r WHERE node IS NOT NULL GROUP BY node"""


def bfs_input(spark, d) -> tuple[DataFrame, DataFrame]:
    """(seeds, edges): the first domain, and links of domains and sections both ways."""
    b = site_edges(pages(spark, d)).select(F.concat(F.lit("domain "), "src").alias("x"), F.concat(F.lit("section "), "dst").alias("y"))
    edges = b.select(F.col("x").alias("src"), F.col("y").alias("dst")).unionByName(b.select(F.col("y").alias("src"), F.col("x").alias("dst")))
    return b.agg(F.min("x").alias("node")).where("node IS NOT NULL"), edges


@query(_BFS)
def bfs_reachability(spark, d):
    """Depth of every domain and section within ten links of the first domain, links taken both ways."""
    from ..operators import crawl

    return crawl.bfs(*bfs_input(spark, d), max_depth=10)


# ---------------------------------------------------------------- endpoints
_SCRIPTED = """html || CASE page_id % 4 WHEN 0 THEN '<script>fetch("/api/v1/items?b=2&a=1"); axios.get("/admin/users"); const apiUrl = "/rest/orders";</script>'
 WHEN 1 THEN '<script>$.ajax("/login"); x.open("POST", "/api/save"); new WebSocket("wss://live.example.com/feed")</script>'
 WHEN 2 THEN '<script>router.get("/health", f); this.http.post("/v2/things", b); var u = `/api/user/$' || '{id}`;</script>' ELSE '' END"""
_JS = " UNION ALL ".join(f"SELECT page_id, '{k}' AS source, unnest(regexp_extract_all(h, {q(p)}, 1)) AS path FROM s" for k, p in C.JS_PATTERNS.items())
_ENDPOINTS = f"s AS (SELECT page_id, {_SCRIPTED} AS h FROM pages), ep AS (SELECT DISTINCT page_id, source, path FROM ({_JS}))"


def endpoint_rows(spark, d) -> DataFrame:
    """Distinct (page_id, source, path) of calls and routes in pages' scripts."""
    s = pages(spark, d).select("page_id", F.expr(_SCRIPTED).alias("h"))
    return s.select("page_id", F.inline(F.concat(*[_tagged(k, p) for k, p in C.JS_PATTERNS.items()]))).distinct()


def _tagged(source: str, pattern: str):
    return F.transform(F.regexp_extract_all("h", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(source).alias("source"), x.alias("path")))


@query(f"WITH {_ENDPOINTS} SELECT page_id, source, path FROM ep")
def js_endpoints(spark, d):
    return endpoint_rows(spark, d)


@query(f"WITH s AS (SELECT page_id, {_SCRIPTED} AS h FROM pages) SELECT page_id, unnest(regexp_extract_all(h, {q(C.WEBSOCKET)}, 1)) AS endpoint FROM s")
def websocket_endpoints(spark, d):
    s = pages(spark, d).select("page_id", F.expr(_SCRIPTED).alias("h"))
    return s.select("page_id", F.explode(F.regexp_extract_all("h", F.lit(C.WEBSOCKET), F.lit(1))).alias("endpoint"))


# probe outcomes are an input table; here they follow from the page's number
_OUTCOME = "page_id, source, 'http://h.example.com' || path AS url, CASE page_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS auth, page_id % 5 = 0 AS cors, CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 401 ELSE 404 END AS status, CASE page_id % 2 WHEN 0 THEN 'application/json' ELSE 'text/html' END AS ct"
_S_RISK = f"""CASE WHEN {has(s_part('url', 3), C.SENSITIVE_PATH)} THEN CASE WHEN auth = false THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN status = 200 AND coalesce(NOT auth, false) THEN CASE WHEN contains(ct, 'json') THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN cors AND coalesce(NOT auth, false) THEN 'HIGH' WHEN cors THEN 'MEDIUM' WHEN status IN (401, 403) THEN 'LOW' ELSE 'INFO' END"""
_RISKS = f"WITH {_ENDPOINTS}, o AS (SELECT {_OUTCOME} FROM ep), risks AS (SELECT page_id, source, url, {_S_RISK} AS risk FROM o)"


def risk_rows(spark, d) -> DataFrame:
    o = endpoint_rows(spark, d).selectExpr(*[c.strip() for c in _split_select(_OUTCOME)])
    args = [F.col(c) for c in ("url", "source", "auth", "cors", "status", "ct")]
    return o.select("page_id", "source", "url", classify.endpoint_risk(*args).alias("risk"), classify.risk_reason(*args).alias("reason"))


def _split_select(text_: str) -> list[str]:
    return ["page_id", "source", *[p.strip() for p in text_.split("source, ", 1)[1].split(", ")]]


@query(f"{_RISKS} SELECT * FROM risks")
def endpoint_risk(spark, d):
    return risk_rows(spark, d).drop("reason")


@query(f"{_RISKS} SELECT risk, count(*) AS endpoints, count(DISTINCT url) AS urls, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM risks GROUP BY risk")
def risk_summary(spark, d):
    return risk_rows(spark, d).groupBy("risk").agg(F.count("*").alias("endpoints"), F.countDistinct("url").alias("urls"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


# ---------------------------------------------------------------- DOM fields (no SQL: they need a tree)
def _dom(name: str, field: str):
    @query(name=name)
    def run(spark, d, field=field):
        return ex.extract(pages(spark, d), [field]).select("page_id", F.to_json(F.struct(F.col(field).alias("v"))).alias(field))

    return run


for _name, _field in (
    ("headings_dom", "headings"),
    ("semantic_zones", "zones"),
    ("forms_dom", "forms"),
    ("tables_dom", "tables"),
    ("lists_dom", "lists"),
    ("images_dom", "images"),
    ("links_dom", "links"),
    ("json_ld_dom", "json_ld"),
    ("opengraph_dom", "opengraph"),
    ("entities_dom", "entities"),
    ("meta_dom", "meta"),
    ("paragraphs_dom", "paragraphs"),
):
    _dom(_name, _field)


@query()
def main_content_dom(spark, d):
    return ex.extract(pages(spark, d), ["main_content"]).select("page_id", "main_content")


@query()
def css_select(spark, d):
    m = pages(spark, d).select("page_id", ex.select_css(F.col("html"), F.col("url"), "article > h1, nav li:first-child a[href]").alias("m"))
    return m.select("page_id", F.explode("m").alias("m")).select("page_id", "m.tag", "m.text", F.to_json("m.attrs").alias("attrs"))


@query()
def xpath_select(spark, d):
    m = pages(spark, d).select("page_id", ex.select_xpath(F.col("html"), "//nav//a/@href").alias("m"))
    return m.select("page_id", F.posexplode("m").alias("pos", "m")).select("page_id", "pos", F.col("m.text").alias("href"))


# ---------------------------------------------------------------- the pipeline
@query()
def merged_documents(spark, d):
    m = pipeline.run_pipeline(pages(spark, d))
    return m.select("url", "title", "description", "language", "page_type", "canonical_url", "confidence_score", "content_hash", F.array_join("conflicting_fields", ",").alias("conflicts"), "engines_used", "engines_succeeded", F.col("quality.quality_score").alias("quality_score"))


@query()
def audit_decisions_dom(spark, d):
    m = pipeline.merge(pipeline.engine_results(pages(spark, d)))
    return pipeline.decisions(m).select("url", "field", F.array_join("engines", ",").alias("engines"), "confidence", "conflict", "reason")


# ---------------------------------------------------------------- endpoints by pass
# pages with forms, comments, described interfaces and inline scripts put behind their own markup
_MINED = """html || CASE page_id % 3 WHEN 0 THEN '<form action="/api/login?b=2&a=1" method="post"><input name="user"><select name="lang"></select></form><form><input name="q"></form><!-- see /api/v1/debug and https://other.example.org/rest/x?y=1, /plain/page -->'
 WHEN 1 THEN '<a href="/v2/things/' || page_id || '.json">t</a><a href="/about">a</a><link rel="describedby" href="/openapi.yaml"><script>fetch("/api/v1/items"); const apiUrl = "/rest/orders"; fetch("relative")</script><script src="/x.js">fetch("/not/seen")</script>'
 ELSE '<script>axios.get("/api/v1/items"); axios.get("/api/v1/items")</script><a href="/api/v1/items">again</a>' END"""
_SCRIPT_TEXT = """'var post = fetch("/api/save"); $.post("/api/kept"); fetch("/api/v1/' || page_id || '?z=1&y=2"); fetch("https://cdn.example.net/api/x"); axios.post("http://localhost/api"); new WebSocket("wss://live.example.com/feed"); http.get("/a")' || chr(10) || '//# sourceMappingURL=app' || (page_id % 3) || '.js.map'"""


def _s_full(raw: str) -> str:
    return f"CASE WHEN starts_with({raw}, '/') THEN {s_part('url', 1)} || '://' || {s_part('url', 2)} || {raw} ELSE {raw} END"


def _s_found(rows: str, keys: str = "page_id") -> str:
    """From rows(page_id, url, kind, pos, method, source, raw, params): each URL once, by (kind, pos)."""
    same = f"lower({s_part('u', 1)}) = lower({s_part('url', 1)}) AND lower({s_part('u', 2)}) = lower({s_part('url', 2)})"
    return f"""r AS ({rows}), f AS (SELECT *, {_s_full('raw')} AS full_url FROM r), n AS (SELECT *, {s_normal('full_url', s_part('full_url', 3), ())} AS u FROM f WHERE lower({s_part('full_url', 1)}) IN ('http', 'https', 'ws', 'wss')),
found AS (SELECT {keys}, u AS url, method, source, params, NOT ({same}) AS external, kind, pos FROM n QUALIFY row_number() OVER (PARTITION BY {keys}, u ORDER BY kind, pos) = 1)"""


def _s_each(pattern: str, group: int = 1, text_: str = "h") -> str:
    return f"unnest(regexp_extract_all({text_}, {q(pattern)}, {group}))"


_S_ATTR = lambda a, n: f"regexp_extract({a}, {q(rf'''(?is)(?:^|\s){n}\s*=\s*[\"']([^\"']*)[\"']''')}, 1)"
_PAGE_FOUND = f"""h AS (SELECT page_id, url, {_MINED} AS h FROM pages), fo AS (SELECT page_id, url, {_s_each(ep.FORM, 1)} AS a, {_s_each(ep.FORM, 2)} AS b FROM h),
co AS (SELECT page_id, url, {_s_each(ep.COMMENT)} AS c FROM h), sc AS (SELECT page_id, url, {_s_each(ep.SCRIPT, 1)} AS a, {_s_each(ep.SCRIPT, 2)} AS b FROM h), si AS (SELECT page_id, url, b FROM sc WHERE NOT regexp_matches(a, '(?i)(?:^|\\s)src\\s*=')),
""" + _s_found(
    f"""SELECT page_id, url, 0 AS kind, row_number() OVER () AS pos, CASE WHEN {_S_ATTR('a', 'method')} = '' THEN 'GET' ELSE upper({_S_ATTR('a', 'method')}) END AS method, 'form' AS source, CASE WHEN {_S_ATTR('a', 'action')} = '' THEN url ELSE {_S_ATTR('a', 'action')} END AS raw, array_to_string(regexp_extract_all(b, {q(ep.FIELD)}, 1), ',') AS params FROM fo
UNION ALL SELECT * FROM (SELECT page_id, url, 1, row_number() OVER (), 'GET', 'html_href', {_s_each(ep.ANCHOR)} AS raw, '' FROM h) WHERE regexp_matches(raw, {q(C.API_HREF)})
UNION ALL SELECT * FROM (SELECT page_id, url, 2, row_number() OVER (), 'GET', 'html_comment', {_s_each(C.COMMENT_URL, 0, 'c')} AS raw, '' FROM co) WHERE regexp_matches(raw, {q(C.API_HREF)})
"""
    + "".join(f"UNION ALL SELECT * FROM (SELECT page_id, url, 3, row_number() OVER (), 'GET', 'js_inline', {_s_each(p, 1, 'b')} AS raw, '' FROM si) WHERE regexp_matches(raw, {q(C.API_HREF)}) OR starts_with(raw, '/')\n" for p in C.JS_PATTERNS.values())
)


@query(f"WITH {_PAGE_FOUND} SELECT page_id, url, method, source, params, external FROM found")
def page_endpoints(spark, d):
    """Endpoints that pages name in forms, links, comments and inline scripts."""
    return ep.in_pages(pages(spark, d).select("page_id", "url", F.expr(_MINED).alias("html")), ["page_id"])


@query(f"WITH h AS (SELECT page_id, url, {_MINED} AS h FROM pages) SELECT page_id, lower({s_part('url', 1)}) || '://' || lower({s_part('url', 2)}) || '/openapi.yaml' AS spec_url FROM h WHERE page_id % 3 = 1")
def page_specs(spark, d):
    """API descriptions that pages link to."""
    return ep.described_by(pages(spark, d).select("page_id", "url", F.expr(_MINED).alias("html")), ["page_id"])


@query(
    f"""WITH b AS (SELECT page_id, lower({s_part('url', 1)}) || '://' || lower({s_part('url', 2)}) AS o FROM pages)
SELECT page_id, 'wss://live.example.com/feed' AS url, 'WS' AS method, 'js_websocket' AS source, '' AS params, true AS external FROM b
UNION ALL SELECT page_id, o || '/static/app' || (page_id % 3) || '.js.map', 'GET', 'source_map', '', false FROM b
UNION ALL SELECT page_id, o || '/api/save', 'POST', 'js_regex', '', false FROM b UNION ALL SELECT page_id, o || '/api/kept', 'GET', 'js_regex', '', false FROM b UNION ALL SELECT page_id, o || '/api/v1/' || page_id || '?y=2&z=1', 'GET', 'js_regex', '', false FROM b
UNION ALL SELECT page_id, 'https://cdn.example.net/api/x', 'GET', 'js_external', '', true FROM b UNION ALL SELECT page_id, o || '/a', 'GET', 'js_regex', '', false FROM b"""
)
def script_endpoints(spark, d):
    """Endpoints that script files name: a file of known text for each page."""
    origin = F.concat(urls.part(F.col("url"), 1), F.lit("://"), urls.part(F.col("url"), 2))
    return ep.in_scripts(pages(spark, d).select("page_id", F.concat(origin, F.lit("/static/app.js")).alias("url"), F.expr(_SCRIPT_TEXT).alias("js")), ["page_id"])


@query(f"WITH {_PAGE_FOUND} SELECT url, method, arg_min(source, page_id) AS source, min(page_id) AS page_id FROM found GROUP BY url, method")
def distinct_endpoints(spark, d):
    """Each URL and method once over all pages, as the first page names it."""
    return ep.distinct(page_endpoints(spark, d), F.col("page_id"), []).select("url", "method", "source", "page_id")
