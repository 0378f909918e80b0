"""Queries on strategy records, version history, domain profiles, jobs and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions import classify, text
from ..operators import crawl, extract, history, merge, merge_fold, profile, quality
from . import pipeline
from . import queries_pages as qp
from .registry import any_of, clean, has, q, query, table

# ---------------------------------------------------------------- records of three strategies, natively
_H1 = clean("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1', 1)")
_HREFS = f"list_distinct(regexp_extract_all(html, {q(qp._LINK)}, 1))"
_VIS = f"substr({qp._VISIBLE}, 1, {C.CAPS['main_content']})"
_ER = f"""er AS (
  SELECT url, page_id, 'static_requests' AS engine_id, 0 AS rank, true AS success, {qp.S_TITLE} AS title, coalesce({qp.S_LANG}, 'unknown') AS language, {_VIS} AS body, regexp_extract_all(html, {q(qp._LINK)}, 1) AS links, CASE WHEN NOT contains(html, '</html>') THEN 'parse warning' ELSE '' END AS warning, (page_id % 13) / 10.0::DOUBLE AS elapsed FROM pages
  UNION ALL SELECT url, page_id, 'structured_metadata', 6, page_id % 4 <> 1, {_H1}, CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE coalesce({qp.S_LANG}, 'unknown') END, {_H1}, [], CASE WHEN page_id % 7 = 0 THEN 'connection error' ELSE '' END, (page_id % 11) / 10.0::DOUBLE FROM pages
  UNION ALL SELECT url, page_id, 'search_index', 10, page_id % 5 <> 2, CASE WHEN page_id % 2 = 0 THEN '  ' || {qp.S_TITLE} ELSE left({qp.S_TITLE}, 20) END, 'en', substr({_VIS}, 1, 300), regexp_extract_all(html, {q(qp._LINK)}, 1)[1:3], CASE WHEN page_id % 6 = 0 THEN 'timeout' ELSE '' END, (page_id % 7) / 10.0::DOUBLE FROM pages
)"""
_W = "CASE engine_id " + " ".join(f"WHEN '{e}' THEN {w}::DOUBLE" for e, w in C.ENGINE_WEIGHTS.items()) + f" ELSE {C.DEFAULT_WEIGHT}::DOUBLE END"
_LONG = f"""{_ER}, lf AS (SELECT url, engine_id, rank, 'title' AS field, title AS value FROM er WHERE success AND title <> '' UNION ALL SELECT url, engine_id, rank, 'language', language FROM er WHERE success AND language <> ''),
nv AS (SELECT *, lower({clean('value')}) AS norm, {_W} AS w FROM lf)"""


def records(spark, d) -> DataFrame:
    h = F.col("html")
    title, lang = classify.title(h), F.coalesce(classify.language(h), F.lit("unknown"))
    h1 = text.sanitize(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1", 1))
    v = F.regexp_replace(F.regexp_replace(h, extract.SCRIPTS, " "), "<[^>]*>", " ")
    body = F.substring(F.trim(F.regexp_replace(v, r"\s+", " ")), 1, C.CAPS["main_content"])
    hrefs = F.regexp_extract_all(h, F.lit(qp._LINK), F.lit(1))
    p, none = F.col("page_id"), F.array().cast("array<string>")
    warn = lambda c, t: F.when(c, F.array(F.lit(t))).otherwise(none)
    base = qp.pages(spark, d).select("url", "page_id", title.alias("t"), lang.alias("g"), h1.alias("h1"), body.alias("body"), hrefs.alias("hrefs"), (~F.contains(h, F.lit("</html>"))).alias("cut"))

    def record(engine, ok, t, g, b, links, warnings, elapsed):
        return F.struct(F.lit(engine).alias("engine_id"), F.lit(C.ENGINE_RANK[engine]).alias("engine_rank"), ok.alias("success"), t.alias("title"), g.alias("language"), b.alias("body"), links.alias("links"), warnings.alias("warnings"), elapsed.alias("elapsed"))

    three = F.array(
        record("static_requests", F.lit(True), F.col("t"), F.col("g"), F.col("body"), F.col("hrefs"), warn(F.col("cut"), "parse warning"), p % 13 / 10.0),
        record("structured_metadata", p % 4 != 1, F.col("h1"), F.when(p % 3 == 0, "unknown").otherwise(F.col("g")), F.col("h1"), none, warn(p % 7 == 0, "connection error"), p % 11 / 10.0),
        record("search_index", p % 5 != 2, F.when(p % 2 == 0, F.concat(F.lit("  "), F.col("t"))).otherwise(F.left("t", F.lit(20))), F.lit("en"), F.substring("body", 1, 300), F.slice("hrefs", 1, 3), warn(p % 6 == 0, "timeout"), p % 7 / 10.0),
    )
    return base.select("url", "page_id", F.inline(three))


def values(spark, d) -> DataFrame:
    return merge.long_form(records(spark, d), ("title", "language"))


@query(f"WITH {_LONG} SELECT url, engine_id, field, value FROM nv")
def engine_results_long(spark, d):
    return values(spark, d).select("url", "engine_id", "field", "value")


_VOTE = f"""{_LONG}, per AS (SELECT url, field, norm, sum(w) AS w, min(rank) AS r, min_by(value, rank) AS value FROM nv GROUP BY ALL),
vote AS (SELECT url, field, value AS winner, round(w / sum(w) OVER (PARTITION BY url, field), 3) AS agreement, row_number() OVER (PARTITION BY url, field ORDER BY round(w, 6) DESC, r) AS k FROM per QUALIFY k = 1)"""


@query(f"WITH {_VOTE} SELECT url, field, winner, agreement FROM vote")
def vote_exact(spark, d):
    return merge.vote_exact(values(spark, d))


@query()
def vote_clustered(spark, d):
    g = values(spark, d).groupBy("url", "field").agg(F.array_sort(F.collect_list(F.struct("engine_rank", "engine_id", "value"))).alias("v"))

    def vote(rows):
        norms = [merge_fold.normal(r["value"]) for r in rows]
        winner, agreement = merge_fold.vote(norms, [r["engine_id"] for r in rows])
        return {"winner": "" if winner is None else norms[winner], "agreement": agreement}

    return g.select("url", "field", F.udf(vote, "struct<winner:string,agreement:double>", useArrow=True)("v").alias("r")).select("url", "field", "r.*")


_BW = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda x: x <> ''))"


@query(
    f"""WITH {_ER}, v AS (SELECT url, rank, body AS value, {_W} AS w FROM er WHERE success AND body <> ''),
b AS (SELECT url, value AS best FROM v QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(value) DESC, rank) = 1)
SELECT url, any_value(best) AS value, round(sum(CASE WHEN len(list_intersect({_BW.format('best')}, {_BW.format('value')})) >= 0.5 * len({_BW.format('best')}) THEN w ELSE 0 END) / sum(w), 3) AS agreement
FROM v JOIN b USING (url) GROUP BY url"""
)
def longest_value(spark, d):
    return merge.longest_value(records(spark, d), "body", tie="page_id")


@query(
    f"""WITH {_ER}, l AS (SELECT url, engine_id, rank, unnest(links) AS href, generate_subscripts(links, 1) AS pos FROM er WHERE success)
SELECT url, href, engine_id FROM l QUALIFY row_number() OVER (PARTITION BY url, href ORDER BY rank, pos) = 1"""
)
def union_links(spark, d):
    return merge.union_links(records(spark, d))


@query(f"WITH {_ER} SELECT url, round(sum(CASE WHEN len(links) > 0 THEN {_W} ELSE 0 END) / sum({_W}), 3) AS agreement FROM er WHERE success GROUP BY url")
def list_agreement(spark, d):
    return merge.list_agreement(records(spark, d))


_REL = f"rel AS (SELECT url, round(avg(success::INT) * (1 - least(0.04::DOUBLE * count(*) FILTER ({has('warning', C.RELIABILITY_PENALTY)}), 0.25)), 3) AS reliability FROM er GROUP BY url)"


@query(f"WITH {_ER}, {_REL} SELECT url, reliability FROM rel")
def reliability(spark, d):
    return merge.reliability(records(spark, d))


_NOISY = any_of("lower(title)", C.NOISE_WORDS)
_TQ = f"""CASE WHEN coalesce(title, '') = '' THEN 0.0::DOUBLE ELSE round(((length(trim(title)) BETWEEN 10 AND 120)::INT + (NOT {_NOISY})::INT + (lower(trim(title)) <> '' AND lower(trim(title)) <> lower(url))::INT + (language NOT IN ('', 'unknown'))::INT) / 4.0::DOUBLE, 3) END"""


@query(f"WITH {_ER} SELECT url, engine_id, {_TQ} AS quality FROM er")
def field_quality(spark, d):
    return records(spark, d).select("url", "engine_id", merge.title_quality(F.col("title"), F.col("url"), F.col("language")).alias("quality"))


_CONF = f"""{_VOTE}, {_REL}, doc AS (SELECT t.url, t.winner AS title, t.agreement AS ta, g.winner AS language, g.agreement AS ga FROM vote t JOIN vote g ON g.url = t.url AND g.field = 'language' WHERE t.field = 'title'),
cf AS (SELECT url, title, language, round(0.5 * ta + 0.3 * ({_TQ}) + 0.2 * reliability, 3) AS tc, round(0.5 * ga + 0.3 * (CASE WHEN language IN ('', 'unknown') THEN 0 ELSE 1 END) + 0.2 * reliability, 3) AS gc FROM doc JOIN rel USING (url)),
conf AS (SELECT url, tc AS title_confidence, gc AS language_confidence, round((tc * 0.15 + gc * 0.03) / 0.18, 3) AS score FROM cf)"""


def confidences(spark, d) -> DataFrame:
    r = records(spark, d)
    v = merge.vote_exact(merge.long_form(r, ("title", "language")))
    wide = v.groupBy("url").agg(*[F.max(F.when(F.col("field") == f, F.col(c))).alias(f"{f}_{c}") for f in ("title", "language") for c in ("winner", "agreement")])
    wide = wide.where("title_winner IS NOT NULL AND language_winner IS NOT NULL").join(merge.reliability(r), "url")
    tq = merge.title_quality(F.col("title_winner"), F.col("url"), F.col("language_winner"))
    gq = F.when(F.col("language_winner").isin("", "unknown"), 0.0).otherwise(1.0)
    out = wide.select("url", merge.confidence(F.col("title_agreement"), tq, F.col("reliability")).alias("title_confidence"), merge.confidence(F.col("language_agreement"), gq, F.col("reliability")).alias("language_confidence"))
    tw, gw = C.FIELD_IMPORTANCE["title"], C.FIELD_IMPORTANCE["language"]
    return out.withColumn("score", F.round((F.col("title_confidence") * tw + F.col("language_confidence") * gw) / (tw + gw), 3))


@query(f"WITH {_CONF} SELECT * FROM conf")
def confidence(spark, d):
    return confidences(spark, d)


@query(f"WITH {_LONG} SELECT url, field, count(DISTINCT norm) AS n FROM nv WHERE norm NOT IN ('', 'unknown') GROUP BY ALL HAVING count(DISTINCT norm) > 1")
def conflicts(spark, d):
    return merge.conflicts(values(spark, d))


@query(f"WITH {_LONG} SELECT url, field, string_agg(engine_id, ',' ORDER BY rank, engine_id) AS engines FROM nv GROUP BY ALL")
def contributions(spark, d):
    return merge.contributions(values(spark, d))


@query(
    f"""WITH {_VOTE}, c AS (SELECT url, field, count(DISTINCT norm) FILTER (norm NOT IN ('', 'unknown')) > 1 AS conflict, string_agg(engine_id, ',' ORDER BY rank, engine_id) AS engines FROM nv GROUP BY ALL)
SELECT url, field, winner, engines, conflict, 'weighted_cluster_majority' || CASE WHEN conflict THEN ' (conflict)' ELSE '' END AS reason FROM vote JOIN c USING (url, field)"""
)
def audit_decisions(spark, d):
    v = values(spark, d)
    won = merge.vote_exact(v).drop("agreement").join(merge.contributions(v), ["url", "field"])
    hit = merge.conflicts(v).select("url", "field", F.lit(True).alias("c"))
    out = won.join(hit, ["url", "field"], "left").withColumn("conflict", F.coalesce("c", F.lit(False))).drop("c")
    return out.withColumn("reason", F.concat(F.lit("weighted_cluster_majority"), F.when(F.col("conflict"), " (conflict)").otherwise("")))


@query(f"WITH {_VOTE}, c AS (SELECT url, field, count(DISTINCT norm) FILTER (norm NOT IN ('', 'unknown')) > 1 AS conflict FROM nv GROUP BY ALL) SELECT field, count(*) AS decisions, count(*) FILTER (conflict) AS conflicts FROM c GROUP BY field")
def audit_totals(spark, d):
    a = audit_decisions(spark, d)
    return a.groupBy("field").agg(F.count("*").alias("decisions"), F.count_if("conflict").alias("conflicts"))


# first and second attempts: the score less 0.5 and the title's confidence less 0.5
@query(
    f"""WITH {_CONF}, t AS (SELECT url, round(score - 0.5, 3) AS a, round(title_confidence - 0.5, 3) AS b FROM conf)
SELECT url, CASE WHEN a < {C.RESCRAPE_CONFIDENCE} AND b > a THEN b ELSE a END AS confidence_score, CASE WHEN a < {C.RESCRAPE_CONFIDENCE} AND b > a THEN 'retry' ELSE 'first' END AS kept FROM t"""
)
def confidence_gate(spark, d):
    """Weak documents are replaced by their retry where that is strictly better."""
    c = confidences(spark, d)
    attempt = lambda score, name: c.select("url", F.round(F.col(score) - 0.5, 3).alias("confidence_score"), F.lit(name).alias("kept"))
    return pipeline.confidence_gate(attempt("score", "first"), attempt("title_confidence", "retry"))


_GARBLED = "(length(coalesce(body, '')) < 20 OR " + has("body", C.GARBAGE_RUN) + f" OR length(regexp_replace(coalesce(body, ''), '[^\\p{{L}}]', '', 'g'))::DOUBLE / greatest(length(coalesce(body, '')), 1) < {C.MIN_ALPHA_RATIO})"


@query(
    f"""WITH {_ER}, q AS (SELECT url, engine_id, list_filter([CASE WHEN page_id % 9 = 0 THEN 'missing required field: title' END, CASE WHEN elapsed > 1 THEN 'confidence_score out of range: ' || elapsed END], lambda x: x IS NOT NULL) AS errors, {_GARBLED} AS garbage FROM er)
SELECT url, engine_id, nullif(array_to_string(errors, '; '), '') AS errors, garbage, round(((len(errors) = 0)::INT + 1 + 0 + 1) / 4.0::DOUBLE, 3) AS quality_score FROM q"""
)
def schema_validation(spark, d):
    """Quality notes on strategy records; every ninth title is missing, some scores are out of range, descriptions are empty and thus garbage."""
    r = records(spark, d).select(
        "url", "engine_id", F.when(F.col("page_id") % 9 != 0, F.col("title")).alias("title"), F.lit("").alias("description"), F.col("body").alias("main_content"), F.col("elapsed").alias("confidence_score"), F.lit(None).cast(f"{schemas.ENTITIES}").alias("entities")
    )
    q = pipeline.annotate_quality(r)
    return q.select("url", "engine_id", F.nullif(F.array_join("quality.schema_errors", "; "), F.lit("")).alias("errors"), F.col("quality.garbage_main_content").alias("garbage"), F.col("quality.quality_score").alias("quality_score"))


@query(f"WITH {_ER} SELECT url, engine_id, length(body) >= {C.THIN_HYBRID} AS enough FROM er WHERE success AND body <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(body) >= {C.THIN_HYBRID} DESC, CASE WHEN length(body) >= {C.THIN_HYBRID} THEN 0 ELSE -length(body) END, rank) = 1")
def hybrid_choice(spark, d):
    """The first strategy in rank order that found enough text, else the one that found most."""
    r = records(spark, d).where(F.col("success") & (F.coalesce("body", F.lit("")) != ""))
    n = F.char_length("body")
    order = F.struct((n < C.THIN_HYBRID).alias("thin"), F.when(n < C.THIN_HYBRID, -n).otherwise(0).alias("n"), F.col("engine_rank").alias("r"))
    return r.groupBy("url").agg(F.min_by("engine_id", order).alias("engine_id"), (F.max(n) >= C.THIN_HYBRID).alias("enough"))


# Levenshtein similarity of the titles that a page's strategies found; a page has few strategies
@query()
def title_similarity(spark, d):
    v = merge.long_form(records(spark, d), ("title",)).select("url", "engine_id", "engine_rank", text.normal(F.col("value")).alias("norm"))
    g = v.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("engine_rank", "engine_id", "norm"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    p = g.select("url", F.explode(pairs).alias("p"))
    x, y = F.col("p.x.norm"), F.col("p.y.norm")
    return p.select("url", F.col("p.x.engine_id").alias("a"), F.col("p.y.engine_id").alias("b"), F.levenshtein(x, y).cast("long").alias("distance"), F.round(text.lev_similarity(x, y), 6).alias("similarity"))


# ---------------------------------------------------------------- history
_HIST = "hist AS (SELECT conv_id, turn, md5(text) AS content_hash, length(text) - length(replace(text, '.', '')) AS headings, length(text) - length(replace(text, ' ', '')) AS links FROM conversations)"


def hist(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    n = lambda ch: F.char_length("text") - F.char_length(F.replace("text", F.lit(ch), F.lit("")))
    return c.select("conv_id", "turn", F.md5("text").alias("content_hash"), n(".").cast("long").alias("headings"), n(" ").cast("long").alias("links"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
def next_version(spark, d):
    return history.with_versions(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "version")


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_snapshot(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return history.latest(o, "o_custkey", "o_orderdate", "o_orderkey")


@query(
    f"""WITH {_HIST}, l AS (SELECT *, lag(content_hash) OVER w AS b, headings - coalesce(lag(headings) OVER w, 0) AS delta FROM hist WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, b IS NULL OR b <> content_hash AS changed, CASE WHEN b IS NULL OR b <> content_hash THEN b END AS previous_hash,
  CASE WHEN b IS NULL THEN 'first_crawl' WHEN b = content_hash THEN 'no change' WHEN delta > 0 THEN '+' || delta || ' headings' WHEN delta < 0 THEN delta || ' headings' ELSE 'content updated' END AS diff_summary FROM l"""
)
def change_detection(spark, d):
    return history.changes(hist(spark, d), "conv_id", "turn").select("conv_id", "turn", "changed", "previous_hash", "diff_summary")


_PAIRS = f"WITH {_HIST}, p AS (SELECT b.conv_id, b.turn, a.content_hash AS h1, b.content_hash AS h2, a.headings AS n1, b.headings AS n2, a.links AS l1, b.links AS l2 FROM hist a JOIN hist b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


@query(f"{_PAIRS} SELECT conv_id, turn FROM p WHERE h1 <> h2 AND (abs(greatest(n1, 1) - greatest(n2, 1)) / greatest(n1, 1) > 0.40 OR abs(greatest(l1, 1) - greatest(l2, 1)) / greatest(l1, 1) > 0.40)")
def redesign_suspects(spark, d):
    p = history.version_pairs(hist(spark, d), "conv_id", "turn")
    return p.where(history.redesigned(*[F.col(c) for c in ("a_headings", "b_headings", "a_links", "b_links", "a_content_hash", "b_content_hash")])).select("conv_id", "turn")


@query(f"{_PAIRS} SELECT conv_id, turn, n2 - n1 AS heading_delta, l2 - l1 AS link_delta, h1 <> h2 AS hash_changed FROM p")
def version_meta_diff(spark, d):
    p = history.version_pairs(hist(spark, d), "conv_id", "turn")
    return p.select("conv_id", "turn", (F.col("b_headings") - F.col("a_headings")).alias("heading_delta"), (F.col("b_links") - F.col("a_links")).alias("link_delta"), (F.col("a_content_hash") != F.col("b_content_hash")).alias("hash_changed"))


@query()
def version_text_diff(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    p = history.version_pairs(c, "conv_id", "turn")
    return p.select("conv_id", "turn", history.text_diff(F.col("a_text"), F.col("b_text")).alias("diff"))


@query("SELECT conv_id, max(turn) AS latest_version, count(*) AS versions FROM conversations GROUP BY conv_id")
def tracked_urls(spark, d):
    return history.tracked(table(spark, d, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 1 ORDER BY turn DESC LIMIT 3 OFFSET 1")
def history_page(spark, d):
    return history.page(table(spark, d, "conversations"), "conv_id", 1, "turn", 3, 1).select("conv_id", "turn", "role")


# ---------------------------------------------------------------- profiles
_ENG = "CASE event_id % 5 WHEN 0 THEN 'static_requests' WHEN 1 THEN 'static_httpx' WHEN 2 THEN 'search_index' WHEN 3 THEN 'hybrid' ELSE 'visual_ocr' END"
_OUT = f"oc AS (SELECT user_id % 40 AS domain, {_ENG} AS engine_id, event_type <> 'error' AND NOT (user_id % 40 = 7 AND event_id % 5 = 3) AS ok, value * 100 AS elapsed_ms, ts, event_id, value FROM events)"
_SCORES = f"{_OUT}, sc AS (SELECT domain, engine_id, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS fail, avg(elapsed_ms) AS avg_ms FROM oc GROUP BY ALL), sr AS (SELECT *, ok / (ok + fail) AS rate FROM sc)"


def outcomes(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    ok = (F.col("event_type") != "error") & ~((F.col("user_id") % 40 == 7) & (F.col("event_id") % 5 == 3))
    return e.select((F.col("user_id") % 40).alias("domain"), F.expr(_ENG).alias("engine_id"), ok.alias("ok"), (F.col("value") * 100).alias("elapsed_ms"), "ts", "event_id", "value")


@query(f"WITH {_SCORES} SELECT domain, engine_id, ok, fail, round(avg_ms, 6) AS avg_ms, rate FROM sr")
def engine_scores(spark, d):
    return profile.engine_scores(outcomes(spark, d)).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"WITH {_SCORES} SELECT domain, engine_id AS best_engine, rate FROM sr QUALIFY row_number() OVER (PARTITION BY domain ORDER BY rate DESC, engine_id) = 1")
def best_engine(spark, d):
    return profile.best_engine(profile.engine_scores(outcomes(spark, d)))


@query(f"WITH {_SCORES} SELECT domain, engine_id FROM sr WHERE ok + fail >= 3 AND fail / (ok + fail) >= 0.70")
def engines_to_skip(spark, d):
    return profile.engines_to_skip(profile.engine_scores(outcomes(spark, d)))


@query(f"WITH {_OUT} SELECT domain, round(avg(elapsed_ms), 6) AS avg_load_ms, CASE WHEN avg(elapsed_ms) <= 0 THEN 30.0 ELSE round(greatest(10.0, least(avg(elapsed_ms) * 3 / 1000, 120.0)), 1) END AS timeout_s FROM oc GROUP BY domain")
def recommended_timeout(spark, d):
    return profile.recommended_timeout(outcomes(spark, d)).withColumn("avg_load_ms", F.round("avg_load_ms", 6))


@query(f"WITH {_SCORES}, runs AS (SELECT domain, sum(ok + fail) AS runs FROM sr GROUP BY domain HAVING sum(ok + fail) >= 3) SELECT domain, engine_id, row_number() OVER (PARTITION BY domain ORDER BY rate DESC, engine_id) AS rank FROM sr JOIN runs USING (domain)")
def preferred_engines(spark, d):
    return profile.preferred(profile.engine_scores(outcomes(spark, d)))


_FIELDS = f"{_OUT}, fo AS (SELECT domain, engine_id, 'title' AS field, ok FROM oc UNION ALL SELECT domain, engine_id, 'links', value > 20 FROM oc), fa AS (SELECT domain, engine_id, field, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS fail FROM fo GROUP BY ALL)"


def accuracy(spark, d) -> DataFrame:
    return profile.field_accuracy(outcomes(spark, d).withColumn("has_links", F.col("value") > 20), {"title": "ok", "links": "has_links"})


@query(f"WITH {_FIELDS} SELECT * FROM fa")
def field_accuracy(spark, d):
    return accuracy(spark, d)


@query(f"WITH {_FIELDS} SELECT domain, field, engine_id FROM fa WHERE ok + fail >= 2 AND ok > 0 QUALIFY row_number() OVER (PARTITION BY domain, field ORDER BY ok / (ok + fail) DESC, engine_id) = 1")
def best_engine_for_field(spark, d):
    return profile.best_for_field(accuracy(spark, d))


@query(
    """WITH h AS (SELECT user_id, ts, event_id, event_type <> 'error' AS hit FROM events), c AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS hit_count FROM h),
m AS (SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY user_id, hit_count ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS miss_streak FROM c)
SELECT user_id, event_id, hit_count, miss_streak, miss_streak >= 3 AS dead FROM m"""
)
def miss_streaks(spark, d):
    h = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("hit"))
    return profile.miss_streaks(h, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "hit_count", "miss_streak", "dead")


@query("SELECT user_id AS domain, count(*) AS n, avg((event_type = 'error')::INT) AS failed FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id HAVING count(*) >= 3 AND avg((event_type = 'error')::INT) >= 0.7")
def circuit_breaker(spark, d):
    e = table(spark, d, "events").where("event_type IN ('error', 'signup')").select(F.col("user_id").alias("domain"), (F.col("event_type") != "error").alias("ok"))
    return profile.circuit_open(e)


@query(f"WITH {_OUT}, b(le) AS (VALUES {', '.join(f'({b}::DOUBLE)' for b in C.LATENCY_BUCKETS)}) SELECT engine_id, le, count(*) FILTER (value <= le) AS n FROM oc CROSS JOIN b GROUP BY ALL")
def latency_histogram(spark, d):
    return profile.latency_histogram(outcomes(spark, d), "value")


@query("SELECT user_id, event_id, sum(event_id % 1000) OVER w AS total, sum(event_id % 1000) OVER w <= 20000 AS within FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)".replace("sum(event_id % 1000) OVER w AS", "(sum(event_id % 1000) OVER w)::BIGINT AS"))
def byte_budget(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 1000).alias("bytes"))
    return profile.byte_budget(e, "user_id", "event_id", "bytes", 20000).select("user_id", "event_id", "total", "within")


@query("SELECT user_id AS domain, event_id, round(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6, 3) AS gap_s, coalesce(round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 3) >= 60, true) AS kept FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)".replace("round(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6, 3)", "round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 3)"))
def crawl_gap(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("domain"), "event_id", "ts")
    return crawl.crawl_gaps(e, 60.0).select("domain", "event_id", "gap_s", "kept")


@query("SELECT user_id, event_id, 0.15 + (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::DOUBLE / count(*) OVER (PARTITION BY user_id) * 0.60 AS pct FROM events")
def progress_pct(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    done = F.row_number().over(w.orderBy("ts", "event_id")) / F.count("*").over(w)
    return table(spark, d, "events").select("user_id", "event_id", (0.15 + done * 0.60).alias("pct"))


# ---------------------------------------------------------------- jobs and errors
_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'done' ELSE 'failed' END"
_JOBS = f"jobs AS (SELECT user_id AS job_id, arg_max({_STATUS}, struct_pack(a := ts, b := event_id)) AS status, min(ts) AS created, count(*) AS events FROM events GROUP BY user_id)"


def jobs(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.expr(_STATUS).alias("status"), "ts", "event_id")
    return e.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.min("ts").alias("created"), F.count("*").alias("events"))


@query(f"WITH {_JOBS} SELECT job_id, CASE WHEN status = 'running' THEN 'pending' ELSE status END AS status, created, events FROM jobs")
def job_latest_status(spark, d):
    """Latest status of each job; jobs that were running at a crash are pending again."""
    return jobs(spark, d).withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


@query(f"WITH {_JOBS} SELECT status, count(*) AS jobs FROM jobs GROUP BY status")
def job_counts(spark, d):
    return jobs(spark, d).groupBy("status").agg(F.count("*").alias("jobs"))


@query(f"WITH {_JOBS} SELECT job_id, events AS priority FROM jobs WHERE status NOT IN ('paused', 'done', 'failed') ORDER BY events, job_id LIMIT 20")
def queue_order(spark, d):
    return jobs(spark, d).where("status NOT IN ('paused', 'done', 'failed')").select("job_id", F.col("events").alias("priority")).orderBy("priority", "job_id").limit(20)


_MESSAGES = """CASE event_id % 17 WHEN 0 THEN 'Timeout after 30s' WHEN 1 THEN 'HTTP 403 Forbidden' WHEN 2 THEN '404 not found' WHEN 3 THEN 'empty page' WHEN 4 THEN 'lxml parse failure' WHEN 5 THEN 'SSL handshake' WHEN 6 THEN 'Connection refused'
 WHEN 7 THEN 'ollama down' WHEN 8 THEN '502 bad gateway' WHEN 9 THEN 'chromium crashed' WHEN 10 THEN '' WHEN 11 THEN 'robots disallow' WHEN 12 THEN '429 too many requests' WHEN 13 THEN 'module x not installed' WHEN 14 THEN 'job cancelled' WHEN 15 THEN 'byte budget exceeded' ELSE 'something else' END"""
_CATEGORY = "CASE WHEN m = '' THEN 'unknown' " + " ".join(f"WHEN {has('m', p)} THEN '{n}'" for n, p in C.ERROR_TAXONOMY) + " ELSE 'unknown' END"
_CODE = "CASE WHEN m = '' THEN 'E901' " + " ".join(f"WHEN {any_of('lower(m)', w)} THEN '{c}'" for w, c in C.ERROR_WORDS) + " ELSE 'E901' END"
_CODES = ", ".join(f"('{c}', '{n}', '{g}', {str(r).lower()})" for c, (n, g, r) in C.ERROR_CODES.items())


def messages(spark, d) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", F.expr(_MESSAGES).alias("m"))


_ERRORS = f"e AS (SELECT event_id, {_MESSAGES} AS m FROM events WHERE event_type = 'error')"


@query(f"WITH {_ERRORS} SELECT event_id, {_CATEGORY} AS category, {any_of('lower(m)', C.TRANSIENT_WORDS)} AS transient FROM e")
def error_taxonomy(spark, d):
    return messages(spark, d).select("event_id", classify.error_category(F.col("m")).alias("category"), classify.is_transient(F.col("m")).alias("transient"))


@query(f"WITH {_ERRORS}, c AS (SELECT event_id, {_CODE} AS code FROM e), k(code, name, category, retryable) AS (VALUES {_CODES}) SELECT event_id, code, name, category, retryable FROM c JOIN k USING (code)")
def error_code(spark, d):
    codes = spark.createDataFrame([(c, *v) for c, v in C.ERROR_CODES.items()], "code string, name string, category string, retryable boolean")  # thirty fixed rows
    return messages(spark, d).select("event_id", classify.error_code(F.col("m")).alias("code")).join(F.broadcast(codes), "code").select("event_id", "code", "name", "category", "retryable")


@query(f"WITH {_ERRORS} SELECT {_CATEGORY} AS category, count(*) AS errors FROM e GROUP BY 1")
def error_metrics(spark, d):
    return messages(spark, d).groupBy(classify.error_category(F.col("m")).alias("category")).agg(F.count("*").alias("errors"))


# ---------------------------------------------------------------- checklists of all fields
# pages with images, structured data, a description and a canonical link put behind their own markup
_RICH = """html || '<img src="//cdn.example.net/' || page_id || '.png"><img src="local.png">' || CASE page_id % 3 WHEN 0 THEN '<script type="application/ld+json">{"@type":"Article"}</script><meta property="og:title" content="T">' WHEN 1 THEN '<meta property="og:title" content="T"><meta name="description" content="A description that is long enough to pass, of page ' || page_id || ' and more words">' ELSE '<meta name="description" content="Read more"><a href="http://x.example.org/javascript:void">j</a>' END || CASE WHEN page_id % 2 = 0 THEN '<link rel="canonical" href="https://c.example.org/' || page_id || '">' ELSE '<link rel="canonical" href="/relative">' END"""
_R_DESC = r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)"""
_R_CANON = r"""(?is)<link[^>]+rel=["']canonical["'][^>]+href=["']([^"']*)"""
_R_IMG = r"""(?is)<img[^>]+src=["']([^"']*)"""
_R_HEAD = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]"
_R_HREF = r"""(?is)<a[^>]+href=["']([^"']*)"""
_RICH_DOCS = f"""rich AS (SELECT page_id, url, {_RICH} AS html FROM pages), rd AS (SELECT page_id, url, {qp.S_TITLE} AS title, regexp_extract(html, {q(_R_DESC)}, 1) AS description, {_VIS} AS main_content, coalesce({qp.S_LANG}, 'unknown') AS language, regexp_extract(html, {q(_R_CANON)}, 1) AS canonical_url,
  regexp_extract_all(html, {q(_R_HREF)}, 1) AS links, regexp_extract_all(html, {q(_R_IMG)}, 1) AS images, regexp_extract_all(html, {q(_R_HEAD)}, 1) AS levels, regexp_extract_all(html, {q(_R_HEAD)}, 2) AS heads, contains(html, 'application/ld+json') AS json_ld, contains(html, 'property="og:') AS opengraph FROM rich),
h1 AS (SELECT *, list_filter([CASE WHEN levels[i] = '1' THEN lower(heads[i]) END for i in range(1, len(levels) + 1)], lambda x: x IS NOT NULL) AS firsts FROM rd)"""
_NOISE = lambda c: any_of(f"lower({c})", C.NOISE_WORDS)
_WORDS_OF = "list_filter(string_split_regex(trim(main_content), '\\s+'), lambda w: w <> '')"
_CHECKS = {
    "title": _TQ,
    "description": f"CASE WHEN description = '' THEN 0 ELSE round(((length(trim(description)) BETWEEN 50 AND 500)::INT + (lower(trim(description)) <> lower(trim(title)))::INT + (NOT {_NOISE('description')})::INT) / 3.0::DOUBLE, 3) END",
    "main_content": f"CASE WHEN main_content = '' THEN 0 ELSE round(((length(trim(main_content)) > 300)::INT + (length(array_to_string({_WORDS_OF}, '')) / greatest(len({_WORDS_OF}), 1) >= 4.0)::INT + (len(regexp_extract_all(trim(main_content), '\\p{{L}}')) / greatest(length(trim(main_content)), 1) >= 0.6)::INT) / 3.0::DOUBLE, 3) END",
    "links": "CASE WHEN len(links) = 0 THEN 0 ELSE round(len(list_filter(links, lambda u: regexp_matches(u, '^https?://') AND NOT contains(u, 'javascript:'))) / len(links)::DOUBLE, 3) END",
    "images": "CASE WHEN len(images) = 0 THEN 0 ELSE round(len(list_filter(images, lambda u: regexp_matches(u, '^(?:https?:)?//'))) / len(images)::DOUBLE, 3) END",
    "headings": "CASE WHEN len(levels) = 0 THEN 0 ELSE 0.5 * (len(firsts) > 0)::INT + 0.5 * (len(list_filter(string_split_regex(lower(trim(title)), '\\s+'), lambda w: length(w) > 3 AND len(list_filter(firsts, lambda h: contains(h, w))) > 0)) > 0)::INT END",
    "structured_data": "0.5 * json_ld::INT + 0.5 * opengraph::INT",
    "canonical_url": "regexp_matches(trim(canonical_url), '^https?://')::INT",
    "language": "(lower(trim(language)) NOT IN ('', 'unknown', 'none'))::INT",
}
_CHECKED = f"{_RICH_DOCS}, fq AS (" + " UNION ALL ".join(f"SELECT page_id, url, '{f}' AS field, ({e})::DOUBLE AS quality FROM h1" for f, e in _CHECKS.items()) + ")"


def rich_documents(spark, d) -> DataFrame:
    """Every field that has a checklist, from the page's own markup."""
    p = qp.pages(spark, d).select("page_id", "url", F.expr(_RICH).alias("html"))
    h = F.col("html")
    visible = F.regexp_replace(F.regexp_replace(h, extract.SCRIPTS, " "), "<[^>]*>", " ")
    of = lambda pattern, k=1: F.regexp_extract_all(h, F.lit(pattern), F.lit(k))
    heads = F.zip_with(of(_R_HEAD, 1), of(_R_HEAD, 2), lambda n, t: F.struct(n.cast("int").alias("level"), t.alias("text")))
    return p.select(
        "page_id", "url", classify.title(h).alias("title"), F.regexp_extract(h, _R_DESC, 1).alias("description"), F.substring(F.trim(F.regexp_replace(visible, r"\s+", " ")), 1, C.CAPS["main_content"]).alias("main_content"),
        F.coalesce(classify.language(h), F.lit("unknown")).alias("language"), F.regexp_extract(h, _R_CANON, 1).alias("canonical_url"), of(_R_HREF).alias("links"), of(_R_IMG).alias("images"), heads.alias("headings"),
        F.contains(h, F.lit("application/ld+json")).alias("json_ld"), F.contains(h, F.lit('property="og:')).alias("opengraph"),
    )


@query(f"WITH {_CHECKED} SELECT page_id, field, quality FROM fq")
def field_checklists(spark, d):
    """The quality of nine fields of every page."""
    return quality.scores(rich_documents(spark, d), ["page_id"])


_IMPORTANCE = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}::DOUBLE" for f, w in C.FIELD_IMPORTANCE.items()) + f" ELSE {C.DEFAULT_IMPORTANCE}::DOUBLE END"


@query(
    f"""WITH {_ER}, {_REL}, {_CHECKED}, ag AS (SELECT url, round(sum(CASE WHEN success THEN {_W} ELSE 0 END) / sum({_W}), 3) AS agreement FROM er GROUP BY url),
c AS (SELECT page_id, field, round(0.5 * agreement + 0.3 * quality + 0.2 * reliability, 3) AS c, {_IMPORTANCE} AS w FROM fq JOIN rel USING (url) JOIN ag USING (url) WHERE quality > 0)
SELECT page_id, round(sum(c * w) / sum(w), 3) AS confidence, count(*) AS fields FROM c GROUP BY page_id"""
)
def document_confidence(spark, d):
    """A page's confidence over all its fields: agreement is the weight of the strategies that succeeded."""
    r = records(spark, d)
    w = merge.weight(F.col("engine_id"))
    agreed = r.groupBy("url").agg(F.round(F.sum(F.when(F.col("success"), w).otherwise(0.0)) / F.sum(w), 3).alias("agreement"))
    fields = quality.scores(rich_documents(spark, d), ["page_id", "url"]).where("quality > 0")
    return quality.global_confidence(fields.join(merge.reliability(r), "url").join(agreed, "url"), ["page_id"])
