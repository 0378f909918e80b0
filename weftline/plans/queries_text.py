"""Queries on documents: entities, garbage, keywords, overlap, fingerprints, duplicates, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text
from ..operators import dedup, findings, headings
from .registry import has, q, query, table, words

_ALPHA = "length(regexp_replace(coalesce(text, ''), '[^\\p{L}]', '', 'g')) / greatest(length(coalesce(text, '')), 1)"
_ALPHA = f"({_ALPHA.replace('/', '::DOUBLE /', 1)})"
_GARBAGE = f"(length(coalesce(text, '')) < 20 OR {has('text', C.GARBAGE_RUN)} OR {_ALPHA} < {C.MIN_ALPHA_RATIO})"


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


_EMAILS = f"regexp_extract_all(coalesce(text, ''), {q(C.EMAIL_FIND)}, 0)"


@query(f"SELECT DISTINCT doc_id, unnest({_EMAILS}) AS email FROM documents")
def email_extract(spark, d):
    return docs(spark, d).select("doc_id", F.explode(text.emails(F.col("text"))).alias("email"))


_MAIL_CASES = """CASE doc_id % 8 WHEN 0 THEN 'User' || doc_id || '@example.com' WHEN 1 THEN 'no-at.example.com' WHEN 2 THEN 'a@b@c.org' WHEN 3 THEN '' WHEN 4 THEN repeat('x', 70) || '@example.com'
  WHEN 5 THEN 'bad@-start.com' WHEN 6 THEN repeat('y', 260) || '@e.com' ELSE 'ok+tag@sub.example.co' END"""
_REASON = f"""CASE WHEN e = '' THEN 'empty' WHEN length(e) > 254 THEN 'too_long' WHEN length(e) - length(replace(e, '@', '')) <> 1 THEN 'invalid_at'
  WHEN length(split_part(e, '@', 1)) > 64 THEN 'local_too_long' WHEN NOT {has('e', C.EMAIL_STRICT)} THEN 'invalid_format' WHEN {has("split_part(e, '@', 2)", '^-|-$')} THEN 'invalid_domain' ELSE 'ok' END"""


@query(f"WITH m AS (SELECT doc_id, lower(trim({_MAIL_CASES})) AS e FROM documents) SELECT doc_id, {_REASON} AS reason FROM m")
def email_validate(spark, d):
    return docs(spark, d).select("doc_id", text.email_reason(F.expr(_MAIL_CASES)).alias("reason"))


_PHONES = f"regexp_extract_all(coalesce(text, ''), {q(C.PHONE_FIND)}, 0)"


@query(
    f"""WITH p AS (SELECT doc_id, unnest({_PHONES}) AS p, generate_subscripts({_PHONES}, 1) AS pos FROM documents),
f AS (SELECT doc_id, trim(p) AS phone, regexp_replace(p, '[^0-9]', '', 'g') AS digits, pos FROM p WHERE length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)
SELECT doc_id, phone FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, digits ORDER BY pos) = 1"""
)
def phone_extract(spark, d):
    return docs(spark, d).select("doc_id", F.explode(text.phones(F.col("text"))).alias("phone"))


@query(
    f"""WITH p AS (SELECT doc_id, unnest({_PHONES}) AS p FROM documents), n AS (SELECT doc_id, p, regexp_replace(p, '[^0-9+]', '', 'g') AS kept FROM p)
SELECT DISTINCT doc_id, CASE WHEN length(ltrim(kept, '+')) BETWEEN 7 AND 15 THEN kept ELSE p END AS phone FROM n"""
)
def phone_normalise(spark, d):
    found = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(C.PHONE_FIND), F.lit(0)))
    return docs(spark, d).select("doc_id", found.alias("p")).select("doc_id", text.normal_phone(F.col("p")).alias("phone")).distinct()


_ADDRESSED = "CASE doc_id % 3 WHEN 0 THEN coalesce(text, '') || '. 12 Market Street, Springfield; short st.' ELSE coalesce(text, '') END"


@query(
    f"""WITH s AS (SELECT doc_id, trim(unnest(string_split_regex({_ADDRESSED}, '[\\n.;|]'))) AS s FROM documents)
SELECT DISTINCT doc_id, s AS sentence FROM s WHERE length(s) BETWEEN 10 AND 300 AND {has('s', C.ADDRESS_WORDS)}"""
)
def address_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.explode(text.address_sentences(F.expr(_ADDRESSED))).alias("sentence"))


@query(f"SELECT doc_id, {_GARBAGE} AS garbage FROM documents")
def garbage_text(spark, d):
    return docs(spark, d).select("doc_id", text.is_garbage(F.col("text")).alias("garbage"))


@query(f"SELECT doc_id, round({_ALPHA}, 6) AS alpha_ratio FROM documents")
def alpha_ratio(spark, d):
    return docs(spark, d).select("doc_id", F.round(text.alpha_ratio(F.col("text")), 6).alias("alpha_ratio"))


@query(f"WITH g AS (SELECT doc_id, {_GARBAGE} AS garbage FROM documents) SELECT quality, garbage, count(*) AS documents FROM g JOIN labels USING (doc_id) GROUP BY ALL")
def quality_vs_label(spark, d):
    g = docs(spark, d).select("doc_id", text.is_garbage(F.col("text")).alias("garbage"))
    return g.join(table(spark, d, "labels"), "doc_id").groupBy("quality", "garbage").agg(F.count("*").alias("documents"))


_KEY = r"""'^[.,!?;:''"()\[\]]+|[.,!?;:''"()\[\]]+$'"""
_WORDS = f"""w AS (SELECT doc_id, lang, regexp_replace(unnest(string_split_regex(lower(coalesce(text, '')), '\\s+')), {_KEY}, '', 'g') AS word FROM documents),
k AS (SELECT doc_id, lang, word FROM w WHERE length(word) > 3 AND regexp_matches(word, '^\\p{{L}}+$') AND NOT list_contains({words(C.KEYWORD_STOPWORDS)}, word))"""


@query(
    f"""WITH {_WORDS}, n AS (SELECT lang, word, count(*) AS n FROM k GROUP BY ALL)
SELECT lang, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM n) WHERE rank <= 30"""
)
def keyword_topk(spark, d):
    """Thirty most frequent words a language. Words are counted before they are ranked, and ranked in two steps, so no task holds a language."""
    w = docs(spark, d).select("lang", F.explode(text.keyword_words(F.col("text"))).alias("word"))
    n = w.groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("word")]
    near = n.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(64)))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where("r <= 30")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where("rank <= 30").select("lang", "word", "n", "rank")


@query(
    f"""WITH w AS (SELECT doc_id, unnest(list_transform(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: regexp_replace(x, {_KEY}, '', 'g'))) AS word, generate_subscripts(string_split_regex(lower(coalesce(text, '')), '\\s+'), 1) AS pos FROM documents),
n AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE length(word) > 3 AND regexp_matches(word, '^\\p{{L}}+$') AND NOT list_contains({words(C.KEYWORD_STOPWORDS)}, word) GROUP BY ALL)
SELECT doc_id, word, n FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) <= 30"""
)
def document_keywords(spark, d):
    """Thirty most frequent words of each document, ties in the order of their first appearance.

    The texts are dealt out by document, once; counting and ranking their words needs no other shuffle.
    """
    w = docs(spark, d).select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(text.keyword_words(F.col("text"))).alias("pos", "word"))
    n = w.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")  # a document's distinct words
    return n.withColumn("rank", F.row_number().over(order)).where("rank <= 30").select("doc_id", "word", "n")


_TOKENS = f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9'']+', 0), lambda x: lower(x)), lambda x: length(x) > 2 AND NOT list_contains({words(C.OVERLAP_STOPWORDS)}, x)))"


@query(
    f"""WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE doc_id % 20 = 0), b AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
dt AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM d), bt AS (SELECT item_id, len(t) AS m, unnest(t) AS w FROM b)
SELECT doc_id, item_id, round(2.0 * count(*) / (n + m), 4)::DOUBLE AS overlap FROM dt JOIN bt USING (w) GROUP BY doc_id, item_id, n, m HAVING round(2.0 * count(*) / (n + m), 4) >= 0.1"""
)
def rouge_vs_benchmark(spark, d):
    """Documents (ids divisible by 20) against benchmark items: F1 of their word sets, by counting shared words."""
    left = docs(spark, d).where("doc_id % 20 = 0").select("doc_id", text.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    right = table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("t")).select("item_id", F.size("t").alias("m"), F.explode("t").alias("w"))
    shared = left.join(right, "w").groupBy("doc_id", "item_id", "n", "m").agg(F.count("*").alias("c"))
    return shared.select("doc_id", "item_id", F.round(2.0 * F.col("c") / (F.col("n") + F.col("m")), 4).alias("overlap")).where("overlap >= 0.1")


@query(
    f"""WITH p AS (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations), x AS (SELECT a.conv_id, a.turn, a.t AS h, b.t AS r FROM p a JOIN p b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1)
SELECT conv_id, turn, CASE WHEN len(h) = 0 OR len(r) = 0 THEN 0.0 ELSE round(2.0 * len(list_intersect(h, r)) / (len(h) + len(r)), 4) END::DOUBLE AS overlap,
  CASE WHEN len(h) = 0 OR len(r) = 0 THEN 0.0 ELSE round(2.0 * len(list_intersect(h, r)) / (len(h) + len(r)), 4) END < {C.HALLUCINATION_OVERLAP} AS ungrounded FROM x"""
)
def hallucination_check(spark, d):
    """Each turn against the turn before: overlap below the threshold counts as ungrounded."""
    c = table(spark, d, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("h"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("h").alias("r"))
    out = c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", text.overlap_f1(F.col("h"), F.col("r")).alias("overlap"))
    return out.withColumn("ungrounded", F.col("overlap") < C.HALLUCINATION_OVERLAP)


@query("SELECT doc_id, substr(sha256(source || coalesce(text, '') || array_to_string(list_sort([lang, source]), chr(10))), 1, 16) AS hash FROM documents")
def content_hash(spark, d):
    return docs(spark, d).select("doc_id", text.content_hash(F.col("source"), F.coalesce("text", F.lit("")), F.array("lang", "source")).alias("hash"))


@query("WITH h AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents) SELECT min(doc_id) AS keep_id, count(*) AS copies FROM h GROUP BY h HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return docs(spark, d).groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("h")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1").select("keep_id", "copies")


_SIM_TOKENS = f"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda x: x <> '' AND NOT list_contains({words(C.SIMHASH_STOPWORDS)}, x))"
_BITS = " + ".join(f"(CASE WHEN 2 * sum(c * ((h >> {b}) & 1)) > sum(c) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64))
_FPS = f"""t AS (SELECT doc_id, unnest({_SIM_TOKENS}) AS w FROM documents), g AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY ALL),
hh AS (SELECT doc_id, c, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h FROM g), fp AS (SELECT doc_id, {_BITS} AS fp FROM hh GROUP BY doc_id)"""


@query(f"WITH {_FPS} SELECT d.doc_id, lpad(lower(to_hex(coalesce(fp, 0))), 16, '0') AS fingerprint FROM documents d LEFT JOIN fp USING (doc_id)")
def simhash_fingerprint(spark, d):
    fp = dedup.simhash(docs(spark, d))
    return fp.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"))


@query(
    f"""WITH RECURSIVE {_FPS}, f AS (SELECT d.doc_id, coalesce(fp, 0) AS fp FROM documents d LEFT JOIN fp USING (doc_id)), c AS (SELECT fp, min(doc_id) AS rep FROM f GROUP BY fp),
l AS (SELECT a.rep AS a, b.rep AS b FROM c a JOIN c b ON a.rep <> b.rep AND bit_count(xor(a.fp, b.fp)) <= {C.SIMHASH_DISTANCE}),
r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b)
SELECT f.doc_id, c.rep AS rep_id, min(r.root) AS component_id FROM f JOIN c USING (fp) JOIN r ON r.node = c.rep GROUP BY ALL"""
)
def near_dup_classes(spark, d):
    """Each document's class of equal fingerprints and the component that links of eight bits or less make of the classes."""
    return dedup.near_classes(dedup.simhash(docs(spark, d))).select("doc_id", F.col("rep").alias("rep_id"), F.col("component").alias("component_id"))


@query()
def fuzzy_dedup_headings(spark, d):
    """First lines of all of each source's documents, near-duplicates folded, by the merge rule (sources stand in for pages)."""
    return headings.fold(docs(spark, d).select("source", "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("t")))


@query(findings.oracle_sql("documents", "doc_id", "text"))
def secret_findings(spark, d):
    return findings.scan(docs(spark, d), "doc_id", "text")


@query(f"WITH f AS ({findings.oracle_sql('documents', 'doc_id', 'text')}) SELECT severity, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM f GROUP BY severity")
def secret_summary(spark, d):
    return findings.scan(docs(spark, d), "doc_id", "text").groupBy("severity").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("documents"))
