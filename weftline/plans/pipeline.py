"""The extraction pipeline: strategies -> normalised records -> one merged document a page -> quality.

A page is parsed once; strategies are projections of what was parsed, so they cost no second parse.
Records meet again by one shuffle on the page's URL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions import classify, slices, text, urls
from ..operators import extract, merge_fold

_NONE = {
    "title": "string",
    "description": "string",
    "main_content": "string",
    "headings": f"array<{schemas.HEADING}>",
    "links": f"array<{schemas.LINK}>",
    "images": f"array<{schemas.IMAGE}>",
    "tables": f"array<{schemas.TABLE}>",
    "forms": f"array<{schemas.FORM}>",
    "lists": f"array<{schemas.LIST}>",
    "keywords": "array<string>",
    "canonical_url": "string",
    "language": "string",
    "page_type": "string",
    "json_ld": "array<string>",
    "opengraph": "map<string,string>",
    "meta_tags": "map<string,string>",
    "zones": f"map<string,{schemas.ZONE}>",
    "entities": schemas.ENTITIES,
}
STRATEGIES = ("static_requests", "structured_metadata", "search_index")
#: Strategies added by register(): name -> function that gives their columns.
_OWN: dict[str, Callable[[], dict[str, Column]]] = {}
_RANKS: dict[str, int] = {}


def register(name: str, record: Callable[[], dict[str, Column]], rank: int | None = None) -> None:
    """A strategy of one's own. ``record`` gives columns over url, html and the parsed fields, named as in a document; ``rank`` settles ties."""
    unknown = [k for k in record() if k not in _NONE]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    _OWN[name] = record
    _RANKS[name] = len(C.ENGINE_RANK) + len(_RANKS) if rank is None else rank


def meta_map(meta: Column) -> Column:
    """name, property or http-equiv -> content; the last of a name counts."""
    name = lambda m: F.coalesce(text.nonempty(m["name"]), text.nonempty(m["property"]), m["http_equiv"])
    rows = F.filter(meta, lambda m: (name(m) != "") & (m["content"] != ""))
    rows = F.transform(rows, lambda m: F.struct(name(m).alias("key"), m["content"].alias("value")))
    keys = F.transform(rows, lambda r: r["key"])
    last = F.filter(rows, lambda r, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), r["key"]) == 0)
    return F.map_from_entries(last)


def _record(engine: str, **values: Column) -> Column:
    cols = [values.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in _NONE.items()]
    missing = F.when(~F.contains(F.lower(F.coalesce("html", F.lit(""))), F.lit("</html>")), F.array(F.lit("document has no end tag"))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.lit(engine).alias("engine_id"),
        F.lit(C.ENGINE_RANK[engine] if engine in C.ENGINE_RANK else _RANKS[engine]).alias("engine_rank"),
        F.coalesce(F.col("html") != "", F.lit(False)).alias("success"),
        missing.alias("warnings"),
        F.substring("html", 1, C.CAPS["raw_html"]).alias("raw_html"),
        *cols,
    )


def _native_links(base: Column) -> Column:
    """Anchors by pattern, resolved against ``base``, each target once, as links of a document."""
    found = F.transform(extract.native_links(F.col("html")), lambda x: F.struct(x["text"].alias("text"), urls.resolve(base, x["href"]).alias("href")))
    hrefs = F.transform(found, lambda x: x["href"])
    first = F.filter(found, lambda x, i: (x["href"] != "") & (F.array_position(hrefs, x["href"]) == i + 1))
    return F.transform(first, lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href"), F.lit("").alias("rel"), F.lit("").alias("title")))


def engine_results(pages: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """One record a page and strategy, already in the normalised form."""
    names = ["title", "meta", "headings", "paragraphs", "main_content", "links", "images", "tables", "lists", "forms", "json_ld", "opengraph", "zones", "entities", "segments"]
    p = pages.select("url", "html", extract.fields(F.col("html"), F.col("url"), names).alias("p"))
    p = p.select("url", "html", "p.*").withColumn("meta_tags", meta_map(F.col("meta")))
    meta = lambda k: F.coalesce(F.element_at("meta_tags", F.lit(k)), F.lit(""))
    good = F.filter("paragraphs", lambda x: ~text.is_noise(x))
    body = F.when(F.size(good) > 0, F.array_join(good, " ")).otherwise(F.col("main_content"))
    found = {
        "static_requests": lambda: _record(
            "static_requests",
            title=F.col("title"),
            description=F.coalesce(text.nonempty(meta("description")), F.try_element_at("paragraphs", F.lit(1))),
            main_content=F.substring(body, 1, C.CAPS["main_content"]),
            headings=F.filter("headings", lambda h: ~text.is_noise(h["text"])),
            links=F.slice("links", 1, C.CAPS["links"]),
            images=F.slice("images", 1, C.CAPS["images"]),
            tables=F.slice("tables", 1, C.CAPS["tables"]),
            forms=F.slice("forms", 1, C.CAPS["forms"]),
            lists=F.slice("lists", 1, C.CAPS["lists"]),
            language=classify.language(F.col("html")),
            page_type=classify.page_type(F.col("url"), F.col("html")),
            meta_tags=F.col("meta_tags"),
            zones=F.col("zones"),
            entities=F.col("entities"),
        ),
        # the same page by patterns instead of a tree, links against the address that the page calls its own
        "static_httpx": lambda: _record(
            "static_httpx",
            title=classify.title(F.col("html")),
            description=F.coalesce(text.nonempty(meta("description")), F.try_element_at(extract.native_paragraphs(F.col("html")), F.lit(1))),
            main_content=F.substring(F.array_join(F.filter(extract.native_paragraphs(F.col("html")), lambda x: ~text.is_noise(x)), " "), 1, C.CAPS["main_content"]),
            links=F.slice(_native_links(F.coalesce(text.nonempty(classify.canonical(F.col("url"), F.col("html"))), F.col("url"))), 1, C.CAPS["links"]),
            language=classify.language(F.col("html")),
            page_type=classify.page_type(F.col("url"), F.col("html")),
        ),
        "static_urllib": lambda: _record(
            "static_urllib",
            title=classify.title(F.col("html")),
            main_content=F.substring(F.array_join("paragraphs", " "), 1, C.CAPS["main_content"]),
            links=F.slice(_native_links(F.col("url")), 1, C.CAPS["links"]),
            language=classify.language(F.col("html")),
            meta_tags=F.col("meta_tags"),
        ),
        "structured_metadata": lambda: _record(
            "structured_metadata",
            title=F.coalesce(F.element_at("opengraph", F.lit("og:title")), F.col("title")),
            description=F.coalesce(F.element_at("opengraph", F.lit("og:description")), meta("description")),
            canonical_url=classify.canonical(F.col("url"), F.col("html")),
            language=F.coalesce(classify.language(F.col("html")), text.nonempty(meta("og:locale"))),
            page_type=classify.page_type(F.col("url"), F.col("html")),
            keywords=F.slice(F.filter(F.transform(F.split(meta("keywords"), ","), lambda s: F.trim(s)), lambda k: k != ""), 1, C.CAPS["keywords"]),
            json_ld=F.col("json_ld"),
            opengraph=F.col("opengraph"),
            meta_tags=F.col("meta_tags"),
        ),
        "search_index": lambda: _record(
            "search_index",
            title=F.trim("title"),
            main_content=F.substring(F.array_join(F.transform("segments", lambda s: s["content"]), " "), 1, C.CAPS["main_content"]),
            language=classify.language(F.col("html")),
        ),
    }
    own = {name: (lambda name=name: _record(name, **_OWN[name]())) for name in _OWN}
    return p.select("url", F.explode(F.array(*[(found | own)[name]() for name in strategies])).alias("r")).select("url", "r.*")


_MERGED = (
    "struct<title:string,canonical_url:string,language:string,page_type:string,main_content:string,description:string,"
    f"links:array<{schemas.LINK}>,images:array<{schemas.IMAGE}>,headings:array<{schemas.HEADING}>,tables:array<{schemas.TABLE}>,"
    f"forms:array<{schemas.FORM}>,lists:array<{schemas.LIST}>,keywords:array<string>,json_ld:array<string>,opengraph:map<string,string>,"
    f"meta_tags:map<string,string>,zones:map<string,{schemas.ZONE}>,entities:{schemas.ENTITIES},confidence_score:double,"
    "field_confidence:map<string,double>,confidence_breakdown:map<string,struct<agreement:double,quality:double,reliability:double,confidence:double>>,"
    "engine_contributions:map<string,array<string>>,conflicting_fields:array<string>,heading_repetition:double,engines_used:int,engines_succeeded:int,warnings:array<string>>"
)


def _plain(value):
    """Rows and arrow values as dicts, lists and scalars."""
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _fold(records, language: str | None, page_type: str | None) -> dict:
    rows = []
    # maps have no order in SQL, so records are ranked here
    for d in sorted(map(_plain, records), key=lambda r: (r["engine_rank"], r["engine_id"], repr(sorted(r.items(), key=lambda x: x[0])))):
        d["structured_data"] = {k: d[k] for k in ("json_ld", "opengraph") if d.get(k)}
        d["semantic_zones"] = d.pop("zones")
        d["entities"] = {k: v for k, v in (d.get("entities") or {}).items() if v}
        rows.append(d)
    doc = merge_fold.fold(rows, language, page_type)
    sd = doc.pop("structured_data")
    doc["json_ld"], doc["opengraph"], doc["zones"] = sd.get("json_ld", []), sd.get("opengraph", {}), doc.pop("semantic_zones")
    return doc


def merge(records: DataFrame) -> DataFrame:
    """One merged document a URL: its fields, confidences, conflicts and contributions.

    Records of a page are few (one a strategy), so a group is small whatever the corpus.
    """
    fields = ["engine_rank", "url", "engine_id", "success", "warnings", *_NONE]
    raw = F.min_by("raw_html", F.when(F.coalesce(F.col("raw_html") != "", F.lit(False)), F.col("engine_rank")))
    grouped = records.groupBy("url").agg(F.collect_list(F.struct(*fields)).alias("rs"), raw.alias("raw"))
    merged = slices.by_rows(_fold, _MERGED)(F.col("rs"), classify.language(F.col("raw")), classify.page_type(F.col("url"), F.col("raw")))
    return grouped.select("url", merged.alias("m")).select("url", "m.*").withColumn("content_hash", text.content_hash(F.col("title"), F.col("main_content"), F.transform("links", lambda x: F.coalesce(x["href"], F.lit("")))))


def annotate_quality(merged: DataFrame) -> DataFrame:
    """Adds ``quality``: schema errors, e-mail and phone reports, garbage flags and the overall score.

    A boolean column ``hallucinated``, if there is one, counts against the score.
    """
    if "hallucinated" not in merged.columns:
        return annotate_quality(merged.withColumn("hallucinated", F.lit(False))).drop("hallucinated")
    conf = F.col("confidence_score")
    errors = F.array_compact(
        F.array(
            F.when(F.col("url").isNull(), "missing required field: url"),
            F.when(F.col("title").isNull(), "missing required field: title"),
            F.when(conf.isNull(), "missing required field: confidence_score"),
            F.when(~conf.between(0, 1), F.concat(F.lit("confidence_score out of range: "), conf.cast("string"))),
        )
    )
    mails = F.coalesce(F.col("entities.emails"), F.array().cast("array<string>"))
    checked = F.transform(mails, lambda e: F.struct(e.alias("email"), text.email_reason(e).alias("reason")))
    rejected = F.filter(checked, lambda c: c["reason"] != "ok")
    valid = F.array_distinct(F.transform(F.filter(checked, lambda c: c["reason"] == "ok"), lambda c: F.lower(F.trim(c["email"]))))
    phones = F.array_distinct(F.transform(F.coalesce(F.col("entities.phones"), F.array().cast("array<string>")), text.normal_phone))
    garbage = {f: text.is_garbage(F.col(f)) for f in ("title", "description", "main_content")}
    any_garbage = garbage["title"] | garbage["description"] | garbage["main_content"]
    score = (
        (F.size(errors) == 0).cast("int")
        + ((F.size(mails) == 0) | (F.size(valid) > 0)).cast("int")
        + (~any_garbage).cast("int")
        + (~F.coalesce(F.col("hallucinated"), F.lit(False))).cast("int")
    ) / 4.0
    q = F.struct(
        (F.size(errors) == 0).alias("schema_valid"),
        errors.alias("schema_errors"),
        valid.alias("emails"),
        rejected.alias("emails_rejected"),
        phones.alias("phones"),
        *[c.alias(f"garbage_{f}") for f, c in garbage.items()],
        F.round(score, 3).alias("quality_score"),
    )
    return merged.withColumn("quality", q)


def run_pipeline(pages: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """Merged and annotated documents of pages(url, html). Repeated URLs are merged together."""
    return annotate_quality(merge(engine_results(pages, strategies)))


def confidence_gate(merged: DataFrame, retry: DataFrame) -> DataFrame:
    """Documents below the confidence threshold are replaced by their retry where that is strictly better."""
    low = merged.where(F.col("confidence_score") < C.RESCRAPE_CONFIDENCE).select("url", F.col("confidence_score").alias("before"))
    better = retry.join(low, "url").where(F.col("confidence_score") > F.col("before")).drop("before")
    return merged.join(better.select("url"), "url", "left_anti").unionByName(better, allowMissingColumns=True)


def decisions(merged: DataFrame) -> DataFrame:
    """Audit rows (url, field, engines, confidence, conflict, reason), one a page and field."""
    scalar = F.col("field").isin("title", "canonical_url", "language", "page_type")
    reason = F.when(scalar, "weighted_cluster_majority").when(F.col("field").isin(*C.LONGEST_FIELDS), "longest_with_overlap").when(F.col("field").isin(*C.DICT_FIELDS), "deep_dict_merge").otherwise("union_merge")
    rows = merged.select("url", "conflicting_fields", "engine_contributions", F.explode("field_confidence").alias("field", "confidence"))
    conflict = F.array_contains("conflicting_fields", F.col("field"))
    return rows.select(
        "url",
        "field",
        F.element_at("engine_contributions", F.col("field")).alias("engines"),
        "confidence",
        conflict.alias("conflict"),
        F.when(conflict, F.concat(reason, F.lit(" (conflict)"))).otherwise(reason).alias("reason"),
    )
