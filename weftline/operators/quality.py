"""Quality of a document's fields by checklists, and its confidence over all fields; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text
from . import merge


def _share(*checks: Column) -> Column:
    return F.round(sum(F.coalesce(c, F.lit(False)).cast("int") for c in checks) / float(len(checks)), 3)


def _some(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _fitting(items: str, ok) -> Column:
    n = F.size(items)
    return F.when(n > 0, F.round(F.size(F.filter(items, ok)) / n, 3)).otherwise(0.0)


def checklists() -> dict[str, Column]:
    """A score from 0 to 1 for each field of documents(url, title, description, main_content, language, canonical_url,
    links array<string>, images array<string>, headings array<struct<level, text>>, json_ld boolean, opengraph boolean); 0 where it is empty."""
    title, about, body = (F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "description", "main_content"))
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    letters = F.regexp_count(body, F.lit(r"\p{L}"))
    first = F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: F.lower(h["text"]))
    telling = F.filter(F.split(F.lower(title), r"\s+"), lambda w: F.char_length(w) > 3)
    overlap = F.exists(telling, lambda w: F.exists(first, lambda h: F.contains(h, w)))
    half = lambda a, b: F.coalesce(a, F.lit(False)).cast("int") * 0.5 + F.coalesce(b, F.lit(False)).cast("int") * 0.5
    return {
        "title": merge.title_quality(F.col("title"), F.col("url"), F.col("language")),
        "description": F.when(_some("description"), _share(F.char_length(about).between(50, 500), F.lower(about) != F.lower(title), ~text.has_noise_word(about))).otherwise(0.0),
        "main_content": F.when(_some("main_content"), _share(F.char_length(body) > 300, F.char_length(F.array_join(words, "")) / F.greatest(F.size(words), F.lit(1)) >= 4.0, letters / F.greatest(F.char_length(body), F.lit(1)) >= 0.6)).otherwise(0.0),
        "links": _fitting("links", lambda u: F.rlike(u, F.lit("^https?://")) & ~F.contains(u, F.lit("javascript:"))),
        "images": _fitting("images", lambda u: F.rlike(u, F.lit("^(?:https?:)?//"))),
        "headings": F.when(F.size("headings") > 0, half(F.size(first) > 0, overlap)).otherwise(0.0),
        "structured_data": half(F.col("json_ld"), F.col("opengraph")),
        "canonical_url": F.rlike(F.trim(F.coalesce("canonical_url", F.lit(""))), F.lit("^https?://")).cast("double"),
        "language": (~F.lower(F.trim(F.coalesce("language", F.lit("")))).isin("", "unknown", "none")).cast("double"),
    }


def scores(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, quality): the checklists in long form, one pass over the documents."""
    every = F.array(*[F.struct(F.lit(f).alias("field"), q.cast("double").alias("quality")) for f, q in checklists().items()])
    return docs.select(*keys, F.inline(every))


def global_confidence(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confidence, fields) of fields(keys, field, agreement, quality, reliability): each field's confidence, weighed by its importance."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in C.FIELD_IMPORTANCE.items() for x in kv]), F.col("field")), F.lit(C.DEFAULT_IMPORTANCE))
    each = fields.withColumn("c", merge.confidence(F.col("agreement"), F.col("quality"), F.col("reliability"))).withColumn("w", weight)
    return each.groupBy(*keys).agg(F.round(F.sum(F.col("c") * F.col("w")) / F.sum("w"), 3).alias("confidence"), F.count("*").alias("fields"))
