"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; repeated inlining of long expressions would outgrow generated code."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rx(col: Column, pattern: str) -> Column:
    """Whether the pattern is found in the column; false for null."""
    return F.coalesce(F.rlike(col, F.lit(pattern)), F.lit(False))


def sanitize(col: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))


def normal(col: Column) -> Column:
    return F.lower(sanitize(col))


def nonempty(col: Column) -> Column:
    """The column, null where it is empty."""
    return F.nullif(col, F.lit(""))


def is_empty(col: Column) -> Column:
    return F.coalesce(F.trim(col) == "", F.lit(True))


def is_noise(col: Column) -> Column:
    """Boilerplate: three characters or less, or a well-known phrase."""
    s = F.trim(F.coalesce(col, F.lit("")))
    return (F.char_length(s) <= 3) | rx(s, C.NOISE_LINE)


def has_noise_word(col: Column) -> Column:
    low = F.lower(F.coalesce(col, F.lit("")))
    out = F.lit(False)
    for w in C.NOISE_WORDS:
        out = out | F.contains(low, F.lit(w))
    return out


def alpha_ratio(col: Column) -> Column:
    s = F.coalesce(col, F.lit(""))
    return F.char_length(F.regexp_replace(s, r"[^\p{L}]", "")) / F.greatest(F.char_length(s), F.lit(1))


def is_garbage(col: Column, least: int = 20) -> Column:
    """Too short, a run of unusual characters, or too few letters."""
    s = F.coalesce(col, F.lit(""))
    return (F.char_length(s) < least) | rx(s, C.GARBAGE_RUN) | (alpha_ratio(s) < C.MIN_ALPHA_RATIO)


def tokens(col: Column) -> Column:
    """Distinct lower-case words of more than two characters, without stop words."""
    words = F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit("[a-zA-Z0-9']+"), F.lit(0)), F.lower)
    stop = F.array(*[F.lit(w) for w in C.OVERLAP_STOPWORDS])
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 2) & ~F.array_contains(stop, w)))


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets (ROUGE-1), four places; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.round(2.0 * both / (F.size(a) + F.size(b)), 4))


def lev_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def emails(col: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(C.EMAIL_FIND), F.lit(0)))


def email_reason(col: Column) -> Column:
    """'ok' or why the address is rejected, first reason first."""
    e = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    ats = F.char_length(e) - F.char_length(F.replace(e, F.lit("@"), F.lit("")))
    local, domain = F.split_part(e, F.lit("@"), F.lit(1)), F.split_part(e, F.lit("@"), F.lit(2))
    return (
        F.when(e == "", "empty")
        .when(F.char_length(e) > 254, "too_long")
        .when(ats != 1, "invalid_at")
        .when(F.char_length(local) > 64, "local_too_long")
        .when(~rx(e, C.EMAIL_STRICT), "invalid_format")
        .when(rx(domain, "^-|-$"), "invalid_domain")
        .otherwise("ok")
    )


def digits(col: Column) -> Column:
    return F.regexp_replace(col, r"[^0-9]", "")


def phones(col: Column) -> Column:
    """Phone-like strings with 7 to 15 digits, first of each digit string, in order."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(C.PHONE_FIND), F.lit(0))
    found = F.transform(found, lambda p: F.struct(digits(p).alias("d"), F.trim(p).alias("p")))
    found = F.filter(found, lambda p: F.char_length(p["d"]).between(7, 15))
    first = F.filter(found, lambda p, i: F.array_position(F.transform(found, lambda q: q["d"]), p["d"]) == i + 1)
    return F.transform(first, lambda p: p["p"])


def normal_phone(col: Column) -> Column:
    """Digits with a leading plus if they are 7 to 15, else the string itself."""
    kept = F.regexp_replace(col, r"[^0-9+]", "")
    n = F.char_length(F.ltrim(kept, F.lit("+")))
    return F.when(n.between(7, 15), kept).otherwise(col)


def address_sentences(col: Column) -> Column:
    """Distinct sentences of 10 to 300 characters with an address word, in order."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), r"[\n.;|]"), lambda s: F.trim(s))
    return F.array_distinct(F.filter(parts, lambda s: F.char_length(s).between(10, 300) & F.rlike(s, F.lit(C.ADDRESS_WORDS))))


def content_hash(title: Column, body: Column, hrefs: Column) -> Column:
    """First 16 hex digits of the SHA-256 of title, body and sorted link targets."""
    return F.substring(F.sha2(F.concat(title, body, F.array_join(F.array_sort(hrefs), "\n")), 256), 1, 16)


def keyword_words(col: Column) -> Column:
    """Words that can be keywords: longer than three, letters only, no stop words; punctuation at the ends is cut."""
    words = F.split(F.lower(F.coalesce(col, F.lit(""))), r"\s+")
    words = F.transform(words, lambda w: F.regexp_replace(w, r"""^[.,!?;:'"()\[\]]+|[.,!?;:'"()\[\]]+$""", ""))
    stop = F.array(*[F.lit(w) for w in C.KEYWORD_STOPWORDS])
    return F.filter(words, lambda w: (F.char_length(w) > 3) & F.rlike(w, F.lit(r"^\p{L}+$")) & ~F.array_contains(stop, w))
