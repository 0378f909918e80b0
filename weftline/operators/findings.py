"""Findings of leaked credentials in text: severity, pattern, masked preview and line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (severity, name, pattern). The first group is the secret.
PATTERNS = (
    ("critical", "private_key", r"(-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----)"),
    ("critical", "cloud_access_key", r"(?:^|[^\p{L}\p{N}_])(AKIA[A-Z0-9]{16})(?:[^\p{L}\p{N}_]|$)"),
    ("high", "bearer_token", r"(?i)(?:^|[^\p{L}\p{N}_])bearer\s+([A-Za-z0-9._~+/\-]{20,})"),
    ("high", "jwt", r"(?:^|[^\p{L}\p{N}_])(eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+)"),
    ("high", "password", r"""(?i)(?:^|[^\p{L}\p{N}_])(?:password|passwd|pwd)["']?\s*[:=]\s*["']?([A-Za-z0-9+/_.\-]{6,})"""),
    ("medium", "api_key", r"""(?i)(?:^|[^\p{L}\p{N}_])(?:api_?key|secret|token)["']?\s*[:=]\s*["']?([A-Za-z0-9+/_.\-]{16,})"""),
    ("low", "hex_digest", r"(?:^|[^\p{L}\p{N}_])([0-9a-f]{40})(?:[^\p{L}\p{N}_]|$)"),
)


def _mask(secret: Column) -> Column:
    """At most a quarter of the secret at either end, four characters at most."""
    n = F.least(F.lit(4), F.floor(F.char_length(secret) / 4).cast("int"))
    return F.concat(F.left(secret, n), F.lit("…"), F.right(secret, n))


def scan(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct (id, pattern, preview): severity, pattern_name, match_preview, which never shows more than half of a secret."""

    def found(severity: str, name: str, pattern: str):
        hits = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), F.lit(1))
        return F.transform(hits, lambda m: F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("pattern_name"), _mask(m).alias("match_preview")))

    return rows.select(id_col, F.inline(F.concat(*[found(*p) for p in PATTERNS]))).distinct()


def located(rows: DataFrame, source_type: str, url_col: str, text_col: str) -> DataFrame:
    """scan() with where a finding was: source_type, source_url and line_context, the 80 characters around it with the secret masked."""

    def found(severity: str, name: str, pattern: str):
        lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n"), lambda x: F.rlike(x, F.lit(pattern)))

        def row(line: Column, m: Column) -> Column:
            at = F.greatest(F.position(m, line) - 30, F.lit(1))
            return F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("pattern_name"), _mask(m).alias("match_preview"), F.substr(F.replace(line, m, _mask(m)), at, F.lit(80)).alias("line_context"))

        return F.flatten(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda m: row(x, m))))

    every = rows.select(F.lit(source_type).alias("source_type"), F.col(url_col).alias("source_url"), F.inline(F.concat(*[found(*p) for p in PATTERNS])))
    return every.groupBy("severity", "pattern_name", "match_preview", "source_type", "source_url").agg(F.min("line_context").alias("line_context"))


def oracle_sql(table: str, id_col: str, text_col: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [
        f"SELECT {id_col}, '{s}' AS severity, '{n}' AS pattern_name, unnest(regexp_extract_all(coalesce({text_col}, ''), {quote(p)}, 1)) AS m FROM {table}" for s, n, p in PATTERNS
    ]
    n = "least(4, length(m) // 4)::INT"
    return f"SELECT DISTINCT {id_col}, severity, pattern_name, left(m, {n}) || '…' || right(m, {n}) AS match_preview FROM ({' UNION ALL '.join(parts)})"
