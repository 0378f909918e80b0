"""Secret scan through an inverted trigram index, in DataFrame operations only.

From every rule's regex a Boolean trigram query is derived: which trigrams any match must contain. The rows
are numbered and written; one pass over them makes the index, a table of postings: for each of the rules'
trigrams and each block of BLOCK rows a bitmap of the rows that hold it. A rule's query, in disjunctive form,
intersects the bitmaps of each conjunction and unites the conjunctions, all by aggregates on (rule, block).
What is left are the rule's candidates, one bitmap a block, and only those rows are verified with its regex.
Rules from which no mandatory trigram follows scan every row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, let, materialize, scratch_tables

_MAX_STRINGS = 64
#: Rows of a bitmap; fixed by the built-in bitmap aggregates.
BLOCK = 1 << 15
#: Matches of a text that are placed in one run.
RUN = 256


@dataclass(frozen=True)
class Rule:
    """``regex`` finds candidates, leftmost and non-overlapping; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    #: An equivalent regex that is quicker to search: it finds exactly the matches of ``regex`` that are long enough.
    scan: str | None = None


# The base rules.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
# Further credential formats.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + EXTRA


# ------------------------------------------------------------ trigram queries
# A query is None (no mandatory trigram), a trigram, or ("and" | "or", [queries]).
def _all_of(queries: list):
    kept = [q for q in dict.fromkeys(queries) if q is not None]
    return None if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _conjunct(query) -> frozenset[str]:
    """The trigrams of a plain conjunction; empty for other queries."""
    if isinstance(query, str):
        return frozenset([query])
    return frozenset(query[1]) if query[0] == "and" and all(isinstance(q, str) for q in query[1]) else frozenset()


def _any_of(queries: list):
    kept = list(dict.fromkeys(queries))
    # a or (a and b) is a
    grams = {q: _conjunct(q) for q in kept if q is not None}
    kept = [q for q in kept if not any(o != q and grams.get(o) and grams.get(q) and grams[o] < grams[q] for o in kept)]
    return None if None in kept or not kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _of_strings(strings: set[str]):
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(tree) -> tuple[set[str] | None, object]:
    """(the exact strings that the tree matches, if they are few; its trigram query), in lower case."""
    strings: set[str] = {""}
    found = []
    whole = True

    def flush() -> None:
        nonlocal strings, whole
        found.append(_of_strings(strings))
        strings, whole = {""}, False

    for op, arg in tree:
        name, exact, query = str(op), None, None
        if name == "LITERAL":
            exact = {chr(arg).lower()}
        elif name == "IN":
            chars: set[str] | None = set()
            for k, v in arg:
                if str(k) == "LITERAL":
                    chars.add(chr(v).lower())
                elif str(k) == "RANGE" and v[1] - v[0] < 8:
                    chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    chars = None
                    break
            exact = chars if chars and len(chars) <= 8 else None
        elif name == "SUBPATTERN":
            exact, query = _walk(arg[-1])
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            if all(x[0] is not None for x in parts):
                exact = set().union(*(x[0] for x in parts))
            query = _any_of([_of_strings(x[0]) if x[0] is not None else x[1] for x in parts])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            lo, hi, body = arg
            inner, q = _walk(body)
            if inner is not None and lo == hi == 1:
                exact = inner
            elif inner is not None and (lo, int(hi)) == (0, 1):
                exact = inner | {""}
            elif inner is not None and lo == hi and len(inner) == 1:
                exact = {next(iter(inner)) * lo}
            elif lo > 0:
                query = _of_strings(inner) if inner is not None else q
        if exact is not None and len(strings) * len(exact) <= _MAX_STRINGS:
            strings = {a + b for a, b in product(strings, exact)}
            continue
        flush()
        if exact is not None:
            strings = set(exact)
        else:
            found.append(query)
    if whole:
        return strings, _of_strings(strings)
    found.append(_of_strings(strings))
    return None, _all_of(found)


def trigram_query(regex: str):
    """Boolean query over lower-case trigrams that every text with a match satisfies; None: no such query."""
    return _walk(re._parser.parse(regex))[1]


def _trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def disjuncts(query) -> set[frozenset[str]]:
    """The query as alternatives of trigrams that must all be there."""
    if isinstance(query, str):
        return {frozenset([query])}
    parts = [disjuncts(q) for q in query[1]]
    found = set().union(*parts) if query[0] == "or" else {frozenset().union(*p) for p in product(*parts)}
    return {c for c in found if not any(o < c for o in found)}


# ------------------------------------------------------------ index
def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index of rows(at, text): (gram, block, rows), a bitmap of the rows of a block that hold the trigram."""
    low = rows.select("at", F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    each = low.select(_block("at"), F.col("at").bitwiseAND(F.lit(BLOCK - 1)).alias("pos"), F.explode(held).alias("gram"))
    return each.groupBy("gram", "block").agg(F.bitmap_construct_agg("pos").alias("rows"))


def _block(at: str) -> Column:
    return F.shiftright(at, BLOCK.bit_length() - 1).alias("block")


def candidates(index: DataFrame, queries: dict[int, object]) -> DataFrame:
    """(block, rows map<rule, bitmap>): the rows that satisfy each rule's query, for blocks with any."""
    terms = [(rule, n, g, len(c)) for rule, q in queries.items() for n, c in enumerate(sorted(map(sorted, disjuncts(q)))) for g in c]
    terms = index.sparkSession.createDataFrame(terms, "rule int, term int, gram string, size int")
    each = index.join(F.broadcast(terms), "gram")  # the rules' trigrams, a fixed list
    both = each.groupBy("rule", "term", "size", "block").agg(F.bitmap_and_agg("rows").alias("rows"), F.count("*").alias("n")).where("n = size")
    any_ = both.groupBy("rule", "block").agg(F.bitmap_or_agg("rows").alias("rows"))
    return any_.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("rule", "rows"))).alias("rows"))


def rules_of_rows(found: DataFrame) -> DataFrame:
    """(at, held array<rule>): the candidates row by row, instead of a bitmap a block; as many rows as there are candidates."""
    each = found.select("block", F.explode("rows").alias("rule", "bits"))
    set_ = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda k: _bit(F.col("bits"), k))
    each = each.select("rule", F.shiftleft("block", BLOCK.bit_length() - 1).alias("base"), F.explode(set_).alias("pos"))
    return each.groupBy((F.col("base") + F.col("pos")).alias("at")).agg(F.collect_list("rule").alias("held"))


def _bit(bitmap: Column, pos: Column) -> Column:
    """Whether a bit of the bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(pos, F.lit(8)))), F.lit(2)) == 1


# ------------------------------------------------------------ verification
def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans (start, rank, kind, end) of a rule's matches, in code points: pieces between matches alternate with matches.

    Matches are placed in runs of RUN, then the runs, so that lists of many matches aren't copied once a match.
    """
    regex = rule.scan or rule.regex
    kind = "array<struct<start:int,rank:int,kind:string,end:int>>"
    empty = F.array().cast(kind)
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    long = F.transform(hits, F.char_length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(rule.group)), F.char_length) if rule.scan is None and rule.group else long
    gaps = F.transform(F.split(text, regex, -1), F.char_length)
    rows = F.zip_with(F.arrays_zip(gaps.alias("p"), long.alias("h")), sizes, lambda a, n: F.struct(a["p"].alias("p"), a["h"].alias("h"), n.alias("n")))
    rows = F.filter(rows, lambda r: r["h"].isNotNull())

    def step(acc: Column, r: Column) -> Column:
        start = acc["pos"] + r["p"]
        end = start + r["h"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("pos"), F.when(r["n"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def place(runs: Column) -> Column:
        total = F.transform(runs, lambda c: F.aggregate(c, F.lit(0), lambda acc, r: acc + r["p"] + r["h"]))
        begin = F.aggregate(total, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(runs, F.slice(begin, 1, F.size(runs)), lambda c, b: F.aggregate(c, F.struct(b.alias("pos"), empty.alias("out")), step)["out"]))

    cut = lambda rs: F.transform(F.sequence(F.lit(0), F.floor((F.size(rs) - 1) / RUN).cast("int")), lambda c: F.slice(rs, c * RUN + 1, RUN))
    found = let(rows, lambda rs: F.when(F.size(rs) > 0, let(cut(rs), place)).otherwise(empty))
    return F.when(F.rlike(text, F.lit(regex)), found).otherwise(empty)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans`` array<struct<start, rank, kind, end>>, sorted.

    Spans are in code points, end exclusive, ordered by start, then by the rules' order (ties). Null and empty
    texts have no spans; very long texts are scanned whole, in time linear in their matches; repeated rows and
    null ids have each their own row; an empty table gives an empty table. Other columns of ``docs`` don't
    matter, whatever their names.
    """
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.regex)) is not None}
    grams = sorted(set().union(*map(_trigrams, queries.values())))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("at"))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    if grams:
        begun = scratch_tables()
        rows = materialize(d, "texts")  # so that numbers are the same each time they are read
        since = scratch_tables()
        index = materialize(postings(rows, grams), "postings")
        found = materialize(candidates(index, queries), "candidates")
        drop_scratch(since, found)
        found = materialize(rules_of_rows(found), "rules")
        drop_scratch(since, found)
        d = rows.join(found, "at", "left")
    cols = [
        F.when(F.array_contains("held", k), _spans(F.col("text"), r, k)).otherwise(empty) if k in queries else _spans(F.col("text"), r, k)
        for k, r in enumerate(rules)
    ]
    out = d.select("doc_id", F.array_sort(F.concat(*cols)).alias("spans"))
    if grams:  # the numbered texts go with the index
        out = materialize(out, "spans")
        drop_scratch(begun, out)
    return out


def digest(scanned: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts and digests of scan(): doc_id, n_<base kind>..., base_sha256, spans."""
    own = F.filter("spans", lambda s: s["rank"] < len(base))
    of_rank = lambda k: F.filter("spans", lambda s: s["rank"] == k)
    counts = [F.size(of_rank(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(base)]
    return scanned.select("doc_id", *counts, F.sha2(_joined(own), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
