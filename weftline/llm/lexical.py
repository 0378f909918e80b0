"""Ranked lexical search over a tiered index.

Documents are indexed by segments. A segment's postings of a term are sorted by impact, highest first, and cut
into tiers; each tier tells the highest impact behind it, the term's residual bound. A round reads one tier more
than the round before, for the pairs of segment and item that still lack a proof:

* what has been read of a document is a lower bound of its score, and residual bounds of the terms not met in it
  make an upper bound;
* an item's threshold is its 20th highest lower bound over all segments;
* a pair is proved when none of the segment's documents with an open score reaches the threshold. Then its closed
  scores are exact and it is done; else it falls through to the next tier. The last tier has no residual.

Scores are 64-bit integers throughout. What is shuffled are postings of the items' terms by segment and, at most,
20 rows a task and item; items meet segments in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import segments
from .common import ascii_lower, drop_scratch, materialize, scratch_tables

TOP = 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most documents of a segment and most items of a block: together they bound the scores that a task holds.
SEGMENT_ROWS = 2048
BLOCK = 64
#: Postings of a term and segment in the tiers above the last.
TIERS = (8, 64)
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DOCS = -1  # in place of a term: the segment's documents

_RAW = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("docs", pa.binary()), ("tfs", pa.binary()), ("ns", pa.binary()), ("df", pa.int64()), ("total", pa.int64())])
_INDEX = pa.schema([("segment", pa.int64()), ("tid", pa.int64()), ("tier", pa.int32()), ("docs", pa.binary()), ("f", pa.binary()), ("residual", pa.int64())])


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each segment by term, and under the empty term its documents: ids (with which of them there are) and lengths."""
    for segment, rows in segments.pieces(batches, "text"):
        ids = rows.column("doc_id")
        order = pc.array_sort_indices(ids)  # nulls last
        ids, texts = ids.take(order), rows.column("text").take(order)
        vocabulary, term, doc = segments.words(texts, _INSIDE)
        n = np.bincount(doc, minlength=len(texts)).astype(np.int32)
        key, tf = np.unique(term.astype(np.int64) * len(texts) + doc, return_counts=True)
        term, doc = key // len(texts), (key % len(texts)).astype(np.int32)
        first = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)]), len(term))
        k = len(vocabulary)
        yield pa.RecordBatch.from_arrays(
            [
                pa.repeat(pa.scalar(segment, pa.int64()), k),
                vocabulary,
                segments.binaries(doc, first),
                segments.binaries(tf.astype(np.int32), first),
                segments.binaries(n[doc], first),
                pa.array(np.diff(first).astype(np.int64)),
                pa.nulls(k, pa.int64()),
            ],
            schema=_RAW,
        )
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        own = [[segment], [""], [ids.fill_null(0).to_numpy().astype("<i8").tobytes()], [known.astype(np.uint8).tobytes()], [n.tobytes()], [int((n > 0).sum())], [int(n.sum())]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(own, _RAW)], schema=_RAW)


def _tiers(n_docs: int, n_terms: int):
    """Postings become impacts, highest first, in tiers. ``n_docs``, ``n_terms``: of the whole collection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for segment, tid, docs, tfs, ns in zip(*(batch.column(c).to_pylist() for c in ("segment", "tid", "docs", "tfs", "ns"))):
                if tid == _DOCS:
                    out.append((segment, tid, 0, docs, tfs, 0))
                    continue
                docs, tf, n = (np.frombuffer(b, "<i4") for b in (docs, tfs, ns))
                tf, n = tf.astype(np.int64), n.astype(np.int64)
                m = 75 + 25 * n * n_docs // n_terms
                f = 1_000_000_000 * tf // (1000 * tf + 12 * m)
                order = np.argsort(-f, kind="stable")
                docs, f = docs[order], f[order]
                ends = [*(e for e in TIERS if e < len(f)), len(f)]
                for tier, (lo, hi) in enumerate(zip([0, *ends], ends)):
                    out.append((segment, tid, tier, docs[lo:hi].tobytes(), f[lo:hi].astype("<i4").tobytes(), int(f[hi]) if hi < len(f) else 0))
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out) if out else [[]] * 6, _INDEX)], schema=_INDEX)

    return run


class TieredIndex:
    """An index of documents for a set of terms: ``index`` (segment, tid, tier, docs, f, residual), ``terms`` (term, tid, df)."""

    def __init__(self, docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        """``terms``: one string column of distinct terms; postings of others are not kept, but count in documents' lengths."""
        both = terms.toDF("term").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
        # a table of its own, whose size Spark knows when it plans the join with the postings
        both = materialize(both.select("term", F.when(F.col("term") == "", _DOCS).otherwise(F.monotonically_increasing_id()).alias("tid")), "terms")
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        raw = rows.mapInArrow(_invert, "segment long, term string, docs binary, tfs binary, ns binary, df long, total long")
        since = scratch_tables()
        raw = materialize(raw.join(both, "term").drop("term"), "postings", batch_rows=SEGMENT_ROWS)
        n = raw.where(F.col("tid") == _DOCS).agg(F.sum("df").alias("docs"), F.sum("total").alias("terms")).first()
        self.n_docs, self.n_terms = n["docs"] or 0, n["terms"] or 0
        self.terms = materialize(both.join(raw.groupBy("tid").agg(F.sum("df").alias("df")), "tid"), "frequencies")
        index = raw.select("segment", "tid", "docs", "tfs", "ns").mapInArrow(_tiers(self.n_docs, max(1, self.n_terms)), "segment long, tid long, tier int, docs binary, f binary, residual long")
        self.index = materialize(index, "index")
        drop_scratch(since, self.terms, self.index)


_FOUND = "segment long, item long, ids array<long>, scores array<long>, closed array<boolean>, bound long"


def _bounds(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a segment and a block of items, each item's TOP documents by lower bound, which of these are closed, and the highest upper bound of any open one."""
    docs = pdf[pdf["tid"] == _DOCS].iloc[0]
    ids, known = np.frombuffer(docs["docs"], "<i8"), np.frombuffer(docs["f"], np.uint8).astype(bool)
    block = int(docs["block"])
    pending = np.asarray(pdf["pending"].iloc[0]) if "pending" in pdf else None
    words = pdf[pdf["tid"] != _DOCS].sort_values(["tid", "tier"])
    tid = words["tid"].to_numpy()
    last = np.append(tid[1:] != tid[:-1], True)[: len(tid)]  # the lowest tier read of each term
    rest = np.zeros(len(tid), np.int64)
    rest[last] = words["residual"].to_numpy()[last]
    rest = rest[::-1][np.maximum.accumulate(np.where(last[::-1], np.arange(len(tid)), 0))][::-1] if len(tid) else rest
    low, more, residual = np.zeros((BLOCK, len(ids)), np.int64), np.zeros((BLOCK, len(ids)), np.int64), np.zeros(BLOCK, np.int64)
    for docs_, f_, items_, weights_, r, end in zip(words["docs"], words["f"], words["items"], words["weights"], rest.tolist(), last.tolist()):
        at, f = np.frombuffer(docs_, "<i4"), np.frombuffer(f_, "<i4").astype(np.int64)
        items, w = np.asarray(items_), np.asarray(weights_, np.int64)
        if pending is not None:
            ok = np.isin(items, pending)
            items, w = items[ok], w[ok]
        for i, v in zip(items.tolist(), w.tolist()):
            low[i, at] += v * f
            if r:
                more[i, at] -= v * r
        if end:
            residual[items] += w * r
    more += residual[:, None]
    out = []
    here = np.unique(np.concatenate([np.zeros(0, np.int64), *words["items"]]).astype(np.int64))
    for i in (here if pending is None else np.intersect1d(here, pending)).tolist():
        s, m = low[i], more[i]
        opened = m > 0
        bound = int((s + m)[opened].max()) if opened.any() else 0
        some = np.flatnonzero(s > 0)
        if len(some) > TOP:
            some = some[s[some] >= np.partition(s[some], -TOP)[-TOP]]
        best = some[np.argsort(-s[some], kind="stable")][:TOP]  # documents stand in the order of their ids
        out.append((docs["segment"], block * BLOCK + i, [int(d) if k else None for d, k in zip(ids[best], known[best])], s[best].tolist(), (~opened[best]).tolist(), bound))
    return pd.DataFrame(out, columns=["segment", "item", "ids", "scores", "closed", "bound"])


def _ranked(rows: DataFrame) -> DataFrame:
    """The TOP best rows of each item, with their rank; tasks keep TOP of an item before they shuffle."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _exploded(found: DataFrame) -> DataFrame:
    hits = F.explode(F.arrays_zip("ids", "scores", "closed"))
    return found.select("segment", "item", hits.alias("h")).select("segment", "item", F.col("h.ids").alias("doc_id"), F.col("h.scores").alias("score"), F.col("h.closed").alias("closed"))


def search(docs: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The TOP documents of each item by score: (item_id, rank, doc_id, score); terms, weights and scores as README says.

    Scores are exact. Nulls: a null text has no terms, so such a document is never found and such an item finds
    nothing; a document with a null id is ranked like any other, behind equal scores with an id. Rows are documents
    and items of their own, repeated ones too, each with its own ranks; among rows equal in score and id either may
    come first. Empty and very long texts are taken whole. Ties in score go by ascending doc_id. Items with fewer
    documents of a score above 0 return those. An empty table on either side gives an empty table. Other columns
    don't matter, whatever their names.
    """
    asked = items.select(F.col(item_col).alias("item_id"), F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(TERM), F.lit(0)).alias("t"))
    asked = materialize(asked.select(F.monotonically_increasing_id().alias("item"), "item_id", "t"), "items")
    each = asked.select("item", F.explode("t").alias("term")).groupBy("item", "term").agg(F.count("*").alias("k"))
    index = TieredIndex(docs, each.select("term").distinct(), id_col, text_col)
    weight = F.floor(1000 * F.log((F.lit(2 * index.n_docs + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = each.join(index.terms, "term").select("tid", F.floor(F.col("item") / BLOCK).cast("long").alias("block"), F.pmod("item", F.lit(BLOCK)).cast("int").alias("i"), (F.col("k") * weight).alias("w"))
    words = weighed.where("w > 0").groupBy("block", "tid").agg(F.collect_list(F.struct("i", "w")).alias("q"))
    words = words.select("block", "tid", F.col("q.i").alias("items"), F.col("q.w").alias("weights"))
    own = words.select("block").distinct().select("block", F.lit(_DOCS).cast("long").alias("tid"), F.array().cast("array<int>").alias("items"), F.array().cast("array<long>").alias("weights"))
    words = materialize(words.unionByName(own), "weights")
    done, pending = None, None
    for tier in range(len(TIERS) + 1):
        rows = index.index.where(F.col("tier") <= tier).join(words, "tid")
        if pending is not None:
            rows = rows.join(pending, ["segment", "block"])
        found = materialize(rows.groupBy("segment", "block").applyInPandas(_bounds, _FOUND), "bounds")
        hits = _exploded(found)
        known = hits.select("item", "doc_id", "score")
        if done is not None:
            known = known.unionByName(done)
        cut = _ranked(known).groupBy("item").agg(F.min(F.when(F.col("rank") == TOP, F.col("score"))).alias("cut"))
        cut = materialize(cut.select("item", F.coalesce("cut", F.lit(0)).cast("long").alias("cut")), "cuts")
        judged = found.join(cut, "item", "left").withColumn("open", (F.col("bound") > 0) & (F.col("bound") >= F.coalesce("cut", F.lit(0))))
        proved = _exploded(judged.where("NOT open")).where("closed").join(cut, "item").where("score >= cut").select("item", "doc_id", "score")
        done = materialize(proved if done is None else done.unionByName(proved), "proved")
        left = judged.where("open").select("segment", F.floor(F.col("item") / BLOCK).cast("long").alias("block"), F.pmod("item", F.lit(BLOCK)).cast("int").alias("i"))
        pending = materialize(left.groupBy("segment", "block").agg(F.collect_list("i").alias("pending")), "pending")
        if not pending.limit(1).count():
            break
    best = _ranked(done).join(asked.select("item", "item_id"), "item")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
),
s AS (SELECT count(*)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, s),
q AS (
  SELECT i, item_id, term, count(*)::BIGINT AS k FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
),
c AS (
  SELECT i, item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY i, item_id, r, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY rank <= 20
"""
