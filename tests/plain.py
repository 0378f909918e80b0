"""Plain versions of the queries that SQL doesn't express: name -> (columns to compare, function of (DuckDB connection) -> rows).

They work on every row of the tables with the standard library alone, by other means than the library's: regular
expressions on the generated pages in place of a tree, loops in place of joins.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from difflib import unified_diff
from urllib.parse import urljoin

from weftline import constants as C

_VOID = re.compile(r"<(br|meta|img|input|hr|link)\b[^>]*>", re.I)


def _text(fragment: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", fragment))).split())


def _pages(con):
    return con.sql("SELECT page_id, url, html FROM pages").fetchall()


def _tidy(page: str) -> str:
    return re.sub(r"(?s)<!--.*?-->", "", page)


def _inline(fragment: str) -> str:
    """Text where inline tags leave no blank."""
    return " ".join(html.unescape(re.sub(r"(?is)</?(b|i|a|em|strong|span)\b[^>]*>", "", fragment).replace("<br>", " ")).split())


def headings(con):
    return [(i, json.dumps([[int(n), _text(t)] for n, t in re.findall(r"(?s)<h([1-6])[^>]*>(.*?)</h\1>", p)])) for i, _, p in _pages(con)]


def links(con):
    """Each target once, as first found."""
    found = lambda u, p: {urljoin(u, h): _text(t) for h, t in reversed(re.findall(r'(?s)<a href="([^"]*)">(.*?)</a>', p))}
    order = lambda u, p: dict.fromkeys(urljoin(u, h) for h in re.findall(r'<a href="([^"]*)">', p))
    return [(i, json.dumps([[found(u, p)[h], h] for h in order(u, p)])) for i, u, p in _pages(con)]


def lists(con):
    return [(i, json.dumps([[_text(x) for x in re.findall(r"(?s)<li>(.*?)</li>", ul)] for ul in re.findall(r"(?s)<ul>(.*?)</ul>", p)])) for i, _, p in _pages(con)]


def paragraphs(con):
    out = []
    for i, _, p in _pages(con):
        body = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", _tidy(p))
        parts = re.split(r"<p>", body)[1:]
        texts = [_text(re.split(r"</?(?:p|div|article|footer|ul|body|html)\b", x)[0]) for x in parts]
        out.append((i, json.dumps([t for t in texts if t])))
    return out


def metas(con):
    return [(i, json.dumps([re.search(r'charset="([^"]*)"', m)[1] for m in re.findall(r"<meta[^>]*>", p)])) for i, _, p in _pages(con)]


def nothing(pattern: str):
    """Pages without such an element have none."""
    return lambda con: [(i, not re.search(pattern, p)) for i, _, p in _pages(con)]


def zones(con):
    out = []
    for i, _, p in _pages(con):
        nav, foot = re.search(r"(?s)<nav>(.*?)</nav>", p)[1], re.search(r"(?s)<footer>(.*?)(</footer>|</body>|$)", p)
        out.append((i, _text(nav), _text(foot[1]) if foot else ""))
    return out


def entities(con):
    out = []
    for i, _, p in _pages(con):
        body = _text(re.sub(r"(?s)<head>.*?</head>", "", _tidy(p)))
        out.append((i, json.dumps(list(dict.fromkeys(re.findall(C.EMAIL_FIND, body))))))
    return out


def check_main_content(rows, con):
    """Each page's content is the text of one of its blocks: the article, all its paragraphs, one of them, the advertisement."""
    pages = {i: _tidy(p) for i, _, p in _pages(con)}
    joined = {i: "".join(json.loads(x)).replace(" ", "") for i, x in paragraphs(con)}
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        p = pages[r["page_id"]]
        blocks = [re.search(r"(?s)<article>(.*?)(</article>|$)", p)[1], re.search(r"(?s)<body>(.*)", p)[1], *re.split(r"</?(?:p|div|article|footer|nav)\b[^>]*>", p)]
        found, every = r["main_content"].replace(" ", ""), {joined[r["page_id"]], *(_text(x).replace(" ", "") for x in blocks)}
        assert found in every or (len(r["main_content"]) == C.CAPS["main_content"] and any(x.startswith(found) for x in every)), r["page_id"]


def check_approximate(rows, con):
    """Within five standard errors of the exact number."""
    exact = dict(con.sql("SELECT l_returnflag, count(DISTINCT l_partkey) FROM lineitem GROUP BY 1").fetchall())
    assert {r["l_returnflag"] for r in rows} == set(exact)
    assert all(abs(r["parts"] - exact[r["l_returnflag"]]) <= 0.1 * exact[r["l_returnflag"]] for r in rows)


def css_matches(con):
    out = []
    for i, u, p in _pages(con):
        out += [(i, "h1", _text(t)) for t in re.findall(r"(?s)<article><h1>(.*?)</h1>", p)]
        for nav in re.findall(r"(?s)<nav>(.*?)</nav>", p):
            out += [(i, "a", _text(re.search(r"(?s)<a href=[^>]*>(.*?)</a>", ul)[1])) for ul in re.findall(r"(?s)<ul>(<li>.*?</li>)", nav)]
    return out


def xpath_matches(con):
    return [(i, k, h) for i, _, p in _pages(con) for nav in re.findall(r"(?s)<nav>(.*?)</nav>", p) for k, h in enumerate(re.findall(r'<a href="([^"]*)"', nav))]


def merged(con):
    """Strategies that agree on a page's title and language leave no conflict about them."""
    out = []
    for _, u, p in _pages(con):
        out.append((u, _text(re.search(r"(?s)<title>(.*?)</title>", p)[1]), re.search(r'<html lang="([^"]*)"', p)[1], 3, 3))
    return out


def decisions(con):
    kind = dict.fromkeys(("title", "canonical_url", "language", "page_type"), "weighted_cluster_majority") | dict.fromkeys(C.LONGEST_FIELDS, "longest_with_overlap")
    kind |= dict.fromkeys(C.DICT_FIELDS, "deep_dict_merge")
    fields = [*C.VOTE_FIELDS, *C.LONGEST_FIELDS, *C.UNION_FIELDS, *C.DICT_FIELDS]
    return [(u, f, kind.get(f, "union_merge")) for _, u, _ in _pages(con) for f in fields]


def text_diffs(con):
    turns = {(c, t): x for c, t, x in con.sql("SELECT conv_id, turn, text FROM conversations").fetchall()}
    return [(c, t, "\n".join(unified_diff((turns[c, t - 1] or "").splitlines(), (x or "").splitlines(), lineterm="", n=2))[:5000]) for (c, t), x in turns.items() if (c, t - 1) in turns]


def _distance(a: str, b: str) -> int:
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
    return d[len(a), len(b)]


def _values(con):
    from weftline.plans.catalog import QUERIES

    groups = defaultdict(list)
    for url, engine, field, value in con.sql(f"SELECT url, engine_id, field, value FROM ({QUERIES['engine_results_long'][1]})").fetchall():
        groups[url, field].append((C.ENGINE_RANK[engine], engine, " ".join(value.split()).lower()))
    return {k: sorted(v) for k, v in groups.items()}


def votes(con):
    out = []
    for (url, field), rows in _values(con).items():
        leaders: list[list[tuple[str, float]]] = []
        for _, engine, v in rows:
            w = C.ENGINE_WEIGHTS[engine]
            for group in leaders:
                if 1 - _distance(v, group[0][0]) / max(len(v), len(group[0][0]), 1) >= 0.82:
                    group.append((v, w))
                    break
            else:
                leaders.append([(v, w)])
        best, heavy = None, 0.0
        for size in sorted({len(g) for g in leaders}, reverse=True):
            for g in leaders:
                if len(g) == size and sum(w for _, w in g) > heavy:
                    best, heavy = g, sum(w for _, w in g)
        longest = max(len(v) for v, _ in best)
        out.append((url, field, next(v for v, _ in best if len(v) == longest), round(heavy / sum(C.ENGINE_WEIGHTS[e] for _, e, _ in rows), 3)))
    return out


def title_pairs(con):
    out = []
    for (url, field), rows in _values(con).items():
        if field == "title":
            for k, (_, a, x) in enumerate(rows):
                out += [(url, a, b, _distance(x, y), round(1 - _distance(x, y) / max(len(x), len(y)), 6) if x or y else 1.0) for _, b, y in rows[k + 1 :]]
    return out


def first_lines(con):
    """The merge rule over each source's distinct first lines: a line near an earlier kept one goes, or replaces it if longer."""
    from weftline.operators.merge_fold import simhash

    lines = defaultdict(dict)
    for i, s, t in con.sql("SELECT doc_id, source, split_part(text, chr(10), 1) FROM documents ORDER BY doc_id").fetchall():
        lines[s].setdefault(t, i)
    out = []
    for s, first in lines.items():
        kept: list[tuple[str, int]] = []
        for t in sorted(first, key=lambda t: (first[t], t is not None, t or "")):
            fp = simhash(t or "")
            for k, (other, ofp) in enumerate(kept):
                if (fp ^ ofp).bit_count() <= 8:
                    if len(t or "") > len(other or ""):
                        kept[k] = (t, fp)
                    break
            else:
                kept.append((t, fp))
        out += [(s, t) for t, _ in kept]
    return out


def har_entries(con):
    return [(i, "http://h.example.com/" + kind, round(v, 6), props) for i, kind, v, props in con.sql("SELECT event_id, event_type, value, props FROM events").fetchall()]


def reports(con):
    return [(u, html.escape(_text(re.search(r"(?s)<title>(.*?)</title>", p)[1]))) for _, u, p in _pages(con)]


def _by_user(con):
    users = defaultdict(list)
    for u, i, kind, ts in con.sql("SELECT user_id, event_id, event_type, epoch_us(ts) FROM events ORDER BY ts, event_id").fetchall():
        users[u].append((i, kind, ts))
    return users


def buckets(con):
    out = []
    for u, events in _by_user(con).items():
        tokens, last = 5.0, None
        for i, _, ts in events:
            if last is not None:
                tokens = min(5.0, tokens + (ts - last) / 1e6 / 60)
            last = ts
            ok = tokens >= 1
            tokens -= ok
            out.append((u, i, ok, round(tokens, 4)))
    return out


def queue(con):
    """A job that waits may start, one that runs may pause or finish, a paused one may start again, any of them may be cancelled; new and ended ones may be submitted."""
    control = {"signup": "submit", "view": "start", "click": "pause", "purchase": "finish"}
    out = []
    for u, events in _by_user(con).items():
        status = "new"
        for i, kind, _ in events:
            c, before = control.get(kind, "cancel"), status
            if c == "submit" and status in ("new", "done", "cancelled"):
                status = "pending"
            elif c == "start" and status in ("pending", "paused"):
                status = "running"
            elif c == "pause" and status == "running":
                status = "paused"
            elif c == "finish" and status == "running":
                status = "done"
            elif c == "cancel" and status in ("pending", "running", "paused"):
                status = "cancelled"
            out.append((u, i, status, status != before))
    return out


def _json(column: str, pick):
    return lambda r: (r["page_id"], json.dumps(pick(json.loads(r[column])["v"])))


def _none(column: str):
    return lambda r: (r["page_id"], not json.loads(r[column])["v"])


def _har(r):
    e = json.loads(r["entry"])
    return r["event_id"], e["request"]["url"], round(e["time"], 6), e["response"]["content"]["text"]


PLAIN = {
    "headings_dom": (_json("headings", lambda v: [[h["level"], h["text"]] for h in v]), headings),
    "links_dom": (_json("links", lambda v: [[x["text"], x["href"]] for x in v]), links),
    "lists_dom": (_json("lists", lambda v: [x["items"] for x in v]), lists),
    "paragraphs_dom": (_json("paragraphs", lambda v: v), paragraphs),
    "meta_dom": (_json("meta", lambda v: [m["charset"] for m in v]), metas),
    "forms_dom": (_none("forms"), nothing("<form")),
    "tables_dom": (_none("tables"), nothing("<table")),
    "images_dom": (_none("images"), nothing("<img")),
    "json_ld_dom": (_none("json_ld"), nothing("ld\\+json")),
    "opengraph_dom": (_none("opengraph"), nothing("og:")),
    "semantic_zones": (lambda r: (r["page_id"], json.loads(r["zones"])["v"]["navbar"]["text"], json.loads(r["zones"])["v"].get("footer", {}).get("text", "")), zones),
    "entities_dom": (_json("entities", lambda v: v["emails"]), entities),
    "css_select": (lambda r: (r["page_id"], r["tag"], r["text"]), css_matches),
    "xpath_select": (lambda r: (r["page_id"], r["pos"], r["href"]), xpath_matches),
    "merged_documents": (lambda r: (r["url"], r["title"], r["language"], r["engines_used"], r["engines_succeeded"]), merged),
    "audit_decisions_dom": (lambda r: (r["url"], r["field"], r["reason"].removesuffix(" (conflict)")), decisions),
    "version_text_diff": (lambda r: (r["conv_id"], r["turn"], r["diff"]), text_diffs),
    "vote_clustered": (lambda r: (r["url"], r["field"], r["winner"], r["agreement"]), votes),
    "title_similarity": (lambda r: (r["url"], r["a"], r["b"], r["distance"], r["similarity"]), title_pairs),
    "fuzzy_dedup_headings": (lambda r: (r["source"], r["heading"]), first_lines),
    "har_log": (_har, har_entries),
    "html_report": (lambda r: (r["url"], re.search(r"(?s)<title>(.*?)</title>", r["html"])[1]), reports),
    "token_bucket": (lambda r: (r["user_id"], r["event_id"], r["admitted"], round(r["tokens"], 4)), buckets),
    "stream_queue": (lambda r: (r["key"], r["event_id"], r["status"], r["accepted"]), queue),
}

#: Queries whose rows are checked rather than rebuilt.
CHECKS = {"main_content_dom": check_main_content, "q_approx_distinct": check_approximate}
