"""Word lists, patterns, weights and thresholds that results depend on.

Patterns are written in the common subset of Java and RE2 syntax, so that the SQL of the queries can
use the same text.
"""

from __future__ import annotations

# Extraction strategies in rank order, with their weights in votes.
ENGINE_WEIGHTS = {
    "static_requests": 0.80,
    "static_httpx": 0.80,
    "static_urllib": 0.80,
    "headless_playwright": 0.90,
    "dom_interaction": 0.90,
    "network_observe": 0.95,
    "structured_metadata": 1.00,
    "session_auth": 0.70,
    "file_data": 0.65,
    "crawl_discovery": 0.65,
    "search_index": 0.75,
    "visual_ocr": 0.60,
    "hybrid": 0.70,
    "ai_assist": 0.50,
    "endpoint_probe": 0.75,
    "secret_scan": 0.85,
}
ENGINE_RANK = {name: k for k, name in enumerate(ENGINE_WEIGHTS)}
DEFAULT_WEIGHT = 0.70

# How much each field counts in the overall confidence.
FIELD_IMPORTANCE = {
    "main_content": 0.20,
    "title": 0.15,
    "description": 0.10,
    "links": 0.10,
    "headings": 0.10,
    "structured_data": 0.10,
    "images": 0.05,
    "meta_tags": 0.05,
    "forms": 0.05,
    "detected_endpoints": 0.05,
    "leaked_secrets": 0.05,
    "canonical_url": 0.03,
    "language": 0.03,
    "page_type": 0.02,
    "keywords": 0.02,
}
DEFAULT_IMPORTANCE = 0.01

VOTE_FIELDS = ("language", "title", "canonical_url", "page_type")
LONGEST_FIELDS = ("main_content", "description")
UNION_FIELDS = ("links", "images", "headings", "tables", "forms", "lists", "keywords", "detected_api_data", "detected_endpoints", "leaked_secrets")
DICT_FIELDS = ("structured_data", "meta_tags", "semantic_zones", "entities", "endpoint_probe_summary", "secret_scan_summary")

NOISE_WORDS = ("loading", "please wait", "no records", "click here", "read more", "learn more", "back to top", "follow us")
RELIABILITY_PENALTY = (
    r"(?i)404|timeout|timed.?out|ocr.*(empty|no text|fail)|tesseract|missing.*(depend|install)|engine.*crash|connection.*error|ssl.*error"
)

# Words without weight in fingerprints, in overlap scores and in keyword lists.
SIMHASH_STOPWORDS = (
    "a an the and or but in on at to for with of is are was were be been have has had do does did will would could "
    "should may this that it its by from as not no"
).split()
OVERLAP_STOPWORDS = [w for w in SIMHASH_STOPWORDS if w != "may"]
KEYWORD_STOPWORDS = "the a an and or in on at to for of with is are was were be been by this that it its from as have had".split()

# Patterns on pages.
LANG_ATTRIBUTE = r"""(?i)<html[^>]+\blang=["']([a-zA-Z]{2,8}(?:-[a-zA-Z0-9]{2,8})*)["']"""
LANG_META = r"""(?i)<meta[^>]+http-equiv=["']content-language["'][^>]+content=["']([^"']+)["']"""
LANG_META_REVERSED = r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+http-equiv=["']content-language["']"""
CANONICAL = r"""(?i)<link[^>]*\brel=["']?canonical["']?[^>]*\bhref=["']([^"']+)["']"""
CANONICAL_REVERSED = r"""(?i)<link[^>]*\bhref=["']([^"']+)["'][^>]*\brel=["']?canonical["']?"""
OG_TYPE = r"""(?i)<meta[^>]*\bproperty=["']og:type["'][^>]*\bcontent=["']([^"']*)["']"""
LD_TYPE = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>[^<]*?"@type"\s*:\s*"([^"]+)\""""
PAGE_HOME = r"(?i)^https?://[^/]+(/?|/index(\.[a-z]{2,4})?|/home/?)?$"
PAGE_ARTICLE = r"(?i)<(?:article|main)[^>]*>"
PAGE_BLOG = r"(?i)/blog/|/news/|/post/|/article/"
PAGE_PRODUCT = r"(?i)/product/|/shop/|/store/|/item/"
PAGE_SEARCH = r"(?i)[?&](?:q|query|search)="
PAGE_CONTACT = r"(?i)/contact|/about|/reach-us"
NOISE_LINE = (
    r"(?i)^(?:no records?(?: available)?[!.]?|loading\.{0,3}|please wait\.{0,3}|click here|read more|learn more|see more|show more"
    r"|back to top|scroll to top|cookie(?:s)?(?: policy| consent)?|accept all cookies|privacy policy|terms(?: of(?: use|service))?"
    r"|all rights reserved|copyright \d{4}|© \d{4}|subscribe|sign up(?: now)?|log(?: ?in|out)|follow us|share this|tweet|[←-⇿])$"
)
# Matched in lower-cased pages.
SPA_SIGNATURES = ("react", "__next_data__", "_nuxt_", "ng-version", "vue", "angular", "ember", "svelte", "window.__store__")
API_SIGNATURES = ("application/json", "xmlhttprequest", "fetch(", "axios", "/api/", "graphql")
FILE_CONTENT_TYPES = ("pdf", "csv", "excel", "xml", "json", "spreadsheet", "octet-stream")

# Challenge pages.
CAPTCHA_CLOUDFLARE = (
    r"(?i)<title>\s*Just a moment\.{0,3}\s*</title>",
    r'(?i)id="cf-challenge-running"',
    r'(?i)id="challenge-form"',
    r"(?i)Checking if the site connection is secure",
    r"(?i)cdn-cgi/challenge-platform",
    r"(?i)__cf_chl_managed_tk__",
)
CAPTCHA_TURNSTILE = r'(?i)class="cf-turnstile"|src="[^"]*challenges\.cloudflare\.com/turnstile|turnstile\.render'
CAPTCHA_HCAPTCHA = r"""(?is)class="h-captcha"|data-sitekey=["']([^"']+)["'].*h-captcha|src="[^"]*hcaptcha\.com/1/api\.js"""
CAPTCHA_V3 = r'(?i)grecaptcha\.execute\s*\(|src="[^"]*recaptcha/api\.js\?render=([^"&]+)"'
CAPTCHA_V2 = r"""(?i)class="g-recaptcha"|data-sitekey=["']([^"']+)["']|src="[^"]*google\.com/recaptcha/api\.js|grecaptcha\.render"""
SITEKEYS = (
    r"""(?i)data-sitekey=["']([^"']{20,})["']""",
    r"""(?i)grecaptcha\.execute\s*\(\s*["']([^"']+)["']""",
    r"""(?i)turnstile\.render\s*\([^,]*,\s*\{[^}]*sitekey\s*:\s*["']([^"']+)["']""",
)

# URLs.
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid", "_ga", "_gl", "mc_cid", "mc_eid")
PATH_HIGH_VALUE = (
    r"(?i)/(?:about|contact|course|program(?:me)?|department|faculty|people|team|news|event|service|product|research|publication|admission|gallery|media)(?:/|$)"
)
PATH_LOW_VALUE = (
    r"(?i)/(?:login|logout|signin|signup|cart|checkout|policy|terms|privacy|cookie|legal|sitemap|feed|rss|cdn-cgi|wp-json|wp-admin|wp-login|static|assets|_next|__webpack|node_modules)(?:/|$)"
)
LINK_SKIP = r"^(#|javascript:|mailto:|tel:|data:)"
API_PATHS = ((r"/api/|/v\d+/|/rest/|/service/|/ws/|/gql", 3), (r"/graphql|/query|/mutation", 3), (r"(\.json|\.xml)$", 2), (r"/admin|/management|/actuator|/health|/metrics|/debug|/config|/env|/secret", 4))
SENSITIVE_PATH = r"(?i)/(?:admin|debug|management|actuator|env|secret|config|token|credentials|internal|private|backup|test|phpinfo|console|shell|root|passwd|shadow)"
MAX_URL_LENGTH = 2048
BLOCKED_HOSTS = ("localhost", "broadcasthost", "ip6-localhost", "ip6-loopback", "ip6-allnodes", "ip6-allrouters")
PRIVATE_NETS = (
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "0.0.0.0/8",
    "100.64.0.0/10",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
    "255.255.255.255/32",
)

# Calls and routes in scripts.
JS_PATTERNS = {
    "fetch_api": r"""(?i)fetch\s*\(\s*['"`]([^'"`\s\)]+)['"`]""",
    "axios": r"""(?i)axios\s*\.\s*(?:get|post|put|patch|delete|head|request)\s*\(\s*['"`]([^'"`\s\)]+)['"`]""",
    "jquery_ajax": r"""(?i)\$\s*\.\s*(?:get|post|ajax|getJSON)\s*\(\s*['"`]([^'"`\s\)]+)['"`]""",
    "xhr_open": r"""(?i)\.open\s*\(\s*['"`](?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)['"`]\s*,\s*['"`]([^'"`\s\)]+)['"`]""",
    "superagent": r"""(?i)(?:superagent|request|got|ky)\s*(?:\.\s*)?(?:get|post|put|patch|delete)\s*\(\s*['"`]([/][^'"`\s\)]+)['"`]""",
    "const_assign": r"""(?i)(?:api|endpoint|url|path|route|base|resource|service)[A-Za-z0-9_]*\s*[=:]\s*['"`]([/][^'"`\s\)]{3,})['"`]""",
    "router_path": r"""(?im)(?:^|[,{\s])path\s*:\s*['"`]([/][^'"`\s\)]{2,})['"`]""",
    "express_route": r"""(?i)(?:router|app)\s*\.\s*(?:get|post|put|patch|delete|all|use)\s*\(\s*['"`]([/][^'"`\s\)]+)['"`]""",
    "angular_http": r"""(?i)(?:http|this\.http)\s*\.\s*(?:get|post|put|patch|delete)\s*\(\s*['"`]([^'"`\s\)]+)['"`]""",
    "template_literal": r"""(?i)`([/][^`\$\s]{3,})\$\{""",
}
API_HREF = r"(?i)(?:/api/|/v\d+/|/rest/|/graphql|/gql|/service/|/ws/|/_/)|\.(?:json|xml|yaml)$"
COMMENT_URL = r"""(?i)https?://[^\s"'<>]+|/[a-zA-Z0-9/_?&=%#.\-]{5,}"""
SOURCE_MAP = r"(?i)//# sourceMappingURL=(.+\.map)"
WEBSOCKET = r"""(?i)new\s+WebSocket\s*\(\s*['"`](wss?://[^'"`\s\)]+)['"`]"""

# Entities in text.
EMAIL_FIND = r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9_\-]+\.[a-zA-Z]{2,8}"
EMAIL_STRICT = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}$"
)
PHONE_FIND = r"(?:(?:\+|00)\d{1,3}[\s\-\.]?)?(?:\(?\d{2,4}\)?[\s\-\.]?){2,5}\d{3,4}"
ADDRESS_KEYWORDS = (
    "street|st|avenue|ave|road|rd|lane|ln|blvd|boulevard|nagar|marg|district|pin|pincode|zip|postal|city|state|province|sector|phase"
    "|floor|building|tower|campus|plot|block"
)
# Java and RE2 differ on what \b means next to letters outside ASCII, so word ends are spelled out.
ADDRESS_WORDS = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{ADDRESS_KEYWORDS})(?:[^\p{{L}}\p{{N}}_]|$)"
GARBAGE_RUN = r"[^\x20-\x7E\n\r\t\x{a0}-\x{ff}]{5,}"

# Error messages. First match wins.
ERROR_TAXONOMY = (
    ("timeout", r"(?i)timeout|timed.?out|deadline|read.*error"),
    ("bot_blocked", r"(?i)403|captcha|bot.*detected|access.*denied|cloudflare|distil"),
    ("not_found", r"(?i)404|not.?found|page.*doesn.*exist"),
    ("empty_content", r"(?i)empty|no.*content|zero.*chars?|insufficient.*text|<200 chars"),
    ("parse_error", r"(?i)parse|lxml|beautifulsoup|xml.*error|malformed"),
    ("ssl_error", r"(?i)ssl|certificate|cert.*verify|handshake"),
    ("connection", r"(?i)connection.*refused|connection.*reset|network.*unreachable|getaddrinfo"),
    ("llm_error", r"(?i)openai|ollama|llm|gpt|api.*key|rate.*limit.*ai"),
    ("server_error", r"(?i)5[0-9]{2}|internal.*server.*error|bad.*gateway|service.*unavailable"),
    ("playwright", r"(?i)playwright|chromium|browser.*crash|page.*crashed"),
)
# Words in lower-cased messages -> code. First match wins; E901 otherwise.
ERROR_WORDS = (
    (("timeout", "timed out", "hard timeout"), "E001"),
    (("connection refused", "refused"), "E101"),
    (("connection reset", "reset by peer", "broken pipe"), "E102"),
    (("cannot resolve", "dns", "getaddrinfo"), "E103"),
    (("ssl",), "E104"),
    (("http 4", "http 5", "status code"), "E105"),
    (("robots",), "E401"),
    (("429", "rate limit", "too many requests"), "E402"),
    (("ssrf",), "E404"),
    (("memory",), "E501"),
    (("byte budget", "budget exceeded"), "E502"),
    (("captcha",), "E601"),
    (("not installed", "import", "module"), "E701"),
    (("cancel", "skipped"), "E903"),
)
# code: (name, category, retryable)
ERROR_CODES = {
    "E001": ("ENGINE_TIMEOUT", "timeout", True),
    "E002": ("JOB_TIMEOUT", "timeout", False),
    "E003": ("NAVIGATION_TIMEOUT", "timeout", True),
    "E101": ("CONNECTION_REFUSED", "network", True),
    "E102": ("CONNECTION_RESET", "network", True),
    "E103": ("DNS_FAILURE", "network", False),
    "E104": ("SSL_ERROR", "network", True),
    "E105": ("HTTP_ERROR", "network", False),
    "E201": ("HTML_PARSE_ERROR", "parse", False),
    "E202": ("JSON_PARSE_ERROR", "parse", False),
    "E203": ("ENCODING_ERROR", "parse", False),
    "E204": ("EMPTY_RESPONSE", "parse", True),
    "E301": ("LOGIN_FAILED", "auth", True),
    "E302": ("SESSION_EXPIRED", "auth", True),
    "E303": ("SIGNUP_FAILED", "auth", False),
    "E401": ("ROBOTS_DISALLOWED", "policy", False),
    "E402": ("RATE_LIMITED", "policy", True),
    "E403": ("BLOCKED_BY_SITE", "policy", False),
    "E404": ("SSRF_BLOCKED", "policy", False),
    "E501": ("MEMORY_EXCEEDED", "resource", False),
    "E502": ("BYTE_BUDGET_EXCEEDED", "resource", False),
    "E503": ("FILE_TOO_LARGE", "resource", False),
    "E504": ("SCREENSHOT_TOO_LARGE", "resource", False),
    "E601": ("CAPTCHA_DETECTED", "captcha", True),
    "E602": ("CAPTCHA_UNSOLVABLE", "captcha", False),
    "E701": ("MISSING_DEPENDENCY", "config", False),
    "E702": ("INVALID_CONFIG", "config", False),
    "E901": ("UNKNOWN", "internal", False),
    "E902": ("ENGINE_CRASH", "internal", False),
    "E903": ("CANCELLED", "internal", False),
}
TRANSIENT_WORDS = ("timeout", "timed out", "connection", "refused", "reset", "temporary", "503", "429", "network", "unavailable", "eof", "broken pipe", "ssl")

# Element classes that mark page zones, and elements without content.
HERO_CLASSES = {"hero", "jumbotron", "banner", "carousel", "slider", "masthead", "showcase", "featured"}
SIDEBAR_CLASSES = {"sidebar", "side-bar", "widget", "widgets", "aside"}
NAV_CLASSES = {"navbar", "nav", "navigation", "menu", "header", "topbar", "top-bar", "site-header"}
FOOTER_CLASSES = {"footer", "site-footer", "page-footer"}
NOISE_TAGS = {"nav", "header", "footer", "aside", "script", "style", "noscript", "form", "button", "iframe", "svg"}

# Limits of a normalised record.
CAPS = {"main_content": 10_000, "links": 500, "images": 200, "tables": 50, "forms": 20, "lists": 50, "keywords": 50, "raw_html": 8192}

PAGE_RESULT = {"main_content": 2000, "headings": 20, "links": 50}
SNAPSHOT = {"description": 500, "main_content": 2000}
PARALLEL = ("static_requests", "static_httpx", "static_urllib", "structured_metadata", "search_index", "file_data", "endpoint_probe", "secret_scan")
CORS_PROBES, ACTIVE_PROBES = 25, 30
BAN_FAILURES, BAN_SECONDS = 3, 300
QUEUE_TTL_S = 3600

# Thresholds.
CLUSTER_SIMILARITY = 0.82
SIMHASH_DISTANCE = 8
HALLUCINATION_OVERLAP = 0.25
MIN_ALPHA_RATIO = 0.40
RESCRAPE_CONFIDENCE = 0.35
FAILURE_RATIO = 0.70
MIN_OBSERVATIONS = 3
REDESIGN_RATIO = 0.40
THIN_BODY, THIN_HYBRID = 150, 200
DEAD_SELECTOR_MISSES = 3
LATENCY_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0)

# The engines that page analysis selects, in order.
SELECT_ALWAYS = ("static_requests", "static_httpx", "static_urllib", "structured_metadata", "search_index", "endpoint_probe", "secret_scan")
SELECT_JS = ("headless_playwright", "dom_interaction", "network_observe")
SELECT_FILE = ("file_data",)
SELECT_EXTENDED = ("visual_ocr", "crawl_discovery", "hybrid")
SELECT_AUTH = ("session_auth",)
SELECT_AI = ("ai_assist",)
SELECT_BROWSER = ("headless_playwright", "dom_interaction", "visual_ocr")
