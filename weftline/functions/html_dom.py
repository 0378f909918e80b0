"""A small element tree for real-world HTML, built on the standard library's tokenizer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style"))
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A start tag ends open elements of these kinds, up to the nearest element of the second set.
_CLOSES: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tbody": (frozenset(("tr", "td", "th", "thead", "tbody", "tfoot")), frozenset(("table",))),
    "thead": (frozenset(("tr", "td", "th", "thead", "tbody", "tfoot")), frozenset(("table",))),
    "tfoot": (frozenset(("tr", "td", "th", "thead", "tbody", "tfoot")), frozenset(("table",))),
}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    @property
    def classes(self) -> set[str]:
        return set(self.get("class").lower().split())

    def elements(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.elements() if n.tag in tags]

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.elements() if test(n)), None)

    def find(self, *tags: str) -> Node | None:
        return self.first(lambda n: n.tag in tags)

    def own(self, *tags: str) -> list[Node]:
        """Children with one of the tags."""
        return [c for c in self.children if isinstance(c, Node) and c.tag in tags]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def strings(self, skip: frozenset[str] | set[str] = _RAW) -> Iterator[str]:
        """Text pieces in order, without those inside ``skip`` elements below this one."""
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in skip:
                stack.extend(reversed(item.children))

    def text(self, separator: str = "", skip: frozenset[str] | set[str] = _RAW) -> str:
        return separator.join(self.strings(skip))

    def words(self, separator: str = "", skip: frozenset[str] | set[str] = _RAW) -> str:
        """Text with white space collapsed."""
        return " ".join(self.text(separator, skip).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def _close(self, kinds: frozenset[str], until: frozenset[str]) -> None:
        node, hit = self.at, None
        while node is not None and node.tag not in until:
            if node.tag in kinds:
                hit = node
            node = node.parent
        if hit is not None:
            self.at = hit.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in _BLOCKS:
            self._close(frozenset(("p",)), frozenset(("button", "td", "th", "table")))
        kept: dict[str, str] = {}
        for name, value in attrs:
            kept.setdefault(name, value or "")
        node = Node(tag, kept, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except (AssertionError, ValueError):  # the tokenizer gives up on some malformed declarations; what it has read stays
        pass
    return builder.root


# ---------------------------------------------------------------- selectors
_SIMPLE = re.compile(r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[~^$*|]?=)(?P<q>["']?)(?P<val>[^\]"']*)(?P=q))?\]|:(?P<pos>first-child|last-child)""")


def _compound(text: str) -> Callable[[Node], bool]:
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"selector not supported: {text!r}")
        at = m.end()
        g = m.groupdict()
        if g["tag"]:
            if g["tag"] != "*":
                tests.append(lambda n, t=g["tag"].lower(): n.tag == t)
        elif g["id"]:
            tests.append(lambda n, v=g["id"]: n.get("id") == v)
        elif g["cls"]:
            tests.append(lambda n, v=g["cls"]: v in n.get("class").split())
        elif g["pos"]:
            k = 0 if g["pos"] == "first-child" else -1
            tests.append(lambda n, k=k: [c for c in n.parent.children if isinstance(c, Node)][k] is n)
        elif not g["op"]:
            tests.append(lambda n, a=g["attr"].lower(): a in n.attrs)
        else:
            compare = {
                "=": lambda x, v: x == v,
                "~=": lambda x, v: v in x.split(),
                "^=": lambda x, v: bool(v) and x.startswith(v),
                "$=": lambda x, v: bool(v) and x.endswith(v),
                "*=": lambda x, v: bool(v) and v in x,
                "|=": lambda x, v: x == v or x.startswith(v + "-"),
            }[g["op"]]
            tests.append(lambda n, a=g["attr"].lower(), v=g["val"], f=compare: a in n.attrs and f(n.attrs[a], v))
    if not tests and text != "*":
        raise ValueError(f"selector not supported: {text!r}")
    return lambda n: all(t(n) for t in tests)


def select(root: Node, selector: str) -> list[Node]:
    """Elements that match a CSS selector: compounds of tag, #id, .class, [attr] and :first/last-child, blanks, > and commas."""
    chains = []
    for one in selector.split(","):
        parts = re.findall(r"""(?:\[[^\]]*\]|[^\s>\[])+|>""", one.strip())
        if not parts or parts[-1] == ">":
            raise ValueError(f"selector not supported: {selector!r}")
        chain, direct = [], False
        for p in parts:
            if p == ">":
                direct = True
            else:
                chain.append((_compound(p), direct))
                direct = False
        chains.append(chain)

    def holds(node: Node, chain: list, k: int) -> bool:
        test, direct = chain[k]
        if not test(node):
            return False
        if k == 0:
            return True
        above = [node.parent] if direct else node.ancestors()
        return any(a is not None and a.tag != "#document" and holds(a, chain, k - 1) for a in above)

    return [n for n in root.elements() if any(holds(n, c, len(c) - 1) for c in chains)]


_STEP = re.compile(r"(//?)(text\(\)|@[\w:-]+|[\w*-]+)((?:\[[^\]]*\])*)")
_TEST = re.compile(r"""\[(?:(\d+)|@([\w:-]+)(?:\s*=\s*["']([^"']*)["'])?|contains\(\s*@([\w:-]+)\s*,\s*["']([^"']*)["']\s*\))\]""")


def xpath(root: Node, expression: str) -> list[Node | str]:
    """Absolute XPath of steps /tag, //tag, /@attr, /text() with [n], [@a], [@a='v'] and [contains(@a,'v')]."""
    at: list[Node | str] = [root]
    pos = 0
    while pos < len(expression):
        m = _STEP.match(expression, pos)
        if not m:
            raise ValueError(f"expression not supported: {expression!r}")
        pos = m.end()
        deep, name, tests = m[1] == "//", m[2], m[3]
        found: list[Node | str] = []
        for node in at:
            if isinstance(node, str):
                continue
            scope = [node, *node.elements()] if deep else [node]
            if name.startswith("@"):
                found += [n.attrs[name[1:]] for n in scope if name[1:] in n.attrs]
            elif name == "text()":
                found += [c for n in scope for c in n.children if isinstance(c, str)]
            else:
                for n in scope:
                    group = [c for c in n.children if isinstance(c, Node) and name in ("*", c.tag)]
                    read = 0
                    for t in _TEST.finditer(tests):
                        read += len(t[0])
                        if t[1]:
                            group = group[int(t[1]) - 1 : int(t[1])]
                        elif t[2]:
                            group = [c for c in group if t[2] in c.attrs and (t[3] is None or c.attrs[t[2]] == t[3])]
                        else:
                            group = [c for c in group if t[5] in c.get(t[4])]
                    if read != len(tests):
                        raise ValueError(f"expression not supported: {expression!r}")
                    found += group
        seen: set[int] = set()
        at = [f for f in found if isinstance(f, str) or not (id(f) in seen or seen.add(id(f)))]
    return at
