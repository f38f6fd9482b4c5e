"""A small, forgiving HTML reader: tags, text and implied ends, in one pass over the source."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

TAG = re.compile(r"<(?:(/?)([A-Za-z][A-Za-z0-9:_-]*)|!--|[!?])")
SPECIAL = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?:\s|=|$|/)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""")

#: Fixed values of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp template".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: A start tag of the key's set ends an open element of the key.
ENDS = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
        "header hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}
#: An implied end does not reach out of these.
SCOPE = frozenset("ul ol dl table article section main aside nav div body html".split())

#: Elements that never hold an article's text.
APART = frozenset(
    "nav aside footer form script style noscript template iframe button select textarea svg canvas object "
    "head title menu dialog".split()
)
#: Words of class, id or role that say the same.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "contentinfo cookie cookies disqus footer masthead menu modal navbar navigation nav newsletter notice notices "
    "pager pagination popup promo promotion related replies share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget".split()
)
#: Those of them that an article can be by itself: then it is not the page's own.
ASIDE_ARTICLES = frozenset("ad ads advert advertisement comment comments promo related sponsored".split())
WORDS = re.compile(r"[a-z]+|\d+")
WHITE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    name: str = ""  # tag with its class words, which tells templates' parts apart
    apart: bool = False
    by_words: bool = False  # apart for its class, id or role alone
    holds_others: bool = False  # articles in it are not the page's own
    items: list = field(default_factory=list)  # nodes and strings in order


def _start(tag: str, attributes: str, inside_article: bool) -> Node:
    node = Node(tag, tag)
    if attributes:
        said = [value.strip("\"'").lower() for _, value in ATTRIBUTE.findall(attributes)]
        words = [w for value in said for w in WORDS.findall(value) if not w.isdigit()]
        if words:
            node.name = tag + "." + ".".join(dict.fromkeys(words))
        telling = APART_WORDS & ASIDE_ARTICLES if tag == "article" else APART_WORDS
        node.by_words = tag not in ("body", "html", "main") and not telling.isdisjoint(words)
        node.holds_others = node.by_words and not ASIDE_ARTICLES.isdisjoint(words)
        node.apart = node.by_words or bool(HIDDEN.search(attributes))
    if tag in APART or tag == "header" and not inside_article:
        node.apart = True
    return node


class _TagEnds:
    """Where tags end: at the first ``>`` outside quotes. Remembers what it has seen, so that all questions of a page
    together take time in proportion to its length."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.begun, self.special = 0, -1  # the last search of a special character, and what it found
        self.closing: dict[int, int] = {}
        self.dead: set[int] = set()  # places outside quotes from which no end follows

    def _special(self, at: int) -> int:
        if not self.begun <= at <= self.special:
            found = SPECIAL.search(self.source, at)
            self.begun, self.special = at, found.start() if found else len(self.source)
        return self.special

    def __call__(self, at: int) -> int:
        """The place of the ``>`` for a tag whose name ends at ``at``, or -1: then it is no tag."""
        if at > self.last:
            return -1
        first = self._special(at)
        here, passed = first, []
        while here < len(self.source) and here not in self.dead:
            if self.source[here] == ">":
                return here
            passed.append(here)
            if here not in self.closing:
                self.closing[here] = self.source.find(self.source[here], here + 1)
            close = self.closing[here]
            if close < 0:
                break
            found = SPECIAL.search(self.source, close + 1)
            here = found.start() if found else len(self.source)
        self.dead.update(passed)
        return -1


class _Open:
    """The open elements, and what has to be known of them without looking through all."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.near = [0]  # for each, the place of the nearest one that is not inline
        self.tags = Counter()
        self.holders = 0

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.near.append(self.near[-1] if node.tag in INLINE else at)
        self.nodes.append(node)
        self.tags[node.tag] += 1
        self.holders += node.holds_others

    def cut(self, depth: int) -> None:
        for node in self.nodes[depth:]:
            self.tags[node.tag] -= 1
            self.holders -= node.holds_others
        del self.nodes[depth:], self.near[depth:]

    def end(self, tag: str) -> None:
        """An end tag: an inline one does not reach out of the element that is not inline around it."""
        if not self.tags[tag]:
            return
        for depth in range(len(self.nodes) - 1, 0, -1):
            if self.nodes[depth].tag == tag:
                return self.cut(depth)
            if tag in INLINE and self.nodes[depth].tag not in INLINE:
                return

    def imply_ends(self, tag: str) -> None:
        while len(self.nodes) > 1:
            depth = self.near[-1]
            if not depth or tag not in ENDS.get(self.nodes[depth].tag, ()):
                return
            self.cut(depth)


def parse(source: str) -> Node:
    """The tree of a page. Comments go; unknown or unclosed tags are taken as they come; what looks like a tag but has no
    end is text. Takes time in proportion to the length of the page, however it is nested."""
    root = Node("", "")
    held, ends = _Open(root), _TagEnds(source)
    at = looked = 0
    while True:
        found = TAG.search(source, looked)
        if not found:
            if at < len(source):
                held.nodes[-1].items.append(source[at:])
            return root
        looked, tag = found.end(), found[2]
        if tag is not None:
            close = ends(looked)
        elif source.startswith("<!--", found.start()):
            close = source.find("-->", found.start() + 2) + 2
            close = len(source) if close < 2 else close
        else:
            close = source.find(">", looked) if looked <= ends.last else -1
        if close < 0:
            continue
        if found.start() > at:
            held.nodes[-1].items.append(source[at : found.start()])
        attributes = source[looked:close]
        at = looked = close + 1
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            held.end(tag)
            continue
        held.imply_ends(tag)
        node = _start(tag, attributes, held.tags["article"] > 0)
        if tag in ("article", "main") and not node.apart and not held.holders:
            for n in held.nodes:  # a class such as "with-sidebar" around the article says nothing about it
                n.apart = n.apart and not n.by_words
        held.nodes[-1].items.append(node)
        if tag in RAW:
            end = re.compile(f"(?i)</{tag}").search(source, at)
            begin = len(source) if end is None else end.start()
            close = source.find(">", begin)
            at = looked = len(source) if end is None or close < 0 else close + 1
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            held.push(node)


def blocks(node: Node) -> list[str]:
    """Text blocks of a subtree in order, without parts that stand apart; white space is made single."""
    found: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = WHITE.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text:
            found.append(text)

    todo: list = [node]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(item)
        elif item.apart:
            if item.tag not in INLINE:
                end()
        elif item.tag == "br":
            line.append("\n")
        elif item.tag in INLINE:
            todo.extend(reversed(item.items))
        else:
            end()
            todo.append(None)
            todo.extend(reversed(item.items))
    end()
    return found
