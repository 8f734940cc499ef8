"""A forgiving reader of HTML: the blocks of text of a page, and the tree they stand in."""

from __future__ import annotations

import html
import re
from collections import Counter

#: Fixed values of the HTML and MathML standards.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea select annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mover munder munderover mfenced menclose mpadded mstyle mspace semantics".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An opening tag ends an open element of these kinds, up to the container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
#: Words in classes, ids and roles that mark what is not main text, what may follow or
#: stand before such a word without a change of sense, and words whose header is a text's own.
AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar aside rail widget widgets related recommended recommendations trending "
    "cookie cookies consent gdpr notice notices alert popup modal overlay dialog toast "
    "share sharing social follow subscribe subscription newsletter signup login signin register search form "
    "comment comments reply replies respond discussion disqus pagination pager paging toolbar tools copyright legal "
    "complementary contentinfo".split()
)
#: Those of the words that have another sense inside a text: there they do not decide alone.
WEAK_WORDS = frozenset("header masthead search form widget widgets tools toolbar rail legal copyright alert dialog register trending discussion follow".split())
PARTS = frozenset("area bar block bottom box boxes button buttons container content count form group holder inner item items label left link links list listing main menu module outer panel posts right row section slot stories strip text thread title top unit widget wrap wrapper".split())
MODIFIERS = frozenset("with has no not without is js show hide before after".split())
OWN = frozenset("article entry post story section content".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[/!?]?[a-zA-Z](?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*>|<[/!?]?[a-zA-Z][^<>]*>|[^<]+|<", re.S)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"[0-9]+")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def attributes(tag: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(tag)}


def marks_away(token: str) -> str:
    """"!" if a class, id or role names something beside the text, "~" if it does by a weak word, else "".

    Its last word tells ("cookie-notice", "reader-comments"), or its first if parts of pages follow
    ("comment-list"); "with-sidebar", "more-text" and "entry-header" name nothing of the kind."""
    words = WORDS.findall(token)
    if not words or words[0].lower() in MODIFIERS:
        return ""
    first, last = words[0].lower(), words[-1].lower()
    if last == "header" and first in OWN or first == "skip" and last not in ("link", "links", "nav"):
        return ""
    if last in AWAY_WORDS and last not in WEAK_WORDS or first == "skip" and len(words) > 1:
        return "!"
    if first in AWAY_WORDS and all(w.lower() in PARTS for w in words[1:]):
        return "~" if first in WEAK_WORDS else "!"
    return "~" if last in WEAK_WORDS else ""


def key_of(name: str, tag: str) -> str:
    """An element's kind: its name with its classes (figures in them blanked), "!" if class, id or role
    mark it as no main text, "~" if weak words alone do, "^" if they mark it as an article's body, "*" as the main element.

    Ids themselves are left out, so that a site has no more kinds than its templates have."""
    if "=" not in tag:
        return name
    a = attributes(tag)
    classes = sorted(set(a.get("class", "").split()))
    more = "".join(f".{DIGITS.sub('0', c)}" for c in classes)
    role = a.get("role", "").lower()
    marks = set(map(marks_away, (*classes, a.get("id", ""), role)))
    more += "!" if "!" in marks else "~" if "~" in marks else ""
    if a.get("itemprop", "").lower() == "articlebody" or role == "article":
        more += "^"
    if role == "main":
        more += "*"
    return (name + more.lower()).replace(" ", "")


class Page:
    """One page: blocks (text, characters in links), its title, links and language.

    tree, if asked for, is nested [key, children] with a block's number for a block of text."""

    def __init__(self, source: str | None, tree: bool = False, links: bool = False):
        self.blocks: list[tuple[str, int]] = []
        self.title: str | None = None
        self.lang: str | None = None
        self.links: list[tuple[str, str]] = []
        self.root: list = ["", []]
        stack: list[tuple[str, list]] = [("", self.root)]  # name, node
        opened: Counter[str] = Counter()
        text: list[str] = []
        in_link, link_chars = 0, 0
        skip: str | None = None
        depth = 0

        def flush() -> None:
            nonlocal link_chars
            if text:
                block = "".join(text)
                if "&" in block:
                    block = html.unescape(block)
                block = " ".join(block.split())
                if block:
                    if tree:
                        stack[-1][1][1].append(len(self.blocks))
                    self.blocks.append((block, link_chars))
                text.clear()
            link_chars = 0

        def cut(i: int) -> None:
            opened.subtract(x[0] for x in stack[i:])
            del stack[i:]

        def close(name: str, stop: frozenset | set = frozenset()) -> bool:
            if not opened[name]:
                return False
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    flush()
                    cut(i)
                    return True
                if stack[i][0] in stop:
                    return False
            return False

        for token in TOKEN.findall(source or ""):
            first = token[0]
            if skip is not None:
                if first == "<" and (m := NAME.match(token)) and m[1].lower() == skip:
                    depth += -1 if token[1] == "/" else skip not in ("script", "style", "textarea")
                    if depth <= 0:
                        if skip == "title" and text:
                            self.title = self.title or " ".join(html.unescape("".join(text)).split())
                            text.clear()
                        skip = None
                elif skip == "title":
                    text.append(token)
                continue
            if first != "<" or token == "<":
                text.append(token)
                if in_link:
                    link_chars += len(token)
                continue
            m = NAME.match(token)
            if m is None:
                continue  # comment, doctype, processing instruction
            name = m[1].lower()
            if name in INLINE:
                if name == "a":
                    in_link = token[1] != "/"
                    if links and in_link and (href := attributes(token).get("href")):
                        self.links.append((href, ""))
                elif name in ("br", "img", "wbr"):
                    text.append(" " if name != "wbr" else "")
                continue
            if token[1] == "/":
                if name == "p" or not close(name, {"table"} if name not in ("table", "body", "html") else frozenset()):
                    close(name)
                continue
            if name in RAW or name == "title":
                if name == "title":
                    flush()
                skip, depth = (name, 1) if not token.endswith("/>") else (None, 0)
                continue
            flush()
            if name in VOID:
                continue
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        cut(i)
                        break
                    if stack[i][0] in ("td", "th", "li", "table", "button", "div", "article"):
                        break
            if name in SIBLINGS:
                same, within = SIBLINGS[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in within:
                        break
                    if stack[i][0] in same:
                        cut(i)
                        break
            if name == "html" and self.lang is None:
                self.lang = attributes(token).get("lang")
            if token.endswith("/>") or name in ("html", "body", "head"):
                continue
            in_link = 0
            node: list = [key_of(name, token) if tree else name, []]
            if tree:
                stack[-1][1][1].append(node)
            stack.append((name, node))
            opened[name] += 1
        flush()
        if skip == "title" and text:
            self.title = " ".join(html.unescape("".join(text)).split())
