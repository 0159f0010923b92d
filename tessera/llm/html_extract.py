"""Main text of HTML pages by tree scoring.

A page is parsed leniently (implied and missing end tags, truncated pages).  Menus,
headers, footers, sidebars, notices, adverts, forms, comments and hidden parts are cut by
tag, role and class.  Every remaining paragraph passes points (length and commas) to its
ancestors, less with each level; a container's sum is discounted by its link density.  The
best container is kept with those of its siblings that score near it or read like text.
Inside an article (or else a main) element that element is the container: all its blocks
stay but lists, tables and sections that are mostly links.

Edge cases: a null or empty page gives ''; a page without text gives ''; rows are
independent, so repeated and null ids do not matter; pages of any length are parsed whole,
without recursion; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var img wbr input".split())
CUT = set("head title script style noscript template nav footer aside form iframe button select textarea svg canvas "
          "object menu dialog audio video map".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li td th pre blockquote dd dt figcaption caption address".split())
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"})}
BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|"
                 r"gdpr|menu|modal|nav|navbar|navigation|newsletter|notice|notification|overlay|pager|pagination|popup|"
                 r"promo\w*|related|replies|reply|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|widget|"
                 r"masthead)(?:[\s_-]|$)", re.I)
HEADER = re.compile(r"(?:^|[\s_-])header(?:[\s_-]|$)", re.I)
GOOD = re.compile(r"article|body|content|entry|hentry|main|page|post|story|text", re.I)


class Tree(HTMLParser):
    """Node arrays in page order and a list of events (node, text); text None: a break."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.dropped, self.link, self.weight = ["#page"], [-1], [False], [False], [0]
        self.stack, self.open = [0], Counter()
        self.events: list[tuple[int, str | None]] = []

    def _drop(self, tag: str, a: dict) -> bool:
        if tag in CUT or (a.get("role") or "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" \
                or "display:none" in (a.get("style") or "").replace(" ", "").lower():
            return True
        name = f"{a.get('class') or ''} {a.get('id') or ''}"
        inside = bool(self.open["article"] or self.open["main"])
        if tag in ("html", "body", "article", "main"):
            return tag == "article" and bool(re.search(r"comment|reply", name, re.I))
        return bool(BAD.search(name)) or (not inside and (tag == "header" or bool(HEADER.search(name))))

    def _pop_through(self, depth: int) -> None:
        for n in self.stack[depth:]:
            self.open[self.tag[n]] -= 1
        del self.stack[depth:]

    def _close(self, tags: set, stop: set | None = None) -> None:
        """Pop through the innermost open element of ``tags`` unless ``stop`` (or, without
        it, any container) lies above it."""
        if not any(self.open[t] for t in tags):
            return
        for d in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[d]]
            if t in tags:
                return self._pop_through(d)
            if t in stop if stop is not None else t not in INLINE:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._close({"p"})
            if tag in CLOSES:
                self._close(*CLOSES[tag])
            self.events.append((self.stack[-1], None))
        if tag in VOID:
            return
        up, a = self.stack[-1], dict(attrs)
        self.tag.append(tag)
        self.parent.append(up)
        self.dropped.append(self.dropped[up] or self._drop(tag, a))
        self.link.append(self.link[up] or tag == "a")
        good = GOOD.search(f"{a.get('class') or ''} {a.get('id') or ''}")
        self.weight.append(25 * (tag in ("article", "main")) + 25 * bool(good) if tag not in INLINE else 0)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # in HTML the slash has no meaning

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.events.append((self.stack[-1], None))
        if tag == "br" or not self.open[tag]:
            return
        if tag in INLINE or tag == "p":
            self._close({tag})
        else:
            self._close({tag}, set())

    def handle_data(self, data: str) -> None:
        n = self.stack[-1]
        if not self.dropped[n]:
            self.events.append((n, data))


def _blocks(t: Tree, kept: list | None = None) -> list[tuple[int, str, int]]:
    """(block node, text, link characters) of every run of text between breaks."""
    out, buf, owner, linked = [], [], 0, 0
    for n, s in [*t.events, (0, None)]:
        if s is not None:
            if kept is None or kept[n]:
                if not buf:
                    owner = n
                buf.append(s)
                linked += len(s.strip()) if t.link[n] else 0
        elif buf:
            text = " ".join("".join(buf).split())
            if text:
                while t.tag[owner] in INLINE:
                    owner = t.parent[owner]
                out.append((owner, text, linked))
            buf, linked = [], 0
    return out


def extract(html: str | None) -> str:
    if not html:
        return ""
    t = Tree()
    t.feed(html)
    t.close()
    n = len(t.tag)
    score, chars, linked = [0.0] * n, [0] * n, [0] * n
    own: dict[int, list[str]] = {}
    for b, text, link in _blocks(t):
        own.setdefault(b, []).append(text)
        chars[b] += len(text)
        linked[b] += link
        points = 1 + text.count(",") + text.count("，") + len(text) / 100
        node, level = (t.parent[b] if t.tag[b] in TEXTUAL and t.parent[b] >= 0 else b), 0
        while node > 0 and level < 5:
            score[node] += points / (1, 2, 6, 9, 12)[level]
            node, level = t.parent[node], level + 1
    if not own:
        return ""
    for i in range(n - 1, 0, -1):
        chars[t.parent[i]] += chars[i]
        linked[t.parent[i]] += linked[i]
    density = [min(1.0, linked[i] / chars[i]) if chars[i] else 0.0 for i in range(n)]
    final = [(score[i] + t.weight[i]) * (1 - density[i]) if score[i] else 0.0 for i in range(n)]
    best = max(range(n), key=lambda i: (final[i], -i))
    if not final[best]:
        best = 0
    path = [best]
    while t.parent[path[-1]] >= 0:
        path.append(t.parent[path[-1]])
    root = next((i for tag in ("article", "main") for i in path if t.tag[i] == tag), best)
    kept, near = [False] * n, max(10.0, 0.2 * final[best])
    chosen, above = [False] * n, set(path)
    for i in range(n):
        up = t.parent[i]
        chosen[i] = i == best or (up >= 0 and chosen[up])
        if i == root or (up >= 0 and kept[up]):
            kept[i] = (chosen[i] or i in above or t.tag[i] in INLINE or t.tag[i] in TEXTUAL
                       or density[i] <= 0.5)
        elif root and up == t.parent[root]:
            said = " ".join(own.get(i, ()))
            kept[i] = (final[i] >= near or t.tag[i] in ("h1", "h2", "h3") and density[i] < 0.25
                       or t.tag[i] == "p" and (len(said) > 80 and density[i] < 0.25
                                               or density[i] == 0 and bool(re.search(r"\.( |$)", said))))
        kept[i] = kept[i] and not t.dropped[i]
    return "\n".join(text for _, text, _ in _blocks(t, kept))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                text = pa.array([extract(h) for h in part.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), text],
                                                 names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
