"""HTML extraction by tag-path ratios.

A page is read once into text nodes with their root-to-leaf tag path (tags with their class and id words). Per path
the text length, punctuation, link text and nodes are added up; length per node and punctuation per node are
smoothed over neighbouring paths in page order, fused with the share of text outside links, and compared with a
share of the page's length-weighted mean. Paths at or above it are content. The content root is the container with
the most fused text, where a marked article (``article``, ``main``) counts as one container; if it is one, the
other articles are roots too. The root's text is the result but for paths that are mostly links and no content.
Text in boilerplate (by tag, class, id or role) is filtered out before; inside a marked article a text block (a paragraph, quotation, caption, cell,
list item or heading) is no boilerplate for class words that an author may use too (:data:`AUTHOR_WORDS`).

Edge cases: null and empty pages and pages without content give an empty text; markup may be unclosed, nested
wrongly or cut off; a page is processed whole, in time proportional to its length and whatever its depth; of roots of
equal text the first is taken; repeated rows get equal results; an empty table gives an empty result; other columns
are passed on, but ``text`` and ``n_chars``, which the result has of its own, are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
OWN_KIND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
BOILER_TAGS = frozenset("nav footer aside form button menu dialog fieldset input".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations "
    "comment comments reply replies respond disqus widget search pagination pager toolbar copyright legal disclaimer skip".split()
)
#: Of these, words that also name parts of an article; and the elements that hold one block of text.
AUTHOR_WORDS = frozenset("aside footer header masthead banner notice notices alert legal disclaimer copyright skip search share related recommended navigation menu widget promotion overlay".split())
TEXT_BLOCKS = frozenset("p blockquote figcaption caption td th li dt dd pre h1 h2 h3 h4 h5 h6".split()) | INLINE
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<!--.*?(?:-->|\Z)|<[!?/][^>]+>""", re.S)
#: Tags of a page whose quotes don't pair.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<!--.*?(?:-->|\Z)|<[!?/][^>]+>", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，]")


@dataclass(frozen=True)
class HtmlParams:
    #: A path is content from this share of the page's length-weighted mean of fused ratios.
    threshold: float = 0.1
    #: Neighbouring paths on either side that a ratio is smoothed with, and the weight of its own value among theirs.
    smooth: int = 1
    own: int = 4
    #: Paths count for the choice of the root from this share of that mean on, so that the bulk of many short pieces doesn't.
    root_threshold: float = 0.9


class _Page:
    """Text nodes of one page: ``(block, path, root, boiler, in_link, text)``.

    Paths are numbers, each with its ``parent``, its ``block`` (the path up to its last block element) and whether
    a ``heading`` is on it; 0 is the empty path. What a node needs to know of the elements around it is handed down as
    they open, so that depth costs nothing."""

    def __init__(self, html: str):
        self.nodes: list[tuple] = []
        self.parent, self.block, self.heading = [0], [0], [False]
        self._numbers: dict[tuple[int, str], int] = {}
        self._stack: list[tuple] = []  # (tag, path, boiler, root, in_link, place of the last block element)
        self._open_at: dict[str, list[int]] = defaultdict(list)
        self._at_block = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, text_from, last, pattern, never = 0, 0, html.rfind(">"), TAG, set()
        while (place := html.find("<", at)) >= 0:
            found = pattern.match(html, place) if place < last or html.startswith("<!--", place) else None
            if not found and pattern is TAG and place < last and (found := LOOSE.match(html, place)):
                pattern = LOOSE
            if not found:
                at = place + 1
                continue
            self._text(html[text_from:place])
            at = text_from = found.end()
            if not (name := found[2]):
                continue
            name = name.lower()
            if found[1]:
                self._close(name)
            elif name in RAW:
                end = None if name in never else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                if end:
                    at = text_from = end.end()
                elif name in ("script", "style"):
                    return
                else:
                    never.add(name)
            else:
                self._open(name, found[3] or "")
        self._text(html[text_from:])

    def _path(self, parent: int, tag: str, step: str) -> int:
        number = self._numbers.get((parent, step))
        if number is None:
            number = self._numbers[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.block.append(self.block[parent] if tag in INLINE else number)
            self.heading.append(self.heading[parent] or tag in HEADINGS)
        return number

    def _text(self, raw: str) -> None:
        if raw:
            _, path, boiler, root, in_link, _ = self._stack[-1] if self._stack else ("", 0, False, None, False, -1)
            self.nodes.append((self._at_block, path, root, boiler, in_link, unescape(raw)))

    def _open(self, name: str, attributes: str) -> None:
        if name == "br" or name not in INLINE:
            self._at_block += 1
        if name in VOID:
            return
        if name in ENDS_P:
            self._up_to("p", ("article", "section", "div", "td", "th", "li", "body", "main", "button"))
        if name in OWN_KIND:
            self._up_to(name, OWN_KIND[name])
            if name in ("dt", "dd"):
                self._up_to("dd" if name == "dt" else "dt", ("dl",))
        words, roles, hidden = set(), set(), False
        for a in ATTRIBUTE.finditer(attributes) if attributes else ():
            key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
            if key in ("class", "id"):
                words.update(x for x in re.split(r"[^a-z]+", value) if x)
            elif key == "role":
                roles.update(value.split())
            else:
                hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        _, above, in_boiler, in_root, in_link, block = self._stack[-1] if self._stack else ("", 0, False, None, False, -1)
        root = name in ("article", "main") or "main" in roles or "article" in roles
        inside = in_root is not None
        boiler = hidden or name in BOILER_TAGS or bool(roles & BOILER_ROLES) or name == "header" and not inside
        if name not in ("html", "body", "main"):
            telling = words & BOILER_WORDS - (AUTHOR_WORDS if inside and name in TEXT_BLOCKS else frozenset())
            boiler |= bool(telling) and not (name == "article" and not words & {"comment", "ad", "advert", "promo", "sponsored", "related", "reply"}) and not (name == "header" and inside and words <= {"header", "article", "entry", "post", "title"})
        path = self._path(above, name, name + "".join(f".{w}" for w in sorted(words)))
        own_root = path if root and not boiler and in_root is None else in_root
        self._open_at[name].append(len(self._stack))
        self._stack.append((name, path, in_boiler or boiler, own_root, in_link or name == "a", block if name in INLINE else len(self._stack)))

    def _last(self, name: str) -> int:
        """The place of the innermost open element of a name, or -1."""
        return self._open_at[name][-1] if self._open_at.get(name) else -1

    def _pop(self, place: int) -> None:
        while len(self._stack) > place:
            self._open_at[self._stack.pop()[0]].pop()

    def _up_to(self, name: str, bounds: tuple) -> None:
        place = self._last(name)
        if place >= 0 and all(self._last(b) < place for b in bounds if b != name):
            self._pop(place)

    def _close(self, name: str) -> None:
        place = self._last(name)
        if name not in INLINE:
            self._at_block += 1
            if place >= 0:
                self._pop(place)
        elif place > self._stack[-1][5] if self._stack else False:
            self._pop(place)


def path_scores(nodes: list[tuple], params: HtmlParams) -> dict[int, float]:
    """The fused ratio of every tag path."""
    chars, marks, links, counts = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for _, path, _, _, in_link, text in nodes:
        n = len("".join(text.split()))
        if n:
            chars[path] += n
            marks[path] += len(PUNCTUATION.findall(text))
            links[path] += n * in_link
            counts[path] += 1
    order = list(chars)

    def smoothed(value: dict) -> list[float]:
        raw = [value[p] / counts[p] for p in order]
        near = [raw[max(0, i - params.smooth) : i + params.smooth + 1] + [raw[i]] * (params.own - 1) for i in range(len(raw))]
        return [sum(x) / len(x) for x in near]

    return {p: a * (1 + b) * (1 - links[p] / chars[p]) for p, a, b in zip(order, smoothed(chars), smoothed(marks))}


def main_text(html: str, params: HtmlParams = HtmlParams()) -> str:
    """The main text of a page: blocks in page order, joined by one space."""
    page = _Page(html)
    open_nodes = [x for x in page.nodes if not x[3]]
    scores = path_scores(open_nodes, params)
    if not scores:
        return ""
    weight = defaultdict(int)
    for x in open_nodes:
        weight[x[1]] += len(x[5].strip())
    mean = sum(scores[p] * weight[p] for p in scores) / max(1, sum(weight[p] for p in scores))
    content = {p for p, s in scores.items() if s >= params.threshold * mean}
    if not content:
        return ""
    totals: dict[int, float] = defaultdict(float)
    marked = set()
    for x in open_nodes:
        if x[1] in content and scores[x[1]] >= params.root_threshold * mean:
            # What stands in a marked article counts for the whole of it.
            holder = x[2] if x[2] is not None else page.parent[page.block[x[1]]]
            marked |= {holder} if x[2] is not None else set()
            totals[holder] += scores[x[1]] * len(x[5].strip())
    best = max(totals, key=totals.get, default=0)
    own = {page.block[p] for p in content}
    under = [best == 0]  # whether a path leads through the root
    for p in range(1, len(page.parent)):
        under.append(p == best or under[page.parent[p]])
    inside = [x for x in open_nodes if (x[2] is not None if best in marked else under[x[1]])]
    # Short blocks of the root are the article's too; only lists of links aren't.
    linked, chars = defaultdict(int), defaultdict(int)
    for x in inside:
        n = len("".join(x[5].split()))
        linked[page.block[x[1]]] += n * x[4]
        chars[page.block[x[1]]] += n
    chosen = [x for x in inside if page.block[x[1]] in own or 2 * linked[page.block[x[1]]] <= chars[page.block[x[1]]]]
    blocks: dict[int, list[str]] = defaultdict(list)
    for x in chosen:
        blocks[x[0]].append(x[5])
    return " ".join(b for b in (" ".join("".join(parts).split()) for parts in blocks.values()) if b)


def _extract(params: HtmlParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", params) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return run


def extract_text(pages: DataFrame, params: HtmlParams = HtmlParams(), html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of the html."""
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest), "text string"])
    out = pages.select(*rest, html_col).mapInArrow(_extract(params), schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
