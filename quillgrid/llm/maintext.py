"""Main text of web pages by minimum-cut labelling.

A page is read into blocks. A classifier scores each block from its own words and its place in the
document tree; the costs of calling it content or boilerplate become capacities to the two terminals.
Neighbouring blocks, and blocks that share a container, are joined by smoothness edges. The minimum
cut separates content from boilerplate. Blocks whose own cost outweighs all their edges have the same
label in every minimum cut and are fixed first; max-flow runs on the rest.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed lists of HTML elements.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select", "option", "button", "canvas", "audio", "video", "head"}
OPAQUE = {"script", "style", "textarea", "title", "iframe"}  # their content isn't markup
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end where another of the same group begins within one container.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "header", "search", "fieldset"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form", "toolbar"}
CONTENT_TAGS = {"article", "main"}
BOILER_NAMES = re.compile(
    r"^(?:ad|ads|adv|advert\w*|advertisement|banner|sponsor\w*|promo\w*|side|sidebar|sidenav|rail|nav|navbar|navigation|menu|menubar|breadcrumbs?|crumbs|header|masthead|topbar|footer|foot|bottom|copyright|"
    r"legal|disclaimer|comments?|commentlist|respond|reply|replies|disqus|share|sharing|social|follow|cookies?|consent|gdpr|notice|notices|alert|message|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|register|search|form|related|recommend\w*|recommended|more|popular|trending|widget|widgets|tags|pagination|pager|toolbar|skip|hidden|print)$"
)
NOT_NAMES = {"has", "with", "no", "without", "is", "not"}
#: A name with one of these says how a page is laid out, as in content-sidebar-wrap or layout-sidebar-right.
LAYOUT_NAMES = {"wrap", "wrapper", "wrapped", "layout", "left", "right"}
CONTENT_NAMES = re.compile(r"^(?:article|articlebody|content|contents|entry|post|story|main|maintext|bodytext|text|prose|body)$")
#: Names of what can itself be marked up as an article within a page: reader comments, adverts, notices.
GUEST_NAMES = re.compile(r"^(?:ad|ads|adv|advert\w*|advertisement|banner|sponsor\w*|promo\w*|comments?|commentlist|respond|reply|replies|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|related|hidden)$")
TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What stands between a tag's name and its end. Only after = does a quote open a string.
IN_TAG = re.compile(r"(?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
WHITE = re.compile(r"\s+")
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’)\]]*(?:\s|$)")

ADJACENT, SIBLING = 0.6, 0.9  # weights of the smoothness edges
SCALE = 0.4  # of a block's own score; what its element says (7 or 4) still outweighs its edges, its text alone doesn't
NAME_COST, FADE = 5.0, 0.15  # what a name of boilerplate costs, and the part of it that each element further inside leaves
BY_NAME = -2  # the mark of an element whose name only says boilerplate


@dataclass
class Container:
    tag: str
    parent: Container | None
    mark: int = 0  # 2: content by its element or role, 1: by its name, -1: boilerplate, BY_NAME: the same by its name only, 0: says nothing
    inside_content: bool = False
    boiler: bool = False  # it or something around it is boilerplate by its element, its role or as it is hidden
    name_cost: float = 0.0  # what names of boilerplate on it or around it cost


@dataclass
class Block:
    tag: str
    where: Container
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def names_of(attributes: dict[str, str]) -> list[str]:
    return (attributes.get("class", "") + " " + attributes.get("id", "") + " " + attributes.get("itemprop", "")).split()


def mark_of(tag: str, raw: str) -> int:
    """What an element says about its content; boilerplate outweighs. 2: an element or role for content says so.

    An element for content is boilerplate by its name only where guests (comments, adverts, notices) are named;
    a name that has a word for content as well as one for other boilerplate, as post-popular, says nothing.
    """
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return -1
    if tag in BOILER_TAGS or found.get("role", "").lower() in BOILER_ROLES:
        return -1
    if tag in ("html", "body"):
        return 0
    content, named = tag in CONTENT_TAGS or found.get("role", "").lower() in ("main", "article"), False
    for name in names_of(found):
        parts = [p.lower() for p in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", name) if p]
        if parts and parts[0] in NOT_NAMES:
            continue
        if LAYOUT_NAMES.intersection(parts):
            continue
        says_content = any(CONTENT_NAMES.match(p) for p in parts)
        if any(GUEST_NAMES.match(p) for p in parts):
            return BY_NAME
        if any(BOILER_NAMES.match(p) for p in parts):
            if not content and not says_content:
                return BY_NAME
            continue
        named = named or says_content
    return 2 if content else int(named)


@dataclass
class Reader:
    """The tags of a page one after the other, each character looked at a bounded number of times.

    A page may have a tag whose quotes don't end. From there on quotes are characters like any others.
    """

    page: str
    plain: bool = False

    def __post_init__(self) -> None:
        self.last_end = self.page.rfind(">")

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """start, end, whether it closes, name and attributes of the next tag; the name of a comment or declaration is empty."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                if page.startswith((">", "->"), start + 4):
                    return start, page.index(">", start) + 1, False, "", ""
                m = COMMENT_END.search(page, start + 4)
                return start, m.end() if m else len(page), False, "", ""
            if start > self.last_end:
                at = page.find("<!--", start)  # nothing but a comment can end the page
                if at < 0:
                    return None
                continue
            if page.startswith(("<!", "<?"), start):
                return start, page.index(">", start) + 1, False, "", ""
            m = TAG_NAME.match(page, start + 1)
            if not m:
                at = start + 1
                continue
            end = -1
            if not self.plain:
                end = IN_TAG.match(page, m.end()).end()
                if end >= len(page):
                    self.plain, end = True, -1
            if end < 0:
                end = page.index(">", m.end())
            return start, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]
        return None


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    root = Container("#", None)
    stack = [root]
    is_open: Counter[str] = Counter()
    inline_links = 0
    blocks: list[Block] = []
    now = Block("#", root)

    def flush(tag: str) -> None:
        nonlocal now
        if now.parts:
            text = WHITE.sub(" ", html_lib.unescape("".join(now.parts))).strip()
            if text:
                now.text = text
                blocks.append(now)
        now = Block(tag, stack[-1])

    def add(piece: str) -> None:
        if piece:
            now.parts.append(piece)
            if inline_links:
                now.link_chars += len(piece.strip())

    at, n = 0, len(page)
    reader = Reader(page)
    skip_tag, skip_depth = "", 0
    while at < n:
        if skip_tag in OPAQUE:
            end = re.compile(rf"</{re.escape(skip_tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            skip_tag = ""
            continue
        met = reader.next(at)
        start = met[0] if met else n
        if not skip_tag:
            add(page[at:start])
        if not met:
            break
        _, at, closing, tag, attributes = met
        if not tag:
            continue
        if skip_tag:  # inside an element whose content doesn't show
            if tag == skip_tag:
                skip_depth += -1 if closing else 1
                if skip_depth == 0:
                    skip_tag = ""
            elif skip_tag == "head" and tag in ("body", "article", "main", "nav", "div", "p", "header"):
                skip_tag = ""
                at = start
            elif tag in OPAQUE and not closing:
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
            continue
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                skip_tag, skip_depth = tag, 1
            continue
        if tag == "br":
            add(" ")
            continue
        if tag == "a":
            inline_links = 0 if closing else 1
            continue
        if tag not in BLOCK:
            if tag in ("img", "wbr"):
                add(" " if tag == "img" else "")
            continue
        inline_links = 0
        if closing:
            flush(tag)
            for k in range(len(stack) - 1, 0, -1) if is_open[tag] else ():
                if stack[k].tag == tag:
                    is_open.subtract(x.tag for x in stack[k:])
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "article", "main", "body") and tag in ("p", "li", "div", "span"):
                    break
            now = Block(stack[-1].tag, stack[-1])
            continue
        ends = SELF_CLOSING.get(tag, {"p"} if tag != "p" else set())
        while len(stack) > 1 and (stack[-1].tag in ends or stack[-1].tag == "p"):
            is_open[stack.pop().tag] -= 1
        if tag not in VOID:
            up = stack[-1]
            own = mark_of(tag, attributes)
            if tag == "header" and up.inside_content and own == -1:
                own = 0  # an article's own header holds its title
            # A nested main or article starts anew; other names only fade the further inside a block is.
            by_name = NAME_COST if own == BY_NAME else 0.0 if own == 2 else up.name_cost * FADE
            inside = own != BY_NAME and (own == 2 or up.inside_content or (own == 1 and not up.name_cost))
            made = Container(tag, up, own, inside, up.boiler or own == -1, by_name)
            stack.append(made)
            is_open[tag] += 1
        flush(tag)
    flush("#")
    return blocks


def score(block: Block, page_has_content: bool) -> float:
    """Log-odds that a block is content, from weights set by hand, on a scale on which edges can outweigh a block's own text."""
    text, where = block.text, block.where
    s = -0.4 - where.name_cost
    if where.boiler:
        s -= 7.0
    elif where.inside_content:
        s += 4.0
    elif page_has_content:
        s -= 2.0
    links = block.link_chars / max(1, len(text))
    s -= 3.0 * max(0.0, links - 0.3)
    s += min(1.6, len(text) / 120)
    s += 0.6 if SENTENCE_END.search(text) else 0.0
    if block.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        s += 0.8
    if text.startswith(("©", "Copyright ", "copyright ", "(c) ")):
        s -= 2.5
    if where.tag == "header" and block.tag not in ("h1", "h2", "h3"):
        s -= 3.5
    return SCALE * s


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Adjacent blocks, weaker the further apart in the tree, and each block with the one before it in its container."""
    found = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        up = b.where.parent if b.tag == b.where.tag and b.where.parent is not None else b.where
        if i:
            before = blocks[i - 1]
            same = before.where is b.where or before.where.parent is b.where.parent
            found.append((i - 1, i, ADJACENT if same else ADJACENT / 3))
        if id(up) in last:
            found.append((last[id(up)], i, SIBLING))
        last[id(up)] = i
    return found


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels (True: content) that minimise the costs of labels plus the weights of edges between unlike ones.

    scores are log-odds; calling a block content costs log(1 + exp(-s)), boilerplate log(1 + exp(s)),
    whose difference is s.
    """
    n = len(scores)
    pull = list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(pull[i]) > sum(near[i].values()):
            label[i] = pull[i] > 0
            for j, w in near[i].items():
                pull[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    free = [i for i in range(n) if label[i] is None]
    if free:
        side = max_flow(free, pull, near)
        for i in free:
            label[i] = i in side
    return [bool(x) for x in label]


def max_flow(free: list[int], pull: list[float], near: list[dict[int, float]]) -> set[int]:
    """The nodes on the source's side of a minimum cut: Dinic's algorithm, levels by breadth, paths by depth."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in free}
    room[source], room[sink] = {}, {}
    for i in free:
        if pull[i] > 0:
            room[source][i], room[i][source] = pull[i], 0.0
        else:
            room[i][sink], room[sink][i] = -pull[i], 0.0
    tiny = 1e-12
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return {i for i in free if i in level}
        ways = {u: iter(list(room[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                least = min(room[a][b] for a, b in zip(path, path[1:]))
                cut_at = 0
                for k, (a, b) in enumerate(zip(path, path[1:])):
                    room[a][b] -= least
                    room[b][a] = room[b].get(a, 0.0) + least
                    if room[a][b] <= tiny and not cut_at:
                        cut_at = k + 1
                path = path[:cut_at]
                continue
            for v in ways[u]:
                if room[u].get(v, 0.0) > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                level.pop(u, None)


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by blank lines; empty if there are none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    marked = any(b.where.inside_content and not b.where.boiler for b in blocks)
    labels = min_cut([score(b, marked) for b in blocks], edges_of(blocks))
    return "\n\n".join(b.text for b, content in zip(blocks, labels) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page, and one without content, gives an empty text. Broken markup is read as far
    as it goes; nothing is cut off. Repeated rows are read row by row, other columns are not read, an
    empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)


def cost(scores: list[float], edges: list[tuple[int, int, float]], labels: list[bool]) -> float:
    """What min_cut minimises; for tests and tuning."""
    own = sum(math.log1p(math.exp(-s)) if x else math.log1p(math.exp(s)) for s, x in zip(scores, labels))
    return own + sum(w for a, b, w in edges if labels[a] != labels[b])
