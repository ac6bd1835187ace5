"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

Inference. A page's token stream becomes a tree of elements and texts (implied end tags,
raw-text elements). Aligning a page with the wrapper of its host resolves each mismatch:
differing texts become a text slot, siblings of one shape a repeated group, siblings
that alternate (up to three kinds) a repeated group of several, and what only one
side has an optional group. Wrappers align with wrappers in the same way, so each task
folds its pages into one wrapper a host, and these are merged in two rounds: all pages
count, no host is gathered in one task, and only wrappers are shuffled. In a wide sequence
optional parts of one kind between two parts that every page has become one repeated group, so
a wrapper grows with the kinds of parts, not with the number of pages, and forgets no part.

Extraction. A wrapper tells a host's template from its content: a text that never varies over
three or more pages while others vary is template, wherever it stands, and a slot knows how much text
it took on all pages. Each page is aligned with its host's wrapper, and its article is the
element that matches the deepest part that holds most of the text of all slots (links count as
no text). Blocks whose texts the alignment shows as fixed go. Where the wrapper can't tell (a host
of one or two pages, a page that doesn't match), the article is the largest article or main
element, else the body. Within it, menus, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are told by element, role, class and id, unless such a part holds most of the text itself.
Block elements and line breaks separate blocks, character references are decoded, and white space
within a block is one space.

Defined results: null html counts as empty and gives an empty text; a null or host-less
URL is the host ''; rows that repeat give repeated results; an empty table gives an empty one;
other columns are ignored. Nothing is cut from long pages. Alignment isn't associative, so a wrapper may
differ in detail with the partitioning of the pages.
"""

from __future__ import annotations

import html as entities
import difflib
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.shared import pieces, table, text_or_empty
from alphaloom.llm.url_filters import host_of

# Element names by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg math object".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split())
NEVER = set("head nav footer aside form script style noscript template iframe select option button textarea input svg math canvas object dialog menu search title".split())
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
#: Words in class and id that name a part which isn't the article's text.
PARTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumb\w*"
    r"|sidebar|side-bar|aside|footer|header|masthead|comment|comments|disqus|respond|reply|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|widget)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(hidden)(?=[\s/>]|$)", re.I)


def spaced(text: str) -> str:
    """White space as single spaces, none at the ends."""
    return " ".join(text.split())


#: Sequences longer than this have the optional parts of one kind folded into one group.
WIDE = 60
#: Cells of an alignment's table, beyond which matching blocks stand in for the longest common subsequence.
CELLS = 250_000
#: Pages that must agree before a text is template, and the share of the text of all slots that the article's part holds at least.
AGREE, MOST = 3, 0.6


#: Elements nested deeper than this become siblings, as in browsers; their text stays.
DEEPEST = 200


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "depth")

    def __init__(self, tag: str, attrs: str, parent):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent
        self.depth = parent.depth + 1 if parent else 0


def parse(page: str) -> Node:
    """A tree of Nodes and strings (raw text) from any string."""
    root = here = Node("#root", "", None)
    at, raw = 0, None
    find = TOKEN.search
    while True:
        if raw:  # up to the end tag of a raw-text element
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            here.kids.append(page[at : m.start() if m else len(page)])
            here = here.parent
            at, raw = (m.end() if m else len(page)), None
            continue
        m = find(page, at)
        if not m:
            if at < len(page):
                here.kids.append(page[at:])
            return root
        if m.start() > at:
            here.kids.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, attrs = name.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            up = here
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if tag in CLOSES_P:
            here = _close(here, {"p"}, {"table", "td", "th", "div", "section", "article", "button", "li"})
        if tag == "li":
            here = _close(here, {"li"}, {"ul", "ol", "menu"})
        elif tag in ("dd", "dt"):
            here = _close(here, {"dd", "dt"}, {"dl"})
        elif tag == "option":
            here = _close(here, {"option"}, {"select"})
        elif tag in ("td", "th"):
            here = _close(here, {"td", "th"}, {"table", "tr"})
        elif tag == "tr":
            here = _close(here, {"tr"}, {"table"})
        node = Node(tag, attrs, here)
        here.kids.append(node)
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in RAW:
            here, raw = node, tag
        elif node.depth < DEEPEST:
            here = node


def _close(here: Node, tags: set[str], stop: set[str]) -> Node:
    up = here
    while up is not None and up.tag not in stop:
        if up.tag in tags:
            return up.parent
        up = up.parent
    return here


def attributes(node: Node) -> dict[str, str]:
    if not node.attrs:
        return {}
    return {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'") for m in ATTR.finditer(node.attrs)}


HEADINGS = set("h1 h2 h3 h4 h5 h6 header hgroup".split())


def excluded(node: Node, in_article: bool) -> bool:
    """Whether an element is no part of the article's text."""
    if node.tag in NEVER or node.tag == "header" and not in_article:
        return True
    if not node.attrs:
        return False
    a = attributes(node)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if node.tag in HEADINGS and in_article:  # an entry's own header is part of it, whatever it is called
        return False
    named = f"{a.get('class', '')} {a.get('id', '')}"
    return node.tag not in ("html", "body", "main", "article") and bool(PARTS.search(named)) or node.tag == "article" and bool(re.search(r"(?:^|[\s_-])(?:comment|comments|reply|related|teaser|promo)(?:$|[\s_-])", named, re.I))


OWN = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
#: Elements that repeat whatever they hold.
LEAVES = set("# a b i u em strong span small br img tr option source".split())

# --- wrappers: [key, optional, repeated, pages, fixed text or None, parts, characters, hashes]; key '#' is a text, '*' a group of
# several; the hashes are those of the texts that a paragraph, item or heading (a repeated one: some member of it) has on every page.

KEY, OPT, REP, SEEN, TEXT, KIDS, MASS, ALWAYS = range(8)


def _key(node) -> str:
    if isinstance(node, str):
        return "#"
    named = attributes(node).get("class", "").split() if node.attrs and node.tag not in ("a", "img", "link", "meta", "script") else []
    return node.tag + ("." + re.sub(r"\d+", "0", named[0]) if named else "")


def _parts(node: Node) -> list:
    """The children that take part in an alignment."""
    return [] if node.tag in RAW else [k for k in node.kids if not isinstance(k, str) or k.strip()]


def _shape(node, linked: bool = False) -> list:
    if isinstance(node, str):
        text = spaced(node)
        return ["#", 0, 0, 1, text, [], 0 if linked else len(text), []]
    kids = [_shape(k, linked or node.tag == "a") for k in _parts(node)]
    return [_key(node), 0, 0, 1, None, _grouped(kids), 0, [_hash(node)] if node.tag in OWN else []]


def _text(node: Node) -> str:
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in RAW:
            todo += reversed(x.kids)
    return spaced("".join(parts))


def _hash(node: Node) -> str:
    return hashlib.blake2b(_text(node).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _alike(x: list) -> tuple:
    """What must be equal for neighbours to repeat: the key, of containers also those of their parts, as two plain boxes side by side may be different things."""
    return (x[KEY],) if x[KEY].split(".")[0] in OWN or "." in x[KEY] or x[KEY] in LEAVES else (x[KEY], *dict.fromkeys(k[KEY] for k in x[KIDS]))


def _grouped(seq: list) -> list:
    """Neighbours of one shape, then two or three that alternate, as repeated groups."""
    for width in (1, 2, 3):
        if len(seq) < 2 * width:
            return seq
        shapes = [_alike(x) for x in seq]
        if len(set(shapes)) == len(shapes):
            return seq
        out: list = []
        i = 0
        while i < len(seq):
            keys = [x[KEY] for x in seq[i : i + width]]
            same = shapes[i : i + width]
            n = 1
            while len(keys) == width and shapes[i + n * width : i + (n + 1) * width] == same and "#" not in keys[:1]:
                n += 1
            if n == 1:
                out.append(seq[i])
                i += 1
                continue
            if width == 1:
                one = seq[i]
                for x in seq[i + 1 : i + n]:
                    one = merge(one, x, again=True)
                one[REP] = 1
                out.append(one)
            else:
                rows = [seq[i + k * width : i + (k + 1) * width] for k in range(n)]
                parts = rows[0]
                for row in rows[1:]:
                    parts = [merge(x, y, again=True) for x, y in zip(parts, row)]
                out.append(["*" + "+".join(keys), 0, 1, 1, None, parts, 0, []])
            i += n * width
        seq = out
    return seq


def merge(a: list, b: list, again: bool = False) -> list:
    """Align two wrappers of one key; again: both come from one page, which then counts once."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    return [a[KEY], a[OPT] | b[OPT], a[REP] | b[REP], max(a[SEEN], b[SEEN]) if again else a[SEEN] + b[SEEN], text, _aligned(a[KIDS], b[KIDS], again), a[MASS] + b[MASS],
            sorted(set(a[ALWAYS]) | set(b[ALWAYS]) if again else set(a[ALWAYS]) & set(b[ALWAYS]))]


def _common(ka: list[str], kb: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists of keys (of a long one, where both are long)."""
    lo, hi = 0, 0
    while lo < min(len(ka), len(kb)) and ka[lo] == kb[lo]:
        lo += 1
    while hi < min(len(ka), len(kb)) - lo and ka[-1 - hi] == kb[-1 - hi]:
        hi += 1
    x, y = ka[lo : len(ka) - hi], kb[lo : len(kb) - hi]
    found = [(k, k) for k in range(lo)]
    if len(x) * len(y) > CELLS:
        for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks():
            found += [(lo + m.a + k, lo + m.b + k) for k in range(m.size)]
    elif x and y:
        table_ = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                table_[i][j] = table_[i + 1][j + 1] + 1 if x[i] == y[j] else max(table_[i + 1][j], table_[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                found.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif table_[i + 1][j] >= table_[i][j + 1]:
                i += 1
            else:
                j += 1
    return found + [(len(ka) - k, len(kb) - k) for k in range(hi, 0, -1)]


def _aligned(a: list, b: list, again: bool) -> list:
    """Align two sequences; what only one has becomes optional."""
    if not a and not b:
        return []
    if len(a) == len(b) and all(x[KEY] == y[KEY] for x, y in zip(a, b)):
        out = [merge(x, y, again) for x, y in zip(a, b)]
        return _folded(out) if len(out) > WIDE else out
    optional = lambda x: [*x[:OPT], 1, *x[REP:]]
    out, i, j = [], 0, 0
    for m, n in [*_common([x[KEY] for x in a], [x[KEY] for x in b]), (len(a), len(b))]:
        out += [*map(optional, a[i:m]), *map(optional, b[j:n])]
        if m < len(a):
            out.append(merge(a[m], b[n], again))
        i, j = m + 1, n + 1
    return _folded(out) if len(out) > WIDE else out


def _folded(seq: list) -> list:
    """Optional parts of one key between two parts that aren't optional as one repeated group."""
    out: list = []
    place: dict[str, int] = {}
    for x in seq:
        if not x[OPT]:
            place.clear()
            out.append(x)
        elif x[KEY] in place:
            at = place[x[KEY]]
            out[at] = merge(out[at], x, again=True)
            out[at][REP] = 1
        else:
            place[x[KEY]] = len(out)
            out.append(x)
    return out


def wrapper_of(page: str) -> list:
    return _shape(parse(page))


def expression(w: list) -> str:
    """A wrapper as a union-free regular expression, for people."""
    if w[KEY] == "#":
        body = json.dumps(w[TEXT], ensure_ascii=False) if w[TEXT] is not None else "TEXT"
    else:
        body = (f"<{w[KEY]}>" if w[KEY][0] != "*" else "") + "".join(map(expression, w[KIDS]))
    return f"({body}){'+' if w[REP] else ''}{'?' if w[OPT] else ''}" if w[REP] or w[OPT] else body


class Template:
    """What a wrapper says of its host: which part is the article, and which texts are fixed."""

    def __init__(self, w: list):
        self.wrapper = w
        slots, todo = 0, [w]
        while todo:
            x = todo.pop()
            slots += x[KEY] == "#" and x[TEXT] is None
            todo += x[KIDS]
        self.tells = w[SEEN] >= AGREE and slots >= 2
        self.path = self._path() if self.tells else []

    def _path(self) -> list[list]:
        """The parts from the root down to the deepest one, repeated by no page, that holds most of the text of all slots."""
        mass: dict[int, int] = {}

        def weigh(x: list) -> int:
            own = x[MASS] if x[KEY] == "#" and not self.fixed(x) else 0
            mass[id(x)] = own + sum(map(weigh, x[KIDS]))
            return mass[id(x)]

        every, here, path = weigh(self.wrapper), self.wrapper, []
        while every:
            most = max((k for k in here[KIDS] if k[KEY][0] not in "#*"), key=lambda k: mass[id(k)], default=None)
            if most is None or most[REP] or most[KEY].split(".")[0] in OWN or mass[id(most)] < MOST * every:
                break
            path.append(most)
            here = most
        return path

    def fixed(self, part: list) -> bool:
        return part[TEXT] is not None and part[SEEN] >= AGREE and not part[OPT]

    def matches(self, node: Node, part: list) -> list[tuple[object, list]]:
        """A node's children with the parts of the wrapper they match; a repeated part matches several."""
        own = _parts(node)
        flat = [y for x in part[KIDS] for y in (x[KIDS] if x[KEY][0] == "*" else [x])]
        again = [bool(x[REP]) for x in part[KIDS] for _ in (x[KIDS] if x[KEY][0] == "*" else [x])]
        keys, out, j = [x[KEY] for x in flat], [], 0
        if not any(again) and keys == [_key(k) for k in own]:
            return list(zip(own, flat))
        for k in own:
            key = _key(k)
            at = next((n for n in range(j, len(keys)) if keys[n] == key), None)
            if at is None:  # back to the last repeated part of that key, if any: groups alternate
                at = next((n for n in range(min(j, len(keys)) - 1, -1, -1) if keys[n] == key and again[n]), None)
                if at is None:
                    continue
            out.append((k, flat[at]))
            j = at if again[at] else at + 1
        return out

    def article(self, root: Node) -> tuple[Node | None, list | None]:
        """The element of a page that is the article, with its part."""
        here, part = root, self.wrapper
        for wanted in self.path:
            here = next((k for k, x in self.matches(here, part) if x is wanted and not isinstance(k, str)), None)
            if here is None:
                return None, None
            part = wanted
        return (here, part) if self.path else (None, None)

    def fixed_texts(self, node: Node, part: list, out: set[int]) -> set[int]:
        """Of a matched element, the ids of its text's elements and positions that are template."""
        for k, x in self.matches(node, part):
            if isinstance(k, str):
                if self.fixed(x) and spaced(k) == x[TEXT]:
                    out.add(id(k))
            elif x[ALWAYS] and x[SEEN] >= AGREE and not x[OPT] and _hash(k) in x[ALWAYS]:
                out.update(_strings(k))
            else:
                self.fixed_texts(k, x, out)
        return out


def _strings(node: Node) -> list[int]:
    out, todo = [], [node]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, str):
                out.append(id(k))
            else:
                todo.append(k)
    return out


# --- extraction


def _weight(node: Node, in_article: bool) -> int:
    n = 0
    for k in node.kids:
        if isinstance(k, str):
            n += len(k.strip())
        elif not excluded(k, in_article) and k.tag != "a":
            n += _weight(k, in_article)
    return n


def _bulk(node: Node) -> int:
    """Characters of all text but that of links and raw elements."""
    n, todo = 0, [node]
    while todo:
        x = todo.pop()
        if x.tag in RAW or x.tag == "a":
            continue
        for k in x.kids:
            if isinstance(k, str):
                n += len(k.strip())
            else:
                todo.append(k)
    return n


def _find(node: Node, tags: set[str], out: list) -> list:
    for k in node.kids:
        if not isinstance(k, str):
            if k.tag in tags or k.attrs and attributes(k).get("role") in tags:
                if not excluded(k, False):
                    out.append(k)
            elif not (k.tag in NEVER) or k.tag == "form":
                _find(k, tags, out)
    return out


def main_text(page: str, template: Template | None = None) -> str:
    """Text of a page's article: blocks in page order, one a line."""
    root = parse(page)
    top, part = template.article(root) if template is not None and template.tells else (None, None)
    fixed: set[int] = template.fixed_texts(top, part, set()) if top is not None else set()
    found = top is not None
    if top is None:
        parts = _find(root, {"article"}, []) or _find(root, {"main"}, [])
        found = bool(parts)
        top = max(parts, key=lambda x: _weight(x, True)) if parts else root
    blocks: list[str] = []
    line: list[str] = []
    varies = [False]
    bulk: list[int] = []

    def skipped(k: Node) -> bool:
        if not excluded(k, found):
            return False
        if k.tag in RAW or k.tag not in ("form", "header", "section", "div", "table"):
            return True
        if not bulk:
            bulk.append(_bulk(top))
        # A part that holds most of the text is the article, whatever it is called.
        return 2 * _bulk(k) <= bulk[0]

    def end() -> None:
        if line:
            text = spaced(entities.unescape("".join(line)))
            if text and varies[0]:
                blocks.append(text)
            line.clear()
        varies[0] = False

    stack = [(top, iter(top.kids))]
    while stack:
        node, kids = stack[-1]
        k = next(kids, None)
        if k is None:
            stack.pop()
            if node.tag in BLOCK:
                end()
        elif isinstance(k, str):
            line.append(k)
            varies[0] = varies[0] or id(k) not in fixed and bool(k.strip())
        elif k.tag in BLOCK:
            end()
            if k.tag not in VOID and not skipped(k):
                stack.append((k, iter(k.kids)))
        elif not excluded(k, found):
            if k.tag not in RAW:
                stack.append((k, iter(k.kids)))
    end()
    return "\n".join(blocks)


# --- on DataFrames


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    known: dict[str, list] = {}
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = wrapper_of(page)
            known[host] = merge(known[host], w) if host in known else w
    ctx = TaskContext.get()
    part = ctx.partitionId() if ctx else 0
    yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([part % 32] * len(known), pa.int32()), pa.array([json.dumps(w) for w in known.values()], pa.string())], ["host", "salt", "wrapper"])


def _merged(key, tbl):
    ws = sorted(tbl.column("wrapper").to_pylist())
    one = json.loads(ws[0])
    for w in ws[1:]:
        one = merge(one, json.loads(w))
    return pa.table({"host": [key[0].as_py()], "salt": pa.array([0], pa.int32()), "wrapper": [json.dumps(one)]})


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): one wrapper (as JSON) for each host, from all its pages."""
    kind = "host string, salt int, wrapper string"
    src = pages.select(F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), text_or_empty(html_col).alias("html"))
    return src.mapInArrow(_fold, kind).groupBy("host", "salt").applyInArrow(_merged, kind).groupBy("host").applyInArrow(_merged, kind).select("host", "wrapper")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template] = {}
    for big in batches:
        for batch in pieces(big, column="html"):
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = Template(json.loads(wrapper)) if wrapper else None
                texts.append(main_text(page, known[wrapper]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


#: Wrappers are broadcast up to this many characters in all; beyond it pages and wrappers meet in a shuffled join.
BROADCAST_CHARS = 32 << 20


def extract(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, by the wrapper of its host."""
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    side = wrappers.select(F.col("host").alias("w_host"), "wrapper")
    side = F.broadcast(side) if size <= BROADCAST_CHARS else side
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"))
    joined = src.join(side, F.col("host") == F.col("w_host"), "left").select("id", "url", "html", "wrapper")
    return joined.mapInArrow(_extract, "id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from alphaloom.llm.shared import materialise

    pages = table(spark, sf_dir, "pages")
    return extract(pages, materialise(infer_wrappers(pages), "wrappers")).withColumnRenamed("id", "page_id")
