"""Main text of web pages by tag-path ratios.

Every piece of text hangs on a root-to-leaf tag path.  Paths, not nodes, are
judged: articles put their paragraphs on few paths that carry long, punctuated
text, while menus, notices and footers put short, unpunctuated text on theirs.
For each path the length of text outside links and the punctuation are summed
and divided by the number of its nodes.  Both ratios are smoothed along the
page, a neighbour counting by its distance and by how much of its tag path it
shares; they are fused by multiplication, weighed by what the path's own labels
make likely (``article`` is likely, ``class="sidebar"`` hardly), and compared
with a threshold taken from the page's best path.  Labels are weights: a path
with a doubtful label stays when its ratios are good, and a path inside
``article`` goes when they are not.  Length does not outweigh a label: beyond the
best path's own ratio a longer text counts no more, so long comments, notices
and adverts go wherever the page has other text; a page that is all within such
labels is judged by its ratios alone.  Only elements whose meaning is fixed by the
markup itself (``nav``, ``footer``, ``form``, hidden ones, ...) never count.

Short blocks (headings, list items, cells) are judged by their container: in a
container that passing paths fill, a path stays unless its labels are worse
than the container's or its nodes are a list of short links.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from heliograph.llm.columns import add_columns

# One token of a page.  Possessive repeats keep the scan linear on broken markup.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>?"
    r"|<[a-zA-Z][^<>]*>?"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STEM = re.compile(r"sidebar|cookie|advert|newsletter|breadcrumb|navbar|sponsor|adsby|commentlist|commentform")
_HEADING = re.compile(r"h[1-6](?![a-z0-9])")
_PUNCTUATION = re.compile(r"[.,;:!?…。,、!?;:]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math mfrac mi mn mo mover mroot mrow ms msqrt msub msubsup msup mtext munder munderover semantics".split()
)
_NEVER = frozenset("head nav footer aside form button menu dialog label fieldset legend datalist optgroup option select svg template".split())
#: Deeper elements without a label share the path of the one around them, as all paths would else grow with the square of
#: the depth; labels and end tags count at any depth.
DEEP = 512
# Open ones of these end at the next element of running text, as they cannot hold it.
_NO_TEXT = frozenset("select svg math option optgroup datalist button label".split())
_BODY = frozenset("article main".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_GROUPS = frozenset("ul ol dl table div article section".split())
_ITEMS = {name: (name,) for name in ("li", "tr", "td", "th")} | {name: ("dt", "dd") for name in ("dt", "dd")}
_SCOPE = frozenset("body html table td th button article section div main li blockquote aside nav header footer".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Fixed words that mark a container as something else than the article: hardly the article in any name, ...
_STRONG = frozenset(
    """ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar
    cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login signin comment comments disqus widget widgets toolbar pagination pager hidden copyright
    outbrain taboola paywall recommended recommendations trending""".split()
)
# ... in a name of nothing but such words and words of layout, ...
_LIKELY = frozenset("promo promoted promotion banner side foot header notice notices notification alert share sharing social related reply replies respond skip search form teaser disclaimer".split())
# ... and those that an article uses as often.
_DOUBTFUL = frozenset("discussion legal".split())
_LAYOUT = frozenset("area bar bars block blocks bottom box boxes btn button buttons container group icon icons inner item items left link links list lists main media page post posts right row section site slot tools top wrap wrapper".split())
STRONG, LIKELY, DOUBTFUL, IN_BODY = 0.02, 0.1, 0.5, 10.0

# Fixed words of that list that inside an article mark its own title.
_OF_TITLE = frozenset("header head title".split())


@dataclass
class Block:
    text: str
    path: str
    prior: float
    order: int
    linked: int = 0
    body: bool = False


@dataclass
class _Open:
    """An open element: weight of its labels and those around it, inside article or main, inside a link, path and its depth;
    places in the stack of the nearest element (itself included) that is not inline, that ends the search for an open
    ``p``, and that ends the search for an open item or cell; inside svg or math, inside one that holds no text."""

    name: str = ""
    path: str = ""
    weight: float = 1.0
    body: bool = False
    link: bool = False
    depth: int = 0
    block: int = 0
    scope: int = 0
    group: int = 0
    drawn: bool = False
    closed: bool = False


def _weight(said: str, in_body: bool) -> float:
    """How likely an element of this class or id belongs to the article; 1 says nothing."""
    weight = 1.0
    for name in said.split():
        words = {w.lower() for w in _WORD.findall(name)} - (_OF_TITLE if in_body else set())
        if not _STRONG.isdisjoint(words) or any(map(_STEM.match, words)):
            weight = min(weight, STRONG)
        elif words <= _LIKELY | _DOUBTFUL | _LAYOUT:
            weight = min([weight, *(LIKELY for w in words if w in _LIKELY), *(DOUBTFUL for w in words if w in _DOUBTFUL)])
    return weight


def _labels(name: str, attrs: str, in_body: bool = False) -> tuple[str, float]:
    """The path step of an element and its weight; 0 if the markup itself rules it out (the head of an article belongs to it)."""
    weight = 0.0 if name in _NEVER else 1.0
    whole = name in _BODY or name in ("html", "body")  # their labels speak of the page
    mark = ""
    if attrs and "=" in attrs or "hidden" in attrs:
        for key, a, b, c in _ATTR.findall(attrs):
            key, said = key.lower(), a or b or c
            value = said.lower()
            if key == "class" or key == "id":
                mark += f".{value.strip()}" if key == "class" else f"#{value.strip()}"
                weight *= 1.0 if whole else _weight(said, in_body)
            elif (
                (key == "role" and value in _ROLES)
                or (key == "style" and re.search(r"display:none|visibility:hidden", value.replace(" ", "")))
                or (key == "hidden" and value != "false")
                or (key == "aria-hidden" and value == "true")
            ):
                weight = 0.0
    return name + mark, weight


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order.

    A block ends at every tag that is not inline.  ``br`` and white space are
    one blank inside it.  End tags that close nothing are left out, an open
    ``p`` ends at the next block tag, and what is open at the end is closed.
    """
    found: list[Block] = []
    stack = [_Open()]
    open_at: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = 0
    known: dict[tuple[str, str, bool], tuple[str, float]] = {}
    where = stack[0]

    def flush() -> None:
        nonlocal parts, linked
        text = html.unescape("".join(parts)) if len(parts) > 1 or "&" in parts[0] else parts[0]
        text = " ".join(text.split())
        if text:
            found.append(Block(text, where.path, where.weight * (IN_BODY if where.body else 1.0), len(found), linked, where.body))
        parts, linked = [], 0

    def last(*names: str) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=0)

    def close(at: int) -> None:
        while len(stack) > at:
            open_at[stack.pop().name].pop()

    for m in _TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            if not parts:
                where = stack[-1]
            parts.append(m.group())
            if stack[-1].link:
                linked += len(m.group().strip())
            continue
        name = m.group("name")
        if name is None:
            if m.group("raw") and parts and m.group("raw").lower() not in ("script", "style"):
                flush()
            continue
        name = name.lower()
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if name not in _INLINE and parts:
            flush()
        if m.group("close"):
            at = last(name)
            if at and not (name in _INLINE and at < stack[-1].block):
                close(at)
            continue
        attrs = m.group("attrs")
        if name in _VOID:
            continue
        if name in _CLOSES_P or name == "li":
            while stack[-1].name in _NO_TEXT or stack[-1].closed:
                close(len(stack) - 1)
        if name in _CLOSES_P:
            if (at := last("p")) > stack[-1].scope:
                close(at)
        elif name in _ITEMS and (at := last(*_ITEMS[name])) > stack[-1].group:
            close(at)
        up = stack[-1]
        if attrs.endswith("/") and (up.drawn or name in ("svg", "math")):
            continue
        key = (name, attrs, up.body)
        step, weight = known.get(key) or known.setdefault(key, _labels(name, attrs, up.body))
        if name == "header" and not up.body:
            weight = 0.0
        weight *= up.weight
        at = len(stack)
        path = up.path if name in _INLINE or (up.depth >= DEEP and weight in (0.0, up.weight)) else f"{up.path}/{step}"
        stack.append(
            _Open(
                name,
                path,
                weight,
                up.body or name in _BODY,
                up.link or name == "a",
                up.depth + (path != up.path),
                up.block if name in _INLINE else at,
                at if name in _SCOPE else up.scope,
                at if name in _GROUPS else up.group,
                up.drawn or name in ("svg", "math"),
                weight == 0 and (up.closed or name in ("svg", "select") or last("svg", "select") > 0),
            )
        )
        open_at.setdefault(name, []).append(at)
    if parts:
        flush()
    return found


def _shared(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """The share of two tag paths that is common from the root."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return same / max(len(a), len(b), 1)


def _smooth(values: list[float], paths: list[tuple[str, ...]], radius: int = 2) -> list[float]:
    """Each value with its neighbours', by a Gaussian of the distance times the shared part of the tag paths."""
    kernel = [math.exp(-(d * d) / 2) for d in range(radius + 1)]
    out = []
    for i, own in enumerate(paths):
        total, weight = values[i], 1.0
        for j in range(max(0, i - radius), min(len(values), i + radius + 1)):
            if j != i:
                w = kernel[abs(i - j)] * (1.0 if paths[j] == own else _shared(own, paths[j]))
                total += values[j] * w
                weight += w
        out.append(total / weight)
    return out


@dataclass
class Path:
    """Sums over the nodes of a tag path."""

    nodes: int = 0
    chars: int = 0
    linked: int = 0
    marks: int = 0
    weight: float = 0.0
    body: bool = False

    @property
    def link_list(self) -> bool:
        """Mostly links; inside an article only several short ones are a list."""
        return 2 * self.linked > self.chars and not (self.body and (self.nodes < 3 or self.chars >= 60 * self.nodes))


def path_ratios(found: list[Block]) -> tuple[dict[str, Path], dict[str, float]]:
    """The sums of each path that the markup does not rule out, and its fused ratio.

    The fused ratio is the mean over the path's nodes of the geometric mean of
    its own text ratio and the smoothed one, times that of (1 + punctuation
    ratio), own and smoothed.  It says nothing of labels.
    """
    paths: dict[str, Path] = {}
    usable = [b for b in found if b.prior]
    for b in usable:
        p = paths.setdefault(b.path, Path())
        p.nodes += 1
        p.chars += len(b.text)
        p.linked += b.linked
        p.marks += len(_PUNCTUATION.findall(b.text))
        p.weight = max(p.weight, b.prior)
        p.body = p.body or b.body
    steps = {path: tuple(path.split("/")[1:]) for path in paths}
    text = [max(paths[b.path].chars - paths[b.path].linked, 0) / paths[b.path].nodes for b in usable]
    marks = [paths[b.path].marks / paths[b.path].nodes for b in usable]
    where = [steps[b.path] for b in usable]
    fused = dict.fromkeys(paths, 0.0)
    for b, own, t, said, m in zip(usable, text, _smooth(text, where), marks, _smooth(marks, where), strict=True):
        fused[b.path] += math.sqrt(own * t * (1 + said) * (1 + m)) / paths[b.path].nodes
    return paths, fused


def _containers(good: set[str], paths: dict[str, Path]) -> set[str]:
    """For each good path the largest container around it of which good paths hold most of the text; never the page itself."""
    inside: dict[str, list[int]] = {}
    for path, p in paths.items():
        up = path
        while up := up.rpartition("/")[0]:
            text = inside.setdefault(up, [0, 0])
            text[0] += p.chars
            text[1] += p.chars if path in good else 0
    out = set()
    for path in good:
        best, up = "", path
        while up := up.rpartition("/")[0]:
            if up.rpartition("/")[2] in ("html", "body"):
                break
            body = re.split(r"[.#]", up.rpartition("/")[2])[0] in _BODY
            if not best or body or 10 * inside[up][1] >= 7 * inside[up][0]:
                best = up
        if best:
            out.add(best)
    return out


def _judged(paths: dict[str, Path], fused: dict[str, float]) -> dict[str, float]:
    """Fused ratios times the weights of the labels, ratios counting up to that of the best path.

    The best path has the largest product; to be it, one that is hardly the article needs fifty times
    the ratio of the others, whatever its label.
    """
    def rank(path: str) -> float:
        weight = paths[path].weight / (IN_BODY if paths[path].body else 1.0)
        return fused[path] * paths[path].weight * (min(1.0, STRONG / weight) if weight <= LIKELY else 1.0)

    most = fused[max(paths, key=rank)]
    return {path: paths[path].weight * min(v, most) for path, v in fused.items()}


def select(found: list[Block], share: float = 0.12) -> list[Block]:
    """The content blocks: those on paths whose fused and weighed ratio reaches ``share`` of the page's best path.

    In a container that passing paths fill, the others stay too, but those with
    worse labels than a passing one and lists of short links.  On a page without
    such a container headings beside a passing path stay.
    """
    paths, fused = path_ratios(found)
    if not paths:
        return []
    fused = _judged(paths, fused)
    best = max(fused.values())
    good = {path for path, v in fused.items() if v >= share * best and not (paths[path].link_list and v < best)}
    weight: dict[str, float] = {}
    for path in good:
        up = path
        while up := up.rpartition("/")[0]:
            weight[up] = min(weight.get(up, math.inf), paths[path].weight)
    kept = set(good)
    containers = _containers(good, paths)
    for path, p in paths.items():
        up, around = path, path.rpartition("/")[0]
        while path not in kept and (up := up.rpartition("/")[0]):
            if up in containers and p.weight >= weight[up] and not p.link_list:
                kept.add(path)
        if around in weight and _HEADING.match(path.rpartition("/")[2]) and p.weight >= weight[around]:
            kept.add(path)
    return [b for b in found if b.path in kept and b.prior]


def main_text(page: str | None) -> str:
    """The article of a page, one line a block; empty if there is none.

    Null, empty and text-free pages give the empty text.
    """
    return "\n".join(b.text for b in select(blocks(page))) if page else ""


def extract(df: DataFrame, html_col: str = "html", out: str = "text", length_out: str = "n_chars") -> DataFrame:
    """``df`` with the main text of each page and its number of code points.

    Null and empty pages give the empty text; columns with the output's names
    are replaced, others pass through; repeated rows give equal results, an
    empty table an empty one.
    """

    def make(column: pa.Array) -> list[pa.Array]:
        texts = [main_text(v.as_py()) for v in column]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return add_columns(df, html_col, {out: "string", length_out: "bigint"}, make)
