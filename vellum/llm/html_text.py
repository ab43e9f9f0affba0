"""Main-text extraction by composite text density.

Pages become trees. Every node's density is its characters per tag, adjusted for links;
a node's density sum adds the densities of its children. The node of the greatest sum is
the core, and the least density on its path to the body is the threshold that further
subtrees must reach to count as well.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content, with raw text, that stand as blocks, and that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br option html body caption tbody td tfoot th thead tr legend summary".split())
DROPPED = frozenset("nav header footer aside form script style textarea title noscript iframe xmp noembed noframes head button select option menu dialog template object svg canvas input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class names and ids of what is no main text.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus dropdown footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain paywall popup promo promoted promotion related reply respond share sharing sidebar signup social sponsor sponsored subscribe taboola toolbar widget widgets".split())
#: Of these, the ones that go even where they hold an article, and what turns a class name's meaning.
COMMENTS = frozenset("comment comments commentlist disqus reply respond".split())
TURNED = frozenset("has with no without hide hidden is".split())
MAIN = frozenset(("article", "main"))
#: Elements that only mark a phrase; they count as no tags and their text is their parent's.
PHRASE = frozenset("abbr acronym b bdi bdo big br cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A subtree whose class names speak against it stays if the core in it has this many times the density sum of any other, and this many characters.
DENSER, LEAST = 4, 250
_WORDS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")

#: A whole tag from its "<" on. Possessive throughout, so a failed match has read each character once; it fails only where the page ends inside the tag.
TAG = re.compile(r"""<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]*+[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\r\f>]*+))?+)*+)[ \t\n\r\f]*+(/?)[ \t\n\r\f/]*+>""")
ATTRIBUTE = re.compile(r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\r\f>]*+)))?+""")
#: What may name a role or a class at all.
_NAMED = re.compile(r"class|id|role", re.I)
SPACE = re.compile(r"\s+")
#: Opening one of the first closes an open one of the second, unless the third is nearer.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}


class Tree:
    """Nodes in page order, as parallel lists; 0 is the root.

    Text is kept in page order as (node, words), with (-1, " ") where a block begins or ends.
    """

    def __init__(self) -> None:
        self.tag, self.parent, self.end, self.dropped = ["#root"], [-1], [0], [False]
        self.doubtful: list[int] = []
        self.comments: list[int] = []
        self.text: list[tuple[int, str]] = []


def _level(tag: str, rest: str) -> int:
    """0 for what may be main text, 1 where class names speak against it, 2 for reader comments, 3 for what never is."""
    if tag in DROPPED:
        return 3
    if not rest or tag in MAIN or tag in ("body", "html") or not _NAMED.search(rest):
        return 0
    found = 0
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name = name.lower()
        if name not in ("class", "id", "role"):
            continue
        for value in (a or b or c).split():
            words = {w.lower() for w in _WORDS.split(value)}
            if name == "role":
                found = max(found, 3 * bool(words & ROLES))
            elif not words & TURNED:
                found = max(found, 2 if words & COMMENTS else 1 if words & MARKS else 0)
    return found


def parse(page: str) -> Tree:
    """The tree of a page; unclosed and stray tags are mended, comments and declarations left out.

    One scan forward: where no end of a comment, declaration or tag follows, the rest of
    the page belongs to it and holds no text.
    """
    tree, stack, at, size = Tree(), [0], 0, len(page)
    tag, parent, end, dropped, text = tree.tag, tree.parent, tree.end, tree.dropped, tree.text
    places: dict[str, list[int]] = {"#root": [0]}  # of each name, the depths of its open elements

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            node = stack.pop()
            end[node] = len(tag)
            places[tag[node]].pop()
            if tag[node] in BLOCK:
                text.append((-1, " "))

    def deepest(names: Iterable[str]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def skip(mark: str, start: int) -> int:
        stop = page.find(mark, start)
        return size if stop < 0 else stop + len(mark)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text.append((stack[-1], page[at:]))
            break
        if lt > at:
            text.append((stack[-1], page[at:lt]))
        sign = page[lt + 1 : lt + 2]
        if sign == "!" or sign == "?":
            at = skip("-->", lt + 4) if page.startswith("<!--", lt) else skip("]]>", lt + 9) if page.startswith("<![CDATA[", lt) else skip(">", lt + 2)
            continue
        letter = page[lt + 2 : lt + 3] if sign == "/" else sign
        if not (letter.isascii() and letter.isalpha()):
            text.append((stack[-1], "<"))
            at = lt + 1
            continue
        m = TAG.match(page, lt)
        if m is None:
            break
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if depth := deepest((name,)):
                close(depth)
            continue
        if name in CLOSES_P or name in IMPLIED:
            shut, stop = IMPLIED.get(name, ({"p"}, {"table", "td", "th", "article", "div", "section", "main", "blockquote", "li"}))
            shut = shut | {"p"} if name in CLOSES_P else shut
            depth = deepest(shut)
            if depth and depth >= deepest(stop):
                close(depth)
        node = len(tag)
        tag.append(name)
        parent.append(stack[-1])
        end.append(node + 1)
        level = _level(name, m[3])
        dropped.append(level == 3 or dropped[stack[-1]])
        if 0 < level < 3 and not dropped[-1]:
            (tree.doubtful if level == 1 else tree.comments).append(node)
        if name in BLOCK:
            text.append((-1, " "))
        if name in VOID or m[4] and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            stop = _find_close(page, name, at)
            at = size if stop < 0 else skip(">", stop)
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append(node)
    close(1)
    end[0] = len(tag)
    return tree


_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _find_close(page: str, name: str, at: int) -> int:
    m = _CLOSERS[name].search(page, at)
    return m.start() if m else -1


class Densities:
    """Composite text density of every node, with the subtrees in ``dropped`` left out."""

    def __init__(self, tree: Tree, chars: list[int], dropped: list[bool]) -> None:
        n, parent = len(tree.tag), tree.parent
        phrase = [t in PHRASE for t in tree.tag]
        total, linked, tags, links, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = tree.tag[i] == "a" or in_link[parent[i]]
        own = chars[:]
        for i in range(n - 1, -1, -1):
            if dropped[i]:
                continue
            total[i] += chars[i]
            linked[i] += chars[i] * in_link[i]
            if i:
                p = parent[i]
                total[p] += total[i]
                linked[p] += linked[i]
                tags[p] += tags[i] + (not phrase[i])
                links[p] += links[i] + (in_link[i] and not phrase[i])
                if phrase[i]:
                    own[p] += own[i]
        body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
        all_chars, all_linked = max(total[body], 1), linked[body]
        e, log = math.e, math.log

        def adjusted(c: int, t: int, lc: int, lt: int) -> float:
            if not c:
                return 0.0
            base = log(c / max(c - lc, 1) * lc + all_linked / all_chars * c + e)
            return c / t * max(log(c / max(lc, 1) * (t / lt)), 0.0) / base

        density = [0.0 if dropped[i] or phrase[i] else adjusted(total[i], max(tags[i], 1), linked[i], max(links[i], 1)) for i in range(n)]
        # a node's own words count as a child without tags, so that leaves can be the core
        sums = [0.0 if dropped[i] or phrase[i] else adjusted(own[i], 1, own[i] * in_link[i], 1) for i in range(n)]
        up = parent[:]
        for i in range(1, n):
            while phrase[up[i]]:
                up[i] = up[up[i]]
            if not dropped[i]:
                sums[up[i]] += density[i]
        self.total, self.linked, self.density, self.sums, self.body = total, linked, density, sums, body
        alive = [i for i in range(n) if not dropped[i] and total[i] and not phrase[i]]
        self.core = max(alive, key=lambda i: (sums[i], total[i], -i)) if alive else -1
        if self.core >= 0 and not sums[self.core]:
            self.core = body


def _gone(tree: Tree, nodes: list[int], before: list[bool]) -> list[bool]:
    out = before[:]
    for i in nodes:
        if not out[i]:
            out[i : tree.end[i]] = [True] * (tree.end[i] - i)
    return out


def judge(tree: Tree, chars: list[int]) -> tuple[list[bool], Densities]:
    """What is left out, and the densities without it.

    Subtrees whose class names speak against them go, but for those that hold an article
    and those that hold what is by far the densest: class names never remove the core.
    Reader comments go unless the page holds nothing else.
    """
    hard = _gone(tree, tree.comments, tree.dropped)
    doubtful = tree.doubtful
    if tree.comments and not any(c for c, gone in zip(chars, hard, strict=True) if not gone):
        hard, doubtful = tree.dropped, sorted(doubtful + tree.comments)
    articles = [0]  # articles among the nodes before each
    for name, gone in zip(tree.tag, hard, strict=True):
        articles.append(articles[-1] + (name in MAIN and not gone))
    marked = [i for i in doubtful if not hard[i] and articles[tree.end[i]] == articles[i]]
    if not marked:
        return hard, Densities(tree, chars, hard)
    dropped = _gone(tree, marked, hard)
    rest = Densities(tree, chars, dropped)
    sizes = [0]
    for c, gone in zip(chars, hard, strict=True):
        sizes.append(sizes[-1] + (0 if gone else c))
    if not any(sizes[tree.end[i]] - sizes[i] >= LEAST for i in marked):
        return dropped, rest
    whole = Densities(tree, chars, hard)
    best = whole.sums[whole.core]
    if rest.core >= 0 and best <= DENSER * rest.sums[rest.core] or whole.total[whole.core] - whole.linked[whole.core] < LEAST:
        return dropped, rest
    core, stop = whole.core, tree.end[whole.core]
    strong = [i for i in marked if i <= core < tree.end[i] or core < i < stop and max(whole.sums[i], whole.density[i]) * 2 >= best]
    if not strong:
        return dropped, rest
    spared = set(strong)
    dropped = _gone(tree, [i for i in marked if i not in spared], hard)
    return dropped, Densities(tree, chars, dropped)


def select(tree: Tree, chars: list[int]) -> list[bool]:
    """For each node whether its own text is main text. ``chars``: each node's own characters."""
    n, parent = len(tree.tag), tree.parent
    dropped, found = judge(tree, chars)
    keep = [False] * n
    core = found.core
    if core < 0:
        return keep
    threshold, i = found.density[core], core
    while i > 0 and i != found.body:
        threshold, i = min(threshold, found.density[i]), parent[i]
    above, i = set(), core
    while i >= 0:
        above.add(i)
        i = parent[i]
    for i in range(core, tree.end[core]):
        keep[i] = not dropped[i]
    i = found.body
    while i < n:  # subtrees beside the core that are as dense as its path
        if i not in above and not dropped[i] and not keep[i] and found.density[i] >= threshold > 0 and found.total[i] > found.linked[i]:
            for j in range(i, tree.end[i]):
                keep[j] = not dropped[j]
            i = tree.end[i]
        else:
            i += 1
    return keep


def extract(page: str) -> str:
    """Main text of a page: blocks in page order joined by one space, references decoded."""
    tree = parse(page)
    decoded = [(node, entities.unescape(t)) for node, t in tree.text if node < 0 or not tree.dropped[node]]
    chars = [0] * len(tree.tag)
    for node, t in decoded:
        if node >= 0:
            chars[node] += len("".join(t.split()))
    keep = select(tree, chars)
    return SPACE.sub(" ", "".join(t for node, t in decoded if node < 0 or keep[node])).strip()


def main_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: ``id_col``, the ``carry`` columns, text and n_chars (its code points).

    Null, empty and textless pages have an empty text. Ids may be null or repeat; columns
    not named are ignored; empty input, empty result. A page of any size is read whole.
    """
    names = [id_col, *carry]
    schema = ", ".join(f"_{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(names)) + ", text string, n_chars bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [extract(h) if h else "" for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*part.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)], F.col(html_col).cast("string").alias("_html"))
    out = rows.mapInArrow(scan, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], "text", "n_chars")
