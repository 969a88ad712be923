"""HTML extraction by wrappers: union-free regular expressions inferred from pages of one host.

A page is a balanced stream of structural tags and text slots (inline tags vanish, scripts, styles and comments are
skipped, missing end tags are supplied).  Repeats next to each other fold into groups.  Two streams of a host are
aligned; what only one has becomes optional, what one repeats becomes a repeated group, texts that differ become
slots.  Aligning page after page gives the host's wrapper:

    ("e", tag, nodes)  ("x", constant text or None for a slot, pages)  ("+", nodes)  ("?", nodes)

The wrapper of a host is fixed before pages are read.  Its text nodes are labelled once: main (in an article or main
element), open (elsewhere), none (in a part that is no main text).  In an article a part is none by its tag or role; by
a plain name (advert, notice, comments); by a vague name (related, header, promo) only if the wrapper bears it out, all
its texts being constants of the host while the article has slots; and, whatever its name, as a repeated group of
readers' comments: inner articles, or at the article's end units of two texts and more without headings or tables,
under a heading that is a constant of the host.  Names and repeats count only where the article keeps text without the
part.  A page is parsed by its host's wrapper, so each of its texts gets the label of
the node that matched it; a page that does not fit is aligned with the wrapper for itself alone, so no page's result
depends on another row of its batch.  Main text is what main nodes matched.  On a page where they match nothing it is
what open nodes matched, but for the site's own texts: those that stand on every page of the host, counted over all its
pages, and only if two of them differ.  Of a page's places of such a text those go that are matched by a node that has
it on half of the pages; all of them if there is none.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import sys
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util

#: Pages of a host that its wrapper is inferred from; all pages are parsed, and widen it where they must.
SAMPLE = 8
#: Bytes of wrappers that are broadcast at most; more go by a join.
MOST_BROADCAST = 32 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<![^>]*>|<\?[^>]*>", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_ENDED_BY = {"p": {"p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "form", "nav", "aside", "header", "footer", "main", "figure", "dl", "hr", "address"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "math"}
#: Names of parts that are no main text; a name's last word counts, those of containers aside.
_DROPPED_WORDS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|sidebar\w*|footer|header|breadcrumbs?|cookies?|consent|notices?|popup|modal|newsletter|subscribe|share|sharing|social|comments?|replies|disqus|related|recommended|pagination|toolbar|widget|hidden"
)
_CONTAINER_WORDS = re.compile(r"\d*|area|bar|block|body|box|button|buttons|col|column|container|content|form|group|holder|icons|inner|item|items|links|list|outer|panel|posts|row|section|signup|slot|thread|unit|widget|wrap|wrapper")
#: Blocks of text: only these names drop them.
_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt", "td", "th", "figcaption"}
_BLOCK_WORDS = re.compile(r"ads?|advert\w*|sponsored|cookies?|consent|notices?|comments?|breadcrumbs?|hidden")
#: Names that an article's own parts bear as well; in an article they count if the wrapper bears them out.
_VAGUE_WORDS = re.compile(r"header|related|recommended|promo\w*|banner|social|widget")
_VAGUE_BLOCK_WORDS = re.compile(r"comment")
#: Tags of units that are no readers' comments.
_STRUCTURED = {"h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "dt", "dd", "figure", "pre"}
_DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}


def _named(value: str, block: bool) -> str:
    """'~' if a class or id names a part that is no main text, '^' if it does so vaguely, else ''."""
    mark = ""
    for name in value.lower().split():
        words = re.split(r"[-_]+", name)
        while len(words) > 1 and _CONTAINER_WORDS.fullmatch(words[-1]):
            words.pop()
        if (_BLOCK_WORDS if block else _DROPPED_WORDS).fullmatch(words[-1]):
            if not (_VAGUE_BLOCK_WORDS if block else _VAGUE_WORDS).fullmatch(words[-1]):
                return "~"
            mark = "^"
    return mark


def stream(page: str) -> list[tuple[str, str]]:
    """("o", tag), ("c", tag), ("x", text): balanced; tags carry a mark if all inside is no main text: '!', or by name '~', or '^' if vaguely."""
    out: list[tuple[str, str]] = []
    opened: list[str] = []
    count: dict[str, int] = {}
    text: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        if text:
            t = " ".join("".join(text).split())
            text.clear()
            if t:
                out.append(("x", t))

    def close(k: int) -> None:
        flush()
        while len(opened) > k:
            out.append(("c", opened.pop()))
            count[out[-1][1].rstrip("!~^")] -= 1

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if name in _RAW:
            if not m.group(1):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in _INLINE:
            if name == "br":
                text.append(" ")
            continue
        if m.group(1):
            if count.get(name):
                for k in range(len(opened) - 1, -1, -1):
                    if opened[k].rstrip("!~^") == name:
                        close(k)
                        break
            else:
                flush()
            continue
        for k in range(len(opened) - 1, -1, -1):
            inner = opened[k].rstrip("!~^")
            if name in _ENDED_BY.get(inner, ()):
                close(k)
            elif inner not in ("p", "dt", "dd", "td", "th"):
                break
        flush()
        if name in _VOID:
            continue
        drop, named = name in _DROPPED, ""
        for a in _ATTR.finditer(m.group(3) or ""):
            key, value = (a.group(1) or a.group(3)).lower(), (a.group(2) or "").strip("\"'")
            drop |= key == "hidden" or key == "role" and value.lower() in _DROPPED_ROLES
            if key in ("class", "id"):
                named = max(named, _named(value, name in _BLOCKS))
        tag = name + ("!" if drop else named if name not in ("html", "body", "article", "main") else "")
        count[name] = count.get(name, 0) + 1
        opened.append(tag)
        out.append(("o", tag))
    close(0)
    return out


def fold(tokens: list[tuple[str, str]], join: bool = True) -> list:
    """Wrapper nodes of one page: repeats next to each other become one group, if they are to be joined."""
    levels: list[list] = [[]]  # the insides of the elements that are open
    for kind, v in tokens:
        if kind == "x":
            levels[-1].append(["x", v, 1])
        elif kind == "o":
            levels.append([])
        else:
            unit = ["e", v, levels.pop()]
            beside = levels[-1]
            last = beside[-1] if beside and join else None
            if last and last[0] == "+" and last[1][0][1] == v:
                beside[-1] = ["+", merge(last[1], [unit])]
            elif last and last[0] == "e" and last[1] == v:
                beside[-1] = ["+", merge([last], [unit])]
            else:
                beside.append(unit)
    todo = [levels[0]]
    while todo:  # however often a page repeats a text, it is one page
        for n in todo.pop():
            if n[0] == "x":
                n[2] = 1
            else:
                todo.append(n[-1])
    return levels[0]


def _shape(nodes: list) -> str:
    return "".join("#" if n[0] == "x" else f"<{n[1]}>{_shape(n[2])}</{n[1]}>" if n[0] == "e" else f"{n[0]}({_shape(n[1])})" for n in nodes)


def merge(a: list, b: list) -> list:
    """The least wrapper of this kind that both sequences satisfy."""
    key = lambda n: "=" + _first(n) if n[0] in "+?" else _first(n)
    if [key(n) for n in a] == [key(n) for n in b]:
        return [_both(x, y) for x, y in zip(a, b)]
    # an element, a repeated group and an optional part that begin alike can be aligned
    out: list = []
    match = SequenceMatcher(None, [_first(n) for n in a], [_first(n) for n in b], autojunk=False)
    for op, i, j, k, m in match.get_opcodes():
        if op == "equal":
            for x, y in zip(a[i:j], b[k:m]):
                out.extend(_merge_unit(x, y))
        else:
            out.extend(n if n[0] == "?" else ["?", [n]] for n in a[i:j] + b[k:m])
    return out


def _first(n: list) -> str:
    while n[0] in "+?":
        n = n[1][0]
    return "#" if n[0] == "x" else n[1]


def _merge_unit(x: list, y: list) -> list:
    if x[0] in "+?" or y[0] in "+?":
        a, b = (v[1] if v[0] == "?" else [v] for v in (x, y))
        if a[0][0] == "+" or b[0][0] == "+":
            got = [["+", merge(*(v[0][1] if v[0][0] == "+" and len(v) == 1 else v for v in (a, b)))]]
        else:
            got = merge(a, b)
        return [["?", got]] if x[0] == "?" or y[0] == "?" else got
    return [_both(x, y)]


def _both(x: list, y: list) -> list:
    if x[0] == "x":
        return ["x", x[1] if x[1] == y[1] else None, x[2] + y[2]]
    return [*x[:-1], merge(x[-1], y[-1])]


def infer(pages: list[str]) -> list:
    """The wrapper of some pages of a host; copies of a page count once."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
    out: list | None = None
    for p in dict.fromkeys(pages):
        nodes = fold(stream(p))
        out = nodes if out is None else merge(out, nodes)
    return out or []


def pack(wrapper: list) -> str:
    """The wrapper as flat JSON, however deep its groups are."""
    out, todo = [], [iter(wrapper)]
    while todo:
        n = next(todo[-1], None)
        if n is None:
            todo.pop()
            out.append([")"])
        elif n[0] == "x":
            out.append(n[:3])
        else:
            out.append(n[:-1])
            todo.append(iter(n[-1]))
    return json.dumps(out[:-1])


def unpack(flat: str) -> list:
    levels: list[list] = [[]]
    for n in json.loads(flat):
        if n[0] == ")":
            levels.pop()
        else:
            levels[-1].append(n)
            if n[0] != "x":
                n.append([])
                levels.append(n[-1])
    return levels[0]


_NONE, _OPEN, _MAIN = 0, 1, 2
_HEADINGS = {"h2", "h3", "h4", "h5", "h6"}


def label(wrapper: list) -> list[int]:
    """Numbers the wrapper's text nodes and gives each its label, as the module's text says."""
    dropped, named, vague, article = [], [], [], []  # of each text: by tag, by a plain name, by any, the outermost article it is in
    slot, fixed, headed, single = [], [], [], []  # one text or several, the same on two pages at least, in a heading, in no group
    parts, groups = [], []  # vague parts in an article; repeated groups in one: (first text, end, their article, are they articles)
    count = dict.fromkeys(("!", "~", "^", "+", "h", "a", "s", "g"), 0)  # how many such nodes are open ("s", "g": structured tags and groups met so far)
    within = articles = 0
    todo = [(None, iter(wrapper), 0, 0, 0)]
    while todo:
        open_, rest, begin, met, held = todo[-1]
        n = next(rest, None)
        if n is None:
            todo.pop()
            if open_ is None:
                continue
            kind, tag = open_[0], _first(open_) if open_[0] == "+" else open_[1] if open_[0] == "e" else ""
            if kind == "+":
                count["+"] -= 1
                if within and len(dropped) > begin:
                    inner = tag == "article" and count["a"] > 0
                    if inner or (len(dropped) >= begin + 2 or count["g"] > held) and count["s"] == met and tag != "p":
                        groups.append((begin, len(dropped), articles, inner))
            elif kind == "e":
                if tag[-1] in "!~^":
                    count[tag[-1]] -= 1
                    if tag[-1] == "^" and within:
                        parts.append((begin, len(dropped)))
                count["h"] -= tag in _HEADINGS
                count["a"] -= tag == "article"
                within -= tag in ("article", "main")
        elif n[0] == "x":
            n[3:] = [len(dropped)]
            dropped.append(count["!"] > 0)
            named.append(count["~"] > 0)
            vague.append(count["~"] + count["^"] > 0)
            article.append(articles if within else 0)
            slot.append(n[1] is None)
            fixed.append(n[1] is not None and n[2] >= 2)
            headed.append(count["h"] > 0)
            single.append(count["+"] == 0)
        else:
            if n[0] == "+":
                count["+"] += 1
                count["g"] += 1
            todo.append((n, iter(n[-1]), len(dropped), count["s"], count["g"]))
            if n[0] == "e":
                tag = n[1]
                if tag[-1] in "!~^":
                    count[tag[-1]] += 1
                count["h"] += tag in _HEADINGS
                count["s"] += tag in _STRUCTURED
                count["a"] += tag == "article"
                if tag in ("article", "main"):
                    articles += not within
                    within += 1
    varied = {a for a, d, s, o in zip(article, dropped, slot, single) if a and not d and s and o}
    last = {a: k for k, (a, d, m) in enumerate(zip(article, dropped, named)) if not d and not m}
    changing = [0, *accumulate(not f for f in fixed)]
    out = list(named)
    for begin, end in parts:
        if end > begin and article[begin] in varied and changing[begin] == changing[end]:
            out[begin:end] = [True] * (end - begin)
    done = -1
    for begin, end, a, inner in sorted(groups, key=lambda g: (g[0], -g[1])):  # outer groups first
        heading = begin - 1 if begin and headed[begin - 1] and fixed[begin - 1] and single[begin - 1] and article[begin - 1] == a else None
        if begin >= done and (inner or a in varied and heading is not None and last.get(a, -1) < end):
            done = end
            out[begin:end] = [True] * (end - begin)
            if heading is not None:
                out[heading] = True
    keeps = {a for a, d, m in zip(article, dropped, out) if not d and not m}
    return [_NONE if d or (m and a in keeps if a else v) else _MAIN if a else _OPEN for a, d, m, v in zip(article, dropped, out, vague)]


def parse(wrapper: list, tokens: list[tuple[str, str]]) -> list[int] | None:
    """The number of the node that matched each text (-1 for tags); None if the page does not fit."""
    nodes = [-1] * len(tokens)
    end = _match(wrapper, tokens, 0, nodes)
    return nodes if end == len(tokens) else None


def _match(nodes: list, tokens: list, at: int, found: list[int]) -> int:
    for n in nodes:
        kind = n[0]
        if kind == "e":
            if at >= len(tokens) or tokens[at] != ("o", n[1]):
                return -1
            at = _match(n[2], tokens, at + 1, found)
            if at < 0 or tokens[at] != ("c", n[1]):
                return -1
            at += 1
        elif kind == "x":
            if at >= len(tokens) or tokens[at][0] != "x" or n[1] is not None and tokens[at][1] != n[1]:
                return -1
            found[at] = n[3]
            at += 1
        else:
            got = _match(n[1], tokens, at, found)
            if got < 0:
                if kind == "+":
                    return -1
                continue
            at = got
            while kind == "+":
                got = _match(n[1], tokens, at, found)
                if got <= at:
                    break
                at = got
    return at


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Host:
    """The fixed wrapper of a host, read once, and the texts of its site: (node, hash)."""

    def __init__(self, wrapper: list, site: set[tuple[int, int]] = frozenset()) -> None:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # Python's own frames only, none of C's stack
        self.wrapper, self.labels = wrapper, label(wrapper)
        self.site, self.anywhere = site, {h for _, h in site}

    def read(self, page: str) -> tuple[bool, list[tuple[int, int, str]]]:
        """(does it fit, (label, node, text) of each text in page order)."""
        tokens = stream(page)
        nodes, labels = parse(self.wrapper, tokens), self.labels
        fits = nodes is not None
        if not fits:
            for own in (lambda: unpack(pack(merge(self.wrapper, fold(tokens)))), lambda: fold(tokens, join=False)):
                wider = own()
                labels = label(wider)
                nodes = parse(wider, tokens)
                if nodes is not None:  # the page's own tokens always fit
                    break
        return fits, [(labels[k], k, v) for k, (kind, v) in zip(nodes, tokens) if kind == "x"]

    def main_text(self, page: str | None) -> str:
        """The blocks of the article, one a line."""
        if not page:
            return ""
        fits, texts = self.read(page)
        blocks = [v for kind, _, v in texts if kind == _MAIN]
        if not blocks:
            rest = [(k, v, text_hash(v) if self.anywhere else 0) for kind, k, v in texts if kind == _OPEN]
            placed = {h for k, _, h in rest if fits and (k, h) in self.site}
            blocks = [v for k, v, h in rest if h not in self.anywhere or h in placed and (k, h) not in self.site]
        return "\n".join(blocks)


def _host(pages: DataFrame):
    return F.coalesce(F.lower(F.regexp_extract(pages["url"], r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def host_wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, wrapper as JSON) from `sample` pages of each host at most, drawn by hash.

    min_by with partial aggregation picks the ids, so a host with a third of all pages moves a few rows only.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), _host(pages).alias("host"), pages["html"].alias("html")).where("html is not null")
    picks = rows.groupBy("host").agg(*[F.min_by("page_id", F.xxhash64("page_id", F.lit(j))).alias(f"p{j}") for j in range(sample)])
    picks = util.persist(picks.select(F.explode(F.array_distinct(F.array(*[f"p{j}" for j in range(sample)]))).alias("page_id")).distinct())
    if picks.count() <= 50_000:  # 8 bytes each
        picks = F.broadcast(picks)
    chosen = rows.join(picks, "page_id", "left_semi").groupBy("host", "page_id").agg(F.min("html").alias("html"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        some = pdf.sort_values(["page_id"])["html"].tolist()
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [pack(infer(some))]})

    return chosen.groupBy("host").applyInPandas(kernel, "host string, wrapper string")


def _given(rows: DataFrame, by_host: DataFrame, most: int):
    """(rows, a lookup by host or None): small tables go by broadcast, others by a join, each host salted."""
    sizes = [F.length(c) if t == "string" else 24 * F.coalesce(F.size(c), F.lit(0)) for c, t in by_host.dtypes]
    size = by_host.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0
    if size <= most:
        return rows, rows.sparkSession.sparkContext.broadcast({r[0]: tuple(r)[1:] for r in by_host.collect()})
    salts = 32
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    by_host = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(by_host, ["host", "salt"], "left"), None


class _Hosts:
    """Hosts of a task, read when first met, forgotten when they get many."""

    def __init__(self, fixed) -> None:
        self.fixed, self.known, self.held = fixed, {}, 0

    def of(self, rb: pa.RecordBatch, i: int) -> Host:
        host = rb.column("host")[i].as_py()
        if host not in self.known:
            if self.fixed is not None:
                wrapper, *site = self.fixed.value.get(host, (None, None))
            else:
                wrapper, *site = (rb.column(c)[i].as_py() for c in ("wrapper", "site") if c in rb.schema.names)
            self.held += len(wrapper or "")
            if self.held > MOST_BROADCAST:
                self.known.clear()
                self.held = len(wrapper or "")
            pairs = [(x["node"], x["hash"]) if isinstance(x, dict) else tuple(x) for x in (site[0] if site else None) or ()]
            self.known[host] = Host(unpack(wrapper or "[]"), set(pairs))
        return self.known[host]


def host_sites(rows: DataFrame, wrappers: DataFrame, most: int) -> DataFrame:
    """(host, site): hashes of the texts that stand on each of the host's different pages, of which it has two at least.

    Each with the nodes that match it on half of the pages, and with node -1.  Pages with the same texts in the same order
    count once.  Only hosts that have a page without a text in an article are counted.
    """
    joined, fixed = _given(rows.where("html is not null and html <> ''"), wrappers, most)

    def kernel(batches) -> Iterator[pa.RecordBatch]:
        hosts = _Hosts(fixed)
        for rb in util.slices(batches, "html"):
            bare, prints, pairs = [], [], []
            for i, page in enumerate(rb.column("html").to_pylist()):
                fits, texts = hosts.of(rb, i).read(page)
                hashes = [text_hash(v) for _, _, v in texts]
                bare.append(not any(kind == _MAIN for kind, _, _ in texts))
                prints.append(hashlib.blake2b(repr(hashes).encode(), digest_size=16).digest())
                pairs.append([{"node": k, "hash": h} for k, h in sorted({(k if fits else -1, h) for (_, k, _), h in zip(texts, hashes)})])
            kind = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_pydict({"host": rb.column("host"), "bare": pa.array(bare, pa.bool_()), "print": pa.array(prints, pa.binary()), "pairs": pa.array(pairs, kind)})

    facts = util.persist(joined.mapInArrow(kernel, "host string, bare boolean, print binary, pairs array<struct<node:int,hash:long>>"))
    different = facts.join(facts.where("bare").select("host").distinct(), "host", "left_semi").groupBy("host", "print").agg(F.min("pairs").alias("pairs"))
    n = different.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    each = different.select("host", F.explode(F.array_distinct(F.transform("pairs", lambda p: p["hash"]))).alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("k"))
    every = each.join(n, "host").where("k = n").select("host", "hash", "n")
    nodes = different.select("host", F.explode("pairs").alias("p")).where("p.node >= 0").groupBy("host", F.col("p.hash").alias("hash"), F.col("p.node").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    often = nodes.join(every, ["host", "hash"]).where("2 * k >= n").select("host", "hash", "node")
    site = every.select("host", "hash", F.lit(-1).alias("node")).unionByName(often)
    return site.groupBy("host").agg(F.collect_list(F.struct("node", "hash")).alias("site"))


def extract(pages: DataFrame, sample: int = SAMPLE, most: int = MOST_BROADCAST) -> DataFrame:
    """One row per page: page_id, url, main text, its code points.

    Null and empty pages give empty texts; a null url belongs to host ''; repeated rows give repeated rows.  Pages
    are read whole, however long or deeply nested.  Wrappers are broadcast up to `most` bytes; beyond that they are
    joined, each host salted.
    """
    util.ship(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"), _host(pages).alias("host"))
    wrappers = util.persist(host_wrappers(pages, sample))
    joined, fixed = _given(rows, util.persist(wrappers.join(host_sites(rows, wrappers, most), "host", "left")), most)

    def kernel(batches) -> Iterator[pa.RecordBatch]:
        hosts = _Hosts(fixed)
        for rb in util.slices(batches, "html"):
            texts = [hosts.of(rb, i).main_text(page) for i, page in enumerate(rb.column("html").to_pylist())]
            yield pa.RecordBatch.from_pydict({"page_id": rb.column("page_id"), "url": rb.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return joined.mapInArrow(kernel, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
