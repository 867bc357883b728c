"""Main text of web pages by union-free wrappers inferred for each host.

A page's tokens form a tree of block elements (told apart by name and first
class) with blocks of text.  Consecutive siblings of one label fold into a
repeated group, so a page becomes a short union-free regular expression.  The
expressions of one host are aligned page by page: children that match are
merged, mismatched elements become optional or repeated groups, and text that
differs becomes a slot, until one wrapper covers every page of the host.  Text
that stays equal in all different pages, of two at least, in groups that none of
them lacks, is the host's template, not data.

The content region is the article, else the main element; all that it holds
outside of the groups for menus, headers, footers, side bars, notices, adverts,
forms and reader comments is main text, whether other pages say it too or not.
On a host without such elements the region is the group whose slots hold most
text; template counts for nothing there, so a menu that every page repeats loses
against an article, whatever it is called.  Of such a region, template goes,
except headings, which sites repeat in their articles; if all of it is template,
it stays (then the pages are copies, and nothing tells data from template).

Pages of a host are aligned in groups of ``GROUP`` different expressions, whose
wrappers are aligned ``FAN`` at a time until one is left, so a host with a third
of all pages is spread over many tasks; the order is that of the expressions, so
the result does not depend on how pages are stored.  What wrappers decide is broadcast only when its
measured size is within ``BROADCAST_BYTES``; else pages and wrappers meet in an
equi-join on the host, which adaptive execution may split.

Cases: null or empty html gives empty text; pages without a host share the empty
host; an empty table gives an empty result; unclosed and stray tags follow the
usual recovery (a new block ends an open paragraph, an end tag without a start
is ignored); elements nested deeper than ``DEPTH`` levels are read as siblings
on that level, which changes no text; more than ``WIDE`` different children are
aligned by label alone; a page without the groups that its host's wrapper marks
is its own wrapper; repeated rows are kept; other columns pass through, those
named like an added one are replaced.  A page is read in one pass that never
recurses.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_stage, cut, in_batches
from graphloom.llm.urlfilter import host_of

BROADCAST_BYTES = 8 << 20
#: Different expressions aligned in one group, and wrappers of groups aligned together.
GROUP, FAN = 1024, 16
#: Levels of nesting that are told apart, and children aligned in order.
DEPTH, WIDE = 60, 200

#: Elements without end tag, text elements, and elements that are never content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br img".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
NEVER = frozenset("head nav header footer aside form menu dialog button select option input fieldset canvas object audio video figcaption".split()) - {"figcaption"}
#: Words that mark boilerplate, whole or as a beginning, where they make up a whole class, id or role (see NEUTRAL).
MARKS = frozenset("ad ads adv advert adverts banner sponsor sponsored promo promotion promoted sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies notice notices consent gdpr alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments reply replies disqus respond responses discussion widget widgets pagination pager toolbar skip search contentinfo complementary".split())
BEGIN = ("advert", "sponsor", "comment", "cookie", "sidebar", "breadcrumb", "newsletter", "navbar", "footer", "adsby")
#: Words that leave a mark what it is: a class or id is boilerplate if it has a mark and else only these, digits and letters.
NEUTRAL = frozenset("site page main global top bottom left right inner outer primary secondary area bar block box container wrapper wrap holder content section panel list item items link links row col column unit slot text form button buttons icons body the my js id google".split())
#: Elements whose id is a title's slug, and the ids that mark readers' comments all the same.
SLUGS, READERS = frozenset("h1 h2 h3 h4 h5 h6 section".split()), frozenset(("comments", "respond", "disqus_thread"))
CELLS = frozenset("tr td th thead tbody".split())
ROOTS = frozenset("html body main article".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: An open paragraph ends where one of these starts.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@lru_cache(maxsize=4096)
def label(tag: str, attrs: str) -> str:
    """The element's name, with ``!`` if its attributes mark it as boilerplate."""
    if attrs and "=" in attrs:
        words, marked = set(), False
        for m in _ATTR.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            # The id of a heading or section is the slug of its title.
            slug = m[1].lower() == "id" and tag in SLUGS
            for token in value.split():
                if slug and token.lower() not in READERS:
                    continue
                own = {w.lower() for w in _WORD.findall(token)}
                words |= own
                if tag in HEADS | CELLS:
                    own -= {"header", "side", "search", "alert"}
                tells = {w for w in own if w in MARKS or w.startswith(BEGIN)}
                marked |= bool(tells) and all(w in tells or w in NEUTRAL or w.isdigit() or len(w) == 1 for w in own)
        if tag in ROOTS:
            marked = marked and any(w.startswith("comment") for w in words) and tag not in ("html", "body")
        if marked:
            return tag + "!"
        if tag in ("div", "section", "td") and "main" in words | ({"main"} if re.search(r"role\s*=\s*[\"']?main", attrs, re.I) else set()):
            return tag + "*"
    return tag


_MANY_DIGITS = re.compile(r"\d{2,}")


@lru_cache(maxsize=4096)
def signature(tag: str, attrs: str) -> str:
    """The label by which elements are aligned: the name with its mark, and the first class without numbers."""
    name = label(tag, attrs)
    for m in _ATTR.finditer(attrs or ""):
        if m[1].lower() == "class" and (first := (m[2] or m[3] or m[4] or "").split()[:1]):
            return name + "." + _MANY_DIGITS.sub("", first[0].replace("/", "").replace(".", ""))
    return name


def name_of(sign: str) -> str:
    return sign.split(".", 1)[0]


def walk(html: str) -> Iterator[tuple[str, str]]:
    """('<', signature), ('>', signature) and ('#', text) events of the block structure; raw elements are dropped."""
    at, stack = 0, []
    open_now: Counter[str] = Counter()
    n = len(html)

    def pop() -> tuple[str, str]:
        tag, sign = stack.pop()
        open_now[tag] -= 1
        return ">", sign

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            yield "#", html[at:]
            break
        if m.start() > at:
            yield "#", html[at : m.start()]
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "#", m[0][9:].removesuffix("]]>")
            continue
        tag = m[2].lower()
        if m[1]:
            if open_now[tag]:
                while stack[-1][0] != tag:
                    yield pop()
                yield pop()
            continue
        if tag in RAW:
            if not m[0].endswith("/>") and (end := re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)):
                at = end.end()
            elif tag in ("script", "style") and not m[0].endswith("/>"):
                at = n
            continue
        if tag == "br":
            yield "#", " "
            continue
        sign = signature(tag, m[3])
        if tag in VOID:
            if tag == "hr":
                yield "<", "hr"
                yield ">", "hr"
            continue
        if tag in INLINE and not name_of(sign).endswith("!"):
            continue
        closes = ("p",) if tag in ENDS_P else SIBLINGS.get(tag, ())
        if any(open_now[c] for c in closes):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    while len(stack) > i:
                        yield pop()
                    if tag != "tr":
                        break
                elif stack[i][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "td", "th", "li", "body"):
                    break
        stack.append((tag, sign))
        open_now[tag] += 1
        yield "<", sign
    while stack:
        yield pop()


def dead(name: str) -> bool:
    return name.endswith("!") or name.rstrip("!*") in NEVER


def blocks(html: str) -> Iterator[tuple[str, str, str]]:
    """Live structure with paths: ('<', signature, path), ('>', signature, path), ('#', text, path).

    Each text is a whole block, references decoded and white space collapsed.
    What lies inside of marked or never-content elements is left out.
    """
    parts: list[str] = []
    paths = [""]
    depth = dead_at = 0

    def text() -> list[tuple[str, str, str]]:
        got = " ".join(unescape("".join(parts)).split())
        parts.clear()
        return [("#", got, paths[-1])] if got else []

    for kind, what in walk(html):
        if kind == "#":
            if not dead_at:
                parts.append(what)
            continue
        name = name_of(what)
        block = name.rstrip("!*") not in INLINE
        if kind == "<":
            depth += 1
            if dead_at:
                continue
            if block:
                yield from text()
            if dead(name):
                dead_at = depth
            if block:
                paths.append(f"{paths[-1]}/{what}" if len(paths) <= DEPTH else paths[-1])
                yield "<", what, paths[-1]
        else:
            if dead_at in (0, depth) and block:
                if not dead_at:
                    yield from text()
                yield ">", what, paths.pop()
            if dead_at == depth:
                dead_at = 0
            depth -= 1
    yield from text()


# An expression is a list of groups [label, flags, inner]; flags: "", "?", "+", "*".  Inner is a list of groups; of text,
# labelled "#", [mark, length] of the blocks that every page says there, in order: all else there is a slot.
Group = list


def _both(a: str, b: str) -> str:
    many, maybe = "+" in a + b or "*" in a + b, "?" in a + b or "*" in a + b
    return "*" if many and maybe else "+" if many else "?" if maybe else ""


def _optional(g: Group) -> Group:
    return [g[0], _both(g[1], "?"), g[2]]


def _common(x: list, y: list) -> list:
    """Blocks of text that both have, in order: a longest common subsequence; what differs is a slot."""
    if x == y:
        return x
    both = {mark for mark, _ in x} & {mark for mark, _ in y}
    x, y = ([t for t in side if t[0] in both] for side in (x, y))
    if max(len(x), len(y)) > WIDE:
        return list({t[0]: t for t in x}.values())
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append(x[i])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _inner(x: Group, y: Group, page: bool) -> list:
    """Both inner parts as one. Text of one page is put in a row; of different pages what they share is kept."""
    if x[0] != "#":
        return align(x[2], y[2], page)
    return x[2] + y[2] if page else _common(x[2], y[2])


def _repeated(last: Group, g: Group, page: bool) -> Group:
    flags = _both(last[1], g[1]) if "?" in last[1] and "?" in g[1] else (last[1] + g[1]).replace("?", "")
    return [g[0], _both(flags, "" if g[0] == "#" else "+"), _inner(last, g, page)]


def fold(groups: list[Group], page: bool = False) -> list[Group]:
    """Runs of one label become a repeated group."""
    out: list[Group] = []
    for g in groups:
        if out and out[-1][0] == g[0]:
            out[-1] = _repeated(out[-1], g, page)
        else:
            out.append(g)
    return out


def by_label(groups: list[Group], page: bool = False) -> list[Group]:
    """One group for each label, in order of first appearance: what many children fold to."""
    out: dict[str, Group] = {}
    for g in groups:
        out[g[0]] = _repeated(out[g[0]], g, page) if g[0] in out else g
    return list(out.values())


def align(a: list[Group], b: list[Group], page: bool = False) -> list[Group]:
    """One expression for both: a longest common label sequence is merged, the rest becomes optional."""
    if a == b and not page:
        return a
    if max(len(a), len(b)) > WIDE:
        x, y = ({g[0]: g for g in by_label(side, page)} for side in (a, b))
        both = [[k, _both(x[k][1], y[k][1]), _inner(x[k], y[k], page)] if k in y else _optional(x[k]) for k in x]
        return both + [_optional(y[k]) for k in y if k not in x]
    x, y = [g[0] for g in a], [g[0] for g in b]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out: list[Group] = []
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append([x[i], _both(a[i][1], b[j][1]), _inner(a[i], b[j], page)])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return fold(out + [_optional(g) for g in a[i:] + b[j:]], page)


def mark_of(text: str, path: str) -> int:
    """A block of text at its place, as a number."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def expression(html: str) -> list[Group]:
    """The folded expression of one page; marks of text are [number, length]."""
    top: list[Group] = []
    open_groups = [top]
    for kind, what, path in blocks(html):
        if kind == "<":
            g = [what, "", []]
            open_groups[-1].append(g)
            open_groups.append(g[2] if len(open_groups) <= DEPTH else open_groups[-1])
        elif kind == ">":
            done = open_groups.pop()
            if done is not open_groups[-1]:
                done[:] = fold(done, True)
                if len(done) > WIDE:
                    done[:] = by_label(done, True)
        else:
            open_groups[-1].append(["#", "", [[mark_of(what, path), len(what)]]])
    return fold(top, True)


def template(wrapper: list[Group]) -> list[tuple[int, str, int]]:
    """(mark, holder's path, length) of the text that the wrapper has as it is, in groups without which no page is."""
    found: list[tuple[int, str, int]] = []

    def visit(groups: list[Group], path: str, level: int) -> None:
        for sign, flags, inner in groups:
            if "?" in flags or "*" in flags:
                continue
            if sign == "#":
                found.extend((mark, holder(path), size) for mark, size in inner)
            elif not dead(name_of(sign)):
                visit(inner, f"{path}/{sign}" if level < DEPTH else path, level + 1)

    visit(wrapper, "", 0)
    return found


def holder(path: str) -> str:
    """The group that directly holds a text: that of a heading, paragraph or list item is its parent."""
    return path.rsplit("/", 1)[0] if name_of(path.rsplit("/", 1)[-1]) in HEADS | {"li", "blockquote", "pre"} else path


def content_kind(wrapper: list[Group]) -> str | None:
    """Whether an article, else a main element, is among the wrapper's live groups."""
    seen = set()
    todo = list(wrapper)
    while todo:
        sign, _, inner = todo.pop()
        name = name_of(sign)
        if sign == "#" or dead(name):
            continue
        if name == "article":
            return "article"
        if name == "main" or name.endswith("*"):
            seen.add("main")
        todo += inner
    return "main" if seen else None


def content(html: str, marker: str) -> list[tuple[int, str, str]]:
    """(mark, path, text) of the blocks in the content region; ``marker`` is the kind of its element, or a path."""
    out, inside = [], 0
    for kind, what, path in blocks(html):
        if kind == "#":
            if inside if marker in ("article", "main") else not marker or f"{path}/".startswith(marker + "/"):
                out.append((mark_of(what, path), path, what))
        else:
            name = name_of(what)
            if name == marker or marker == "main" and name.endswith("*"):
                inside += 1 if kind == "<" else -1
    return out


def main_text(html: str, marker: str, known: frozenset[int] = frozenset()) -> str:
    """Text of the content region; where no element marks it, without the host's template, but with its headings."""
    got = content(html, marker)
    if marker not in ("article", "main") and any(mark not in known for mark, _, _ in got):
        got = [x for x in got if x[0] not in known or name_of(x[1].rsplit("/", 1)[-1]) in HEADS - {"p"}]
    return "\n".join(text for _, _, text in got)


def masses(html: str) -> dict[str, int]:
    """Characters of live text by the path of what holds it."""
    out: dict[str, int] = {}
    for kind, what, path in blocks(html):
        if kind == "#":
            at = holder(path)
            out[at] = out.get(at, 0) + len(what)
    return out


def page_text(html: str, marker: str, known: frozenset[int] = frozenset()) -> str:
    """By the host's wrapper; a page that lacks the wrapper's content groups is its own wrapper."""
    text = main_text(html, marker, known)
    if not text and html.strip():
        weight = masses(html)
        own = content_kind(expression(html)) or (min(weight, key=lambda p: (-weight[p], p)) if weight else "")
        if own != marker:
            text = main_text(html, own)
    return text


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, marker, template): one union-free expression a host, what marks its content, and marks of its template text. pages: (host, html)."""

    def shapes(batch: pa.RecordBatch) -> pa.RecordBatch:
        made, weigh = [], []
        for h in batch.column("html").to_pylist():
            e = expression(h or "")
            made.append(json.dumps(e, separators=(",", ":")))
            weigh.append([] if content_kind(e) else [{"path": p, "size": s} for p, s in masses(h or "").items()])
        kind = pa.list_(pa.struct([("path", pa.string()), ("size", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string()), pa.array(weigh, kind)], names=["host", "shape", "mass"])

    shaped = cut(arrow_stage(pages.select("host", "html"), shapes, "host string, shape string, mass array<struct<path:string,size:bigint>>"))
    distinct = shaped.groupBy("host", "shape").agg(F.count("*").alias("pages"))
    counted = distinct.groupBy("host").agg(F.count("*").alias("n"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, out = None, None, []

        def rows() -> pa.RecordBatch:
            host, part, shape = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(part, pa.int64()), pa.array(shape, pa.string())], names=["host", "part", "shape"])

        for batch in batches:
            for host, part, shape in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "shape")), strict=True):
                e = json.loads(shape)
                if (host, part) != held:
                    if held is not None:
                        out.append((*held, json.dumps(now, separators=(",", ":"))))
                    held, now = (host, part), e
                else:
                    now = align(now, e)
            if out:
                yield rows()
        if held is not None:
            out.append((*held, json.dumps(now, separators=(",", ":"))))
            yield rows()

    dealt = distinct.join(counted, "host").select("host", F.pmod(F.xxhash64("shape"), F.ceil(F.col("n") / GROUP)).alias("part"), "shape")
    kind = "host string, part bigint, shape string"
    first = in_batches(dealt.repartition("host", "part").sortWithinPartitions("host", "part", "shape"), merge, kind)
    whole, parts = first, counted.agg(F.coalesce(F.max(F.ceil(F.col("n") / GROUP)), F.lit(1))).first()[0]
    while parts > 1:
        fewer = whole.select("host", F.floor(F.col("part") / FAN).alias("part"), "shape")
        whole, parts = in_batches(fewer.repartition("host", "part").sortWithinPartitions("host", "part", "shape"), merge, kind), -(-parts // FAN)

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, marks, fixed = [], [], []
        for shape, n in zip(batch.column("shape").to_pylist(), batch.column("n").to_pylist(), strict=True):
            e = json.loads(shape)
            same = template(e) if n > 1 else []
            kinds.append(content_kind(e))
            marks.append(sorted({mark for mark, _, _ in same}))
            fixed.append([{"path": path, "size": size} for _, path, size in same])
        return pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), pa.array(kinds, pa.string()), pa.array(marks, pa.list_(pa.int64())), pa.array(fixed, pa.list_(pa.struct([("path", pa.string()), ("size", pa.int64())])))], names=["host", "wrapper", "kind", "template", "fixed"])

    known = cut(arrow_stage(whole.join(counted, "host").select("host", "shape", "n"), read, "host string, wrapper string, kind string, template array<bigint>, fixed array<struct<path:string,size:bigint>>"))
    # Of hosts without article or main element: text by path, less what is template.
    weight = shaped.where(F.size("mass") > 0).select("host", F.explode("mass").alias("m")).groupBy("host", "m.path").agg(F.sum("m.size").alias("size"))
    pages_of = shaped.where(F.size("mass") > 0).groupBy("host").agg(F.count("*").alias("pages"))
    fixed = known.where("kind is null").select("host", F.explode("fixed").alias("f")).groupBy("host", "f.path").agg(F.sum("f.size").alias("fixed")).join(pages_of, "host")
    net = weight.join(fixed, ["host", "path"], "left").withColumn("net", F.col("size") - F.coalesce(F.col("fixed") * F.col("pages"), F.lit(0)))
    heaviest = net.groupBy("host").agg(F.min_by("path", F.struct(-F.col("net"), "path")).alias("path"))
    return known.join(heaviest, "host", "left").select("host", "wrapper", F.coalesce("kind", "path", F.lit("")).alias("marker"), "template")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Every row of ``pages`` without ``html``, and with text and n_chars."""
    carried = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    hosted = pages.select(*[F.col(f"`{c}`") for c in carried], host_of(F.col(url)).alias("__host"), F.coalesce(html, F.lit("")).alias("__html"))
    known = cut(wrappers(hosted.select(F.col("__host").alias("host"), F.col("__html").alias("html"))).drop("wrapper"))
    small = known.agg(F.coalesce(F.sum(F.length("host") + F.length("marker") + 8 * F.size("template") + 48), F.lit(0))).first()[0] <= BROADCAST_BYTES
    marks = known.select(F.col("host").alias("__host"), F.col("marker").alias("__marker"), F.col("template").alias("__template"))
    met = hosted.join(F.broadcast(marks) if small else marks, "__host", "left")
    schema = ", ".join(f"`{c}` {hosted.schema[c].dataType.simpleString()}" for c in carried) + ", text string, n_chars bigint"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [page_text(h, m or "", frozenset(t or ())) for h, m, t in zip(*(batch.column(c).to_pylist() for c in ("__html", "__marker", "__template")), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(got, pa.string()), pa.array([len(g) for g in got], pa.int64())], names=[*carried, "text", "n_chars"])

    return arrow_stage(met.select(*carried, "__html", "__marker", "__template"), run, schema)
