"""Main text of web pages by wrappers inferred per host: union-free regular expressions over elements.

A page is read as nested elements; an element's label is its tag with classes and id (digits as one), its path the labels
from the page's root. The content model of a path is a union-free expression over the labels of its children, inferred
from all pages of the host:

1. Inside one element, neighbouring repeats of one label or of a group of labels become a repeated group, ``(a b)+``.
2. Children of the same path on another page are aligned with the model so far. Equal items meet; an item that only one
   side has, up to the nearest item that both have, becomes optional, ``a?``. Text is the slot ``#``.
3. A model that has grown beyond ``LONGEST`` items has no common order and becomes one repeated group of optional items.

Equal child lists of a host are counted once before alignment, and parts of a large host are aligned separately and then
with each other, so no task holds a host. The wrapper of a host is its paths with models and amounts of text and of
linked text. From it follow the content root, the path that holds the article, and the menus, repeated groups whose text
is nearly all links. A page's text is read along its wrapper: slots below the root, without menus and without elements
that are boilerplate by tag or by class. A page without its host's root is read from its own article or body.

Texts are aligned as well, where a page does not say itself what its article is: on hosts whose root is no article or main
element. A block is the text of an element that is not inline, up to the next such element. Where the root's model has a
container (a div, a section, a list) once or as an optional item, not in a repeated group, its blocks are counted by path
and text over the host's pages of different text, hashes only, with partial sums before the shuffle. A block that at least
``TEMPLATE_PAGES`` of them hold, and ``TEMPLATE_SHARE`` of those with its path, is constant. A container of which this
share is constant is the template's (a notice, an advert), and its constant blocks go; all other blocks are slots and are
returned. So headings, paragraphs and bylines of the root itself, items of repeated groups, and whatever stands inside an
article or main element, are never template, however often they recur. Where more than ``COPY_SHARE`` of the text would be
template, in a host or in the pages holding one block, they are copies of one text and nothing is taken out.

A word of a class, id or role, and a form, are weak signs: they never condemn html, body, main or an outermost article,
nor a path that holds most of the prose of the host's pages that have it, unless these pages have an article or main
elsewhere. A page that is left without text by weak signs is judged once more by its own prose alone.

Null or empty html: empty text. Null url: pages of one nameless host. Comments, scripts, styles and an unfinished tag at
the end hold no text. Unclosed and stray tags are tolerated; elements deeper than ``DEEPEST`` count as their ancestor at
that depth. Very long pages are read whole, a page being the unit of work. Repeated rows have equal results. ``extract`` reads the named columns only. Empty input: empty result.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import materialize

LONGEST, DEEPEST, PERIOD = 40, 40, 6
PARTS = 16
TEMPLATE_PAGES, TEMPLATE_SHARE, COPY_SHARE = 3, 0.9, 0.9

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*>"
    r"|<(?P<cut>/?[a-zA-Z!?][^<>]*)\Z|(?P<text>[^<]+|<)", re.S | re.I)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
# An opening tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("article section main body div ul ol table dl blockquote aside nav header footer form".split())
BOILERPLATE_TAGS = frozenset("head nav footer aside form button select option input label iframe svg canvas object "
                             "audio video dialog menu datalist fieldset map".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disqus footer gdpr menu modal nav navbar navigation newsletter notice notices notification pager "
    "pagination popup promo promoted promotion related reply replies respond share sharing sidebar social sponsor "
    "sponsored subscribe subscription toolbar widget widgets".split())
ROOT_TAGS = ("article", "main")
# Tags that are boilerplate only if they do not hold the page.
FORM_TAGS = frozenset(("form", "fieldset"))
PAGE_TAGS = frozenset(("html", "body", *ROOT_TAGS))
WEAK, STRONG = 1, 2


@lru_cache(maxsize=20_000)
def label_of(tag: str, attrs: str) -> tuple[str, int]:
    """(label, whether the element is boilerplate by itself: 0, WEAK or STRONG)."""
    names: dict[str, str] = {}
    for m in NAMED.finditer(attrs):
        names.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    classes = sorted(set(names.get("class", "").split()))
    role = names.get("role", "")
    own = tag + "".join(f".{c}" for c in classes) + (f"#{names['id']}" if names.get("id") else "")
    if words_in(role) & BOILERPLATE_WORDS:
        own += f"@{role}"
    sign = sign_of(tag, " ".join([*classes, names.get("id", ""), role]))
    return re.sub(r"[0-9]+", "0", own).replace("/", "_").replace(" ", "_"), sign


def words_in(names: str) -> set[str]:
    return set(re.split(r"[^a-z]+", names))


def sign_of(tag: str, names: str) -> int:
    if tag in BOILERPLATE_TAGS and tag not in FORM_TAGS:
        return STRONG
    return WEAK if tag in FORM_TAGS or words_in(names) & BOILERPLATE_WORDS else 0


def tag_of(path: str) -> str:
    return re.split(r"[.#@]", path.rpartition("/")[2])[0]


class Element:
    __slots__ = ("tag", "path", "sign", "bad", "strong", "children", "linked")

    def __init__(self, tag: str, path: str, sign: int, bad: bool, strong: bool, linked: bool):
        self.tag, self.path, self.sign, self.bad, self.strong = tag, path, sign, bad, strong
        self.linked, self.children = linked, []


def read(page: str, spared: frozenset[str] = frozenset()) -> Iterator[tuple[str, Element, str]]:
    """Events ("open" | "close" | "break" | "text", element, text) in page order; weak signs at ``spared`` do not count."""
    top = Element("", "", 0, False, False, False)
    stack = [top]

    def close(count: int) -> Iterator[tuple[str, Element, str]]:
        for _ in range(count):
            yield "close", stack.pop(), ""

    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            yield "text", stack[-1], m["text"]
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag == "br" or tag == "hr":
            yield "break", stack[-1], ""
            continue
        if tag in VOID:
            continue
        if m["close"]:
            for back in range(1, len(stack)):
                if stack[-back].tag == tag:
                    yield from close(back)
                    break
                if tag in INLINE and stack[-back].tag not in INLINE:
                    break
            continue
        ends = ENDS.get(tag) or (None if tag in INLINE else {"p"})
        if ends:
            for back in range(1, len(stack)):
                if stack[-back].tag in ends:
                    yield from close(back)
                    break
                if stack[-back].tag in CONTAINERS:
                    break
        if tag == "body" and any(e.tag == "head" for e in stack):
            while stack[-1].tag != "head":
                yield from close(1)
            yield from close(1)
        label, sign = label_of(tag, m["attrs"] or "")
        parent = stack[-1]
        if tag == "header" and not any(e.tag in ROOT_TAGS for e in stack):  # a page's header, not an article's
            sign = STRONG
        if tag in PAGE_TAGS and not (tag == "article" and any(e.tag == "article" for e in stack)):
            sign = 0
        path = parent.path if len(stack) > DEEPEST else f"{parent.path}/{label}"
        bad = parent.bad or sign == STRONG or (sign == WEAK and path not in spared)
        element = Element(tag, path, sign, bad, parent.strong or sign == STRONG, parent.linked or tag == "a")
        parent.children.append(label)
        stack.append(element)
        yield "open", element, ""
    yield from close(len(stack) - 1)


class Judged:
    """Prose of one page, and of it below each path with a weak sign: {path: (below the path, of the page)}."""

    def __init__(self) -> None:
        self.prose, self.mains, self.marks = 0, 0, 0
        self.open: list[tuple[int, int]] = []
        self.above: list[Element] = []
        self.below: dict[str, int] = {}
        self.apart: dict[str, int] = {}

    def see(self, event: str, element: Element, words: int) -> None:
        if event == "text":
            if not element.linked and not element.strong:
                self.prose += words
        elif event == "open":
            main = element.tag in ROOT_TAGS and not element.sign and not self.marks and not element.bad
            self.mains += main
            self.marks += element.sign > 0
            self.above.append(element)
            # Articles in the open elements are around this one; others are apart from it.
            self.open.append((self.prose, main + (self.open[-1][1] if self.open else 0)))
        elif event == "close":
            self.above.pop()
            before, around = self.open.pop()
            self.marks -= element.sign > 0
            if element.sign == WEAK and not any(e.path == element.path for e in self.above):
                self.below[element.path] = self.below.get(element.path, 0) + self.prose - before
                self.apart[element.path] = max(self.apart.get(element.path, -1), -around)

    def paths(self) -> dict[str, tuple[int, int]]:
        return {path: (0 if self.mains + self.apart[path] > 0 else n, self.prose) for path, n in self.below.items()}


def most(below: int, around: int) -> bool:
    return 2 * below > around


# Content models: lists of items, an item being a label or group with marks ``+`` and ``?`` behind it.


def bare(item: str) -> str:
    return item.rstrip("+?")


def marked(item: str, *others: str) -> str:
    marks = "".join(x[len(bare(x)):] for x in (item, *others))
    return bare(item) + "+" * ("+" in marks) + "?" * ("?" in marks)


def collapsed(labels: list[str]) -> list[str]:
    """Neighbouring repeats of up to PERIOD items as repeated groups, shortest periods first."""
    for period in range(1, PERIOD + 1):
        out: list[str] = []
        at = 0
        while at < len(labels):
            group, end = labels[at:at + period], at + period
            while len(group) == period and [bare(x) for x in labels[end:end + period]] == [bare(x) for x in group]:
                end += period
            if end > at + period:
                out.append(marked(group[0], "+") if period == 1 else f"({' '.join(group)})+")
                at = end
            else:
                out.append(labels[at])
                at += 1
        labels = out
    return labels


def free(model: list[str]) -> bool:
    return len(model) == 1 and model[0].startswith("(*")


def freed(items: list[str]) -> list[str]:
    """One repeated group of optional items, for children without a common order."""
    names: dict[str, None] = {}
    for item in items:
        for name in re.findall(r"[^\s()*+?]+", item):
            names[name] = None
    return ["(* " + " ".join(f"{n}?" for n in sorted(names)) + ")+"]


def aligned(model: list[str], other: list[str]) -> list[str]:
    """The model extended so that it also covers ``other``."""
    if model == other:
        return model
    if free(model) or free(other):
        return freed(model + other)
    out: list[str] = []
    i = j = 0
    while i < len(model) and j < len(other):
        if bare(model[i]) == bare(other[j]):
            out.append(marked(model[i], other[j]))
            i, j = i + 1, j + 1
            continue
        skip_other = next((k for k in range(j, len(other)) if bare(other[k]) == bare(model[i])), None)
        skip_model = next((k for k in range(i, len(model)) if bare(model[k]) == bare(other[j])), None)
        if skip_other is not None and (skip_model is None or skip_other - j <= skip_model - i):
            out += [marked(x, "?") for x in other[j:skip_other]]
            j = skip_other
        elif skip_model is not None:
            out += [marked(x, "?") for x in model[i:skip_model]]
            i = skip_model
        else:
            out += [marked(model[i], "?"), marked(other[j], "?")]
            i, j = i + 1, j + 1
    out += [marked(x, "?") for x in model[i:] + other[j:]]
    out = collapsed(out)
    return out if len(out) <= LONGEST else freed(out)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


_OBSERVED = "host string, path string, model string, n long, words long, linked long, below long, around long"
_AMOUNTS = ("n", "words", "linked", "below", "around")


def observed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Child lists per host and path with the pages, words and linked words they have, counted per batch.

    The prose below a path with a weak sign and that of its pages stand at the first child list that a page has for it.
    """
    for batch in batches:
        counts: dict[tuple[str, str, str], list[int]] = {}
        for host, page in zip(batch["host"].tolist(), batch["html"].tolist()):
            amounts: dict[int, list[int]] = {}
            judged, first = Judged(), {}
            for event, element, text in read(page or ""):
                n = len(text.split())
                judged.see(event, element, n)
                if event == "text" and not text.isspace():
                    element.children.append("#")
                    own = amounts.setdefault(id(element), [0, 0])
                    own[0] += n
                    own[1] += n * element.linked
                elif event == "close":
                    items = collapsed(element.children)
                    model = " ; ".join(items if len(items) <= LONGEST else freed(items))
                    own = amounts.pop(id(element), [0, 0])
                    total = counts.setdefault((host, element.path, model), [0] * len(_AMOUNTS))
                    total[0] += 1
                    total[1] += own[0]
                    total[2] += own[1]
                    first.setdefault(element.path, total)
            for path, (below_it, of_page) in judged.paths().items():
                first[path][3] += below_it
                first[path][4] += of_page
        yield pd.DataFrame([(*k, *v) for k, v in counts.items()], columns=[c.split()[0] for c in _OBSERVED.split(", ")])


def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by host and path: one row per host and path, its models aligned one after the other."""
    key, model, total = None, [], [0] * len(_AMOUNTS)
    for batch in batches:
        out = []
        for host, path, text, *amounts in batch.itertuples(index=False):
            items = [x for x in text.split(" ; ") if x]
            if (host, path) != key:
                if key is not None:
                    out.append((*key, " ; ".join(model), *total))
                key, model, total = (host, path), items, [0] * len(_AMOUNTS)
            else:
                model = aligned(model, items)
            total = [a + b for a, b in zip(total, amounts)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OBSERVED.split(", ")])
    if key is not None:
        yield pd.DataFrame([(*key, " ; ".join(model), *total)], columns=[c.split()[0] for c in _OBSERVED.split(", ")])


def models(pages: DataFrame) -> DataFrame:
    """Rows (host, path, model, and the sums of ``_AMOUNTS``): the content model of every path of every host."""
    seen = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(observed, _OBSERVED)
    counted = seen.groupBy("host", "path", "model").agg(*[F.sum(c).alias(c) for c in _AMOUNTS])
    part = F.pmod(F.xxhash64("model"), F.lit(PARTS))
    first = counted.repartition("host", "path", part).sortWithinPartitions("host", "path", "model") \
        .mapInPandas(folded, _OBSERVED)
    return first.repartition("host", "path").sortWithinPartitions("host", "path", "model").mapInPandas(folded, _OBSERVED)


def below(path: str, root: str) -> bool:
    return path == root or path.startswith(root + "/")


def plan_of(paths: list[tuple]) -> dict:
    """The content root, the menus and the spared paths of a host, from rows (path, model, and ``_AMOUNTS``)."""
    words: dict[str, list[int]] = {}
    for path, _, _, n, linked, *_ in paths:
        at = path
        while at:
            own = words.setdefault(at, [0, 0])
            own[0] += n
            own[1] += linked
            at = at.rpartition("/")[0]
    menus = sorted(
        path for path, model, *_ in paths
        if "+" in model and words.get(path, [0, 0])[0] and words[path][1] >= 0.8 * words[path][0]
        and tag_of(path) in ("ul", "ol", "div", "p", "table", "section", "dl"))
    spared = sorted(path for path, *_, held, around in paths if most(held, around))

    def usable(path: str) -> bool:
        at, articles = "", 0
        for part in path.strip("/").split("/"):
            at, tag = f"{at}/{part}", tag_of(part)
            sign = sign_of(tag, part[len(tag):])
            if tag in PAGE_TAGS and not (tag == "article" and articles):
                sign = 0
            articles += tag == "article"
            if sign == STRONG or (sign == WEAK and at not in spared):
                return False
        return not any(below(path, m) for m in menus)

    def planned(root: str) -> dict:
        repeated = set()
        for path, model, *_ in paths:
            if path == root:
                for item in model.split(" ; "):
                    if "+" in item[len(item.rstrip("+?")):]:
                        repeated |= set(re.findall(r"[^\s()*+?]+", item))
        return {"root": root, "menus": menus, "spared": spared, "repeated": sorted(repeated)}

    prose = {p: w[0] - w[1] for p, w in words.items() if usable(p)}
    for tag in ROOT_TAGS:
        tagged = [p for p in prose if tag_of(p) == tag and prose[p] > 0]
        if tagged:
            # Where articles are nested, the outer one is the root.
            return planned(min(tagged, key=lambda p: (-prose[p], len(p), p)))
    root = next((p for p in sorted(prose, key=lambda p: (len(p), p)) if tag_of(p) == "body"), "")
    while True:  # go down while one child of the root holds nearly all of its prose in elements of its own
        inner = [p for p in prose if p.rpartition("/")[0] == root
                 and tag_of(p) in CONTAINERS]
        best = max(inner, key=lambda p: (prose[p], p), default=None)
        if not best or not root or prose[best] < 0.7 * max(prose[root], 1):
            return planned(root)
        root = best


def wrappers(paths: DataFrame) -> DataFrame:
    """One row per host: its plan as JSON. A host's paths are its distinct element paths, not its pages."""
    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, rows = None, []
        for batch in batches:
            out = []
            for name, *row in batch.itertuples(index=False):
                if name != host:
                    if host is not None:
                        out.append((host, json.dumps(plan_of(rows))))
                    host, rows = name, []
                rows.append(tuple(row))
            yield pd.DataFrame(out, columns=["host", "plan"])
        if host is not None:
            yield pd.DataFrame([(host, json.dumps(plan_of(rows)))], columns=["host", "plan"])

    return paths.repartition("host").sortWithinPartitions("host", "path").mapInPandas(plan, "host string, plan string")


@lru_cache(maxsize=1_000)
def _plan(text: str) -> tuple[str, frozenset[str], frozenset[str]]:
    plan = json.loads(text)
    return plan["root"], frozenset(plan["menus"]), frozenset(plan["spared"])


_NO_PLAN = ("", frozenset(), frozenset())


Block = tuple[str, str]  # path, text


def read_blocks(page: str, root: str, menus: frozenset[str], spared: frozenset[str]) -> list[Block]:
    """The blocks below the root; if weak signs leave nothing of the page, its own prose decides which of them count."""
    blocks = below_root(page, root, menus, spared)
    if blocks:
        return blocks
    judged = Judged()
    for event, element, piece in read(page):
        judged.see(event, element, len(piece.split()))
    own = frozenset(path for path, amounts in judged.paths().items() if most(*amounts))
    return below_root(page, root, menus, spared | own) if own - spared else blocks


@lru_cache(maxsize=20_000)
def block_path(path: str) -> str:
    while tag_of(path) in INLINE:
        path = path.rpartition("/")[0]
    return path


def below_root(page: str, root: str, menus: frozenset[str], spared: frozenset[str]) -> list[Block]:
    """The blocks below the root, or of the page's own article or body. Inline elements and line breaks do not end a block."""
    regions = ("root", "article", "main", "body", "page")
    held: dict[str, list[str]] = {r: [] for r in regions}
    blocks: dict[str, list[Block]] = {r: [] for r in regions}
    inside = {"root": 0, "menu": 0, "article": 0, "main": 0, "body": 0, "page": 1}
    at = ""

    def flush() -> None:
        for region, texts in held.items():
            if texts:
                block = " ".join(html_lib.unescape("".join(texts)).split())
                if block:
                    blocks[region].append((at, block))
                texts.clear()

    for event, element, text in read(page, spared):
        if event == "text":
            if element.bad or inside["menu"]:
                continue
            at = block_path(element.path)
            for region, texts in held.items():
                if inside[region]:
                    texts.append(text)
            continue
        if event == "break":
            for texts in held.values():
                if texts:
                    texts.append(" ")
            continue
        if element.tag not in INLINE:
            flush()
        step = 1 if event == "open" else -1
        inside["root"] += step * (bool(root) and element.path == root)
        inside["menu"] += step * (element.path in menus)
        if element.tag in ROOT_TAGS or element.tag == "body":
            inside[element.tag] += step
    flush()
    return next((blocks[r] for r in regions if blocks[r]), [])


def key_of(*parts: str) -> int:
    return int.from_bytes(blake2b("\n".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(maxsize=1_000)
def _template_places(text: str) -> tuple[str, frozenset[str]] | None:
    """The root, and the labels of its repeated groups, if blocks below it may be template at all."""
    plan = json.loads(text)
    held = any(tag_of(part) in ROOT_TAGS for part in plan["root"].strip("/").split("/"))
    return None if held or not plan["root"] else (plan["root"], frozenset(plan["repeated"]))


def container_of(path: str, root: str, repeated: frozenset[str]) -> str | None:
    """The container directly below the root that holds a block, if it is no item of a repeated group and the block lies
    in no article or main element."""
    if not path.startswith(root + "/"):
        return None
    steps = path[len(root) + 1:].split("/")
    if steps[0] in repeated or tag_of(steps[0]) not in CONTAINERS or any(tag_of(x) in ROOT_TAGS for x in steps):
        return None
    return f"{root}/{steps[0]}"


_COUNTED = "signature long, words long, blocks array<struct<container: long, path: long, key: long, words: long>>"


def block_keys(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of each page that may hold template: a hash of its text, its words, and its different blocks in containers; one
    without a key for each of their paths. Other pages give null and are not read."""
    for pages, plans in batches:
        rows = []
        for page, plan in zip(pages.tolist(), plans.tolist()):
            places = _template_places(plan) if plan else None
            if places is None:
                rows.append((None, None, None))
                continue
            blocks = read_blocks(page or "", *_plan(plan))
            found = {b: (c, len(b[1].split())) for b in blocks if (c := container_of(b[0], *places))}
            paths = {b[0]: key_of(c) for b, (c, _) in found.items()}
            rows.append((
                key_of(*[part for b in blocks for part in b]), sum(len(b[1].split()) for b in blocks),
                [{"container": c, "path": key_of(path), "key": None, "words": 0} for path, c in paths.items()]
                + [{"container": key_of(c), "path": key_of(b[0]), "key": key_of(*b), "words": n}
                   for b, (c, n) in found.items()]))
        frame = pd.DataFrame(rows, columns=["signature", "words", "blocks"])
        yield frame.astype({"signature": "Int64", "words": "Int64"})


def templates(hosted: DataFrame) -> DataFrame:
    """One row per host with a template: the keys of its blocks, as text. Pages of equal text are one page."""
    found = hosted.select("host", F.pandas_udf(block_keys, _COUNTED)("html", "plan").alias("b")).select("host", "b.*")
    pages = found.where(F.col("signature").isNotNull()).groupBy("host", "signature").agg(
        F.first("words").alias("of_page"), F.first("blocks").alias("blocks"))
    counted = materialize(
        pages.select("host", "signature", "of_page", F.explode_outer("blocks").alias("b"))
        .groupBy("host", "b.container", "b.path", "b.key")
        .agg(F.count("*").alias("n"), F.sum("b.words").alias("words"), F.sum("of_page").alias("around")))
    blocks, paths = counted.where("key is not null"), counted.where("key is null and path is not null")
    constant = (
        blocks.where(F.col("n") >= TEMPLATE_PAGES)
        .join(paths.select("host", "path", F.col("n").alias("of_path")), ["host", "path"])
        .where((F.col("n") >= TEMPLATE_SHARE * F.col("of_path")) & (F.col("words") <= COPY_SHARE * F.col("around")))
    )
    whole = blocks.groupBy("host", "container").agg(F.sum("n").alias("of_all"))
    of_template = (
        constant.groupBy("host", "container").agg(F.sum("n").alias("n")).join(whole, ["host", "container"])
        .where(F.col("n") >= TEMPLATE_SHARE * F.col("of_all")).select("host", "container")
    )
    equal = (
        constant.join(of_template, ["host", "container"], "left_semi").groupBy("host")
        .agg(F.sum("words").alias("words"), F.concat_ws(",", F.sort_array(F.collect_set("key").cast("array<string>")))
             .alias("template"))
    )
    size = pages.groupBy("host").agg(F.sum("of_page").alias("around"))
    return equal.join(size, "host").where(F.col("words") <= COPY_SHARE * F.col("around")).select("host", "template")


@lru_cache(maxsize=1_000)
def _keys(text: str) -> frozenset[int]:
    return frozenset(map(int, text.split(",")))


def main_text(page: str, plan: str | None, template: str | None) -> str:
    """The text of the page's slots."""
    blocks = read_blocks(page, *(_plan(plan) if plan else _NO_PLAN))
    known = _keys(template) if template else frozenset()
    return " ".join(b[1] for b in blocks if not known or key_of(*b) not in known)


def page_text(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in batches:
        yield pd.Series([main_text(page or "", plan, template)
                         for page, plan, template in zip(*[c.tolist() for c in columns])], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars and the wrapper's root."""
    plans = materialize(wrappers(models(pages)))
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(plans, "host", "left")
    joined = hosted.join(materialize(templates(hosted)), "host", "left")
    return joined.select("page_id", "url", F.pandas_udf(page_text, "string")("html", "plan", "template").alias("text"),
                         F.get_json_object("plan", "$.root").alias("root")) \
        .withColumn("n_chars", F.length("text").cast("long"))
