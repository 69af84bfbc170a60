"""Operator 5: main text of web pages by wrappers inferred from pages of one host.

A page is read as a stream of start tags (with their class, id and role), end tags and texts; comments, scripts and
styles fall away and inline tags join their texts. The stream is kept as nested lists, so an element's tokens are
aligned only with those of the element at its place. A wrapper is a union-free regular expression over such streams:
elements in sequence, each once or repeated (+), needed or optional (?), and text slots that hold either the one text
that all pages have there or free text.

Two wrappers are merged by aligning their element sequences (longest common subsequence of labels): aligned elements
merge in turn, equal neighbours become one repeated element, an element without a partner becomes optional, and
differing texts a free slot. Merging is associative enough to be done per task and then per host: every task folds its
pages into one wrapper a host, and only those are gathered, in two steps (host and salt, then host), so that a host
with a third of all pages costs one row a task.

Content is what the wrapper's text slots hold: in a main element all of them, else the free and repeated ones, not the
texts that the wrapper has as constants over MIN_PAGES pages or more while other slots are free. Some elements never are content by
their tag (nav, header, footer, aside, form, ..). An article or main element is the main one; without, on hosts of
MIN_PAGES pages or more, the wrapper's innermost element with SHARE of all free text, and on smaller ones what class
words name. Words of class, id and role (sidebar, notice, ..) only raise a doubt. Inside the main element the wrapper
settles it on hosts of MIN_PAGES pages or more: an element with free or repeated slots that aren't links is content,
less its texts that are links, unless it is named an advert or comments. The words decide on smaller hosts (but an
element named the head of something stays, as it may hold the title and the lead), outside a main element, and where they'd leave nothing they are passed over. An element that holds an article isn't doubted.

A null or empty page has an empty text, a null url is a host of its own; pages that repeat, and ties between alignments
(the first of the two sequences goes first), have no bearing on which texts are found. Elements nested deeper than DEPTH
keep their texts in order, as part of the element at that depth.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.staging import materialise, tables

MIN_PAGES = 8
#: Elements in a repeated group at most; longer ones stay sequences.
GROUP = 4
#: Elements nested deeper than this give their texts and elements to the one at this depth, those that drop or name a part of the page at twice this depth.
DEPTH = 64
#: The share of a host's free text that the part of the page with the article has at least.
SHARE = 0.7
#: The most cells of an alignment's table.
CELLS = 1 << 18
SALTS = 16
#: Wrappers above this are joined by host instead of being broadcast.
BROADCAST_BYTES = 64 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+))")

# HTML element names by their role.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "xmp", "iframe", "svg", "annotation", "object", "canvas", "audio", "video"}
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|$)", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "maction", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics"}
DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head", "fieldset", "option", "input", "map", "frameset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = ("article", "main")
#: Elements whose id names a place in the text and not a part of the page.
ANCHORS = {"p", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figure", "table"}
# Words of class, id and role attributes that mark what isn't the article, and what is.
NOT_CONTENT = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pagination", "popup", "promo", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets"}
#: Of these, what names the head of a page, but inside an article that of the article.
HEADS = {"banner", "header", "masthead"}
#: Of these, what is free text by its nature, so that no wrapper can tell it from an article.
NEVER = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "disqus", "promo", "reply", "replies", "respond", "sponsor", "sponsored"}
CONTENT = {"article", "articlebody", "content", "entry", "main", "post", "story"}


def label(tag: str, attributes: str) -> tuple[str, bool, int, bool]:
    """The token of a start tag, whether it drops its element, whether its words cast doubt on it (1: outside an article only), and whether it names the main element."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
    marks = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
    words = set(re.findall(r"[a-z]+", marks))
    main = tag in MAIN or found.get("role") == "main" or bool(words & CONTENT)
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "")
    dropped = tag in DROPPED or hidden
    named = " ".join(found.get(k, "") for k in ("class", "role")).lower() if tag in ANCHORS else marks
    doubts = set(re.findall(r"[a-z]+", named)) & NOT_CONTENT if tag not in HEADINGS else set()
    doubted = (2 if doubts - HEADS else 1) if doubts else 0
    classes = ".".join(sorted(set(re.sub(r"\d+", "0", marks).split())))
    return f"{tag}.{classes}" if classes else tag, dropped, doubted, main and not dropped and (not doubted or tag in MAIN)


class Element:
    __slots__ = ("depth", "doubted", "dropped", "kids", "label", "main", "tag")

    def __init__(self, tag: str, label: str = "", dropped: bool = False, doubted: int = 0, main: bool = False) -> None:
        self.tag, self.label, self.dropped, self.doubted, self.main = tag, label or tag, dropped, doubted, main
        self.kids: list[Element | str] = []
        self.depth = 0

    def holds_main(self) -> bool:
        """Whether an article that isn't doubted itself lies inside."""
        return any(isinstance(k, Element) and not k.dropped and (k.tag in MAIN and not k.doubted or k.holds_main()) for k in self.kids)


class Link(str):
    """A block text that is all links."""

    __slots__ = ()


def parse(page: str | None) -> Element:
    """The page as nested elements and block texts; texts are decoded, their white space made one space."""
    root = Element("html")
    stack, words, at, link, plain = [root], [], 0, False, False
    page = page or ""

    def flush() -> None:
        nonlocal plain
        if words:
            if block := " ".join(html.unescape("".join(words)).split()):
                stack[-1].kids.append(block if plain else Link(block))
            words.clear()
        plain = False

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        end, tag, attributes, text = m.groups()
        if text is not None:
            words.append(text)
            plain = plain or not link and any(c.isalnum() for c in (html.unescape(text) if "&" in text else text))
        elif tag:
            tag = tag.lower()
            if not end and tag in RAW and not attributes.rstrip().endswith("/"):
                close = RAW_END[tag].search(page, at)  # nothing else is read as a tag inside
                at = close.end() if close else len(page)
            elif tag in INLINE:
                if tag in ("br", "img"):
                    words.append(" ")
                elif tag == "a":
                    link = not end and "href" in attributes.lower()
            else:
                flush()
                if end:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == tag:
                            del stack[k:]
                            break
                elif tag in VOID:
                    continue
                elif tag not in ("html", "body"):
                    if tag == "p" or tag in HEADINGS:  # an open paragraph ends here
                        if stack[-1].tag == "p":
                            stack.pop()
                    elif tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
                        near = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}[tag]
                        while stack[-1].tag in (*near, "p") and len(stack) > 1:
                            stack.pop()
                    elif stack[-1].tag == "p":
                        stack.pop()
                    element = Element(tag, *label(tag, attributes))
                    depth = stack[-1].depth
                    if depth < DEPTH or (depth < 2 * DEPTH and (element.dropped or element.doubted or element.main)):
                        stack[-1].kids.append(element)
                        element.depth = depth + 1
                    else:  # nested too deep: what is in it belongs to the element around it
                        element.kids, element.depth = stack[-1].kids, depth
                    stack.append(element)
    flush()
    for e in descendants(root):
        if e.doubted and e.tag not in MAIN and e.holds_main():
            e.doubted = 0
    return root


def descendants(e: Element) -> Iterator[Element]:
    todo = [e]
    while todo:
        e = todo.pop()
        todo += [k for k in e.kids if isinstance(k, Element)]
        yield e


# A wrapper is [label, repeated, optional, pages, text, kids, characters]: text None for an element, "" for a free slot.


def wrapper_of(e: Element) -> list:
    kids: list[list] = []
    for k in e.kids:
        kids.append(["#a" if isinstance(k, Link) else "#", False, False, 1, k, [], len(k)] if isinstance(k, str) else wrapper_of(k))
    return [f"-{e.label}" if e.dropped else e.label, False, False, 1, None, collapsed(kids), 0]


def collapsed(kids: list[list]) -> list[list]:
    """Equal neighbours as one repeated element, and runs of up to GROUP elements that recur as one repeated group."""
    single: list[list] = []
    for k in kids:
        if single and single[-1][0] == k[0]:
            single[-1] = merge(single[-1], k, same_page=True)
            single[-1][1] = True
        else:
            single.append(k)
    out: list[list] = []
    for k in single:
        out.append(k)
        for n in range(2, GROUP + 1):
            unit = out[-n:]
            name = "(" + " ".join(x[0] for x in unit) + ")"
            if len(out) > n and out[-n - 1][0] == name:
                out[-n - 1 :] = [merge(out[-n - 1], [name, True, False, unit[0][3], None, unit, 0], same_page=True)]
                break
            if len(out) >= 2 * n and [x[0] for x in out[-2 * n : -n]] == [x[0] for x in unit]:
                pair = [merge(x, y, same_page=True) for x, y in zip(out[-2 * n : -n], unit)]
                out[-2 * n :] = [[name, True, False, unit[0][3], None, pair, 0]]
                break
    return out


def merge(a: list, b: list, same_page: bool = False) -> list:
    """The wrapper of all that a or b is a wrapper of."""
    pages = max(a[3], b[3]) if same_page else a[3] + b[3]
    text = a[4] if a[4] == b[4] else ""
    return [a[0], a[1] or b[1], a[2] or b[2], pages, text, aligned(a[5], b[5], same_page), a[6] + b[6]]


def aligned(a: list[list], b: list[list], same_page: bool) -> list[list]:
    if [k[0] for k in a] == [k[0] for k in b]:
        return [merge(x, y, same_page) for x, y in zip(a, b)]
    if len(a) * len(b) > CELLS:
        return collapsed(beside(a, b, same_page))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out: list[list] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append([*a[i][:2], True, *a[i][3:]])
            i += 1
        else:
            out.append([*b[j][:2], True, *b[j][3:]])
            j += 1
    return collapsed(out)


def beside(a: list[list], b: list[list], same_page: bool) -> list[list]:
    """As aligned(), each element of a with the next of its label in b that isn't used up; for sequences too long for a table."""
    places: dict[str, list[int]] = {}
    for j, k in enumerate(b):
        places.setdefault(k[0], []).append(j)
    out: list[list] = []
    at = 0
    for k in a:
        own = places.get(k[0], [])
        n = bisect_left(own, at)
        if n == len(own):
            out.append([*k[:2], True, *k[3:]])
        else:
            out += [[*x[:2], True, *x[3:]] for x in b[at : own[n]]]
            out.append(merge(k, b[own[n]], same_page))
            at = own[n] + 1
    return out + [[*x[:2], True, *x[3:]] for x in b[at:]]


def expression(w: list) -> str:
    """The wrapper as a regular expression, for people."""
    if w[4] is not None:
        inner = "#text" if w[4] == "" else json.dumps(w[4], ensure_ascii=False)
    else:
        inner = "".join(map(expression, w[5]))
        tag = w[0].lstrip("-")
        inner = inner if w[0][0] == "(" else f"<{tag}>{inner}</{tag.split('.')[0]}>"
    return f"({inner}){'+' if w[1] else ''}{'?' if w[2] else ''}" if w[1] or w[2] else inner


def constants(wrapper: list | None, least: int = MIN_PAGES) -> set[tuple[str, str]]:
    """(path, text) of the slots that hold one text on `least` pages or more, if the wrapper has free slots as well."""
    fixed: set[tuple[str, str]] = set()
    free = False

    def walk(w: list, path: str) -> None:
        nonlocal free
        here = path if w[0][0] == "(" else f"{path}/{w[0].lstrip('-')}"
        if w[4] == "":
            free = free or w[3] >= least
        elif w[4] is not None and w[3] >= least:
            fixed.add((path, w[4]))
        for k in w[5]:
            walk(k, here)

    if wrapper:
        walk(wrapper, "")
    return fixed if free else set()


def words_in(label: str) -> set[str]:
    return set(re.findall(r"[a-z]+", label.partition(".")[2]))


def verdicts(wrapper: list | None, least: int = MIN_PAGES) -> set[tuple[str, str | None]]:
    """constants(); with None as text the paths of elements with doubtful words that have free or repeated slots other than links; and ("", path) of the part of the page with the article, where path "" tells that the wrapper decides, but not on such a part."""
    found: set[tuple[str, str | None]] = set(constants(wrapper, least))

    def walk(w: list, path: str) -> bool:
        here = path if w[0][0] == "(" else f"{path}/{w[0].lstrip('-')}"
        free = w[4] == "" and w[0] == "#"
        for k in w[5]:
            free = walk(k, here) or free
        own = words_in(w[0])
        if free and w[4] is None and own & NOT_CONTENT and not own & NEVER:
            found.add((here, None))
        return free

    if wrapper and wrapper[3] >= least:
        walk(wrapper, "")
        found.add(("", article_path(wrapper)))
    return found


def free_chars(w: list) -> int:
    """Characters in free slots that aren't links, outside dropped elements, adverts and comments."""
    if w[0][0] == "-" or words_in(w[0]) & NEVER:
        return 0
    return w[6] if w[4] == "" and w[0] == "#" else sum(map(free_chars, w[5]))


def article_path(wrapper: list) -> str:
    """The path of the innermost element with SHARE of the free text; paragraphs, headings and the page itself aren't such."""
    total, path, here, at = free_chars(wrapper), f"/{wrapper[0]}", "", wrapper
    while total:
        most = max(at[5], key=free_chars, default=None)
        if most is None or free_chars(most) < SHARE * total:
            break
        tag = most[0].partition(".")[0]
        if most[4] is not None or tag in HEADINGS or tag in ANCHORS:
            break
        at = most
        if most[0][0] != "(":
            path = here = f"{path}/{most[0]}"
    return here


def main_text(page: str | None, fixed: set[tuple[str, str | None]]) -> str:
    """The blocks of the page's main element, joined by two line feeds. fixed: verdicts() of the host's wrapper."""
    root = parse(page)
    decided = [text for path, text in fixed if not path]

    def blocks(e: Element, path: str, inside: bool, words: bool = True, links: bool = True) -> list[str]:
        here = f"{path}/{e.label}"
        out: list[str] = []
        for k in e.kids:
            if isinstance(k, str):
                if (inside or (here, k) not in fixed) and (links or not isinstance(k, Link)):
                    out.append(k)
            elif not k.dropped:
                if not (k.doubted > inside and words):
                    out += blocks(k, here, inside, words, links)
                elif inside and (f"{here}/{k.label}", None) in fixed:
                    out += blocks(k, here, inside, words, False)
            elif k.tag == "header" and e.main:  # an article's own header keeps its headings
                out += [x for h in k.kids if isinstance(h, Element) and h.tag in HEADINGS for x in blocks(h, f"{here}/{k.label}", inside, words)]
        return out

    def mains(e: Element, path: str, words: bool, wanted: Callable[[Element, str], bool]) -> list[tuple[Element, str]]:
        found: list[tuple[Element, str]] = []
        here = f"{path}/{e.label}"
        for k in e.kids:
            if isinstance(k, Element) and not k.dropped and not (k.doubted and words):
                found += [(k, here)] if wanted(k, here) else mains(k, here, words, wanted)
        return found

    # the elements that tell by their tag; else what the wrapper tells; else, on small hosts at once, what class words tell
    ways: list[tuple[bool, Callable[[Element, str], bool]]] = [(True, lambda k, _: k.main)]
    if decided:
        ways = [(True, lambda k, _: k.main and k.tag in MAIN), (False, lambda k, here: f"{here}/{k.label}" in decided), *ways]
    for words in (True, False):
        for inside, wanted in ways:
            chosen = [blocks(e, path, inside) for e, path in mains(root, "", words, wanted)]
            if any(chosen):
                break
        if not any(chosen):
            chosen = [blocks(root, "", False, words)]
        if any(chosen):
            break
    return "\n\n".join(x for c in chosen for x in c)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, n_pages and wrapper (JSON) of every host. pages: (host, html)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        part = 0
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                own = wrapper_of(parse(page))
                known[host] = merge(known[host], own) if host in known else own
            if len(known) > 20_000:  # bounds the task's memory
                yield rows(known, part)
                known, part = {}, part + 1
        if known:
            yield rows(known, part)

    def rows(known: dict[str, list], part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(known)), pa.array([hash_of(json.dumps(w)) % SALTS for w in known.values()], pa.int32()), pa.array([json.dumps(w) for w in known.values()])], ["host", "salt", "wrapper"])

    def hash_of(x: str) -> int:
        return sum(x.encode()[:: max(1, len(x) // 64)]) + len(x)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by host (and salt) -> one wrapper each."""
        at, own, salt = None, None, 0
        for batch in batches:
            for host, s, w in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "wrapper"))):
                if own is not None and (host, s) == at:
                    own = merge(own, json.loads(w))
                else:
                    if own is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([0], pa.int32()), pa.array([json.dumps(own)])], ["host", "salt", "wrapper"])
                    at, own = (host, s), json.loads(w)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([salt], pa.int32()), pa.array([json.dumps(own)])], ["host", "salt", "wrapper"])

    kinds = "host string, salt int, wrapper string"
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = pages.select("host", "html").mapInArrow(fold, kinds)
    part = part.repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(join, kinds)
    return part.repartition(n, "host").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(join, kinds).select("host", F.get_json_object("wrapper", "$[3]").cast("long").alias("n_pages"), "wrapper")


def extracted(pages: DataFrame, page_key: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """page_key, url, text and n_chars of every page. A null url counts as a host of its own, a null html as empty."""
    rows = pages.select(F.col(page_key).alias("page_id"), F.col(url).alias("url"), F.col(html_column).alias("html"), host_of(F.col(url)).alias("host"))
    found = materialise(infer_wrappers(rows), "wrappers")
    fixed = found.mapInArrow(fixed_rows, "host string, fixed string").where("fixed <> '[]'")
    size = fixed.agg(F.sum(F.length("fixed"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, set] = {}
        for batch in batches:
            out = []
            for page, fixed in zip(batch.column("html").to_pylist(), batch.column("fixed").to_pylist()):
                if fixed and fixed not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[fixed] = set(map(tuple, json.loads(fixed)))
                out.append(main_text(page, sets[fixed] if fixed else set()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if size <= BROADCAST_BYTES:
        both = rows.join(F.broadcast(fixed), "host", "left")
    else:
        salted = fixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return both.select("page_id", "url", "html", "fixed").mapInArrow(run, f"page_id {pages.schema[page_key].dataType.simpleString()}, url string, text string, n_chars long")


def fixed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [json.dumps(sorted(verdicts(json.loads(w)), key=lambda x: (x[0], x[1] is not None, x[1]))) for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], ["host", "fixed"])


def op5_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(tables(spark, sf_dir, "pages"))


QUERIES = {"op5_wrapper_extraction": op5_wrapper_extraction}
ORACLE_SQL: dict[str, str] = {}
