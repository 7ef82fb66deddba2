"""Main text by wrappers inferred from same-host token streams.

A page's stream of tags and texts is read once, with the ends that HTML leaves out, into a tree of block
elements and texts. A wrapper is a union-free regular expression over such streams: elements in order, each
with the expression of what it holds, text slots, and optional or repeated groups. A page is an expression
of its own once its repeats are folded: equal neighbours and neighbouring equal sequences of up to four
elements become one repeated group. Two expressions are aligned element by element along a longest common
subsequence: what matches is aligned in turn, what does not becomes optional, a slot whose texts differ
becomes data and one whose texts agree stays constant. A host's different pages are aligned in small batches
by hash, the batches' wrappers in further rounds, until each host has one; no host's pages are brought
together, and copies of a page count once.

The wrapper decides where the article is. Constant texts that every page has once are template, the rest is
data; the main node is the deepest container that holds at least `share` of the data. A page's text is what
it has in the main node; there nothing is deleted but elements that are never an article's (navigation,
forms, elements named as adverts and the like), whatever a host's pages share. A page that lacks the main
node, or whose main node is a plain container, is read from its own article, main or else by its own masses,
without template where other text is left.

Null or empty html gives an empty text; very long and malformed pages are read in linear time; repeated
rows repeat; texts tied between slots keep page order; null urls form one host; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import pickle
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, ship, tidy, written

# Quotes matter only after "=", and an open tag ends at the next "<" at the latest; possessive repeats never look back.
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b[^<>]*+>.*?(?:</\1\s*+>|$)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>]*+)|[\"'])*+)>?|<[!?][^>]*+>?",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Names that tell about something else in the element or page.
ABOUT = re.compile("(?:has|no|with|without)[_-]").match
# Block elements, containers, elements never part of an article, and words that name such.
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article body div html main section td".split())
NEVER = frozenset("nav footer aside form button select textarea iframe svg head title menu dialog object audio video canvas".split())
NEVER_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer menu nav navbar "
    "navigation newsletter notice pagination popup promo related share sidebar signup social sponsored subscribe widget".split()
)
HEADER = "header"
DEPTH = 64  # deeper elements fold into the one they lie in
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag ends open elements of these kinds, up to an element of the second group.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
SCOPE = frozenset("html body article aside blockquote button dd div dl dt fieldset figure footer form header li main nav ol section table td th ul".split())


def named(attrs: str) -> set[str]:
    if "=" not in attrs:
        return set()
    names = " ".join(m[1] or m[2] or m[3] or "" for m in NAMES.finditer(attrs)).lower()
    return {w for name in names.split() if not ABOUT(name) for w in re.split("[_-]+", name) if w}


def blocks(page: str, root: list | None = None) -> list[tuple[str, str]]:
    """(slot, text) of every block that may be an article's, in page order.

    With a root, its list gets the page's tree: a block element is [label, list], a text (slot, text).
    """
    out: list[tuple[str, str]] = []
    now: list[str] = []
    # Open elements: tag, slot of the nearest block element, whether its text never counts, 1 in a header and 2 in its title.
    stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]
    inside = [root]  # the tree's lists that the open elements add to
    at = 0

    def close():
        s = " ".join("".join(now).split())
        now.clear()
        if s and not stack[-1][2] and stack[-1][3] != 1:
            out.append((stack[-1][1], s))
            if root is not None:
                inside[-1].append((stack[-1][1], s))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            now.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if tag in BLOCKS or (k and stack[k][2] and not stack[k - 1][2]):
                close()
            if not k:
                continue
            if tag in BLOCKS or stack[k][2] or not any(e[0] in BLOCKS for e in stack[k + 1 :]):
                del stack[k:], inside[k:]
            else:
                # An inline element ends alone, the blocks in it go on.
                del stack[k], inside[k]
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            elif tag == "br":
                now.append(" ")
            continue
        names = named(m[4])
        never = stack[-1][2] or tag in NEVER or (tag not in ("html", "body") and not names.isdisjoint(NEVER_WORDS))
        block = tag in BLOCKS
        if block or (never and not stack[-1][2]):
            close()
        if block:
            kinds, stop = ENDS.get(tag, (None, None))
            for k in range(len(stack) - 1, 0, -1):
                if kinds and stack[k][0] in kinds:
                    del stack[k:], inside[k:]
                elif stack[k][0] == "p" and tag != "option":
                    del stack[k:], inside[k:]
                    break
                elif stack[k][0] in (stop or SCOPE):
                    break
            never = stack[-1][2] or tag in NEVER or (tag not in ("html", "body") and not names.isdisjoint(NEVER_WORDS))
        _, slot, _, head = stack[-1]
        inside.append(inside[-1])
        if block and len(stack) < DEPTH:
            words = sorted(w for w in names if w.isalpha() and len(w) < 20)
            slot = f"{slot}/{'.'.join([tag, *words])}"
            if root is not None:
                inside[-1] = []
                inside[-2].append([slot[slot.rindex("/") + 1 :], inside[-1]])
            if tag == HEADER or HEADER in names:
                head = max(head, 1)
            if tag == "h1" and head == 1 and ("/article" in slot or "/main" in slot):
                head = 2
        stack.append((tag, slot, never, head))
    if at < len(page):
        now.append(entities.unescape(page[at:]))
    close()
    return out


def text_key(slot: str, text: str) -> int:
    k = xxhash.xxh64_intdigest(f"{slot}\0{text}".encode("utf-8", "surrogatepass"))
    return k - (1 << 64) if k >> 63 else k


def prefixes(slot: str) -> list[str]:
    """Containers that hold a slot, from the outermost."""
    parts = slot.split("/")[1:]
    return ["/" + "/".join(parts[: i + 1]) for i, p in enumerate(parts) if p.split(".")[0] in CONTAINERS]


def host_of(url):
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^\w+://([^/?#]*)", 1)


TEXT = "#"
# An item of an expression: label, optional, repeated, body, data, pages, texts. The body of a text is its hash, or
# None where texts differ; that of an element or group the items it holds. `data` counts the characters below,
# `texts` are the places of its blocks in a page and empty in a wrapper.


def group(items: list) -> list:
    """Items that repeat together, as one."""
    return ["(" + " ".join(i[0] for i in items) + ")", False, False, items, sum(i[4] for i in items), 1, [k for i in items for k in i[6]]]


def merged(a: list, b: list, repeat: bool = False) -> list:
    """One item of two with equal labels: of one page's neighbours if they repeat, else of two streams."""
    body = (a[3] if a[3] == b[3] else None) if a[0] == TEXT else aligned(a[3], b[3])
    return [a[0], a[1] or b[1], a[2] or b[2] or repeat, body, a[4] + b[4], a[5] if repeat else a[5] + b[5], a[6] + b[6]]


def key(item: list) -> tuple:
    """What makes two items alike: the label, and the labels directly below."""
    return (item[0], *(() if item[0] == TEXT else (i[0] for i in item[3])))


def maybe(item: list) -> list:
    return [item[0], True, *item[2:]]


def folded(items: list, most: int = 4) -> list:
    """Neighbouring alike items, and neighbouring sequences of up to `most` with equal labels, as repeated ones."""
    for width in range(1, most + 1):
        out: list = []
        for item in items:
            out.append(item)
            if width == 1:
                if len(out) > 1 and key(out[-2]) == key(item):
                    out[-2:] = [merged(out[-2], item, True)]
                continue
            tail = [i[0] for i in out[-width:]]
            if len(out) > width and len(tail) == width and out[-width - 1][0] == "(" + " ".join(tail) + ")":
                out[-width - 1 :] = [merged(out[-width - 1], group(out[-width:]), True)]
            elif len(out) >= 2 * width and [i[0] for i in out[-2 * width : -width]] == tail:
                out[-2 * width :] = [merged(group(out[-2 * width : -width]), group(out[-width:]), True)]
        items = out
    return items


def grouped(items: list, labels: dict[str, int]) -> list:
    """Items with every sequence that the other side has as a group put into one."""
    if not labels:
        return items
    out: list = []
    for item in items:
        out.append(item)
        for label, width in labels.items():
            if len(out) >= width and "(" + " ".join(i[0] for i in out[-width:]) + ")" == label:
                out[-width:] = [group(out[-width:])]
                if len(out) > 1 and out[-2][0] == label:
                    out[-2:] = [merged(out[-2], out[-1], True)]
                break
    return out


def matches(x: list[tuple], y: list[tuple], most: int = 250_000) -> list[tuple[int, int]]:
    """Places of a common subsequence of labels, the longest in which alike items count double.

    Of very long lists those of some common subsequence of alike items, in linear time.
    """
    lo = 0
    while lo < len(x) and lo < len(y) and x[lo] == y[lo]:
        lo += 1
    n, m = len(x) - lo, len(y) - lo
    while n and m and x[lo + n - 1] == y[lo + m - 1]:
        n, m = n - 1, m - 1
    out = [(i, i) for i in range(lo)]
    if n * m > most:
        at: dict[tuple, list[int]] = {}
        for j in range(lo + m - 1, lo - 1, -1):
            at.setdefault(y[j], []).append(j)
        last = lo - 1
        for i in range(lo, lo + n):
            places = at.get(x[i], [])
            while places and places[-1] <= last:
                places.pop()
            if places:
                last = places.pop()
                out.append((i, last))
    elif n and m:
        worth = lambda i, j: 0 if x[lo + i][0] != y[lo + j][0] else 2 if x[lo + i] == y[lo + j] else 1
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                w = worth(i, j)
                best[i][j] = max(best[i + 1][j], best[i][j + 1], w and best[i + 1][j + 1] + w)
        i = j = 0
        while i < n and j < m:
            if (w := worth(i, j)) and best[i][j] == best[i + 1][j + 1] + w:
                out.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return out + [(lo + n + k, lo + m + k) for k in range(len(x) - lo - n)]


def aligned(x: list, y: list) -> list:
    """The expression of two: common items aligned, the others optional, in an order that keeps both."""
    x, y = (grouped(a, {i[0]: i[0].count(" ") + 1 for i in b if i[0][0] == "("}) for a, b in ((x, y), (y, x)))
    out, i, j = [], 0, 0
    for p, q in [*matches([key(a) for a in x], [key(b) for b in y]), (len(x), len(y))]:
        out += [maybe(a) for a in x[i:p]] + [maybe(b) for b in y[j:q]]
        if p < len(x):
            out.append(merged(x[p], y[q]))
        i, j = p + 1, q + 1
    return out


def expression(page: str) -> tuple[list, list[tuple[str, str]]]:
    """(a page as an expression, its blocks): elements that hold no text are left out."""

    def of(nodes):
        nonlocal at
        out = []
        for n in nodes:
            if isinstance(n, tuple):
                out.append([TEXT, False, False, text_key(*n), len(n[1]), 1, [at]])
                at += 1
            elif body := of(n[1]):
                out.append([n[0], False, False, body, sum(i[4] for i in body), 1, [k for i in body for k in i[6]]])
        return folded(out)

    root: list = []
    at = 0
    found = blocks(page, root)
    return of(root), found


def bare(items: list) -> list:
    """An expression without places."""
    return [[*i[:3], i[3] if i[0] == TEXT else bare(i[3]), i[4], i[5], []] for i in items]


def fits(slot: list, item: list) -> bool:
    if slot[0] != item[0] or (item[2] and not slot[2]):
        return False
    return slot[3] in (None, item[3]) if item[0] == TEXT else accepts(slot[3], item[3])


def accepts(wrapper: list, page: list) -> bool:
    """Whether a page's expression is one of the wrapper's: every item has its place in order, and only optional places are empty."""
    page = grouped(page, {i[0]: i[0].count(" ") + 1 for i in wrapper if i[0][0] == "("})
    at = 0
    for item in page:
        while at < len(wrapper) and not fits(wrapper[at], item):
            if not wrapper[at][1]:
                return False
            at += 1
        if at == len(wrapper):
            return False
        at += 1
    return all(w[1] for w in wrapper[at:])


def written_out(items: list) -> str:
    """The expression as text: `#` is a slot of data, `"` a constant text, `?` optional, `+` repeated."""

    def one(i):
        what = ("#" if i[3] is None else '"') if i[0] == TEXT else f"({written_out(i[3])})" if i[0][0] == "(" else f"{i[0]}({written_out(i[3])})"
        return what + "+" * i[2] + "?" * i[1]

    return " ".join(map(one, items))


def decided(items: list, pages: int, share: float = 0.6) -> tuple[list | None, list[int]]:
    """(guide to the main node, hashes of template texts) of a wrapper of so many pages.

    The guide has, from the root down, the keys of the items beside each other and the place of the one that
    leads to the main node; a page is matched along it. One page shows neither: nothing was aligned.
    """
    if pages < 2:
        return None, []
    template: list[int] = []
    mass: list[tuple] = []

    def walk(items, path, certain):
        total = 0
        for k, (label, optional, repeated, body, data, seen, _) in enumerate(items):
            sure = certain and not optional and not repeated
            if label == TEXT:
                if sure and seen == pages and body is not None:
                    template.append(body)
                else:
                    total += data
            else:
                own = walk(body, [*path, (items, k)], sure)
                if label.split(".")[0] in CONTAINERS:
                    mass.append((own, [*path, (items, k)]))
                total += own
        return total

    whole = walk(items, [], True)
    # Nodes with over half of the data lie within each other, so the longest path is the deepest.
    path = max((p for n, p in mass if n >= share * whole > 0), key=len, default=None)
    return path and [([key(i) for i in beside], k) for beside, k in path], template


def followed(guide: list, items: list) -> list | None:
    """The item of a page's expression that a guide leads to; None if the page lacks it."""
    item = None
    for keys, k in guide:
        items = grouped(items, {c[0]: c[0].count(" ") + 1 for c in keys if c[0][0] == "("})
        item = next((items[q] for p, q in matches(keys, [key(i) for i in items]) if p == k), None)
        if item is None:
            return None
        items = item[3]
    return item


def streams(pages: DataFrame) -> DataFrame:
    """(host, page, stream): the expression of every different page; `page` is its hash."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                found = [pickle.dumps(bare(expression(p.as_py() or "")[0]), 5) for p in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.binary())], ["host", "page", "stream"])

    hosted = pages.select(host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return hosted.select("host", "html", F.xxhash64("html").alias("page")).mapInArrow(
        tidy(run), "host string, page long, stream binary"
    ).dropDuplicates(["host", "page"])


def wrappers(pages: DataFrame, batch: int = 64) -> DataFrame:
    """(host, pages, stream, expression, guide, template): one wrapper a host; stream and guide are pickled."""
    ship(pages.sparkSession)
    left = written(streams(pages).withColumn("pages", F.lit(1).cast("long")), "html-streams", compression="zstd")

    def align(table):
        order = table.column("page").to_numpy().argsort(kind="stable").tolist()
        whole, n = None, 0
        for k in order:
            one = pickle.loads(table.column("stream")[k].as_py())
            whole = one if whole is None else aligned(whole, one)
            n += table.column("pages")[k].as_py()
        return pa.table(
            {"host": [table.column("host")[0].as_py()], "page": [table.column("page")[order[0]].as_py()], "stream": [pickle.dumps(whole, 5)], "pages": [n]},
            schema=pa.schema([("host", pa.string()), ("page", pa.int64()), ("stream", pa.binary()), ("pages", pa.int64())]),
        )

    while True:
        deals = left.groupBy("host").agg(F.ceil(F.count("*") / batch).alias("deals"))
        dealt = left.join(deals, "host").withColumn("deal", F.pmod(F.xxhash64(F.col("page"), F.lit("deal")), F.col("deals")))
        left = written(
            dealt.select("host", "page", "stream", "pages", "deal").groupBy("host", "deal").applyInArrow(align, "host string, page long, stream binary, pages long"),
            "html-wrappers", compression="zstd",
        )
        if left.groupBy("host").count().where("count > 1").isEmpty():
            break

    def decide(batches):
        for b in batches:
            rows = [(pickle.loads(s.as_py()), n.as_py()) for s, n in zip(b.column(1), b.column(2))]
            found = [decided(*r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(2), b.column(1), pa.array([written_out(r[0]) for r in rows], pa.string()),
                    pa.array([f[0] and pickle.dumps(f[0], 5) for f in found], pa.binary()), pa.array([f[1] for f in found], pa.list_(pa.int64())),
                ],
                ["host", "pages", "stream", "expression", "guide", "template"],
            )

    return left.select("host", "stream", "pages").mapInArrow(
        tidy(decide), "host string, pages long, stream binary, expression string, guide binary, template array<long>"
    )


def within(slot: str, node: str) -> bool:
    return slot.startswith(node) and slot[len(node) : len(node) + 1] in ("", "/")


def own_main(found: list[tuple[str, str]], share: float = 0.6) -> str:
    """The main node of one page: its article or main with most text, else the deepest container with most of it."""
    mass: dict[str, int] = {}
    for slot, text in found:
        for p in prefixes(slot):
            mass[p] = mass.get(p, 0) + len(text)
    whole = sum(len(t) for _, t in found)
    for tag in ("article", "main"):
        best = max((p for p in mass if p.rsplit("/", 1)[-1].split(".")[0] == tag), key=lambda p: (mass[p], -len(p)), default=None)
        if best and 3 * mass[best] >= whole:
            return best
    return max((p for p in mass if mass[p] >= share * whole), key=len, default="")


def main_text(page: str | None, guide: list | None, template: frozenset[int]) -> str:
    items, found = expression(page or "")
    item = followed(guide, items) if guide else None
    inside = [found[k] for k in sorted(item[6])] if item else []
    if not inside or not any(re.match(r"(article|main)\b", keys[k][0]) for keys, k in guide):
        # Within a plain container, or without the main node, a page's own article or main goes first.
        data = [(s, t) for s, t in found if text_key(s, t) not in template] if template and not inside else found
        own = own_main(inside or data or found)
        inside = [b for b in inside or data or found if within(b[0], own)]
    return "\n\n".join(t for _, t in inside)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    known = written(wrappers(pages).select("host", "guide", "template"), "html-hosts")

    def run(batches):
        last, guide, template = None, None, frozenset()
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                texts = []
                for page, packed, constant in zip(*(part.column(c).to_pylist() for c in (2, 3, 4))):
                    if (packed, constant) != last:
                        last, guide, template = (packed, constant), packed and pickle.loads(packed), frozenset(constant or ())
                    texts.append(main_text(page, guide, template))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        host_of(F.col("url")).alias("host"),
    )
    return keyed.join(known, "host", "left").select("page_id", "url", "html", "guide", "template").mapInArrow(
        tidy(run), "page_id long, url string, text string, n_chars long"
    )


def query(spark, sf_dir):
    return extract(load(spark, sf_dir, "pages"))
