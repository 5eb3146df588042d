"""Main text of web pages through wrappers inferred from pages of the same host.

A page becomes a stream of text blocks, each under the path of its containers. Streams of one host
are aligned one after the other into a union-free regular expression over such paths: what repeats
becomes a repeated group, what only some pages have an optional group, and text that differs a slot;
text that is the same on every page is the template's. A page is then read through its host's
wrapper: blocks of the template and of menus, adverts and the like go, slots and optional groups
stay; where most of what is left stands in an article, what stands beside it goes too.
"""

from __future__ import annotations

import html as markup
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import by_arrow, stored

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is never text of the page.
SILENT = frozenset(
    "applet audio button canvas datalist embed head iframe input map meter noembed noframes "
    "noscript object option progress script select style svg template textarea title video".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and words in class or id that mark what stands around an article.
AROUND = frozenset("nav aside footer form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
HINTS = frozenset(
    "ad ads adbox adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies disclaimer discussion disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification pager "
    "pagination popup promo promoted promotion recommended related replies reply respond responses "
    "share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar "
    "widget widgets".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Parts of a name that say what a layout has or lacks, not what an element is.
STATES = frozenset("no not non has have having with without is hide layout page content main".split())
_SPACES = re.compile(r"\s+")


#: Of these, names that page builders also give to the parts of a text.
PARTS = frozenset("widget widgets".split())


def _hint(token: str, inside: bool) -> set[str]:
    """The words of a class or an id that name what stands around an article, as ``ad`` or
    ``site-footer``; ``no-sidebar`` and ``has-header`` name a layout."""
    words = set(re.split(r"[^a-z0-9]+", token))
    return set() if words & STATES else words & (HINTS if inside else HINTS | {"header"})


def _around(tag: str, attributes: str, inside: bool) -> bool | set[str]:
    """Whether an element stands around an article; ``inside`` one, a header belongs to it.

    A set of words: only its class or id says so, by these. Ids of headings and sections inside an article are made
    of their titles and say nothing.
    """
    if tag in AROUND or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    named: set[str] = set()
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", _ATTRIBUTE.sub(" ", attributes), re.I):
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id"):
            title = name == "id" and inside and re.fullmatch("h[1-6]|section", tag)
            if not title:
                named = named.union(*[_hint(token, inside) for token in value.split()])
    return named or False


def blocks(page: str | None) -> list[tuple[str, str, str]]:
    """(path, place, text) of every block with text, in page order.

    ``place`` is ``article``, ``main``, ``page`` or ``around``. A closing tag without its opening
    one is passed over, an unclosed element ends with its parent, a paragraph with the next block.
    A class or id does not put an element around the article that holds most of the page's text;
    elements of one path that are only called widgets count together.
    """
    page = page or ""
    out: list[tuple[str, str, str, list[int]]] = []
    stack: list[tuple[str, str, bool, int]] = []  # tag, name in the path, stands around, number if named so
    sizes: list[int] = []  # of the elements named so
    parts: dict[str, int] = {}  # number of the elements of one path that are called widgets
    text: list[str] = []
    at = 0
    silent: list[tuple[str, int]] = []  # tag, open elements when it began

    def flush() -> None:
        joined = _SPACES.sub(" ", markup.unescape("".join(text))).strip()
        text.clear()
        if joined:
            tags = [x[0] for x in stack]
            place = ("around" if any(x[2] for x in stack) else "article" if "article" in tags
                     else "main" if "main" in tags else "page")
            named = sorted({x[3] for x in stack if x[3] >= 0})
            for i in named:
                sizes[i] += len(joined)
            out.append(("/".join(x[1] for x in stack), place, joined, named))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            if not silent:
                text.append(page[at:])
            break
        if not silent:
            text.append(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if not tag:
            continue
        if tag in SILENT:
            if tag in RAW and not closing:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                text.append(" ")
            elif closing:
                if any(t == tag for t, _ in silent):  # with all that was opened inside it
                    while (last := silent.pop())[0] != tag:
                        pass
                    del stack[last[1]:]
            elif tag not in VOID and not attributes.rstrip().endswith("/"):
                if tag == "option" and silent and silent[-1][0] == tag:
                    silent.pop()
                silent.append((tag, len(stack)))
            continue
        if silent and (tag in ("body", "article", "main")
                       or tag in BLOCKS and all(t == "option" for t, _ in silent)):
            silent.clear()  # an unclosed head or button, or an option outside a list, ends here
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            if any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
                while silent and silent[-1][1] > len(stack):
                    silent.pop()  # its parent ended
            continue
        if silent:
            pass
        elif stack and stack[-1][0] == "p" or stack and stack[-1][0] == tag and tag in (
                "li", "dt", "dd", "td", "th", "tr"):
            stack.pop()
        if tag == "hr":
            continue
        inside = any(x[0] in ("article", "main") for x in stack)
        marks = "".join("." + "".join(v) for n, *v in _ATTRIBUTE.findall(attributes)
                        if n.lower() == "class")
        around = _around(tag, attributes, inside)
        number = -1
        if isinstance(around, set):
            number = len(sizes)
            if around <= PARTS:
                number = parts.setdefault("/".join([*[x[1] for x in stack], tag + marks]), number)
            if number == len(sizes):
                sizes.append(0)
        stack.append((tag, tag + marks, around is True, number))
    flush()
    total = sum(len(t) for _, _, t, _ in out)
    return [(path, "around" if any(2 * sizes[i] <= total for i in named) else place, t)
            for path, place, t, named in out]


# A wrapper is a list of groups [path, repeated, optional, text or None, pages].

def groups(found: list[tuple[str, str, str]]) -> list[list]:
    """One page's blocks as a wrapper of its own: neighbours of one path are a repeated group."""
    from xxhash import xxh3_64_hexdigest

    out: list[list] = []
    for path, _, text in found:
        digest = xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass"))
        if out and out[-1][0] == path:
            out[-1][1] = True
            out[-1][3] = xxh3_64_hexdigest((out[-1][3] + digest).encode())
        else:
            out.append([path, False, False, digest, 1])
    return out


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common sequence of ``x`` and ``y``.

    A row of the usual table is one integer with a bit per place of ``y``: 0 where the length grows.
    Pages of twenty thousand groups take 50 MB and a second instead of gigabytes and minutes.
    """
    places: dict[str, int] = {}
    for j, path in enumerate(y):
        places[path] = places.get(path, 0) | 1 << j
    everywhere = (1 << len(y)) - 1
    rows = [everywhere]
    for path in x:
        row = rows[-1]
        met = row & places.get(path, 0)
        rows.append(((row + met) | (row - met)) & everywhere)
    found, i, j = [], len(x), len(y)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif not rows[i - 1] >> j - 1 & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def matched(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Places of the longest common sequence of paths."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [(i, i) for i in range(len(a))]
    low = 0
    while low < min(len(a), len(b)) and a[low][0] == b[low][0]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high][0] == b[-1 - high][0]:
        high += 1
    x, y = ([g[0] for g in side[low:len(side) - high]] for side in (a, b))
    middle = [(low + i, low + j) for i, j in common(x, y)]
    return [*[(k, k) for k in range(low)], *middle,
            *[(len(a) - k, len(b) - k) for k in range(high, 0, -1)]]


def aligned(a: list[list] | None, b: list[list]) -> list[list]:
    """The wrapper of both: unmatched groups become optional, differing texts slots."""
    if a is None:
        return b
    out, i, j = [], 0, 0
    for p, q in [*matched(a, b), (len(a), len(b))]:
        out += [[g[0], g[1], True, *g[3:]] for g in [*a[i:p], *b[j:q]]]
        if p < len(a):
            x, y = a[p], b[q]
            out.append([x[0], x[1] or y[1], x[2] or y[2], x[3] if x[3] == y[3] else None, x[4] + y[4]])
        i, j = p + 1, q + 1
    return out


def main_text(page: str | None, wrapper: list[list] | None = None, pages: int = 0) -> str:
    """The main text of ``page``, read through the ``wrapper`` of its host's distinct ``pages``.

    A group is the template's if most of these pages, two at least, have it with one text. Of what
    is left, an article, or else main, is the text alone if it holds most of it.
    """
    found = blocks(page)
    own = groups(found)
    template = {i for i, w in matched(own, wrapper or []) if wrapper[w][3] and wrapper[w][4] > 1 and 2 * wrapper[w][4] > pages}
    left, group, before = [], -1, None
    for path, place, text in found:
        group, before = group + (path != before), path
        if place != "around" and group not in template:
            left.append((place, text))
    total = sum(len(t) for _, t in left)
    for places in (("article",), ("article", "main")):
        chosen = [t for place, t in left if place in places]
        if 2 * sum(map(len, chosen)) > total:
            return "\n".join(chosen)
    return "\n".join(t for _, t in left)


def host(url: Column) -> Column:
    """Lower-case host of an address, empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, salts: int = 64) -> DataFrame:
    """(``host``, ``wrapper`` as JSON, ``pages``) inferred from all distinct pages of every host.

    Pages whose blocks have equal paths and texts count as one, pages without text as none. Each task aligns its own pages first, so that a host that holds a third of all pages sends one
    small wrapper per task; these meet in ``salts`` groups and then in one.
    """

    def read(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_hexdigest

        for batch in batches:
            found = [(h, json.dumps(w)) for h, w in (
                (h, groups(blocks(page))) for h, page in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True)) if w]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in found], pa.string()),
                 pa.array([xxh3_128_hexdigest(w.encode("utf-8", "surrogatepass")) for _, w in found], pa.string()),
                 pa.array([w for _, w in found], pa.string())], ["host", "digest", "wrapper"])

    def infer(batches):
        import pyarrow as pa

        known: dict[str, list] = {}
        counts: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(known), pa.string()),
                 pa.array([json.dumps(w) for w in known.values()], pa.string()),
                 pa.array([counts.pop(h) for h in known], pa.int64())], ["host", "wrapper", "pages"])

        for batch in batches:
            for name, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known[name] = aligned(known.get(name), json.loads(wrapper))
                counts[name] = counts.get(name, 0) + 1
            if len(known) > 5_000:
                yield out()
                known.clear()
        yield out()

    def merge(frame):
        import pandas as pd

        whole = None
        for wrapper in sorted(frame["wrapper"]):
            whole = aligned(whole, json.loads(wrapper))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(whole)],
                             "pages": [int(frame["pages"].sum())]})

    kind = "host string, wrapper string, pages long"
    found = by_arrow(pages.select(host(F.col("url")).alias("host"), "html"), read,
                     "host string, digest string, wrapper string")
    distinct = found.groupBy("host", "digest").agg(F.min("wrapper").alias("wrapper"))
    partial = by_arrow(distinct.select("host", "wrapper"), infer, kind)
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(salts)).alias("salt")
    return partial.groupBy("host", salt).applyInPandas(merge, kind).groupBy("host").applyInPandas(merge, kind)


def extract(pages: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``pages`` with the main ``text`` added.

    Needs ``url`` and ``html``; a column named ``text`` is replaced. Null and empty pages, and pages
    without text, give an empty string. Pages without an address share one host. A page alone on
    its host has no template, nor have pages that are all copies of one. An empty table gives an empty table.
    """
    kept = [c for c in columns or pages.columns if c != "text"]
    known = stored(wrappers(pages))
    joined = pages.select(*kept, host(F.col("url")).alias("__host"),
                          F.col("html").alias("__html")).join(
        known.toDF("__host", "__wrapper", "__pages"), "__host", "left")

    def run(batches):
        import pyarrow as pa

        parsed: dict[str | None, list | None] = {}
        for batch in batches:
            texts = []
            for page, wrapper, n in zip(*(c.to_pylist() for c in batch.columns[len(kept):]), strict=True):
                if wrapper not in parsed:
                    if len(parsed) > 2_000:
                        parsed.clear()
                    parsed[wrapper] = json.loads(wrapper) if wrapper else None
                texts.append(main_text(page, parsed[wrapper], n or 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(texts, pa.string())], [*kept, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema)
    return by_arrow(joined.select(*kept, "__html", "__wrapper", "__pages"), run, f"{schema}, text string")
