"""Main text of web pages by differencing each with the page of the nearest URL.

A page becomes text lines, one per block. Within a host, pages sorted by path stand beside their
neighbours; of the one before and the one after, that with the longer common path is the
nearest. The two pages' lines are aligned by longest common subsequence, and shared lines (equal
in text and in whether a boilerplate element holds them) are deleted as template. Lines inside an article are protected from that (articles quote and repeat
each other). Of the lines that differencing leaves, those outside a marked article go, and those
of menus, headers, footers, side bars, forms, adverts, notices and reader comments, known by
their elements or class names: they may be a page's own, and a page alone on its host has no
other to differ from. Scripts, styles and titles are no text. Names never leave out html, body,
main or an article (but one within an article), nor "header" a box inside an article; a head left
open ends at the first body element or text.

Pages are dealt by ranges of (host, path), each range with the one page before and after it, so
every page meets its nearest neighbour in its host whatever the host's size. A page alone on its
host keeps all its lines.

Defined results: a NULL or empty page is empty, a NULL url has an empty host and path. Repeated
rows delete each other's lines outside articles; of neighbours equally near the one before is
taken. Very long pages are read in linear time however broken their tags are, and aligned in
linear space. All Unicode white space in a block, no-break spaces too, becomes one space. The
input's columns are carried as ``keep`` says, those named like a result give way, in any case of
letters. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridcast.llm.common import partitions, quoted, slices
from gridcast.llm.url_filter import url_parts

OFTEN = 512                     # a line in more places keeps its bits between steps
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)")
_PLAIN_REST = re.compile(r"""[^'"<>]*+(?:"[^"<>]*+"[^'"<>]*+|'[^'<>]*+'[^'"<>]*+)*+>""")
_STOPS = re.compile("[\"'>]")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp "
                    "small span strike strong sub sup time tt u var wbr".split())
_APART = frozenset("nav footer aside form header dialog menu button select svg head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES = frozenset("ad ads advert advertisement advertising sponsored promo cookie cookies consent notice banner sidebar "
                   "menu navbar navigation nav breadcrumb breadcrumbs footer header comment comments replies reply "
                   "share social related widget popup modal newsletter subscribe complementary contentinfo search".split())
_MAIN = frozenset(["article", "main"])


_WHOLE = frozenset(["html", "body"])           # never left out, whatever their names
_ASIDE = frozenset(["nav", "footer", "aside"])
_IN_HEAD = frozenset("head title meta link style script base noscript template".split())


class _Tags:
    """Where tags end: the first ``>`` outside quotes.

    What follows a quote or ``>`` met outside quotes does not depend on where the tag began, so it
    is worked out once for each: open tags and quotes cost no more than others.
    """

    def __init__(self, page: str):
        self.page, self.stops, self.known = page, None, {}

    def end(self, at: int) -> int:
        """The end of a tag whose name ends at ``at``; -1 if there is none."""
        if m := _PLAIN_REST.match(self.page, at):
            return m.end() - 1
        if self.stops is None:
            self.stops = [m.start() for m in _STOPS.finditer(self.page)]
        passed, found = [], -1
        while (i := bisect_left(self.stops, at)) < len(self.stops):
            stop = self.stops[i]
            if stop in self.known:
                found = self.known[stop]
                break
            passed.append(stop)
            if self.page[stop] == ">":
                found = stop
                break
            shut = self.page.find(self.page[stop], stop + 1)
            if shut < 0:
                break
            at = shut + 1
        self.known.update(dict.fromkeys(passed, found))
        return found


def _is_named(attributes: str, names: frozenset[str] = _NAMES) -> bool:
    if "=" not in attributes:
        return False
    return any(names.intersection(re.split(r"[^a-z0-9]+", (a or b or c).lower())) for a, b, c in _NAMED.findall(attributes))


def page_lines(page: str) -> list[tuple[str, bool]]:
    """``(text, in an article)`` of the blocks that no boilerplate element holds."""
    return [(text, inside) for text, inside, named in page_blocks(page) if not named]


def page_blocks(page: str) -> list[tuple[str, bool, bool]]:
    """``(text, in an article, in a boilerplate element)`` of all blocks.

    An article inside a boilerplate element counts; one in a nav, footer or aside, or one named
    like boilerplate itself, only where the page has no other.
    """
    lines = _lines(page, False)
    if not any(inside for _, inside, _ in lines) and re.search("<(?:article|main)", page, re.I):
        anywhere = _lines(page, True)
        if any(inside for _, inside, _ in anywhere):
            return anywhere
    return lines


def _lines(page: str, anywhere: bool) -> list[tuple[str, bool, bool]]:
    lines: list[tuple[str, bool, bool]] = []
    block: list[str] = []
    skipped, depth, main, articles = "", 0, 0, 0   # the boilerplate element passed over, its nesting, open articles
    at, end = 0, len(page)

    def close() -> None:
        text = " ".join(html.unescape("".join(block)).split())
        block.clear()
        if text:
            lines.append((text, main > 0 and not skipped, skipped != ""))

    tags = _Tags(page)
    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = stop if stop >= 0 else end
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        else:
            m = _TAG.match(page, at)
            shut = tags.end(m.end()) if m else -1
            if shut >= 0:
                tag, closing, attributes, at = m[2], m[1] == "/", page[m.end():shut], shut + 1
                stop = -1
            elif page.startswith(("!", "?"), at + 1):                  # a declaration
                stop = page.find(">", at + 1)
                at = stop + 1 if stop >= 0 else end
                continue
            else:
                stop = at + 1
        if stop >= 0:
            if skipped == "head" and not page[at:stop].isspace():
                skipped = ""                   # text ends a head left open
            block.append(page[at:stop])
            at = stop
            continue
        tag = tag.lower()
        if tag in _RAW and not closing:
            if skipped == "head" and tag not in _IN_HEAD:
                skipped = ""
            stop = _RAW[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if skipped == "head":
            if closing or tag in _IN_HEAD:
                skipped = "" if closing and tag in ("head", "html") else skipped
                continue
            skipped = ""                       # so does the first element of the body
        if skipped:
            if tag not in _INLINE:
                close()
            if tag in _MAIN and not closing and (anywhere or skipped not in _ASIDE and not _is_named(attributes)):
                skipped = ""                   # the article of a page inside, or after, such a box
            else:
                if tag == skipped:
                    depth += -1 if closing else 1
                if not depth:
                    skipped = ""
                continue
        if tag in _INLINE:
            continue
        close()
        if not closing and tag not in _VOID and not attributes.endswith("/"):
            if tag in _MAIN:
                if tag == "article" and articles and _is_named(attributes):
                    skipped, depth = tag, 1    # a reader's comment or an advert within the article
                else:
                    main, articles = main + 1, articles + (tag == "article")
            elif tag == "header" and main or tag in _WHOLE:
                pass
            elif tag in _APART or _is_named(attributes, _NAMES - {"header"} if main else _NAMES):
                skipped, depth = tag, 1
        elif closing and tag in _MAIN and main:
            main, articles = main - 1, max(articles - (tag == "article"), 0)
    close()
    return lines


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Exact in linear space: the sequences are halved where the best scores of both halves meet,
    and a row of scores is one long integer, so equal lines cost no more than others.
    """
    out: set[int] = set()
    todo = [(list(enumerate(a)), b)]
    while todo:
        x, y = todo.pop()
        known = set(y)
        x = [line for line in x if line[1] in known]
        known = {line for _, line in x}
        y = [line for line in y if line in known]
        low = 0
        while low < min(len(x), len(y)) and x[low][1] == y[low]:
            low += 1
        high = 0
        while high < min(len(x), len(y)) - low and x[-1 - high][1] == y[-1 - high]:
            high += 1
        out.update(i for i, _ in x[:low])
        out.update(i for i, _ in x[len(x) - high:])
        x, y = x[low:len(x) - high], y[low:len(y) - high]
        if len(x) == 1:
            out.update(i for i, line in x if line in y)
        elif x and y:
            middle = len(x) // 2
            head, tail = x[:middle], x[middle:]
            score = _scores([line for _, line in head], y)
            score = score + _scores([line for _, line in reversed(tail)], y[::-1])[::-1]
            cut = int(score.argmax())
            todo += [(head, y[:cut]), (tail, y[cut:])]
    return out


def _scores(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    often = {line: _bits(at, len(b)) for line, at in places.items() if len(at) > OFTEN}
    whole = row = (1 << len(b)) - 1
    for line in a:
        if line in places:
            hit = row & (often.get(line) or _bits(places[line], len(b)))
            row = ((row + hit) | (row - hit)) & whole
    ones = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(1 - ones.astype(np.int64))])


def _bits(places: list[int], n: int) -> int:
    if len(places) < 8:
        return sum(1 << j for j in places)
    flags = np.zeros(n, np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def differenced(blocks: list[tuple], nearest: list[tuple] | None) -> tuple[str, int, int]:
    """The text left of a page, how many blocks went as shared with the nearest page, and how many
    of the others by the page's own marks."""
    shared = common_lines(*([(b[0], any(b[2:])) for b in page] for page in (blocks, nearest))) if nearest else set()
    article, kept, n_shared = any(b[1] for b in blocks), [], 0
    for i, (text, inside, *named) in enumerate(blocks):
        if i in shared and not inside:
            n_shared += 1
        elif inside or not (article or any(named)):
            kept.append(text)
    return "\n".join(kept), n_shared, len(blocks) - len(kept) - n_shared


def main_text(blocks: list[tuple], nearest: list[tuple] | None) -> str:
    return differenced(blocks, nearest)[0]


def _beside(rows):
    """Each own row with the nearer of its neighbours on the same host."""
    before = here = None
    for row in chain(rows, [None]):
        if here is not None and here["own"]:
            near = [r for r in (before, row) if r is not None and r["host"] == here["host"]]
            yield here, max(near, key=lambda r: len(commonprefix([r["path"], here["path"]])), default=None)
        before, here = here, row


KEY = ("host", "path", "spot")
RESULTS = ("text", "n_chars", "n_shared", "n_marked")


def _ranges(read: DataFrame, n: int) -> tuple[list, list]:
    """First and last key of at most ``n`` ranges that hold all rows; only keys are shuffled."""
    key = F.struct(*KEY)
    ends = read.select(*KEY).repartitionByRange(n, *KEY).groupBy(F.spark_partition_id().alias("at")) \
        .agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    ends.sort(key=lambda r: (r["lo"]["host"].encode(), r["lo"]["path"].encode(), r["lo"]["spot"]))
    return [r["lo"] for r in ends], [r["hi"] for r in ends]


def _dealt(read: DataFrame, n: int) -> DataFrame:
    """Rows sorted within ranges; ``own`` is false for the rows next to a range."""
    firsts, lasts = _ranges(read, n)
    if not firsts:
        return read.withColumn("own", F.lit(True))
    key = F.struct(*KEY)
    literal = lambda rows: F.array(*[F.struct(F.lit(r["host"]).alias("host"), F.lit(r["path"]).alias("path"),
                                              F.lit(r["spot"]).alias("spot")) for r in rows])
    steps = [1 << i for i in reversed(range(len(firsts).bit_length()))]
    # The last range that does not begin after the key, by halving.
    home = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(literal(firsts), at + step) <= F.col("key"), F.lit(False)), at + step).otherwise(at))
    homes = F.array(F.struct(F.col("home").alias("place"), F.lit(True).alias("own")),
                    F.when((F.col("home") > 0) & (F.get(literal(firsts), F.col("home")) == F.col("key")),
                           F.struct((F.col("home") - 1).alias("place"), F.lit(False).alias("own"))),
                    F.when((F.col("home") < len(firsts) - 1) & (F.get(literal(lasts), F.col("home")) == F.col("key")),
                           F.struct((F.col("home") + 1).alias("place"), F.lit(False).alias("own"))))
    placed = read.withColumn("key", key).withColumn("home", home) \
        .withColumn("to", F.explode(F.filter(homes, lambda h: h.isNotNull())))
    return placed.select(*read.columns, "to.place", "to.own").repartitionById(len(firsts), F.col("place")) \
        .sortWithinPartitions(*KEY)


def extract(pages: DataFrame, url: str = "url", page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` less ``html``, with ``text``, ``n_chars`` and the counts of :func:`differenced`."""
    names = [n for n in (pages.columns if keep is None else keep) if n.lower() not in (page, *RESULTS)]
    host, path = (F.coalesce(c, F.lit("")) for c in url_parts(F.col(url)))
    read = pages.select(F.struct(*[F.col(quoted(n)) for n in names]).alias("row"), host.alias("host"), path.alias("path"),
                        F.col(page).alias("html"), F.xxhash64(*[F.col(quoted(n)) for n in names], F.col(page)).alias("spot"))
    dealt = _dealt(read, partitions(pages.sparkSession))
    schema = T.StructType([pages.schema[n] for n in names] + [T.StructField("text", T.StringType())] +
                          [T.StructField(c, T.LongType()) for c in RESULTS[1:]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        def rows():
            for batch in slices(batches, "html", 8 << 20):
                for row, host_, path_, page_, own in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "path", "html", "own"))):
                    yield {"row": row, "host": host_, "path": path_, "own": own, "blocks": page_blocks(page_ or "")}

        out: list[dict] = []
        for here, near in _beside(rows()):
            text, shared, marked = differenced(here["blocks"], near and near["blocks"])
            out.append(here["row"] | {"text": text, "n_chars": len(text), "n_shared": shared, "n_marked": marked})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return dealt.select("row", "host", "path", "html", "own").mapInArrow(run, schema)
