"""Stored HTML pages to topics, entries, users and links.

One small Arrow helper lists the interesting elements of a page; everything
else (which element belongs where, which field it feeds) is a Spark expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from postlens.functions import links
from postlens.functions import text as tx
from postlens.functions import values as val
from postlens.operators.rows import unnest

ELEMENTS = T.ArrayType(T.StructType([
    T.StructField("at", T.IntegerType()),                       # place in the page
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("within", T.ArrayType(T.StringType())),       # marks of all ancestors, outermost first
    T.StructField("parents", T.ArrayType(T.IntegerType())),     # places of all ancestors
    T.StructField("own_text", T.StringType()),                  # direct text only
    T.StructField("text", T.StringType()),
    T.StructField("inner", T.StringType()),                     # inner HTML as written
]))

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


#: Plain markup: text, entities that end as they should, end tags, and start tags whose attributes are in double quotes.
_PLAIN = re.compile(r'[^<&]+|&(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+);|</([a-z][a-z0-9]*)>|<([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"&<>]*")*)>')
_ATTRIBUTE = re.compile(r' ([a-z][a-z0-9-]*)="([^"]*)"')
#: Elements whose content is not read as markup, or not everywhere.
_RAW = {"script", "style", "textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript", "svg", "math"}


class _Lister(HTMLParser):
    """Lists the elements whose tag, class or id is wanted. Entities stay as written.

    A page of plain markup is read by one pattern; at anything else it is left
    to the parser from its beginning.
    """

    def __init__(self, page: str, wanted: set[str]):
        self.page, self.wanted = page, wanted
        if not self._plain():
            super().__init__(convert_charrefs=False)
            self.open, self.found, self.seen, self.line_starts = [], [], 0, [0]
            for line in page.split("\n"):
                self.line_starts.append(self.line_starts[-1] + len(line) + 1)
            self.feed(page)
            self.close()
        self._pop(0, len(page))

    def _plain(self) -> bool:
        self.open, self.found, self.seen, read = [], [], 0, 0
        for m in _PLAIN.finditer(self.page):
            if m.start() != read:
                return False
            read = m.end()
            end, tag, attrs = m.groups()
            if tag:
                if tag in _RAW:
                    return False
                self._start(tag, dict(_ATTRIBUTE.findall(attrs)) if attrs else {}, m.start(), read)
            elif end:
                self._end(end, m.start())
            elif self.open:
                self.handle_data(m.group())
        return read == len(self.page)

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        at = self._offset()
        self._start(tag, {k: v or "" for k, v in attrs}, at, at + len(self.get_starttag_text()))

    def handle_endtag(self, tag):
        self._end(tag, self._offset())

    def _start(self, tag: str, attrs: dict, at: int, inside: int):
        if tag == "li":  # a new list item ends the one before it
            lists = [i for i, e in enumerate(self.open) if e["tag"] in ("li", "ul", "ol")]
            if lists and self.open[lists[-1]]["tag"] == "li":
                self._pop(lists[-1], at)
        marks = [tag]
        if "class" in attrs:
            marks += ["." + c for c in attrs["class"].split()]
        if "id" in attrs:
            marks += ["#" + i for i in attrs["id"].split()]
        element = {"at": self.seen, "tag": tag, "attrs": attrs, "marks": marks, "own": [], "all": [],
                   "start": inside, "wanted": not self.wanted.isdisjoint(marks)}
        self.seen += 1
        if tag in VOID:
            element["start"] = 0
            self._list(element, 0)
        else:
            self.open.append(element)

    def _end(self, tag: str, at: int):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                return self._pop(i, at)

    def _pop(self, depth: int, end: int):
        while len(self.open) > depth:
            self._list(self.open.pop(), end)

    def _list(self, element: dict, end: int):
        if element["wanted"]:
            self.found.append({
                "at": element["at"], "tag": element["tag"], "attrs": list(element["attrs"].items()),
                "within": [m for e in self.open for m in e["marks"]], "parents": [e["at"] for e in self.open],
                "own_text": "".join(element["own"]), "text": "".join(element["all"]),
                "inner": self.page[element["start"]:end]})

    def handle_data(self, data):
        if self.open:
            self.open[-1]["own"].append(data)
            for element in self.open:
                if element["wanted"]:
                    element["all"].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


#: Pages whose elements a Python task holds as objects at a time.
SLICE = 128


def with_elements(pages: DataFrame, wanted: list[str], html: str = "html") -> DataFrame:
    """Add ``elements``: the elements matching one of ``wanted`` (``tag``, ``.class`` or ``#id``), in page order."""
    marks, listed = set(wanted), to_arrow_type(ELEMENTS)

    @F.arrow_udf(ELEMENTS)
    def listing(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                yield pa.array([sorted(_Lister(p, marks).found, key=lambda e: e["at"]) if p else []
                                for p in batch.slice(at, SLICE).to_pylist()], listed)

    # Declared nondeterministic so that a filter on the result cannot parse the pages twice.
    return pages.withColumn("elements", listing.asNondeterministic()(F.col(html)))


def having(mark: str):
    """Predicate: the element itself carries the mark."""
    if mark.startswith("."):
        return lambda e: F.array_contains(F.split(F.coalesce(e["attrs"]["class"], F.lit("")), r"\s+"), mark[1:])
    if mark.startswith("#"):
        return lambda e: F.coalesce(e["attrs"]["id"] == mark[1:], F.lit(False))
    return lambda e: e["tag"] == mark


def select(elements: Column, mark: str, within: list[str] = (), parent: Column | None = None) -> Column:
    """Elements with the mark, below all of ``within`` and below the element at place ``parent``."""
    def fits(e: Column) -> Column:
        ok = having(mark)(e)
        for outer in within:
            ok = ok & F.array_contains(e["within"], outer)
        return ok if parent is None else ok & F.array_contains(e["parents"], parent)

    return F.filter(elements, fits)


def itemized(elements: Column, fits) -> Column:
    """Array of ``struct(item, own)``: every element that ``fits``, and the elements from it up to the next such one.

    Each item carries its own part of the page only, so a page takes time in proportion to its length.
    """
    places = F.transform(elements, lambda e, i: F.struct(e.alias("item"), i.alias("i")))

    def cut(items: Column) -> Column:
        return F.transform(items, lambda m, k: F.struct(m["item"].alias("item"), F.slice(
            elements, m["i"] + 1, F.coalesce(F.get(items, k + 1)["i"], F.size(elements)) - m["i"]).alias("own")))

    return val.let(F.filter(places, lambda p: fits(p["item"])), cut)


def _below(mark: str, within: list[str]):
    """Predicate: the element has the mark and lies below all of ``within``."""
    return lambda e: reduce(lambda ok, outer: ok & F.array_contains(e["within"], outer), within, having(mark)(e))


def _first(elements: Column, mark: str, within: list[str] = (), parent: Column | None = None) -> Column:
    return F.get(select(elements, mark, within, parent), F.lit(0))


def _texts(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda e: e["text"]), "")


def extract_threads(pages: DataFrame, keep: list[str] = (), container: str = ".topic-list", html: str = "html") -> DataFrame:
    """Topic listing to ``(…keep, id, title, slug, entry_count)``.

    The title is the link's own text, so the counter in ``<small>`` stays out of
    it; a link without counter counts one entry.
    """
    listed = with_elements(pages, ["a", "small"], html)
    found = itemized(F.col("elements"), lambda e: _below("a", [container, "li"])(e) & _parent_is(e, "li"))
    rows = unnest(listed, list(keep), found, "_x").select(*keep, F.col("_x.item").alias("_a"), F.col("_x.own").alias("_own"))
    counter = _texts(select(F.col("_own"), "small", parent=F.col("_a.at")))
    return rows.select(
        *keep, links.id_from_slug(F.col("_a.attrs")["href"]).alias("id"),
        tx.strip(F.col("_a.own_text")).alias("title"), F.col("_a.attrs")["href"].alias("slug"),
        val.parse_count(counter).alias("entry_count"))


def _parent_is(e: Column, tag: str) -> Column:
    """The innermost ancestor's marks end the list, and its first mark is the tag."""
    tags = F.filter(e["within"], lambda m: ~F.substring(m, 1, 1).isin(".", "#"))
    return F.element_at(tags, -1) == tag


def _with_entries(listed: DataFrame, keep: list[str], container: list[str]) -> DataFrame:
    marked = itemized(F.col("elements"), lambda e: _below("li", container)(e) & e["attrs"]["data-id"].isNotNull())
    items = unnest(listed, list(keep), marked, "_x", "pos").select(*keep, "pos", F.col("_x.item").alias("_li"), F.col("_x.own").alias("_own"))
    elements, place = F.col("_own"), F.col("_li.at")
    body = tx.strip(_first(elements, ".content", parent=place)["inner"])
    date = val.parse_edit_date(_texts(select(elements, ".entry-date", parent=place)))
    return items.select(
        *keep, "pos", F.col("_li.attrs")["data-id"].alias("id"), body.alias("body"),
        _texts(select(elements, ".entry-author", parent=place)).alias("author"),
        F.col("_li.attrs")["data-author"].alias("data_author"),
        F.col("_li.attrs")["data-author-id"].alias("author_id"),
        F.col("_li.attrs")["data-favorite-count"].alias("fav_count"),
        date["created_at"].alias("created_at"), date["updated_at"].alias("updated_at"))


ENTRY_MARKS = ["li", ".content", ".entry-date", ".entry-author"]


def extract_entries(pages: DataFrame, keep: list[str] = (), html: str = "html") -> DataFrame:
    """Topic page to its entries; rows lacking body, author or id are skipped."""
    rows = _with_entries(with_elements(pages, ENTRY_MARKS, html), list(keep), ["#entry-item-list"])
    complete = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("body", "author", "id")]
    return rows.where(complete[0] & complete[1] & complete[2]).drop("data_author")


def extract_topics(pages: DataFrame, keep: list[str] = (), html: str = "html") -> DataFrame:
    """Topic page to its header: id, title, slug, pages, tags and disambiguation links."""
    elements = F.col("elements")
    listed = with_elements(pages, ["#title", ".pager", "#hidden-channels", "li", "a"], html)
    title = _first(elements, "#title")["attrs"]
    pager = _first(elements, ".pager")["attrs"]
    others = itemized(elements, _below("li", ["#disambiguations", "ul"]))

    def number(c: Column) -> Column:
        return F.coalesce(F.nullif(c.try_cast("int"), F.lit(0)), F.lit(1))

    return listed.select(
        *keep, title["data-id"].alias("id"), title["data-title"].alias("title"),
        F.concat(title["data-slug"], F.lit("--"), title["data-id"]).alias("slug"),
        number(pager["data-pagecount"]).alias("total_page"),
        number(pager["data-currentpage"]).alias("current_page"),
        val.split_tags(_first(elements, "#hidden-channels")["text"]).alias("tags"),
        F.transform(others, lambda x: x["item"]["text"]).alias("disambiguation_titles"),
        F.transform(others, lambda x: _first(x["own"], "a", parent=x["item"]["at"])["attrs"]["href"]).alias("disambiguation_links"))


def extract_entry(pages: DataFrame, keep: list[str] = (), entry_id: str | None = None, html: str = "html") -> DataFrame:
    """Single-entry page: numeric id and favourites, author from the attribute.

    ``entry_id`` names the column with the requested id; without it the first
    entry of the page is taken.
    """
    listed = with_elements(pages, ENTRY_MARKS + ["#title"], html)
    titled = listed.withColumn("_title", _first(F.col("elements"), "#title")["attrs"]["data-title"])
    columns = [*keep, "_title"] + ([entry_id] if entry_id and entry_id not in keep else [])
    rows = _with_entries(titled, columns, [])
    rows = rows.where(F.col("id") == F.col(entry_id).cast("string")) if entry_id else rows.where("pos = 0")
    return rows.select(
        *keep, F.col("id").try_cast("bigint").alias("entry"), F.col("_title").alias("title"), "body",
        F.col("data_author").alias("author"), F.col("fav_count").try_cast("bigint").alias("fav_count"),
        "created_at", "updated_at")


def extract_search(pages: DataFrame, base_url: str, keep: list[str] = (), html: str = "html") -> DataFrame:
    """Search page to one row per topic with the page's ``thread_count`` text and absolute slugs."""
    listed = with_elements(pages, ["a", "small", ".topic-list-description"], html)
    found = itemized(F.col("elements"), lambda e: _below("a", ["#content-body", ".topic-list", "li"])(e) & _parent_is(e, "li"))
    count = tx.strip(_texts(select(F.col("elements"), ".topic-list-description")))
    rows = unnest(listed, [*keep, count.alias("thread_count")], found, "_x").select(
        *keep, "thread_count", F.col("_x.item").alias("_a"), F.col("_x.own").alias("_own"))
    counter = _texts(select(F.col("_own"), "small", parent=F.col("_a.at")))
    slug = links.absolute_url(F.col("_a.attrs")["href"], base_url)
    return rows.select(
        *keep, "thread_count", links.id_from_slug(slug).alias("id"), tx.strip(F.col("_a.own_text")).alias("title"),
        slug.alias("slug"), val.first_truthy(counter, default="1").alias("entry_count_total"))


USER_COUNTERS = ["entry-count-total", "entry-count-lastmonth", "entry-count-lastweek", "entry-count-today",
                 "last-entry-time"]


def extract_user(pages: DataFrame, keep: list[str] = (), html: str = "html") -> DataFrame:
    """Profile page to one row of ten text fields."""
    elements = F.col("elements")
    wanted = ["#user-profile-title", "a", "p"] + [f"#{c}" for c in USER_COUNTERS]
    quote = ["#quote-entry"]
    return with_elements(pages, wanted, html).select(
        *keep, _first(elements, "#user-profile-title")["attrs"]["data-nick"].alias("nick"),
        _texts(select(elements, "a", [*quote, "h2"])).alias("quote_entry_title"),
        _first(elements, "p", [*quote, "div"])["inner"].alias("quote_entry_body"),
        _texts(select(elements, "a", [*quote, "footer"])).alias("quote_entry_date"),
        _first(elements, "a", [*quote, "footer"])["attrs"]["href"].alias("quote_entry_url"),
        *[tx.strip(_texts(select(elements, f"#{c}"))).alias(c.replace("-", "_")) for c in USER_COUNTERS])


def extract_user_entries(pages: DataFrame, base_url: str, keep: list[str] = (), html: str = "html") -> DataFrame:
    """User timeline to ``(…keep, pos, name, date, summary, url)``.

    The page holds four parallel lists; the i-th item takes the i-th of each.
    """
    elements = F.col("elements")
    listed = with_elements(pages, [".topic-item", "a", ".permalink", ".content"], html).withColumns({
        "_items": select(elements, ".topic-item"),
        "_names": select(elements, "a", [".topic-item", "h1"]),
        "_dates": select(elements, ".permalink", [".topic-item", "ul", "li", "footer"]),
        "_bodies": select(elements, ".content", [".topic-item", "ul", "li"]),
    })
    joined = F.transform("_items", lambda _, i: F.struct(*[F.get(c, i).alias(c) for c in ("_names", "_dates", "_bodies")]))
    rows = unnest(listed, list(keep), joined, "_item", "pos")

    def nth(column: str) -> Column:
        return F.col(f"_item.{column}")

    return rows.select(
        *keep, "pos", F.coalesce(nth("_names")["text"], F.lit("")).alias("name"),
        F.coalesce(nth("_dates")["text"], F.lit("")).alias("date"),
        F.coalesce(nth("_bodies")["text"], F.lit("")).alias("summary"),
        links.absolute_url(nth("_names")["attrs"]["href"], base_url).alias("url"))
