"""Whole elements of pages, by the depth of their tags.

A page is cut at every ``<`` into an array, so that a tag's place in the array is its position. One fold over the tags that
matter keeps a running depth: an element begins at a tag that fits, and ends where the depth returns to what it was. Elements
whose end tag may be left out (cells, rows, list items) also end at the next of their kind in the same table or list.
The fold is linear in the tags of a page and runs inside the row: pages are not shuffled.

``row_spans`` finds the table row around a position by windows over the narrow table of row and table tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingmill.functions.text import bind, clean_whitespace, decode_entities

# --- fixed values -----------------------------------------------------------
#: Elements that may lack an end tag: what nests them anew, and what ends them.
OPEN_ENDED = {
    "td": (("table",), ("td", "/td", "th", "/th", "tr", "/tr")),
    "th": (("table",), ("td", "/td", "th", "/th", "tr", "/tr")),
    "tr": (("table",), ("tr", "/tr")),
    "li": (("ul", "ol"), ("li", "/li")),
    "p": ((), ("p", "/p", "div", "/div", "ul", "table", "/td", "/li")),
}
INVISIBLE = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
TAG = r"(?s)<(?:[A-Za-z][^>]*|/[^>]*|![^>]*)>"
# -----------------------------------------------------------------------------


def attributes(*conditions: str) -> str:
    """A pattern for the tag of an element that meets every condition."""
    return "(?i)^" + "".join(f"(?=[^>]*?{c})" for c in conditions) + r"\w+"


def css(name: str) -> str:
    """A condition: the class ``name``, quoted or not."""
    return rf"""\sclass\s*=\s*(?:["'][^"'>]*?)?(?<![\w-]){name}(?![\w-])"""


def link_to(address: str) -> str:
    """A pattern for a link whose address holds a match of ``address``; group 1 is the address, quoted or not."""
    return rf"""(?i)\shref\s*=\s*["']?((?<=")[^"]*?{address}[^"]*|(?<=')[^']*?{address}[^']*|(?<=[=\s])[^\s"'>]*?{address}[^\s"'>]*)"""


def group(text: Column, pattern: Column, number: int) -> Column:
    """``regexp_extract`` with a pattern from a column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(number))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows; filters that follow read their values instead of repeating the expressions behind them.

    The optimiser pushes a filter below a projection by writing its expressions into the filter, once for each mention. It
    doesn't push one below a generator.
    """
    return rows.select(F.explode_outer(F.array(F.struct(*rows.columns))).alias("_row")).select("_row.*")


def markup(html: Column) -> Column:
    """The page without comments, scripts and styles, cut at every ``<``."""
    return F.split(F.regexp_replace(html, INVISIBLE, ""), "<")


def tag_name(part: Column) -> Column:
    return F.lower(F.regexp_extract(part, r"^(/?[A-Za-z][A-Za-z0-9]*)", 1))


def _by_tag(tag: Column, choose, other: Column) -> Column:
    out = other
    for name, rule in OPEN_ENDED.items():
        found = choose(rule)
        out = F.when(tag == name, F.array(*[F.lit(x) for x in found]) if found else F.array().cast("array<string>")).otherwise(out)
    return out


def elements(parts: Column, tag: Column, attrs: Column) -> Column:
    """array of struct(a, b): the outermost ``tag`` elements whose tag matches ``attrs``, from part a to before part b.

    An element that never ends goes to the end of the page. A blank ``tag`` is the whole page.
    """

    def scan(rule: Column) -> Column:
        # rule binds what depends on the tag alone, so that it is computed once for a page
        named = F.transform(parts, lambda p, i: F.struct(i.alias("i"), tag_name(p).alias("name"), p.alias("p")))
        near = F.filter(named, lambda t: F.array_contains(rule["names"], t["name"]))
        marks = F.transform(
            near,
            lambda t: F.struct(
                t["i"].alias("i"),
                F.when(F.array_contains(rule["nest"], t["name"]), 1).when(F.array_contains(rule["leave"], t["name"]), -1).otherwise(0).alias("step"),
                F.array_contains(rule["ends"], t["name"]).alias("ends"),
                ((t["name"] == tag) & ((attrs == "") | (group(t["p"], attrs, 0) != ""))).alias("fits"),
            ),
        )
        nothing = F.array().cast("array<struct<a:int,b:int>>")
        start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("start"), nothing.alias("found"))

        def step(s: Column, t: Column) -> Column:
            inside = s["start"] >= 0
            over = inside & (s["depth"] == 0) & (t["ends"] | (t["step"] < 0))
            begins = (~inside | over) & t["fits"]
            return F.struct(
                F.when(begins | over | ~inside, 0).otherwise(s["depth"] + t["step"]).alias("depth"),
                F.when(begins, t["i"]).when(over, -1).otherwise(s["start"]).alias("start"),
                F.when(over, F.array_append(s["found"], F.struct(s["start"].alias("a"), t["i"].alias("b")))).otherwise(s["found"]).alias("found"),
            )

        def finish(s: Column) -> Column:
            rest = F.struct(s["start"].alias("a"), F.size(parts).alias("b"))
            return F.when(s["start"] >= 0, F.array_append(s["found"], rest)).otherwise(s["found"])

        return F.aggregate(marks, start, step, finish)

    nest = _by_tag(tag, lambda r: r[0], F.array(tag))
    ends = _by_tag(tag, lambda r: r[1], F.array().cast("array<string>"))
    leave = F.transform(nest, lambda n: F.concat(F.lit("/"), n))
    rule = F.struct(nest.alias("nest"), leave.alias("leave"), ends.alias("ends"), F.array_union(F.array_union(nest, leave), F.array_append(ends, tag)).alias("names"))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.size(parts).alias("b")))
    return F.when(tag == "", whole).otherwise(bind(rule, scan))


def cut(parts: Column, span: Column) -> Column:
    """The markup of a span, its own tag included."""
    body = F.array_join(F.slice(parts, span["a"] + 1, span["b"] - span["a"]), "<")
    return F.when(span["a"] > 0, F.concat(F.lit("<"), body)).otherwise(body)


def element_text(html: Column) -> Column:
    """The text of markup, tags removed, line ends kept; a ``<`` before anything but a tag is text."""
    return decode_entities(F.regexp_replace(html, TAG, ""))


def plain(html: Column) -> Column:
    return clean_whitespace(element_text(html))


def row_spans(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """page_id, a, row: the innermost table row around position ``a`` of (page_id, a) in the page's ``parts``, NULL without one.

    Table tags give every position its level. On its level, the last row or table tag before a position tells whether a row is
    open there, and the next one where it ends. Three windows over row and table tags, all dealt by page.
    """
    tags = pages.select("page_id", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "part")).select("page_id", "n", "i", tag_name(F.col("part")).alias("name"))
    tags = tags.filter(F.col("name").isin("table", "/table", "tr", "/tr")).distinct()
    asked = spans.select("page_id", F.lit(None).cast("int").alias("n"), F.col("a").alias("i"), F.lit("").alias("name")).distinct()
    step = F.when(F.col("name") == "table", 1).when(F.col("name") == "/table", -1).otherwise(0)
    order = W.partitionBy("page_id").orderBy("i", "name").rowsBetween(W.unboundedPreceding, 0)
    marks = tags.unionByName(asked).withColumn("level", F.sum(step).over(order) + F.when(F.col("name") == "/table", 1).otherwise(0))
    mark = F.when(F.col("name") != "", F.struct("i", "name"))
    before = W.partitionBy("page_id", "level").orderBy("i", "name").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("page_id", "level").orderBy(F.desc("i"), F.desc("name")).rowsBetween(W.unboundedPreceding, -1)
    marks = marks.withColumns({"_last": F.last(mark, True).over(before), "_next": F.last(mark, True).over(after)})
    inside = marks.filter(F.col("name") == "").select("page_id", F.col("i").alias("a"), "_last", "_next")
    # An open row without a next tag on its level goes on to the end of the page.
    row = F.when(F.col("_last.name") == "tr", F.struct(F.col("_last.i").alias("a"), F.coalesce("_next.i", F.lit(1 << 30)).alias("b")))
    return inside.select("page_id", "a", row.alias("row"))
