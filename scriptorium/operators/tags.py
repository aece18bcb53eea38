"""Evidence of landing pages: titles, meta tags, links, structured data and abstracts.

A page is cut into pieces (tags, comments, raw elements, text) by one pattern. What single
tags tell is read on a table of tags, which holds no text, and gathered by page. Containers
need the tags around them: nesting is a running sum over a page's tags, a container ends where
the sum is again what it was before, and a text is inside where more containers have
begun than ended. Only pages whose source mentions a container's name are cut that way.

Left as they stand: character references without a semicolon (numbers need none), and
those that are not of HTML 4. A tag that the page's end cuts off is dropped. Of an
attribute given twice the last counts.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_NAME, _VALUE = r"[^\s/>=][^\s/>=]*+", r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|)"""
_ATTRIBUTE = rf"({_NAME})(?:\s*+=\s*+({_VALUE}))?+"
_TAG = rf"</?+[A-Za-z][^\s/>]*+(?:[\s/]++|=|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+>"
_RAW = "script|style|title|textarea"
_PIECE = rf"(?si)<!--.*?(?:-->|\z)|(?=<({_RAW})[\s/>]){_TAG}.*?(?=</\1[\s/>]|\z)|{_TAG}|</?+[a-z][^>]*+\z|<[!?/][^>]*+>?+|[^<]++|<"

#: Elements without content, meta names that point to a PDF, containers of abstracts.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
PDF_NAMES = ("citation_pdf_url", "wkhealth_pdf_url")
ABSTRACT = r"(?i)abstract|^Abs1(?:-content)?$"
CONTAINERS = ("div", "p", "section")


def pieces(html: Column) -> Column:
    """The page cut into tags, comments, raw elements (with their content, without their end tag) and texts; null gives none."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_PIECE), F.lit(0))


def tag_name(piece: Column) -> Column:
    """Lower-case name of a start tag, with a slash before that of an end tag; empty for other pieces."""
    return F.lower(F.regexp_extract(piece, r"^<(/?[A-Za-z][^\s/>]*)", 1))


def unescaped(text: Column) -> Column:
    """Character references replaced; a number that is no character becomes U+FFFD."""
    names = F.str_to_map(F.lit("\t".join(f"{n}\n{chr(c)}" for n, c in [*name2codepoint.items(), ("apos", 39)])), F.lit("\t"), F.lit("\n"))
    form = r"^(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([A-Za-z][A-Za-z0-9]*);)"

    def one(part: Column) -> Column:
        whole, hexed, digits, name = (F.regexp_extract(part, form, k) for k in range(4))
        number = F.when(hexed != "", F.conv(F.right(hexed, F.lit(8)), 16, 10)).otherwise(F.right(digits, F.lit(10))).cast("long")
        long = F.length(F.ltrim(F.lit("0"), F.concat(hexed, digits))) > 8
        bad = long | (number < 1) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(number)), 8, "0")), "UTF-32")
        value = F.when(name != "", F.try_element_at(names, name)).when(whole != "", char)
        return F.when(value.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(value, F.substr(part, F.length(whole) + 1)))

    cut = F.split(text, "&", -1)
    decoded = F.concat(cut[0], F.array_join(F.transform(F.slice(cut, 2, F.size(cut)), one), ""))
    return F.when(text.contains("&"), decoded).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """Value of the attribute, references decoded; null where the tag lacks it, empty where it has no value."""
    inner = F.regexp_replace(tag, r"^</?[A-Za-z][^\s/>]*|>$", "")
    names = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(2))
    at = F.array_position(F.reverse(names), name)
    raw = F.when(at > 0, F.try_element_at(F.reverse(values), at.cast("int")))
    return unescaped(F.regexp_replace(raw, r"""^(["'])([\s\S]*)\1$""", "$2"))


def start_tag(piece: Column) -> Column:
    return F.regexp_extract(piece, "^(?:" + _TAG + ")", 0)


def content(raw: Column) -> Column:
    """What a raw element holds."""
    return F.regexp_replace(raw, "^(?:" + _TAG + ")", "")


def resolve(rows: DataFrame, base: str, reference: str, out: str) -> DataFrame:
    """``rows`` with ``out``: ``reference`` as an address, a relative one from ``base``, its dot segments removed. Null if either is null; a column ``out`` is replaced."""
    form = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
    parts = ("scheme", "host", "path", "query", "mark")
    t = rows.withColumn("_ref", F.regexp_replace(reference, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    t = t.withColumns({f"_{side}_{n}": F.regexp_extract(c, form, k) for side, c in (("r", "_ref"), ("b", base)) for k, n in enumerate(parts, 1)})
    folder = F.when(F.col("_b_path").contains("/"), F.regexp_replace("_b_path", "[^/]*$", "")).otherwise("/")
    t = t.withColumn("_path", F.when(F.col("_r_path") == "", F.col("_b_path")).when(F.col("_r_path").startswith("/"), F.col("_r_path")).otherwise(F.concat(folder, "_r_path")))
    dotted = F.col("_path").rlike(r"(^|/)\.\.?(/|$)") & (F.col("_r_path") != "")
    t = t.withColumn("_steps", F.when(dotted, F.split("_path", "/", -1)))
    step = lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s)))
    t = t.withColumn("_kept", F.aggregate(F.slice("_steps", 2, F.size("_steps")), F.array().cast("array<string>"), step))
    slash = F.when(F.element_at("_steps", -1).isin(".", "..") & (F.size("_kept") > 0), "/").otherwise("")
    path = F.when(dotted, F.concat(F.lit("/"), F.array_join("_kept", "/"), slash)).otherwise(F.col("_path"))
    query = F.when((F.col("_r_path") == "") & (F.col("_r_query") == ""), F.col("_b_query")).otherwise(F.col("_r_query"))
    own = F.concat("_b_scheme", F.lit(":"), "_b_host", path, query, "_r_mark")
    address = F.when(F.col("_ref") == "", F.col(base)).when(F.col("_r_scheme") != "", F.col("_ref")).when(F.col("_r_host") != "", F.concat("_b_scheme", F.lit(":"), "_ref")).otherwise(own)
    return t.withColumn(out, F.when(F.col(base).isNotNull() & F.col("_ref").isNotNull(), address)).drop("_ref", *[f"_{side}_{n}" for side in "rb" for n in parts], "_path", "_steps", "_kept")


def tag_table(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(row, key, base, at, name, piece): a row for each title, base, meta, link, a and script of a page, at least one a page. ``base``: the address that references start from, null where none is known."""
    wanted = F.filter(pieces(F.col(html)), lambda p: tag_name(p).isin("title", "base", "meta", "a", "link", "script"))
    t = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(url).alias("url"), wanted.alias("pieces"))
    with_base = F.filter("pieces", lambda p: (tag_name(p) == "base") & F.array_contains(F.regexp_extract_all(F.lower(p), F.lit(_ATTRIBUTE), F.lit(1)), "href"))
    t = t.withColumn("first", F.try_element_at(with_base, F.lit(1))).withColumn("href", attribute(start_tag(F.col("first")), "href"))
    t = resolve(t, "url", "href", "base").withColumn("base", F.coalesce("base", "url"))
    return t.select("row", "key", "base", F.posexplode_outer("pieces").alias("at", "piece")).withColumn("name", tag_name(F.col("piece")))


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, k, link): the http and https addresses of a page's a elements, numbered from 0 in page order; relative ones need a url or base."""
    t = tag_table(pages, key, url, html).where("name = 'a'").withColumn("href", attribute(start_tag(F.col("piece")), "href"))
    t = _addressed(t.select("row", "key", "base", "at", F.when(F.col("href") != "", F.col("href")).alias("ref")))
    k = F.count("link").over(W.partitionBy("row").orderBy("at")) - 1
    return t.withColumn("k", k).where("link IS NOT NULL").select(F.col("key").alias(key), "k", "link")  # kept after the numbering, so that nothing is computed twice


def _addressed(t: DataFrame) -> DataFrame:
    """With ``link``: ``ref`` as an http or https address, else null."""
    t = resolve(t, "base", "ref", "link").withColumn("link", F.coalesce("link", F.trim("ref")))
    return t.withColumn("link", F.when(F.col("link").rlike(r"(?i)^https?://[^/?#]"), F.col("link")))


def evidence(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, title, base, meta, links, pdfs, data), a row for each of ``pages``.

    ``title``: text of the first title element, white space made single, null without one. ``meta``: (name, content) of
    every meta tag with a name or property, lower case, in page order, repeated ones included. ``links``: http and https addresses
    of the a elements, in page order; ``pdfs``: those of meta tags and typed links that point to a PDF. ``data``: JSON-LD
    blocks that are JSON. A null url resolves nothing relative; a null or empty page has empty arrays. Equal and null keys stay rows apart.
    """
    t = tag_table(pages, key, url, html).withColumn("tag", start_tag(F.col("piece")))
    of = lambda name, *tags: F.when(F.col("name").isin(*tags), attribute(F.col("tag"), name))
    t = t.withColumn("called", F.when(F.col("name") == "meta", of("name", "meta"))).withColumn("called", F.lower(F.when(F.col("called") != "", F.col("called")).otherwise(of("property", "meta"))))
    t = t.withColumn("content", of("content", "meta")).withColumn("href", of("href", "a", "link")).withColumn("type", F.lower(of("type", "link", "script")))
    points = (F.col("name") == "link") & (F.col("type") == "application/pdf") | F.col("called").isin(*PDF_NAMES)
    t = t.withColumn("points", F.coalesce(points, F.lit(False))).withColumn("ref", F.when(F.col("name") == "a", F.col("href")).when(F.col("points"), F.coalesce("content", "href")))
    t = _addressed(t.withColumn("ref", F.when(F.col("ref") != "", F.col("ref"))))
    block = F.when((F.col("name") == "script") & (F.col("type") == "application/ld+json"), content(F.col("piece")))
    t = t.withColumn("block", block).withColumn("block", F.when(F.try_parse_json("block").isNotNull(), F.col("block")))
    t = t.withColumn("heading", F.when(F.col("name") == "title", F.trim(F.regexp_replace(unescaped(content(F.col("piece"))), r"\s+", " "))))
    gathered = lambda when, *values: F.collect_list(F.when(when, F.struct("at", F.struct(*values) if len(values) > 1 else F.col(values[0])).cast("struct<at:int,v:" + ("struct<name:string,content:string>" if len(values) > 1 else "string") + ">")))
    named = F.when(F.col("called") != "", F.coalesce("content", F.lit("")))
    t = t.withColumn("content", named)
    rows = t.groupBy("row").agg(
        F.first("key").alias("key"),
        F.first("base").alias("base"),
        F.min_by("heading", F.when(F.col("heading").isNotNull(), F.col("at"))).alias("title"),
        gathered(F.col("content").isNotNull(), "called", "content").alias("meta"),
        gathered((F.col("name") == "a") & F.col("link").isNotNull(), "link").alias("links"),
        gathered(F.col("points") & F.col("link").isNotNull(), "link").alias("pdfs"),
        gathered(F.col("block").isNotNull(), "block").alias("data"),
    )
    plain = [F.transform(F.array_sort(c), lambda x: x["v"]).alias(c) for c in ("meta", "links", "pdfs", "data")]
    return rows.select(F.col("key").alias(key), "title", "base", *plain)


def abstracts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, abstract): what the page shows inside its containers of abstracts, white space made single.

    Pages without such a container, or with an empty one, have no row. Raw elements show nothing. A container that
    is never closed reaches to the page's end.
    """
    told = pages.where(F.col(html).rlike("(?i)abs(?:tract|1)")).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), html)
    told = told.select("row", "key", F.posexplode(pieces(F.col(html))).alias("at", "piece"))
    name = tag_name(F.col("piece"))
    closing, alone = name.startswith("/"), F.col("piece").rlike(r"/>$")
    step = F.when((name == "") | name.isin(*VOID), 0).when(closing, -1).when(alone & ~name.isin(*_RAW.split("|")), 0).otherwise(1)
    marker = F.concat_ws(" ", *[F.coalesce(attribute(start_tag(F.col("piece")), a), F.lit("")) for a in ("id", "class", "data-title")])
    begins = (step == 1) & name.isin(*CONTAINERS) & F.trim(marker).rlike(ABSTRACT)
    order = W.partitionBy("row").orderBy("at")
    t = told.select("row", "key", "at", "piece", name.alias("name"), step.alias("step"), begins.alias("begins"))
    t = t.withColumn("level", F.sum("step").over(order)).withColumn("own", F.when(F.col("step") == 1, F.col("level") - 1).otherwise(F.col("level")))
    level = W.partitionBy("row", "own", F.col("step") == 0).orderBy("at")  # at one level, tags open and close in turn
    t = t.withColumn("ends", (F.col("step") == -1) & F.coalesce(F.lag("begins").over(level), F.lit(False)))
    t = t.withColumn("open", F.sum(F.col("begins").cast("int") - F.col("ends").cast("int")).over(order))
    shown = t.where("open > 0").withColumn("shown", F.when((F.col("name") == "") & ~F.col("piece").rlike("^<[!?/]"), F.col("piece")).when(F.col("name").isin("br", "/p", "/div", "/section", "p", "div", "section", "/li", "/h2", "/h3", "/h4"), " ").otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda s: s["shown"]), "")
    out = shown.groupBy("row").agg(F.first("key").alias(key), F.trim(F.regexp_replace(unescaped(body), r"\s+", " ")).alias("abstract"))
    return out.where("abstract <> ''").drop("row")
