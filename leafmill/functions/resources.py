"""Resources of a package: paths, bases, scripts, links, manifests.  Column to Column."""

from __future__ import annotations

from urllib.parse import urljoin
from xml.parsers import expat

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scan
from .text import let
from .urls import resolve

# Script types that run, relations of links that fetch, types that can hold references, namespaces.
SCRIPT_TYPES = (
    "application/ecmascript", "application/javascript", "application/x-ecmascript", "application/x-javascript", "text/ecmascript", "text/javascript",
    "text/javascript1.0", "text/javascript1.1", "text/javascript1.2", "text/javascript1.3", "text/javascript1.4", "text/javascript1.5", "text/jscript",
    "text/livescript", "text/x-ecmascript", "text/x-javascript",
)
FETCHING_RELATIONS = ("icon", "modulepreload", "prefetch", "preload", "stylesheet")
XML_TYPES = (
    "application/mathml+xml", "application/smil+xml", "application/xhtml+xml", "application/x-dtbncx+xml", "application/x-dtbook+xml", "image/svg+xml",
    "text/x-oeb1-document",
)
XHTML, OPF = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/opf"
XML_BASE = "http://www.w3.org/XML/1998/namespace}base"
# Elements whose ends set words apart when the text of two documents is compared.
TEXT_BOUNDARIES = ("p", "div", "section", "br", "td", "th", "caption", "tr", "h1", "h2")


def percent_decode(value: Column) -> Column:
    """Percent escapes as UTF-8; a plus stays, and a value with a broken escape is left as it is."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def percent_encode(path: Column) -> Column:
    """All but letters, digits, ``_.-~`` and ``/`` as percent escapes of UTF-8."""
    out = F.url_encode(path)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def normal_path(path: Column) -> Column:
    """A relative path without empty and ``.`` segments, each ``..`` taking the segment before it; ``..`` that lead stay."""
    folded = F.aggregate(
        F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")),
        F.array().cast("array<string>"),
        lambda done, s: F.when((s == "..") & (F.size(done) > 0) & (F.get(done, F.size(done) - 1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.concat(done, F.array(s))
        ),
    )
    return F.coalesce(F.nullif(F.array_join(folded, "/"), F.lit("")), F.lit("."))


def _escapes(path: Column) -> Column:
    return (path == "..") | path.startswith("../")


def archive_reference(package_path: Column, href: Column) -> Column:
    """Struct of the member ``path`` that a manifest's href names, null for a remote one, and the ``problem``."""
    scheme = F.lower(F.regexp_extract(href, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(href, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    elsewhere = (scheme != "") | (authority != "")
    inside = percent_decode(F.regexp_extract(href, r"^(?://)?([^?#]*)", 1))
    folder = F.regexp_extract(package_path, "^(.*/)?", 0)

    def judged(p: Column) -> Column:
        unsafe = (p["decoded"] == "") | p["decoded"].startswith("/") | F.contains(p["decoded"], F.lit("\\")) | _escapes(p["path"])
        problem = F.when(elsewhere, F.when(~scheme.isin("http", "https") | (authority == ""), "unsafe remote manifest resource")).when(unsafe, "unsafe package resource")
        return F.struct(F.when(~elsewhere & ~unsafe, p["path"]).alias("path"), problem.alias("problem"))

    return let(let(inside, lambda d: F.struct(d.alias("decoded"), normal_path(F.concat(folder, d)).alias("path"))), judged)


def resource_base(path: Column, host: str) -> Column:
    """URL of a member of the package."""
    return F.concat(F.lit(f"https://{host}/"), percent_encode(path))


def document_base(rows: Column, path: Column, host: str) -> Column:
    """Struct of the ``base`` URL of a document (rows of :func:`scan.xml_flatten`) and the ``problem``.

    The first base element with an href among the children of the first head counts.
    """
    own = resource_base(path, host)
    xhtml = F.get(rows, F.lit(0))
    is_html = (xhtml["name"] == "html") & (xhtml["namespace"] == XHTML)
    head = F.get(F.filter(rows, lambda r: (r["parent"] == 0) & (r["name"] == "head") & (r["namespace"] == XHTML)), F.lit(0))["node"]
    bases = F.filter(rows, lambda r: (r["parent"] == head) & (r["name"] == "base") & (r["namespace"] == XHTML) & (F.trim(r["attributes"]["href"]) != ""))

    def judged(href: Column) -> Column:
        full = resolve(own, href)
        problem = (
            F.when(F.contains(href, F.lit("\\")), "reverse solidus in URL reference")
            .when(full.rlike("(?i)^file:"), "file URLs are forbidden")
            .when(href.rlike("(?i)^https?:(?!//[^/?#])"), "HTTP(S) base URL requires an authority")
        )
        return F.struct(F.when(problem.isNull(), F.when(href.isNull(), own).otherwise(full)).alias("base"), problem.alias("problem"))

    return let(F.when(is_html, F.get(bases, F.lit(0))["attributes"]["href"]), judged)


def image_sources(markup: Column) -> Column:
    """Quoted ``src`` values in order."""
    return F.regexp_extract_all(markup, F.lit(r"""(?i)src=(["'])(.*?)\1"""), F.lit(2))


def with_style(markup: Column, style: str) -> Column:
    """Markup with a style sheet before the end of its head."""
    return F.replace(markup, F.lit("</head>"), F.lit(f"<style>{style}</style></head>"))


def runs(script_type: Column, is_svg: Column) -> Column:
    """Whether a script of a type is run; parameters count, but for SVG."""
    bare = F.lower(F.trim(F.coalesce(script_type, F.lit(""))))
    seen = F.when(is_svg, F.trim(F.substring_index(bare, ";", 1))).otherwise(bare)
    return seen.isin("", "module", *SCRIPT_TYPES)


def fetches(relations: Column) -> Column:
    """Whether a link of these relations fetches its target."""
    return F.arrays_overlap(F.split(F.lower(F.trim(F.coalesce(relations, F.lit("")))), r"\s+"), F.array(*map(F.lit, FETCHING_RELATIONS)))


def can_refer(media_type: Column) -> Column:
    """Whether a resource of a type is read for references."""
    return media_type.isin("text/css", *SCRIPT_TYPES, *XML_TYPES)


def decoded(content: Column) -> Column:
    """Text of a style sheet or script: UTF-16 by its byte order mark, else UTF-8."""
    mark = F.hex(F.substring(content, 1, 2))
    return F.when(mark.isin("FEFF", "FFFE"), F.decode(content, "UTF-16")).otherwise(F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", ""))


def resource_references(content: Column, media_type: Column) -> Column:
    """Struct of the references (``kind``, ``ref``) of a style sheet or script by its type, whether it is ``scripted``, and the ``problem``."""
    is_style, is_script = media_type == "text/css", media_type.isin(*SCRIPT_TYPES)
    styles, scripts = scan.css_refs(F.when(is_style, decoded(content))), scan.js_refs(F.when(is_script, decoded(content)))
    of = lambda kind, found: F.transform(found["refs"], lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))
    refs = F.when(is_style, of("style", styles)).when(is_script, of("script", scripts)).otherwise(F.array().cast("array<struct<kind:string,ref:string>>"))
    return F.struct(refs.alias("refs"), is_script.alias("scripted"), F.coalesce(styles["problem"], scripts["problem"]).alias("problem"))


def manifest_items(rows: Column) -> Column:
    """Array of struct(id, href, media_type, properties, fallback) of the items in flattened rows of a package file."""
    items = F.filter(rows, lambda r: (r["name"] == "item") & (r["namespace"] == OPF) & (F.get(rows, r["parent"])["name"] == "manifest"))
    words = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "")

    def item(r: Column) -> Column:
        a = r["attributes"]
        return F.struct(
            a["id"].alias("id"), a["href"].alias("href"), a["media-type"].alias("media_type"), F.array_distinct(words(a["properties"])).alias("properties"), F.nullif(a["fallback"], F.lit("")).alias("fallback")
        )

    return F.transform(items, item)


def _sections(source: bytes, base: str) -> list[tuple]:
    """(node, base, in_frame): the base URL of every element, and whether it is inside an iframe."""
    parser = expat.ParserCreate(namespace_separator="}")
    out: list[tuple] = []
    stack = [(base, False)]

    def start(name: str, attributes: dict[str, str]) -> None:
        if len(out) >= scan.MAX_ELEMENTS or len(stack) > scan.MAX_DEPTH:
            raise scan.BudgetError("XML element budget exceeded")
        above, inside = stack[-1]
        own = urljoin(above, attributes.get(XML_BASE, ""))
        out.append((len(out), own, inside))
        stack.append((own, inside or name == XHTML + "}iframe"))

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: stack.pop()
    parser.EntityDeclHandler = _refuse
    parser.Parse(source, True)
    return out


def _body_text(source: bytes) -> str:
    """Text of the body element, a space at both ends of elements that set words apart."""
    parser = expat.ParserCreate(namespace_separator="}")
    parts: list[str] = []
    state = {"depth": 0, "body": None}

    def edge(name: str) -> None:
        if state["body"] is not None and name.rpartition("}")[2] in TEXT_BOUNDARIES:
            parts.append(" ")

    def start(name: str, _: dict[str, str]) -> None:
        if state["depth"] >= scan.MAX_DEPTH:
            raise scan.BudgetError("XML element budget exceeded")
        if state["body"] is None and name.rpartition("}")[2] == "body":
            state["body"] = state["depth"]
        state["depth"] += 1
        edge(name)

    def end(name: str) -> None:
        edge(name)
        state["depth"] -= 1
        if state["body"] == state["depth"]:
            state["body"] = None

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda text: parts.append(text) if state["body"] is not None else None
    parser.EntityDeclHandler = _refuse
    parser.Parse(source, True)
    return "".join(parts)


def _refuse(*_: object) -> None:
    raise scan.BudgetError("entity declarations are refused")


def sections(content: Column, base: Column) -> Column:
    """Struct of ``rows`` (node, base, in_frame) of a document, or the ``problem``; bases are inherited and changed by xml:base."""
    kind = "struct<rows:array<struct<node:int,base:string,in_frame:boolean>>,problem:string>"
    return F.udf(lambda x, b: scan._guarded(lambda v: _sections(bytes(v), b), x), kind, useArrow=True)(content, base)


def body_text(content: Column) -> Column:
    """Struct of the ``text`` of the body of an XML document, white space collapsed, or the ``problem``."""
    return F.udf(lambda x: scan._guarded(lambda v: " ".join(_body_text(bytes(v)).split()), x), "struct<text:string,problem:string>", useArrow=True)(content)


def extracted_name(page: Column, number: Column, extension: Column, masked: Column) -> Column:
    """File name of an image of a page; one with a mask is rendered, so it ends in ``.png`` too."""
    name = F.concat(F.lit("assets/page-"), page.cast("string"), F.lit("-image-"), number.cast("string"), F.lit("."), extension)
    return F.when(masked, F.concat(name, F.lit(".png"))).otherwise(name)
