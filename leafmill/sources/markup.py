"""Markdown and word-processor contents as HTML, for the markup operators."""

from __future__ import annotations

import html
import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPANS = (
    (re.compile(r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)"), r'<img src="\2" alt="\1" />'),
    (re.compile(r"\[([^\]]+)\]\(([^)\s]*)[^)]*\)"), r'<a href="\2">\1</a>'),
    (re.compile(r"\*\*(.+?)\*\*"), r"<strong>\1</strong>"),
    (re.compile(r"\*(.+?)\*"), r"<em>\1</em>"),
)


def _inline(text: str) -> str:
    parts = re.split(r"(`[^`]+`)", text)
    out = []
    for part in parts:
        if len(part) > 2 and part[0] == part[-1] == "`":
            out.append(f"<code>{html.escape(part[1:-1], quote=False)}</code>")
            continue
        part = html.escape(part, quote=False)
        for pattern, new in _SPANS:
            part = pattern.sub(new, part)
        out.append(part)
    return "".join(out)


def markdown_html(text: str) -> str:
    """Headings, paragraphs, lists, fenced code and inline marks of Markdown."""
    out: list[str] = []
    paragraph: list[str] = []
    items: list[str] = []
    kind = ""
    code: list[str] | None = None

    def close() -> None:
        nonlocal kind
        if paragraph:
            out.append(f"<p>{_inline(' '.join(paragraph))}</p>")
            paragraph.clear()
        if items:
            out.append(f"<{kind}>{''.join(f'<li>{_inline(i)}</li>' for i in items)}</{kind}>")
            items.clear()
            kind = ""

    for line in text.replace("\r\n", "\n").split("\n"):
        if line.startswith("```"):
            if code is None:
                close()
                code = []
            else:
                out.append(f"<pre><code>{html.escape(chr(10).join(code), quote=False)}</code></pre>")
                code = None
            continue
        if code is not None:
            code.append(line)
            continue
        head = re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)
        item = re.match(r"\s*(?:([-*+])|\d+[.)])\s+(.*)", line)
        if head:
            close()
            out.append(f"<h{len(head[1])}>{_inline(head[2])}</h{len(head[1])}>")
        elif item:
            wanted = "ul" if item[1] else "ol"
            if paragraph or kind != wanted:
                close()
            kind = wanted
            items.append(item[2])
        elif not line.strip():
            close()
        elif items:
            items[-1] += " " + line.strip()
        else:
            paragraph.append(line.strip())
    if code is not None:
        out.append(f"<pre><code>{html.escape(chr(10).join(code), quote=False)}</code></pre>")
    close()
    return "\n".join(out)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_html(data: bytes) -> str:
    """Paragraphs and headings of a DOCX archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        source = archive.read("word/document.xml")
    if b"<!DOCTYPE" in source or b"<!ENTITY" in source:
        raise ValueError("document types are refused")
    out = []
    for paragraph in ElementTree.fromstring(source).iter(f"{_W}p"):
        text = "".join((e.text or "") if e.tag == f"{_W}t" else " " for e in paragraph.iter() if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"Heading([1-6])", style.get(f"{_W}val", "")) if style is not None else None
        if text.strip():
            tag = f"h{level[1]}" if level else "p"
            out.append(f"<{tag}>{html.escape(text, quote=False)}</{tag}>")
    return "\n".join(out)


def from_markdown(value: Column) -> Column:
    return F.udf(lambda x: None if x is None else markdown_html(x), "string", useArrow=True)(value)


def from_docx(content: Column) -> Column:
    return F.udf(lambda x: None if x is None else docx_html(bytes(x)), "string", useArrow=True)(content)
