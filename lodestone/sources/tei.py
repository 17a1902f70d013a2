"""TEI documents by an XML parser: one pass over each text, in Arrow batches.

Character references, CDATA, comments, prefixes and nested elements are the parser's matter. Names count without their prefix.
Named references that XML doesn't know are taken as HTML's. A broken document gives what stands before its fault.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from xml.parsers import expat

_NAMED = re.compile(r"&(?!(?:lt|gt|amp|quot|apos);)[A-Za-z][A-Za-z0-9]*;")


class Node:
    __slots__ = ("attributes", "inside", "name")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.inside = name, attributes, []

    def all(self, name: str) -> Iterator[Node]:
        """Elements of that name in document order, at any depth."""
        waiting = [x for x in reversed(self.inside) if isinstance(x, Node)]
        while waiting:
            node = waiting.pop()
            if node.name == name:
                yield node
            waiting += [x for x in reversed(node.inside) if isinstance(x, Node)]

    def first(self, name: str, **attributes: str) -> Node | None:
        return next((n for n in self.all(name) if all(n.attributes.get(k) == v for k, v in attributes.items())), None)

    def text(self, between: str = "") -> str:
        """Its text, white space runs as one space; `between` parts the texts of different elements."""
        parts, waiting = [], [self]
        while waiting:
            x = waiting.pop()
            if isinstance(x, Node):
                waiting += [between, *reversed(x.inside), between]
            else:
                parts.append(x)
        return " ".join("".join(parts).split())


def parse(xml: str | None) -> Node:
    """The document as a node without a name."""
    root = Node("", {})
    path = [root]

    def start(name: str, attributes: dict[str, str]) -> None:
        node = Node(name.rpartition(":")[2], {k.rpartition(":")[2] if k != "xml:id" else k: v for k, v in attributes.items()})
        path[-1].inside.append(node)
        path.append(node)

    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, lambda _: path.pop()
    parser.CharacterDataHandler = lambda said: path[-1].inside.append(said)
    try:
        parser.Parse(_NAMED.sub(lambda m: html.escape(html.unescape(m[0])) if html.unescape(m[0]) != m[0] else "", (xml or "").lstrip()).encode("utf-8", "replace"), True)
    except expat.ExpatError:
        pass
    return root


def said(node: Node | None, between: str = "") -> str | None:
    return (node.text(between) or None) if node is not None else None


def inside(node: Node, name: str, kinds: tuple[str, ...], attribute: str = "type") -> str | None:
    """Text of the first element of that name whose attribute is the first of `kinds`, else the next one."""
    return next((t for k in kinds if (t := said(node.first(name, **{attribute: k})))), None)


def people(node: Node) -> list[str]:
    """Names (first forename, surname) of all authors with a persName, in order."""
    found = []
    for author in node.all("author"):
        person = author.first("persName")
        if person is not None:
            found.append(" ".join(x for x in (said(person.first("forename", type="first")), said(person.first("surname"))) if x))
    return [x for x in found if x]


def year(date: Node | None) -> int | None:
    when = (date.attributes.get("when") or "")[:4].strip() if date is not None else ""
    return int(when) if re.fullmatch("[0-9]+", when) else None


def header(xml: str | None) -> dict:
    root = parse(xml)
    head = root.first("teiHeader") or root
    return {
        "title": inside(head, "title", ("main",)) or said(head.first("title")) or "Untitled", "abstract": said(head.first("abstract"), " ") or "", "authors": people(head),
        "doi": inside(head, "idno", ("DOI", "doi")), "arxiv_id": inside(head, "idno", ("arXiv", "arxiv")), "publication_year": year(head.first("date", type="published") or head.first("date")),
    }


def references(xml: str | None) -> Iterator[dict]:
    root = parse(xml)
    held = root.first("listBibl") or root.first("back") or root
    for pos, b in enumerate(held.all("biblStruct")):
        plain = next((n for n in b.all("title") if "level" not in n.attributes), None)
        yield {
            "pos": pos, "raw_citation": b.text(" "), "title": inside(b, "title", ("a", "m"), "level") or said(plain), "authors": people(b),
            "doi": inside(b, "idno", ("DOI", "doi")), "arxiv_id": inside(b, "idno", ("arXiv", "arxiv")), "year": year(b.first("date")), "extraction_method": "grobid",
        }
