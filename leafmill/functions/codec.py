"""The document codec: nodes, two byte streams, and back to HTML or text.

A node is ``(op, tag, attrs, payload)``. An encoded document is the length of its
structure stream (u32, big-endian), that stream, and its content stream.
"""

from __future__ import annotations

import re
import struct
from html.parser import HTMLParser

from .vocabulary import DEFAULT, RAW, UNKNOWN, VOID, Vocabulary

OPEN, CLOSE, TEXT, DOCTYPE, COMMENT, SELFCLOSE, RAWTEXT = range(1, 8)
BLOCKS = frozenset(
    "article aside blockquote br caption dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p "
    "pre section table tbody thead title tr ul".split()
)
CELLS = frozenset(("td", "th"))
SKIP_CLASSES = ("breadcrumb", "catlinks", "mw-editsection", "mw-jump", "navbox", "printfooter", "site-nav")


class CorruptDocument(ValueError):
    """An encoded document that breaks off or holds what the format doesn't know."""


def to_text(html) -> str:
    """Text of bytes or of a string, with what isn't UTF-8 replaced."""
    if isinstance(html, (bytes, bytearray, memoryview)):
        return bytes(html).decode("utf-8", "replace")
    return html.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class _Parser(HTMLParser):
    def __init__(self, found: list):
        HTMLParser.__init__(self)  # which resolves character references
        self.found = found
        self.raw = False

    def handle_starttag(self, tag, attrs):
        self.found.append((SELFCLOSE if tag in VOID else OPEN, tag, attrs, None))
        self.raw = self.raw or tag in RAW

    def handle_endtag(self, tag):
        if tag in RAW:
            self.raw = False
        if tag not in VOID:
            self.found.append((CLOSE, tag, [], None))

    def handle_data(self, data):
        if not data.isspace():
            self.found.append((RAWTEXT if self.raw else TEXT, None, [], data))
        elif " " in data and "\n" not in data:
            self.found.append((TEXT, None, [], " "))

    def handle_decl(self, decl):
        self.found.append((DOCTYPE, None, [], decl))

    def handle_comment(self, data):
        self.found.append((COMMENT, None, [], data))


def parse(html, close: bool = False) -> list[tuple]:
    """Nodes of a page: no tree repair, white-space-only text dropped unless it is a space within a line.

    Text behind the last tag that might go on, such as ``AT&T`` or ``x&amp`` at the
    very end, is only told apart by ``close``; without it, it is lost.
    """
    found: list[tuple] = []
    p = _Parser(found)
    p.feed(to_text(html))
    if close:
        p.close()
    return found


def parse_repaired(html) -> list[tuple]:
    """Nodes of a page after tree repair by lxml, where that library is there: what it can't parse is parsed plainly."""
    from lxml import etree
    from lxml import html as tree

    text = to_text(html)
    root = None
    for given in (text, text.encode("utf-8", "replace")):  # text with an encoding declaration is taken as bytes only
        try:
            root = tree.document_fromstring(given)
            break
        except (etree.ParserError, ValueError):
            continue
    if root is None:
        return parse(text)
    doctype = re.match(r"\s*<!(doctype[^>]*)>", text, re.I)
    found: list[tuple] = [(DOCTYPE, None, [], doctype[1])] if doctype else []

    def data(value: str | None, raw: bool) -> None:
        if value and not value.isspace():
            found.append((RAWTEXT if raw else TEXT, None, [], value))
        elif value and " " in value and "\n" not in value:
            found.append((TEXT, None, [], " "))

    stack: list[tuple] = [(root, False)]  # without recursion, as pages nest deeply
    while stack:
        node, leaving = stack.pop()
        tag = node.tag.rpartition("}")[2].lower() if isinstance(node.tag, str) else None
        if leaving:
            if tag and tag not in VOID:
                found.append((CLOSE, tag, [], None))
            if node is not root:
                data(node.tail, False)
            continue
        stack.append((node, True))
        if tag:
            found.append((SELFCLOSE if tag in VOID else OPEN, tag, [(k.rpartition("}")[2].lower(), v) for k, v in node.attrib.items()], None))
            data(node.text, tag in RAW)
            stack.extend((child, False) for child in reversed(node))
        elif node.tag is etree.Comment:
            found.append((COMMENT, None, [], node.text or ""))
    return found


def parser(name: str = "plain"):
    """A way to parse: plain, closed, repaired, or auto, which repairs where the library is there."""
    if name == "auto":
        from importlib.util import find_spec

        name = "repaired" if find_spec("lxml") else "plain"
    return {"plain": parse, "closed": lambda html: parse(html, True), "repaired": parse_repaired}[name]


class Codec:
    def __init__(self, vocabulary: Vocabulary = DEFAULT, tokenizer: str = "plain"):
        self.vocabulary, self.tokenizer = vocabulary, tokenizer
        self.tag_ids, self.attr_ids, self.string_ids = ({t: i for i, t in enumerate(names)} for names in vocabulary)

    # strings

    @staticmethod
    def _inline(out: bytearray, s: str) -> None:
        raw = s.encode("utf-8", "replace")
        out.append(0xFD)
        if len(raw) < 0xFF:
            out.append(len(raw))
        else:
            out += b"\xff" + struct.pack(">I", len(raw))
        out += raw

    def _string(self, out: bytearray, s: str | None) -> None:
        i = 0 if s is None else self.string_ids.get(s, -1)
        if s is None:
            out.append(0xFE)
        elif i < 0:
            self._inline(out, s)
        elif i < 0xFC:
            out.append(i)
        else:
            out += b"\xff" + struct.pack(">H", i)

    def _classes(self, out: bytearray, value: str) -> None:
        names = value.split()
        if not 0 < len(names) < 256:
            self._inline(out, value)
            return
        if len(names) > 1:
            out += bytes((0xFC, len(names)))
        for name in names:
            self._string(out, name)

    def _read(self, data: bytes, at: int) -> tuple[str | None, int]:
        try:
            b = data[at]
            if b == 0xFE:
                return None, at + 1
            if b == 0xFD:
                n, at = data[at + 1], at + 2
                if n == 0xFF:
                    (n,), at = struct.unpack_from(">I", data, at), at + 4
                if at + n > len(data):
                    raise CorruptDocument("a string goes beyond the end")
                return data[at : at + n].decode("utf-8"), at + n
            if b == 0xFC:
                names, n, at = [], data[at + 1], at + 2
                for _ in range(n):
                    name, at = self._read(data, at)
                    names.append(name or "")
                return " ".join(names), at
            if b == 0xFF:
                (b,), at = struct.unpack_from(">H", data, at + 1), at + 2
            return self.vocabulary.strings[b], at + 1
        except (IndexError, struct.error, UnicodeDecodeError) as e:
            raise CorruptDocument(f"bad string: {e}") from e

    # documents

    def encode_nodes(self, nodes: list[tuple]) -> bytes:
        shape, content = bytearray(), bytearray()
        for op, tag, attrs, payload in nodes:
            shape.append(op)
            if op in (OPEN, SELFCLOSE):
                if len(attrs) > 255:
                    raise ValueError("an element has more than 255 attributes")
                i = self.tag_ids.get(tag, UNKNOWN)
                shape += bytes((i, len(attrs)))
                if i == UNKNOWN:
                    self._string(content, tag)
                for name, value in attrs:
                    name = name.lower()
                    i = self.attr_ids.get(name, UNKNOWN)
                    shape.append(i)
                    if i == UNKNOWN:
                        self._string(content, name)
                    if name == "class" and value is not None:
                        self._classes(content, value)
                    else:
                        self._string(content, value)
            elif op != CLOSE:
                self._inline(content, payload)
        return struct.pack(">I", len(shape)) + bytes(shape) + bytes(content)

    def encode(self, html) -> bytes:
        return self.encode_nodes(parser(self.tokenizer)(html))

    def encode_text(self, text) -> bytes:
        return self.encode_nodes([(TEXT, None, [], to_text(text))])

    def nodes(self, blob: bytes, strict: bool = False):
        """Yields the nodes of an encoded document; those that close have the name of what they close."""
        if len(blob) < 4:
            raise CorruptDocument("the document has no header")
        (n,) = struct.unpack_from(">I", blob)
        if strict and 4 + n > len(blob):
            raise CorruptDocument("the structure stream breaks off")
        shape, content, at, c, open_ = blob[4 : 4 + n], blob[4 + n :], 0, 0, []
        tags, attr_names = self.vocabulary.tags, self.vocabulary.attrs
        try:
            while at < len(shape):
                op = shape[at]
                at += 1
                if op in (OPEN, SELFCLOSE):
                    i, count, at = shape[at], shape[at + 1], at + 2
                    if i == UNKNOWN:
                        tag, c = self._read(content, c)
                    else:
                        tag = tags[i]
                    attrs = []
                    for j in shape[at : at + count]:
                        if j == UNKNOWN:
                            name, c = self._read(content, c)
                        else:
                            name = attr_names[j]
                        value, c = self._read(content, c)
                        attrs.append((name, value))
                    if strict and at + count > len(shape):
                        raise CorruptDocument("the structure stream breaks off")
                    at += count
                    if op == OPEN:
                        open_.append(tag)
                    yield op, tag, attrs, None
                elif op == CLOSE:
                    yield op, open_.pop() if open_ else "", [], None
                elif op in (TEXT, DOCTYPE, COMMENT, RAWTEXT):
                    payload, c = self._read(content, c)
                    yield op, None, [], payload or ""
                elif strict:
                    raise CorruptDocument(f"unknown operation {op}")
        except IndexError as e:
            raise CorruptDocument("the structure stream breaks off") from e

    def decode(self, blob: bytes, strict: bool = False) -> str:
        return render(self.nodes(blob, strict))

    def text(self, blob: bytes, strict: bool = False) -> str:
        return nodes_text(self.nodes(blob, strict))


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attr(s: str) -> str:
    return s.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")


def render(nodes) -> str:
    """HTML of decoded nodes: one a line, tags indented by two spaces for each open element."""
    lines, depth = [], 0
    for op, tag, attrs, payload in nodes:
        if op in (OPEN, SELFCLOSE):
            given = "".join(f" {k}" if v is None else f' {k}="{escape_attr(v)}"' for k, v in attrs)
            lines.append(f"{'  ' * depth}<{tag}{given}>")
            depth += op == OPEN
        elif op == CLOSE:
            depth = max(0, depth - 1)
            lines.append(f"{'  ' * depth}</{tag}>")
        else:
            lines.append({TEXT: escape_text, RAWTEXT: str, DOCTYPE: "<!{}>".format, COMMENT: "<!--{}-->".format}[op](payload))
    return "\n".join(lines)


_BLANKS, _LINES = re.compile(r"[ \t\f\v]+"), re.compile(r"\n\s*\n+")


def tidy(text: str) -> str:
    return _LINES.sub("\n\n", _BLANKS.sub(" ", text)).strip()


def is_boilerplate(attrs) -> bool:
    for name, value in attrs:
        low = (value or "").lower()
        if (name == "role" and low == "navigation") or (name == "class" and any(s in low for s in SKIP_CLASSES)):
            return True
    return False


def nodes_text(nodes, repair: bool = False) -> str:
    """Readable text: a line break where a block opens, a tab where a cell does, no boilerplate.

    What is skipped ends where the depth returns, so an element left open inside
    of it prolongs it. With ``repair``, an end tag also closes what was left open
    within its element, and one without a partner closes nothing.
    """
    out, depth, skip = [], 0, None
    open_: list[str] = []
    for op, tag, attrs, payload in nodes:
        if op == OPEN or op == SELFCLOSE:
            if op == OPEN:
                depth += 1
                open_.append(tag)
                if skip is None and is_boilerplate(attrs):
                    skip = depth - 1
            if skip is None and tag in BLOCKS:
                out.append("\n")
            elif skip is None and tag in CELLS:
                out.append("\t")
        elif op == CLOSE:
            if repair:
                if tag in open_:
                    while open_.pop() != tag:
                        pass
                depth = len(open_)
            else:
                depth = max(0, depth - 1)
            if skip is not None and depth <= skip:
                skip = None
        elif op == TEXT and skip is None:
            out.append(payload)
    return tidy("".join(out))
