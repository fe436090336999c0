"""Text of simple PDF files with the standard library alone.

Reads objects, also those packed in object streams; follows the page tree; runs each page's text operators; and maps
codes through a font's ToUnicode table or, without one, as Latin-1.  Files that are encrypted, or compressed by other
means than Flate, raise; layout is not reconstructed beyond the order of operators and their line moves.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*)", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]/%]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[01]?", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A kerning of so many thousandths of an em reads as a space.
GAP = -200


def literal(token: bytes) -> bytes:
    """The bytes of a string token."""
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m: re.Match) -> bytes:
        what = m[1]
        if what.isdigit():
            return bytes([int(what, 8) & 255])
        return b"" if what in (b"\n", b"\r\n") else ESCAPES.get(what, what)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


class File:
    def __init__(self, content: bytes):
        if re.search(rb"/Encrypt\b", content):
            raise ValueError("encrypted")
        self.objects: dict[int, bytes] = {int(m[1]): m[2] for m in OBJECT.finditer(content)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                head, data = self.stream(body)
                first, n = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"First", b"N"))
                numbers = list(map(int, data[:first].split()[: 2 * n]))
                places = [*numbers[1::2], len(data) - first]
                for number, a, b in zip(numbers[::2], places[:-1], places[1:], strict=True):
                    self.objects.setdefault(number, data[first + a : first + b])

    def stream(self, body: bytes) -> tuple[bytes, bytes]:
        """An object's dictionary and its decoded stream."""
        m = STREAM.match(body)
        if not m:
            return body, b""
        head, data = m[1], m[2]
        end = data.rfind(b"endstream")
        data = data[: end if end >= 0 else len(data)]
        kinds = re.findall(rb"/(\w+Decode)\b", head)
        for kind in kinds:
            if kind != b"FlateDecode":
                raise ValueError(f"filter {kind.decode()}")
            data = zlib.decompressobj().decompress(data)
        return head, data

    def value(self, body: bytes, key: bytes) -> bytes:
        """What follows a key of a dictionary: an object if it is a reference, else the text up to the dictionary's end."""
        m = re.search(rb"/%s\b\s*" % key, body)
        if not m:
            return b""
        rest = body[m.end() :]
        r = REFERENCE.match(rest)
        return self.objects.get(int(r[1]), b"") if r else rest

    def kids(self, node: bytes, inherited: bytes = b"", depth: int = 0) -> list[tuple[bytes, bytes]]:
        """(page, its resources) below a node of the page tree, in order."""
        resources = self.value(node, b"Resources") or inherited
        if not re.search(rb"/Kids\b", node) or depth > 60:
            return [(node, resources)]
        listed = re.search(rb"/Kids\s*\[(.*?)\]", node, re.S)
        held = listed[1] if listed else self.value(node, b"Kids")
        return [page for r in REFERENCE.finditer(held) for page in self.kids(self.objects.get(int(r[1]), b""), resources, depth + 1)]

    def pages(self) -> list[tuple[bytes, bytes]]:
        catalog = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        if catalog is None:
            raise ValueError("no catalog")
        return [p for p in self.kids(self.value(catalog, b"Pages")) if re.search(rb"/Type\s*/Page\b", p[0])]

    def fonts(self, resources: bytes) -> dict[bytes, Font]:
        held = self.value(resources, b"Font")
        named = re.match(rb"\s*<<(.*?)>>", held, re.S)
        return {m[1]: Font(self, self.objects.get(int(m[2]), b"")) for m in re.finditer(rb"/(\S+)\s+(\d+)\s+\d+\s+R", named[1] if named else b"")}

    def text(self, page: bytes, resources: bytes) -> str:
        fonts = self.fonts(resources)
        listed = re.search(rb"/Contents\s*\[(.*?)\]", page, re.S)
        parts = [self.objects.get(int(r[1]), b"") for r in REFERENCE.finditer(listed[1])] if listed else [self.value(page, b"Contents")]
        out: list[str] = []
        held: list[bytes] = []
        font = Font(self, b"")
        for token in TOKEN.findall(b"\n".join(self.stream(p)[1] for p in parts)):
            if token[:1] in b"(<[]/+-.0123456789":
                held.append(token)
                continue
            if token == b"Tf":
                font = fonts.get(next((t[1:] for t in held if t.startswith(b"/")), b""), font)
            elif token in (b"T*", b"'", b'"', b"ET") or (token in (b"Td", b"TD") and held and float(held[-1]) != 0) or token == b"Tm":
                out.append("\n")
            if token in (b"Tj", b"TJ", b"'", b'"'):
                for t in held:
                    if t[:1] in b"(<" and t != b"<<":
                        out.append(font.text(literal(t)))
                    elif token == b"TJ" and t[:1] in b"+-.0123456789" and float(t) < GAP:
                        out.append(" ")
            held.clear()
        lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
        return "\n".join(line for line in lines if line)


class Font:
    """How codes of one or two bytes become text."""

    def __init__(self, file: File, body: bytes):
        self.wide = bool(re.search(rb"/Identity-H\b", body))
        self.table: dict[int, str] = {}
        data = file.stream(file.value(body, b"ToUnicode"))[1] if b"/ToUnicode" in body else b""
        text = lambda digits: bytes.fromhex(digits.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
            self.table |= {int(a, 16): text(b) for a, b in re.findall(rb"<(\w+)>\s*<(\w+)>", block)}
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
            for a, b, c in re.findall(rb"<(\w+)>\s*<(\w+)>\s*<(\w+)>", block):
                first = text(c)
                self.table |= {int(a, 16) + i: first[:-1] + chr(ord(first[-1]) + i) for i in range(min(int(b, 16) - int(a, 16), 0xFFFF) + 1)}
            for a, listed in re.findall(rb"<(\w+)>\s*<\w+>\s*\[(.*?)\]", block, re.S):
                self.table |= {int(a, 16) + i: text(c) for i, c in enumerate(re.findall(rb"<(\w+)>", listed))}

    def text(self, raw: bytes) -> str:
        codes = [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw) - 1, 2)] if self.wide else list(raw)
        if self.table:
            return "".join(self.table.get(c, "") for c in codes)
        return "" if self.wide else raw.decode("cp1252", "replace")


def pages_of(content: bytes) -> tuple[list[str], str | None]:
    """Texts of the pages in order, and the title of the metadata."""
    file = File(content)
    title = next((m[1] for b in [*file.objects.values(), content] if (m := re.search(rb"/Title\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", b))), None)
    raw = literal(title) if title else b""
    name = raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")
    return [file.text(*p) for p in file.pages()], name or None
