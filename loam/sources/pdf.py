"""Text of PDF files, page by page: objects and object streams, Flate, text operators, character maps.

Covers what text extraction needs: objects are found by their marks, so a broken cross-reference table does no harm.
Encrypted files, and filters other than Flate on content, give no text.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

DELIMITER = rb"\x00\t\n\x0c\r ()<>\[\]{}/%"
TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]]|/[^" + DELIMITER + rb"]*|\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|[^" + DELIMITER + rb"]+|[(){}<>]", re.S)
OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
STREAM = re.compile(rb"stream\r?\n")
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
#: An adjustment between strings of this many thousandths of the font size, or more, is a blank.
GAP = 180


class Name(bytes):
    pass


class Word(bytes):
    """An operator, or what stands for itself."""


class Ref(NamedTuple):
    number: int


class Stream(NamedTuple):
    head: dict
    raw: bytes


def string(token: bytes) -> bytes:
    """Bytes of a literal or hexadecimal string."""
    if token[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\r\n": b"", b"\n": b"", b"\r": b""}
    return ESCAPE.sub(lambda m: named.get(m[1], bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else m[1]), token[1:-1])


def tokens(data: bytes, at: int = 0):
    """(token, place after it); literal strings with inner brackets are one token."""
    while m := TOKEN.search(data, at):
        token, at = m[0], m.end()
        if token == b"(":  # brackets within
            depth, i = 1, at
            while i < len(data) and depth:
                depth += (data[i : i + 1] == b"(") - (data[i : i + 1] == b")")
                i += 1 + (data[i : i + 1] == b"\\")
            token, at = data[m.start() : i], i
        if token[:1] != b"%":
            yield token, at


def value_of(data: bytes, at: int = 0):
    """(value, place after it) of the first value of data."""
    stack: list[list] = [[]]
    for token, end in tokens(data, at):
        top = stack[-1]
        if token in (b"<<", b"["):
            stack.append([Word(token)])
            continue
        if token in (b">>", b"]"):
            if len(stack) == 1:
                break
            own = stack.pop()
            value = {k: v for k, v in zip(own[1::2], own[2::2]) if isinstance(k, bytes)} if token == b">>" else own[1:]
            top = stack[-1]
        elif token[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), token[1:]))
        elif token[:1] in (b"(", b"<") and len(token) > 1:
            value = string(token)
        elif token == b"R" and len(top) > 1 and all(isinstance(x, int) for x in top[-2:]):
            value = Ref(top[-2])
            del top[-2:]
        elif re.fullmatch(rb"[+-]?\d+", token):
            value = int(token)
        elif re.fullmatch(rb"[+-]?\d*\.\d*", token) and token not in (b".", b"+.", b"-."):
            value = float(token)
        else:
            value = Word(token)
        if len(stack) == 1 and not isinstance(value, int):
            return value, end
        if len(stack) == 1 and isinstance(value, int) and not re.match(rb"\s+\d+\s+R\b", data[end : end + 30]) and not top:
            return value, end
        top.append(value)
        at = end
    return (stack[0][0] if stack[0] else None), at


class Document:
    def __init__(self, data: bytes):
        self.objects: dict[int, object] = {}
        for m in OBJECT.finditer(data):
            value, end = value_of(data, m.end())
            if isinstance(value, dict) and (s := STREAM.match(data, re.compile(rb"\s*").match(data, end).end())):
                length = value.get(b"Length")
                stop = s.end() + length if isinstance(length, int) and data[s.end() + length : s.end() + length + 12].lstrip().startswith(b"endstream") else data.find(b"endstream", s.end())
                value = Stream(value, data[s.end() : stop if stop >= 0 else len(data)])
            self.objects[int(m[1])] = value  # of equal numbers, the last
        for held in [x for x in self.objects.values() if isinstance(x, Stream) and x.head.get(b"Type") == b"ObjStm"]:
            body, first = self.bytes_of(held), self.get(held.head.get(b"First"))
            if not isinstance(first, int):
                continue
            numbers = [int(x) for x in re.findall(rb"\d+", body[:first])]
            for number, place in zip(numbers[::2], numbers[1::2]):
                self.objects.setdefault(number, value_of(body, first + place)[0])

    def get(self, x):
        seen = 0
        while isinstance(x, Ref) and seen < 50:
            x, seen = self.objects.get(x.number), seen + 1
        return x

    def mapping(self, x) -> dict:
        x = self.get(x)
        return x if isinstance(x, dict) else {}

    def bytes_of(self, stream: Stream) -> bytes:
        filters = self.get(stream.head.get(b"Filter"))
        data = stream.raw
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if f != b"FlateDecode":
                return b""
            inflate = zlib.decompressobj()
            try:
                data = inflate.decompress(data)
            except zlib.error:
                return b""
        return data

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with the resources that they inherit."""
        roots = [x for x in self.objects.values() if isinstance(x, dict) and x.get(b"Type") == b"Catalog"]
        out, stack, seen = [], [(roots[-1].get(b"Pages"), None)] if roots else [], set()
        while stack:
            ref, resources = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            resources = node.get(b"Resources", resources)
            kids = self.get(node.get(b"Kids"))
            if isinstance(kids, list):
                stack += [(k, resources) for k in reversed(kids)]
            else:
                out.append(node | {b"Resources": resources})
        return out


def character_map(cmap: bytes) -> tuple[int, dict[bytes, str]]:
    """(bytes of a code, text of each code) of a ToUnicode stream."""
    text = lambda b: b.decode("utf-16-be", "replace")
    strings = lambda part: [string(x) for x in re.findall(rb"<[0-9A-Fa-f\s]*>", part)]
    codes: dict[bytes, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        own = strings(part)
        codes |= {a: text(b) for a, b in zip(own[::2], own[1::2])}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to in re.findall(rb"(<[^>]*>)\s*(<[^>]*>)\s*(<[^>]*>|\[.*?\])", part, re.S):
            low, high = string(low), string(high)
            begin = int.from_bytes(low, "big")
            span = range(begin, min(int.from_bytes(high, "big"), begin + 0xFFFF, 256 ** len(low) - 1) + 1)
            targets = strings(to) if to[:1] == b"[" else None
            base = None if targets else string(to)
            for k, code in enumerate(span):
                if targets is not None and k >= len(targets):
                    break
                into = targets[k] if targets is not None else ((int.from_bytes(base, "big") + k) % 256 ** len(base)).to_bytes(len(base), "big")
                codes[code.to_bytes(len(low), "big")] = text(into)
    sizes = [len(x) for part in re.findall(rb"begincodespacerange(.*?)endcodespacerange", cmap, re.S) for x in strings(part)]
    return max(sizes, default=max(map(len, codes), default=1)), codes


def page_text(doc: Document, page: dict) -> str:
    """Text in the order of the content; a move to another line is a line end, a wide gap in a line a blank."""
    fonts, maps = doc.mapping(doc.mapping(page.get(b"Resources")).get(b"Font")), {}
    contents = doc.get(page.get(b"Contents"))
    parts = [doc.get(c) for c in contents] if isinstance(contents, list) else [contents]
    data = b"\n".join(doc.bytes_of(p) for p in parts if isinstance(p, Stream))
    out: list[str] = []
    font, line = None, None
    operands: list = []

    def shown(raw: bytes) -> str:
        if font not in maps:
            told = doc.get(doc.mapping(fonts.get(font)).get(b"ToUnicode"))
            maps[font] = character_map(doc.bytes_of(told)) if isinstance(told, Stream) else (1, {})
        size, codes = maps[font]
        if not codes:
            return raw.decode("cp1252", "replace")
        return "".join(codes.get(raw[i : i + size], "\ufffd") for i in range(0, len(raw), size))

    def broken() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    at = 0
    while at < len(data):
        value, end = value_of(data, at)
        if value is None or end <= at:
            break
        at = end
        if not isinstance(value, Word):
            operands.append(value)
            continue
        numbers = [x for x in operands if isinstance(x, (int, float))]
        if value == b"Tf" and operands and isinstance(operands[0], Name):
            font = operands[0]
        elif value in (b"Td", b"TD") and len(numbers) == 2 and numbers[1] or value == b"T*":
            broken()
        elif value == b"Tm" and len(numbers) == 6:
            if line is not None and numbers[5] != line:
                broken()
            line = numbers[5]
        elif value in (b"Tj", b"'", b'"') and operands and isinstance(operands[-1], bytes):
            if value != b"Tj":
                broken()
            out.append(shown(operands[-1]))
        elif value == b"TJ" and operands and isinstance(operands[-1], list):
            for x in operands[-1]:
                if isinstance(x, bytes):
                    out.append(shown(x))
                elif isinstance(x, (int, float)) and x <= -GAP and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
        elif value == b"ET":
            broken()
        elif value == b"BI":  # an image in the content
            at = max(at, data.find(b"EI", at) + 2)
        operands = []
    return "".join(out).strip("\n")


def page_texts(content: bytes) -> list[str] | None:
    """The text of each page; None for what is no PDF, or an encrypted one."""
    if b"%PDF-" not in content[:1024] or re.search(rb"/Encrypt\b", content):
        return None
    doc = Document(content)
    return [page_text(doc, p) for p in doc.pages()]
