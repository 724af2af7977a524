"""Text of the pages of plain PDF files, by their objects: unencrypted, streams as they are or deflated, fonts with a ToUnicode map or a Latin encoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]\s*)*(<<|>>|\[|\]|<[0-9A-Fa-f\s]*>|\(|/[^\s<>\[\]()/%{}]*|[^\s<>\[\]()/%{}]+)")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """The number of another object."""


class Name(str):
    pass


class Operator(str):
    pass


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string that begins behind its parenthesis."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            c = data[at : at + 1]
            at += 1
            if c.isdigit():
                digits = re.match(rb"[0-7]{1,3}", data[at - 1 : at + 2])
                if digits:
                    at += len(digits[0]) - 1
                    out.append(int(digits[0], 8) & 255)
            elif c in b"\r\n":
                at += data[at - 1 : at + 1] == b"\r\n"
            else:
                out += _ESCAPED.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def parse(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators in their order, with where each ends; `1 0 R` is one."""
    stack: list[list] = []
    while (m := _TOKEN.match(data, at)) is not None:
        token, at = m[1], m.end()
        value: object
        if token in (b"[", b"<<"):
            stack.append([token])
            continue
        if token in (b"]", b">>"):
            if not stack:
                return
            kind, *own = stack.pop()
            value = own if kind == b"[" else dict(zip(own[::2], own[1::2], strict=False))
        elif token == b"(":
            value, at = _string(data, at)
        elif token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif token[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), token[1:]).decode("latin-1"))
        elif re.fullmatch(rb"[+-]?\d+", token):
            value = int(token)
            reference = re.compile(rb"\s+\d+\s+R(?![A-Za-z])").match(data, at)
            if reference:
                value, at = Ref(value), reference.end()
        elif re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", token):
            value = float(token)
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(token, Operator(token.decode("latin-1")))
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class Document:
    def __init__(self, data: bytes) -> None:
        if not data.lstrip()[:5].startswith(b"%PDF-"):
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("the PDF file is encrypted")
        self.data = data
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        for m in _OBJECT.finditer(data):
            value, end = next(parse(data, m.end()), (None, m.end()))
            begin = re.compile(rb"\s*stream\r?\n").match(data, end)
            self.objects[int(m[1])] = value, self._raw(value, begin.end()) if begin and isinstance(value, dict) else None
        for value, raw in list(self.objects.values()):
            if raw is not None and value.get("Type") == "ObjStm":
                self._unpack(value, raw)

    def _raw(self, value: dict, begin: int) -> bytes:
        length = value.get("Length")
        end = begin + length if type(length) is int and self.data[begin + length :].lstrip()[:9] == b"endstream" else self.data.find(b"endstream", begin)
        return self.data[begin : end if end >= 0 else len(self.data)]

    def _unpack(self, value: dict, raw: bytes) -> None:
        """Objects that lie in a stream; one that is there by itself is newer."""
        body = self._inflated(value, raw)
        numbers = [int(x) for x in body[: value["First"]].split()]
        for number, offset in zip(numbers[::2], numbers[1::2], strict=True):
            found = next(parse(body, value["First"] + offset), None)
            if found:
                self.objects.setdefault(number, (found[0], None))

    def get(self, value: object) -> object:
        for _ in range(20):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(int(value), (None, None))[0]
        return value

    def _inflated(self, value: dict, raw: bytes) -> bytes:
        kinds = self.get(value.get("Filter"))
        for kind in kinds if isinstance(kinds, list) else [kinds] if kinds else []:
            if kind != "FlateDecode":
                raise ValueError(f"a stream of a kind that isn't read: {kind}")
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def stream(self, value: object) -> bytes:
        if not isinstance(value, Ref):
            return b"\n".join(self.stream(v) for v in value) if isinstance(value, list) else b""
        about, raw = self.objects.get(int(value), (None, None))
        return self._inflated(about, raw) if raw is not None else self.stream(about)

    def pages(self) -> Iterator[dict]:
        """The leaves of the page tree in order, with the resources that they inherit."""
        roots = [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        todo = [(roots[-1]["Pages"], {}, 0)] if roots else []
        while todo:
            at, above, depth = todo.pop()
            node = self.get(at)
            if not isinstance(node, dict) or depth > 50:
                continue
            resources = self.get(node.get("Resources")) or above
            if "Kids" in node:
                todo += [(kid, resources, depth + 1) for kid in reversed(self.get(node["Kids"]))]
            else:
                yield node | {"Resources": resources}

    def decoder(self, font: object):
        """Bytes of a string to text, by the font's map if it has one."""
        found = self.get(font)
        if not isinstance(found, dict) or "ToUnicode" not in found:
            return lambda s: s.decode("cp1252", "replace")
        body, codes, width = self.stream(found["ToUnicode"]), {}, 1
        text = lambda b: b.decode("utf-16-be", "ignore")
        for kind, part in re.findall(rb"beginbf(char|range)(.*?)endbf", body, re.S):
            own = [v for v, _ in parse(part)]
            for k in range(0, len(own) - 1, 2 if kind == b"char" else 3):
                low, width = int.from_bytes(own[k]), len(own[k])
                if kind == b"char":
                    codes[low] = text(own[k + 1])
                else:
                    for i in range(int.from_bytes(own[k + 1]) - low + 1):
                        to = own[k + 2]
                        codes[low + i] = text(to[i]) if isinstance(to, list) else text((int.from_bytes(to) + i).to_bytes(len(to)))
        return lambda s: "".join(codes.get(int.from_bytes(s[k : k + width]), "") for k in range(0, len(s), width))

    def text(self, page: dict) -> str:
        """What the page shows, in the order of its content: a line ends where the position moves down."""
        fonts = self.get((self.get(page["Resources"]) or {}).get("Font")) or {}
        made: dict[str, object] = {}
        decode, out, own, height = (lambda s: s.decode("cp1252", "replace")), [], [], None
        for value, _ in parse(self.stream(page.get("Contents"))):
            if not isinstance(value, Operator):
                own.append(value)
                continue
            if value == "Tf" and len(own) > 1:
                if own[-2] not in made:
                    made[own[-2]] = self.decoder(fonts.get(own[-2]))
                decode = made[own[-2]]
            elif value in ("Td", "TD") and own:
                out.append("\n" if own[-1] else " ")
            elif value == "Tm" and len(own) > 5:
                out.append("\n" if own[-1] != height else " ")
                height = own[-1]
            elif value in ("T*", "ET"):
                out.append("\n")
            if value in ("Tj", "'", '"') and own and isinstance(own[-1], bytes):
                out.append(("\n" if value != "Tj" else "") + decode(own[-1]))
            elif value == "TJ" and own and isinstance(own[-1], list):
                out.append("".join(decode(x) if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x < -200 else "" for x in own[-1]))
            own = []
        return re.sub(r" *\n[ \n]*", "\n", "".join(out)).strip()


def pages_of(data: bytes) -> list[tuple[int, str]]:
    """Numbers from 1 and texts of all pages."""
    own = Document(data)
    return [(n, own.text(page)) for n, page in enumerate(own.pages(), 1)]
