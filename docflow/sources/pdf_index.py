"""The page tree of a PDF file, read by random access: how many pages there are, and the size of each.

Only the cross-reference tables and the nodes on the way to a page are read, never the pages' contents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

WHITE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
#: Bytes read at a time for an object.
READ = 4096


class Ref(tuple):
    """An object's number and generation."""


class Name(str):
    """A name, without its slash."""


class Parser:
    """Objects of a piece of a file."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        while self.at < len(self.data):
            if self.data[self.at] in WHITE:
                self.at += 1
            elif self.data[self.at : self.at + 1] == b"%":
                self.at = min((x for x in (self.data.find(c, self.at) for c in (b"\n", b"\r")) if x >= 0), default=len(self.data))
            else:
                return

    def word(self) -> bytes:
        self.skip()
        start = self.at
        while self.at < len(self.data) and self.data[self.at] not in WHITE + DELIMITERS:
            self.at += 1
        return self.data[start : self.at]

    def value(self) -> Any:
        self.skip()
        two = self.data[self.at : self.at + 2]
        if not two:
            raise EOFError("an object goes on beyond what was read")
        if two == b"<<":
            self.at += 2
            found = {}
            while self.peek() != b">>":
                key = self.value()
                found[key] = self.value()
            self.at += 2
            return found
        one = two[:1]
        if one == b"[":
            self.at += 1
            items = []
            while self.peek()[:1] != b"]":
                items.append(self.value())
            self.at += 1
            return items
        if one == b"/":
            self.at += 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self.word()).decode("latin-1"))
        if one == b"<":
            end = self.data.index(b">", self.at)
            digits = re.sub(rb"\s", b"", self.data[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if one == b"(":
            return self.string()
        word = self.word()
        if not word:
            raise ValueError(f"no object at {self.at}")
        if re.fullmatch(rb"[+-]?\d+", word):
            back, number = self.at, int(word)
            following = re.compile(rb"\s+(\d+)\s+R(?![A-Za-z])").match(self.data, self.at)
            if following:
                self.at = following.end()
                return Ref((number, int(following[1])))
            self.at = back
            return number
        if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, word)

    def peek(self) -> bytes:
        self.skip()
        if self.at >= len(self.data):
            raise EOFError("an object goes on beyond what was read")
        return self.data[self.at : self.at + 2]

    def string(self) -> bytes:
        depth, start = 0, self.at
        while self.at < len(self.data):
            c = self.data[self.at : self.at + 1]
            self.at += 2 if c == b"\\" else 1
            depth += (c == b"(") - (c == b")")
            if not depth:
                return self.data[start + 1 : self.at - 1]
        raise EOFError("a string goes on beyond what was read")


class PdfIndex:
    """The pages of an open file."""

    def __init__(self, file: BinaryIO):
        self.file = file
        self.size = file.seek(0, 2)
        self.places: dict[int, tuple[int, int, int]] = {}  # number: (kind, offset or stream's number, place in the stream)
        self.trailer: dict[str, Any] = {}
        self.streams: dict[int, tuple[bytes, list[int]]] = {}
        tail = self.read(max(0, self.size - 2048), 2048)
        found = re.findall(rb"startxref\s+(\d+)", tail)
        if not found:
            raise ValueError("no cross-reference table")
        seen, at = set(), int(found[-1])
        while at is not None and at not in seen:
            seen.add(at)
            table = self.table(at)
            self.trailer = table | self.trailer  # the newest stays
            if "XRefStm" in table:
                self.table(table["XRefStm"])
            at = table.get("Prev")
        if "Encrypt" in self.trailer:
            raise ValueError("an encrypted file")
        self.root = self.get(self.get(self.trailer["Root"])["Pages"])

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def parsed(self, at: int, what) -> Any:
        """What a function makes of the bytes from a place on; more are read as long as the object goes on."""
        n = READ
        while True:
            data = self.read(at, n)
            try:
                return what(Parser(data), data)
            except (EOFError, IndexError):
                if len(data) < n:
                    raise ValueError(f"a broken object at {at}") from None
                n *= 4

    def table(self, at: int) -> dict[str, Any]:
        """Enters a cross-reference table or stream; returns its trailer."""
        if not self.read(at, 16).lstrip().startswith(b"xref"):
            trailer, data = self.parsed(at, self.indirect)
            self.enter_stream(trailer, self.decoded(trailer, data))
            return trailer

        def read(parser: Parser, data: bytes) -> dict[str, Any]:
            parser.word()
            entries: dict[int, tuple[int, int, int]] = {}
            while True:
                word = parser.word()
                if not word:
                    raise EOFError
                if word == b"trailer":
                    trailer = parser.value()
                    for number, place in entries.items():
                        self.places.setdefault(number, place)
                    return trailer
                first, count = int(word), int(parser.word())
                for k in range(count):
                    offset, _, kind = parser.word(), parser.word(), parser.word()
                    if not kind:
                        raise EOFError
                    if kind == b"n":
                        entries[first + k] = (1, int(offset), 0)

        return self.parsed(at, read)

    def enter_stream(self, trailer: dict[str, Any], data: bytes) -> None:
        widths = trailer["W"]
        ranges = trailer.get("Index") or [0, trailer["Size"]]
        row, at = sum(widths), 0
        for first, count in zip(ranges[::2], ranges[1::2], strict=True):
            for number in range(first, first + count):
                fields, place = [], at
                for width in widths:
                    fields.append(int.from_bytes(data[place : place + width], "big") if width else None)
                    place += width
                at += row
                kind = 1 if fields[0] is None else fields[0]
                if kind in (1, 2):
                    self.places.setdefault(number, (kind, fields[1] or 0, fields[2] or 0))

    def indirect(self, parser: Parser, data: bytes) -> tuple[Any, bytes | None]:
        """An object with its number, and a stream's bytes."""
        if parser.word() is None or parser.word() is None or parser.word() != b"obj":
            raise ValueError("no object here")
        value = parser.value()
        back = parser.at
        if isinstance(value, dict) and parser.word() == b"stream":
            start = parser.at + (2 if data[parser.at : parser.at + 2] == b"\r\n" else 1)
            n = self.get(value["Length"])
            if start + n > len(data):
                raise EOFError
            return value, data[start : start + n]
        parser.at = back
        return value, None

    @staticmethod
    def decoded(info: dict[str, Any], data: bytes) -> bytes:
        kinds, how = info.get("Filter"), info.get("DecodeParms")
        kinds, how = (kinds, how) if isinstance(kinds, list) else ([kinds] if kinds else [], [how])
        for kind, parms in zip(kinds, how or [None] * len(kinds), strict=False):
            if kind != "FlateDecode":
                raise ValueError(f"a stream of {kind}")
            data = zlib.decompress(data)
            if parms and parms.get("Predictor", 1) >= 10:
                data = unpredicted(data, parms.get("Columns", 1))
        return data

    def get(self, value: Any) -> Any:
        """What a reference refers to; other values as they are."""
        if not isinstance(value, Ref):
            return value
        kind, where, nth = self.places.get(value[0], (0, 0, 0))
        if kind == 1:
            return self.get(self.parsed(where, self.indirect)[0])
        if kind == 2:
            if where not in self.streams:
                of, (_, at, _) = None, self.places[where]
                info, of = self.parsed(at, self.indirect)
                data = self.decoded(info, of)
                heads = Parser(data)
                numbers = [int(heads.word()) for _ in range(2 * info["N"])]
                self.streams[where] = data, [info["First"] + x for x in numbers[1::2]]
            data, starts = self.streams[where]
            return self.get(Parser(data, starts[nth]).value())
        return None

    def __len__(self) -> int:
        return self.get(self.root.get("Count", 0))

    def pages(self, wanted: list[int]) -> Iterator[tuple[int, float, float]]:
        """Number and size (width, height in points, as shown) of pages, numbers from 0 and rising. Subtrees without any
        of them are passed over by their counts."""
        yield from self.below(self.root, 0, wanted, {}, frozenset())

    def below(self, node: dict[str, Any], first: int, wanted: list[int], given: dict[str, Any], above: frozenset[int]) -> Iterator[tuple[int, float, float]]:
        given = given | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate") if k in node}
        if "Kids" not in node:
            box = [float(self.get(x)) for x in self.get(given.get("CropBox", given.get("MediaBox", [0, 0, 612, 792])))]
            width, height = abs(box[2] - box[0]), abs(box[3] - box[1])
            yield (first, height, width) if (self.get(given.get("Rotate", 0)) or 0) % 180 else (first, width, height)
            return
        for kid in self.get(node["Kids"]):
            if isinstance(kid, Ref) and kid[0] in above:
                raise ValueError("a page tree with a cycle")
            child = self.get(kid)
            n = self.get(child.get("Count", 0)) if "Kids" in child else 1
            inside = [p for p in wanted if first <= p < first + n]
            if inside:
                yield from self.below(child, first, inside, given, above | ({kid[0]} if isinstance(kid, Ref) else set()))
            first += n


def unpredicted(data: bytes, columns: int) -> bytes:
    """Rows with a PNG filter each, as cross-reference streams have them: none, or up."""
    out, last = bytearray(), bytes(columns)
    for at in range(0, len(data), columns + 1):
        kind, row = data[at], data[at + 1 : at + 1 + columns]
        if kind not in (0, 2):
            raise ValueError(f"a row filter of kind {kind}")
        last = bytes((a + b) & 255 for a, b in zip(row, last, strict=True)) if kind == 2 else row
        out += last
    return bytes(out)
