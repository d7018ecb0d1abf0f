"""Items of JSON arrays inside files of any size, read a piece at a time."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator, Sequence
from typing import Any, BinaryIO

PIECE = 1 << 20


def array_items(stream: BinaryIO, keys: Sequence[str] = ("links", "relationships"), piece: int = PIECE) -> Iterator[Any]:
    """Items of the top-level array under the first of the keys that the file has.

    At most a piece and one value are held. Other top-level values are skipped
    value by value. A file without any of the keys has no items; keys are
    looked for in turn, from the file's start.
    """
    for key in keys:
        stream.seek(0)
        found = False
        for name, item in _members(stream, key, piece):
            found = found or name == key
            if item is not _NONE:
                yield item
        if found:
            return


_NONE = object()


class _Text:
    """A window over the decoded stream."""

    def __init__(self, stream: BinaryIO, piece: int) -> None:
        self.stream, self.piece, self.decode = stream, piece, codecs.getincrementaldecoder("utf-8")().decode
        self.text, self.at, self.ended = "", 0, False

    def more(self) -> bool:
        if self.ended:
            return False
        raw = self.stream.read(self.piece)
        self.ended = not raw
        self.text, self.at = self.text[self.at :] + self.decode(raw, self.ended), 0
        return True

    def mark(self) -> str:
        """The next character that is no white space, empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n\ufeff":
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, mark: str) -> None:
        if self.mark() != mark:
            raise ValueError(f"{mark!r} was expected in a JSON text")
        self.at += 1

    def value(self) -> Any:
        self.mark()
        reader = json.JSONDecoder()
        while True:
            try:
                found, end = reader.raw_decode(self.text, self.at)
                if end < len(self.text) and self.text[end] in ",:]} \t\r\n" or not self.more():  # a number may go on in the next piece
                    self.at = end
                    return found
            except ValueError:
                if not self.more():
                    raise


def _items(text: _Text) -> Iterator[Any]:
    text.take("[")
    if text.mark() == "]":
        text.take("]")
        return
    while True:
        yield text.value()
        if text.mark() == "]":
            text.take("]")
            return
        text.take(",")


def _members(stream: BinaryIO, key: str, piece: int) -> Iterator[tuple[str, Any]]:
    text = _Text(stream, piece)
    if text.mark() != "{":
        return
    text.take("{")
    while text.mark() == '"':
        name = text.value()
        text.take(":")
        if text.mark() == "[":
            yield name, _NONE
            for item in _items(text):
                if name == key:
                    yield name, item
        else:
            text.value()
        if text.mark() != ",":
            break
        text.take(",")
