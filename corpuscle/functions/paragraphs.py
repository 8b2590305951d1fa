"""Paragraphs put together one after another, by all that was joined before; linear in the text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from . import layout as y

#: How much of the end of a text is looked at first for its last sign, and how much of its start for a label.
TAIL_CHARS, HEAD_CHARS = 4_096, 32

_CHINESE = re.compile("[一-鿿]")
_CITED = re.compile(r"[0-9,\s\-–—a-zA-Z]+")
_NOISE = "])}”’」』〕\"'" + "".join(filter(str.isspace, map(chr, range(0x3001))))
_KEYWORD_LINE, _NEW_BLOCK, _NUMBERED, _LEADING_WORD = map(re.compile, (y.KEYWORD_LINE, y.NEW_BLOCK, y.NUMBERED, y.LEADING_WORD))


def core(text: str) -> tuple[str, bool]:
    """The text without the citations and closing signs at its end, and whether what stands before it could matter."""
    text, open_start = text.rstrip(), False
    for _ in range(3):
        ended = text.rstrip()
        if ended.endswith("]"):
            at = ended.rfind("[")
            if at >= 0 and _CITED.fullmatch(ended, at + 1, len(ended) - 1):
                text = ended[:at]
            open_start |= at < 0 and (len(ended) == 1 or bool(_CITED.fullmatch(ended, 0, len(ended) - 1)))
        text = text.rstrip(_NOISE)
    return text, open_start or not text


class Growing:
    """A paragraph that grows at its end: parts, length, and no more of its start and end than the rules ask for."""

    def __init__(self, text: str, pos: int, page: int):
        self.pos, self.page, self.parts, self.size = pos, page, [text], len(text)
        self.head, self.tail = self._collapsed(text), text.rstrip()[-TAIL_CHARS:]

    @staticmethod
    def _collapsed(text: str) -> str:
        return " ".join(text.split())[:HEAD_CHARS]

    def text(self) -> str:
        if len(self.parts) > 1:
            self.parts = ["".join(self.parts)]
        return self.parts[0]

    def add(self, text: str) -> None:
        """Put a text to the end: without a blank where either side of the seam is Chinese."""
        last, text = self.parts[-1], text.lstrip()
        self.parts[-1] = last.rstrip()
        self.size -= len(last) - len(self.parts[-1])
        seam = "" if _CHINESE.match(self.parts[-1][-1:]) or _CHINESE.match(text) else " "
        self.parts.append(seam + text)
        self.size += len(seam) + len(text)
        self.tail = (self.tail + seam + text.rstrip())[-TAIL_CHARS:]
        if len(self.head) < HEAD_CHARS:
            self.head = self._collapsed(self.head + seam + text)

    def ended(self) -> bool:
        """Whether it ends as a sentence does."""
        kept, unsure = core(self.tail)
        if unsure and self.size > len(self.tail):
            kept, _ = core(self.text())
        return kept[-1:] != "" and kept[-1] in y.TERMINATORS

    def takes(self, text: str) -> bool:
        """Whether the next paragraph is a part of this one that the layout has cut off."""
        now = text.strip()
        if _KEYWORD_LINE.match(self.head) or _NEW_BLOCK.match(now):
            return False
        if self.tail.endswith((":", "：")):
            return True
        if _NUMBERED.match(now) or self.ended():
            return False
        return len(now) < y.SHORT_CHARS or "a" <= now[0] <= "z" or bool(_LEADING_WORD.match(now)) or not now[0].isupper()

    def takes_short(self, unit: Growing) -> bool:
        """Whether a short paragraph goes with this one, the one before it."""
        return unit.size < y.SHORT_CHARS and not _NEW_BLOCK.match(unit.text().strip()) and (self.size < y.SHORT_CHARS or not self.ended())


def joined(rows: Iterable[tuple[tuple, int, int, str, bool]]) -> Iterator[tuple[tuple, int, int, str]]:
    """``(key, pos, page, text)`` of rows (key, pos, page, text, apart) in order; nothing is joined over a row that is apart.

    A paragraph takes the next one by what it has become, then the one before takes it if it is short. Only these two are
    held, so the input may be of any length. Blank texts count as not there; what they part stays apart.
    """
    key: tuple = ()
    before: Growing | None = None
    unit: Growing | None = None

    def closed() -> Iterator[tuple[tuple, int, int, str]]:
        nonlocal before
        if unit is None:
            return
        if before is not None and before.takes_short(unit):
            before.add(unit.text())
            return
        if before is not None:
            yield key, before.pos, before.page, before.text()
        before = unit

    apart_next = False
    for own, pos, page, text, apart in rows:
        apart_next |= apart
        if not text.strip():
            continue
        if apart_next:
            yield from closed()
            if before is not None:
                yield key, before.pos, before.page, before.text()
            before, unit, key, apart_next = None, Growing(text, pos, page), own, False
        elif unit is not None and unit.takes(text):
            unit.add(text)
        else:
            yield from closed()
            unit = Growing(text, pos, page)
    yield from closed()
    if before is not None:
        yield key, before.pos, before.page, before.text()
