"""Rows of a CSV text, read permissively and as a stream over the text: no list of its lines is made."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_DELIMITERS = ",;\t|"


class Lines:
    """The physical lines of a text by position: they end with \\n or \\r\\n; a text without \\n may use \\r alone."""

    def __init__(self, text: str):
        self.text = text.removeprefix("\ufeff")
        self.end = "\n" if "\n" in self.text else "\r"

    def at(self, pos: int) -> tuple[str, int]:
        """The line that starts at ``pos``, and where the next one starts (beyond the text after the last)."""
        k = self.text.find(self.end, pos)
        if k < 0:
            return self.text[pos:], len(self.text) + 1
        return self.text[pos : k - (self.end == "\n" and k > pos and self.text[k - 1] == "\r")], k + 1

    def more(self, pos: int) -> bool:
        return pos <= len(self.text)


class Row(NamedTuple):
    line_no: int  # from 1, of the physical line on which the row starts
    row_no: int  # from 0, the header
    raw: str
    cells: list[str] | None  # None where the row isn't well quoted; such a row ends with its line


def delimiter_of(header: str) -> str:
    """The delimiter that the header has most often outside quotes; comma if it has none."""
    bare = re.sub(r'"[^"]*"', "", header)
    return max(_DELIMITERS, key=lambda d: (bare.count(d), -_DELIMITERS.index(d)))


def read_row(lines: Lines, at: int, delimiter: str, width: int) -> tuple[list[str], int, int] | None:
    """The cells of the row that starts at ``at``, where the next one starts, and how many lines it has; None if it isn't
    well quoted.

    A row that spans lines must also have ``width`` cells.
    """
    line, after = lines.at(at)
    p, n, cells = 0, 1, []
    if '"' not in line:
        return line.split(delimiter), after, 1
    while True:
        if line[p : p + 1] == '"':
            p, held = p + 1, []
            while True:
                k = line.find('"', p)
                if k < 0:
                    if not lines.more(after) or len(cells) >= width:
                        return None
                    held.append(line[p:] + "\n")
                    (line, after), p, n = lines.at(after), 0, n + 1
                elif line[k + 1 : k + 2] == '"':
                    held.append(line[p : k + 1])
                    p = k + 2
                else:
                    held.append(line[p:k])
                    p = k + 1
                    break
            if p < len(line) and line[p] != delimiter:
                return None
            cells.append("".join(held))
        else:
            k = line.find(delimiter, p)
            k = len(line) if k < 0 else k
            cells.append(line[p:k])
            p = k
        if p >= len(line):
            return None if n > 1 and len(cells) != width else (cells, after, n)
        p += 1


def read_rows(text: str | None, delimiter: str | None = None) -> Iterator[Row]:
    """The rows of a text, the header first; lines that are empty or of spaces only are no rows but count.

    The delimiter is that of the header if none is given. A header that isn't well quoted is split at its delimiters.
    """
    lines, at, line_no, row_no, width = Lines(text or ""), 0, 1, 0, None
    while lines.more(at):
        line, after = lines.at(at)
        if not line.strip(" "):
            at, line_no = after, line_no + 1
            continue
        delimiter = delimiter or delimiter_of(line)
        got = read_row(lines, at, delimiter, line.count(delimiter) + 1 if width is None else width)
        if got is None and width is None:
            got = line.split(delimiter), after, 1
        if got is None:
            yield Row(line_no, row_no, line, None)
            at, line_no = after, line_no + 1
        else:
            cells, after, n = got
            width = len(cells) if width is None else width
            raw = line if n == 1 else lines.text[at : after - 1].replace("\r\n", "\n").removesuffix("\r" if lines.end == "\n" else "")
            yield Row(line_no, row_no, raw, cells)
            at, line_no = after, line_no + n
        row_no += 1
