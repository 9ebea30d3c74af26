"""Tables that stand in a text as aligned lines, without rules: a fold with finite state.

Its state is two counters, of figure rows and of labels that follow each other, and
whether a header was met.
"""

from __future__ import annotations

from quillstone.functions import lines as ln

#: Labels without figures in a row, figure rows of a table without and with a header.
LABEL_RUN, LEAST_ROWS, LEAST_HEADED = 4, 3, 2


class _Run:
    """A run of lines that may become a table, as a state that takes one line after the other."""

    def __init__(self) -> None:
        self.headed = False
        self.figures = 0  # rows with figures
        self.waiting = 0  # labels since the last line of another class
        self.rows: list[list[int]] = []  # lines of every row
        self.dropped: list[int] = []

    def _new_row(self, line: int, label: bool = False) -> bool:
        self.rows.append([line])
        self.waiting = self.waiting + 1 if label else 0
        return True

    def _below(self, line: int) -> bool:
        """Figures alone go to the row above; right below the header they have no row."""
        if self.headed and len(self.rows) == 1:
            self.dropped.append(line)
        else:
            self.figures += self.waiting > 0  # the label has its figures now
            self.rows[-1].append(line)
        self.waiting = 0
        return True

    def take(self, line: int, code: str, wraps: bool) -> bool:
        """Whether the line belongs to the run; wraps: the next line is of figures alone."""
        match code:
            case ln.HEADER if not self.figures:
                self.headed = True
                return self._new_row(line)
            case ln.ROW:
                self.figures += 1
                return self._new_row(line)
            case ln.VALUES:
                return self._below(line)
            case ln.SUBLABEL | ln.WRAPS if self.waiting < LABEL_RUN and (wraps or code == ln.SUBLABEL):
                return self._new_row(line, label=True)
        return False

    def table(self) -> dict[int, int] | None:
        """The row of each line, -1 if it is dropped, without the labels at the end; None if there are too few figures."""
        if self.figures < (LEAST_HEADED if self.headed else LEAST_ROWS):
            return None
        kept = self.rows[: len(self.rows) - self.waiting]
        return {line: k for k, lines in enumerate(kept) for line in lines} | dict.fromkeys(self.dropped, -1)


def runs(codes: str, figures: list[bool]) -> list[tuple[int, int, list[int]]]:
    """(start, end, row of each line or -1) of every table among lines that follow each other.

    codes has the class of each line (see functions/lines.py), figures whether it is of
    figures alone.  A header after figure rows begins the next table; figures alone
    belong to the row above, or are dropped right below a header; labels at the end
    belong to what follows.
    """
    out, at = [], 0
    begins = (ln.HEADER, ln.ROW)
    while at < len(codes):
        if codes[at] not in begins:
            at += 1
            continue
        run, line = _Run(), at
        while line < len(codes) and run.take(line, codes[line], figures[line + 1] if line + 1 < len(codes) else False):
            line += 1
        rows = run.table()
        if rows is None:
            at = line  # no later line of this run begins a longer one
        else:
            out.append((at, max(rows) + 1, [rows[k] for k in range(at, max(rows) + 1)]))
            at = max(rows) + 1
    return out


def markdown(rows: list[list[str]]) -> str:
    """A grid as Markdown; bars inside cells become slashes."""
    grid = [[" ".join((c or "").split()).replace("|", "/") for c in row] for row in rows if row]
    if not grid:
        return ""
    width = max(map(len, grid))
    said = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in grid]
    return "\n".join([said[0], "|" + " --- |" * width, *said[1:]])
