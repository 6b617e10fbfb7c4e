"""A small HTML reader for use inside tasks: one page in, its elements and texts out (standard library only)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDING = ("script", "style")
#: start tags with nothing but quoted attributes and no references, as most are, and their attributes
_PLAIN = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?:[ \n]+[a-zA-Z][a-zA-Z0-9_-]*="[^"&]*")*)[ \n]*>')
_PAIR = re.compile(r'([a-zA-Z][a-zA-Z0-9_-]*)="([^"]*)"')
#: elements whose content the library reads in a way of its own
_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


class _Reader(HTMLParser):
    """Appends the rows of a page to ``out`` while it is read; no tree is kept."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.size, self.base, self.here = len(source), 0, 0
        self.out: list[list] = []
        self.open: list[list] = []  # rows of the open elements
        self.hidden = 0  # how many of them hide their texts
        self.feed(source)
        self.base = self.size - len(self.rawdata)  # what is left is read by close()
        self.close()
        self._leave(0, self.size)

    def updatepos(self, i, j):
        # The library counts lines here, for which nobody asks; offsets will do.
        if i < j:
            self.here = self.base + j
        return j

    def _leave(self, level: int, end: int) -> None:
        """Close the open elements from a level on."""
        last = len(self.out) - 1
        for row in self.open[level:]:
            row[1], row[9] = last, end
            self.hidden -= row[3] in HIDING
        del self.open[level:]

    def parse_starttag(self, i):
        plain = _PLAIN.match(self.rawdata, i)
        if not plain or (tag := plain[1].lower()) in _RAW:
            return super().parse_starttag(i)
        self._begin(tag, [(k.lower(), v) for k, v in _PAIR.findall(plain[2])], self.base + plain.end())
        return plain.end()

    def handle_starttag(self, tag, attrs):
        self._begin(tag, attrs, self.here + len(self.get_starttag_text()))

    def _begin(self, tag: str, attrs: list, start: int) -> None:
        values = {k: v or "" for k, v in attrs}
        if len(values) < len(attrs):  # an attribute given twice: the first value, at the last place
            values = dict(reversed(list({k: v or "" for k, v in reversed(attrs)}.items())))
        at = len(self.out)
        row = [at, at, self.open[-1][0] if self.open else -1, tag, values.get("id", ""), values.get("class", "").split(), values, None, start, start]
        self.out.append(row)
        if tag not in VOID:
            self.open.append(row)
            self.hidden += tag in HIDING

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave(len(self.open) - 1, self.out[-1][8])

    def handle_endtag(self, tag):
        for level in range(len(self.open) - 1, -1, -1):
            if self.open[level][3] == tag:
                return self._leave(level, self.here)

    def handle_data(self, data):
        at = len(self.out)
        self.out.append([at, at, self.open[-1][0] if self.open else -1, "#text", None, None, None, None if self.hidden else data, None, None])


def nodes(source: str) -> list[list]:
    """Elements and texts of a page in document order: [ord, last, parent, tag, id, classes, attrs, text, start, end].

    Texts have the tag "#text"; one below a script or style has no text, as it is not shown. An element's own row holds none.
    """
    return _Reader(source).out
