"""Pages as flat node tables: one pass of the standard-library parser, no tree objects.

Every element and every piece of text becomes a row ``(pos, last, parent, tag, id, cls, text, href)``, numbered in
document order; ``last`` is the number of the last node inside it, so "inside" is a slice of the table.
Texts have the tag ``#text`` (``#raw`` inside script and style); ``href`` is null where an element has none.  The parser
decodes all character references, in texts and in attributes.  Work grows with the page, whatever stays open in it.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

#: Elements without an end tag, and elements whose content is no text (fixed by HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))

NODE_TYPE = ("array<struct<pos:int,last:int,parent:int,tag:string,id:string,cls:array<string>,text:string,href:string>>")


class NodeList(HTMLParser):
    """Collects the node rows of one page; an end tag closes the nearest open element of its name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.open_tags: Counter[str] = Counter()

    def _add(self, tag, id_=None, cls=(), text=None, href=None) -> int:
        pos = len(self.rows)
        self.rows.append([pos, pos, self.open[-1] if self.open else -1, tag, id_, list(cls), text, href])
        return pos

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        pos = self._add(tag, a.get("id"), (a.get("class") or "").split(), href=(a["href"] or "") if "href" in a else None)
        if tag not in VOID:
            self.open.append(pos)
            self.open_tags[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()
            self.open_tags[tag] -= 1

    def handle_endtag(self, tag):
        if not self.open_tags[tag]:
            return
        while True:
            row = self.rows[self.open.pop()]
            row[1] = len(self.rows) - 1
            self.open_tags[row[3]] -= 1
            if row[3] == tag:
                break

    def handle_data(self, data):
        raw = bool(self.open) and self.rows[self.open[-1]][3] in RAW
        self._add("#raw" if raw else "#text", text=data)


def node_rows(html: str | None) -> list[list]:
    p = NodeList()
    p.feed(html or "")
    p.close()
    for k in p.open:
        p.rows[k][1] = len(p.rows) - 1
    return p.rows
