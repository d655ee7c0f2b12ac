"""The text of web pages: a tree of elements as browsers build it, and what of its body a reader sees.

Pages leave end tags out, close elements in another order than they were opened, and put text where no text may be. The
builder keeps a stack of open elements: a start tag ends the elements that can't hold it, an end tag those inside its own.
Formatting elements that are cut off so go on in what follows. What a table can't hold comes before it.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

# Fixed values of the HTML standard and of what counts as hidden.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript svg canvas".split())
HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = HEADINGS | set(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup "
    "hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
#: Elements beyond which a tag ends nothing that is open.
SCOPE = set("applet caption html marquee object svg table td template th".split())
#: Start tag -> what it ends, and where looking for that stops.
ENDS = {
    "li": ({"li"}, {"ol", "ul"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "button": ({"button"}, set()), "a": ({"a"}, set()),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
    "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tr": ({"tr", "caption", "colgroup"}, {"tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, set()), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, set()),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, set()), "caption": ({"caption", "colgroup"}, set()), "colgroup": ({"caption", "colgroup"}, set()),
}
TABLE_PARTS = set("caption col colgroup tbody td tfoot th thead tr".split())
#: Of a table, the parts that hold no text.
TEXTLESS = set("table tbody tfoot thead tr colgroup".split())
#: HTML inside of a drawing ends it.
BREAKS_OUT = ENDS_PARAGRAPH - {"a"} | FORMATTING - {"a"} | set("body br code embed head img meta ruby span sub sup var".split())


#: Formatting elements of a kind that go on at most.
ALIKE = 3


class Element:
    __slots__ = ("tag", "hidden", "children")

    def __init__(self, tag: str, hidden: bool):
        self.tag, self.hidden, self.children = tag, hidden, []


class Tree(HTMLParser):
    """Builds the body of a page. `open` is the stack of open elements, whose first is the body."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.body = Element("body", False)
        self.open = [self.body]
        self.count: Counter[str] = Counter()  # of open elements by tag
        self.in_head: str | None = ""  # the element of the head that is open, "" for none; None in the body

    def find(self, tags: set[str], stop: set[str]) -> int | None:
        """The place of the innermost open element of tags, unless one of stop is further in."""
        if not any(self.count[t] for t in tags):
            return None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in stop:
                return None
        return None

    def close(self, at: int | None = None) -> None:  # also the end of the feed, without a place
        if at is None:
            super().close()
            return
        gone = self.open[at:]
        self.drop(at, None)
        if gone[0].tag in SCOPE or gone[0].tag in TABLE_PARTS:
            return  # formatting ends with a cell or a table
        again = [(e.tag, e.hidden) for e in gone[1:] if e.tag in FORMATTING and e.tag != gone[0].tag]
        for k, kind in enumerate(again):
            if again[k:].count(kind) <= ALIKE:
                self.push(Element(*kind))

    def drop(self, at: int, end: int | None) -> None:
        self.count.subtract(e.tag for e in self.open[at:end])
        del self.open[at:end]

    def misplaced(self, tag: str | None) -> bool:
        """Whether text (tag None) or an element stands in a table, outside of its cells."""
        return self.open[-1].tag in TEXTLESS and tag not in TABLE_PARTS and tag not in ("script", "style", "template", "form")

    def put(self, child, tag: str | None) -> None:
        if self.misplaced(tag):
            at = max(k for k, e in enumerate(self.open) if e.tag == "table")
            before = self.open[at - 1].children
            before.insert(before.index(self.open[at]) if self.open[at] in before else len(before), child)
        else:
            self.open[-1].children.append(child)

    def push(self, element: Element) -> None:
        self.put(element, element.tag)
        self.open.append(element)
        self.count[element.tag] += 1

    def enter_body(self) -> None:
        self.in_head = None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and any(e.tag in ("svg", "math") for e in self.open):
            self.drop(-1, None)  # in drawings such a tag is an element without content; elsewhere the slash means nothing

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head") or tag == "body" and self.in_head is None:
            return
        if tag == "body":
            self.enter_body()
            return
        if self.in_head is not None:
            if tag in HEAD:
                self.in_head = tag if tag not in VOID else ""
                return
            if self.in_head in ("noscript", "template"):
                return
            self.enter_body()
        if (drawing := self.find({"svg", "math"}, {"foreignobject", "desc"})) is not None:
            if tag not in BREAKS_OUT:
                self.push(Element(tag, False))
                return
            self.close(drawing)
        if tag in ENDS_PARAGRAPH and (p := self.find({"p"}, SCOPE | {"button"})) is not None:
            self.close(p)
        if tag in ENDS and (at := self.find(ENDS[tag][0], ENDS[tag][1] | (SCOPE if tag not in TABLE_PARTS else {"table"}))) is not None:
            self.close(at)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.drop(-1, None)
        if tag in TABLE_PARTS and self.find({"table"}, set()) is None:
            return  # a part without a table is no element
        element = Element(tag, tag in HIDDEN or dict(attrs).get("aria-hidden") == "true")
        if tag in VOID:
            return
        self.push(element)

    def handle_endtag(self, tag):
        if self.in_head is not None:
            if tag in ("head", "html", "body"):
                self.in_head = ""
            elif tag == self.in_head:
                self.in_head = ""
            return
        if tag in ("html", "body", "head"):
            return  # what follows is the body's all the same
        if tag in HEADINGS:
            at = self.find(HEADINGS, SCOPE)
        elif tag in TABLE_PARTS or tag in SCOPE:
            at = self.find({tag}, {"table"} if tag in TABLE_PARTS else set())
        else:
            at = self.find({tag}, SCOPE | ({"ol", "ul"} if tag == "li" else set()))
        if at is None:
            return
        if tag in FORMATTING:
            self.drop(at, at + 1)  # what it holds that is still open goes on without it
        else:
            self.close(at)

    def handle_data(self, data):
        if self.in_head is not None:
            if self.in_head:
                return
            data = data.lstrip()
            if not data:
                return
            self.enter_body()
        if data.isspace() and self.open[-1].tag in TEXTLESS:
            self.open[-1].children.append(data)
        else:
            self.put(data, None)


#: An ampersand that begins no reference, or one that no semicolon ends.
OPEN_REFERENCE = re.compile(r"&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)")


def visible(html: str | None, closed: bool = False) -> str:
    """The text of a page's body without hidden elements, white space in runs as one; null and empty pages have none.

    Browsers also take some references that no semicolon ends, such as &amp; cut short; with `closed` these stay as they are.
    """
    tree = Tree()
    tree.feed(OPEN_REFERENCE.sub("&amp;", html or "") if closed else html or "")
    tree.close()
    parts, todo = [], list(reversed(tree.body.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.hidden:
            todo += reversed(x.children)
    text = re.sub(r"[ \t]+", " ", "".join(parts))
    return re.sub(r"\n{3,}", "\n\n", text).strip()
