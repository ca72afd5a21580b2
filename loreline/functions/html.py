"""HTML in columns: tags, entities, links, and the DOM helper."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.functions.text import let, strip

TAG = r"<[^>]+>"

# An anchor up to its href, whose value is the group; the other attributes may hold anything in quotes.
ANCHOR = r"""(?i)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

# What the HTML standard makes of character references, by rule from the standard library's table:
# names with and without semicolon, the old Windows characters, and numbers that name nothing.
NAMED = {name: char for name, char in html5.items()}
OPEN_NAMES = {name: char for name, char in html5.items() if not name.endswith(";")}
OPEN_LENGTHS = sorted({len(n) for n in OPEN_NAMES}, reverse=True)
WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0: "\ufffd", 0x0D: "\r"}


def _table(pairs: dict) -> Column:
    """A constant map, folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in pairs.items()})), T.MapType(T.StringType(), T.StringType()))


def _number(p: Column) -> Column:
    """The character of a numeric reference at the start of a piece, with what follows it; null if there is none."""
    decimal = F.regexp_extract(p, "^#0*([0-9]+)", 1)
    hexa = F.regexp_extract(p, "^#[xX]0*([0-9a-fA-F]+)", 1)
    # Numbers too long for any character are read as the first one past the last.
    beyond = F.lit("110000")
    digits = F.when(decimal != "", F.when(F.length(decimal) > 9, beyond).otherwise(F.conv(F.left(decimal, F.lit(9)), 10, 16))).when(
        hexa != "", F.when(F.length(hexa) > 6, beyond).otherwise(F.upper(F.left(hexa, F.lit(6))))
    )
    rest = F.regexp_replace(p, "^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")

    def char(h: Column) -> Column:
        code = F.when(F.length(h) <= 6, F.conv(h, 16, 10).cast("int")).otherwise(0x110000)
        nothing = (
            code.between(1, 8) | (code == 11) | code.between(14, 31) | code.between(127, 159)
            | code.between(0xFDD0, 0xFDEF) | ((code % 65536) >= 65534)
        )
        made = F.make_valid_utf8(F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32").cast("string"))
        return (
            F.try_element_at(_table(WINDOWS), code.cast("string")),
            F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd")).when(nothing, F.lit("")).otherwise(made),
        )

    return let(digits, lambda h: F.when(h.isNotNull(), F.concat(F.coalesce(*char(h)), rest)))


def _name(p: Column) -> Column:
    """The characters of a named reference at the start of a piece, with what follows it; null if there is none."""
    name = F.regexp_extract(p, "^[^\\t\\n\\f <&#;]{1,32};?", 0)

    def look(n: Column) -> Column:
        whole = F.concat(F.try_element_at(_table(NAMED), n), F.substr(p, F.length(n) + 1))
        begun = [
            F.when(F.length(n) > size, F.concat(F.try_element_at(_table(OPEN_NAMES), F.left(n, F.lit(size))), F.substr(p, F.lit(size + 1))))
            for size in OPEN_LENGTHS
        ]
        return F.coalesce(whole, *begun)

    return let(name, look)


def unescape(c: Column) -> Column:
    """Character references to characters, each once, as the HTML standard reads them.

    The text is cut at its ampersands and each piece is read from its start, so a
    decoded ampersand is never read again.
    """

    def decode(t: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            read = F.when(F.startswith(p, F.lit("#")), _number(p)).otherwise(_name(p))
            return F.when(i == 0, p).otherwise(F.coalesce(read, F.concat(F.lit("&"), p)))

        return F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "&"), piece), "")).otherwise(t)

    return let(c, decode)


def strip_style_script(html: Column) -> Column:
    """H4: style and script blocks removed."""
    html = F.regexp_replace(html, r"(?is)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")


def html_to_text(html: Column, sep: str = "\n") -> Column:
    """H6: tags to `sep`, entities decoded, ends stripped."""
    return strip(unescape(F.regexp_replace(html, TAG, sep)))


def text_summary(html: Column, n: int = 500, sep: str = " ") -> Column:
    """Plain text of a fragment, pieces joined by one blank, cut to `n` characters."""
    pieces = F.split(F.regexp_replace(html, TAG, "\x00"), "\x00")
    pieces = F.filter(F.transform(pieces, lambda p: strip(unescape(p))), lambda p: p != "")
    return F.left(F.array_join(pieces, sep), F.lit(n))


def page_heading(html: Column) -> Column:
    """Text of the first h1."""
    inner = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return unescape(F.regexp_replace(inner, TAG, ""))


def page_links(html: Column) -> Column:
    """The href of every anchor, in order, whether in double, single or no quotes."""
    found = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    bare = F.transform(found, lambda v: F.regexp_replace(v, r"""(?s)^(["'])(.*)\1$""", "$2"))
    return F.transform(bare, unescape)


def drop_heading(html: Column) -> Column:
    """The page without its first h1, for index pages."""
    return F.array_join(F.split(html, r"(?is)<h1[^>]*>.*?</h1>", 2), "")


def rewrite_links(html: Column, root: str) -> Column:
    """Links to .md files become absolute site links."""
    return F.regexp_replace(html, r'href="([^"]*)\.md"', f'href="{root}$1"')


# ---- the DOM helper (K3) ------------------------------------------------------

# Characters of pages after which a task hands on what it has read.
HANDED_ON = 1 << 22

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_BLOCKS = frozenset(("div", "span", "p"))


def _is_signature(attrs: dict) -> bool:
    ident, css = attrs.get("id", "").lower(), attrs.get("class", "").lower()
    return "signature" in ident or "signature" in css or "ms-outlook" in ident


DOM_VIEW = T.StructType([
    T.StructField("body", T.StringType()),
    T.StructField("blocks", T.ArrayType(T.StringType())),
])


class _Blocks(HTMLParser):
    """Collects the body without signature elements, and the text of each block element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.kept, self.texts, self.open = [], [], []
        self.muted = 0

    def handle_starttag(self, tag, attrs):
        muted = bool(self.muted) or _is_signature({k: v or "" for k, v in attrs})
        if not muted:
            self.kept.append(self.get_starttag_text())
        if tag in _VOID:
            return
        slot = None
        if tag in _BLOCKS and not muted:
            slot = []
            self.texts.append(slot)
        self.open.append((tag, slot, muted))
        self.muted += muted

    def handle_startendtag(self, tag, attrs):
        if not self.muted and not _is_signature({k: v or "" for k, v in attrs}):
            self.kept.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        if not any(name == tag for name, _, _ in self.open):
            return
        while True:
            name, _, muted = self.open.pop()
            self.muted -= muted
            if not muted:
                self.kept.append(f"</{name}>")
            if name == tag:
                return

    def handle_data(self, data):
        if self.muted:
            return
        self.kept.append(data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        text = data.strip()
        if text:
            for _, slot, _ in self.open:
                if slot is not None:
                    slot.append(text)


@F.pandas_udf(DOM_VIEW)
def dom_view(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """H5 and the element walk of H15: struct(body without signatures, block texts).

    Nesting defeats regular expressions, so each body goes once through the
    standard parser; all decisions on the texts stay native. Results of a batch are handed on in pieces of bounded size.
    """
    for series in bodies:
        rows, size = [], 0
        for html in series:
            if size >= HANDED_ON:
                yield pd.DataFrame(rows, columns=["body", "blocks"])
                rows, size = [], 0
            if html is None:
                rows.append((None, []))
                continue
            size += len(html)
            parser = _Blocks()
            parser.feed(html)
            parser.close()
            rows.append(("".join(parser.kept), ["".join(t) for t in parser.texts if t]))
        yield pd.DataFrame(rows, columns=["body", "blocks"])


# Marked so, the optimizer neither copies the parse nor moves filters into it.
dom_view = dom_view.asNondeterministic()


def strip_signature(html: Column) -> Column:
    """H5: elements whose id or class names a signature removed, with all they hold."""
    return dom_view(html)["body"]
