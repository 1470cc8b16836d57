"""Listing items of landed pages, read from the bytes of their markup.

A pattern on a column scans all of an item for every field. Here the class' name is found first and the pattern is
tried from the tag on that may hold it. Results are those of ``extract.segments``, ``extract.element_text`` and
``extract.attribute``: byte patterns know ASCII letters, digits and blanks only, as Java's do by default, and
``bytes.lower`` folds A-Z only and moves nothing.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed

# field -> class of the element, attribute of the item's own tag; the rest of these is for items without a ``user``
ELEMENTS = {"price": "tc-price", "server": "tc-server", "side": "tc-side", "amount": "tc-amount",
            "user": "media-user-name", "seller": "tc-seller"}
ATTRIBUTES = {"online": "data-online", "href": "href", "data_seller": "data-seller", "data_user": "data-user",
              "data_username": "data-username"}
# ``markup`` is the item itself, only where the link has no id
FIELDS = (*ATTRIBUTES, *ELEMENTS, "markup")


def class_pattern(name: str) -> str:
    """Pattern of a class attribute that lists ``name``."""
    return rf"""class\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["']"""


def _compiled(pattern: str) -> re.Pattern[bytes]:
    return re.compile(pattern.encode(), re.DOTALL)


# these are tried on lower-cased pages
_ITEM = _compiled(rf"<\w+\b[^>]*{class_pattern('tc-item')}")
# text up to the first end tag of the name, as '(.*?)</\1\s*>', but faster
_ELEMENTS = [(name.encode(), _compiled(rf"<(\w+)\b[^>]*{class_pattern(name)}[^>]*>([^<]*+(?:<(?!/\1\s*>)[^<]*+)*+)</\1\s*>"))
             for name in ELEMENTS.values()]
_ATTRIBUTES = [_compiled(rf"""\s{name}\s*=\s*["']([^"']*)["']""") for name in ATTRIBUTES.values()]
_TAG = _compiled(r"<[^>]*>")
_ODD_TAG = re.compile(rb"<\w+(?=[\x80-\xff])")
_ENTITIES = ((b"&lt;", b"<"), (b"&gt;", b">"), (b"&quot;", b'"'), (b"&#39;", b"'"), (b"&nbsp;", b" "), (b"&amp;", b"&"))
# '$' of a column's pattern also stands ahead of a last line end; those that are no blanks
_LINE_ENDS = tuple(c.encode() for c in "\x85\u2028\u2029")
_ENDS = re.compile(rb"^\s+|\s+(?=(?:" + b"|".join(_LINE_ENDS) + rb")?\Z)")
_ONLINE = {flag.encode() for flag in fixed.ONLINE_FLAGS}
_ID = re.compile(fixed.LISTING_ID.encode())
# a name with one of these is none of fixed.BLANK_SELLERS
_NAMED = re.compile(rb"[b-mo-zB-MO-Z0-9]")


def _plain(markup: bytes) -> bytes:
    """``extract.plain``."""
    if b"<" in markup:
        markup = _TAG.sub(b"", markup)
    if b"&" in markup:
        for entity, char in _ENTITIES:
            markup = markup.replace(entity, char)
    out = markup.strip()
    return _ENDS.sub(b"", markup) if out.endswith(_LINE_ENDS) else out


def _without_odd_tags(html: bytes) -> bytes:
    """The page with another byte for the '<' of tags whose name goes on with a letter or digit outside ASCII.

    To a column's pattern such a name has no end, so no element begins there; a byte pattern would see one.
    """
    def masked(tag: re.Match[bytes]) -> bytes:
        following = html[tag.end():tag.end() + 4].decode(errors="replace")[0]
        kind = unicodedata.category(following)
        word = kind[0] == "L" or kind == "Nd" or kind == "Mn" and not tag[0].endswith(b"_")
        return b"\0" + tag[0][1:] if word else tag[0]
    return html if html.isascii() or not _ODD_TAG.search(html) else _ODD_TAG.sub(masked, html)


def _begin(low: bytes, at: int, first: int, two_quotes: bool = True) -> int:
    """The place from ``first`` on ahead of which no element begins that has the class named at ``at``, or later.

    The name stands in quotes that belong to the element's own tag, and up to these the tag has no '>'.
    """
    quote = low.rfind(b'"', first, at)
    if two_quotes:
        quote = max(quote, low.rfind(b"'", first, at))
    return first if quote < 0 else max(first, low.rfind(b">", first, quote) + 1)


def _item_places(low: bytes) -> list[tuple[int, int]]:
    """Where elements of the item class begin, and where their class ends."""
    places, tried, at = [], 0, low.find(b"tc-item")
    while at >= 0:
        place = low.find(b"<", _begin(low, at, tried), at)
        while place >= 0:
            if begun := _ITEM.match(low, place):
                places.append(begun.span())
            place = low.find(b"<", place + 1, at)
        tried, at = at, low.find(b"tc-item", at + 1)
    return places


def _items(html: bytes) -> list[tuple[bytes | None, ...]]:
    """The fields of every item of a page, in ``FIELDS`` order; of offline items the flag alone."""
    low = _without_odd_tags(html).lower()
    places = _item_places(low)
    ends = [place for place, _ in places[1:]]
    ends.append(len(html))
    found = []
    for (place, begun), end in zip(places, ends):
        if begun > end and not _ITEM.match(low, place, end):
            continue
        head = low.find(b">", place, end) + 1
        values = []
        for pattern in _ATTRIBUTES[:2]:
            value = pattern.search(low, place, head)
            values.append(_plain(html[value.start(1):value.end(1)]) if value else b"")
            if len(values) == 1 and values[0].lower() not in _ONLINE:
                break
        else:
            texts = []
            two_quotes = low.find(b"'", place, end) >= 0
            for name, pattern in _ELEMENTS:
                at = low.find(name, place, end)
                if at < 0:
                    texts.append(b"")
                    continue
                value = pattern.search(low, _begin(low, at, place, two_quotes), end)
                texts.append(_plain(html[value.start(2):value.end(2)]) if value else b"")
            if _NAMED.search(texts[-2]):
                values += _UNREAD
            else:
                for pattern in _ATTRIBUTES[2:]:
                    value = pattern.search(low, place, head)
                    values.append(_plain(html[value.start(1):value.end(1)]) if value else b"")
            found.append((*values, *texts, None if _ID.search(values[1]) else html[place:end]))
            continue
        found.append((values[0], *_OFFLINE))
    return found


_UNREAD = [None] * (len(ATTRIBUTES) - 2)
_OFFLINE = [None] * (len(FIELDS) - 1)
_ROW = pa.struct([pa.field(name, pa.binary()) for name in FIELDS])


def _listed(html: pa.Array) -> pa.Array:
    offsets, rows = [0], []
    for page in html:
        page = page.as_py()
        if page is not None:
            rows += _items(page)
        offsets.append(len(rows))
    columns = zip(*rows) if rows else [()] * len(FIELDS)
    items = pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in columns], fields=list(_ROW))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def page_items(html: Column) -> Column:
    """The items of a page (binary), as an array of structs of ``FIELDS``."""
    return F.arrow_udf(_listed, f"array<struct<{', '.join(f'{name}: binary' for name in FIELDS)}>>")(html)
