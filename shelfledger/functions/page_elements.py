"""Element look-up in one HTML page: the raw texts the extraction works on.

A small helper for use inside tasks. It keeps no tree, only the open elements;
all clean-up and every choice between the texts is done by column expressions.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)

# Parts of attribute values that mark prices, galleries and breadcrumbs.
STATIC_PRICE = (("class", "price"), ("class", "Price"), ("data-testid", "price"))
RENDERED_PRICE = (
    ("class", "price__value"),
    ("class", "Price__value"),
    ("data-testid", "price"),
    ("class", "pip-price"),
    ("class", "ProductPrice"),
)
GALLERY = ("gallery", "media", "carousel", "MediaGallery")
JSON_LD = "application/ld+json"


class PageElements(HTMLParser):
    """Collects the wanted elements of one page in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = []
        self.open_tags = Counter()
        self.trails = self.galleries = 0
        self.text = []
        self.json_ld = []
        self.meta = {}
        self.h1 = None
        self.static_price = self.rendered_price = self.rendered_price_content = None
        self.gallery = []
        self.crumbs = []

    def handle_starttag(self, tag, attrs):
        # The first of repeated attributes counts.
        values = {name: value or "" for name, value in reversed(attrs)}
        uses = self._uses(tag, values)
        if tag in _VOID:
            self._fill(uses, len(self.text))
            return
        trail, gallery = _is_trail(tag, values), _is_gallery(values)
        self.open.append((tag, len(self.text), uses, trail, gallery))
        self.open_tags[tag] += 1
        self.trails += trail
        self.galleries += gallery

    def handle_startendtag(self, tag, attrs):
        # A slash does not close an ordinary element in HTML.
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        self.text.append(data)

    def handle_endtag(self, tag):
        """Close the nearest open element of this name and all inside it."""
        if self.open_tags[tag]:
            while self._leave() != tag:
                pass

    def close(self):
        super().close()
        while self.open:
            self._leave()

    def _leave(self):
        tag, start, uses, trail, gallery = self.open.pop()
        self.open_tags[tag] -= 1
        self.trails -= trail
        self.galleries -= gallery
        self._fill(uses, start)
        return tag

    def _fill(self, uses, start):
        if uses:
            text = "".join(self.text[start:])
            for target, place in uses:
                target[place] = text

    def _uses(self, tag, values):
        """Where the element's text goes; its place is taken when it opens."""
        uses = []
        if tag == "script" and values.get("type", "").lower() == JSON_LD:
            uses.append(_next_place(self.json_ld))
        if tag == "h1" and self.h1 is None:
            self.h1 = [""]
            uses.append((self.h1, 0))
        if tag == "meta":
            content = values.get("content", "")
            for kind in ("property", "name"):
                if kind in values:
                    self.meta.setdefault((kind, values[kind]), content)
        if self.static_price is None and _has_part(values, STATIC_PRICE):
            self.static_price = [""]
            uses.append((self.static_price, 0))
        priced = _has_part(values, RENDERED_PRICE) or values.get("itemprop") == "price"
        if self.rendered_price is None and priced:
            self.rendered_price = [""]
            self.rendered_price_content = values.get("content")
            uses.append((self.rendered_price, 0))
        if tag == "img" and self.galleries:
            self.gallery.append((values.get("src", ""), values.get("data-src", "")))
        if tag == "a" and self.trails:
            uses.append(_next_place(self.crumbs))
        return uses


def _next_place(texts):
    texts.append("")
    return texts, len(texts) - 1


def _has_part(values, parts):
    return any(part in values.get(name, "") for name, part in parts)


def _is_trail(tag, values):
    label = values.get("aria-label", "")
    return (
        "breadcrumb" in values.get("class", "")
        or "breadcrumb" in label
        or (tag == "nav" and "read" in label)
    )


def _is_gallery(values):
    return any(part in values.get("class", "") for part in GALLERY)


def page_elements(html: str | None) -> dict:
    page = PageElements()
    page.feed(html or "")
    page.close()
    return {
        "json_ld": page.json_ld,
        "h1": _only(page.h1),
        "og_title": page.meta.get(("property", "og:title")),
        "og_description": page.meta.get(("property", "og:description")),
        "og_image": page.meta.get(("property", "og:image")),
        "description": page.meta.get(("name", "description")),
        "static_price": _only(page.static_price),
        "rendered_price": _only(page.rendered_price),
        "rendered_price_content": page.rendered_price_content,
        "gallery": page.gallery,
        "crumbs": page.crumbs,
    }


def _only(texts):
    return texts[0] if texts else None
