"""Text clean-up used by catalogue search and page extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfledger.functions.coerce import WHITESPACE, leading_float

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Store names by host, category patterns in order, image words to reject.
STORE_HOSTS = (("homedepot.com", "Home Depot"), ("lowes.com", "Lowe's"))
OTHER = "Other"
CATEGORY_PATTERNS = (
    ("Flooring", "floor|tile|hardwood|laminate|vinyl plank|carpet"),
    ("Vanity", "vanit|bath|medicine cabinet|sink"),
    ("Tools", "tool|drill|saw|hardware|fastener"),
)
REJECTED_IMAGE_WORDS = ("placeholder", "data:")
PRICE_PATTERN = r"([\d,]+\.?\d{0,2})"
MAX_IMAGES = 6


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def collapse_space(text: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def contains_pattern(text: Column, term: str) -> Column:
    """Substring test in which only ASCII letters ignore case.

    ``%`` and ``_`` in the term stay wildcards; a backslash is a plain
    character. A NULL text is no match rather than unknown.
    """
    # Only ASCII letters are folded, on both sides.
    folded = "".join(c.lower() if c in _UPPER else c for c in term)
    pattern = "%" + folded.replace("\\", "\\\\") + "%"
    return F.coalesce(ascii_lower(text).like(pattern), F.lit(False))


def store_of_url(url: Column) -> Column:
    label = None
    for host, name in STORE_HOSTS:
        label = F.when(url.contains(host), name) if label is None else label.when(
            url.contains(host), name
        )
    return label.otherwise(OTHER)


def category_of_crumbs(crumbs: Column) -> Column:
    """First category whose pattern occurs in the joined trail; NULL without a trail."""
    trail = F.lower(F.array_join(crumbs, " "))
    label = F.when(F.size(crumbs) == 0, F.lit(None).cast("string"))
    for name, pattern in CATEGORY_PATTERNS:
        label = label.when(trail.rlike(pattern), name)
    return label.otherwise(OTHER)


def price_of_text(text: Column) -> Column:
    """First run of digits and commas; only its first comma is dropped."""
    run = F.regexp_extract(text, PRICE_PATTERN, 1)
    return leading_float(F.regexp_replace(run, "^([^,]*),", "$1"))


def title_head(title: Column) -> Column:
    return trim_space(F.element_at(F.split(title, r"\|"), 1))


def usable_images(urls: Column) -> Column:
    def usable(url: Column) -> Column:
        keep = url.startswith("http")
        for word in REJECTED_IMAGE_WORDS:
            keep = keep & ~url.contains(word)
        return keep

    return F.slice(F.filter(urls, usable), 1, MAX_IMAGES)
