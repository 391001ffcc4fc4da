"""Structured data of a page, cut down to what the extraction reads.

A small helper for use inside tasks. A block may be of any size and repeat a
name, of which the last counts; it leaves as a few short fields, so that column
expressions can go on with it. Text that is no JSON leaves as a reason.
"""

from __future__ import annotations

import json
import math

# What a script's text is trimmed of, the type that counts, and the images kept.
_SPACE = "\t\n\v\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_PRODUCT = "Product"
_IMAGES = 6


def read_block(text: str) -> tuple[str | None, str | None]:
    """The block's fields as JSON and None, or None and why it cannot be read."""
    try:
        value = json.loads(text.strip(_SPACE), parse_constant=_no_constant)
    except json.JSONDecodeError as error:
        return None, f"{error.msg} at {error.pos}"
    except RecursionError:
        return None, "Nested too deeply"
    except ValueError as error:
        return None, str(error)
    return json.dumps(_block(value), ensure_ascii=False), None


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


def _block(value):
    if isinstance(value, list):
        return _items(value)
    graph = value.get("@graph") if isinstance(value, dict) else None
    if isinstance(graph, list):
        return _items(graph)
    # Of other graphs, those that count as given hold no item.
    return [] if graph or isinstance(graph, dict) else _items([value])


def _items(values: list) -> list:
    """Products, and the nulls that end a block."""
    wanted = [v for v in values if v is None or (isinstance(v, dict) and v.get("@type") == _PRODUCT)]
    return [None if v is None else _product(v) for v in wanted]


def _product(item: dict) -> dict:
    out = {"@type": _PRODUCT}
    for name in ("name", "description"):
        if name in item:
            out[name] = _plain(item[name])
    if "offers" in item:
        offers = item["offers"]
        out["offers"] = [_offer(o) for o in offers[:1]] if isinstance(offers, list) else _offer(offers)
    if "image" in item:
        image = item["image"]
        out["image"] = [_plain(i) for i in image if isinstance(i, str)][:_IMAGES] if isinstance(image, list) else _plain(image)
    return out


def _offer(offer):
    if isinstance(offer, dict):
        return {"price": _plain(offer["price"])} if "price" in offer else {}
    return _plain(offer)


def _plain(value):
    """Text and numbers as they are; of lists and objects only that they are there."""
    if isinstance(value, str):
        # Halves of a character pair that stand alone are no text.
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, list):
        return []
    if isinstance(value, dict):
        return {}
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) >= 1 << 63:
        value = float(value) if value.bit_length() < 1024 else math.inf
    # The largest number stands for those beyond it.
    return math.copysign(1.7976931348623157e308, value) if isinstance(value, float) and math.isinf(value) else value
