"""Visible text of HTML as column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def _element(name: str) -> str:
    """An element whose content is no markup: up to its end tag, with or without attributes, or the end of the page."""
    return rf"<{name}(?:[\s/][^>]*)?>.*?(?:</{name}(?:[\s/][^>]*)?>|\z)"


COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
TAG = r"""</?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>|<[!?/][^>]*>|</?[A-Za-z][^>]*>"""
TITLE = r"<title(?:[\s/][^>]*)?>(.*?)(?:</title(?:[\s/][^>]*)?>|\z)"
# One scan from left to right: what is found first swallows all that looks like markup inside of it.
MARKUP = f"(?is){_element('script')}|{_element('style')}|{COMMENT}|{TAG}"
TOKENS = f"(?is){_element('script')}|{_element('style')}|{COMMENT}|{TITLE}|{TAG}"
REFERENCES = r"(?s)&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"
BLANK = r"[\x09-\x0D\x20\x{A0}]+"

# Named references by their first two letters, so that a look-up passes few names.
NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
# Numbers that stand for characters of an old code page, as pages mean them.
OLD = {number: bytes([number]).decode("cp1252") for number in range(0x80, 0xA0) if number not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
UNKNOWN = "�"


def _by_letters() -> Column:
    nested: dict[str, dict[str, str]] = {}
    for name, text in NAMED.items():
        nested.setdefault(name[:2], {})[name] = text
    return F.from_json(F.lit(json.dumps(nested)), "map<string,map<string,string>>")


def _character(number: Column) -> Column:
    """The character with this number; what is none becomes the replacement character."""
    old = F.from_json(F.lit(json.dumps({str(k): v for k, v in OLD.items()})), "map<string,string>")
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    return F.when(number.between(0x80, 0x9F) & old[number.cast("string")].isNotNull(), old[number.cast("string")]).when(
        valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(UNKNOWN)


def decode_references(text: Column) -> Column:
    """Named and numeric character references that end in a semicolon become characters, once; others stay."""
    named = _by_letters()

    def decode(token: Column) -> Column:
        name = F.substr(token, F.lit(2), F.length(token) - 2)
        lower = F.lower(F.substr(token, F.lit(1), F.lit(3)))
        whole = F.endswith(token, F.lit(";")) & F.startswith(token, F.lit("&"))
        return (F.when(~whole, token)
                .when(lower == "&#x", _character(F.conv(F.substr(name, F.lit(3)), 16, 10).cast("long")))
                .when(F.startswith(token, F.lit("&#")), _character(F.substr(name, F.lit(2)).cast("long")))
                .otherwise(F.coalesce(named[F.left(name, F.lit(2))][name], token)))

    tokens = F.regexp_extract_all(text, F.lit(REFERENCES), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(tokens, decode), "")).otherwise(text)


def visible_text(html: Column) -> Column:
    """Without scripts, styles, comments and tags, references decoded, white space squeezed."""
    bare = F.regexp_replace(html, MARKUP, " ")
    return F.trim(F.regexp_replace(decode_references(bare), BLANK, " "))


def title(html: Column) -> Column:
    """Text of the first title outside of scripts, styles and comments; empty if there is none."""
    found = F.filter(F.regexp_extract_all(html, F.lit(TOKENS), F.lit(0)), lambda t: F.lower(F.left(t, F.lit(6))) == "<title")
    inner = F.regexp_extract(F.get(found, F.lit(0)), f"(?is)^{TITLE}", 1)
    return F.coalesce(visible_text(inner), F.lit(""))
