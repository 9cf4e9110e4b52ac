"""Columns over page source.

Pages are read as text with patterns instead of a parsed tree: hidden parts
(comments, scripts, styles, templates) are cut out first, text is what lies
between tags, and an element reaches to the matching end tag.

``visible_source`` also decodes character references, once per page.  The four
that would look like markup are kept apart as Unicode noncharacters (which no
valid text contains) until ``plain`` restores them in what was extracted.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions.text import SPACE, let, map_literal, strip

# Tag content with quoted attribute values, which may hold ">".  All repeated
# groups are possessive: those run as loops, others recurse and could exhaust
# the stack on a tag with very many attributes.
ATTRS = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
_TAG = rf"""<[!/?a-zA-Z](?:{ATTRS}>|[^>]*+>)"""
# One attempt per "<", which both kinds start with.
_HIDDEN = rf"(?is)<(?:!--.*?(?:-->|\z)|(script|style|template|rt|rp)\b{ATTRS}>.*?(?:</\1\s*>|\z))"
# Tags with the whitespace around them; a run of whitespace is tried from its start only.
_BETWEEN_NODES = rf"(?:(?<!{SPACE}){SPACE}++)?+(?:{_TAG}{SPACE}*+)++"
_MARKUP_CHARS = "<>\"'"
_SET_ASIDE = "\ufdd0\ufdd1\ufdd2\ufdd3"


def decode_entities(c: Column) -> Column:
    """Named and numeric character references; markup characters stay set aside."""
    aside = dict(zip(_MARKUP_CHARS, _SET_ASIDE, strict=True))
    named = {f"&{name};": aside.get(chr(code), chr(code)) for name, code in name2codepoint.items()}
    names = map_literal({**named, "&apos;": aside["'"]})

    def decode_piece(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"\A&#([xX]?[0-9a-fA-F]{1,7});\z", 1)
        from_hex = F.conv(F.ltrim(digits, F.lit("xX")), 16, 10)
        code = F.when(digits.rlike(r"\A[xX]"), from_hex).otherwise(digits).try_cast("int")
        usable = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        letter = F.when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        numeric = F.translate(letter, _MARKUP_CHARS, _SET_ASIDE)
        return F.when(piece.rlike(r"\A&[^;]+;\z"), F.coalesce(F.try_element_at(names, piece), numeric, piece)).otherwise(
            piece
        )

    def decode(s: Column) -> Column:
        pieces = F.transform(F.split(s, r"(?=&)|(?<=;)"), decode_piece)
        return F.when(s.contains("&"), F.array_join(pieces, "")).otherwise(s)

    return let(c, decode)


def visible_source(html: Column) -> Column:
    """Page source without hidden parts; each leaves an empty tag as separator."""
    return decode_entities(F.regexp_replace(html, _HIDDEN, "<!>"))


def plain(c: Column) -> Column:
    """Extracted text with the set-aside characters back in place."""
    return F.translate(c, _SET_ASIDE, _MARKUP_CHARS)


def inner_text(source: Column, separator: str) -> Column:
    """The text nodes of visible source, each stripped, joined by ``separator``: a space or nothing."""
    return plain(strip(F.regexp_replace(source, _BETWEEN_NODES, separator)))


def page_text(visible: Column) -> Column:
    """Text of a page as the extraction rules see it (their scan is 5,000 characters)."""
    return F.left(inner_text(visible, " "), F.lit(5000))


def _up_to_value(name: str) -> str:
    """Pattern from inside an opening tag to the value of its first attribute of a name."""
    here = rf"(?i:{name})\s*="
    return (
        rf"""(?:[^"'>\s/]++|[\s/](?!{here})|"[^"]*+"(?!{here})|'[^']*+'(?!{here}))*+"""
        rf"""(?:[\s/]|"[^"]*+"|'[^']*+'){here}\s*+"""
    )


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag; empty if the tag does not have it."""
    pattern = rf"""(?s)\A<{_up_to_value(name)}(["']?)(.*?)\1(?=[\s/>]|\z)"""
    return plain(F.regexp_extract(tag, pattern, 2))


def tag_where(name: str, attribute_name: str, value: str) -> str:
    """Pattern of the opening tag of an element with an attribute value that fits."""
    return (
        rf"""<(?i:{name})(?=[\s/]){_up_to_value(attribute_name)}"""
        rf"""(?:"{value}"|'{value}'|{value}(?=[\s>])){ATTRS}>"""
    )


ANY_ELEMENT = r"[a-z][^\s/>]*+"


def first_tag(source: Column, pattern: str) -> Column:
    """The first opening tag that fits; empty if none does."""
    return F.regexp_extract(source, f"(?s){pattern}", 0)


def source_from(source: Column, pattern: str) -> Column:
    """Source from the first opening tag that fits to the end; empty if none does."""
    return F.regexp_extract(source, f"(?s)({pattern}.*)", 1)


def leading_element(column: str) -> Column:
    """Source of the element a column starts with, up to its own end tag.

    The source is cut at every opening and closing tag of the same name, and
    the pieces are counted until as many were closed as opened.
    """
    return F.expr(
        rf"""
        CASE WHEN lower(regexp_extract({column}, '^<([a-zA-Z]+)', 1)) IN
          ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'wbr')
        THEN regexp_extract({column}, '^<[^>]*>', 0)
        WHEN {column} <> '' THEN transform(
          array(split({column}, concat('(?i)(?=</?\\Q',
            regexp_extract({column}, '^<([a-zA-Z][^\\s/>]*)', 1), '\\E[\\s/>])'))),
          pieces -> array_join(slice(pieces, 1, aggregate(
            pieces,
            struct(0 AS depth, 0 AS seen),
            (s, piece) -> if(s.depth < 0, s, struct(
              if(s.depth = 1 AND startswith(piece, '</'), -1,
                 s.depth + if(startswith(piece, '</'), -1, 1)) AS depth,
              s.seen + 1 AS seen)),
            s -> if(s.depth < 0, s.seen - 1, s.seen))), ''))[0]
        ELSE '' END
        """
    )


def heading(source: Column, name: str) -> Column:
    """Source of the first element of a kind that does not nest (h1, title)."""
    return F.regexp_extract(source, rf"(?is)<{name}\b{ATTRS}>(.*?)(?:</{name}\s*>|\z)", 1)


def opening_tag(element: Column) -> Column:
    return F.regexp_extract(element, rf"\A{_TAG}", 0)
