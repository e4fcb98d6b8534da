"""Link, heading and page text as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import sql_literal

_ARTICLE = r"(?is)<article\b[^>]*>(.*)</article>"
_HEADING = r"(?is)<h1\b[^>]*>(.*?)</h1>"

_BLOCK_TAG = (
    r"(?i)</?(?:p|div|ul|ol|li|h[1-6]|br|hr|tr|table|section|article|header|footer|blockquote|pre)\b[^>]*>"
)
# comments, scripts and styles with their content (to the end of the text where they are left
# open), then any other tag; every alternative starts with the same character, so text between
# tags is skipped at once
_UNSEEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)|(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\z)"
    r"|/?[a-z][^>]*>|[!?][^>]*>)"
)

# Named character entities.
_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®",
    "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "euro": "€",
}

TOKEN = "[a-z0-9+#]+"


def normalize_link(link: Column) -> Column:
    """The link up to its first `?`; a fragment without a query stays."""
    return F.substring_index(link, "?", 1)


def strip_commas(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def article_html(html: Column) -> Column:
    return F.regexp_extract(html, _ARTICLE, 1)


def heading_html(html: Column) -> Column:
    return F.regexp_extract(html, _HEADING, 1)


def html_to_text(html: Column) -> Column:
    """Plain text of an HTML fragment: tags, images, scripts, styles and comments dropped,
    link text kept, one line per block element, blanks squeezed."""
    text = html
    for blank in "\t\r\n\f":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    text = F.regexp_replace(text, _BLOCK_TAG, "\n")
    text = F.regexp_replace(text, _UNSEEN, "")
    text = decode_entities(text)
    text = F.regexp_replace(text, " {2,}", " ")
    text = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    text = F.regexp_replace(text, "\n{2,}", "\n")
    return F.trim(text, F.lit(" \n"))


def decode_entities(text: Column) -> Column:
    """Character references undone in one pass: `&lt;`, `&#60;` and `&#x3c;` become `<`,
    `&amp;lt;` becomes `&lt;`, and what is no known reference stays."""
    pairs = ", ".join(f"{sql_literal(name + ';')}, {sql_literal(char)}" for name, char in _ENTITIES.items())
    names = F.expr(f"map({pairs})")

    def decoded(piece: Column) -> Column:
        # a piece follows an `&`; its reference, if any, ends with the first `;`
        end = F.instr(piece, ";")
        name = piece.substr(F.lit(1), end)
        char = F.coalesce(F.try_element_at(names, name), F.when(F.startswith(piece, F.lit("#")), _numbered(name)))
        return F.coalesce(F.concat(char, piece.substr(end + 1, F.length(piece))), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    return F.array_join(F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(decoded(piece))), "")


def _numbered(reference: Column) -> Column:
    """The character of `#65;` or `#x41;`, null if there is none."""
    decimal = F.regexp_extract(reference, "^#([0-9]{1,7});$", 1).try_cast("int")
    hexadecimal = F.conv(F.nullif(F.regexp_extract(reference, "^#[xX]([0-9a-fA-F]{1,6});$", 1), F.lit("")), 16, 10)
    code = F.coalesce(decimal, hexadecimal.try_cast("int"))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), char)


def date_stamp(day: Column) -> Column:
    return F.date_format(day, "dd-MM-yyyy")


def flag_text(flag: Column) -> Column:
    """A boolean as the raw files spell it: `True` or `False`."""
    return F.initcap(flag.cast("string"))


def tokens(text: Column) -> Column:
    """Lower-case words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
