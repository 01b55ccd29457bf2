"""Text clean-up expressions that stay in the JVM."""

from __future__ import annotations

import html.entities
import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.expr import col

# fixed patterns
URL = r"https?://\S+|www\.\S+"
MENTION = r"(?U)@\w+"
HASHTAG = r"(?U)#\w+"
SPACE = r"(?U)\s+"
NON_WORD = r"(?U)[^a-z0-9#@!?'\s]"
WORD = r"[\p{L}\p{N}_]{2,}"
FENCE = "```"
BULLET = r"(?md)^\s*[-*]\s"
HEADER = r"(?md)^\s*#{1,6}\s"


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Letters whose compatibility form is one base letter plus marks, by rule over the Latin blocks."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(text) -> Column:
    src, dst = _accent_table()
    return F.regexp_replace(F.translate(col(text), src, dst), r"\p{M}+", "")


@lru_cache(maxsize=1)
def _entities() -> tuple[str, str]:
    named = {k: v for k, v in html.entities.html5.items() if k.endswith(";")}
    bare = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    return json.dumps({**named, **{k: html.entities.html5[k] for k in bare}}), "|".join(bare)


@lru_cache(maxsize=1)
def _c1_table() -> str:
    """Character references 128..159 mean the Windows-1252 characters."""
    out = {}
    for n in range(128, 160):
        try:
            out[str(n)] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            out[str(n)] = chr(n)
    out["0"] = "�"
    return json.dumps(out)


def _from_code_point(n: Column) -> Column:
    bad = (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    special = F.try_element_at(F.from_json(F.lit(_c1_table()), "map<string,string>"), n.cast("string"))
    safe = F.when(bad, F.lit(0xFFFD)).otherwise(n)
    # control characters and non-characters vanish
    nothing = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
    return F.when(bad, F.lit("�")).when(nothing, F.lit("")).otherwise(
        F.coalesce(special, F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")))


def unescape_html(text) -> Column:
    """Named (with or without semicolon) and numeric character references, one pass, left to right."""
    text = col(text)
    table, bare = _entities()
    names = F.from_json(F.lit(table), "map<string,string>")

    def piece(p: Column) -> Column:
        dec = F.regexp_extract(p, r"^&#([0-9]+);?", 1)
        hexa = F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]+);?", 1)
        full = F.regexp_extract(p, r"^&([A-Za-z0-9]+;)", 1)
        short = F.regexp_extract(p, f"^&({bare})", 1)
        n = F.when(dec != "", F.coalesce(dec.try_cast("long"), F.lit(0x110000))).when(
            hexa != "", F.when(F.length(hexa) > 8, F.lit(0x110000)).otherwise(F.conv(hexa, 16, 10).cast("long")))
        by_name = F.when(full != "", F.try_element_at(names, full))
        by_short = F.when(short != "", F.try_element_at(names, short))
        return (
            F.when(~p.startswith("&"), p)
            .when(n.isNotNull(), F.concat(_from_code_point(n), F.regexp_replace(p, r"^&#([0-9]+|[xX][0-9a-fA-F]+);?", "")))
            .when(by_name.isNotNull(), F.concat(by_name, F.regexp_replace(p, r"^&[A-Za-z0-9]+;", "")))
            .when(by_short.isNotNull(), F.concat(by_short, F.substring(p, F.length(short) + 2, F.length(p))))
            .otherwise(p)
        )

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "(?=&)"), piece), "")).otherwise(text)


def squeeze(text) -> Column:
    return F.trim(F.regexp_replace(col(text), SPACE, " "))


def clean_light(text) -> Column:
    """Entities resolved, URLs dropped, whitespace collapsed; case and punctuation kept."""
    return squeeze(F.regexp_replace(unescape_html(text), URL, " "))


def clean_full(text) -> Column:
    """Also lower-cased, mentions dropped, hash signs and non-word characters to spaces."""
    s = F.lower(F.regexp_replace(unescape_html(text), URL, " "))
    s = F.replace(F.regexp_replace(s, MENTION, " "), F.lit("#"), F.lit(" "))
    return squeeze(F.regexp_replace(s, NON_WORD, " "))


def url_unquote(text) -> Column:
    """Percent-decoding that leaves plus signs alone; a malformed text stays as it is."""
    text = col(text)
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text, F.lit(""))


def words(text) -> Column:
    """Whitespace tokens without empties."""
    return F.filter(F.split(col(text), SPACE), lambda t: t != "")


def count_of(text, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern))
