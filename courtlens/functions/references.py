"""Character references of HTML as their characters, the way browsers and the standard library read them."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference behind its ampersand: a number in decimal or hex, or what may be a name.
_REFERENCE = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that count without a semicolon, too, whatever follows them.
_BARE = {k: v for k, v in html5.items() if not k.endswith(";")}
_LONGEST = max(map(len, _BARE))


def _listed(names: dict[str, str]) -> str:
    """Names and their characters as one text, a constant that plans carry around at little cost (a map is hashed anew by
    each rule). Names that have a bare form, which are those that pages use most, come first."""
    order = sorted(names, key=lambda k: (k.rstrip(";") not in _BARE, len(k)))
    return "\x01" + "".join(f"{k}\x02{names[k]}\x01" for k in order)


def _look(listed: str, name: Column) -> Column:
    """The characters of a name (one or two); null if it isn't listed."""
    at = F.instr(F.lit(listed), F.concat(F.lit("\x01"), name, F.lit("\x02")))
    return F.when(at > 0, F.substring_index(F.substr(F.lit(listed), at + F.length(name) + 2, F.lit(3)), "\x01", 1))


def _named(s: Column, unclosed: bool = True) -> Column:
    """The characters of a name, else of the longest name without semicolon that it begins with, and the rest of it."""
    every, bare = _listed(html5), _listed(_BARE)
    if not unclosed:
        return F.coalesce(_look(every, s), F.concat(F.lit("&"), s))
    begun = F.transform(F.array(*[F.substring(s, 1, n) for n in range(_LONGEST, 1, -1)]), lambda x: F.concat(_look(bare, x), F.substr(s, F.length(x) + 1)))
    return F.coalesce(_look(every, s), F.get(F.filter(begun, lambda x: x.isNotNull()), 0), F.concat(F.lit("&"), s))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value written down once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _numbered(s: Column) -> Column:
    """The character of a number: those of Windows-1252 for 0x80 to 0x9F, nothing for what is no character."""
    windows = "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0))

    def number(digits: Column) -> Column:
        # longer numbers are beyond all characters
        value = F.when(F.lower(F.substring(s, 2, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        return F.when(digits == "", F.lit(0)).when(F.length(digits) > 7, F.lit(0x110000)).otherwise(value)

    def char(n: Column) -> Column:
        none = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd")).when(n.between(0x80, 0x9F), F.substr(F.lit(windows), n - 127, F.lit(1)))
            .when(none, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    return held(held(F.regexp_replace(s, "^#[xX]?0*|;$", ""), number), char)


def unescape(c: Column, unclosed: bool = True) -> Column:
    """Text with its references resolved, each once: an ampersand that was written as a reference begins no other one.

    Names are those of HTML with their semicolon; those that older pages write without one are known so as well, also
    with letters right behind them. Without ``unclosed`` only what ends with a semicolon is a reference, so one that was cut
    off stays as it is written. Text without ampersands stays as it is; null stays null.
    """
    char = lambda s: F.when(F.startswith(s, F.lit("#")), _numbered(s)).otherwise(_named(s, unclosed))
    none = lambda s: (s == "") if unclosed else ~F.endswith(s, F.lit(";"))
    piece = lambda p: held(F.regexp_extract(p, _REFERENCE, 1), lambda s: F.when(none(s), p).otherwise(F.concat(char(s), F.substr(p, F.length(s) + 2))))
    return held(c, lambda x: F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(F.split(x, "(?=&)"), piece), "")).otherwise(x))
