"""URL extraction, URL parts, shortener and registry-number signals, input markers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Java regular expressions fold case and classes over Unicode only with these flags.
FLAGS = "(?iuU)"

# URL syntax and the domain endings that count without a scheme.
_STOP = r"\s\x1c-\x1f<>\"'"
SCHEME_URL = FLAGS + r"\bhttps?://[^" + _STOP + r"]+"
TLDS = r"com|net|org|tr|com\.tr|gov\.tr|info|xyz|top|click|link|ly|gl|me|io|biz|co"
TRAILING_PUNCTUATION = r"[.,;:!?)\]'\"]+$"

# The host part is written as one character class, which the regex engine scans without
# recursion (a repeated label group overflows the stack on hostile input such as
# thousands of one-letter labels). Dots next to a dot can never separate labels, so they
# are masked first and restored in the result.
_MASK = "\U0010ffff"
BARE_DOMAIN = FLAGS + r"\b[a-z0-9-][a-z0-9.-]*\.(?:" + TLDS + r")\b(?:/[^" + _STOP + r"]*)?"

# Public link shorteners.
SHORTENER_DOMAINS = (
    "bit.ly",
    "tinyurl.com",
    "cutt.ly",
    "dub.sh",
    "goo.gl",
    "is.gd",
    "ow.ly",
    "t.co",
    "rebrand.ly",
    "shorturl.at",
    "tiny.cc",
    "buff.ly",
    "bit.do",
    "soo.gd",
    "s.id",
    "adf.ly",
    "tr.im",
    "v.gd",
    "clck.ru",
    "qr.ae",
    "shorte.st",
    "rb.gy",
    "cli.re",
    "shrtco.de",
)
SHORTENER_MARKER = "[SHORTENER_VAR]"

# Trade-registry number syntax.
MERSIS = FLAGS + r"\b(?:mersis(?:\s*no)?|mrs|mn)\s*:\s*\d{10,16}\b"
MERSIS_MARKER = "[MERSIS_VAR]"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _matches(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, TRAILING_PUNCTUATION, ""))


def extract_urls(text: Column | str) -> Column:
    """All URLs: every scheme match, then bare domains not contained in one kept so far."""
    column = _col(text)
    scheme = _matches(column, SCHEME_URL)
    masked = F.regexp_replace(column, r"\.(?=\.)|(?<=\.)\.", _MASK)
    found = F.regexp_extract_all(masked, F.lit(BARE_DOMAIN), F.lit(0))
    bare = F.transform(
        found, lambda u: F.regexp_replace(F.replace(u, F.lit(_MASK), F.lit(".")), TRAILING_PUNCTUATION, "")
    )
    return F.aggregate(
        bare,
        scheme,
        lambda kept, url: F.when(F.exists(kept, lambda k: F.contains(k, url)), kept).otherwise(
            F.concat(kept, F.array(url))
        ),
    )


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_authority(url: Column | str) -> Column:
    """The part between ``//`` and the next ``/``, ``?`` or ``#``."""
    return F.regexp_extract(_col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def url_host(url: Column | str) -> Column:
    """Lower-case host without user info and port; empty when there is none."""
    authority = url_authority(url)
    return F.lower(
        F.when(authority.contains("["), F.regexp_extract(authority, r"\[([^\]]*)\]", 1)).otherwise(
            F.regexp_extract(authority, r"^(?:.*@)?([^:@]*)", 1)
        )
    )


def domain_of(url: Column | str) -> Column:
    """Host of a URL with or without a scheme, with one leading ``www.`` removed."""
    column = _col(url)
    full = F.when(column.contains("://"), column).otherwise(F.concat(F.lit("http://"), column))
    return F.regexp_replace(url_host(full), r"^www\.", "")


def shortener_in(urls: Column) -> Column:
    """Whether an array of extracted URLs has a public shortener."""
    known = F.array(*[F.lit(d) for d in SHORTENER_DOMAINS])
    return F.arrays_overlap(F.transform(urls, domain_of), known)


def has_generic_shortener(text: Column | str) -> Column:
    return shortener_in(extract_urls(text))


def mark_shortener(text: Column | str) -> Column:
    column = _col(text)
    return F.when(has_generic_shortener(column), F.concat(F.lit(SHORTENER_MARKER + " "), column)).otherwise(column)


def has_mersis_number(text: Column | str) -> Column:
    return _col(text).rlike(MERSIS)


def mark_mersis(text: Column | str) -> Column:
    column = _col(text)
    return F.when(has_mersis_number(column), F.concat(F.lit(MERSIS_MARKER + " "), column)).otherwise(column)


def mark_all(text: Column | str, urls: Column | str | None = None) -> Column:
    """Both markers; the shortener marker comes first. ``urls`` are the text's URLs where they are known already.

    The marker texts hold no URL and no digits, so both tests can read the unmarked text.
    """
    column = _col(text)
    shortener = has_generic_shortener(column) if urls is None else shortener_in(_col(urls))
    return F.concat(
        F.when(shortener, SHORTENER_MARKER + " ").otherwise(""),
        F.when(has_mersis_number(column), MERSIS_MARKER + " ").otherwise(""),
        column,
    )
