"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Host (with port) in lower case without www., '' if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^?#\s]*)", 1)


def valid_http_url(url: Column) -> Column:
    """http or https, a host, no user, no white space or control characters, a port of digits if any."""
    return F.coalesce(url.rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://[^/?#@\s:]+(:[0-9]+)?([/?#].*)?$") & ~url.rlike(r"[\s\x00-\x1f\x7f]"), F.lit(False))


def canonical_url(url: Column) -> Column:
    """Host and path without the slash at the end; 'invalid:' and the url where there is no valid address."""
    bare = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""))
    return F.when(valid_http_url(url), bare).otherwise(F.concat(F.lit("invalid:"), url))


def belongs_to_outlet(url: Column, domain: Column) -> Column:
    return F.coalesce(host(url) == F.regexp_replace(F.lower(domain), r"^www\.", ""), F.lit(False))


def section_of(url: Column) -> Column:
    """First part of a path of two parts or more."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, parts[0])


def content_id(prefix: str, c: Column, length: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(c), 1, length))


def own_outlet(outlet: Column, url: Column, names: tuple[str, ...], domain: str) -> Column:
    """Whether a report is one's own: the outlet's name is one of names, or its host the domain or below it."""
    bare = F.regexp_replace(host(url), r":[0-9]+$", "")
    return F.coalesce(F.lower(F.trim(outlet)).isin(*[n.lower() for n in names]), F.lit(False)) | F.coalesce((bare == domain) | bare.endswith(f".{domain}"), F.lit(False))


#: Keys of a page's image, by preference.
IMAGE_KEYS = ("og:image:secure_url", "og:image", "og:image:url", "twitter:image", "twitter:image:src")


def meta_content(html: Column, key: str) -> Column:
    """Content of the first meta tag of a key (its property or name), whichever of both comes first; NULL if none."""
    name, content = rf"""(?:property|name)=["']{key}["']""", r"""content=["']([^"']*)["']"""
    after, before = (F.regexp_extract(html, p, 1) for p in (rf"<meta[^>]*{name}[^>]*{content}", rf"<meta[^>]*{content}[^>]*{name}"))
    return F.nullif(F.coalesce(F.nullif(after, F.lit("")), before), F.lit(""))


def absolute(link: Column, page: Column) -> Column:
    """A link of a page as an http(s) address, NULL if it is none."""
    scheme, base = F.regexp_extract(page, r"^(https?):", 1), F.regexp_extract(page, r"^(https?://[^/?#]*)", 1)
    folder = F.regexp_extract(page, r"^(https?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    under = F.when(folder.endswith("/"), F.concat(folder, link)).otherwise(F.concat(folder, F.lit("/"), link))
    return F.when(link.rlike("^https?://."), link).when(link.rlike("^//."), F.concat(scheme, F.lit(":"), link)).when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(link.startswith("/"), F.concat(base, link)).otherwise(under)


def page_image(html: Column, page: Column) -> Column:
    """The representative image of a page: the first key of IMAGE_KEYS that gives an http(s) address."""
    return F.coalesce(*[absolute(F.trim(F.replace(meta_content(html, k), F.lit("&amp;"), F.lit("&"))), page) for k in IMAGE_KEYS])


def page_date(html: Column) -> Column:
    """Publication date of a page as it stands: of its JSON-LD record, else of its article tag."""
    return F.coalesce(F.nullif(F.regexp_extract(html, r'"datePublished"\s*:\s*"([^"]+)"', 1), F.lit("")), meta_content(html, "article:published_time"))
