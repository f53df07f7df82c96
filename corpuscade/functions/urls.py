"""URL keys and normal forms."""

from __future__ import annotations

import posixpath
import re
from functools import lru_cache
from urllib.parse import parse_qsl, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the URL form: parameters that are dropped and ports that go without saying.
TRACKING = frozenset({"fbclid", "gclid"})
TRACKING_PREFIX = "utm_"
DEFAULT_PORT = {"https": 443, "http": 80}
# Fixed value: path endings that are never fetched.
SKIPPED_SUFFIXES = ("pdf", "zip", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "jpg", "jpeg", "png", "gif", "svg", "webp", "mp4", "mp3", "avi", "mov", "dmg", "exe")


@lru_cache(maxsize=4096)
def _query_form(query: str) -> str:
    kept = sorted((k, v) for k, v in parse_qsl(query, keep_blank_values=True) if not (k.lower().startswith(TRACKING_PREFIX) or k.lower() in TRACKING))
    return "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in kept)


def canonical_url(url: str | None) -> str | None:
    """The canonical form: lower-case scheme (default https) and host, no default port, resolved
    path that keeps its closing slash, sorted query without tracking parameters, no path
    parameters and no fragment.  Null where there is no host or the port can't be read."""
    if url is None:
        return None
    try:
        cut = urlsplit(url.strip())
        host, port = (cut.hostname or "").lower(), cut.port
    except ValueError:
        return None
    if not host:
        return None
    scheme = (cut.scheme or "https").lower()
    if port and DEFAULT_PORT.get(scheme) != port:
        host = f"{host}:{port}"
    raw = cut.path
    last = raw.rfind("/") + 1
    semi = raw.find(";", last)
    if semi >= 0:
        raw = raw[:semi]
    raw = raw or "/"
    path = posixpath.normpath(raw)
    if raw.endswith("/") and path[-1] != "/":
        path += "/"
    if path[0] != "/":
        path = "/" + path
    if path.startswith("//"):
        path = "//" + path if cut.netloc == "" else path
    query = _query_form(cut.query) if cut.query else ""
    return f"{scheme}://{host}{path}" + (f"?{query}" if query else "")


@F.pandas_udf(T.StringType())
def canonical_url_udf(urls: pd.Series) -> pd.Series:
    seen: dict = {}
    return urls.map(lambda u: seen[u] if u in seen else seen.setdefault(u, canonical_url(u)))


#: URLs of these shapes are their own canonical form, so only the others go to Python.
_PLAIN = r"^https?://[a-z0-9-]+(\.[a-z0-9-]+)+/([A-Za-z0-9_~-]+(\.[A-Za-z0-9_~-]+)*/?)*$"


def canonical_url_col(url: Column) -> Column:
    """:func:`canonical_url` as a column; plain URLs stay in the JVM's hands."""
    plain = url.rlike(_PLAIN) & ~url.rlike(r"/\.{1,2}(/|$)|//.*//")
    return F.when(plain, url).otherwise(canonical_url_udf(F.when(plain, F.lit(None).cast("string")).otherwise(url)))


def light_url_col(url: Column) -> Column:
    """The lighter form: only http(s), host part lower-case, no closing slash on the path, no
    fragment; query and path parameters stay as written.  Null for anything else."""
    clean = F.trim(url)
    no_fragment = F.regexp_replace(clean, "#.*$", "")
    scheme = F.lower(F.regexp_extract(no_fragment, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    netloc = F.lower(F.regexp_extract(no_fragment, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.regexp_extract(no_fragment, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(no_fragment, r"(\?.*)$", 1)
    # the closing slashes go from the path proper, before any path parameters
    params = F.regexp_extract(path, r"(;[^/]*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), "/+$", "")
    bare = F.when(bare == "", F.lit("/")).otherwise(bare)
    return F.when(scheme.isin("http", "https") & (netloc != ""), F.concat(scheme, F.lit("://"), netloc, bare, params, F.when(query == "?", F.lit("")).otherwise(query)))


def host_col(url: Column) -> Column:
    """Lower-case host without user, port and leading ``www.``; '' where there is none."""
    authority = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")), r"^www\.", "")


def netloc_col(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path_col(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def tenant_slug_col(url: Column) -> Column:
    """Host with dots as hyphens; ``university`` where there is no host."""
    host = host_col(url)
    return F.when(host == "", F.lit("university")).otherwise(F.translate(host, ".", "-"))


def document_id_col(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 12)


def page_key_col(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def first_segment_col(url: Column) -> Column:
    """First path segment, ``general`` where there is none."""
    segment = F.trim(F.split_part(F.regexp_replace(path_col(url), "^/+", ""), F.lit("/"), F.lit(1)))
    return F.when(segment == "", F.lit("general")).otherwise(segment)


def page_type_col(url: Column) -> Column:
    """Page type by the first rule that the path matches, without regard to case."""
    # The rules in their order.
    rules = (
        ("faculty", "/facult|/staff|/people|/professor|/researcher"),
        ("programs", "/program|/degree|/major|/minor|/course|/curriculum"),
        ("scholarships", "/scholar|/financial|/funding|/award|/bursary|/fellowship"),
        ("admissions", "/admiss|/apply|/requirement|/deadline|/enrol"),
    )
    path = F.lower(path_col(url))
    out = F.lit("general")
    for name, pattern in reversed(rules):
        out = F.when(path.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def skipped_url_col(url: Column) -> Column:
    """True for schemes other than http(s) and for paths with an ending that is never fetched."""
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return ~scheme.isin("http", "https") | path_col(url).rlike(r"(?i)\.(" + "|".join(SKIPPED_SUFFIXES) + r")$")


def in_domain_col(url: Column, domain: Column) -> Column:
    """Host equals the domain or lies below it."""
    host = F.regexp_replace(netloc_col(url), r":\d*$", "")
    return (host == F.lower(domain)) | host.endswith(F.concat(F.lit("."), F.lower(domain)))


def in_subtree_col(url: Column, root: Column) -> Column:
    """Host equals or lies below the root's, and the path lies in the root's path subtree."""
    base = F.regexp_replace(path_col(root), "/+$", "")
    path = path_col(url)
    host = F.regexp_replace(netloc_col(root), r":\d*$", "")
    return in_domain_col(url, host) & ((base == "") | (path == base) | path.startswith(F.concat(base, F.lit("/"))))


@F.pandas_udf(T.StringType())
def join_url_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    """RFC 3986 reference resolution; null where either side can't be read."""

    def one(b: str | None, h: str | None) -> str | None:
        if b is None or h is None:
            return None
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)])


SPACE = re.compile(r"\s+")


def department_col(url: Column) -> Column:
    """The part of a site that an address belongs to: the first segment of its path, null at the root."""
    first = F.split(F.regexp_replace(path_col(url), "^/+", ""), "/")[0]
    return F.when(first != "", first)
