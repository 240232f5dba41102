"""URL expressions: canonical form, identity, scope and path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Click and campaign identifiers that do not change what a page shows: fixed values.
TRACKING = ("gclid", "fbclid", "msclkid", "yclid", "mc_cid", "mc_eid", "_ga", "ref", "referrer")
#: Characters that stay as they are in a path: fixed values.
PATH_SAFE = "/-_.~!$&'()*+,;=:@"
ASSET_SUFFIXES = (
    "css", "js", "mjs", "map", "png", "jpg", "jpeg", "gif", "svg", "webp", "avif", "ico", "bmp", "woff", "woff2", "ttf", "otf", "eot", "mp4", "mp3", "wav", "avi", "mov", "webm", "zip", "rar", "gz", "7z", "exe", "dmg",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx",
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without a default port."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1)), ":(80|443)$", "")


def path(url: Column) -> Column:
    """The path without trailing slashes; the root is /."""
    raw = F.regexp_replace(F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(raw == "", "/").otherwise(raw)


def query(url: Column) -> Column:
    return F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)


def is_tracking(name: Column) -> Column:
    return F.lower(name).startswith("utm_") | F.lower(name).isin(*TRACKING)


def decoded(text: Column, plus: bool = False) -> Column:
    """Percent signs decoded; a lone % stays. plus: a plus sign is a space."""
    own = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(own if plus else F.replace(own, F.lit("+"), F.lit("%2B")))


def encoded(text: Column, safe: str = "") -> Column:
    """Percent-encoded but for letters, digits, -._~ and the characters of safe."""
    own = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for c in safe:
        if c not in "-._~":
            own = F.replace(own, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return own


def canonical(url: Column, forced_host: Column | None = None) -> Column:
    """https, lower-case host (or another one given) without user, final point and default port, one spelling of the path without a trailing slash, no
    tracking parameters, the others sorted by name and value, no fragment. "" for what is no web address."""
    own = F.trim(url)
    place = F.regexp_replace(F.regexp_extract(own, "^[A-Za-z]+://([^/?#]*)", 1), "^.*@", "")
    name = F.lower(F.regexp_replace(place, ":[0-9]*$", ""))
    port = F.regexp_extract(place, ":([0-9]+)$", 1)
    site = F.concat(F.regexp_replace(F.coalesce(F.lower(forced_host), name) if forced_host is not None else name, "\\.+$", ""), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)))
    way = F.regexp_replace(encoded(decoded(F.regexp_extract(own, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)), PATH_SAFE), "/+$", "")
    pair = lambda p: F.struct(decoded(F.substring_index(p, "=", 1), True).alias("k"), decoded(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)), True).alias("v"))
    pairs = F.filter(F.transform(F.filter(F.split(query(own), "&"), lambda p: p != ""), pair), lambda x: ~is_tracking(x["k"]))
    kept = F.transform(F.array_sort(pairs), lambda x: F.concat(encoded(x["k"]), F.lit("="), encoded(x["v"])))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    made = F.concat(F.lit("https://"), site, F.when(way == "", "/").otherwise(way), tail)
    return F.when(scheme(own).isin("http", "https") & (name != ""), made).otherwise("")


def document_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def same_site(url: Column, root: Column | str) -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    return (host(url) == root) | host(url).endswith(F.concat(F.lit("."), root))


def segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")


def is_pdf(url: Column) -> Column:
    return F.lower(path(url)).endswith(".pdf")


def is_asset(url: Column) -> Column:
    return F.regexp_extract(F.lower(path(url)), "\\.([a-z0-9]+)$", 1).isin(*ASSET_SUFFIXES)


def wanted_page(url: Column, root: str, languages: tuple[str, ...]) -> Column:
    """Of the site, no file, and under no other language's prefix."""
    first = F.coalesce(F.get(segments(url), F.lit(0)), F.lit(""))
    return same_site(url, root) & ~is_pdf(url) & ~is_asset(url) & ((F.length(first) != 2) | first.isin(*languages))


def parent(url: Column) -> Column:
    """The address one segment up."""
    s = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.concat(F.lit("https://"), host(url), F.lit("/"), F.array_join(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), "/"))


def title_from_slug(url: Column) -> Column:
    last = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), segments(url)), -1), F.lit(""))
    words = F.trim(F.regexp_replace(F.regexp_replace(last, "\\.[a-z0-9]+$", ""), "[-_]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1000))


def without_www(url: Column) -> Column:
    """Host without www and path without a trailing slash: a key for comparing address lists."""
    return F.concat(F.regexp_replace(host(url), "^www\\.", ""), path(url))


def ancestors(url: Column) -> Column:
    """All prefixes of the path, host first."""
    s = segments(url)
    return F.transform(F.sequence(F.lit(0), F.size(s)), lambda n: F.array_join(F.concat(F.array(host(url)), F.slice(s, F.lit(1), n)), "/"))


def is_ghost(url: Column) -> Column:
    """A template placeholder or a bare scheme, not an address."""
    return F.coalesce(url.rlike("[{}<>]|%7[bBdD]|\\$\\{|undefined$|/null$") | url.rlike("^https?:/*$"), F.lit(True))


def without_language(url: Column, languages: tuple[str, ...]) -> Column:
    """Lower-case segments of the path, a language marker in front left out."""
    s = segments(url)
    return F.when(F.coalesce(F.get(s, F.lit(0)), F.lit("")).isin(*languages), F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1)))).otherwise(s)


def own_language(url: Column, foreign: tuple[str, ...], prefixes: tuple[str, ...] = ()) -> Column:
    """No other language's segment in front and, where prefixes are declared, one of them (the root passes)."""
    first = F.coalesce(F.get(segments(url), F.lit(0)), F.lit(""))
    declared = (path(url) == "/") | F.array_contains(F.transform(F.array(*map(F.lit, prefixes)), lambda p: F.lower(path(url)).startswith(p)), True) if prefixes else F.lit(True)
    return ~first.isin(*foreign) & declared


def wanted_file(url: Column, root: str, trusted: tuple[str, ...]) -> Column:
    """A PDF over https on the site or on a trusted one."""
    hosts = F.array(*map(F.lit, (root, *trusted)))
    return url.startswith("https://") & is_pdf(url) & F.exists(hosts, lambda h: (host(url) == h) | host(url).endswith(F.concat(F.lit("."), h)))


def page_link(url: Column, page: Column) -> Column:
    """An address that opens a PDF at a page; "" without an address."""
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(url, F.lit("#page="), page.cast("string")))


def is_broken(url: Column) -> Column:
    """White space, a second scheme or no host at all."""
    return url.rlike("\\s|^https?:/*$|https?://.*https?://") | ~url.rlike("^https?://[^/]+")
