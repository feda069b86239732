"""Resolution of URL references in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: Ports that a scheme has anyway.
PORTS = r"^(https:.*):443$|^(http:.*):80$"


def parts(link: Column) -> Column:
    """struct<scheme, authority, path, query, fragment>; scheme, authority, query and fragment are null where absent."""
    piece = lambda i: F.regexp_extract(link, PARTS, i)
    given = lambda i: F.when(piece(i) != "", piece(i))
    authority = F.when(link.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"), piece(2))
    return F.struct(F.lower(given(1)).alias("scheme"), authority.alias("authority"), piece(3).alias("path"), given(4).alias("query"), given(5).alias("fragment"))


def without_dots(path: Column) -> Column:
    """The path without . and .. segments; .. never leaves the root."""

    def step(held: Column, segment: Column) -> Column:
        low = F.regexp_replace(segment, "(?i)%2e", ".")
        return F.when(low == ".", held).when(low == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.array_append(held, segment))

    def whole(segments: Column) -> Column:
        # a path that ends in a dot segment ends in a slash
        end = F.regexp_replace(F.element_at(segments, -1), "(?i)%2e", ".").isin(".", "..")
        inner = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
        kept = F.aggregate(inner, F.array().cast("array<string>"), step)
        return F.concat(F.lit("/"), F.array_join(F.when(end, F.array_append(kept, F.lit(""))).otherwise(kept), "/"))

    return F.when(path.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"), let(F.split(path, "/"), whole)).otherwise(path)


def encoded(path: Column) -> Column:
    """Spaces, quotes, angle brackets and characters beyond ASCII as percent codes; what is encoded stays."""
    pieces = F.regexp_extract_all(path, F.lit(r"([!#-;=?-_a-z|~]+|[^!#-;=?-_a-z|~]+)"), F.lit(1))
    coded = F.transform(pieces, lambda p: F.when(p.rlike(r"^[!#-;=?-_a-z|~]"), p).otherwise(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))))
    return F.when(path.rlike(r"[^!#-;=?-_a-z|~]"), F.array_join(coded, "")).otherwise(path)


def resolve(link: Column, base: Column) -> Column:
    """struct<scheme, host, path, query, fragment> of a reference read on the page ``base``, or null where either names no host.

    White space around it, tabs and line ends within it do not count, and
    backslashes are slashes. A reference may be a whole URL, or give only what
    follows the scheme, the host, the folder, the path or the query of the base.
    Scheme and host are lower case; user names and usual ports go.
    """
    plain = F.translate(F.regexp_replace(F.regexp_replace(link, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", ""), "\\", "/")

    def merged(both: Column) -> Column:
        r, b = both["r"], both["b"]
        whole, path = r["scheme"].isNotNull(), r["path"]
        same_scheme = ~whole | (r["scheme"] == b["scheme"]) & r["authority"].isNull()
        own_host = r["authority"].isNotNull()
        folder = F.regexp_replace(b["path"], "[^/]*$", "")
        folder = F.when(folder == "", F.lit("/")).otherwise(folder)
        where = F.when(F.startswith(path, F.lit("/")) | own_host | ~same_scheme, path).when(path == "", b["path"]).otherwise(F.concat(folder, path))
        where = F.when(F.startswith(where, F.lit("/")), where).otherwise(F.concat(F.lit("/"), where))
        authority = F.when(own_host, r["authority"]).when(same_scheme, b["authority"])
        scheme = F.coalesce(r["scheme"], b["scheme"])
        host = F.lower(F.regexp_replace(authority, "^.*@", ""))
        host = F.regexp_replace(F.regexp_replace(F.concat(scheme, F.lit(":"), host), PORTS, "$1$2"), r"^[^:]*:", "")
        query = F.when(own_host | (path != "") | r["query"].isNotNull() | ~same_scheme, r["query"]).otherwise(b["query"])
        return F.when(link.isNotNull() & scheme.isNotNull() & (host != ""), F.struct(scheme.alias("scheme"), host.alias("host"), encoded(without_dots(where)).alias("path"), query.alias("query"), r["fragment"].alias("fragment")))

    return let(F.struct(parts(plain).alias("r"), parts(base).alias("b")), merged)


def shown(url: Column) -> Column:
    """The text of a resolved URL."""
    return F.concat(url["scheme"], F.lit("://"), url["host"], url["path"], F.coalesce(url["query"], F.lit("")), F.coalesce(url["fragment"], F.lit("")))


def allowed(link: Column, origin: str, path: str, aliases: tuple[tuple[str, str], ...] = ()) -> Column:
    """The canonical link of a reference on a site, or null: https, the site's host with or without www., and a path that matches.

    The site's own origin, no query, no fragment, no closing slash; each alias
    is a pattern of paths and what stands for it, with its groups.
    """
    host = origin.split("://")[1].removeprefix("www.")

    def rewritten(url: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(url["host"], r":\d*$", ""), r"^www\.", "")
        where = F.regexp_replace(url["path"], "/$", "")
        for pattern, value in aliases:
            where = F.regexp_replace(where, pattern, value)
        return F.when((url["scheme"] == "https") & (name == host) & url["path"].rlike(path), F.concat(F.lit(origin), where))

    return let(resolve(link, F.lit(f"{origin}/")), rewritten)
