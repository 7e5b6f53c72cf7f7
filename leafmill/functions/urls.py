"""URL functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; a trailing slash stays, nothing becomes ``/``."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(
            part == "..",
            F.when((F.size(done) > 0) & (F.element_at(done, -1) != ""), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done),
        )
        .otherwise(F.concat(done, F.array(part))),
    )
    plain = ~path.rlike(r"(?:^|/)\.\.?(?:/|$)")
    closed = let(F.array_join(folded, "/"), lambda j: F.when(path.rlike(r"(?:/|/\.|/\.\.)$") & ~j.endswith("/"), F.concat(j, F.lit("/"))).otherwise(j))
    return F.coalesce(F.nullif(F.when(plain, path).otherwise(closed), F.lit("")), F.lit("/"))


def remote_key(url: Column) -> Column:
    """Canonical form of an absolute http(s) URL with an ASCII host: scheme and host in lower case, trailing dots and
    default ports dropped, dot segments resolved, no fragment."""
    return let(url, _remote_key)


def _remote_key(url: Column) -> Column:
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    scheme = F.lower(part(1))
    user = F.regexp_extract(part(2), r"^(.*@)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(part(2), r"^(?:.*@)?([^:]*)", 1)), r"\.+$", "")
    port = F.regexp_extract(part(2), r":([0-9]+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.coalesce(F.nullif(part(3), F.lit("")), F.lit("/"))
    query = F.when(F.length(part(4)) > 1, part(4)).otherwise("")
    return F.concat(scheme, F.lit("://"), user, host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), remove_dot_segments(path), query)


def resolve(base: Column, reference: Column) -> Column:
    """Absolute, scheme-relative, root-relative, query, fragment and plain relative references against an http(s) base."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    bare = F.regexp_extract(reference, r"^([^?#]*)", 1)
    tail = F.regexp_extract(reference, r"^[^?#]*(.*)$", 1)
    return (
        F.when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), reference)
        .when(reference.startswith("//"), F.concat(scheme, F.lit(":"), reference))
        .when(reference.startswith("/"), F.concat(root, remove_dot_segments(bare), tail))
        .when(bare == "", F.concat(root, path, tail))
        .otherwise(F.concat(root, remove_dot_segments(F.concat(folder, bare)), tail))
    )


def classify(base: Column, reference: Column, internal_host: str) -> Column:
    """Struct of ``target``, ``remote`` and ``problem`` for a reference; all null where nothing is fetched."""
    return let(resolve(base, reference), lambda full: _classified(full, reference, internal_host))


def _classified(full: Column, reference: Column, internal_host: str) -> Column:
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    web = scheme.isin("http", "https")
    quiet = (scheme == "data") | full.rlike(r"(?i)^about:(?:blank|srcdoc)(?:[?#]|$)")
    inside = F.regexp_replace(F.regexp_extract(full, r"^[^:]+://[^/?#]*([^?#]*)", 1), "^/+", "")
    problem = (
        F.when(F.contains(reference, F.lit("\\")), "reverse solidus in URL reference")
        .when(scheme == "file", "file URLs are forbidden")
        .when(quiet, None)
        .when(~web, "unsupported resource URL scheme")
        .when(host == "", "HTTP(S) resource URL requires an authority")
        .when((host == internal_host) & (inside == ""), "unsafe resource reference")
    )
    fetched = problem.isNull() & ~quiet
    remote = host != internal_host
    return F.struct(
        F.when(fetched, F.when(remote, remote_key(full)).otherwise(inside)).alias("target"), F.when(fetched, remote).alias("remote"), problem.alias("problem")
    )


def navigation_target(reference: Column) -> Column:
    """Struct of ``path`` and ``fragment`` of a link."""
    return F.struct(F.regexp_extract(reference, "^([^#]*)", 1).alias("path"), F.regexp_extract(reference, "#(.*)$", 1).alias("fragment"))


def srcset(value: Column) -> Column:
    """References of a ``srcset`` whose candidates are separated by a comma and white space."""
    return F.filter(F.transform(F.split(F.trim(value), r"\s*,\s+|,+$"), lambda c: F.regexp_extract(c, r"^[\s,]*(\S*?),*(?:\s|$)", 1)), lambda r: r != "")
