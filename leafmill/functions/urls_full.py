"""URL functions for all of Unicode and IPv6, as Arrow-optimised UDFs."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import unquote_to_bytes, urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts of a URL with an authority (RFC 3986, appendix B).
_PARTS = re.compile(r"(?s)([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::([0-9]*))?(/[^?#]*|)(?:\?([^#]*))?(?:#.*)?")
# Characters that stand for themselves in a path segment (RFC 3986, section 3.3), less the unreserved ones.
_SEGMENT = b"!$&'()*+,;=:@"
_PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~")
_DEFAULT_PORTS = {"http": 80, "https": 443}
_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})|(.)", re.S)


def _spelt(text: str, keep: bytes) -> str:
    """Percent-encoding normalised (section 6.2.2): each byte plain where it may be, else as an escape in capitals."""
    own = _PLAIN | frozenset(keep)

    def one(found: re.Match) -> bytes:
        byte = int(found[1], 16) if found[1] else found[2][0]
        plain = byte in _PLAIN if found[1] else byte in own
        return bytes([byte]) if plain else b"%%%02X" % byte

    return _ESCAPE.sub(one, text.encode()).decode("ascii")


def _resolved(path: str) -> str:
    """Dot segments removed (section 5.2.4), reading the path from left to right."""
    done: list[str] = []
    segments = path.split("/")[1:]
    for segment in segments:
        if segment == ".." and done:
            done.pop()
        elif segment not in (".", ".."):
            done.append(segment)
    if segments and segments[-1] in (".", ".."):
        done.append("")
    return "/" + "/".join(done)


def _host(name: str) -> str:
    """An IPv6 address in its shortest form, or a name in ASCII and lower case without dots at its end."""
    if name.startswith("["):
        return f"[{ipaddress.IPv6Address(name[1:-1]).compressed}]"
    plain = unquote_to_bytes(name).decode().rstrip(".")
    if re.fullmatch(r"[A-Za-z0-9.-]+", plain):
        return plain.lower()
    import idna

    return idna.encode(plain, uts46=True, std3_rules=True).decode("ascii").lower()


def canonical(url: str) -> str:
    """Canonical form of an absolute http(s) URL; ValueError for one without a valid host or port."""
    found = _PARTS.fullmatch(url)
    if not found or not found[3]:
        raise ValueError("no absolute URL with a host")
    scheme, user, host, port, path, query = (found[1].lower(), *found.groups()[1:])
    if port and int(port) > 65535:
        raise ValueError("no valid port")
    out = [scheme, "://"]
    if user is not None:
        out += [_spelt(user, b"!$&'()*+,;=:"), "@"]
    out.append(_host(host))
    if port and int(port) != _DEFAULT_PORTS.get(scheme):
        out += [":", str(int(port))]
    out.append(_resolved(_spelt(path or "/", _SEGMENT + b"/")))
    if query:
        out += ["?", _spelt(query, _SEGMENT + b"/?")]
    return "".join(out)


def _or_none(function, *values):
    try:
        return None if None in values else function(*values)
    except ValueError:
        return None


def canonical_url(url: Column) -> Column:
    """Canonical URL, null for an invalid one."""
    return F.udf(lambda x: _or_none(canonical, x), "string", useArrow=True)(url)


def join(base: Column, reference: Column) -> Column:
    """Reference resolved against a base by all of RFC 3986."""
    return F.udf(lambda a, b: _or_none(urljoin, a, b), "string", useArrow=True)(base, reference)
