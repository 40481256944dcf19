"""Canonical form of file paths and file URIs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """The absolute path that ``path`` leads to.

    ``path`` is a plain path or a ``file:`` URI with percent escapes (a plus sign is itself; a URI with a
    broken escape is taken as it stands). ``.`` and empty components are dropped, ``..`` removes the
    component before it and is nothing at the root; a relative path starts at the root. The host
    ``localhost`` is the empty host, any other host stays in front. Null gives null.
    """
    is_uri = F.lower(F.substring(path, 1, 5)) == "file:"
    rest = F.substr(path, F.lit(6))
    has_host = rest.startswith("//")
    host = F.lower(F.regexp_extract(rest, "^//([^/]*)", 1))
    raw = F.when(has_host, F.regexp_replace(rest, "^//[^/]*", "")).otherwise(rest)
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    plain = F.when(is_uri, decoded).otherwise(path)
    prefix = F.when(is_uri & has_host & ~host.isin("", "localhost"), F.concat(F.lit("//"), host)).otherwise("")
    parts = F.filter(F.split(plain, "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p != "..", F.concat(done, F.array(p))).otherwise(
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        ),
    )
    resolved = F.when(F.array_contains(parts, ".."), up).otherwise(parts)
    return F.when(path.isNotNull(), F.concat(prefix, F.lit("/"), F.array_join(resolved, "/")))
