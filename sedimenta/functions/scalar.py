"""Keys and tags as Column expressions."""

from __future__ import annotations

from uuid import NAMESPACE_DNS, NAMESPACE_OID, NAMESPACE_URL, NAMESPACE_X500

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = {"dns": NAMESPACE_DNS, "url": NAMESPACE_URL, "oid": NAMESPACE_OID, "x500": NAMESPACE_X500}


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a name in one of the standard namespaces."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_SPACES[namespace].hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def page_tag(sources: Column) -> Column:
    """page_N by the digits after the last pageId= of the first source that has them, else page_unknown."""
    numbers = F.filter(F.transform(sources, lambda s: F.regexp_extract(s, r"pageId=(\d+)(?!.*pageId=\d)", 1)), lambda n: n != "")
    return F.when(F.size(numbers) > 0, F.concat(F.lit("page_"), F.element_at(F.concat(numbers, F.array(F.lit(""))), 1))).otherwise("page_unknown")
