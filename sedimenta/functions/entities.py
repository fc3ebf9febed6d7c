"""Entity dictionaries, and their application as Column expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import symbols

# Entity fields in order; alias lists in order. An alias counts wherever it stands, inside words too.
FIELDS = ("products", "interfaces", "os_tags", "language_tags", "components", "api_symbols")
INTERFACES = {"pkcs#11": "pkcs11", "pkcs 11": "pkcs11", "cryptoki": "pkcs11", "cryptoapi": "cryptoapi", "csp": "csp", "cng": "cng", "pc/sc": "pcsc", "pcsc": "pcsc", "ccid": "ccid", "iso/iec 7816": "iso7816", "minidriver": "minidriver"}
OS_TAGS = {"windows": "windows", "linux": "linux", "gnu/linux": "linux", "mac os": "macos", "macos": "macos", "android": "android", "ios": "ios", "ipados": "ios", "aurora": "aurora", "аврора": "aurora", "unix": "unix"}
LANGUAGE_TAGS = {"python": "python", "c++": "cpp", "c#": "csharp", "java": "java", "javascript": "javascript", "go": "go"}
COMPONENTS = {"opensc": "opensc", "osslsigncode": "osslsigncode", "криптопро": "cryptopro", "cryptopro": "cryptopro", "ldap": "ldap", "msca": "msca", "postgresql": "postgresql", "postgres": "postgresql", "nginx": "nginx", "apache": "apache", "iis": "iis"}
FAMILIES = (("architecture", (("архитектура",),)), ("product_matrix", (("обзорная информация",), ("сравнение технических характеристик",))), ("pkcs11_objects", (("объект", "pkcs"),)), ("storage", (("хранилищ",),)), ("recommendations", (("выбор",), ("рекомендации",))), ("pcsc", (("pc/sc",),)))


@dataclass(frozen=True)
class Dictionary:
    """Aliases by field. A vendor's own product and component names aren't part of the library; add() or load() them."""

    aliases: dict[str, dict[str, str]] = field(default_factory=lambda: {"products": {}, "interfaces": INTERFACES, "os_tags": OS_TAGS, "language_tags": LANGUAGE_TAGS, "components": COMPONENTS})

    def add(self, **more: dict[str, str]) -> Dictionary:
        """A dictionary with further aliases before those it has."""
        return Dictionary({f: {**more.get(f, {}), **self.aliases.get(f, {})} for f in FIELDS[:-1]})

    @classmethod
    def load(cls, path: str) -> Dictionary:
        with open(path, encoding="utf-8") as f:
            return cls().add(**json.load(f))


def alias_tags(lowered: Column, aliases: dict[str, str]) -> Column:
    """Distinct tags whose alias occurs in the text, in dictionary order."""
    if not aliases:
        return F.expr("cast(array() as array<string>)")
    names, tags = F.lit(list(aliases)), F.lit(list(aliases.values()))
    # Two constant arrays and one test, however many aliases there are: the plan stays small.
    return F.array_distinct(F.array_compact(F.transform(names, lambda a, i: F.when(F.contains(lowered, a), F.get(tags, i)))))


def entities(text: Column, dictionary: Dictionary) -> Column:
    """A struct of one array a field. The text is put together and lowered once, not once an alias."""
    make = lambda t: F.struct(*[alias_tags(t["low"], dictionary.aliases.get(f, {})).alias(f) for f in FIELDS[:-1]], symbols(t["text"]).alias("api_symbols"))
    whole = F.transform(F.array(text), lambda t: F.struct(t.alias("text"), F.lower(t).alias("low")))
    return F.element_at(F.transform(whole, make), 1)


def merge(a: Column, b: Column) -> Column:
    """Union of two entity structs, the first's values first."""
    return F.struct(*[F.array_distinct(F.concat(a[f], b[f])).alias(f) for f in FIELDS])


def terms(found: Column) -> Column:
    return F.array_distinct(F.concat(*[found[f] for f in FIELDS]))


def augment(query: Column, found: Column) -> Column:
    return F.when(F.size(terms(found)) > 0, F.concat_ws(" ", query, F.array_join(terms(found), " "))).otherwise(query)


def family(title: Column) -> Column:
    """The document family by the first rule that the title meets."""
    low, out = F.lower(title), F.lit("general")
    for name, ways in reversed(FAMILIES):
        for needs in ways:
            met = F.lit(True)
            for n in needs:
                met = met & F.contains(low, F.lit(n))
            out = F.when(met, name).otherwise(out)
    return out


def matches(metadata: Column, expected: Column, fields=FIELDS) -> Column:
    """Metadata filter: every field that expects something shares a value with it. expected is a struct of arrays."""
    out = F.lit(True)
    for f in fields:
        out = out & ((F.size(expected[f]) <= 0) | F.coalesce(F.arrays_overlap(metadata[f], expected[f]), F.lit(False)))
    return out


def matches_values(columns: dict[str, Column], filters: dict[str, list[str] | str]) -> Column:
    """Metadata filter by literals: columns may be arrays or scalars. An empty list expects nothing."""
    out = F.lit(True)
    for name, value in filters.items():
        wanted = [value] if isinstance(value, str) else list(value)
        if not wanted:
            continue
        array, col = F.array(*map(F.lit, wanted)), columns[name]
        is_array = name in FIELDS
        out = out & F.coalesce(F.arrays_overlap(col, array) if is_array else F.array_contains(array, col), F.lit(False))
    return out
