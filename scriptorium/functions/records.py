"""Identity keys, URLs, digests and ordered decision tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doi(c: Column) -> Column:
    """A DOI without resolver or scheme, in lower case; null if it is none."""
    bare = F.lower(F.regexp_replace(F.trim(c), r"(?i)\A(https?://(dx\.)?doi\.org/|doi: *)", ""))
    return F.when(bare.rlike(r"\A10\.[0-9]{4,9}/[^ ]+\z"), bare)


def identity(stable: Column, doi_value: Column, text: Column) -> Column:
    return F.coalesce(stable, F.concat(F.lit("doi:"), doi_value), F.concat(F.lit("sha256:"), F.sha2(text, 256)))


def normal_url(c: Column) -> Column:
    """https, no fragment, no tracking parameters, the others sorted."""
    bare = F.regexp_replace(F.regexp_replace(c, r"#.*\z", ""), r"\Ahttp://", "https://")
    base, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.split_part(bare, F.lit("?"), F.lit(2))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"\A(utm_[a-z]+|fbclid|gclid)=")))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def public_url(c: Column) -> Column:
    """https to a named public host: no credentials, port, address or local name."""
    host = F.regexp_extract(c, r"\Ahttps://([^/?#]+)", 1)
    return (host != "") & ~host.rlike(r"[@:]|\A[0-9.]+\z|\A\[|(\A|\.)(localhost|local|internal)\z") & host.contains(".")


def compact_digest(pairs: list[tuple[str, Column]]) -> Column:
    """SHA-256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(pairs)])), 256)


def first_of(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """An ordered decision table: the first condition that holds decides."""
    out = F.lit(otherwise)
    for cond, value in reversed(rules):
        out = F.when(cond, value).otherwise(out)
    return out


def findings(rules: list[tuple[Column, str]]) -> Column:
    """All codes whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, code) for cond, code in rules]))
