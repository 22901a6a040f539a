"""Content hashes and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def blob_sha1(text: Column) -> Column:
    """SHA-1 of the text's bytes behind the header ``blob <bytes> NUL``; null for null."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(text).cast("string"), F.lit(NUL)), "UTF-8"), F.encode(text, "UTF-8")))


def content_sha1(content: Column) -> Column:
    """The same of binary content, whatever its bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit(NUL)), "UTF-8"), content))


def blob_sha256(text: Column) -> Column:
    return F.sha2(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(text).cast("string"), F.lit(NUL)), "UTF-8"), F.encode(text, "UTF-8")), 256)


def stable_id(prefix: str, tag: str, *parts: Column) -> Column:
    """``prefix`` and the first 24 hex digits of SHA-256 over tag and parts, joined by NUL."""
    joined = F.concat_ws(NUL, F.lit(tag), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 24))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 code units, as a long."""
    data = F.encode(text, "UTF-16BE")
    codes = F.transform(F.sequence(F.lit(1), (F.octet_length(data) / 2).cast("int")), lambda i: F.conv(F.hex(F.substring(data, i * 2 - 1, F.lit(2))), 16, 10).cast("long"))
    prime, modulus = F.lit(16777619).cast("long"), F.lit(1 << 32).cast("long")
    folded = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * prime, modulus))
    return F.when(F.octet_length(text) > 0, folded).otherwise(F.when(text.isNotNull(), F.lit(2166136261).cast("long")))


def scope_digest(rows: Column) -> Column:
    """SHA-1 of an array of lines, sorted, each ended by a line feed. The lines of one scope are gathered in one row."""
    return F.sha1(F.concat(F.array_join(F.array_sort(rows), "\n"), F.lit("\n")))
