"""Names, versions, links, sizes and documents held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEDIA_NAME_LENGTH = 30
UUID_LENGTH = 36


def blank(col: Column) -> Column:
    """Absent text equals empty text in every rule."""
    return F.coalesce(col, F.lit(""))


def checksum_problem(checksum: Column) -> Column:
    """``length`` or ``hex`` for a bad SHA-256 text; null when fine or empty."""
    return (F.when(blank(checksum) == "", F.lit(None).cast("string"))
            .when(F.octet_length(checksum) != 64, F.lit("length"))
            .when(~checksum.rlike(r"\A[0-9a-fA-F]{64}\z"), F.lit("hex")))


def url_basename(url: Column) -> Column:
    """Last path part, without any query text."""
    path = F.substring_index(url, "?", 1)
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def media_name(name: Column) -> Column:
    return F.substring(F.replace(name, F.lit("_"), F.lit("-")), 1, MEDIA_NAME_LENGTH)


def link_uuid(href: Column) -> Column:
    """The last 36 characters of a link; null when it is shorter."""
    return F.when(F.length(href) >= UUID_LENGTH, F.right(href, F.lit(UUID_LENGTH)))


def kb_to_gb(kb: Column) -> Column:
    return kb / F.lit(1024.0 * 1024.0)


def mb_to_gb(mb: Column) -> Column:
    return mb / F.lit(1024.0)


def major_minor(version: Column) -> Column:
    part = F.split(version, r"\.")
    return F.when(F.size(part) >= 2, F.concat_ws(".", F.get(part, F.lit(0)), F.get(part, F.lit(1)))).otherwise(version)


def full_version(version: Column) -> Column:
    """Two-part versions get a zero patch level."""
    return F.when(F.size(F.split(version, r"\.")) == 2, F.concat(version, F.lit(".0"))).otherwise(version)


def json_path(doc: Column, path: str, as_type: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(doc), path, as_type)


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)
