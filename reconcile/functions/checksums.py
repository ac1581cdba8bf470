"""Content checksums, digests and audit value decoding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

ZERO_DIGEST = "0" * 64
EPOCH_1900 = "1900-01-01 00:00:00"


def content_checksum(text: Column) -> Column:
    """SHA-256 with CRLF folded to LF; a lone CR is content."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def content_checksum_bytes(data: Column) -> Column:
    """Same over raw bytes.  Latin-1 maps every byte to one character and back,
    so the fold works on files that are not valid UTF-8."""
    text = F.decode(data, "ISO-8859-1")
    return F.sha2(
        F.encode(F.replace(text, F.lit("\r\n"), F.lit("\n")), "ISO-8859-1"), 256
    )


def decode_checksum(stored: Column) -> Column:
    """struct(value, valid): blank is the zero digest, 64 hex digits are a
    digest, anything else (NULL included) is invalid."""
    s = strip(stored)
    blank = s == ""
    is_hex = s.rlike(r"\A[0-9a-fA-F]{64}\z")
    value = F.when(blank, F.lit(ZERO_DIGEST)).when(is_hex, F.lower(s))
    return F.struct(
        value.alias("value"), F.coalesce(blank | is_hex, F.lit(False)).alias("valid")
    )


def present(digest: Column) -> Column:
    """A digest that is really recorded: not NULL, blank or zero."""
    return F.coalesce((digest != "") & (digest != ZERO_DIGEST), F.lit(False))


def parse_commit_date(text: Column) -> Column:
    return F.coalesce(
        F.try_to_timestamp(F.nullif(strip(text), F.lit(""))),
        F.lit(EPOCH_1900).cast("timestamp"),
    )


def source_identity(server: Column, port: Column, user: Column, database: Column) -> Column:
    """Identity of a source; the length prefix keeps parts from running together."""
    return F.concat_ws(
        "~", F.octet_length(server).cast("string"), server, port, user, database
    )


def swap_bytes(hex16: Column) -> Column:
    """Reverse the byte order of eight bytes given as 16 hex digits.
    (``reverse`` on binary would pass through a string and break bytes >= 0x80.)"""
    return F.concat(*[F.substring(hex16, 15 - 2 * i, 2) for i in range(8)])


def length_prefixed_hex(text: Column) -> Column:
    """Hex of an 8-byte little-endian byte count followed by the UTF-8 bytes."""
    n = F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")
    return F.concat(swap_bytes(n), F.hex(F.encode(text, "UTF-8")))


def spot_rank(digest: Column, key: Column) -> Column:
    """First eight bytes of SHA-256(digest, NUL, key) as a little-endian number,
    in fixed-width hex so that string order is numeric order."""
    h = F.sha2(F.concat(digest, F.char(F.lit(0)), key), 256)
    return swap_bytes(F.substring(h, 1, 16))
