"""What scripts may call, as column expressions: digests, encodings, decryption, times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioq.functions.urls import component


def md5_hex(c: Column) -> Column:
    return F.md5(c)


def base64_encode(c: Column) -> Column:
    return F.base64(c.cast("binary"))


def base64_decode(c: Column) -> Column:
    return F.unbase64(c).cast("string")


def aes_cbc_decrypt(cipher: Column, key: str, iv: str) -> Column:
    """Base64 text decrypted by AES in CBC mode; Spark wants the vector in front of the bytes."""
    return F.aes_decrypt(F.concat(F.lit(iv).cast("binary"), F.unbase64(cipher)), F.lit(key).cast("binary"), F.lit("CBC"), F.lit("PKCS")).cast("string")


def encode_component(c: Column) -> Column:
    return component(c)


def decode_component(c: Column) -> Column:
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def encode_uri(c: Column) -> Column:
    """As a component, with what separates a URL's parts left alone."""
    out = component(c)
    for code, mark in (("%3A", ":"), ("%2F", "/"), ("%3F", "?"), ("%23", "#"), ("%26", "&"), ("%3D", "="), ("%2B", "+"), ("%2C", ","), ("%3B", ";"), ("%40", "@"), ("%24", "$"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def time_format(c: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """Seconds or milliseconds (told apart by size), in the session's time zone."""
    seconds = F.when(c > F.lit(1_000_000_000_000), F.floor(c / 1000)).otherwise(c)
    return F.date_format(F.timestamp_seconds(seconds), pattern)
