"""Hashes, signatures and sealed text."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """Hex HMAC-SHA256: the key pads are literals, so this is two nested built-in digests."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    digest = F.sha2(F.concat(inner, message.cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def signature_ok(signature: Column, resource_type: Column, resource_id: Column, secret: bytes) -> Column:
    message = F.concat_ws("|", resource_type, F.coalesce(resource_id, F.lit(0)).cast("string"))
    return F.coalesce(hmac_sha256(message, secret) == signature, F.lit(False))


def visitor_hash(salt: Column, anonymous_ip: Column, user_agent: Column, site: str) -> Column:
    """First 8 bytes of SHA-256 over salt, anonymous address, user agent and site."""
    text = F.concat(
        salt.cast("binary"),
        anonymous_ip.cast("binary"),
        F.coalesce(user_agent, F.lit("")).cast("binary"),
        F.lit(site).cast("binary"),
    )
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 8)


def key_id(*key: Column) -> Column:
    """Surrogate id of a natural key; NULL where all of the key is NULL."""
    return F.when(F.coalesce(*[F.when(k.isNotNull(), True) for k in key], F.lit(False)), F.xxhash64(*key))


def seal(payload: Column, key: bytes) -> Column:
    """AES-GCM text of the payload.

    The start value is derived from key and payload, so the expression gives the same text each time
    it is evaluated (a random one would differ between the text and the HMAC taken over it), and two
    payloads never share one.
    """
    start = F.substring(F.unhex(hmac_sha256(payload, key)), 1, 12)
    return F.base64(F.aes_encrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), start))


def unseal(ciphertext: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(ciphertext), F.lit(key), F.lit("GCM")).cast("string")
