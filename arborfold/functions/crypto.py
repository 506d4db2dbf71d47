"""Encrypted values: AES-GCM columns under a key derived from a password."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def derive_key(password: str, salt: bytes) -> bytes:
    """A 32-byte key from a password by scrypt; slow on purpose, so once per session, on the driver."""
    return hashlib.scrypt(password.encode(), salt=salt, n=2**14, r=8, p=1, dklen=32)


def encrypt(value: Column, key: bytes) -> Column:
    """Bytes of a fresh random nonce, the cipher text and its tag; null stays null."""
    return F.aes_encrypt(value, F.lit(key), F.lit("GCM"))


def decrypt(data: Column, key: bytes) -> Column:
    """The text again; null for a wrong key or changed bytes."""
    return F.try_aes_decrypt(data, F.lit(key), F.lit("GCM")).cast("string")
