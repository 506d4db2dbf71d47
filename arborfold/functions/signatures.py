"""Keys as text and signatures of entries: Ed25519 as RFC 8032 defines it, in plain Python, in Arrow batches."""

from __future__ import annotations

import base64
import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

PREFIX = "ed25519:"
# Fixed values of the curve: the field's prime, the group's order.
P = 2**255 - 19
Q = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)


class Point(NamedTuple):
    """A curve point in extended coordinates."""

    x: int
    y: int
    z: int
    t: int


def _add(a: Point, b: Point) -> Point:
    m, n = (a.y - a.x) * (b.y - b.x) % P, (a.y + a.x) * (b.y + b.x) % P
    c, d = 2 * a.t * b.t * D % P, 2 * a.z * b.z % P
    e, f, g, h = n - m, d - c, d + c, n + m
    return Point(e * f % P, g * h % P, f * g % P, e * h % P)


def _times(k: int, a: Point) -> Point:
    out = Point(0, 1, 1, 0)
    while k:
        if k & 1:
            out = _add(out, a)
        a, k = _add(a, a), k >> 1
    return out


def _x_of(y: int, odd: int) -> int | None:
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (not x and odd):
        return None
    return P - x if x & 1 != odd else x


_BASE_Y = 4 * pow(5, P - 2, P) % P
_BASE_X = _x_of(_BASE_Y, 0)
BASE = Point(_BASE_X, _BASE_Y, 1, _BASE_X * _BASE_Y % P)


def _pack(a: Point) -> bytes:
    z = pow(a.z, P - 2, P)
    x, y = a.x * z % P, a.y * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes) -> Point | None:
    y = int.from_bytes(data, "little")
    odd, y = y >> 255, y & (1 << 255) - 1
    x = _x_of(y, odd) if y < P and len(data) == 32 else None
    return None if x is None else Point(x, y, 1, x * y % P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little")
    return a & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    own = _pack(_times(a, BASE))
    r = _hash(prefix, message) % Q
    first = _pack(_times(r, BASE))
    return first + ((r + _hash(first, own, message) * a) % Q).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    a, r = _unpack(public), _unpack(signature[:32])
    s = int.from_bytes(signature[32:], "little")
    if a is None or r is None or len(signature) != 64 or s >= Q:
        return False
    left, right = _times(s, BASE), _add(r, _times(_hash(signature[:32], public, message) % Q, a))
    return (left.x * right.z - right.x * left.z) % P == 0 and (left.y * right.z - right.y * left.z) % P == 0


def key_text(public: bytes) -> str:
    """The text form of a key: a prefix and base64 for URLs, without padding."""
    return PREFIX + base64.urlsafe_b64encode(public).decode().rstrip("=")


def parse_key(text: str) -> bytes:
    """The bytes of a key's text form; ValueError for anything else."""
    if not text.startswith(PREFIX):
        raise ValueError(f"{text!r} does not start with {PREFIX}")
    data = base64.urlsafe_b64decode(text.removeprefix(PREFIX) + "=" * (-len(text.removeprefix(PREFIX)) % 4))
    if len(data) != 32:
        raise ValueError(f"{text!r} holds no 32 bytes")
    return data


def _one(key: str | None, message: str | None, signature: str | None) -> bool | None:
    if message is None or signature is None or key is None:
        return None
    try:
        return verify(parse_key(key), message.encode(), base64.b64decode(signature, validate=True))
    except ValueError:
        return False


def verified(key: Column, message: Column, signature: Column) -> Column:
    """Whether a signature (base64) of a message holds under a key (text form); null if one is null, false for malformed ones.

    Some thousand bit operations on large numbers each, a few milliseconds a row: distinct (key, message) pairs only.
    """
    @F.arrow_udf(BooleanType())
    def check(keys: pa.Array, messages: pa.Array, signatures: pa.Array) -> pa.Array:
        return pa.array([_one(*x) for x in zip(keys.to_pylist(), messages.to_pylist(), signatures.to_pylist())], pa.bool_())

    return check(key, message, signature)


def signed(seed: bytes, message: Column) -> Column:
    """The signature (base64) of each message under one secret seed of 32 bytes; null stays null."""
    @F.arrow_udf(StringType())
    def make(messages: pa.Array) -> pa.Array:
        return pa.array([None if m is None else base64.b64encode(sign(seed, m.encode())).decode() for m in messages.to_pylist()], pa.string())

    return make(message)
