"""Keyed digests and tree hashes, as Arrow UDFs over hashlib."""

from __future__ import annotations

import hashlib
import hmac
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAVES, LEAF_BLOCK = 8, 64


def blake2sp(data: bytes) -> bytes:
    """The eight-leaf tree of BLAKE2s: blocks of 64 bytes go round the leaves, the root hashes their digests."""
    parts = [hashlib.blake2s(fanout=LEAVES, depth=2, leaf_size=0, node_offset=i, node_depth=0, inner_size=32, last_node=i == LEAVES - 1) for i in range(LEAVES)]
    for at in range(0, len(data), LEAF_BLOCK):
        parts[at // LEAF_BLOCK % LEAVES].update(data[at : at + LEAF_BLOCK])
    return hashlib.blake2s(b"".join(p.digest() for p in parts), fanout=LEAVES, depth=2, leaf_size=0, node_offset=0, node_depth=1, inner_size=32, last_node=True).digest()


@lru_cache(1024)
def derive(password: str, salt: bytes, log_rounds: int) -> tuple[bytes, bytes, bytes]:
    """PBKDF2-HMAC-SHA256 at three counts: the key, the hash key (16 rounds on) and the check value (32 on, folded to 8 bytes)."""
    n = 1 << log_rounds
    key, hashed, check = (hashlib.pbkdf2_hmac("sha256", password.encode(), salt, n + more, 32) for more in (0, 16, 32))
    folded = bytearray(8)
    for i, b in enumerate(check):
        folded[i % 8] ^= b
    return key, hashed, bytes(folded)


def password_state(password: str, salt: bytes, log_rounds: int, check: bytes | None) -> str:
    """verified, wrong, or unverifiable without a check value."""
    if check is None:
        return "unverifiable"
    return "verified" if hmac.compare_digest(derive(password, salt, log_rounds)[2], check[:8]) else "wrong"


def keyed_crc(crc: int, hash_key: bytes) -> int:
    """A checksum bound to a key: the HMAC of its bytes, folded to 32 bits."""
    d = hmac.new(hash_key, crc.to_bytes(4, "little"), "sha256").digest()
    out = 0
    for i in range(0, 32, 4):
        out ^= int.from_bytes(d[i : i + 4], "little")
    return out


def keyed_digest(digest: bytes, hash_key: bytes) -> bytes:
    return hmac.new(hash_key, digest, "sha256").digest()


@F.pandas_udf(T.StringType())
def blake2sp_hex(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else blake2sp(bytes(b)).hex())


@F.pandas_udf(T.StringType())
def password_check(password: pd.Series, salt: pd.Series, log_rounds: pd.Series, check: pd.Series) -> pd.Series:
    return pd.Series([password_state(p, bytes(s), int(n), None if c is None else bytes(c)) for p, s, n, c in zip(password, salt, log_rounds, check, strict=True)])
