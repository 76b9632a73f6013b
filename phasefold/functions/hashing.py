"""Arithmetic hash that every SQL engine evaluates alike.

Sampling, splitting and augmentation are ordered by this hash instead of a
random generator, so a retried task draws the same rows.  All intermediates
stay below 2**53, so ANSI mode never overflows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

MODULUS = 4294967296


def _seed_constants(seed: int) -> list[int]:
    """Five unrelated odd 32-bit constants of a seed, so that different seeds give unrelated hashes."""
    digest = hashlib.blake2b(str(int(seed)).encode(), digest_size=20).digest()
    return [int.from_bytes(digest[i:i + 4], "big") | 1 for i in range(0, 20, 4)]


def hash32_sql(key: str, seed: int = 0, div: str = "div") -> str:
    """SQL text of the hash of a non-negative BIGINT; ``div`` is the integer-division operator."""
    a, b, c, d, e = _seed_constants(seed)
    first = f"((({key}) % 1000003) * {a} + ((({key}) {div} 1000003) % 1000003) * {b} + {c}) % {MODULUS}"
    return f"((({first}) % 65536) * {d} + (({first}) {div} 65536) * {e} + {c}) % {MODULUS}"


def hash32(key: str, seed: int = 0) -> Column:
    return F.expr(hash32_sql(key, seed)).cast("bigint")


def uniform(key: str, seed: int = 0) -> Column:
    """Deterministic uniform in [0, 1)."""
    return hash32(key, seed).cast("double") / F.lit(float(MODULUS))


def normal(key: str, seed: int = 0) -> Column:
    """Deterministic standard normal from two uniforms."""
    u = F.greatest(uniform(key, seed), F.lit(1e-12))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * uniform(key, seed + 7919))
