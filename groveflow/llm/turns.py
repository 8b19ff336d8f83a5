"""Turns of conversations: names and order, shared by the operators on conversations.

A turn's name is the first 16 bytes of the SHA-256 of its role's length, role and text, so turns of one name are equal but
for a chance of 2**-128. Turns stand by turn number, null first; equal numbers stand by name, so the order is defined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(column: str) -> Column:
    """Role or text; null is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def name() -> Column:
    """16 bytes that name (role, text)."""
    role = plain("role")
    return F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, plain("text")), 256)), 1, 16)
