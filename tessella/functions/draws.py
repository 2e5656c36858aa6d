"""Reproducible draws: digests of a key, a round and a seed, the same on any engine and in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ticket(*parts: Column | str | int) -> Column:
    """The MD5 in hex of the parts as text, joined by |: to order by, or to compare with a share of all digests."""
    cols = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *cols).cast("binary"))


def number(*parts: Column | str | int) -> Column:
    """The first twelve digits of the ticket as a number."""
    return F.conv(F.substring(ticket(*parts), 1, 12), 16, 10).cast("bigint")


def share(fraction: float) -> str:
    """Tickets smaller than this are a fraction of all."""
    return "g" if fraction >= 1 else f"{int(max(fraction, 0.0) * 16**8):08x}"
