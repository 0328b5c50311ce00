"""Column functions: null-keeping guards, bins, time gaps, text and probability."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(money: Column | str) -> Column:
    """Money in integer cents, so that sums don't depend on their order."""
    return F.round(_c(money) * 100).cast("bigint")


def places(x: Column | str, n: int = 4) -> Column:
    return F.round(_c(x).cast("double"), n)


def clip(x: Column | str, low=None, high=None) -> Column:
    """Bounds that leave null as null (greatest and least would skip it)."""
    out = _c(x)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(_c(x).isNotNull(), out)


def seconds(t: Column | str) -> Column:
    return F.unix_micros(_c(t)) / 1e6


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole elapsed days of 24 hours, rounded down; not calendar days."""
    return F.floor((F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / 86_400_000_000).cast("bigint")


def bin_index(x: Column | str, edges: Sequence[float]) -> Column:
    """Number of the half-open bin that begins at the last of the (ascending) edges not above x; values under the first edge fall in bin 0."""
    out = F.lit(0).cast("bigint")
    for k, edge in enumerate(edges):
        if k:
            out = F.when(_c(x) >= F.lit(float(edge)), F.lit(k).cast("bigint")).otherwise(out)
    return F.when(_c(x).isNotNull(), out)


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Null where the denominator is zero or null."""
    return _c(top) / F.nullif(_c(bottom), F.lit(0))


def _plain_letters() -> tuple[str, str]:
    """Each lower-case Latin letter that decomposes into one plain letter and marks, and that letter; marks by themselves go."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(bare) == 1 and bare.isascii() and bare != c:
            found[c] = bare
    return "".join(found), "".join(found.values())


def normalised_name(name: Column | str) -> Column:
    """Lower case without the accents of Latin letters and apostrophes; other punctuation parts words, runs of blanks shrink."""
    plain = F.regexp_replace(F.translate(F.lower(_c(name)), *_plain_letters()), "[\u0300-\u036f'’]", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def table_cells(html: Column) -> Column:
    """Array of a page's table rows, each an array of its cells' texts without tags; comments and scripts don't count."""
    clean = F.regexp_replace(html, "(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>", "")
    rows = F.regexp_extract_all(clean, F.lit("(?is)<tr\\b[^>]*>(.*?)</tr>"), 1)
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), r"\s+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>"), 1), text))


def tail_two_or_more(mean: Column | str) -> Column:
    """P(N >= 2) of a Poisson count."""
    return 1 - F.exp(-_c(mean)) * (1 + _c(mean))


def log_loss(p: Column | str, y: Column | str, edge: float = 1e-6) -> Column:
    q = clip(p, edge, 1 - edge)
    return -(_c(y) * F.ln(q) + (1 - _c(y)) * F.ln(1 - q))


def hash_uniform(*keys) -> Column:
    """A number in [0, 1) that depends on its keys alone, never on partitioning: 52 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
