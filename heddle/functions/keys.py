"""Keys, hashes and hash draws as columns. All are functions of their arguments alone, so they agree on every executor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2**64 as a double; the greatest draw is 1.0.
TWO_64 = 18446744073709551615.0


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_hash(x: Column | str) -> Column:
    """SHA-256, lower-case hex."""
    return F.sha2(_col(x).cast("string"), 256)


def semantic_id(text: Column | str) -> Column:
    """Hash of a text that ignores case and how white space is laid out (ASCII white space, lower())."""
    return stable_hash(F.lower(F.trim(F.regexp_replace(_col(text), "[ \\t\\n\\r\\f]+", " "))))


def joined(*parts: Column | str, by: str = "|") -> Column:
    return F.concat_ws(by, *(_col(p).cast("string") for p in parts))


def hash_unit(*parts: Column | str) -> Column:
    """A draw from [0, 1]: the first 64 bits of SHA-256 of the parts, joined by a bar."""
    return F.conv(F.substring(stable_hash(joined(*parts)), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(TWO_64)


def bernoulli(p: float, *parts: Column | str) -> Column:
    """True with probability p, by hash."""
    return hash_unit(*parts) < p


def split_of(key: Column | str, fractions: dict[str, float]) -> Column:
    """Name of the split a key falls into; the last takes what rounding leaves. Fractions must sum to one."""
    if abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("split fractions must sum to 1")
    unit, upto, names = hash_unit(F.lit("split"), key), 0.0, list(fractions)
    out = None
    for name in names[:-1]:
        upto += fractions[name]
        out = F.when(unit < upto, name) if out is None else out.when(unit < upto, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[0])


def task_id(source: Column | str, row_key: Column | str, sid: Column | str) -> Column:
    return F.concat(F.lit("pub-"), _col(source), F.lit("-"), F.substring(stable_hash(joined(row_key, sid)), 1, 16))


def request_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("tw-"), F.substring(stable_hash(joined(*parts)), 1, 24))


def canonical_json(flat: Column | str) -> Column:
    """JSON of a flat map with sorted keys and no spaces; non-ASCII characters stay."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(flat)))))


def work_key(source: Column | str, arguments: Column | str) -> Column:
    """One key for a source with equal arguments, whatever their order."""
    return F.concat(_col(source), F.lit(":"), canonical_json(arguments))


def pick(options: list[str], *parts: Column | str) -> Column:
    """One of the options, by hash."""
    at = F.pmod(F.conv(F.substring(stable_hash(joined(*parts)), 1, 8), 16, 10).cast("long"), F.lit(len(options)))
    return F.element_at(F.array(*map(F.lit, options)), (at + 1).cast("int"))
