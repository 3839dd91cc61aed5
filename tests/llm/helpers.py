"""Fixtures that the operators' tests share: documents with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, anchor int"


def documents(spark, rows):
    """rows of (doc_id, text[, lang[, source]]) with extra columns whose names operators use inside."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *[None] * (4 - len(r)))
        full.append((doc_id, text, lang, source, None if text is None else len(text), 7, "x", 1))
    return spark.createDataFrame(full, SCHEMA)


def by_id(df, *columns):
    """Sorted rows of the columns; nulls first."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))
