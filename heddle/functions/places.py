"""Countries and nationalities that evidence texts state, by lists of names and what stands around them.

A text's lines are read in order, the first four at most; the first line that says something decides. Names come from a trie
of words, so a line is walked once however many names there are; guards look at what stands before and after a name.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from heddle.operators.gazetteer import Trie

# Names of countries, of nationalities and of states whose country is the United States.
COUNTRIES = [
    "Argentina", "Australia", "Austria", "Belgium", "Bosnia and Herzegovina", "Brazil", "Bulgaria", "Canada", "Chile", "China", "Colombia", "Croatia", "Czechia", "Denmark", "Egypt", "Finland", "France", "Germany", "Ghana", "Greece", "Guyana", "Hungary", "Hong Kong",
    "Iceland", "India", "Indonesia", "Iran", "Ireland", "Israel", "Italy", "Japan", "Kenya", "Kuwait", "Laos", "Lebanon", "Luxembourg", "Malaysia", "Maldives", "Mexico", "Netherlands", "New Zealand", "Nigeria", "Norway", "Pakistan", "Panama", "Poland", "Portugal",
    "Romania", "Russia", "Serbia", "Singapore", "Slovakia", "Slovenia", "South Africa", "South Korea", "Spain", "Sweden", "Switzerland", "Syria", "Thailand", "Turkey", "Uganda", "Ukraine", "United Kingdom", "United States", "Venezuela", "Vietnam",
]
NATIONALITIES = [
    "American", "Argentine", "Argentinean", "Argentinian", "Australian", "Austrian", "Belgian", "Brazilian", "British", "Bulgarian", "Canadian", "Chilean", "Chinese", "Colombian", "Croatian", "Czech", "Danish", "Dutch", "Egyptian", "English", "Finnish", "French", "German", "Ghanaian",
    "Greek", "Hungarian", "Icelandic", "Indian", "Indonesian", "Iranian", "Irish", "Israeli", "Italian", "Japanese", "Kuwaiti", "Laotian", "Lebanese", "Malaysian", "Mexican", "Nigerian", "Norwegian", "Pakistani", "Polish", "Portuguese", "Puerto Rican", "Romanian", "Russian", "Salvadoran",
    "Scottish", "Serbian", "Slovak", "Slovenian", "South African", "South Korean", "Spanish", "Swedish", "Swiss", "Syrian", "Thai", "Taiwanese", "Togolese", "Turkish", "Ugandan", "Ukrainian", "Venezuelan", "Vietnamese", "Welsh",
]
STATES = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri",
    "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington",
    "West Virginia", "Wisconsin", "Wyoming",
]
LINES = 4
_COUNTRY, _NATION, _STATE = Trie(COUNTRIES), Trie(NATIONALITIES), Trie(STATES)
_I = re.IGNORECASE
_USA = re.compile(r"\b(?:U\.?S\.?|United States)\b(?!\$)", _I)

# What stands before a name (up to its place) or after it, and so says whose it is.
_SUBJECT = re.compile(r"\b(?:is|was|are|were)\s+(?:an?\s+)?(?:\d{4}\s+)?(?:(?:former|retired|professional|pioneering|prominent|leading|well-known|renowned|famous|successful|noted|veteran)\s+){0,3}$", _I)
_FAMILY_BEFORE = re.compile(r"\b(?:father|mother|parents?|grandfather|grandmother|family)(?:'s|s')?[^.;]{0,32}$|\b(?:son|daughter|child)\s+of\b[^.;]{0,80}$", _I)
_OTHERS_AFTER = re.compile(r"\s+(?:roots|ancestry|descent|heritage|background|origin|colon(?:y|ies)|troops?|forces?|arm(?:y|ies)|rule|occupation|territor(?:y|ies))\b", _I)
_WORK_AFTER = re.compile(r"\s+(?:television\s+serials?|films?|movies?|cinema|industry)\b", _I)
_STAGE = re.compile(r"\bprofessional\s+$", _I), re.compile(r"\s+(?:and\s+\w+\s+)?theatre\b", _I)
# What is no statement about the subject at all.
_MEMBERS = re.compile(r"\b(?:consisting of|whose members include|featuring members)\b", _I)
_NAMES = re.compile(r"\bBritish Columbia\b|\bEnglish\s+(?:festival\s+title|version|title|translation)\b[^)]{0,120}\)?", _I)


def lines(text: str) -> list[str]:
    """Lines with plain single spaces; the whole text where there are none."""
    return [" ".join(x.split()) for x in text.splitlines() if x.strip()] or [" ".join(text.split())]


def country_of(text: str) -> str | None:
    """The country that the first telling line names: the United States by name or by one of its states, else the leftmost."""
    for line in lines(text)[:LINES]:
        if _USA.search(line) or next(_STATE.find(line), None):
            return "United States"
        if found := next(_COUNTRY.find(line), None):
            return found[2]
    return None


def origin_of(text: str) -> str | None:
    """The country that a text says its subject is, was born in or comes from; a mere mention is no origin."""
    for line in lines(text)[:LINES]:
        for start, _, name in _COUNTRY.find(line):
            if re.search(r"\b(?:is|was|are|were)\s+(?:an?\s+)?(?:\d{4}\s+)?$", line[:start], _I):
                return name
        for said in (r"\bborn\b(.+)$", r"\b(?:from|native of)\s+(.+)$"):
            if (m := re.search(said, line, _I)) and (found := country_of(m[1])):
                return found
    return None


def nationality_of(text: str) -> str | None:
    """The nationality (or two that a hyphen joins) of a text's subject; null where several might be meant.

    Names that speak of works, ancestors, armies or members don't count unless the subject itself is said to be so.
    """
    for line in lines(text)[:LINES]:
        line = _NAMES.sub("", _MEMBERS.split(line)[0])
        found = []
        for start, end, name in _NATION.find(line):
            before, after = line[:start], line[end:]
            subject = bool(_SUBJECT.search(before[-120:]))
            joined = before.endswith("-") and any(e == start - 1 for _, e, _ in _NATION.find(before))
            if _STAGE[0].search(before) and _STAGE[1].match(after) or not subject and (_WORK_AFTER.match(after) and not joined or _FAMILY_BEFORE.search(before[-120:]) or _OTHERS_AFTER.match(after)):
                continue
            found.append((start, end, name, subject))
        if not found:
            continue
        linked = [line[a[1] : b[0]] for a, b in zip(found, found[1:], strict=False)]
        if any(f[3] for f in found):  # the subject's own, and what a hyphen or `-born` ties to it
            keep = {i for i, f in enumerate(found) if f[3]}
            for i, gap in enumerate(linked):
                if i in keep and (gap.strip() == "-" or re.fullmatch(r"-born\s+", gap, _I)):
                    keep.add(i + 1)
            for i in reversed(range(len(linked))):
                if i + 1 in keep and linked[i].strip() == "-":
                    keep.add(i)
            found = [f for i, f in enumerate(found) if i in keep]
        elif any(gap.strip() != "-" for gap in linked):
            return None
        return "-".join(list(dict.fromkeys(f[2] for f in found))[:2])
    return None


def _column(rule):
    @F.pandas_udf(StringType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rule(t) for t in x], dtype=object)

    return lambda c: run(F.col(c) if isinstance(c, str) else c)


country, origin_country, nationality = (_column(rule) for rule in (country_of, origin_of, nationality_of))


def media_country(text: Column | str) -> Column:
    """The country in what a text says after `filmed in`, `shot in`, `set in` or `takes place in`."""
    t = F.col(text) if isinstance(text, str) else text
    return country(F.nullif(F.regexp_extract(t, r"(?im)\b(?:shot|filmed|filming (?:took place|occurred)|set|takes? place)\s+in[^\S\n]+([^\n]{1,180})", 1), F.lit("")))
