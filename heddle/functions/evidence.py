"""What a text states of its subject: rules with guards and cleaners, and candidates by tier, line and place.

A rule is a pattern with one group, a cleaner that turns the group into a fact or nothing, a tier (lower is more reliable) and
a guard, a pattern that must not stand in the line. What a rule `needs` is words (lower case) of which every match has one. All candidates of a kind are scored by (tier, line, rule), and the first
that its cleaner accepts is the fact. Parents are a pair: clauses such as `daughter of A and B` are cut at the conjunction
between two names, and words that only fit a woman or a man say which is which. A rule is added by adding a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from heddle.functions.places import NATIONALITIES, lines

_I = re.IGNORECASE
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
_MONTHS = tuple(MONTH.lower().split("|"))
DATE = rf"(?:(?:{MONTH})\s+\d{{1,2}},?\s+\d{{3,4}}|\d{{1,2}}\s+(?:{MONTH})\s+\d{{3,4}})"
YEAR = r"(?:1\d{3}|20\d{2})"
_FULL, _YEAR = re.compile(rf"\b{DATE}\b", _I), re.compile(rf"\b{YEAR}\b")
LONGEST = 96

Cleaner = Callable[[str], str | None]


def plain(value: str) -> str | None:
    """Single spaces, no marks at the ends, at most LONGEST characters up to a whole word."""
    value = " ".join(value.split()).strip(" ,.;:-")
    if len(value) > LONGEST:
        value = value[: LONGEST + 1].rpartition(" ")[0].rstrip(" ,.;:-")
    return value or None


def date(value: str) -> str | None:
    """The first full date, else the first year."""
    m = _FULL.search(value) or _YEAR.search(value)
    return m[0].strip(" ,") if m else None


def full_date(value: str) -> str | None:
    m = _FULL.search(value)
    return m[0].strip(" ,") if m else None


# A place ends where the sentence goes on to something else.
_PLACE_END = re.compile(
    rf"\b(?:and|where|who|which|before|after|while|during|from|to|until|into)\b|\s+(?:at (?:the )?age|on (?:the )?\d|in {YEAR}|as [A-ZÀ-ÖØ-Þ]|of a\b|of an\b)|\s--|[;)–—]|,\s+(?:he|she|they|it|an?)\b|,\s+(?:the\s+)?[^,]{{0,60}}\b(?:was|is|made|became|later|studied|worked|rose)\b|,\s*{DATE}|\.\s",
    _I,
)
_NO_PLACE = {"infancy", "childhood", "exile", "prison", "captivity", "home", "poverty", "office", "action", "battle"}


def place(value: str) -> str | None:
    """Where something is: a name with a capital letter, no date, no state of life."""
    value = re.sub(r"^(?:in|at|near)\s+", "", value.strip(), flags=_I)
    value = plain(_PLACE_END.split(value)[0])
    if not value or _FULL.search(value) or re.fullmatch(rf"(?:{MONTH})?\s*{YEAR}", value, _I) or value.casefold() in _NO_PLACE or not re.search(r"[A-ZÀ-ÖØ-Þ]", value):
        return None
    return value


def cause(value: str) -> str | None:
    """What somebody died of, without when and where."""
    value = plain(re.split(r"\s+(?:during|after|while|following|at|in|on)\b|[.;,]", value, flags=_I)[0])
    return None if value is None or value[0].isupper() and not re.search(r"[a-z]{3}", value) else value


_UPPER = r"(?:[A-ZÀ-ÖØ-Þ][\w'’.-]*)"
_PERSON = re.compile(rf"{_UPPER}(?:\s+(?:{_UPPER}|de|da|del|di|du|van|von|of|the|la|bin|ibn))*")
_TITLE = re.compile(rf"^(?:(?:former|late|the|his|her|their|first|second|third|fourth|fellow|{'|'.join(NATIONALITIES)})\s+|(?:King|Queen|Prince|Princess|Duke|Duchess|Count|Countess|Baron|Baroness|Earl|Marquess|Viscount|President|Senator|Congressman|Governor|Emperor|Empress|Dr\.?|Sir|Lady|Lord)\s+(?=[A-ZÀ-ÖØ-Þ])|[a-z-]+\s+(?=\S))+")
_PERSON_END = re.compile(rf"[;()]|\.\s|,\s*(?!(?:Jr|Sr)\b)|\s+(?:who|whom|which|that|is|was|has|had|in {YEAR}|in (?:his|her)|from {YEAR}|until|with whom|during|before|after|as|at|on|for|since|became|died|born|and (?:his|her|the|a|was|became|later))\b", _I)
_NOBODY = {"he", "she", "his", "her", "they", "it", "the", "a", "an", "in", "on", "at", "god"}


def person(value: str) -> str | None:
    """A name: what has capital letters after titles, roles and nationalities, up to where the sentence goes on."""
    value = re.sub(r",\s+(Jr|Sr)\b\.?", r" \1.", value)
    value = _TITLE.sub("", _PERSON_END.split(value, maxsplit=1)[0].strip())
    found = _PERSON.search(value)
    if not found:
        return None
    name = plain(re.sub(r"(?:\s+(?:of|the|de|da|la))+$", "", found[0]))
    if name and re.search(r"\b(?:Jr|Sr)$", name):
        name += "."
    return None if not name or name.casefold() in _NOBODY or _FULL.search(name) else name


def work(value: str) -> str | None:
    """What somebody is: the noun phrase without nationalities and what comes after it."""
    value = re.split(r"\s+(?:who|whom|which|with|known|from|based|born|of the|specialis|specializ|and (?:an?|the)\b)|[.;,(]", value, maxsplit=1, flags=_I)[0]
    value = re.sub(rf"^(?:(?:former|retired)\s+)?(?:(?:{'|'.join(NATIONALITIES)})[\s-]+)+", "", value, flags=_I)
    return plain(value)


def institution(value: str) -> str | None:
    return plain(re.split(rf"\s+(?:in {YEAR}|where|and (?:was|became|later|worked)|before|after|with a|from {YEAR})\b|[.;,]", re.sub(r"^the\s+", "", value, flags=_I), flags=_I)[0])


def prize(value: str) -> str | None:
    return plain(re.split(rf"\s+(?:in {YEAR}|by|from|at)\b|[.;,]", value, flags=_I)[0])


@dataclass(frozen=True)
class Rule:
    """One way to say a fact."""

    pattern: str
    clean: Cleaner
    tier: int = 0
    guard: str = ""
    flags: int = _I
    needs: tuple[str, ...] = ()

    @cached_property
    def compiled(self) -> tuple[re.Pattern, re.Pattern | None]:
        return re.compile(self.pattern, self.flags), re.compile(self.guard, _I) if self.guard else None

    def candidates(self, told: list[tuple[str, str | None]]):
        """`told` has each line, and in lower case if it is ASCII: there a line without the rule's words is passed over."""
        pattern, guard = self.compiled
        for n, (line, low) in enumerate(told):
            if self.needs and low is not None and not any(w in low for w in self.needs):
                continue
            found = [(n, m.start(), m[1]) for m in pattern.finditer(line)]
            if found and not (guard and guard.search(line)):
                yield from found


_DEATH = r"\b(?:died|death|killed|assassinated)\b"
_KIN = r"\b(?:his|her|their)\s+(?:husband|wife|father|mother|son|daughter|brother|sister)\b"
RULES: dict[str, list[Rule]] = {
    "birth_date": [Rule(r"\bborn\b([^.;]{3,60})", date, needs=("born",)), Rule(rf"\(\s*(?:[^()]*?,\s*)?({DATE})\s*(?:[–—-]|\))", full_date, 1, needs=("(",)), Rule(r"\(\s*(\d{3,4})\s*[–—-]", plain, 2, needs=("(",))],
    "death_date": [Rule(r"\bdied\b([^.;]{3,60})", date, needs=("died",)), Rule(rf"[–—-]\s*(?:[^()–—-]*?,\s*)?({DATE})", full_date, 1, needs=("-",)), Rule(r"\(\s*\d{3,4}\s*[–—-]\s*(\d{3,4})\s*\)", plain, 2, needs=("(",))],
    "birth_place": [Rule(r"\bborn\b.{0,80}?\b(?:in|at)\s+((?!\d).+)$", place, needs=("born",)), Rule(r"\bnative of\s+(.+)$", place, 1, needs=("native",)), Rule(rf"\b{DATE}\s+in\s+([^–—;.)]+)", place, 1, _DEATH, needs=_MONTHS), Rule(rf"\(\s*([^()\d]{{3,90}}?),?\s+{DATE}", place, 2, needs=("(",))],
    "death_place": [Rule(r"\b(?:died|assassinated|killed)\b.{0,100}?\b(?:in|at)\s+((?!\d).+)$", place, needs=("died", "assassinated", "killed")), Rule(rf"[–—-]\s*{DATE}\s+in\s+([^)]+)\)", place, 1, needs=("-",)), Rule(rf"[–—-]\s*([^()\d–—-]+?),?\s+{DATE}\s*\)", place, 1, needs=("-",)), Rule(rf"[–—-]\s*(?:{DATE}|\d{{3,4}})\s*,\s*([^)]+)\)", place, 2, needs=("-",))],
    "death_cause": [Rule(r"\bdied\b[^.;]{0,100}?\b(?:of|from)\s+([^.;,]{3,80})", cause, 0, _KIN, needs=("died",)), Rule(r"\bcause of (?:his |her )?death (?:was|is)\s+([^.;,]{3,80})", cause, needs=("cause of",)), Rule(r"\b(?:became|was|fell)\s+ill\s+with\s+([^.;,]{3,80}?)(?=,?\s+and\s+died\b)", cause, 1, needs=("ill",))],
    "release": [Rule(r"\b(?:released|premiered|published)\b([^.;]{0,90})", date), Rule(rf"\bis an?\s+({YEAR})\b", plain, 1)],
    "establishment": [Rule(r"\b(?:founded|established|created|opened|launched)\b([^.;]{0,100})", date)],
    "education": [Rule(r"\beducated at\s+([^;]{3,100})", institution, needs=("educated at",)), Rule(r"\b(?:graduated (?:from|at)|studied (?:[a-z ]{3,30} )?at|degree(?: [^.;]{0,40})? from)\s+([^;]{3,100})", institution, 1, needs=("graduated", "studied", "degree"))],
    "burial": [Rule(r"\b(?:buried|interred)\s+(?:at|in|on)\s+([^.;]{3,100})", place), Rule(r"\bgrave is (?:located )?(?:at|in)\s+([^.;]{3,100})", place, 1)],
    "workplace": [Rule(r"\b(?:worked|works|taught|teaches)\s+(?:at|for)\s+([^.;]{3,100})", institution), Rule(r"\b(?:editor|editor-in-chief|professor)\s+(?:of [a-z ]+ )?(?:of|at)\s+([^.;]{3,100})", institution, 1), Rule(r"\bassociated with\s+([^.;]{3,100})", institution, 2)],
    "occupation": [Rule(r"\b(?:is|was) an?\s+([^.;]{2,100})", work)],
    "award": [Rule(r"\b(?:was\s+)?awarded\s+(?:the\s+|an?\s+)?([A-ZÀ-ÖØ-Þ][^.;]{2,80})", prize, 0, "", 0, ("awarded",)), Rule(r"\b(?:recipient of|won|received)\s+(?:the\s+|an?\s+)?([^.;,]{2,100}?\b(?:Awards?|Prizes?|Medals?)(?:\s+for\s+[^.;,]{2,60})?)", prize, 1, needs=("award", "prize", "medal"))],
    "spouse": [Rule(r"\b(?:his wife|her husband|his husband|her wife)(?: was| is|,)?\s+(.+)$", person, needs=("wife", "husband")), Rule(r"\bmarried (?:to )?(?!(?:from|since|in|for)\b)(.+)$", person, needs=("married",)), Rule(r"\b(?:marriage to|civil partnership with|companion of)\s+(.+)$", person, needs=("marriage to", "partnership with", "companion of")), Rule(r"\b(?:wife|husband|spouse|widow|widower) of\s+(.+)$", person, 1, needs=("wife of", "husband of", "spouse of", "widow of", "widower of"))],
    "child": [Rule(r"\b(?:father|mother|parents?) of\s+(.+)$", person), Rule(r"\b(?:his|her|their) (?:(?:eldest|oldest|youngest|only|second) )?(?:son|daughter|child)(?: is| was|,)?\s+(.+)$", person), Rule(r"\b(?:eldest|oldest|youngest|only|second) (?:son|daughter)(?: is| was|,)?\s+(?!of\b)(.+)$", person, 1)],
    "sibling": [Rule(r"\b(?:brother|sister) of\s+(.+)$", person), Rule(r"\b(?:his|her|their) (?:(?:elder|older|younger|twin) )?(?:brother|sister)(?: is| was|,)?\s+(.+)$", person)],
}


def fact_of(kind: str, text: str) -> str | None:
    return _fact(kind, _told(text))


def _told(text: str) -> list[tuple[str, str | None]]:
    return [(x, x.lower() if x.isascii() else None) for x in lines(text)]


def _fact(kind: str, told: list[tuple[str, str | None]]) -> str | None:
    found = [(r.tier, n, i, at, value, r.clean) for i, r in enumerate(RULES[kind]) for n, at, value in r.candidates(told)]
    scored = sorted(found, key=lambda c: c[:4])
    return next((f for *_, value, clean in scored if (f := clean(value))), None)


_WOMAN = re.compile(r"\b(?:actress|mother|wife|queen|princess|duchess|empress|lady|countess|heiress|née|nee)\b", _I)
_MAN = re.compile(r"\b(?:actor|father|husband|king|prince|duke|emperor|lord|count)\b", _I)
_BORN_TO = re.compile(r"\bborn\b[^.;]{0,100}?\bto\s+(?!(?:the\s+)?(?:musical\s+)?family of\b)(.+)$", _I)
_CHILD_OF = re.compile(r"\b(?:sons?|daughters?|child|children)(?:\s+and\s+(?:successor|heir))?\s+of\s+(.+)$", _I)
_CLAUSE_END = re.compile(r",\s+(?:but|who|which|he|she|they|it|one of|and (?:was|became|succeeded|followed|later|then))\b|,\s+(?:the\s+)?(?:son|daughter|child) of\b|\s+and\s+(?:an?|the)?\s*(?:member of|niece|nephew|grandson|granddaughter|(?:younger|older|elder) (?:brother|sister))\b|\.\s", _I)
_NOT_NAMED = re.compile(r"(?:fled|died|in|into|at|from|had|has|succeeded|followed|left|worked|and)\b", _I)


def parents_of(text: str) -> tuple[str | None, str | None]:
    """(father, mother), as far as the text names them."""
    return _parents(lines(text))


def _parents(told: list[str]) -> tuple[str | None, str | None]:
    clauses = [m[1] for line in told if (m := _BORN_TO.search(line))] + [m[1] for line in told if (m := _CHILD_OF.search(line))]
    father = mother = None
    for clause in clauses:
        clause = _CLAUSE_END.split(clause, maxsplit=1)[0]
        sides = re.split(r",?\s+(?:and|by)\s+(?=(?:his|her|their)\b)|,?\s+and\s+(?=(?:[a-z-]+\s+)*[A-ZÀ-ÖØ-Þ])", clause, maxsplit=1)
        named = [(side, person(side)) for side in sides]
        named = [(side, name) for side, name in named if name]
        if len(named) == 2:
            women = [bool(_WOMAN.search(side)) for side, _ in named]
            first = 1 if women == [True, False] else 0
            father, mother = father or named[first][1], mother or named[1 - first][1]
        elif named:
            if _WOMAN.search(named[0][0]):
                mother = mother or named[0][1]
            else:
                father = father or named[0][1]
        if father and mother:
            break
    for line in told:
        for word in ("father", "mother"):
            m = re.search(rf"\b(?:his|her|their)\s+{word}(?:\s+was|\s+is|,)?\s+(.+)$", line, _I)
            if m and not _NOT_NAMED.match(m[1]) and (name := person(re.split(r"\s+and\s+(?:his|her|their)\s+", m[1])[0])):
                father, mother = (father or name, mother) if word == "father" else (father, mother or name)
    return father, mother


def fact(kind: str, text: Column | str) -> Column:
    """The fact of a kind (a key of RULES, or `father` or `mother`) that a text states; null if it states none."""
    one = (lambda t: parents_of(t)[kind == "mother"]) if kind in ("father", "mother") else lambda t: fact_of(kind, t)

    @F.pandas_udf(StringType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else one(t) for t in x], dtype=object)

    return run(F.col(text) if isinstance(text, str) else text)


def facts(kinds: dict[str, str], text: Column | str) -> Column:
    """A struct of the facts of several kinds, by field name: each text is cut into lines once, its parents are read once."""

    @F.pandas_udf(", ".join(f"{name} string" for name in kinds))
    def run(x: pd.Series) -> pd.DataFrame:
        rows = [[None] * len(kinds) if t is None else facts_of(kinds.values(), t) for t in x]
        return pd.DataFrame(rows, columns=list(kinds), dtype=object)

    return run(F.col(text) if isinstance(text, str) else text)


def facts_of(kinds: Iterable[str], text: str) -> list[str | None]:
    told, parents, out = _told(text), None, []
    for kind in kinds:
        if kind in ("father", "mother"):
            parents = parents or _parents([line for line, _ in told])
            out.append(parents[kind == "mother"])
        else:
            out.append(_fact(kind, told))
    return out
