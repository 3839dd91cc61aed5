"""What a question asks and what an evidence text says, by rule tables turned into columns.

A rule is (name, pattern); the first that matches decides. Extractors are lists of patterns tried in turn, each with
one group, and a cleaner. All of it runs in the JVM; a rule is added by adding a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.text import clean, short

#: Question kinds, most special first.
ASKS: list[tuple[str, str]] = [
    ("birth_date", r"\b(when|what (date|day|year)).*\bborn\b|\bdate of birth\b"),
    ("death_date", r"\b(when|what (date|day|year)).*\b(die|died)\b|\bdate of death\b"),
    ("birth_place", r"\bwhere.*\bborn\b|\bplace of birth\b|\bbirthplace\b"),
    ("death_place", r"\bwhere.*\b(die|died)\b|\bplace of death\b"),
    ("death_cause", r"\bcause of death\b|\bhow did .* die\b|\bwhy did .* die\b"),
    ("nationality", r"\bnationality\b|\bwhat country .* (citizen|from)\b"),
    ("country", r"\b(what|which) country\b"),
    ("release", r"\b(when|what (date|year)).*\b(released|published|come out)\b"),
    ("education", r"\bwhere .* (educated|study|studied|graduate)\b|\balma mater\b"),
    ("burial", r"\bwhere .* buried\b|\bplace of burial\b"),
    ("workplace", r"\bwhere (does|did) .* work\b|\bwork(ed|s)? (at|for)\b"),
    ("founded", r"\b(when|what year).*\b(founded|established)\b"),
    ("occupation", r"\boccupation\b|\bprofession\b|\bwhat does .* do\b"),
    ("award", r"\b(what|which) (award|prize)\b"),
    ("director", r"\bdirect(or|ed)\b"),
    ("composer", r"\bcompos(er|ed)\b"),
    ("performer", r"\b(performer|performed|sang|singer)\b"),
    ("parents", r"\b(father|mother|parents?)\b"),
    ("spouse", r"\b(spouse|wife|husband|married)\b"),
    ("children", r"\b(child|children|son|daughter)s?\b"),
    ("sibling", r"\b(brother|sister|sibling)s?\b"),
    ("comparison", r"\b(older|younger|earlier|later|same|both)\b"),
]
_DATE = r"([0-9]{1,2} [A-Z][a-z]+ [0-9]{4}|[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}|[0-9]{4})"
_NAME = r"([A-Z](?:[\w'-]+|\.)(?: (?:de |von |van |al-)?[A-Z](?:[\w'-]+|\.))*)"
_PLACE = r"([A-Z][\w'-]+(?:[ ,]+(?:[A-Z][\w'-]+|of|the))*)"
#: Patterns of each fact, in order of trust.
FACTS: dict[str, list[str]] = {
    "birth_date": [rf"\bborn (?:on |in )?{_DATE}", rf"\(born {_DATE}", rf"\({_DATE} ?[–-]"],
    "death_date": [rf"\bdied (?:on |in )?{_DATE}", rf"[–-] ?{_DATE}\)"],
    "birth_place": [rf"\bborn (?:[^.]*? )?(?:in|at) {_PLACE}", rf"\bnative of {_PLACE}"],
    "death_place": [rf"\bdied (?:[^.]*? )?(?:in|at) {_PLACE}"],
    "death_cause": [r"\bdied (?:[^.]*? )?(?:of|from) ([a-z][a-z ]+?)(?:[.,;]| in | at |$)", r"\bcause of death (?:was|is) ([a-z ]+)"],
    "release": [rf"\b(?:released|published) (?:on |in )?{_DATE}", rf"\bis an? {_DATE} "],
    "education": [rf"\b(?:studied|educated|graduated) (?:at|from) (?:the )?{_PLACE}"],
    "burial": [rf"\bburied (?:in|at) (?:the )?{_PLACE}"],
    "workplace": [rf"\b(?:works|worked) (?:at|for) (?:the )?{_PLACE}", rf"\bprofessor at (?:the )?{_PLACE}"],
    "founded": [rf"\b(?:founded|established) (?:on |in )?{_DATE}"],
    "occupation": [r"\b(?:is|was) an? (?:[A-Z][a-z]+ )?([a-z]+(?: and [a-z]+)?)(?:[.,]| who| from| of|$)"],
    "award": [rf"\b(?:won|received|awarded) (?:the )?{_PLACE}"],
    "director": [rf"\bdirected by {_NAME}", rf"\bdirector (?:is |was )?{_NAME}"],
    "composer": [rf"\b(?:composed|music) by {_NAME}", rf"\bcomposer (?:is |was )?{_NAME}"],
    "performer": [rf"\b(?:performed|recorded|sung) by {_NAME}", rf"\b(?:song|album|single) by {_NAME}"],
    "parents": [rf"\b(?:son|daughter|child) of {_NAME}(?: and {_NAME})?", rf"\b(?:father|mother) (?:is |was )?{_NAME}"],
    "spouse": [rf"\bmarried (?:to )?{_NAME}", rf"\b(?:wife|husband|spouse) (?:is |was |of )?{_NAME}"],
    "children": [rf"\b(?:father|mother|parent) of {_NAME}", rf"\b(?:sons?|daughters?) (?:is |was |are )?{_NAME}"],
    "sibling": [rf"\b(?:brother|sister) (?:of |is |was )?{_NAME}"],
}
# Adjectives of nationality and their countries.
NATIONALITIES = {
    "American": "United States", "Australian": "Australia", "British": "United Kingdom", "Canadian": "Canada", "Chinese": "China", "Dutch": "Netherlands", "English": "England", "French": "France",
    "German": "Germany", "Indian": "India", "Irish": "Ireland", "Italian": "Italy", "Japanese": "Japan", "Polish": "Poland", "Russian": "Russia", "Scottish": "Scotland", "Spanish": "Spain", "Swedish": "Sweden",
}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def asked(question: Column | str) -> Column:
    """The kind of question, `other` if no rule matches."""
    q = F.lower(_col(question))
    out = None
    for name, pattern in ASKS:
        hit = F.regexp_like(q, F.lit(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def all_asked(question: Column | str) -> Column:
    """Every kind that matches, in the table's order."""
    q = F.lower(_col(question))
    return F.array_compact(F.array(*(F.when(F.regexp_like(q, F.lit(p)), n) for n, p in ASKS)))


def fact(kind: str, text: Column | str) -> Column:
    """The first pattern's match, trimmed; null if there is none."""
    t = _col(text)
    found = [F.nullif(F.regexp_replace(F.regexp_extract(t, p, 1), "[ ,.;:]+$", ""), F.lit("")) for p in FACTS[kind]]
    return F.coalesce(*found)


def nationality(text: Column | str) -> Column:
    """Country of the adjective that stands first after `is a` or `was a`; else of the first adjective in the text."""
    names = "|".join(NATIONALITIES)
    t = _col(text)
    word = F.coalesce(F.nullif(F.regexp_extract(t, rf"\b(?:is|was) an? (?:[a-z]+ )?({names})\b", 1), F.lit("")), F.nullif(F.regexp_extract(t, rf"\b({names})\b", 1), F.lit("")))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in NATIONALITIES.items() for x in kv)), word)


def evidence_summary(question: Column | str, title: Column | str, text: Column | str, limit: int = 160) -> Column:
    """`title: kind = value` of up to three facts that are asked for; a marker for what is missing; else the text's beginning."""
    kinds = all_asked(question)
    facts = F.array_compact(F.array(*(F.when(F.array_contains(kinds, k), F.concat(F.lit(k.replace("_", " ") + " = "), fact(k, text))) for k in FACTS)))
    wanted = F.exists(kinds, lambda k: k.isin(*FACTS))
    body = F.when(F.size(facts) > 0, F.array_join(F.slice(F.array_distinct(facts), 1, 3), "; ")).when(wanted, F.concat(F.lit("no "), F.regexp_replace(kinds[0], "_", " "), F.lit(" stated"))).otherwise(clean(text))
    return short(F.concat(_col(title), F.lit(": "), body), limit)


def candidate_titles(titles: Column | str, n: int = 5) -> Column:
    return F.array_join(F.slice(F.array_distinct(_col(titles)), 1, n), "; ")


def anchors(values: Column | str, scope: Column | str, n: int = 3) -> Column:
    """Up to n distinct anchors: numbers as such, all else as text, with ids hashed over the scope."""
    return F.transform(F.slice(F.array_distinct(_col(values)), 1, n), lambda v: F.struct(F.concat(F.lit("a-"), F.substring(F.sha2(F.concat_ws("|", _col(scope), v), 256), 1, 12)).alias("anchor_id"), F.when(v.try_cast("double").isNotNull(), "number").otherwise("text").alias("kind"), v.alias("value")))


def anchor_key(object_id: Column, number: Column, unit: Column, kind: Column, value: Column) -> Column:
    """The object's id, else `number:v:unit`, else `kind:v`."""
    return F.coalesce(object_id, F.when(number.isNotNull(), F.concat_ws(":", F.lit("number"), number.cast("string"), F.coalesce(unit, F.lit("")))), F.concat_ws(":", kind, value))


LATEX: list[tuple[str, str]] = [
    (r"\\(?:text|mathrm|mbox)\{\s*,?\s*(?:and|or)\s*\}|(?<=\s)(?:and|or)(?=\s)", ","), (r"\s*,(?:\s*,)+", ","),
    (r"\\left|\\right|\\displaystyle|\\!|\\,|\;|\\ ", ""), (r"\\(?:text|mathrm|mbox)\{([^{}]*)\}", "$1"), (r"\\[dt]frac", r"\\frac"), (r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "($1)/($2)"), (r"\\sqrt\{([^{}]*)\}", "sqrt($1)"),
    (r"\\(?:cdot|times)", "*"), (r"\\div", "/"), (r"\\pi", "pi"), (r"\\infty", "inf"), (r"\\(?:%|\$)", ""), (r"\^\{([^{}]*)\}", "^($1)"), (r"\^\\circ", ""), (r"\$", ""), (r"\{|\}", ""), (r"([0-9]),(?=[0-9]{3}(?![0-9]))", "$1"), (r"\s+", ""), (r"\.$", ""),
]


def latex_surface(x: Column | str) -> Column:
    """LaTeX answers in one plain form; letters keep their case, as X and x are different unknowns."""
    out = _col(x)
    for pattern, to in LATEX:
        out = F.regexp_replace(out, pattern, to)
    return out


def latex_parts(x: Column | str) -> Column:
    """Top-level parts of a list of answers, sorted: commas inside brackets don't cut; "and" and "or" cut as words of their own only."""
    y = F.regexp_replace(latex_surface(x), r",(?=[^()\[\]]*[)\]])", "\u0001")
    return F.array_sort(F.transform(F.split(y, ","), lambda p: F.regexp_replace(p, "\u0001", ",")))


def math_match(a: Column | str, b: Column | str) -> Column:
    """Equal surfaces, or the same parts in any order (a perfect matching of equal parts)."""
    return (latex_surface(a) == latex_surface(b)) | (latex_parts(a) == latex_parts(b))
