"""Text functions as columns (ASCII white space; JVM-side throughout)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = "[ \\t\\n\\r\\f]+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """White space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(_col(x), _SPACE, " "))


def clean_multiline(x: Column | str) -> Column:
    """Each line cleaned, empty lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(_col(x), "\n"), clean), lambda y: y != ""), "\n")


def short(x: Column | str, limit: int) -> Column:
    """Cut to the limit with an ellipsis; marks that would stand before it go."""
    c = _col(x)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, limit - 1), "[ ,;:-]+$", ""), F.lit("…")))


def short_dots(x: Column | str, limit: int = 140) -> Column:
    c = _col(x)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 3)), F.lit("...")))


def compact_text(x: Column | str, limit: int) -> Column:
    """Cleaned text cut at the last "; ", ", " or space that leaves half the limit (32 characters at least)."""
    c = clean(x)
    head = F.substring(c, 1, limit)
    least = max(32, limit // 2)

    def last(mark: str) -> Column:
        rest = F.substring_index(head, mark, -1)
        return F.when(F.contains(head, F.lit(mark)), F.length(head) - F.length(rest) - len(mark)).otherwise(F.lit(-1))

    cut = F.lit(-1)
    for mark in (" ", ", ", "; "):
        cut = F.when(last(mark) >= least, last(mark)).otherwise(cut)
    return F.when(F.length(c) <= limit, c).when(cut > 0, F.rtrim(F.substring(head, F.lit(1), cut))).otherwise(F.rtrim(head))


def surface_signature(x: Column | str) -> Column:
    """The shape of a text: identifiers (words that end in a dash and four digits or more) as <id>, numbers that follow no letter as <n>."""
    y = F.regexp_replace(F.lower(_col(x)), "\\b[a-z][a-z0-9-]*-[0-9]{4,}\\b", "<id>")
    y = F.regexp_replace(y, "(?<![a-z])[-+]?[0-9]+(\\.[0-9]+)?", "<n>")
    return F.trim(F.regexp_replace(y, _SPACE, " "))


def qa_normalize(x: Column | str) -> Column:
    """Answer text for comparison: lower case, digit commas dropped, marks to spaces, articles dropped."""
    y = F.lower(F.translate(_col(x), "‘’“”–—", "''\"\"--"))
    y = F.regexp_replace(y, "([0-9]),(?=[0-9])", "$1")
    y = F.regexp_replace(y, "[^a-z0-9à-öø-ÿ.+-]+|\\.(?![0-9])", " ")
    return F.array_join(F.filter(F.split(F.trim(y), " +"), lambda w: ~w.isin("", "a", "an", "the")), " ")


def answer_key(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(x)), "[^a-z0-9]+", " "))


def number_tokens(x: Column | str) -> Column:
    """Signed decimals in order, digit commas and leading plus signs dropped."""
    y = F.regexp_replace(_col(x), "([0-9]),(?=[0-9])", "$1")
    return F.transform(F.regexp_extract_all(y, F.lit("([-+]?[0-9]+(?:\\.[0-9]+)?)"), F.lit(1)), lambda n: F.ltrim(n, F.lit("+")))


def normalized_text(x: Column | str) -> Column:
    """Lower case, cleaned, marks at the ends dropped."""
    return F.regexp_replace(F.lower(clean(x)), "^[.,;:!? ]+|[.,;:!? ]+$", "")


def contains_token(text: Column | str, marker: Column | str) -> Column:
    """Does the text hold the marker: a number as a number of the same digits, all else with no word character (of any script) on either side. An empty marker is nowhere."""
    m = _col(marker)
    number = F.replace(m, F.lit(","), F.lit(""))
    literal = F.replace(m, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    within = F.regexp_like(_col(text), F.concat(F.lit("(?U)(?<!\\w)\\Q"), literal, F.lit("\\E(?!\\w)")))
    return F.when(number.rlike("^[-+]?[0-9]+(\\.[0-9]+)?$"), F.array_contains(number_tokens(text), F.ltrim(number, F.lit("+")))).when(m == "", False).otherwise(within)


def insufficient(x: Column | str) -> Column:
    """Does an answer say that the evidence doesn't suffice."""
    return F.regexp_like(F.lower(_col(x)), F.lit("(insufficient|not enough) (evidence|information)|cannot be (determined|answered)|can't be (determined|answered)|does not (say|state|specify)|unknown from the (evidence|documents)"))


def safe_filename(x: Column | str) -> Column:
    return F.substring(F.regexp_replace(_col(x), "[^A-Za-z0-9_.-]+", "-"), 1, 96)


def choice_prompt(question: Column | str, choices: Column | str) -> Column:
    """The question and its choices, lettered from A, a line each."""
    lettered = F.transform(_col(choices), lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c))
    return F.concat_ws("\n", _col(question), F.array_join(lettered, "\n"))


def key_values(**fields: Column | str) -> Column:
    """`k=v | k=v` of the fields that aren't null."""
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{k}="), _col(v).cast("string")) for k, v in fields.items()))


def conversation_prompt(turns: Column | str) -> Column:
    """A single turn as it is, more as `Label: text` lines; turns are structs of role and text."""
    t = _col(turns)
    lines = F.transform(t, lambda x: F.concat(F.initcap(x["role"]), F.lit(": "), x["text"]))
    return F.when(F.size(t) == 1, t[0]["text"]).otherwise(F.array_join(lines, "\n"))


MONTHS = "january february march april may june july august september october november december".split()


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def calendar_date(x: Column | str) -> Column:
    """struct<y,m,d> of `Month D, Y` or `D Month Y`, with or without an ordinal; null if it is no such date (days 1 to 31)."""

    def of(word: Column) -> Column:
        a, b, c = (F.get(word, F.lit(i)) for i in range(3))
        number, year = "^[0-9]{1,2}$", c.rlike("^[0-9]{4}$")
        first = (F.size(word) == 3) & year & b.rlike(number)
        second = (F.size(word) == 3) & year & a.rlike(number)
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.when(first, a).otherwise(b)).cast("int")
        day = F.when(first, b).otherwise(a).try_cast("int")
        return F.when((first | second) & (month > 0) & day.between(1, 31), F.struct(c.try_cast("int").alias("y"), month.alias("m"), day.alias("d")))

    y = F.regexp_replace(F.lower(clean(x)), "([0-9])(st|nd|rd|th)\\b", "$1")
    return let(F.split(F.trim(F.regexp_replace(y, "[,. ]+", " ")), " "), of)


def partial_date(x: Column | str) -> Column:
    """struct<m,d> of `Month D` or `D Month`."""
    return let(calendar_date(F.concat(_col(x), F.lit(" 2000"))), lambda full: F.when(full.isNotNull(), F.struct(full["m"].alias("m"), full["d"].alias("d"))))
