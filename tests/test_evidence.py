"""Facts from texts, on own literals, one or more for every rule."""

from __future__ import annotations

import dataclasses

import pytest

from heddle.functions import evidence

CASES = {
    "birth_date": [("Ola Berg (born on 4 May 1931) is a weaver.", "4 May 1931"), ("Ola was born in 1931 in Bergen.", "1931"), ("Ola Berg (May 4, 1931 – June 7, 1990) wove.", "May 4, 1931"), ("Ola Berg (1031 – 1090) wove.", "1031"), ("Ola wove.", None), ("Ola died on 4 May 1931.", None)],
    "death_date": [("Ola died on 7 June 1990 in Oslo.", "7 June 1990"), ("Ola Berg (May 4, 1931 – June 7, 1990) wove.", "June 7, 1990"), ("Ola Berg (1031 – 1090) wove.", "1090"), ("Ola was born on 7 June 1990.", None)],
    "birth_place": [("Ola was born on 4 May 1931 in Bergen, Norway, and wove.", "Bergen, Norway"), ("Ola was born at Voss.", "Voss"), ("A native of Tromsø, he wove.", "Tromsø"), ("Ola Berg (Bergen, 4 May 1931 – 7 June 1990)", "Bergen"), ("Ola was born in 1931.", None), ("Ola was born in poverty.", None), ("No line.\nOla was born in Bergen before the war.", "Bergen")],
    "death_place": [("Ola died of fever in Oslo in 1990.", "Oslo"), ("Ola died in prison.", None), ("Ola was assassinated on 7 June in Rome while he spoke.", "Rome"), ("Ola Berg (4 May 1931 – 7 June 1990 in Lund) wove.", "Lund"), ("Ola Berg (4 May 1931 – Lund, 7 June 1990) wove.", "Lund")],
    "death_cause": [("Ola died of pneumonia after a storm.", "pneumonia"), ("Her husband died of fever.", None), ("The cause of death was a heart attack.", "a heart attack"), ("He fell ill with typhus and died.", "typhus"), ("He died in Rome.", None)],
    "release": [("The film was released on 3 March 1999 in Spain.", "3 March 1999"), ("Loom is a 1987 album by Ola.", "1987"), ("Loom is an album.", None)],
    "establishment": [("The mill was founded in 1850 by monks.", "1850"), ("The mill opened its doors.", None)],
    "education": [("She was educated at the Bergen Weaving School, where she won.", "Bergen Weaving School"), ("He graduated from Lund University in 1920.", "Lund University"), ("He studied physics at Oslo University.", "Oslo University"), ("He studied hard.", None)],
    "burial": [("He is buried at Highfield Cemetery, London.", "Highfield Cemetery, London"), ("Her grave is located in Lund.", "Lund"), ("He buried a treasure.", None)],
    "workplace": [("She worked at the Royal Loom and later wove.", "Royal Loom"), ("He is a professor of weaving at Oslo University.", "Oslo University"), ("She is associated with Acme Mills.", "Acme Mills")],
    "occupation": [("Ola is a Norwegian weaver and a singer.", "weaver"), ("Ola was a retired Dutch sailor from Delft.", "sailor"), ("Ola wove.", None)],
    "award": [("She was awarded the Golden Loom in 1950.", "Golden Loom"), ("He won the Weaver's Prize for best rug.", "Weaver's Prize for best rug"), ("He won a race.", None), ("She awarded marks.", None)],
    "spouse": [("His wife was the Swedish singer Eva Lind.", "Eva Lind"), ("She married Count Otto von Holst in 1920.", "Otto von Holst"), ("She was married to John Day, Jr., a baker.", "John Day Jr."), ("He was the widower of Anna Moe.", "Anna Moe"), ("They married in Rome.", None)],
    "child": [("He is the father of the actor Per Berg.", "Per Berg"), ("Their only son was Kim Day, a baker.", "Kim Day"), ("The eldest daughter of a baker", None)],
    "sibling": [("He is the brother of Liv Berg and wove.", "Liv Berg"), ("Her younger sister is Liv Berg.", "Liv Berg"), ("Brothers in arms", None)],
    "father": [("He was born in Oslo to Nils Berg and Kari Moe.", "Nils Berg"), ("She is the daughter of actress Eva Lind and director Rolf Lind.", "Rolf Lind"), ("Son of King Olaf of Hålogaland and his second wife Gunhild, he ruled.", "Olaf of Hålogaland"), ("His father fled to Spain.", None), ("Her father was the baker Nils Berg and her mother was Kari.", "Nils Berg"), ("She is the daughter of Queen Maud.", None)],
    "mother": [("He was born in Oslo to Nils Berg and Kari Moe.", "Kari Moe"), ("She is the daughter of actress Eva Lind and director Rolf Lind.", "Eva Lind"), ("Son of King Olaf and his second wife Gunhild, he ruled.", "Gunhild"), ("Her father was the baker Nils Berg.\nHer mother was Kari Moe.", "Kari Moe"), ("She is the daughter of Queen Maud.", "Maud"), ("Born to the family of Nils Berg", None)],
}


@pytest.mark.parametrize("kind", CASES)
def test_facts(spark, kind):
    rows = [*CASES[kind], ("", None), (None, None), ("x " * 200_000, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = [r["got"] for r in df.select("i", evidence.fact(kind, "t").alias("got")).orderBy("i").collect()]
    assert [(t, w, g) for (t, w), g in zip(rows, got, strict=True) if w != g] == []


def test_every_kind_has_cases():
    assert set(CASES) == {*evidence.RULES, "father", "mother"}


def test_several_facts_equal_each_alone(spark, monkeypatch):
    texts = [t for cases in CASES.values() for t, _ in cases] + ["OLA WAS BORN ON 4 MAY 1931 IN BERGEN", "Ola d\u0130ed on 7 June 1990, marr\u0130ed to Eva Lind", "Kari\u017f wa\u017f born in Voss", "", None]
    kinds = {f"f_{k}": k for k in CASES}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [tuple(r)[1:] for r in df.select("i", evidence.facts(kinds, "t").alias("f")).select("i", "f.*").orderBy("i").collect()]
    # without the words that rules need, every rule reads every line
    bare = {k: [dataclasses.replace(r, needs=()) for r in rules] for k, rules in evidence.RULES.items()}
    assert any(r.needs for rules in evidence.RULES.values() for r in rules)
    monkeypatch.setattr(evidence, "RULES", bare)
    assert got == [tuple(None if t is None else evidence.parents_of(t)[k == "mother"] if k in ("father", "mother") else evidence.fact_of(k, t) for k in CASES) for t in texts]
    seen = []
    monkeypatch.setattr(evidence, "lines", lambda t, cut=evidence.lines: seen.append(t) or cut(t))
    assert evidence.facts_of(CASES, texts[0])[0] == "4 May 1931" and len(seen) == 1  # a text is cut into lines once
