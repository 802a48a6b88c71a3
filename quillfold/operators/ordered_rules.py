"""Ordered lists of substring rules over texts: the first rule that finds one of its marks wins.

A short list is a chain of `contains` in the plan. A long one is an automaton over all marks
(Aho-Corasick), built once a Python worker, that reads each text once whatever the number of
marks; reading stops as soon as the first rule has been met.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .execution import first_match

Rules = list[tuple[str, list[str]]]  # name and marks, in order

SHORT = 32  # marks up to which a chain is used; both ways give the same names


def by_chain(text: Column, rules: Rules, otherwise: str | None) -> Column:
    cases = [(F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m)), F.lit(name)) for name, marks in rules if marks]
    return first_match([(F.coalesce(test, F.lit(False)), name) for test, name in cases], F.lit(otherwise))


def by_automaton(text: Column, rules: Rules, otherwise: str | None) -> Column:
    names = [name for name, _ in rules]
    first: dict[str, int] = {}
    for k, (_, marks) in enumerate(rules):
        for m in marks:
            first.setdefault(m, k)
    always = first.pop("", None)

    @F.pandas_udf("string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for mark, k in first.items():
            machine.add_word(mark, k)
        machine.make_automaton()
        least = min(first.values(), default=-1)

        def of(value: str | None) -> str | None:
            if value is None:
                return otherwise
            best = len(names) if always is None else always
            if first and best > least:
                for _, k in machine.iter(value):
                    if k < best:
                        best = k
                        if best == least:
                            break
            return names[best] if best < len(names) else otherwise

        for values in batches:
            yield pd.Series([of(v) for v in values], dtype=object)

    return find(text)


def first_rule(text: Column, rules: Rules, otherwise: str | None = None, short: int = SHORT) -> Column:
    """Name of the first rule one of whose marks is in the text, letter case included; `otherwise` where none is or the text is null.

    An empty mark is in every text; a rule without marks never holds; of equal marks the earlier rule counts.
    """
    return by_chain(text, rules, otherwise) if sum(len(m) for _, m in rules) <= short else by_automaton(text, rules, otherwise)
