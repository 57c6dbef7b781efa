"""Which columns a column's value is computed from, read off the analysed plan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def _each(seq) -> Iterator:
    """The members of a sequence of the JVM."""
    for i in range(seq.size()):
        yield seq.apply(i)


def _id(attribute) -> int:
    return attribute.exprId().id()


def sources_of(df: DataFrame) -> dict[str, set[str]]:
    """For every column of ``df`` the names of all columns its value comes from, under whatever names, its own included.

    Values are followed through projections, aggregates, windows, unions and generators; what a Python function
    returns comes from all it was given. Conditions of joins and filters choose rows and are not followed, and
    neither is anything before a stored table.
    """
    made_of: dict[int, set[int]] = {}
    names: dict[int, str] = {}

    def known(attributes) -> set[int]:
        found = set()
        for a in _each(attributes):
            names.setdefault(_id(a), a.name())
            found.add(_id(a))
        return found

    def alias(expression) -> None:
        if expression.getClass().getSimpleName() == "Alias":
            names[_id(expression)] = expression.name()
            made_of.setdefault(_id(expression), set()).update(known(expression.child().references().toSeq()))

    waiting = [df._jdf.queryExecution().analyzed()]
    while waiting:
        node = waiting.pop()
        kind, children = node.getClass().getSimpleName(), list(_each(node.children()))
        waiting += children
        known(node.output())
        for expression in _each(node.expressions()):
            alias(expression)
        if kind == "Generate":
            given = known(node.generator().references().toSeq())
            for a in _each(node.generatorOutput()):
                made_of.setdefault(_id(a), set()).update(given)
        elif kind == "Union":
            for child in children:
                for out, given in zip(_each(node.output()), _each(child.output())):
                    if _id(out) != _id(given):
                        made_of.setdefault(_id(out), set()).add(_id(given))
        elif children and ("Python" in kind or "InArrow" in kind or "InPandas" in kind):
            given = set().union(*[known(c.output()) for c in children])
            for a in _each(node.output()):
                if _id(a) not in given:
                    made_of.setdefault(_id(a), set()).update(given)

    def closure(start: int) -> set[str]:
        seen, left = {start}, [start]
        while left:
            new = made_of.get(left.pop(), set()) - seen
            seen |= new
            left += new
        return {names[i] for i in seen}

    return {a.name(): closure(_id(a)) for a in _each(df._jdf.queryExecution().analyzed().output())}
