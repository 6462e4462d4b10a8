"""Code sets as intervals of numbered codes: distinct ``array<bigint>`` columns.

The codes of a digit level are numbered in sorted order, so the codes below a run of leading digits are neighbours and a
code text, however short, means one interval. An interval is one number: its first code's times ``SPAN`` plus its last
code's. Intervals of one level are either disjoint or one holds the other, because runs of leading digits are.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally.fixed_values import CODE_LENGTH
from codetally.functions.codes import code_stem
from codetally.functions import sets

#: More than any code's number.
SPAN_BITS = 20
SPAN = 1 << SPAN_BITS
#: Codes are spelled from lists of so many.
CHUNK_BITS = 8
CHUNK = 1 << CHUNK_BITS
#: No interval: a stem that no code of the level begins with.
NOTHING = -1
#: Digits that decide a section.
SECTION_DIGITS = 2
#: Stems have places: first those of one digit, then those of two, and so on. Where those of k digits begin.
FIRST_PLACE = [0, *(sum(10**k for k in range(1, digits)) for digits in range(1, CODE_LENGTH + 1))]
#: The place of what is no code, after those of all stems.
NOWHERE = sum(10**k for k in range(1, CODE_LENGTH + 1))


def first_code(interval: str) -> str:
    return f"shiftright({interval}, {SPAN_BITS})"


def last_code(interval: str) -> str:
    return f"({interval} & {SPAN - 1})"


def place_of(stem: Column) -> Column:
    first = F.array(*[F.lit(place) for place in FIRST_PLACE])
    return F.coalesce(stem.cast("int") + F.get(first, F.length(stem)), F.lit(NOWHERE))


def stems(codes: Column, most: int) -> Column:
    """The place of the known leading digits of each code, at most so many, ``NOWHERE`` for what is no code."""
    return F.transform(F.transform(codes, lambda code: F.substring(code_stem(code), 1, most)), place_of)


def meant_by_one(index: Column, place: Column, level: int) -> Column:
    """The set of all codes of a level that the stem at a place means, a column without functions of functions."""
    if level == 0:
        return F.get(index["level_0"], F.get(index["cut_0"], place))
    return F.array_remove(F.array(F.get(index[f"level_{level}"], place)), F.lit(NOTHING).cast("bigint"))


def once(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` stands for ``value``, worked out once per row.

    A fold over nothing, since ``transform`` copies all that its function gives, lists of thousands of codes with it.
    """
    return f"aggregate(array(), {value}, (kept, item) -> kept, {name} -> {body})"


def by_place(of_stem: Callable, digits: int, nowhere) -> list:
    """What belongs to each place, for what so many leading digits decide: ``of_stem`` is asked for stems up to these."""
    listed = []
    for k in range(1, CODE_LENGTH + 1):
        cut = min(k, digits)
        each = [of_stem(str(number).zfill(cut)) for number in range(10**cut)]
        listed += each if cut == k else [value for value in each for _ in range(10 ** (k - cut))]
    return [*listed, nowhere]


def meant(index: str, found: str, level: int) -> str:
    """The set of all codes of a level that the stems in ``found`` mean.

    This and what follows takes and gives SQL text, in which ``index`` and ``found`` are names.
    """
    if level == 0:
        one = f"get({index}.level_0, get({index}.cut_0, {{stem}}))"
        return f"if(size({found}) = 1, {one.format(stem=f'{found}[0]')}, array_distinct(flatten(transform({found}, stem -> {one.format(stem='stem')}))))"
    each = f"transform({found}, stem -> get({index}.level_{level}, stem))"
    return f"array_remove(if(size({found}) < 2, {each}, array_distinct({each})), {NOTHING}L)"


def codes_meant(index: str, found: str, level: int) -> str:
    """The same set spelled out, as sorted texts."""
    first, last = (f"cast({end('i')} as int)" for end in (first_code, last_code))
    listed = f"get({index}.codes_{level}, chunk)"
    skipped = f"greatest({first} - chunk * {CHUNK}, 0)"
    some = f"slice({listed}, {skipped} + 1, least({last} - chunk * {CHUNK} + 1, {CHUNK}) - {skipped})"
    # A slice reads the list from its beginning, so whole lists and single codes are taken as they are.
    part = f"if({first} <= chunk * {CHUNK} and (chunk + 1) * {CHUNK} <= {last} + 1, {listed}, {some})"
    from_chunk, to_chunk = f"shiftright({first}, {CHUNK_BITS})", f"shiftright({last}, {CHUNK_BITS})"
    between = f"slice({index}.codes_{level}, {from_chunk} + 2, {to_chunk} - {from_chunk} - 1)"
    several = f"flatten(concat(array({once(from_chunk, 'chunk', part)}), {between}, array({once(to_chunk, 'chunk', part)})))"
    only = f"array(get(get({index}.codes_{level}, {from_chunk}), {first} & {CHUNK - 1}))"
    spelled = f"case when {first} = {last} then {only} when {from_chunk} = {to_chunk} then {once(from_chunk, 'chunk', part)} else {several} end"
    holds = f"wide != narrow and {first_code('wide')} <= {first_code('narrow')} and {last_code('narrow')} <= {last_code('wide')}"
    apart = f"if(size(them) < 2, them, filter(them, narrow -> not exists(them, wide -> {holds})))"
    # Intervals that don't hold each other are in order, and so are their codes one after the other.
    body = f"if(size(them) = 1, {once('them[0]', 'i', spelled)}, flatten(transform(them, i -> {spelled})))"
    return once(once(f"sort_array({meant(index, found, level)})", "them", apart), "them", body)


def is_single(codes: Column) -> Column:
    """Whether a set is exactly one code."""
    only = F.get(codes, F.lit(0))
    return (F.size(codes) == 1) & (F.shiftright(only, SPAN_BITS) == only.bitwiseAND(F.lit(SPAN - 1)))


def single_text(codes: str) -> str:
    """The same for a set that is a name in SQL text."""
    return f"(size({codes}) = 1 and {first_code(f'{codes}[0]')} = {last_code(f'{codes}[0]')})"


def overlaps(left: Column, right: Column) -> Column:
    """Whether two sets share a code."""
    first, last = (lambda c: F.shiftright(c, SPAN_BITS)), (lambda c: c.bitwiseAND(F.lit(SPAN - 1)))
    return F.exists(left, lambda a: F.exists(right, lambda b: (first(a) <= last(b)) & (first(b) <= last(a))))


def least_is_in(codes: Column, among: Column) -> Column:
    """Whether the smallest code of a set is in another set; an empty set has none."""
    least = F.shiftright(F.array_min(codes), SPAN_BITS)
    inside = F.exists(among, lambda c: (F.shiftright(c, SPAN_BITS) <= least) & (least <= c.bitwiseAND(F.lit(SPAN - 1))))
    return F.coalesce(inside, F.lit(False))


def functions_for(kind: T.DataType) -> ModuleType:
    """The module whose functions compare sets of this column type: this one, or ``sets`` for sets spelled out."""
    return sys.modules[__name__] if isinstance(kind.elementType, T.LongType) else sets
