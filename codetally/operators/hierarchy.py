"""The code hierarchy: which codes exist, which section they belong to, what an incomplete code may mean.

A code with at least ``n`` known digits is cut to ``n`` and must exist; a shorter one stands for every existing code
below it. Single codes are looked up by an equi-join of their known leading digits with the table
``prefix -> n-digit codes``. Code sets of up to five digits are read as intervals of numbered codes
(``functions.intervals``): what each run of up to five leading digits means is gathered once, at most 111,110 numbers,
and travels with the tasks, so that no row is joined, exploded or grouped to clean its codes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetally.fixed_values import CODE_LENGTH
from codetally.functions.codes import code_stem, parse_codes
from codetally.functions.intervals import (
    CHUNK, NOTHING, SECTION_DIGITS, SPAN, by_place, codes_meant, meant, meant_by_one, once, place_of, single_text, stems,
)
from codetally.functions.sets import empty_set
from codetally.lineage import carried

# A level of at most this many digits has at most 10 + 100 + ... + 100,000 prefixes, whatever the
# input, so its lookup table is safe to broadcast. Deeper levels are left to the planner.
BROADCAST_DIGITS = CODE_LENGTH


def level_width(digits: Column) -> Column:
    """Digits needed to decide a level: sections (level 0) are decided by two."""
    return F.when(digits == 0, 2).otherwise(digits)


class Hierarchy:
    """A ``(section, code)`` table. ``order_col`` tells which row wins if a division has two sections."""

    def __init__(self, table: DataFrame, order_col: str | None = None):
        position = F.col(order_col) if order_col else F.col("section")
        self.table = table.select(
            F.col("section").cast("string").alias("section"),
            F.col("code").cast("string").alias("code"),
            position.alias("position"),
        )
        self._gathered: tuple[dict[int, list[int]], dict[str, str]] | None = None
        self._indexes: dict[tuple[tuple[int, ...], bool], DataFrame] = {}

    def _gather(self) -> tuple[dict[int, list[int]], dict[str, str]]:
        """The numbers of the codes of each level, and the section of each division: at most 111,110 and 100."""
        if self._gathered is None:
            numeric = self.table.filter(F.col("code").rlike("^[0-9]+$"))
            at = lambda n: F.collect_set(F.when(F.length("code") >= n, F.substring("code", 1, n).cast("int"))).alias(f"level_{n}")
            found = numeric.agg(*[at(n) for n in range(1, BROADCAST_DIGITS + 1)]).first()
            sections = self.section_lookup().filter(F.col("division").rlike("^[0-9]{2}$") & F.col("section").isNotNull())
            self._gathered = (
                {n: sorted(found[f"level_{n}"]) for n in range(1, BROADCAST_DIGITS + 1)},
                {row.division: row.section for row in sections.collect()},
            )
        return self._gathered

    def index(self, levels: list[int], spelled: bool = False) -> Column:
        """What ``functions.intervals`` reads codes of these levels with, ``spelled`` if codes are asked for as text.

        ``level_<n>`` has the interval of each stem, by its place; ``codes_<n>`` all codes in lists of ``CHUNK``. For sections
        ``cut_0`` has the place of each stem's division, and ``level_0`` the intervals of each division.
        """
        if max(levels) > BROADCAST_DIGITS:
            raise ValueError(f"Code sets can be read at up to {BROADCAST_DIGITS} digits, not {max(levels)}.")
        wanted = tuple(levels), spelled
        if wanted not in self._indexes:
            self._indexes[wanted] = carried(self.table.sparkSession, self._lists(levels, spelled))
        return self._indexes[wanted].scalar()

    def _lists(self, levels: list[int], spelled: bool) -> dict[str, tuple[str, list]]:
        """The fields of the index, each with its type."""
        numbers, section_of = self._gather()
        codes_at = {n: [str(number).zfill(n) for number in numbers[n]] for n in numbers}
        intervals: dict[int, dict[str, tuple[int, int]]] = {n: {} for n in levels}
        for n in filter(None, levels):
            for at, code in enumerate(codes_at[n]):
                for k in range(1, n + 1):
                    first, _ = intervals[n].get(code[:k], (at, at))
                    intervals[n][code[:k]] = first, at
        names = sorted(set(section_of.values()))
        sections: dict[str, set[int]] = {}
        for division, name in section_of.items():
            for stem in (division[:1], division):
                sections.setdefault(stem, set()).add(names.index(name))

        def chunks(codes: list[str]) -> tuple[str, list]:
            return "array<array<string>>", [list(part) for part in batched(codes, CHUNK)]

        fields: dict[str, tuple[str, list]] = {}
        for n in levels:
            if n == 0:
                divisions = [str(number).zfill(k) for k in range(1, SECTION_DIGITS + 1) for number in range(10**k)]
                place_of = {stem: place for place, stem in enumerate(divisions)}
                fields["cut_0"] = "array<int>", by_place(place_of.get, SECTION_DIGITS, len(divisions))
                fields["level_0"] = "array<array<bigint>>", [[s * SPAN + s for s in sorted(sections.get(stem, ()))] for stem in [*divisions, None]]
                if spelled:
                    fields["codes_0"] = chunks(names)
                continue
            ends = {stem: first * SPAN + last for stem, (first, last) in intervals[n].items()}
            fields[f"level_{n}"] = "array<bigint>", by_place(lambda stem: ends.get(stem, NOTHING), n, NOTHING)
            if spelled:
                fields[f"codes_{n}"] = chunks(codes_at[n])
        return fields

    def valid_codes(self) -> DataFrame:
        """Section letters and every leading part of every code."""
        parts = F.transform(F.sequence(F.lit(1), F.length("code")), lambda k: F.col("code").substr(F.lit(1), k))
        return (
            self.table.filter(F.length("code") > 0)
            .select(F.explode(F.concat(F.array("section"), parts)).alias("code"))
            .distinct()
        )

    def section_lookup(self) -> DataFrame:
        """Section of each two-digit division, the last row winning."""
        return (
            self.table.groupBy(F.substring("code", 1, 2).alias("division"))
            .agg(F.max_by("section", F.struct("position", "section")).alias("section"))
        )

    def lookup(self, levels: list[int]) -> DataFrame:
        """``(level, prefix, codes)``: the codes of a level found under each run of leading digits."""
        numeric = self.table.filter(F.col("code").rlike("^[0-9]+$"))
        wanted = [n for n in levels if n > 0]
        parts = []
        if wanted:
            level = F.explode(F.array(*[F.lit(n) for n in wanted]))
            parts.append(
                numeric.select("code", level.alias("level"))
                .filter(F.length("code") >= F.col("level"))
                .select("level", F.substring("code", F.lit(1), F.col("level")).alias("value"), F.col("level").alias("width"))
                .distinct()
                .select("level", F.col("value").alias("stem"), "value", "width")
            )
        if 0 in levels:
            sections = self.section_lookup().filter(F.col("division").rlike("^[0-9]{2}$"))
            parts.append(
                sections.select(
                    F.lit(0).alias("level"), F.col("division").alias("stem"), F.col("section").alias("value"), F.lit(2).alias("width")
                )
            )
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return (
            rows.select("level", "stem", "value", F.explode(F.sequence(F.lit(1), F.col("width"))).alias("k"))
            .groupBy("level", F.substring("stem", F.lit(1), F.col("k")).alias("prefix"))
            .agg(F.sort_array(F.collect_set("value")).alias("codes"))
        )

    def find(self, rows: DataFrame, code_col: str, levels: list[int], level_col: str) -> DataFrame:
        """Add ``codes``, the valid codes of the row's level meant by ``code_col``; null when there are none."""
        prefixes = self.lookup(levels).withColumnsRenamed({"level": "_of_level", "prefix": "_prefix"})
        if max(levels) <= BROADCAST_DIGITS:
            prefixes = F.broadcast(prefixes)
        width = level_width(F.col(level_col))
        keyed = rows.withColumn("_key", F.substring(code_stem(F.col(code_col)), F.lit(1), width))
        match = (F.col("_key") == F.col("_prefix")) & (F.col(level_col) == F.col("_of_level"))
        return keyed.join(prefixes, match, "left").drop("_key", "_prefix", "_of_level")

    def clean_one_code(
        self, rows: DataFrame, code_col: str, digits: int | list[int], out_col: str = "codes", level_col: str | None = None
    ) -> DataFrame:
        """Each row's single code as a set of valid codes, at one level or at the level in ``level_col``."""
        levels = digits if isinstance(digits, list) else [digits]
        levelled = rows if level_col else rows.withColumn("_digits", F.lit(levels[0]))
        found = self.find(levelled, code_col, levels, level_col or "_digits")
        return found.withColumn("codes", F.coalesce("codes", empty_set())).drop("_digits").withColumnRenamed("codes", out_col)

    def keep_valid(self, rows: DataFrame, code_col: str) -> DataFrame:
        """Rows whose code exists at any level."""
        return rows.join(self.valid_codes().withColumnRenamed("code", code_col), code_col, "left_semi")

    def sets_of(self, rows: DataFrame, row_cols: list[str], sides: list[Side], levels: list[int], spelled: bool = False) -> DataFrame:
        """``row_cols`` and ``levels``: the sets of all sides at each level, an array of ``struct(digits, <set>, <set>...)``.

        Every row is read where it is: nothing is joined, exploded or grouped.
        """
        # Named apart, since sides may call their lists alike.
        read = [F.struct(*[c.alias(name) for name, c in side.read.items()]).alias(f"side{i}") for i, side in enumerate(sides)]
        spell, single = (codes_meant, lambda codes: f"(size({codes}) = 1)") if spelled else (meant, single_text)

        def at(level: int) -> str:
            found = {}
            for i, side in enumerate(sides):
                lists = side.lists(f"given.side{i}", level)
                found |= side.decide({name: spell("given.index", stems, level) for name, stems in lists.items()}, single)
            return f"named_struct('digits', {level}, {', '.join(f"'{out}', {text}" for out, text in found.items())})"

        taken = [F.col(c).alias(f"c{i}") for i, c in enumerate(row_cols)]
        given = rows.select(*taken, F.struct(self.index(levels, spelled).alias("index"), *read).alias("given"))
        # As text: an expression made piece by piece takes longer to build than to plan.
        levels_of = F.expr(once("given", "given", f"array({', '.join(map(at, levels))})"))
        return given.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(row_cols)], levels_of.alias("levels"))

    def sets_of_one(self, rows: DataFrame, row_cols: list[str], code_col: str, out: str, levels: list[int]) -> DataFrame:
        """What ``sets_of`` gives, for rows that have a single code at most in ``code_col``, as it is written."""
        stem = F.substring(code_stem(F.col(code_col)), 1, CODE_LENGTH)
        placed = rows.select(*row_cols, place_of(stem).alias("_place"))
        index = self.index(levels)
        at = [F.struct(F.lit(n).alias("digits"), meant_by_one(index, F.col("_place"), n).alias(out)) for n in levels]
        return placed.select(*row_cols, F.array(*at).alias("levels"))

    def clean_code_sets(self, rows: DataFrame, row_cols: list[str], sides: list[Side], levels: list[int]) -> DataFrame:
        """Turn the codes listed in each row into sets of valid codes: ``row_cols`` and ``levels``, see ``sets_of``."""
        return self.sets_of(rows, row_cols, sides, levels, spelled=True)


def levels_laid_out() -> Column:
    """The sets inside ``levels`` as columns, a row for each level.

    ``levels`` always holds every level. An inner ``inline`` would have the optimizer drop empty lists first, by a filter
    that is pushed below the projection and so makes all sets a second time.
    """
    return F.inline_outer("levels")


@dataclass(frozen=True)
class Side:
    """Which raw columns some code sets are read from, and how.

    ``read`` are columns worked out once per row. ``lists`` takes the name of the struct that has them and a level and
    gives lists of stems, ``decide`` takes the sets these mean, and a test for sets of one code, and gives the resulting
    sets; all as SQL text.
    """

    read: dict[str, Column]
    lists: Callable[[str, int], dict[str, str]]
    decide: Callable[[dict[str, str], Callable[[str], str]], dict[str, str]]


def text_side(col: str, out: str, tokens: Callable[[Column], Column] = parse_codes) -> Side:
    """The codes written in one text column."""
    return Side({"codes": stems(tokens(F.col(col)), CODE_LENGTH)}, lambda read, level: {out: f"{read}.codes"}, lambda found, single: found)
