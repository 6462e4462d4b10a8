"""Pairs of records that share an id, counted without being formed.

An id on many rows of two tables has as many pairs as its rows multiplied. Of the pairs only counts are wanted: how many
there are, and in how many the two code sets share a code. The first is a product of two counts. The second follows from
how many sets of either table hold each combination of codes (inclusion and exclusion): every short set is laid out into
its combinations, these are counted on either side, and the counts are multiplied where id and combination are equal.
A set is dealt out by id and first code of its combinations, once for each, and laid out in the task it is dealt to: the
combinations, several times as many, are neither moved nor joined. Sets with too many combinations are paired one by one.

Sets are intervals of numbered codes (``functions.intervals``). Two intervals share a code when one holds the other, so
both give a key by which they meet: the holding interval, marked with the table it comes from.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetally.functions.intervals import NOTHING, SPAN, SPAN_BITS, is_single, overlaps
from codetally.functions.sets import once
from codetally.lineage import carried, written
from codetally.operators.joins import hot_ids, id_text, join_on_id, join_repeated_ids

#: Sets of more intervals on the human side, or with more combinations on either, are paired one by one.
LONGEST = 8
MOST_COMBINATIONS = 2000
#: Sets' codes for which a task lays out combinations, about ten times as many rows.
CODES_AT_ONCE = 100_000


def first_code(interval: Column) -> Column:
    return F.shiftright(interval, SPAN_BITS)


def last_code(interval: Column) -> Column:
    return interval.bitwiseAND(F.lit(SPAN - 1))


def apart(codes: Column) -> Column:
    """The intervals of a set in order, without those that another one holds."""
    holds = lambda wide, narrow: (wide != narrow) & (first_code(wide) <= first_code(narrow)) & (last_code(narrow) <= last_code(wide))
    free = F.filter(codes, lambda narrow: ~F.exists(codes, lambda wide: holds(wide, narrow)))
    return F.sort_array(F.when(F.size(codes) < 2, codes).otherwise(free))


def counted_sets(sets: DataFrame, keys: list[str], codes_col: str) -> DataFrame:
    """``keys``, ``codes``, ``single`` and ``records``: equal sets of a key as one row, written."""
    rows = sets.select(*keys, apart(F.col(codes_col)).alias("codes"), is_single(F.col(codes_col)).alias("single"), "records")
    return written(rows.groupBy(*keys, "codes", "single").agg(F.sum("records").alias("records")))


class Holders:
    """The intervals of several codes that occur in a table, found from a code's number: at most 111,110 numbers a level.

    At most four of different widths hold a code, so there are at most as many lists a level, each with one for every code.
    """

    def __init__(self, sets: DataFrame):
        each = sets.select("digits", F.explode("codes").alias("interval"))
        found = each.filter(first_code(F.col("interval")) < last_code(F.col("interval"))).distinct().collect()
        self.lists: dict[int, list[list[int]]] = {}
        # Wide ones first: the lists have a code's holders from the widest to the narrowest.
        for digits, interval in sorted(found, key=lambda row: -((row[1] & (SPAN - 1)) - (row[1] >> SPAN_BITS))):
            lists = self.lists.setdefault(digits, [])
            first, last = interval >> SPAN_BITS, interval & (SPAN - 1)
            depth = next((i for i, known in enumerate(lists) if len(known) <= first or known[first] == NOTHING), len(lists))
            if depth == len(lists):
                lists.append([])
            known = lists[depth]
            known.extend([NOTHING] * (last + 1 - len(known)))
            known[first:last + 1] = [interval] * (last + 1 - first)
        named = {f"of_{level}_{depth}": ("array<bigint>", known) for level, lists in self.lists.items() for depth, known in enumerate(lists)}
        self.table = carried(sets.sparkSession, named or {"none": ("array<bigint>", [])})

    def looked_up(self, df: DataFrame, out: str, body: Callable[[Column], Column]) -> DataFrame:
        """``df`` with a column made by ``body`` from the lists, which no row is written with: the two projections become one."""
        beside = df.select(*df.columns, self.table.scalar().alias("_lists"))
        return beside.select(*df.columns, once(F.col("_lists"), body).alias(out))

    def of(self, interval: Column, digits: Column, lists: Column) -> Column:
        """The intervals that hold this one and are not the same."""
        none = F.array().cast("array<bigint>")
        holding = F.lit(None).cast("array<bigint>")
        for level, known in self.lists.items():
            at = [F.get(lists[f"of_{level}_{depth}"], first_code(interval).cast("int")) for depth in range(len(known))]
            wider = F.filter(F.array(*at), lambda w: (w != NOTHING) & (w != interval) & (last_code(w) >= last_code(interval)))
            holding = F.when(digits == level, wider).otherwise(holding)
        return F.coalesce(holding, none) if self.lists else none


def keys_of_truth(truth: Column, digits: Column, other: Holders, lists: Column) -> Column:
    """The keys by which a set meets those of the other table: its intervals, what holds them there, and its wide ones as
    holders. Two sets have no more keys in common than either has intervals."""
    own = lambda i: F.when(first_code(i) < last_code(i), F.array(i * 2 + 1)).otherwise(F.array().cast("array<bigint>"))
    return distinct_keys(F.transform(truth, lambda i: F.concat(F.array(i * 2), F.transform(other.of(i, digits, lists), lambda w: w * 2), own(i))))


def keys_of_model(model: Column, digits: Column, other: Holders, lists: Column) -> Column:
    """The same seen from the other table: its intervals, and what holds them among the human sets."""
    return distinct_keys(F.transform(model, lambda i: F.concat(F.array(i * 2), F.transform(other.of(i, digits, lists), lambda w: w * 2 + 1))))


def distinct_keys(keys: Column) -> Column:
    """Intervals below the same holder give its key once."""
    return F.sort_array(F.array_distinct(F.flatten(keys)))


def combinations(keys: Column, most: int) -> Column:
    """Every choice of 1 to ``most`` keys, each in order."""
    def longer(found: Column, key: Column) -> Column:
        return F.concat(found, F.transform(F.filter(found, lambda c: F.size(c) < most), lambda c: F.concat(c, F.array(key))))

    none = F.array(F.array().cast("array<bigint>"))
    return F.filter(F.aggregate(keys, none, longer), lambda c: F.size(c) > 0)


def number_of_combinations(keys: Column, most: int) -> Column:
    count, term, total = F.size(keys).cast("double"), F.lit(1.0), F.lit(0.0)
    for taken in range(1, most + 1):
        term = term * F.greatest(count - (taken - 1), F.lit(0.0)) / taken
        total = total + term
    return total


def is_few(keys: Column, most: int) -> Column:
    """Whether a set's combinations are laid out."""
    return number_of_combinations(keys, most) <= MOST_COMBINATIONS


def choices(keys: Column, most: int) -> Column:
    """Every choice of up to ``most`` keys, with none as well."""
    none = F.array(F.array().cast("array<bigint>"))
    return none if most < 1 else F.concat(none, combinations(keys, most))


def after(listed: Column, at: Column) -> Column:
    """What follows a place of a list."""
    return F.slice(listed, at + 2, F.size(listed))


def first_keys(keys: Column) -> Column:
    """Each key with those that follow it."""
    return F.transform(keys, lambda key, at: F.struct(key.alias("first"), after(keys, at).alias("rest")))


def dealt_combinations(rows: DataFrame, at: list[str], most: int, tasks: int) -> DataFrame:
    """A row for each combination of ``_first`` with up to ``most`` - 1 of the keys in ``_rest``: ``_first``, ``_second`` and
    ``_rest``. They are dealt by ``at`` and ``_first``; where these hold many rows, and only there, by the second key as well.
    """
    others = [c for c in rows.columns if c != "_rest"]
    none = F.lit(None).cast("bigint")
    laid = rows.withColumn("_second", none)
    if most > 1:
        alone = F.struct(none.alias("second"), F.array().cast("array<bigint>").alias("rest"))
        seconds = F.transform("_rest", lambda key, i: F.struct(key.alias("second"), after(F.col("_rest"), i).alias("rest")))
        whole = F.array(F.struct(none.alias("second"), F.col("_rest").alias("rest")))
        parts = F.when(F.col("_hot_id").isNotNull(), F.concat(F.array(alone), seconds)).otherwise(whole)
        hot = F.broadcast(hot_ids(rows, [*at, "_first"]).select("_hot_id"))
        marked = rows.withColumn("_id", id_text([*at, "_first"])).join(hot, F.col("_id") == F.col("_hot_id"), "left")
        laid = marked.select(*others, F.explode_outer(parts).alias("_part")).select(*others, F.col("_part.second").alias("_second"), F.col("_part.rest").alias("_rest"))
    dealt = laid.repartition(tasks, *at, "_first", "_second")
    held = F.when(F.col("_second").isNull(), choices(F.col("_rest"), most - 1)).otherwise(choices(F.col("_rest"), most - 2))
    return dealt.select(*others, "_second", F.explode_outer(held).alias("_rest"))


def sharing_pairs(truth: DataFrame, model: DataFrame, id_col: str, by: list[str]) -> DataFrame:
    """``by``, ``digits``, ``single_truth``, ``single_model``, ``records``: pairs of one id whose sets share a code.

    Both tables are results of ``counted_sets`` per id and ``digits``, the model's per ``by`` as well. The numbers of the
    rows add up to the pairs; a single one may be negative.
    """
    at = [id_col, "digits"]
    digits = F.col("digits")
    size = F.size("codes")
    longest, codes = zip(*[df.agg(F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first() for df in (truth, model)])
    most = min(LONGEST, *longest)
    tasks = max(truth.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(codes) / CODES_AT_ONCE))
    of_truth, of_model = Holders(truth), Holders(model)
    shown = [*by, "digits", "single_truth", "single_model"]

    def laid_out(df: DataFrame, other: Holders, keys_of, human: bool) -> DataFrame:
        def parts(lists: Column) -> Column:
            short = F.size("codes") <= LONGEST if human else F.lit(True)
            return once(keys_of(F.col("codes"), digits, other, lists), lambda keys: F.when(short & is_few(keys, most), first_keys(keys)))

        kinds = {name: F.lit(None).cast(model.schema[name].dataType) if human else F.col(name) for name in by}
        # Outer here and above, since else the optimizer looks for empty lists beforehand and so makes them a second time.
        each = other.looked_up(df, "_parts", parts).select(
            *at, *[c.alias(name) for name, c in kinds.items()], F.lit(human).alias("_is_truth"), "single", "records", F.explode_outer("_parts").alias("_part")
        )
        return each.select(*[c for c in each.columns if c != "_part"], F.col("_part.first").alias("_first"), F.col("_part.rest").alias("_rest")).filter("_first is not null")

    both = laid_out(truth, of_model, keys_of_truth, True).unionByName(laid_out(model, of_truth, keys_of_model, False))
    combination = [*at, "_first", "_second", "_rest"]
    held = dealt_combinations(both, at, most, tasks).groupBy(*combination, *by, "_is_truth", "single").agg(F.sum("records").alias("records"))
    # As a window, for which the rows stay where they are; a join would deal them again.
    here = Window.partitionBy(*combination)
    met = held.withColumns({
        name: F.sum(F.when(F.col("_is_truth") & (F.col("single") == single), F.col("records"))).over(here) for name, single in (("_single", True), ("_several", False))
    }).filter(~F.col("_is_truth"))
    taken = F.size("_rest") + F.when(F.col("_second").isNull(), 1).otherwise(2)
    signed = F.col("records") * F.when(taken % 2 == 1, 1).otherwise(-1)
    kinds = [F.struct(F.lit(single).alias("single_truth"), (signed * F.col(name)).alias("records")) for name, single in (("_single", True), ("_several", False))]
    found = met.select(*by, "digits", F.col("single").alias("single_model"), F.inline(F.array(*kinds))).filter("records is not null").select(*shown, "records")

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        renamed = left.withColumnsRenamed({"single": "single_truth", "records": "n_truth", "codes": "truth"})
        pairs = join_repeated_ids(right.withColumnsRenamed({"single": "single_model", "records": "n_model", "codes": "model"}), renamed, at)
        return pairs.filter(overlaps(F.col("truth"), F.col("model"))).select(*shown, (F.col("n_truth") * F.col("n_model")).alias("records"))

    def marked(df: DataFrame, other: Holders, keys_of, human: bool) -> DataFrame:
        def is_short(lists: Column) -> Column:
            few = once(keys_of(F.col("codes"), digits, other, lists), lambda keys: is_few(keys, most))
            return (F.size("codes") <= LONGEST) & few if human else few

        return other.looked_up(df, "_short", is_short)

    plain = [marked(truth, of_model, keys_of_truth, True), marked(model, of_truth, keys_of_model, False)]
    long = [df.filter(~F.col("_short")).drop("_short") for df in plain]
    for left, right in ((long[0], model), (plain[0].filter("_short").drop("_short"), long[1])):
        found = found.unionByName(beside(left, right))
    return found


def compared_pairs(truth: DataFrame, model: DataFrame, id_col: str, by: list[str]) -> DataFrame:
    """All pairs of records of one id by what is known of their sets: ``by``, ``digits``, ``single_truth``,
    ``single_model``, ``overlap`` and ``records``, numbers that add up to the pairs."""
    at = [id_col, "digits"]
    sides = [
        df.groupBy(*keys, F.col("single").alias(name)).agg(F.sum("records").alias(count))
        for df, keys, name, count in ((truth, at, "single_truth", "n_truth"), (model, [*at, *by], "single_model", "n_model"))
    ]
    shown = [*by, "digits", "single_truth", "single_model"]
    every = join_on_id(sides[1], sides[0], at).select(*shown, F.lit(False).alias("overlap"), (F.col("n_truth") * F.col("n_model")).alias("records"))
    shared = sharing_pairs(truth, model, id_col, by).groupBy(*shown).agg(F.sum("records").alias("records"))
    moved = F.inline(F.array(
        F.struct(F.lit(True).alias("overlap"), F.col("records")), F.struct(F.lit(False).alias("overlap"), (-F.col("records")).alias("records"))
    ))
    return every.unionByName(shared.select(*shown, moved))


def nearest_pairs(truth: DataFrame, nearest: DataFrame, id_col: str, by: list[str], least_col: str) -> DataFrame:
    """All pairs of records of one id by whether the code numbered ``least_col`` is in the human set: ``by``, ``digits``,
    ``single_truth``, ``top_in_truth`` and ``records``, numbers that add up to the pairs."""
    at = [id_col, "digits"]
    totals = truth.groupBy(*at).agg(F.sum("records").alias("n_all"), F.sum(F.when(F.col("single"), F.col("records")).otherwise(0)).alias("n_single"))
    intervals = truth.select(*at, "single", "records", F.explode("codes").alias("_interval"))
    holding = intervals.groupBy(*at, "_interval").agg(
        F.sum("records").alias("n_all"), F.sum(F.when(F.col("single"), F.col("records")).otherwise(0)).alias("n_single")
    )

    def counted(pairs: DataFrame, outcomes: list[tuple[bool, int]]) -> DataFrame:
        kinds = [
            F.struct(F.lit(single).alias("single_truth"), F.lit(hit).alias("top_in_truth"), (F.col("records") * n * sign).alias("records"))
            for hit, sign in outcomes
            for single, n in ((True, F.col("n_single")), (False, F.col("n_all") - F.col("n_single")))
        ]
        return pairs.select(*by, "digits", F.inline(F.filter(F.array(*kinds), lambda k: k["records"] != 0)))

    every = counted(join_repeated_ids(nearest, totals, at), [(False, 1)])
    itself = F.col(least_col) * SPAN + F.col(least_col)
    wider = Holders(truth)
    asked = wider.looked_up(
        nearest.filter(F.col(least_col).isNotNull()), "_holders", lambda lists: F.concat(F.array(itself), wider.of(itself, F.col("digits"), lists))
    )
    asked = asked.withColumn("_interval", F.explode("_holders")).drop("_holders")
    inside = counted(join_repeated_ids(asked, holding, [*at, "_interval"]), [(True, 1), (False, -1)])
    return every.unionByName(inside)
