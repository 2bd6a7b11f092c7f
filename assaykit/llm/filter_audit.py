"""Which filter removes which documents, for every order in which filters can be applied.

A document's failed filters are its mask. Of all n! orders, in lexicographic order, those that begin with given filters
stand side by side; their place follows from the Lehmer digits of the beginning. So the orders in which a mask is removed
at a given step by a given filter are intervals of ranks, and a mask's count goes into a difference array at their ends
only. Prefix sums over the ranks give every order's totals. Documents are read once, whatever the number of orders.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.llm.common import broadcast_within, let

MOST_FILTERS = 6  # 720 orders; the tables below are as long as the number of orders


def interval(beginning: tuple[int, ...], n: int) -> tuple[int, int]:
    """First rank, and the one after the last, of the orders of range(n) that begin so: Lehmer digits times factorials."""
    digits = [sum(y < x and y not in beginning[:i] for y in range(n)) for i, x in enumerate(beginning)]
    first = sum(d * math.factorial(n - 1 - i) for i, d in enumerate(digits))
    return first, first + math.factorial(n - len(beginning))


def mask_intervals(spark: SparkSession, n: int) -> DataFrame:
    """(mask, step, ends: array of (rank, sign)): where a mask is removed at ``step``. Adjoining intervals are joined."""
    rows = []
    for mask in range(1, 1 << n):
        failed, passed = [f for f in range(n) if mask >> f & 1], [f for f in range(n) if not mask >> f & 1]
        for step in range(1, len(passed) + 2):
            signs: dict[int, int] = {}
            for before in permutations(passed, step - 1):
                for f in failed:
                    first, end = interval((*before, f), n)
                    signs[first], signs[end] = signs.get(first, 0) + 1, signs.get(end, 0) - 1
            rows.append((mask, step, [(rank, sign) for rank, sign in sorted(signs.items()) if sign]))
    return spark.createDataFrame(rows, "mask int, step int, ends array<struct<rank: int, sign: int>>")


def text_checks(text: Column) -> dict[str, Column]:
    """The checks that look at one text, by letter: true where it fails. Null text is empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counted = let(words, lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.octet_length(F.regexp_replace(whole, "[^A-Z]+", ""))
    return {
        "A": counted["words"] < 50,
        "B": 100 * counted["distinct"] < 65 * counted["words"],
        "C": 100 * capitals.cast("long") > 5 * F.char_length(whole).cast("long"),
        "D": whole.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, checks: dict[str, Column], flags: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source", flag_rows: int = 1_000_000) -> DataFrame:
    """Documents counted by part, mask and flags: ``part``, ``mask``, the flags (boolean) and ``n``.

    ``checks`` take bits 0, 1 ..., the last bit is for a text that a smaller doc_id has too, in the whole table. ``flags``
    has doc_id and boolean columns; an id that it lacks has none, and one of several rows has a flag if any of them has.
    A null part is the empty string, null text is empty; rows without an id are no one's earlier copy and have none.
    Texts stay where they are read: only their digests are dealt, counted per id first, so that a text of a third of
    all rows meets in one task as one row of each part, mask and flag.
    """
    names = [c for c in flags.columns if c != "doc_id"]
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks.values())]
    rows = docs.select(
        docs[doc_id].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")), 256)).alias("digest"),
        sum(bits, F.lit(0)).cast("int").alias("mask"),
    )
    marked = flags.groupBy(F.col("doc_id").alias("id")).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in names])
    rows = rows.join(broadcast_within(marked, flag_rows), "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in names})
    alike = ["digest", "part", "mask", *names]
    by_id = rows.groupBy(*alike, "id").agg(F.count("*").alias("n"))
    with_id = F.col("id").isNotNull()
    groups = by_id.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum(F.when(with_id, F.col("n"))).alias("named"), F.min(F.when(with_id, F.struct("id", "n"))).alias("first"))
    keepers = groups.groupBy("digest").agg(F.min("first.id").alias("keeper"))
    each = groups.join(keepers, "digest")
    copies = F.coalesce(F.col("named") - F.when(F.col("first.id") == F.col("keeper"), F.col("first.n")).otherwise(0), F.lit(0))
    last = 1 << len(checks)
    split = F.array(F.struct((F.col("mask") + last).alias("mask"), copies.alias("n")), F.struct(F.col("mask").alias("mask"), (F.col("n") - copies).alias("n")))
    both = each.select("part", *names, F.inline(split)).where("n > 0")
    return both.groupBy("part", "mask", *names).agg(F.sum("n").alias("n"))


def audit(counts: DataFrame, letters: str, flags: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, zeros included; ``counts`` as ``masks`` gives them.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, ``<flag>_lost`` and shapley (removed by the
    step's filter, over all orders). A part without documents isn't known and has no rows.
    """
    spark, n = counts.sparkSession, len(letters)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    sums = [F.sum("n").alias("n"), *[F.sum(F.when(F.col(f), F.col("n")).otherwise(0)).alias(f) for f in flags]]
    of_mask = counts.groupBy("part", "mask").agg(*sums)
    ends = of_mask.join(F.broadcast(mask_intervals(spark, n)), "mask").select("part", "step", F.inline("ends"), "n", *flags)  # fixed size
    removed = ["n", *flags]
    differences = ends.groupBy("part", "step", "rank").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in removed])
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << f) != 0, F.col("n")).otherwise(0)) for f in range(n)]
    alone = [F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(0)) for f in range(n)]
    parts = of_mask.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    order = [(rank, "".join(p), step, letters.index(p[step - 1])) for rank, p in enumerate(permutations(letters)) for step in range(1, n + 1)]
    grid = parts.join(F.broadcast(spark.createDataFrame(order, "rank int, filter_order string, step int, filter int")))  # fixed size
    filled = grid.join(differences, ["part", "step", "rank"], "left").fillna(0, removed)
    along, earlier = Window.partitionBy("part", "step").orderBy("rank"), Window.partitionBy("part", "rank").orderBy("step")
    summed = filled.withColumns({c: F.sum(c).over(along) for c in removed})
    whole = summed.withColumns({"gone": F.sum("n").over(earlier), "shapley": F.sum("n").over(Window.partitionBy("part", "filter"))})
    long = lambda c, name: c.cast("long").alias(name)
    return whole.select(
        "part", "filter_order", "step", long(F.col("total") - F.col("gone"), "kept"), long(F.col("n"), "removed"), long(F.get("fails", F.col("filter")) - F.col("n"), "redundant"),
        long(F.get("alone", F.col("filter")), "unique_fails"), *[long(F.col(f), f"{f}_lost") for f in flags], long(F.col("shapley"), "shapley"),
    )
