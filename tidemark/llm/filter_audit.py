"""Filter interaction audit: what each filter removes in every order in which the filters could run.

A document is known by its *mask*, the set of filters that it fails; documents of a part and mask are counted once, by
partial sums, and texts are not needed after that. For a mask, the step that removes it depends only on the order's
first letters up to the first one that fails it. The orders with those first letters stand side by side in
lexicographic order, so each removal step of a mask covers intervals of Lehmer ranks. The counts are added where an
interval starts, subtracted where it ends, and a running sum over the ranks gives every order's figures at once, in
place of one pass for each order and filter.

Defined results: a null text is empty (no words, no characters), a null part is the empty string. A document with a
null id takes part in all counts, has no smaller or larger id and no labels. Repeated rows of one id are documents of
their own, and none of them is smaller than the other. A document has a label if any row of the labels gives it that
label. An empty table has no parts and gives no rows. Columns other than those that are named are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FILTERS = "ABCDE"
AMOUNTS = ("n", "good", "toxic")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask (bit 0 for filter A), good, toxic (0 or 1): one row a document.

    The four filters that look at one text are evaluated where it is read; only its digest is shuffled, to meet the
    smallest id of its copies. Copies are made one row a task before that, and the join back may be split where a text
    is very frequent.
    """
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    t = t.withColumn("words", words_of(F.col("text")))
    fails = [
        F.size("words") < 100,
        100 * F.size(F.array_distinct("words")) < 80 * F.size("words"),
        100 * F.regexp_count("text", F.lit("[A-Z]")) > 10 * F.length("text"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    alone = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    t = stored(t.select("id", "part", alone.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("sha")), "masks")

    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
    known = known.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    # Written, so that the join has a shuffle of its own on this side too, without which the other cannot be split.
    copies = stored(t.groupBy("sha").agg(F.min("id").alias("least"), F.count("*").alias("times")).where("times > 1").select("sha", "least"), "copies")
    t = t.join(known, "id", "left").join(copies, "sha", "left")
    again = F.when(F.col("id") > F.col("least"), 1 << 4).otherwise(0)
    return t.select("part", (F.col("mask") + again).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(filters: str) -> list[str]:
    """All orders by their Lehmer rank, which is their place in lexicographic order."""
    return ["".join(p) for p in itertools.permutations(sorted(filters))]


def rank(order: str) -> int:
    """The Lehmer code's value: for each letter, the later ones that are smaller, in the factorial number system."""
    k = len(order)
    return sum(sum(b < a for b in order[i + 1 :]) * math.factorial(k - 1 - i) for i, a in enumerate(order))


def intervals(filters: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last): where documents of that mask are removed at that step.

    The letters before the step pass the mask, the step's letter fails it, and all orders of the rest follow in one run
    of ranks. Runs that touch are joined.
    """
    letters, out = sorted(filters), []
    bit = {f: 1 << i for i, f in enumerate(filters)}
    for mask in range(1, 1 << len(filters)):
        passing = [f for f in letters if not mask & bit[f]]
        failing = [f for f in letters if mask & bit[f]]
        for step in range(1, len(passing) + 2):
            length, runs = math.factorial(len(letters) - step), []
            for before in itertools.permutations(passing, step - 1):
                for f in failing:
                    rest = [x for x in letters if x not in before and x != f]
                    start = rank("".join([*before, f, *rest]))
                    runs.append((start, start + length))
            for start, end in sorted(runs):
                if out and out[-1][:2] == (mask, step) and out[-1][3] == start:
                    start = out.pop()[2]
                out.append((mask, step, start, end))
    return out


def audit(masked: DataFrame, filters: str = FILTERS) -> DataFrame:
    """masked: part, mask, good, toxic. One row a part, order and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    Only the counts of each part and mask go on, which are at most 2 ** len(filters) rows a part.
    """
    spark, k, n_orders = masked.sparkSession, len(filters), math.factorial(len(filters))
    counts = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counts = stored(counts, "audit")

    ends = [(m, s, at, sign) for m, s, a, b in intervals(filters) for at, sign in ((a, 1), (b, -1)) if at < n_orders]
    ends = spark.createDataFrame(ends, "mask int, step int, rank int, sign int")
    differences = counts.join(F.broadcast(ends), "mask").groupBy("part", "step", "rank").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in AMOUNTS])

    def held(f: str, only: bool = False) -> Column:
        bit = 1 << filters.index(f)
        fails = F.col("mask") == bit if only else F.col("mask").bitwiseAND(bit) > 0
        return F.sum(F.when(fails, F.col("n")).otherwise(0))

    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*map(held, filters)).alias("fails"), F.array(*[held(f, True) for f in filters]).alias("only"))
    grid = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(n_orders - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    by_rank = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    t = grid.join(differences, ["part", "step", "rank"], "left").withColumns({c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(by_rank) for c in AMOUNTS})

    named = F.array(*map(F.lit, orders(filters)))
    t = t.withColumn("filter_order", F.element_at(named, F.col("rank") + 1)).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    at = F.instr(F.lit(filters), F.col("letter"))
    by_step = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return t.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("n").over(by_step)).alias("kept"),
        F.col("n").alias("removed"),
        (F.element_at("fails", at) - F.col("n")).alias("redundant"),
        F.element_at("only", at).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    return audit(masks(docs, labels, **columns))


#: By definition: every order and step looks at every mask.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS mask,
  count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
g AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
h AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before, filter_order[1:step] AS until FROM g),
y AS (SELECT part, filter_order, step, letter,
  sum(CASE WHEN translate(mask, until, '') = mask THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN contains(mask, letter) AND translate(mask, before, '') = mask THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN contains(mask, letter) AND translate(mask, before, '') <> mask THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = letter THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN contains(mask, letter) AND translate(mask, before, '') = mask THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN contains(mask, letter) AND translate(mask, before, '') = mask THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, h GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM y"""
