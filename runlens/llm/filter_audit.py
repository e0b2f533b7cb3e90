"""Audit of how filters interact: what each removes at each place of every order in which they can be applied.

The failures of a document are bits of a mask, so a part of the corpus becomes at most 2^5 cells of counts. A
recursive query then extends every prefix of filters by each filter that it does not hold yet, joins the cells
of the part, and carries the bits applied so far; each level of the recursion gives the figures of that step.
A prefix is worked on once however many orders begin with it. Texts are read once, and what is shuffled of a
document is its mask and a digest.
"""

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import checkpoint

FILTERS = "ABCDE"
_ROWS = "spark.sql.cteRecursionRowLimit"


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: few words, repeated words, capitals, marks."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # Bound as a field, so that the text is split once.
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct")))
    n, distinct = F.get(counted, F.lit(0))["n"], F.get(counted, F.lit(0))["distinct"]
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("bigint")
    tests = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text).cast("bigint"), text.rlike(r"[#$%&*|]"))
    bits = F.lit(0)
    for place, test in enumerate(tests):
        bits = bits + F.when(test, 1 << place).otherwise(0)
    return bits


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents of a part that fail exactly the filters of ``mask``."""
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"))
    # Rows alike in all of it count once from here on.
    facts = checkpoint(facts.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")))
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # Joined by digest and id, so that the copies of one text are spread.
    flagged = facts.join(firsts, ["digest", "doc_id"], "left")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    flagged = flagged.withColumn("mask", F.col("mask") + F.when(later, 1 << FILTERS.index("E")).otherwise(0))
    of_id = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    labelled = flagged.join(of_id, "doc_id", "left")
    share = lambda name: F.sum(F.col("n") * F.coalesce(name, F.lit(0))).alias(name)
    return labelled.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("good"), share("toxic"))


_AUDIT = """
WITH RECURSIVE audit (part, filter_order, step, filter, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, '', 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT part, filter_order || added.filter, step + 1, added.filter, applied | added.bit,
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & (applied | added.bit) = 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & applied = 0 AND c.mask & added.bit > 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & applied > 0 AND c.mask & added.bit > 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask = added.bit, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & applied = 0 AND c.mask & added.bit > 0, c.good, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & applied = 0 AND c.mask & added.bit > 0, c.toxic, 0L))
  FROM (
    SELECT a.part, a.filter_order, a.step, a.applied, p.cells, explode(filter({letters}, l -> a.applied & l.bit = 0)) AS added
    FROM audit a JOIN {cells} p ON p.part = a.part WHERE a.step < {steps}))
SELECT part, filter_order AS prefix, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM audit WHERE step > 0
"""


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` has doc_id, source, text, ``labels`` doc_id, quality, toxic; other columns are ignored. A part is a
    source, and '' holds null sources too. Filters: A under 200 words, B fewer than half of the words distinct,
    C more than 2 % of the characters in A-Z, D any of ``#$%&*|``, E a text that a smaller id has too. Null texts
    count as empty. A null id is neither smaller nor larger than another, so such rows never fail E; rows of one
    id with one text neither. A document has a label if any row of its id has it. All 120 orders and 5 steps of a
    part are there, zeros included; an empty table gives no rows. ``filter`` names the step's filter.
    """
    spark = docs.sparkSession
    cell = F.struct("mask", "n", "good", "toxic")
    # At most 32 cells a part.
    parts = checkpoint(mask_cells(docs, labels).groupBy("part").agg(F.collect_list(cell).alias("cells")))
    letters = ", ".join(f"named_struct('filter', '{name}', 'bit', {1 << place})" for place, name in enumerate(FILTERS))
    # There are as many rows as the parts have prefixes; Spark's own limit is for recursions that may not end.
    limit = spark.conf.get(_ROWS, None)
    spark.conf.set(_ROWS, "-1")
    try:
        prefixes = checkpoint(_prefixes(parts, f"array({letters})"))
    finally:
        spark.conf.unset(_ROWS) if limit is None else spark.conf.set(_ROWS, limit)
    orders = prefixes.filter(F.col("step") == len(FILTERS)).select(
        "part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    orders = orders.withColumn("prefix", F.col("filter_order").substr(F.lit(1), F.col("step")))
    rows = orders.join(prefixes, ["part", "prefix", "step"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return rows.select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
                       shapley.alias("shapley"))


def _prefixes(parts: DataFrame, letters: str) -> DataFrame:
    spark, view = parts.sparkSession, f"audit_{uuid4().hex}"
    parts.createTempView(view)
    try:
        return spark.sql(_AUDIT.format(cells=view, letters=letters, steps=len(FILTERS)))
    finally:
        spark.catalog.dropTempView(view)
