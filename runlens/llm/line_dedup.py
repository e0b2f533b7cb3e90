"""Line dedup over a corpus by a deletion-neighbourhood join (Bocek, Hunt and Stiller 2007), edit bound one.

Two lines within one edit share a variant with at most one character deleted: a replaced character leaves the
same rest at the same place, an inserted one leaves the other line itself. So lines stand under the hash of
every such variant, with the place of the deletion:

* lines under one variant and place differ in that character alone. They are all within the bound of each
  other, at most one per character, and each is compared with the earliest of them;
* a line that is itself a variant of another is compared with that one.

No pairs within a group are listed. Only lines that can have a partner emit variants: one edit leaves the
first or the last half of a line as it is, so a line whose halves (by length) no other line shares is out.
Equal lines are one line with its first occurrence from the start.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import checkpoint

_CHUNK = 128
_FIRST = ["no_id", "doc_id", "text_hash", "line_no"]


def _judged(line: Column, least: int, keep_blank: bool) -> Column:
    """Whether a line is compared at all."""
    long = F.length(line) >= least
    return long & line.rlike(r"\S") if keep_blank else long


def _lines(docs: DataFrame, least: int, keep_blank: bool) -> DataFrame:
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.filter(_judged(F.col("line"), least, keep_blank)).select(
        "*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), F.col("doc_id").isNull().alias("no_id"))


def _halves(line: Column) -> Column:
    """Keys under which a line meets all lines within one edit: its halves, by its own and the next smaller length."""
    keys = []
    for less in (0, 1):
        length = F.length(line) - less
        cut = F.floor(length / 2).cast("int")
        keys.append(F.xxhash64(F.lit(0), length, F.substring(line, F.lit(1), cut)))
        keys.append(F.xxhash64(F.lit(1), length, F.right(line, length - cut)))
    return F.array(*keys)


def _meeting(firsts: DataFrame) -> DataFrame:
    """Hashes ``h`` of lines that share a half with a different line."""
    keys = firsts.filter("halves IS NOT NULL").select("h", F.explode("halves").alias("key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low != high").select("key")
    return keys.join(shared, "key", "left_semi").select("h").distinct()


def _variants(lines: DataFrame) -> DataFrame:
    """(h, variant, place) of every line (h, line): itself at place 0, and without each of its characters.

    A text is hashed in chunks of ``_CHUNK`` characters, whose hashes with their numbers are combined. Without a
    character, the chunks before its own stay, those after it move by one character, and only its own is cut: so
    a variant costs a chunk and not a line, and a line as much as its length.
    """
    xor = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda x, y: x.bitwiseXOR(y))
    hashed = lambda chunk, number: F.when(chunk == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(chunk, number))
    once = lambda value: F.explode(F.array(value))  # noqa: E731  generated, so that it is not built again at every use
    numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.length("line"), F.lit(1)) - 1) / _CHUNK).cast("int"))
    # Each chunk with the character after it.
    cut = lines.select("h", once(F.transform(numbers, lambda j: F.substring(F.col("line"), j * _CHUNK + 1, F.lit(_CHUNK + 1)))).alias("chunks"))
    sides = cut.select("h", "chunks", once(F.struct(
        F.transform("chunks", lambda c, j: hashed(F.substring(c, 1, _CHUNK), j)).alias("here"),
        F.transform("chunks", lambda c, j: hashed(F.substring(c, 2, _CHUNK), j)).alias("moved"))).alias("s"))
    each = sides.select("h", "s", F.posexplode("chunks").alias("j", "chunk"))
    around = xor(F.slice("s.here", F.lit(1), F.col("j"))).bitwiseXOR(xor(F.slice("s.moved", F.col("j") + 2, F.size("s.moved"))))
    bound = each.select("h", "j", "chunk", once(F.struct(around.alias("around"), F.when(F.col("j") == 0, xor(F.col("s.here"))).alias("own"))).alias("x"))
    without = F.transform(F.sequence(F.lit(1), F.least(F.length("chunk"), F.lit(_CHUNK))), lambda i: F.struct(
        F.col("x.around").bitwiseXOR(hashed(F.concat(F.substring(F.col("chunk"), F.lit(1), i - 1), F.substring(F.col("chunk"), i + 1, F.lit(_CHUNK))), F.col("j")))
        .alias("variant"), (F.col("j") * _CHUNK + i).alias("place")))
    whole = F.array(F.struct(F.col("x.own").alias("variant"), F.lit(0).alias("place")))
    return bound.filter("chunk != ''").select("h", F.inline(F.when(F.col("j") == 0, F.concat(whole, without)).otherwise(without)))


def _neighbours(lines: DataFrame) -> DataFrame:
    """(later, earlier): pairs of distinct lines (h, line, first) within one edit, a star per variant."""
    stands = checkpoint(_variants(lines.select("h", "line")))
    shared = stands.groupBy("variant").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low != high")
    met = checkpoint(stands.join(shared.select("variant"), "variant", "left_semi").join(lines.select("h", "first"), "h"))

    # One line per character of the alphabet at most.
    place = Window.partitionBy("variant", "place")
    earliest = F.min(F.struct("first", "h")).over(place)
    replaced = met.filter("place > 0").select(F.col("h").alias("later"), earliest["h"].alias("earlier"), "place", F.lit(0).alias("longer"))
    whole = met.filter("place = 0").select("variant", F.col("h").alias("other"), F.col("first").alias("other_first"))
    longer = met.filter("place > 0").join(whole, "variant").filter("h != other")
    after = F.col("first") > F.col("other_first")
    inserted = longer.select(F.when(after, F.col("h")).otherwise(F.col("other")).alias("later"),
                             F.when(after, F.col("other")).otherwise(F.col("h")).alias("earlier"), "place", F.when(after, 1).otherwise(2).alias("longer"))
    pairs = replaced.filter("later != earlier").unionAll(inserted)
    texts = lines.select("h", "line")
    both = (
        pairs.join(texts.select(F.col("h").alias("later"), F.col("line").alias("a")), "later")
        .join(texts.select(F.col("h").alias("earlier"), F.col("line").alias("b")), "earlier")
    )
    # Equal but for the character at the place: one edit, told in one pass where a distance would take the square.
    rest = lambda x: F.concat(F.substring(x, F.lit(1), F.col("place") - 1), F.substring(x, F.col("place") + 1, F.length(x)))
    a, b = F.col("a"), F.col("b")
    same = F.when(F.col("longer") == 0, rest(a) == rest(b)).when(F.col("longer") == 1, rest(a) == b).otherwise(a == rest(b))
    return both.filter(same).select("later", "earlier")


def dedup_lines(docs: DataFrame, *, least_chars: int = 16, near_chars: int = 32, keep_blank: bool = False,
                most_broadcast: int = 400_000) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, any others) without the lines that an earlier line of the corpus repeats.

    Lines are split at line feeds. A line is dropped if an equal line comes earlier, or, from ``near_chars``
    characters on, a line within one edit (a character replaced, inserted or deleted). It need not be a line
    that stays. Earlier means a smaller doc_id (null ids last), then a smaller hash of the text, then a smaller
    line number. Lines of fewer than ``least_chars`` characters always stay, with ``keep_blank`` also those of white
    space. A line may be as long as a text; it costs as much as its length. Adds n_lines and n_kept (0 for a
    null text, which stays null); a text without lines left is empty. Rows alike in doc_id and text are one
    document and come out alike; other columns stay, names that ``docs`` has already are replaced.

    Lines that may have a near partner are looked up by a broadcast up to ``most_broadcast`` of them, and by
    shuffle beyond.
    """
    lines = _lines(docs, least_chars, keep_blank)
    near = F.length("line") >= near_chars
    firsts = checkpoint(lines.withColumn("halves", F.when(near, _halves(F.col("line")))).groupBy("h", "h2").agg(
        F.min(F.struct(*_FIRST)).alias("first"), F.first("halves").alias("halves")))
    meeting = checkpoint(_meeting(firsts))
    firsts = firsts.drop("halves")
    if meeting.count() <= most_broadcast:
        meeting = F.broadcast(meeting)
    # Two different lines of one hash, should they occur, are left as they are.
    texts = lines.filter(near).join(meeting, "h", "left_semi").select("h", "h2", "line").distinct()
    near = checkpoint(texts.join(firsts, ["h", "h2"]).select("h", "h2", "line", "first"))
    unlike = near.groupBy("h").count().filter("count > 1").select("h")
    near = checkpoint(near.join(unlike, "h", "left_anti"))
    dropped = _neighbours(near.select("h", "line", "first")).select(F.col("later").alias("h")).distinct()
    repeats = near.join(dropped, "h", "left_semi").select("h", "h2")

    kept = firsts.join(repeats, ["h", "h2"], "left_anti").select("first.*")
    per_text = kept.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list("line_no").alias("_kept"))
    rows = docs.drop("n_lines", "n_kept").withColumn("_text", F.xxhash64("text"))
    rows = rows.join(per_text, F.expr("doc_id <=> _id AND _text = _hash"), "left")
    rows = rows.withColumn("_rest", _without_repeats(F.col("text"), F.coalesce("_kept", F.array().cast("array<int>")), least_chars, keep_blank))
    return rows.withColumns({
        "text": F.when(F.col("text").isNotNull(), F.array_join("_rest.lines", "\n")),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.col("_rest.n")).cast("bigint"),
        "n_kept": F.when(F.col("text").isNull(), 0).otherwise(F.size("_rest.lines")).cast("bigint"),
    }).drop("_id", "_hash", "_kept", "_text", "_rest")


def _without_repeats(text: Column, kept: Column, least: int, keep_blank: bool) -> Column:
    """struct<n, lines>: number of lines, and those that are not compared or whose number is in ``kept``.

    Takes the slices between dropped lines, one pass however many lines there are. Intermediate arrays are
    bound as fields of one-element arrays: where the optimizer copies this expression, say into a filter, it
    must not copy the split into the inner functions, which would split the text once per line.
    """
    split = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), kept.alias("kept")))

    def cut(x):
        judged = F.filter(F.sequence(F.lit(0), F.size(x["lines"]) - 1), lambda i: _judged(F.get(x["lines"], i), least, keep_blank))
        cuts = F.concat(F.array(F.lit(-1)), F.array_except(judged, x["kept"]), F.array(F.size(x["lines"])))
        return F.struct(x["lines"].alias("lines"), cuts.alias("cuts"))

    def take(x):
        parts = F.transform(
            F.sequence(F.lit(1), F.size(x["cuts"]) - 1),
            lambda j: F.slice(x["lines"], F.get(x["cuts"], j - 1) + 2, F.get(x["cuts"], j) - F.get(x["cuts"], j - 1) - 1))
        return F.struct(F.size(x["lines"]).alias("n"), F.flatten(parts).alias("lines"))

    return F.when(text.isNotNull(), F.get(F.transform(F.transform(split, cut), take), F.lit(0)))
