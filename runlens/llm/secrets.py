"""Secret scans: fixed patterns, and a battery of randomness tests over the other tokens of a text.

A token is a run of 16 or more letters, digits and ``+ / _ -``, with up to two ``=``. Its encoding is inferred
(decimal, hex, base32, base64) and three tests ask whether its symbols are drawn evenly and independently from
that alphabet: chi-squared on the symbol counts, runs above and below the middle of the alphabet, and serial
correlation of neighbours. ``p`` is three times the smallest of their p-values (Bonferroni).

Short tokens look random by chance more often than long ones. So the null is measured: tokens that are plainly
words (letters with optional separators, in one case or capitalised) pass through the same battery, and a
candidate's p-value against writing is the share of words of its length class or shorter that look at least
as random. Benjamini-Hochberg within each length class then keeps false discoveries below ``alpha``.

Everything is column functions; texts are read twice and never shuffled. What is gathered is one count per
length class, kind and score bin: at most 252 rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.rank_test import normal_tail

_VALUE = r"([A-Za-z0-9+/_.=-]+)"
PATTERNS = {  # kind: pattern, group whose length counts, least length
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?" + _VALUE, 2, 12),
    # A run that is long enough is found whole, and a shorter one fails wherever it begins.
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
WORDS = r"^(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/+](?:[A-Z]?[a-z]+|[A-Z]+))*=*$"
ALPHABETS = {  # encoding: what its tokens look like, symbols
    "decimal": (r"^[0-9]+$", "0123456789"),
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base64": (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
CLASSES = (16, 20, 24, 32, 48, 64)  # least length of each
BINS = 20  # of -log2(p)
_CHUNK = 256


_SPANS = "array<struct<start: bigint, end: bigint, token: string>>"
_STATE = f"struct<at: bigint, found: {_SPANS}>"


def _with_spans(rows: DataFrame, name: str, pattern: str, group: int, least: int) -> DataFrame:
    """Adds ``name``: leftmost matches in ``text`` as array<struct<start, end, token>>, too short ones left out.

    Matches alternate with the pieces between them, so starts are running sums of lengths in code points. The
    sums run within chunks of matches whose own lengths are summed first, which keeps texts with very many
    matches cheap. The steps are columns of their own so that no pattern runs twice.
    """
    hits = F.when(F.col("text").rlike(pattern), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("_hits", hits)
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else F.col("_hits")
    gaps = F.when(F.col("_hits").isNotNull(), F.slice(F.split("text", pattern, -1), F.lit(1), F.size("_hits")))
    rows = rows.withColumn("_pieces", F.when(
        F.col("_hits").isNotNull(), F.arrays_zip(gaps.alias("gap"), F.col("_hits").alias("hit"), value.alias("value"))))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_pieces") - 1) / _CHUNK).cast("int")),
                         lambda i: F.slice("_pieces", i * _CHUNK + 1, F.lit(_CHUNK)))
    none = F.array().cast(_SPANS)

    def begin(at: Column) -> Column:
        return F.struct(at.cast("bigint").alias("at"), none.alias("found"))

    def place(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("token")))
        found = F.when(F.length(piece["value"]) >= least, F.concat(state["found"], span)).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found")).cast(_STATE)

    def advance(state: Column, chunk: Column) -> Column:
        length = F.aggregate(chunk, F.lit(0).cast("bigint"), lambda n, p: n + F.length(p["gap"]) + F.length(p["hit"]))
        own = F.aggregate(chunk, begin(state["at"]), place, lambda s: s["found"])
        return F.struct((state["at"] + length).alias("at"), F.concat(state["found"], own).alias("found")).cast(_STATE)

    spans = F.aggregate(chunks, begin(F.lit(0)), advance, lambda s: s["found"])
    return rows.withColumn(name, F.when(F.col("_pieces").isNull(), none).otherwise(spans)).drop("_hits", "_pieces")


def _scored(tokens: Column) -> Column:
    """array<struct<start, end, token, words, length_class, bin>> of an array of spans.

    Each step is an array of its own, so that nothing a later step uses twice is computed twice.
    """
    place = ("start", "end", "token")

    def symbols(t):
        bare = F.rtrim(t["token"], F.lit("="))
        kinds = [F.struct(F.lit(alphabet).alias("alphabet"), F.lit(float(len(alphabet))).alias("k"),
                          (F.lower(bare) if len(alphabet) == 16 else F.translate(bare, "-_", "+/") if len(alphabet) == 64 else bare).alias("symbols"))
                 for _, alphabet in ALPHABETS.values()]
        kind = kinds[-1]
        for (shape, _), own in reversed(list(zip(ALPHABETS.values(), kinds))[:-1]):
            kind = F.when(t["token"].rlike(shape), own).otherwise(kind)
        return F.struct(*[t[c].alias(c) for c in place], kind.alias("kind"))

    def values(t):
        k, text = t["kind"]["k"], t["kind"]["symbols"]
        parts = F.split(text, "")
        squares = F.aggregate(F.array_distinct(parts), F.lit(0.0), lambda s, c: s + F.pow(
            (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"), 2.0))
        return F.struct(
            *[t[c].alias(c) for c in place], k.alias("k"), F.length(text).cast("double").alias("n"), squares.alias("squares"),
            F.transform(parts, lambda c: F.position(c, t["kind"]["alphabet"]) - 1 - (k - 1) / 2).alias("values"))

    def statistics(t):
        k, n = t["k"], t["n"]
        after = F.slice(t["values"], F.lit(2), F.size(t["values"]) - 1)
        both = F.zip_with(F.slice(t["values"], F.lit(1), F.size(t["values"]) - 1), after, lambda a, b: F.struct(
            (a * b).alias("product"), ((a > 0) != (b > 0)).cast("double").alias("change")))
        sums = F.aggregate(both, F.struct(F.lit(0.0).alias("product"), F.lit(0.0).alias("change")), lambda s, p: F.struct(
            (s["product"] + p["product"]).alias("product"), (s["change"] + p["change"]).alias("change")))
        return F.struct(*[t[c].alias(c) for c in place], k.alias("k"), n.alias("n"), t["squares"].alias("squares"), sums.alias("sums"))

    def scores(t):
        k, n = t["k"], t["n"]
        chi = (k / n * t["squares"] - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
        runs = (t["sums"]["change"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = t["sums"]["product"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
        return F.struct(*[t[c].alias(c) for c in place], F.array(chi, F.abs(runs), F.abs(serial)).alias("z"))

    def tails(t):
        return F.struct(*[t[c].alias(c) for c in place], t["z"][0].alias("chi"),
                        F.transform(t["z"], lambda z: normal_tail(F.abs(z))).alias("tails"))

    def binned(t):
        # Uneven counts speak against randomness, even ones do not; the other tests have two sides.
        uneven = F.when(t["chi"] > 0, t["tails"][0]).otherwise(1 - t["tails"][0])
        p = 3 * F.least(uneven, 2 * t["tails"][1], 2 * t["tails"][2])
        length = t["end"] - t["start"]
        size = reduce(lambda c, least: F.when(length >= least, least).otherwise(c), CLASSES[1:], F.lit(CLASSES[0]))
        bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(-F.log2(F.greatest(p, F.lit(1e-9)))))).cast("int")
        return F.struct(*[t[c].alias(c) for c in place], t["token"].rlike(WORDS).alias("words"), size.alias("length_class"), bin_.alias("bin"))

    for step in (symbols, values, statistics, scores, tails, binned):
        tokens = F.transform(tokens, step)
    return tokens


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def thresholds(docs: DataFrame, alpha: float) -> dict[int, int]:
    """Highest score bin that counts as random, per length class; classes without a discovery are absent."""
    tokens = _with_spans(_texts(docs), "tokens", TOKEN, 0, 16).select(F.explode(_scored(F.col("tokens"))).alias("t"))
    scored = tokens.select("t.words", "t.length_class", "t.bin")
    counts = scored.groupBy("words", "length_class", "bin").count().collect()
    found = {}
    for size in CLASSES:
        words = [(r["bin"], r["count"]) for r in counts if r["words"] and r["length_class"] <= size]
        own = [(r["bin"], r["count"]) for r in counts if not r["words"] and r["length_class"] == size]
        nulls, total = sum(n for _, n in words), sum(n for _, n in own)
        for at in range(BINS + 1):
            reached = sum(n for b, n in own if b <= at)
            p = (1 + sum(n for b, n in words if b <= at)) / (1 + nulls)
            if reached and p * total <= alpha * reached:
                found[size] = at
    return found


def secret_scan(docs: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and the spans ``assign``, ``access``, ``hex``, ``random``.

    Each is array<struct<start, end, token>> in order of place, in code points, end exclusive. The first three
    come from fixed patterns, ``random`` from the battery; a token may be found by several. Null counts as
    the empty text, which has none. Rows stay as they are, repeated ones too; other columns are ignored.
    """
    limits = thresholds(docs, alpha)
    rows = _with_spans(_texts(docs), "tokens", TOKEN, 0, 16)
    random = F.array().cast(_SPANS)
    if limits:
        limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
        open_ = F.filter("tokens", lambda t: ~t["token"].rlike(WORDS))
        kept = F.filter(_scored(open_), lambda t: F.coalesce(t["bin"] <= F.try_element_at(limit, t["length_class"]), F.lit(False)))
        random = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("token")))
    rows = rows.withColumn("random", random).drop("tokens")
    for kind, pattern in PATTERNS.items():
        rows = _with_spans(rows, kind, *pattern)
    return rows.select("doc_id", *PATTERNS, "random")


def listed(*kinds: str) -> Column:
    """kind:start:end of the spans of these columns, by start and then kind as listed, joined by commas."""
    def tag(n: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(n).alias("n"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("name")))

    tagged = F.concat(*[tag(n, kind) for n, kind in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(tagged), lambda s: s["name"]), ",")
