"""Registered queries of the operators (``Q``) and their SQL checks (``O``)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import (
    decontaminate,
    filter_audit,
    html,
    licenses,
    line_dedup,
    merkle,
    mixing,
    ngram_lm,
    quality,
    secrets,
    simhash,
    topk,
    toxicity,
)

Q, O = {}, {}  # noqa: E741


def _query(f):
    Q[f.__name__] = f
    return f


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    kinds = list(secrets.PATTERNS)
    found = secrets.secret_scan(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in kinds],
        F.sha2(secrets.listed(*kinds), 256).alias("base_sha256"), secrets.listed(*kinds, "random").alias("spans"),
        F.size("random").cast("bigint").alias("n_random"))


@_query
def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(_table(spark, folder, "pages"))


@_query
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, folder, "documents"))
    words, labels = F.transform("places", lambda p: p["word"]), F.transform("places", lambda p: p["label"])
    rules = F.transform("detections", lambda d: d["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, rules)).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("score"))


@_query
def op4_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", topk.to_integers(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


O["op4_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@_query
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    ratings = quality.ratings_of(_table(spark, folder, "labels"))
    return quality.grade_documents(_table(spark, folder, "documents"), ratings).select("doc_id", "expected_grade", "p_top", "kept")


@_query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, folder, "documents").select("doc_id", "source"))


@_query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, folder, "documents"), least_chars=1, near_chars=16, keep_blank=True)
    return kept.select("doc_id", "n_lines", "n_kept", "text")


# Beside the definition: 16 characters and more, within one edit of an earlier line of that length.
O["op8_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
firsts AS (
  SELECT line, length(line) AS l, min(doc_id * 1000000 + n) AS first FROM lines WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]') GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b ON a.l BETWEEN b.l - 1 AND b.l + 1 AND a.first < b.first
    AND a.l >= 16 AND b.l >= 16 AND (left(a.line, 8) = left(b.line, 8) OR right(a.line, 7) = right(b.line, 7))
  WHERE levenshtein(a.line, b.line) <= 1),
kept AS (
  SELECT t.doc_id, t.n, t.line FROM lines t LEFT JOIN firsts f ON f.line = t.line
  WHERE f.line IS NULL OR (f.first = t.doc_id * 1000000 + t.n AND t.line NOT IN (SELECT line FROM near)))
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, count(k.n) AS n_kept,
  coalesce(string_agg(k.line, chr(10) ORDER BY k.n), '') AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""


@_query
def op9_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_lm.score_documents(_table(spark, folder, "documents"))


@_query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@_query
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@_query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return merkle.manifest(docs, merkle.tampered(docs)).rows


def _manifest_sql(levels: int = 6) -> str:
    """The manifest level by level, for up to 16^levels rows of a source and as many sources.

    CRC-32 goes by half bytes, from a table of 16 entries that its polynomial gives.
    """
    table = []
    for entry in range(16):
        for _ in range(4):
            entry = entry >> 1 ^ 0xEDB88320 * (entry & 1)
        table.append(entry)
    step = lambda c, half: f"xor({c} >> 4, {table}[CAST(xor({c}, {half}) & 15 AS INT) + 1])"
    halves = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ascii(x) & 15, ascii(x) >> 4]))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST({halves} AS BIGINT[])), lambda c, half: {step('c', 'half')}), 4294967295)"
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    row = lambda text: f"sha256({part('doc_id')} || {part('source')} || {part('lang')} || {part('n_chars')} || {part(text)})"
    lower = f"translate(text, '{merkle.ascii_uppercase}', '{merkle.ascii_lowercase}')"
    ctes = [f"""
leaves AS (
  SELECT doc_id, source, {row('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {row(lower)} ELSE {row('text')} END AS seen FROM documents),
a0 AS (
  SELECT source AS tree, doc_id, leaf AS h, seen, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM leaves)"""]

    def climb(name: str) -> None:
        for k in range(levels):
            run = f"PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
            ctes.append(f"""
{name}s{k} AS (
  SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n,
    coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k}),
{name}{k + 1} AS (
  SELECT tree, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {name}s{k} GROUP BY tree, i // 16)""")

    climb("a")
    ctes.append(f"""
b0 AS (SELECT 0 AS tree, tree AS source, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i FROM a{levels})""")
    climb("b")
    steps, joins, folded = [], [], "l.seen"
    for name, at, key in (("a", "l.i", "l.tree"), ("b", "t.i", "0")):
        for k in range(levels):
            own = f"{name}{k}_"
            steps.append(f"{own}.before || {own}.after")
            joins.append(f"JOIN {name}s{k} {own} ON {own}.tree IS NOT DISTINCT FROM {key} AND {own}.i = {at} // {16**k}")
            folded = f"fold({folded}, {own}.before, {own}.after, {own}.n)"
    # Each fold is a subquery of its own, so that no text is written out twice.
    chain = "SELECT *, seen AS f0 FROM joined"
    for k in range(2 * levels):
        own = f"{'ab'[k // levels]}{k % levels}"
        chain = f"SELECT *, CASE WHEN n_{own} = 1 THEN f{k} ELSE sha256(before_{own} || f{k} || after_{own}) END AS f{k + 1} FROM ({chain})"
    sides = [f"{o}_.{c} AS {c}_{o}" for o in [f"{n}{k}" for n in "ab" for k in range(levels)] for c in ("before", "after", "n")]
    ctes.append(f"""
joined AS (
  SELECT l.doc_id, l.h AS leaf, l.seen, t.h AS subroot, r.h AS root, sha256({' || '.join(steps)}) AS proof_sha256, {', '.join(sides)}
  FROM a0 l JOIN b0 t ON t.source IS NOT DISTINCT FROM l.tree CROSS JOIN b{levels} r {' '.join(joins)})""")
    return (f"WITH {','.join(ctes)} SELECT doc_id, leaf, subroot, root, proof_sha256, f{2 * levels} AS folded_root, "
            f"f{2 * levels} = root AS verified FROM ({chain})")


O["op12_merkle_manifest"] = _manifest_sql()


@_query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    audit = filter_audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return audit.drop("filter")


O["op13_filter_audit"] = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
failing AS (
  SELECT part, doc_id, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM texts),
masks AS (
  SELECT f.part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask,
    coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM failing f LEFT JOIN labels l ON l.doc_id = f.doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
prefixes AS (
  SELECT '' AS prefix, '' AS letter, 0 AS step, 0 AS applied, 0 AS bit
  UNION ALL
  SELECT p.prefix || l.letter, l.letter, p.step + 1, p.applied | p.bit, l.bit FROM prefixes p JOIN letters l ON (p.applied | p.bit) & l.bit = 0),
steps AS (
  SELECT c.part, p.prefix, p.letter, p.step,
    coalesce(sum(n) FILTER (mask & (applied | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & applied = 0 AND mask & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & applied > 0 AND mask & bit > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & applied = 0 AND mask & bit > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & applied = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM prefixes p CROSS JOIN cells c WHERE p.step > 0 GROUP BY ALL)
SELECT s.part, o.prefix AS filter_order, s.step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY s.part, s.letter) AS BIGINT) AS shapley
FROM steps s JOIN prefixes o ON o.step = 5 AND s.prefix = left(o.prefix, s.step)
"""
