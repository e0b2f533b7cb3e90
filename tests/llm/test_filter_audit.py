"""The filter audit against filters applied one after the other."""

import random
import re
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from runlens.llm import filter_audit
from runlens.llm.queries import O as CHECKS


def brute_force(docs, labels):
    """Rows as the operator gives them, from (doc_id, source, text) and (doc_id, quality, toxic)."""
    good, toxic = ({i for i, *v in labels if i is not None and v[place] == 1} for place in (0, 1))
    firsts = {}
    for i, _, t in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))

    def fails(i, t):
        words = re.findall("[^ \t-\r]+", t)
        return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and firsts[t] < i}

    out = []
    for part in {s or "" for _, s, _ in docs}:
        own = [(i, fails(i, t or "")) for i, s, t in docs if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                removed = [d for d in left if d[1][letter]]
                gone = len(own) - len(left)
                left = [d for d in left if not d[1][letter]]
                failing = [d for d in own if d[1][letter]]
                assert gone <= len(own)
                shapley[letter] += len(removed)
                rows.append(["".join(order), step, letter, len(left), len(removed), len(failing) - len(removed),
                             sum(sum(d[1].values()) == 1 for d in failing), sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed)])
        out += [(part, *r, shapley[r[2]]) for r in rows]
    return out


def texts(sentence, seed):
    rng = random.Random(seed)
    plain = [sentence(i, rng.choice([150, 250])) for i in range(12)]
    return [rng.choice(["", "#! "]) + rng.choice([t, t.upper(), " ".join([t.split()[0]] * 300), "\x85 " + t, t.replace(" ", "\x0b\t")]) for t in plain for _ in range(3)]


def test_against_brute_force(spark, frame, sentence):
    rng = random.Random(4)
    pool = texts(sentence, 4) + [None, "", " \n", "A", "|" * 30_000, "word " * 40_000]
    docs = [(i, rng.choice(pool), rng.choice(["a", "b", "b", None, ""])) for i in range(160)]
    docs += [(None, docs[3][1], "a"), (None, docs[3][1], "a"), (7, docs[7][1], "b"), (7, docs[9][1], "c"), docs[11], docs[11]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    named = spark.createDataFrame([(*r, "x") for r in labels], "doc_id bigint, quality int, toxic int, text string")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    found = filter_audit.audit(frame(docs).withColumns({"mask": F.lit(1), "part": F.lit("p")}), named)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    assert sorted(map(tuple, found.collect())) == sorted(brute_force([(i, s, t) for i, t, s in docs], labels))
    assert filter_audit.audit(frame(docs).limit(0), named).count() == 0
    assert filter_audit.audit(frame(docs), named.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_sql_against_brute_force(sentence):
    rng = random.Random(5)
    pool = texts(sentence, 5)
    docs = [(i, rng.choice("ab"), rng.choice(pool)) for i in range(80)]
    labels = [(i, i % 2, i % 3 % 2) for i in range(50)]
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, source varchar, text varchar)")
    con.sql("create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into documents values (?, ?, ?)", docs)
    con.executemany("insert into labels values (?, ?, ?)", labels)
    rows = con.sql(CHECKS["op13_filter_audit"]).fetchall()
    assert sorted(rows) == sorted(r[:3] + r[4:] for r in brute_force(docs, labels))


def test_many_parts_pass_the_limit_of_the_recursion(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('s', id) AS source", "'A' AS text")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        found = filter_audit.audit(docs, labels)
        assert found.count() == 4000 * 600 and spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
