"""Bigram language model by deleted interpolation (Jelinek and Mercer 1980), trained and applied in Spark.

P(w | v) = a c(v,w)/c(v) + b c(w)/N + c 1/(V+1), where the weights (a, b, c) depend on how often the context v
was seen (buckets of log2). They are learned by expectation-maximisation on a held-out fold of the training
documents, with that fold's own counts deleted from the rest.

Count tables grow with the corpus, so they are never broadcast and no document is joined word by word:

1. documents are packed into batches of about ``batch_chars`` characters, by hash;
2. a batch sends the distinct 64-bit hashes of its words and word pairs, with its counts, to hash ranges
   (parts). A word as common as "the" comes once per batch, not once per document;
3. a part adds the counts of all batches and answers each in the order of its keys;
4. batches meet their answers, and documents are scored.

Batches and parts are equally many. Keys travel as sorted differences, counts as bytes by significance,
which Spark's shuffle compression then shortens. With larger executors, larger batches need fewer messages.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import checkpoint

HELD_FOLD, FOLDS = 2, 7  # documents the model never learns from
TUNING_FOLD = 3  # training documents whose counts are deleted to learn the weights
BUCKETS = 24
_END, _START = 1, 0  # dense numbers of the end token and of the context before the first word
_START_HASH = np.uint64(0x9E3779B97F4A7C15)
_STEPS = 4  # histogram steps per doubling of a probability
_LOWEST = -60.0


# Blobs ------------------------------------------------------------------------------------------------

def _by_byte(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_bytes(blob: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _keys_out(keys: np.ndarray) -> bytes:
    return _by_byte(np.diff(keys, prepend=np.uint64(0)))


def _keys_in(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_bytes(blob, np.uint64), dtype=np.uint64)


def _counts_out(counts: np.ndarray) -> bytes:
    return zlib.compress(_by_byte(counts.astype(np.uint64)), 1)


def _counts_in(blob: bytes) -> np.ndarray:
    return _from_bytes(zlib.decompress(blob), np.uint64).astype(np.int64)


# Batches ----------------------------------------------------------------------------------------------

class _Words(dict):
    """Dense numbers of words, given in order of appearance."""

    def __missing__(self, word):
        self[word] = number = len(self) + 2
        return number


class _Batch:
    """Tokens of a batch of documents as dense numbers, and its distinct pairs."""

    def __init__(self, blobs):
        words, numbers = _Words(), []
        ids, folds, lengths = [], [], []
        for blob in blobs:
            table = pa.ipc.open_stream(pa.py_buffer(blob)).read_all()
            ids += table["doc_id"].to_pylist()
            folds.append(table["fold"].to_numpy())
            for text in table["text"].cast(pa.binary()):
                # bytes.lower() and bytes.split() know ASCII only, as the definition of tokens does.
                own = text.as_py().lower().split()
                numbers.append(np.fromiter(map(words.__getitem__, own), np.int64, len(own)))
                numbers.append(np.array([_END]))
                lengths.append(len(own) + 1)
        self.ids, self.lengths = ids, np.array(lengths, np.int64)
        self.folds = np.concatenate(folds) if folds else np.zeros(0, np.int64)
        self.tokens = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.hashes = np.concatenate([np.array([_START_HASH, xxhash.xxh64_intdigest(b"")], np.uint64), hashes])
        self.begins = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.begins] = _START
        pairs, self.pair_of = np.unique(before * np.int64(len(self.hashes)) + self.tokens, return_inverse=True)
        self.first, self.second = np.divmod(pairs, np.int64(len(self.hashes)))
        self.token_folds = np.repeat(self.folds, self.lengths)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words (without the start) and of the pairs."""
        mixed = self.hashes[self.first] * np.uint64(0xBF58476D1CE4E5B9) + self.hashes[self.second]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return self.hashes[1:], mixed ^ (mixed >> np.uint64(29))

    def doc_sums(self, of_tokens: np.ndarray) -> np.ndarray:
        return np.add.reduceat(of_tokens, self.begins) if len(of_tokens) else of_tokens


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Number of the range, ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _requests(batch: int, blobs, parts: int) -> pd.DataFrame:
    own = _Batch(blobs)
    learned, tuning = own.token_folds != HELD_FOLD, own.token_folds == TUNING_FOLD
    rows = []
    for kind, keys, of_token in zip((0, 1), own.keys(), (own.tokens - 1, own.pair_of)):
        total = np.bincount(of_token[learned], minlength=len(keys))
        held = np.bincount(of_token[tuning], minlength=len(keys))
        order = np.argsort(keys)
        keys, total, held = keys[order], total[order], held[order]
        edges = np.searchsorted(_part(keys, parts), np.arange(parts + 1))
        for part in np.flatnonzero(np.diff(edges)):
            s = slice(edges[part], edges[part + 1])
            rows.append((part, batch, kind, _keys_out(keys[s]), _counts_out(total[s]), _counts_out(held[s])))
    return pd.DataFrame(rows, columns=["part", "batch", "kind", "keys", "total", "held"])


def _answers(part: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Counts over all batches for the keys of each, and one row (batch -1) with the sums of the part."""
    out = []
    sums = {"vocabulary": 0, "tokens": 0, "kept_tokens": 0}
    for kind, asked in rows.groupby("kind"):
        blobs = [_keys_in(b) for b in asked["keys"]]
        totals, helds = [_counts_in(b) for b in asked["total"]], [_counts_in(b) for b in asked["held"]]
        keys, at = np.unique(np.concatenate(blobs), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(totals), minlength=len(keys)).astype(np.int64)
        kept = total - np.bincount(at, weights=np.concatenate(helds), minlength=len(keys)).astype(np.int64)
        if kind == 0:
            sums = {"vocabulary": int((total > 0).sum()), "tokens": int(total.sum()), "kept_tokens": int(kept.sum())}
        ends = np.cumsum([len(b) for b in blobs])
        for batch, end, size, held in zip(asked["batch"], ends, map(len, blobs), helds):
            places = at[end - size : end]
            # The tuning fold's answer covers the keys it has itself, without its own counts.
            out.append((batch, part, kind, _counts_out(total[places]), _counts_out(kept[places[held > 0]]), 0, 0, 0))
    out.append((-1, part, 0, b"", b"", *sums.values()))
    return pd.DataFrame(out, columns=["batch", "part", "kind", "total", "kept", *sums])


def _answered(own: _Batch, answers: pd.DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts by dense number (a start stands as often as an end) and by pair."""
    found = []
    for kind, keys in zip((0, 1), own.keys()):
        blobs = answers[answers["kind"] == kind].sort_values("part")[column]
        counts = np.empty(len(keys), np.int64)
        counts[np.argsort(keys)] = np.concatenate([_counts_in(b) for b in blobs])
        found.append(counts)
    words = np.concatenate([[0], found[0]])
    words[_START] = words[_END]
    return words, found[1]


def _bucket(contexts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + floor(log2)."""
    return np.minimum(np.frexp(contexts.astype(float))[1], BUCKETS - 1)


def _shares(own: _Batch, words: np.ndarray, pairs: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct pair: bucket of the context, share of the pair in it, share of the word in all tokens."""
    context = words[own.first]
    return _bucket(context), pairs / np.maximum(context, 1), words[own.second] / max(tokens, 1)


def _tuning_histogram(own: _Batch, answers: pd.DataFrame, tokens: int) -> pd.DataFrame:
    bucket, pair, word = _shares(own, *_answered(own, answers, "kept"), tokens)
    with np.errstate(divide="ignore"):
        steps = [np.round(np.maximum(np.log2(p), _LOWEST) * _STEPS).astype(int) for p in (pair, word)]
    times = np.bincount(own.pair_of, minlength=len(pair))
    rows = pd.DataFrame({"bucket": bucket, "pair": steps[0], "word": steps[1], "n": times})
    return rows.groupby(["bucket", "pair", "word"], as_index=False)["n"].sum()


def learn_weights(histogram: pd.DataFrame, vocabulary: int, rounds: int = 100) -> np.ndarray:
    """Weights (pair, word, uniform) per bucket by expectation-maximisation on held-out counts.

    ``histogram`` has the number ``n`` of held-out tokens by bucket and rounded log2 shares of the pair and the
    word. A bucket without such tokens takes the weights of the nearest one below that has some.
    """
    weights = np.tile([0.6, 0.3, 0.1], (BUCKETS, 1))
    last = None
    for bucket in range(BUCKETS):
        own = histogram[histogram["bucket"] == bucket]
        if len(own):
            shares = np.stack([2.0 ** (own[c].to_numpy() / _STEPS) for c in ("pair", "word")]
                              + [np.full(len(own), 1 / (vocabulary + 1))], axis=1)
            shares[:, :2][shares[:, :2] <= 2.0 ** (_LOWEST + 1)] = 0
            n, mix = own["n"].to_numpy(float), np.full(3, 1 / 3)
            for _ in range(rounds):
                parts = shares * mix
                mix = (n[:, None] * parts / parts.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
            # The uniform share stays positive, so that no text has probability zero.
            last = (mix + [0, 0, 1e-9]) / (1 + 1e-9)
        if last is not None:
            weights[bucket] = last
    return weights


def _scores(own: _Batch, answers: pd.DataFrame, tokens: int, vocabulary: int, weights: np.ndarray) -> pd.DataFrame:
    words, pairs = _answered(own, answers, "total")
    bucket, pair, word = _shares(own, words, pairs, tokens)
    mixed = (weights[bucket] * np.stack([pair, word, np.full(len(pair), 1 / (vocabulary + 1))], axis=1)).sum(axis=1)
    base = np.log10((words + 1) / (tokens + vocabulary + 1))
    return pd.DataFrame({
        "doc_id": pd.array(own.ids, "Int64"), "held_out": own.folds == HELD_FOLD, "n_tokens": own.lengths,
        "n_known": own.doc_sums((words[own.tokens] > 0).astype(np.int64)), "train_tokens": tokens,
        "base_score": own.doc_sums(base[own.tokens]), "score": own.doc_sums(np.log10(mixed)[own.pair_of]),
    })


# The job ----------------------------------------------------------------------------------------------

def _packed(rows: DataFrame) -> DataFrame:
    """(batch, docs): compressed blobs of documents of one batch."""

    def run(records):
        for record in records:
            table = pa.Table.from_batches([record])
            if not table.num_rows:
                continue
            batches = table["batch"].to_numpy()
            order = np.argsort(batches, kind="stable")
            cuts = np.flatnonzero(np.diff(batches[order], prepend=-1))
            blobs = []
            for take in np.split(order, cuts[1:]):
                sink = pa.BufferOutputStream()
                part = table.select(["doc_id", "fold", "text"]).take(take)
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(part)
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(batches[order][cuts], pa.int64()), pa.array(blobs, pa.binary())],
                                             names=["batch", "docs"])

    return rows.mapInArrow(run, "batch bigint, docs binary")


def score_documents(docs: DataFrame, *, batch_chars: int = 20_000_000) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) under the model learned from the training documents.

    Training documents are those whose crc32(doc_id as text) mod 7 is not 2; a null id belongs to them. Tokens
    are runs without ASCII white space, A-Z lower-cased, then one end. Returns doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score (add-one unigram) and score (the model), as log10 probabilities. Null
    text counts as empty: the end alone. Rows stay as they are, repeated ones too, and each is learned from;
    other columns are ignored.
    """
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)), F.lit(-1)).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"), fold.alias("fold"))
    chars = rows.agg(F.sum(F.length("text") + 200)).first()[0] or 0
    batches = max(1, -(-chars // batch_chars))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))

    def ask(key, group):
        return _requests(key[0], group["docs"], batches)

    def answer(key, group):
        return _answers(key[0], group)

    asked = _packed(rows).groupBy("batch").applyInPandas(
        ask, "part bigint, batch bigint, kind int, keys binary, total binary, held binary")
    answers = checkpoint(asked.groupBy("part").applyInPandas(
        answer, "batch bigint, part bigint, kind int, total binary, kept binary, vocabulary bigint, tokens bigint, kept_tokens bigint"))
    sums = answers.filter("batch = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("vocabulary", "tokens", "kept_tokens")])
    vocabulary, tokens, kept_tokens = sums.first()
    answers = answers.filter("batch >= 0")

    def met(documents, column):
        return _packed(documents).groupBy("batch").cogroup(answers.select("batch", "part", "kind", column).groupBy("batch"))

    def tuned(key, own, answers):
        none = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("bucket", "pair", "word", "n")})
        return _tuning_histogram(_Batch(own["docs"]), answers, kept_tokens) if len(own) else none

    def scored(key, own, answers):
        return _scores(_Batch(own["docs"]), answers, tokens, vocabulary, weights)

    # Buckets and steps are fixed in number, so this is too, however large the corpus.
    histogram = met(rows.filter(F.col("fold") == TUNING_FOLD), "kept").applyInPandas(
        tuned, "bucket bigint, pair bigint, word bigint, n bigint")
    weights = learn_weights(histogram.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).toPandas(), vocabulary)
    return met(rows, "total").applyInPandas(
        scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
