"""Log-likelihood of whole documents under a recurrent model trained on the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from watchkeep.llm import gru
from watchkeep.llm.common import U64, Words, arrow, held_out, store, text_chunks, text_or_empty

# The end of a document, as a word hash.
END = U64(0x0123456789ABCDEF)
# Words whose counts every task holds (bounded), and those with outputs of their own.
KNOWN, HEADS = 262_144, 4_096
BUCKET_BITS = 20
# Other words fall in classes by length and by how they end.
LENGTHS = np.array([2, 4, 6, 8, 10, 13, 17])
ENDINGS = np.zeros(256, np.int64)
ENDINGS[ord(".")], ENDINGS[ord(",")] = 1, 2
ENDINGS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = 3
TAILS = 4 * (len(LENGTHS) + 1)
# Training: rounds, and the shares of the training documents that they take in turn.
ROUNDS, SHARE, RATE = 4, 4, 0.02
SLICE = 2_048
STREAM_TOKENS = 200_000
# Text scored together: the more documents, the fewer steps are taken for the longest alone.
SCORE_BYTES = 16_000_000


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, tail class, first token of each text) with an end after every text."""
    w = Words(data, offsets)
    shape = np.searchsorted(LENGTHS, w.ends - w.starts) * 4 + ENDINGS[data[w.ends - 1] if len(w.ends) else data[:0]]
    at = w.first[1:]
    return np.insert(w.hashes, at, END), np.insert(shape, at, 0), w.first + np.arange(len(w.first))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, tail, n): every token of every row of ``docs`` (text), combined before the shuffle."""
    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def joined():
            h, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
            found, place, back = np.unique(h, return_index=True, return_inverse=True)
            return found, s[place], np.bincount(back, n, minlength=len(found)).astype(np.int64)

        def rows(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])],
                                              names=["word", "tail", "n"])

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch):
                h, s, _ = _tokens(data, offsets)
                found, place, n = np.unique(h, return_index=True, return_counts=True)
                held.append((found, s[place], n))
                size += len(found)
                if size > 1_500_000:
                    held = [joined()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield rows(held[0])
                        held, size = [], 0
        if held:
            yield rows(joined())

    found = docs.select(text_or_empty()).mapInArrow(run, "word long, tail int, n long")
    return found.groupBy("word", "tail").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The counts every task holds: frequent words, and sums over the tail classes."""

    def __init__(self, counts: DataFrame, known: int, heads: int):
        total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.total, self.types = int(total["n"] or 0), int(total["v"])
        # How many words have each size of count, to choose the least count held: a few hundred rows.
        size = F.floor(F.log2("n") * 32)
        sizes = sorted(((r["k"], r["words"]) for r in counts.groupBy(size.alias("k")).agg(F.count("*").alias("words")).collect()), reverse=True)
        least, sofar = None, 0
        for k, words in sizes:
            if sofar + words > known:
                break
            least, sofar = k, sofar + words
        kept = counts.where(size >= least) if least is not None else counts.where("false")
        self.kept = kept
        frame = kept.toPandas().sort_values(["n", "word"], ascending=[False, True])
        heads = min(heads, len(frame))
        hashes = frame["word"].to_numpy(np.int64).view(U64)
        self.index(hashes, np.arange(len(frame)), frame["n"].to_numpy(np.int64), frame["tail"].to_numpy(np.int64))
        self.shape = gru.Shape(heads, TAILS)
        self.head_counts = frame["n"].to_numpy(np.float64)[:heads]
        # Tail classes hold all words but the heads: their tokens and single words.
        sums = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") == 1, 1)).alias("once")).collect()
        self.tail_tokens, once = np.zeros(TAILS), np.zeros(TAILS)
        for r in sums:
            self.tail_tokens[r["tail"]], once[r["tail"]] = r["n"], r["once"]
        head = frame.iloc[:heads]
        self.tail_tokens -= np.bincount(head["tail"], head["n"], minlength=TAILS)
        once -= np.bincount(head["tail"], head["n"] == 1, minlength=TAILS)
        # Good-Turing: unseen words have the share of words seen once.
        unseen = np.where(self.tail_tokens > 0, (once + 1) / (self.tail_tokens + 2), 1.0)
        self.log_unseen = np.log10(unseen)
        self.log_seen = np.log10(np.maximum(1 - unseen, 1e-12)) - np.log10(np.maximum(self.tail_tokens, 1))

    def index(self, hashes: np.ndarray, rank: np.ndarray, n: np.ndarray, tail: np.ndarray) -> None:
        """Words by hash; ``buckets`` tells where each value of the leading bits begins."""
        order = np.argsort(hashes)
        self.hashes, self.rank, self.n, self.tail = hashes[order], rank[order], n[order], tail[order]
        begins = np.searchsorted(self.hashes, np.arange(1 << BUCKET_BITS, dtype=U64) << U64(64 - BUCKET_BITS))
        self.buckets = begins.astype(np.int32)
        self.most = int(np.diff(np.append(begins, len(hashes))).max())

    def light(self) -> Vocabulary:
        """A copy that can be sent to the tasks."""
        other = object.__new__(Vocabulary)
        other.__dict__.update({k: v for k, v in self.__dict__.items() if k != "kept"})
        return other

    def look_up(self, hashes: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token number, count; 0 if the word is not held)."""
        if not len(self.hashes):
            return self.shape.heads + tail, np.zeros(len(hashes), np.int64)
        bucket = (hashes >> U64(64 - BUCKET_BITS)).astype(np.int64)
        at, last = self.buckets[bucket], len(self.hashes) - 1
        np.minimum(at, last, out=at)
        hit = self.hashes[at] == hashes
        for _ in range(self.most - 1):
            # A place past its bucket holds another hash.
            missing = np.flatnonzero(~hit)
            at[missing] = np.minimum(at[missing] + 1, last)
            hit[missing] = self.hashes[at[missing]] == hashes[missing]
        rank = self.rank[at]
        return np.where(hit & (rank < self.shape.heads), rank, self.shape.heads + tail), np.where(hit, self.n[at], 0)


def _averaged(rows: DataFrame) -> DataFrame:
    """Weighted means of the parameter slices, first in shares and then together.

    Groups are runs of sorted rows: most have few rows, and a pandas frame for each would cost more than its mean.
    """
    def mean(batches):
        at, held = None, []

        def row():
            weights, slices = (np.array(x) for x in zip(*held, strict=True))
            values = np.average(slices, axis=0, weights=weights).astype(np.float32)
            return pa.RecordBatch.from_arrays([
                pa.array([at[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([weights.sum()]), pa.array([values], pa.list_(pa.float32()))],
                names=["part", "share", "weight", "slice"])

        for batch in batches:
            slices, weights = batch.column("slice"), batch.column("weight").to_numpy()
            for i, key in enumerate(zip(batch.column("part").to_pylist(), batch.column("share").to_pylist(), strict=True)):
                if held and key != at:
                    yield row()
                    held = []
                at = key
                held.append((weights[i], slices[i].values.to_numpy()))
        if held:
            yield row()

    kind = "part int, share int, weight double, slice array<float>"
    for keys in (["part", "share"], ["part"]):
        rows = rows.repartition(*keys).sortWithinPartitions("part", "share").mapInArrow(mean, kind)
    return rows


def dealt(docs: DataFrame, share: int) -> DataFrame:
    """(text, turn): ``docs`` dealt over ``share`` turns by a hash of a row number, stored so that no row changes its turn."""
    turn = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(100)), F.lit(share)).cast("int")
    return store(docs.select(text_or_empty(), turn.alias("turn")), "training")


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int, share: int, rate: float) -> dict[str, np.ndarray]:
    """Model averaging: in each round every partition trains from the shared parameters.

    ``docs`` are ``dealt`` over ``share`` turns; with as many rounds every
    document is learned from once, whole.
    """
    if share > rounds:
        raise ValueError("some training documents would have no turn: more shares than rounds")
    spark = docs.sparkSession
    light = vocabulary.light()
    parameters = gru.start(light.shape, light.head_counts, light.tail_tokens)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((parameters, light))

        def run(batches, shared=shared, rate=rate / (1 + turn)):
            p, v = shared.value
            trainer = gru.Trainer(p, v.shape, rate)
            held, fresh, size = [], [], 0

            def learn():
                trainer.train(np.concatenate(held), np.concatenate(fresh))

            for batch in batches:
                for _, _, data, offsets in text_chunks(batch):
                    h, s, first = _tokens(data, offsets)
                    new = np.zeros(len(h), bool)
                    new[first[:-1]] = True
                    held.append(v.look_up(h, s)[0])
                    fresh.append(new)
                    size += len(h)
                    if size > STREAM_TOKENS:
                        learn()
                        held, fresh, size = [], [], 0
            if size:
                learn()
            if trainer.seen:
                flat = gru.flatten(trainer.p)
                slices = [flat[i: i + SLICE] for i in range(0, len(flat), SLICE)]
                spread = int(abs(hash(float(flat.sum())))) % 64
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(len(slices), dtype=np.int32)), pa.array(np.full(len(slices), spread, np.int32)),
                    pa.array(np.full(len(slices), float(trainer.seen))), pa.array(slices, pa.list_(pa.float32()))],
                    names=["part", "share", "weight", "slice"])

        rows = docs.where(F.col("turn") == turn % share).select("text").mapInArrow(run, "part int, share int, weight double, slice array<float>")
        found = sorted(_averaged(rows).select("part", "slice").collect())  # as many rows as the model has slices
        if found:
            parameters = gru.restore(np.concatenate([np.array(r["slice"], np.float32) for r in found]), parameters)
        shared.unpersist()
    return parameters


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, parameters: dict[str, np.ndarray]) -> DataFrame:
    """(row, doc_id, n_tokens, n_known, base_score, score) of every row.

    Words that tasks hold are scored there; the others are joined with their
    counts, one row per document and word, and summed per document.
    """
    light = vocabulary.light()
    shared = docs.sparkSession.sparkContext.broadcast((parameters, light))

    def run(batch):
        p, v = shared.value
        ids, rows = batch.column("doc_id"), batch.column("row")
        for begin, end, data, offsets in text_chunks(batch, most=SCORE_BYTES):
            h, s, first = _tokens(data, offsets)
            token, n = v.look_up(h, s)
            count = end - begin
            owner = np.repeat(np.arange(count), np.diff(first))
            natural = gru.log_likelihood(p, v.shape, token, first)
            held = n > 0
            sums = lambda x, w: np.bincount(x, w, minlength=count)
            inner = held & (token >= v.shape.heads)
            model = natural / np.log(10) + sums(owner[inner], v.log_seen[s[inner]] + np.log10(n[inner]))
            key = np.stack([owner[~held].astype(U64), h[~held]], axis=1)
            order = np.lexsort((key[:, 1], key[:, 0]))
            key, tail = key[order], s[~held][order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            place = np.flatnonzero(new)
            times = np.diff(np.append(place, len(key))).astype(np.int32)
            cut = np.concatenate([[0], np.cumsum(np.bincount(key[place, 0].astype(np.int64), minlength=count))]).astype(np.int32)
            of = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x))
            yield {
                "row": rows.slice(begin, count), "doc_id": ids.slice(begin, count), "n_tokens": np.diff(first),
                "known": sums(owner, held.astype(np.float64)).astype(np.int64),
                "base": sums(owner, np.log10(n + 1.0)), "model": model,
                "words": of(key[place, 1].view(np.int64)), "tails": of(tail[place].astype(np.int8)), "times": of(times),
            }

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    first = store(arrow(run, numbered, "row long, doc_id long, n_tokens long, known long, base double, model double, "
                                       "words array<long>, tails array<tinyint>, times array<int>", SCORE_BYTES), "scored")
    apart = first.select("row", F.explode(F.arrays_zip("words", "tails", "times")).alias("x")).select(
        "row", F.col("x.words").alias("word"), F.col("x.tails").cast("int").alias("t"), F.col("x.times").alias("times"))
    held = vocabulary.kept.select("word")
    others = counts.select("word", "n").join(held, "word", "left_anti")
    table = lambda a: F.array(*[F.lit(float(x)) for x in a])
    at = lambda a: F.element_at(table(a), F.col("t") + 1)
    inner = F.when(F.col("n").isNull(), at(light.log_unseen)).otherwise(at(light.log_seen) + F.log10("n"))
    rest = apart.join(others, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("more_base"),
        F.sum(F.col("times") * inner).alias("more_model"))
    each = float(np.log10(light.total + light.types + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return first.drop("words", "tails", "times").join(rest, "row", "left").select(
        "row", "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(light.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") - F.col("n_tokens") * each).alias("base_score"),
        (F.col("model") + zero("more_model")).alias("score"))


def log_scores(docs: DataFrame, unseen: Column | None = None, known: int = KNOWN, heads: int = HEADS,
               rounds: int = ROUNDS, share: int = SHARE, rate: float = RATE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Counts cover all training texts, those not ``unseen`` (crc32 of the id
    modulo 7 is 2).  The network predicts the ``heads`` most frequent words and
    classes of the others; inside a class, seen words share by count, and one
    unknown word has the Good-Turing share of words seen once, so the
    probabilities over all known words and one unknown sum to 1.

    Null and empty texts are the end alone; repeated rows get equal scores and
    count each; null ids are trained on; without training texts all words are
    unknown; an empty table gives no rows; other columns are not read.
    """
    unseen = held_out(F.col("doc_id"), 7, 2) if unseen is None else unseen
    training = dealt(docs.where(~unseen), share)
    counts = store(word_counts(training), "word-counts")
    vocabulary = Vocabulary(counts, known, heads)
    parameters = train(training, vocabulary, rounds, share, rate)
    return score(docs, counts, vocabulary, parameters).select(
        "doc_id", unseen.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
