"""Log-probability of texts under a hashed maximum-entropy model with class-factored softmax.

A token is predicted in three steps: its class, its bucket in the class, the token in
its bucket. The first two are softmaxes over hashed features of the three tokens
before (n-grams and skips); the third is the token's share of its bucket in the
training counts, smoothed like the base score, so the product is a distribution over
all known tokens and one unknown token per bucket. Frequent tokens have buckets of their
own, the others are grouped by their last two bytes.

Training goes through disjoint slices of the training texts: each task takes gradient
steps on its texts from the shared weights, Spark adds the updates up, and the mean
update, weighted by tokens, moves the shared weights.

Counts of all tokens stay in Spark. The HOT most frequent tokens are broadcast (their
number and length are bounded), the others meet their counts in a join by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenland.llm.common import cut, fold

CLASSES, SUBS = 8, 16
BUCKETS = CLASSES * SUBS
OWN = 64  # buckets of single tokens, the end token's included
ROWS = 1 << 14  # hashed features
HOT = 120_000
HOT_BYTES = 64  # longer tokens are never broadcast
ROUNDS = 2
BATCH = 16_384  # tokens of one gradient step
CHUNK_TOKENS = 8 * BATCH  # tokens numbered at a time
RUN_BYTES = 1 << 23  # text split at a time
FEW = 8  # gradients of a row that are added one by one
RATE = 0.3
MOST_WORDS = 600_000  # counts held in one task
END = b""
START = 3  # tokens before a text
CHUNK = 4096  # weights in one row while updates are added up


def tokens(text: str | None) -> list[bytes]:
    """Words between blanks, A-Z in lower case (bytes.lower and bytes.split know ASCII only), then the end."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def _spelled(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """`tokens` of many texts, RUN_BYTES or one text at a time: the different tokens, which of them each token is, tokens per text.

    The end token is the last of the different ones.
    """
    if not len(texts):
        return
    run = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // RUN_BYTES
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    for start, end in zip(starts, [*starts[1:], len(texts)], strict=True):
        # both kernels know ASCII only, like those of bytes
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts[start:end], "")))
        words, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
        empty = (pc.binary_length(words).to_numpy() == 0).nonzero()[0]  # from blanks at the ends
        if len(empty):
            sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
            words = words.filter(pc.not_equal(words, ""))
        sizes += 1
        coded = words.dictionary_encode()
        different = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
        which = np.full(sizes.sum(), len(different) - 1)
        is_word = np.ones(len(which), bool)
        is_word[np.cumsum(sizes) - 1] = False
        which[is_word] = coded.indices.to_numpy()
        yield different, which, sizes


class Words:
    """What the model needs of tokens: bucket, hash, log10(count + 0.5) of the broadcast ones (NaN: not one of them)."""

    def __init__(self, own: dict[bytes, int], hot: dict[bytes, float]):
        self.own, self.hot = own, pa.array([*hot], pa.binary())
        self.known = np.array([*hot.values(), np.nan])  # the last for those that are not found
        self.shared: dict[bytes, int] = {}  # last two bytes to bucket

    def are_hot(self, words: pa.Array) -> np.ndarray:
        return pc.is_in(words, self.hot).to_numpy(zero_copy_only=False)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spelled, shared = words.to_pylist(), self.shared
        ends = pc.binary_slice(words, -2).dictionary_encode()
        for end in ends.dictionary.to_pylist():
            if end not in shared:
                shared[end] = bucket_of(end, {})
        bucket = np.array([shared[end] for end in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]
        place = pc.index_in(words, pa.array([*self.own], pa.binary())).fill_null(-1).to_numpy()
        bucket = np.where(place < 0, bucket, np.array([*self.own.values()], np.int64)[place])
        code = np.fromiter(map(xxhash.xxh32_intdigest, spelled), np.uint32, len(spelled)) | np.uint32(1)
        return bucket, code, self.known[pc.index_in(words, self.hot).fill_null(-1).to_numpy()]


def bucket_of(word: bytes, own: dict[bytes, int]) -> int:
    bucket = own.get(word)
    return OWN + xxhash.xxh32_intdigest(word[-2:]) % (BUCKETS - OWN) if bucket is None else bucket


@dataclass
class Model:
    own: dict[bytes, int] = field(default_factory=lambda: {END: 0})
    hot: dict[bytes, float] = field(default_factory=dict)  # token to log10(count + 0.5)
    total: int = 0  # N
    distinct: int = 0  # V
    inside: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))  # log10(N_b + 0.5 (V_b + 1))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(ROWS * (CLASSES + SUBS), np.float32))

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of the classes and those of the buckets in a class, row by row."""
        return parts_of(self.weights)


def parts_of(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut_at = ROWS * CLASSES
    return flat[:cut_at].reshape(ROWS, CLASSES), flat[cut_at:].reshape(ROWS, SUBS)


def _features(codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Rows of the weights for the places `at`: last token, last two, and the two skips. Row 0 is the constant."""
    one, two, three = codes[at - 1], codes[at - 2], codes[at - 3]
    out = []
    for value in (one * np.uint32(2654435761), one * np.uint32(2246822519) + two * np.uint32(3266489917), two * np.uint32(668265263), three * np.uint32(374761393)):
        value = value ^ (value >> np.uint32(15))
        out.append(1 + (value * np.uint32(2246822519) >> np.uint32(8)) % np.uint32(ROWS - 1))
    return out


def _sub_rows(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The row of a feature together with a class; the class alone has a row of its own as well."""
    return (rows * np.uint32(7919) + (classes + 1).astype(np.uint32) * np.uint32(104_729)) % np.uint32(ROWS)


def _softmax(logits: np.ndarray) -> np.ndarray:
    turned = np.ascontiguousarray(logits.T)  # CLASSES or SUBS long rows instead of many short ones
    turned -= turned.max(axis=0)
    np.exp(turned, out=turned)
    parts = turned[:8] + turned[8:] if len(turned) == 16 else turned
    turned /= ((parts[0] + parts[1]) + (parts[2] + parts[3])) + ((parts[4] + parts[5]) + (parts[6] + parts[7]))
    return np.ascontiguousarray(turned.T)


def _chances(weights: tuple[np.ndarray, np.ndarray], rows: list[np.ndarray], buckets: np.ndarray):
    """Classes, subs, rows of the lower softmax, chance of every class, chance of every sub in the true class."""
    classes, subs = buckets // SUBS, buckets % SUBS
    above, under = weights
    below = [_sub_rows(r, classes) for r in (np.zeros(len(buckets), np.uint32), *rows)]
    upper = np.repeat(above[:1], len(buckets), axis=0)
    for r in rows:
        upper += above.take(r, axis=0)
    lower = under.take(below[0], axis=0)
    for r in below[1:]:
        lower += under.take(r, axis=0)
    return classes, subs, below, _softmax(upper), _softmax(lower)


def _sums(rows: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the gradients of each row, and the rows.

    Most rows occur a few times in a batch: their first gradients are taken at once, then their
    second ones, and so on. Only the stretches of frequent rows are left to `reduceat`.
    """
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # ROWS is at most 2 ** 16: a radix sort
    sorted_rows = rows.take(order)
    starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    times = np.diff(starts, append=len(rows))
    few = np.flatnonzero(times <= FEW)
    few = few.take(np.argsort((FEW - times.take(few)).astype(np.uint8), kind="stable"))  # those with most gradients first
    at = starts.take(few)
    more = len(few) - np.cumsum(np.bincount(times.take(few), minlength=FEW + 1))  # rows with more than k gradients
    sums = gaps.take(order.take(at), axis=0)
    rest = gaps.take(order.take(at[: more[1]] + 1), axis=0)
    for k in range(2, FEW):
        rest[: more[k]] += gaps.take(order.take(at[: more[k]] + k), axis=0)
    sums[: more[1]] += rest
    used = sorted_rows.take(at)
    if len(few) < len(times):
        often = times > FEW
        bounds = np.r_[0, np.cumsum(times[often])[:-1]]
        frequent = np.add.reduceat(gaps.take(order[np.repeat(often, times)], axis=0), bounds, axis=0)
        sums, used = np.concatenate([sums, frequent]), np.concatenate([used, sorted_rows[starts[often]]])
    return sums, used


def _move(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, gaps: np.ndarray) -> None:
    """One step of the rows' weights against their summed gradients, each weight at its own rate (Adagrad)."""
    sums, used = _sums(rows, gaps)
    square = squares.take(used, axis=0)
    square += sums * sums
    squares[used] = square
    square += np.float32(1)
    np.sqrt(square, out=square)
    sums *= np.float32(RATE)
    sums /= square
    weights[used] = weights.take(used, axis=0) - sums


def _step(weights: tuple[np.ndarray, np.ndarray], squares: tuple[np.ndarray, np.ndarray], rows: list[np.ndarray], buckets: np.ndarray) -> None:
    """One gradient step on a batch of places."""
    n = np.arange(len(buckets))
    classes, subs, below, upper, lower = _chances(weights, rows, buckets)
    upper[n, classes] -= 1
    lower[n, subs] -= 1
    _move(weights[0], squares[0], np.zeros(1, np.uint32), upper.sum(axis=0, keepdims=True))
    for r in rows:
        _move(weights[0], squares[0], r, upper)
    for r in below:
        _move(weights[1], squares[1], r, lower)


def _placed(texts: pa.Array, words: Words, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Several texts in a row, each led by START places of hash 0: buckets, hashes and known parts of the tokens (`Words.of`);
    places of the tokens; tokens per text."""
    parts, sizes, held = [], [], 0
    for different, which, counts in _spelled(texts):
        columns = [x[which] for x in words.of(different)]
        ends = np.cumsum(counts)
        text = token = 0
        while (last := int(np.searchsorted(ends, token + most - held))) < len(ends):
            end = int(ends[last])
            yield _joined([*parts, [x[token:end] for x in columns]], [*sizes, counts[text : last + 1]])
            parts, sizes, held, text, token = [], [], 0, last + 1, end
        parts.append([x[token:] for x in columns])
        sizes.append(counts[text:])
        held += len(which) - token
    if held:
        yield _joined(parts, sizes)


def _joined(parts: list[list[np.ndarray]], sizes: list[np.ndarray]):
    columns, counts = [np.concatenate(x) for x in zip(*parts, strict=True)], np.concatenate(sizes)
    total = len(columns[0])
    at = np.arange(total) + START * (np.repeat(np.arange(len(counts)), counts) + 1)
    spread = []
    for x in columns:
        spread.append(np.zeros(total + START * len(counts), x.dtype))
        spread[-1][at] = x
    return *spread, at, counts


def count_tokens(texts: DataFrame) -> DataFrame:
    """word (binary), n over all rows of `texts`; each task adds up what it holds before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added() -> pa.Table:
            sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return sums.select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            for different, which, _ in _spelled(batch["text"]):
                held.append(pa.table({"word": different, "n": np.bincount(which, minlength=len(different))}))
                if sum(map(len, held)) > MOST_WORDS:
                    held = [added()]
                    if len(held[0]) > MOST_WORDS // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from added().to_batches()

    parts = texts.select("text").mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _bucket_sizes(counts: DataFrame, own: dict[bytes, int]) -> np.ndarray:
    """N_b and V_b of every bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for pdf in batches:
            buckets = np.array([bucket_of(bytes(w), own) for w in pdf["word"]], np.int64)
            sums[0] += np.bincount(buckets, weights=pdf["n"], minlength=BUCKETS).astype(np.int64)
            sums[1] += np.bincount(buckets, minlength=BUCKETS)
        yield pd.DataFrame({"bucket": range(BUCKETS), "n": sums[0], "v": sums[1]})

    parts = counts.mapInPandas(run, "bucket int, n long, v long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    out = np.zeros((2, BUCKETS))
    for r in parts.collect():  # BUCKETS rows
        out[:, r.bucket] = r.n, r.v
    return out


def _round(texts: DataFrame, model: Model) -> np.ndarray:
    """Mean update of the weights over all tasks, weighted by their tokens."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded by HOT, HOT_BYTES and ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value.weights
        weights, squares, seen = start.copy(), np.zeros_like(start), 0
        own, own_squares = parts_of(weights), parts_of(squares)
        words = Words(shared.value.own, {})
        for batch in batches:
            for buckets, codes, _, at, _ in _placed(batch["text"], words, CHUNK_TOKENS):
                for k in range(0, len(at), BATCH):
                    part = at[k : k + BATCH]
                    _step(own, own_squares, _features(codes, part), buckets[part])
                seen += len(at)
        if seen:
            change = (weights - start) * np.float32(seen)
            chunks = len(change) // CHUNK
            rows = pa.ListArray.from_arrays(np.arange(0, len(change) + 1, CHUNK, dtype=np.int32), pa.array(change))
            yield pa.RecordBatch.from_pydict({"chunk": np.arange(chunks, dtype=np.int32), "change": rows, "seen": np.full(chunks, seen, np.int64)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.array(pdf["change"].tolist(), np.float64), axis=0) / pdf["seen"].sum()
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "change": [total.astype(np.float32)]})

    parts = texts.select("text").mapInArrow(run, "chunk int, change array<float>, seen long")
    out = np.zeros((model.weights.size // CHUNK, CHUNK), np.float32)
    for r in parts.groupBy("chunk").applyInPandas(add, "chunk int, change array<float>").collect():  # the weights once
        out[r.chunk] = r.change
    return out.reshape(model.weights.shape)


def _frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The tokens above a count that at most HOT tokens reach, by falling count.

    The count comes from a histogram in sixteenths of powers of two, so no task sends
    more than its share of the tokens that are kept.
    """
    step = F.floor(F.log2(F.col("n")) * 16).cast("int")
    short = counts.where(F.octet_length("word") <= HOT_BYTES).withColumn("step", step)
    held, least = 0, None
    for r in short.groupBy("step").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():  # 1,024 rows at most
        held += r.words
        if held > HOT:
            break
        least = r.step
    if least is None:
        return []
    rows = short.where(F.col("step") >= least).select("word", "n").collect()
    return sorted(((bytes(r.word), r.n) for r in rows), key=lambda x: (-x[1], x[0]))


def train(texts: DataFrame, counts: DataFrame) -> Model:
    """Model from the training rows (doc_id, text) and their token counts."""
    model = Model()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    model.total, model.distinct = int(sums.n), int(sums.v)
    model.hot = {w: float(np.log10(n + 0.5)) for w, n in _frequent(counts)}
    for word in [w for w in model.hot if w != END][: OWN - 1]:
        model.own[word] = len(model.own)
    size, distinct = _bucket_sizes(counts, model.own)
    model.inside = np.log10(size + 0.5 * (distinct + 1))
    for k in range(ROUNDS):
        part = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == k)
        model.weights = model.weights + _round(part, model)
    return model


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        """Rows alike in id and text share a key, and their results."""
        each = zip(batch["doc_id"].to_pylist(), pc.fill_null(batch["text"], "").cast(pa.binary()), strict=True)
        digests = [xxhash.xxh3_64_intdigest(b"%s\n%s" % (str(doc_id).encode(), text.as_buffer().to_pybytes())) for doc_id, text in each]
        return np.array(digests, np.uint64).view(np.int64)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.own, shared.value.hot)
        for batch in batches:
            keys, done = keys_of(batch), 0
            for different, which, sizes in _spelled(batch["text"]):
                seldom = ~words.are_hot(different)[which]
                text = np.repeat(np.arange(len(sizes)), sizes)[seldom]
                pairs, times = np.unique(text * len(different) + which[seldom], return_counts=True)
                text, word = np.divmod(pairs, len(different))
                first = np.diff(text, prepend=-1) != 0
                yield pa.RecordBatch.from_pydict({"key": keys[done + text], "word": different.take(pa.array(word)), "times": times.astype(np.int64), "first": first.astype(np.int32)})
                done += len(sizes)

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        words, weights = Words(own.own, own.hot), own.parts()
        for batch in batches:
            if not len(batch):
                continue
            out = []
            for buckets, codes, logs, at, sizes in _placed(batch["text"], words, CHUNK_TOKENS):
                chance = np.empty(len(at))
                for k in range(0, len(at), BATCH):
                    part = at[k : k + BATCH]
                    classes, subs, _, upper, lower = _chances(weights, _features(codes, part), buckets[part])
                    n = np.arange(len(part))
                    chance[k : k + BATCH] = np.log10(upper[n, classes].astype(np.float64)) + np.log10(lower[n, subs].astype(np.float64))
                chance -= own.inside[buckets[at]]
                known = logs[at]
                hot = ~np.isnan(known)
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                out.append((sizes, *[np.add.reduceat(x, starts) for x in (chance, np.where(hot, known, 0.0), hot.astype(np.int64))]))
            columns = map(np.concatenate, zip(*out, strict=True))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "key": keys_of(batch), **dict(zip(("n_tokens", "chance", "known", "hot"), columns, strict=True))})

    seldom = rows.mapInArrow(rare, "key long, word binary, times long, first int")
    met = seldom.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_row = met.groupBy("key").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum("first").alias("rows"),
    )
    seen = rows.mapInArrow(context, "doc_id long, key long, n_tokens long, chance double, known double, hot long").join(by_row, "key", "left")
    logs = F.col("known") + F.coalesce(F.col("more") / F.col("rows"), F.lit(0.0))
    each = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    return seen.select(
        "doc_id",
        "n_tokens",
        (F.col("hot") + F.coalesce((F.col("more_known") / F.col("rows")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * each).alias("base_score"),
        (logs + F.col("chance")).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows whose crc32 of the id modulo 5 is not 1. Null and empty texts are the end token
    alone; a null id counts as the empty text for the fold; repeated rows count and are scored each.
    Without training rows N and V are 0 and the weights stay 0. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = rows.where(fold(F.col("doc_id"), 5) != 1)
    counts = cut(count_tokens(learned))
    scores = score_texts(rows, train(learned, counts), counts)
    return scores.withColumn("held_out", fold(F.col("doc_id"), 5) == 1)
