"""A hidden Markov language model, trained by Baum-Welch on Spark.

Latent states emit symbols: words that are frequent enough, and for the other
words the class of their last two bytes; within a class a word has its own smoothed
frequency, known or not, so that probabilities of texts sum to one. Expected
counts are made in each partition and summed by Spark; scaled forward recursion
gives the exact likelihood of a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.stage import by_bytes, fresh, stored
from fathom.llm.textkernel import U64, chunks, mix, scan, segment_sum

STATES = 8
#: A word that training texts have so often has emissions of its own, the most frequent WORDS at most; the others emit by their classes.
OFTEN, WORDS, CLASSES = 32, 1 << 17, 1024
#: Words whose counts go to all executors; the rest are looked up by a join.
LOOKUP = 1 << 18
ITERATIONS = 4
#: Longer training sequences are worked on in blocks of so many tokens, with what crosses their borders carried over.
SEGMENT = 512
#: Training tokens that one task counts over, at least where there are tasks for all cores: each sends up to WORDS + CLASSES rows of sums.
TASK_TOKENS = 1 << 24
#: Steps after which products are scaled; no product of so many emissions is too small a number.
RESCALE = 12
PRIOR = 50.0
ADD = 0.1

END = 0x1D5E0F


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is divisible by 10; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each token, and each text's range of them: its words in lower case (A-Z), then an end."""
    words = scan(texts, lower=True)
    last = words.buffer[words.ends - 1].astype(np.int64)
    before = np.where(words.ends - words.starts > 1, words.buffer[np.maximum(words.ends - 2, 0)], 0).astype(np.int64)
    kind = (mix((last * 256 + before + 1).astype(U64)) >> U64(54)).astype(np.int64)  # CLASSES is 2 ** 10
    ptr = words.text_ptr + np.arange(len(words.text_ptr))
    n = int(ptr[-1])
    word = np.ones(n, bool)
    word[ptr[1:] - 1] = False
    hashes, kinds = np.full(n, END, np.int64), np.zeros(n, np.int64)
    hashes[word], kinds[word] = words.hashes().view(np.int64), kind
    return hashes, kinds, ptr


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(hash, kind, n): the count of each token of docs."""
    frame = docs.select(F.col(text_col).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0):
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            for lo, hi in chunks(texts, 8 << 20):
                hashes, kinds, _ = tokens(texts[lo:hi])
                own, at, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(kinds[at].astype(np.int32)), pa.array(n)], names=["hash", "kind", "n"])

    return frame.mapInArrow(run, "hash long, kind int, n long").groupBy("hash", "kind").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Counts of the most frequent tokens, and the symbol of each: its rank if that is below own, else its class."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    symbols: np.ndarray  # the symbol, or -1: its class
    class_tokens: np.ndarray
    class_types: np.ndarray
    total: int
    types: int
    unigram: np.ndarray
    own: int  # words with a symbol of their own, the end among them

    @property
    def floor(self) -> float:
        """log10 of the base's denominator."""
        return float(np.log10(self.total + ADD * (self.types + 1)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)


def lexicon(words: DataFrame) -> Lexicon:
    """The lexicon of a stored vocabulary: its most frequent tokens, LOOKUP at most, and sums by class go through the driver.

    Tokens that tie at the least count are all in or all out.
    """
    often = words.groupBy("n").agg(F.count("*").alias("types")).toArrow().to_pandas().sort_values("n", ascending=False)
    often = often[often["types"].cumsum() <= LOOKUP]
    least = int(often["n"].min()) if len(often) else 1 << 62
    top = words.where(F.col("n") >= least).toArrow().to_pandas().sort_values(["n", "hash"], ascending=[False, True], ignore_index=True)
    end = top["hash"] == END
    top = pd.concat([top[end], top[~end]]) if end.any() else pd.concat([words.where(F.col("hash") == END).toArrow().to_pandas(), top])
    total, types = words.agg(F.sum("n"), F.count("*")).first()
    by_class = words.where(F.col("hash") != END).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toArrow().to_pandas()
    n, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    n[by_class["kind"]], kinds[by_class["kind"]] = by_class["n"], by_class["types"]
    n_own = max(1, min(WORDS, int(((top["n"] >= OFTEN) | (top["hash"] == END)).sum())))
    own = top.iloc[:n_own]
    own = own[own["hash"] != END]
    n -= np.bincount(own["kind"], weights=own["n"], minlength=CLASSES)
    kinds -= np.bincount(own["kind"], minlength=CLASSES)
    symbol = np.where(np.arange(len(top)) < n_own, np.arange(len(top)), -1)
    if not len(top) or top["hash"].iloc[0] != END:  # nothing to learn from: the end is a symbol all the same
        top = pd.DataFrame({"hash": [END], "kind": [0], "n": [0]})
        symbol = np.zeros(1, np.int64)
    unigram = np.zeros(n_own + CLASSES)
    unigram[: min(n_own, len(top))] = top["n"].iloc[:n_own]
    unigram[n_own:] = n
    unigram[0] += ADD
    unigram[n_own:] += ADD
    order = np.argsort(top["hash"].to_numpy())
    return Lexicon(top["hash"].to_numpy()[order], top["n"].to_numpy()[order].astype(float), symbol[order], n, kinds, int(total or 0), int(types or 0), unigram / unigram.sum(), n_own)


def encoded(docs: DataFrame, words: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, held_out, n_tokens, symbols, and sums over the tokens that the lexicon has; rest: other tokens' hashes.

    known_log sums log10(count + ADD) over tokens that the lexicon has. class_log sums
    the log10 probabilities of words within their classes, up to the counts of the
    tokens in rest, which come with them by the join.
    """
    (row,) = fresh(docs, "_row")
    frame = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.monotonically_increasing_id().alias(row), F.col(text_col).cast("binary").alias("_text"))
    schema = frame.drop("_text").selectExpr(
        "*", "0L n_tokens", "0L n_found", "0D known_log", "0D class_log", "cast(null as binary) symbols", "cast(null as array<bigint>) rest"
    ).withColumnRenamed(row, "_row").schema
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        within = np.log10(lex.class_tokens + ADD * (lex.class_types + 1))
        for batch in by_bytes(batches, 3):
            texts = [t or b"" for t in batch.column(3).to_pylist()]
            for lo, hi in chunks(texts):
                hashes, kinds, ptr = tokens(texts[lo:hi])
                at, there = lex.find(hashes)
                symbol = np.where(there, lex.symbols[at], -1)
                in_class = symbol < 0
                log_n = np.where(there, np.log10(lex.counts[at] + ADD), 0.0)
                class_log = np.where(in_class, log_n - within[kinds], 0.0)
                symbol = np.where(in_class, lex.own + kinds, symbol).astype("<u4")
                missing = ~there
                cut = np.concatenate([[0], np.cumsum(missing)])[ptr]
                arrays = [c.slice(lo, hi - lo) for c in batch.columns[:3]]
                arrays += [pa.array(np.diff(ptr)), pa.array(segment_sum((there & (lex.counts[at] > 0)).astype(np.int64), ptr))]
                arrays += [pa.array(segment_sum(log_n, ptr)), pa.array(segment_sum(class_log, ptr))]
                arrays += [pa.array([symbol[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())]
                arrays += [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(hashes[missing]))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return frame.mapInArrow(run, schema)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def first_model(unigram: np.ndarray, states: int = STATES) -> Model:
    """Fixed noise around the unigram, so that the states can part."""
    noise = (mix(np.arange(1, unigram.size * states + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(11)).astype(float) * 2.0**-53
    emit = unigram[:, None] * np.exp(2 * noise.reshape(unigram.size, states) - 1)
    move = np.full((states, states), 0.3 / (states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.7 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _packed(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, long ones first, time by time: symbols, where each time starts, and the order."""
    length = np.array([len(s) for s in sequences])
    order = np.argsort(-length, kind="stable")
    length = length[order]
    flat = np.concatenate([sequences[i] for i in order])
    start = np.cumsum(length) - length
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    time_start = np.concatenate([[0], np.cumsum(live)])
    # Place of (sequence k, time t) in the packed order: time_start[t] + k.
    t = np.arange(len(flat)) - np.repeat(start, length)
    out = np.empty(len(flat), flat.dtype)
    out[time_start[t] + np.repeat(np.arange(len(length)), length)] = flat
    return out, time_start, order


def log_likelihood(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of the probability of each sequence, by scaled forward recursion."""
    if not sequences:
        return np.zeros(0)
    flat, at, order = _packed(sequences)
    out = np.zeros(len(sequences))
    alpha = model.start[None, :] * model.emit[flat[: at[1]]]
    for t in range(len(at) - 1):
        n = at[t + 1] - at[t]
        if t:
            alpha = (alpha[:n] @ model.move) * model.emit[flat[at[t] : at[t + 1]]]
        scale = alpha.sum(axis=1)
        out[:n] += np.log10(scale)
        alpha /= scale[:, None]
    result = np.empty(len(sequences))
    result[order] = out
    return result


def _blocks_of(sequences: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The sequences in blocks of SEGMENT tokens, and each block's sequence."""
    blocks, of = [], []
    for i, s in enumerate(sequences):
        for lo in range(0, len(s), SEGMENT):
            blocks.append(s[lo : lo + SEGMENT])
            of.append(i)
    return blocks, np.array(of, np.int64)


def _borders(blocks: list[np.ndarray], of: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each block the state's distribution before it (rows of nan for a first one) and the weights of its states after it (ones for a last one).

    All blocks of longer sequences become matrices at once; then these run along each sequence, forth and back.
    """
    states = len(model.start)
    before, after = np.full((len(blocks), states), np.nan), np.ones((len(blocks), states))
    long = np.flatnonzero(np.bincount(of, minlength=of.max() + 1)[of] > 1) if len(of) else np.zeros(0, np.int64)
    if not len(long):
        return before, after
    flat, at, order = _packed([blocks[k] for k in long])
    first = np.append(True, of[long][1:] != of[long][:-1])[order]
    step = np.broadcast_to(np.eye(states), (len(long), states, states)).copy()
    for t in range(len(at) - 1):
        n = at[t + 1] - at[t]
        moved = (step[:n].reshape(-1, states) @ model.move).reshape(n, states, states)
        if not t:  # nothing moves into a first token: all rows are the start
            moved[first] = model.start
        np.multiply(moved, model.emit[flat[at[t] : at[t + 1]]][:, None, :], out=step[:n])
        if t % RESCALE == RESCALE - 1:
            step[:n] /= step[:n].sum(axis=(1, 2))[:, None, None]
    through = np.empty_like(step)
    through[order] = step
    for j in range(1, len(long)):
        if of[long[j]] == of[long[j - 1]]:
            was = before[long[j - 1]]
            a = through[j - 1][0] if np.isnan(was[0]) else was @ through[j - 1]
            before[long[j]] = a / a.sum()
    for j in range(len(long) - 2, -1, -1):
        if of[long[j]] == of[long[j + 1]]:
            b = through[j + 1] @ after[long[j + 1]]
            after[long[j]] = b / b.sum()
    return before, after


def expected_counts(sequences: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of starts, moves and emissions, by the forward-backward recursion over whole sequences."""
    blocks, of = _blocks_of(sequences)
    before, after = _borders(blocks, of, model)
    flat, at, order = _packed(blocks)
    before, after = before[order], after[order]
    goes_on = ~np.isnan(before[:, 0])
    states = len(model.start)
    emitted = model.emit[flat]
    alpha, scales = np.empty((len(flat), states)), np.empty(len(flat))
    for t in range(len(at) - 1):
        now = slice(at[t], at[t + 1])
        n = at[t + 1] - at[t]
        if t:
            come = alpha[at[t - 1] : at[t - 1] + n] @ model.move
        else:
            come = np.where(goes_on[:, None], np.nan_to_num(before) @ model.move, model.start[None, :])
        a = come * emitted[now]
        scales[now] = a.sum(axis=1)
        alpha[now] = a / scales[now][:, None]
    moves = np.zeros((states, states))
    gamma = alpha  # alpha is turned into gamma from the end on
    beta = np.zeros((0, states))
    for t in range(len(at) - 2, -1, -1):
        now = slice(at[t], at[t + 1])
        n, ending = at[t + 1] - at[t], slice(len(beta), at[t + 1] - at[t])
        # Blocks that end here: what follows them, so that their states' weights sum to one.
        last = after[ending]
        beta = np.concatenate([beta, last / (alpha[now][ending] * last).sum(axis=1, keepdims=True)])
        ahead = emitted[now] * beta / scales[now][:, None]
        if t:
            moves += alpha[at[t - 1] : at[t - 1] + n].T @ ahead
        else:
            moves += before[goes_on].T @ ahead[goes_on]
        gamma[now] *= beta
        beta = ahead @ model.move.T
    emissions = np.column_stack([np.bincount(flat, weights=gamma[:, k], minlength=len(model.emit)) for k in range(states)])
    return gamma[: at[1]][~goes_on].sum(axis=0), moves * model.move, emissions


def baum_welch(codes: DataFrame, unigram: np.ndarray, states: int = STATES, iterations: int = ITERATIONS, n_tokens: int = 0) -> Model:
    """A model from the symbols of codes. Each iteration reads all of them; the sums have a row per symbol and per state.

    n_tokens, as many as codes hold, sets how many tasks make sums: one for each core, or for TASK_TOKENS of them, so
    that the rows that are shuffled don't grow with the number of files.
    """
    spark = codes.sparkSession
    codes = codes.coalesce(max(spark.sparkContext.defaultParallelism, -(-n_tokens // TASK_TOKENS)))
    model = first_model(unigram, states)
    size = len(unigram)
    columns = [f"s{k}" for k in range(states)]
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + states + 1, states))
            held: list[np.ndarray] = []
            n = 0

            def add() -> None:
                start, moves, emissions = expected_counts(held, shared.value)
                total[:size] += emissions
                total[size : size + states] += moves
                total[size + states] += start

            for batch in by_bytes(batches, 0):
                for data in batch.column(0).to_pylist():
                    held.append(np.frombuffer(data, "<u4"))
                    n += len(held[-1])
                    if n >= 1 << 19:
                        add()
                        held, n = [], 0
            if held:
                add()
            row = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(total[row, k]) for k in range(states))], names=["row", *columns])

        sums = codes.select("symbols").mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in columns))
        found = sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toArrow().to_pandas()
        total = np.zeros((size + states + 1, states))
        total[found["row"]] = found[columns].to_numpy()
        emit = total[:size] + PRIOR * unigram[:, None]
        move, start = total[size : size + states] + 1, total[size + states] + 1
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", iterations: int = ITERATIONS) -> DataFrame:
    """A row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows that aren't held out. base_score is the sum of
    the tokens' smoothed unigram log10 probabilities, score the model's log10
    probability of the text, both of whole texts. A null text is an empty one: its
    end alone. Rows with repeated ids are scored each. With nothing to learn from,
    all words are unknown. An empty table gives an empty table.
    """
    words = stored(vocabulary(docs.where(~held_out(id_col)), text_col), "vocabulary")
    lex = lexicon(words)
    codes = stored(encoded(docs, lex, id_col, text_col), "codes")
    model = baum_welch(codes.where("NOT held_out"), lex.unigram, iterations=iterations, n_tokens=lex.total)
    rest = codes.select("_row", F.explode("rest").alias("hash"))
    found = rest.join(words.select("hash", "n"), "hash", "left").groupBy("_row")
    found = found.agg(F.count("n").alias("_more"), F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + ADD)).alias("_log"))
    frame = codes.select(id_col, "held_out", "_row", "n_tokens", "n_found", "known_log", "class_log", "symbols")
    schema = frame.drop("symbols").withColumn("forward", F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 7, 8 << 20):
            own = [np.frombuffer(s, "<u4") for s in batch.column(7).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(log_likelihood(own, shared.value))], names=schema.names)

    d = frame.mapInArrow(run, schema).join(found, "_row", "left")
    more = F.coalesce("_log", F.lit(0.0))
    return d.select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("n_found") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("known_log") + more - F.col("n_tokens") * F.lit(lex.floor)).alias("base_score"),
        (F.col("forward") + F.col("class_log") + more).alias("score"),
    )
