"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

The model predicts, from the two tokens before, an output: a frequent token by itself, or the
class of rare tokens that it belongs to. The number of frequent tokens grows with the corpus, as
the cube root of its distinct tokens. Outputs lie in blocks; log P(output | two before) =
log P(block | two before) + log P(output | block, one before), both log-bilinear, so that batched
matrix products over about a square root of the outputs give normalised log-probabilities. Within a
rare class a token has its smoothed share of the class's corpus count, so the probabilities of all
tokens add up to one.

Every training text is learned from, each of its tokens as what is to be predicted once: in rounds
over ever larger parts of the corpus each task trains numpy weights on its texts from the same
start, and a Spark aggregate averages the tasks' weights by their tokens.

Counts come from the whole corpus too: tokens are counted for each task, summed by token, and
joined back. The ``LOCAL`` most frequent ones (a fixed number) travel to the tasks, which
leaves a small part of the occurrences for the exact join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import crc_mod, load_documents, space_words_of
from tessera.session import materialize

#: Classes of rare tokens.
CLASSES = 64
#: Frequent tokens for each unit of the cube root of the number of distinct tokens.
GROWTH = 48
#: Tokens whose counts every task holds, at most: those more frequent than the least count that allows it.
LOCAL = 1 << 17
#: Rounds of training: sixteenths of the corpus that each takes (all of it in the end), and the learning rate.
ROUNDS = ((1, 0.2), (3, 0.2), (12, 0.1))
DIMENSIONS, NOISE, NEAR_NOISE, BATCH, BUFFER = 16, 24, 2, 2048, 1 << 17
#: Bytes of text that are numbered and scored at once, and that are taken into the buffer of training at once.
CHUNK, TRAIN_CHUNK = 1 << 22, 1 << 19
#: Bytes of words that a task counts before it passes the counts on.
FLUSH = 24 << 20
#: The end of a text. Words hold no white space, so it is none of them.
END = b"\n"
ADD = 0.1


def rare_class(token: bytes) -> int:
    """0 to CLASSES - 1, by the first three bytes (about the first two letters)."""
    return zlib.crc32(token[:3]) % CLASSES


def rare_classes(words: pa.Array) -> np.ndarray:
    """``rare_class`` of each word: computed once for each beginning that occurs."""
    heads = pc.binary_slice(words, 0, 3).dictionary_encode()
    return np.array([rare_class(h) for h in heads.dictionary.to_pylist()], np.int64)[heads.indices.to_numpy()]


class Numbers:
    """Output numbers of tokens: 0 the end, then the frequent ones, then classes. ranked: the most frequent tokens, in order."""

    def __init__(self, frequent: int, ranked: pa.Array):
        self.ranked, self.frequent = ranked, frequent
        self.of = np.concatenate([np.arange(1, frequent + 1), 1 + frequent + rare_classes(ranked[frequent:]), [0]])

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place in ranked, -1 for none; output number) of each word. A call hashes ``ranked``, so words come many at a time."""
        at = pc.fill_null(pc.index_in(words, value_set=self.ranked), -1).to_numpy().astype(np.int64)
        ids = self.of[at]
        missing = np.flatnonzero(at < 0)
        ids[missing] = 1 + self.frequent + rare_classes(words.take(pa.array(missing)))
        return at, ids


class Layout:
    """Where the parts of the model lie in one matrix of weights: contexts, outputs, blocks, three square matrices.

    The last column holds the biases of outputs and blocks.
    """

    def __init__(self, outputs: int, dimensions: int = DIMENSIONS):
        self.outputs, self.dimensions = outputs, dimensions
        self.width = max(1, int(np.ceil(np.sqrt(outputs))))
        self.blocks = -(-outputs // self.width)
        cuts = np.cumsum([0, outputs, outputs, self.blocks, dimensions, dimensions, dimensions])
        self.context, self.target, self.block, self.first, self.second, self.inner = [slice(a, z) for a, z in zip(cuts, cuts[1:])]
        self.rows = int(cuts[-1])

    def start(self, unigram: np.ndarray, seed: int = 1) -> np.ndarray:
        d = self.dimensions
        w = np.zeros((self.rows, d + 1), np.float32)
        draw = np.random.default_rng(seed)
        w[: self.block.stop, :d] = draw.normal(0, 0.1, (self.block.stop, d))
        share = (unigram + 0.5) / (unigram + 0.5).sum()
        w[self.target, d] = np.log(share)
        w[self.block, d] = np.log(np.add.reduceat(share, np.arange(0, self.outputs, self.width)))
        for part, scale in ((self.first, 0.7), (self.second, 0.3), (self.inner, 0.7)):
            w[part, :d] = np.eye(d) * scale
        return w


def contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each, and the one before that; 0 before a text begins. ids: whole texts in a row, each ending in 0."""
    before = np.concatenate([[0, 0], ids])
    one, two = before[1:-1], before[:-2].copy()
    two[one == 0] = 0
    return one, two


def _sums(at: np.ndarray, rows: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Which numbers occur, and the sums of their rows. kind: the least type that holds the numbers (numpy sorts two bytes by radix)."""
    order = np.argsort(at.astype(kind), kind="stable")
    at = at.take(order)
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at.take(begin), np.add.reduceat(rows.take(order, 0), begin, axis=0)


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps on a copy of the weights.

    For blocks, NOISE samples of the block unigram are shared by a batch; for outputs within a
    block, each token has NEAR_NOISE samples of the unigram within its block. Every token is
    predicted once; a ``share`` under 1 (not used by ``fit``) draws that part of them.
    """

    def __init__(self, layout: Layout, weights: np.ndarray, unigram: np.ndarray, rate: float, share: float = 1.0, seed: int = 2):
        self.share = share
        self.o, self.w, self.rate = layout, weights.copy(), np.float32(rate)
        self.past = np.full(weights.shape, 1e-6, np.float32)
        self.draw = np.random.default_rng(seed)
        share = (unigram + 0.5) / (unigram + 0.5).sum()
        begin = np.arange(0, layout.outputs, layout.width)
        self.block_share = np.add.reduceat(share, begin)
        self.log_block = np.log(NOISE * self.block_share).astype(np.float32)
        self.log_inner = np.log(NEAR_NOISE * share / np.repeat(self.block_share, layout.width)[: layout.outputs]).astype(np.float32)
        self.sum = np.concatenate([[0.0], np.cumsum(share)])
        self.kind = np.min_scalar_type(layout.outputs)
        self.tokens = 0
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        """Takes in whole texts in a row, each ending in 0. A buffer of texts is learned from in random order."""
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BUFFER:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.held)
        self.held, self.waiting = [], 0
        one, two = contexts(ids)
        order = self.draw.choice(len(ids), max(1, int(self.share * len(ids))), replace=False)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            self._step(ids[rows], one[rows], two[rows])
        self.tokens += len(ids)

    def _step(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        o, d, n = self.o, self.o.dimensions, len(word)
        c, t, u = self.w[o.context], self.w[o.target], self.w[o.block]
        # What the token before gives: to the hidden vector, then to that within the block.
        before = np.hstack([self.w[o.first, :d], self.w[o.inner, :d]])
        second = np.ascontiguousarray(self.w[o.second, :d])
        a, b = c.take(one, 0)[:, :d], c.take(two, 0)[:, :d]
        block = word // o.width
        # Hidden vectors have a last column of ones, for the biases.
        hidden, inside = np.ones((2, n, d + 1), np.float32)
        both = a @ before
        hidden[:, :d] = both[:, :d] + b @ second
        inside[:, :d] = both[:, d:]
        # Blocks: one hidden vector for each token, the noise shared.
        noise = self.draw.choice(o.blocks, NOISE, p=self.block_share)
        own_row, noise_rows = u.take(block, 0), u[noise]
        own = 1 / (1 + np.exp(self.log_block.take(block) - np.einsum("nd,nd->n", hidden, own_row))) - 1
        other = 1 / (1 + np.exp(self.log_block[noise] - hidden @ noise_rows.T))
        d_hidden = own[:, None] * own_row[:, :d] + other @ noise_rows[:, :d]
        # Rows of the sum by block: a matrix product, as blocks are few.
        member = np.zeros((o.blocks, n), np.float32)
        member[block, np.arange(n)] = own
        g_block = member @ hidden
        np.add.at(g_block, noise, other.T @ hidden)
        # Outputs of the block: the token and its own noise.
        begin, end = block * o.width, np.minimum((block + 1) * o.width, o.outputs)
        low, high = self.sum.take(begin), self.sum.take(end)
        drawn = np.searchsorted(self.sum, low[:, None] + self.draw.random((n, NEAR_NOISE)) * (high - low)[:, None], "right") - 1
        drawn = np.clip(drawn, begin[:, None], end[:, None] - 1)
        chosen = np.hstack([word[:, None], drawn])
        rows = t.take(chosen, 0)
        error = 1 / (1 + np.exp(self.log_inner.take(chosen) - np.einsum("nkd,nd->nk", rows, inside)))
        error[:, 0] -= 1
        d_inside = np.einsum("nk,nkd->nd", error, rows)[:, :d]
        at_t, g_t = _sums(chosen.ravel(), (error[:, :, None] * inside[:, None, :]).reshape(-1, d + 1), self.kind)
        at_c, g_c = _sums(np.concatenate([one, two]), np.concatenate([np.hstack([d_hidden, d_inside]) @ before.T, d_hidden @ second.T]), self.kind)
        self._move(o.target.start + at_t, g_t / n)
        self._move(o.block, g_block / n)
        for part, g in ((o.first, a.T @ d_hidden), (o.second, b.T @ d_hidden), (o.inner, a.T @ d_inside)):
            self._move(part, g / n)
        self._move(at_c, g_c / n)

    def _move(self, at: np.ndarray | slice, g: np.ndarray) -> None:
        """A step of the first columns of rows, as many as ``g`` has."""
        k = g.shape[1]
        past = self.past[at, :k] + g * g
        self.past[at, :k] = past
        np.sqrt(past, out=past)
        self.w[at, :k] -= np.divide(self.rate * g, past, out=past)


class Tables:
    """What scoring needs, as plain arrays: context vectors for each use, and the normaliser of each block after each token."""

    @staticmethod
    def of(layout: Layout, w: np.ndarray) -> dict[str, np.ndarray]:
        d = layout.dimensions
        c, t, u = w[layout.context, :d], w[layout.target], w[layout.block]
        inside = c @ w[layout.inner, :d]
        z = np.empty((layout.outputs, layout.blocks), np.float32)
        for k in range(layout.blocks):
            part = t[k * layout.width : (k + 1) * layout.width]
            for at in range(0, layout.outputs, 1 << 14):
                s = inside[at : at + (1 << 14)] @ part[:, :d].T + part[:, d]
                top = s.max(1, keepdims=True)
                z[at : at + (1 << 14), k] = (top + np.log(np.exp(s - top).sum(1, keepdims=True)))[:, 0]
        return {"one": c @ w[layout.first, :d], "two": c @ w[layout.second, :d], "inside": inside, "target": t, "block": u, "z": z, "width": np.array(layout.width)}

    @staticmethod
    def log10(tables: dict[str, np.ndarray], ids: np.ndarray, size: int = 1 << 13) -> np.ndarray:
        """log10 P(output | the two before) of each of ids (whole texts in a row, each ending in 0)."""
        one, two = contexts(ids)
        width, target, u, z = int(tables["width"]), tables["target"], tables["block"], tables["z"]
        d = target.shape[1] - 1
        out = np.empty(len(ids))
        for at in range(0, len(ids), size):
            a, b, w = one[at : at + size], two[at : at + size], ids[at : at + size]
            block = w // width
            s = (tables["one"][a] + tables["two"][b]) @ u[:, :d].T
            s += u[:, d]
            own = s[np.arange(len(w)), block]
            total = np.exp(s, out=s).sum(1)
            if not np.isfinite(total).all() or not total.all():
                raise FloatingPointError("block scores out of range")
            of_block = own - np.log(total)
            within = (tables["inside"][a] * target[w, :d]).sum(1) + target[w, d] - z[a, block]
            out[at : at + size] = (of_block + within) / np.log(10)
        return out


def token_counts(docs: DataFrame) -> DataFrame:
    """(text, ...) -> (token, n): how often each token, the end included, occurs."""

    def counted(held: list[pa.Array], texts: int) -> pa.RecordBatch:
        words, n = pa.chunked_array(held, pa.binary()).value_counts().flatten()
        return pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.concat_arrays([n, pa.array([texts], pa.int64())])], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0
        for b in _parts(batches, 0):
            held.append(space_words_of(b.column(0))[0])
            size, texts = size + held[-1].nbytes, texts + b.num_rows
            if size > FLUSH:
                yield counted(held, texts)
                held, size, texts = [], 0, 0
        if texts:
            yield counted(held, texts)

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def fit(training: DataFrame, ranked: list[bytes], frequent: int, unigram: np.ndarray) -> tuple[Layout, np.ndarray]:
    """The model's weights, learned from all training texts in the rounds of ROUNDS.

    A text belongs to one round, by its hash. Texts are learned from whole; a task passes on
    its weights times its tokens, a row for each row of the matrix, and Spark adds them up.
    """
    layout = Layout(len(unigram))
    weights = layout.start(unigram)
    spark = training.sparkSession
    columns = [f"w{i}" for i in range(layout.dimensions + 1)]
    slot = F.pmod(F.xxhash64("text", F.lit(23)), F.lit(16))
    vocabulary = spark.sparkContext.broadcast(pa.array(ranked, pa.binary()))
    begun = 0
    for sixteenths, rate in ROUNDS:
        sent = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate: float = rate) -> Iterator[pa.RecordBatch]:
            numbers, trainer = Numbers(frequent, vocabulary.value), Trainer(layout, sent.value, unigram, rate)
            for b in _parts(batches, 0):
                words, sizes = space_words_of(b.column(0))
                after = np.concatenate([[0], np.cumsum(sizes)])
                ids = np.insert(numbers(words)[1], after[1:], 0)
                for first, last in _cuts(b.column(0), TRAIN_CHUNK):
                    trainer.add(ids[after[first] + first : after[last] + last])
            trainer.flush()
            if trainer.tokens:
                cols = [pa.array(np.arange(layout.rows, dtype=np.int32)), pa.array(np.full(layout.rows, float(trainer.tokens)))]
                cols += [pa.array(trainer.w[:, i].astype(np.float64) * trainer.tokens) for i in range(layout.dimensions + 1)]
                yield pa.RecordBatch.from_arrays(cols, ["k", "tokens", *columns])

        part = training.where((slot >= begun) & (slot < begun + sixteenths)).select("text")
        begun += sixteenths
        learned = part.mapInArrow(run, "k int, tokens double, " + ", ".join(f"{c} double" for c in columns))
        got = learned.groupBy("k").agg(F.sum("tokens").alias("tokens"), *(F.sum(c).alias(c) for c in columns)).toArrow().sort_by("k")
        if got.num_rows:
            total = got.column("tokens").to_numpy()
            weights = np.stack([got.column(c).to_numpy() / total for c in columns], 1).astype(np.float32)
        sent.unpersist()
    return layout, weights


def _cuts(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` bytes of text (one text at least): first row, row after the last."""
    first, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1):
        held += n
        if held >= size:
            yield first, i
            first, held = i, 0
    if first < len(texts):
        yield first, len(texts)


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about CHUNK bytes of text, so that arrays over their tokens stay small."""
    for b in batches:
        for first, last in _cuts(b.column(text), CHUNK):
            yield b.slice(first, last - first)


def least_count(counts: DataFrame, most: int = LOCAL) -> int:
    """A count that at most ``most`` tokens exceed, 0 if all may. Counts are summed up by eighths of powers of two."""
    step = F.floor(F.log2("n") * 8)
    above = 0
    for row in sorted(counts.groupBy(step.alias("k")).agg(F.count("*").alias("types"), F.max("n").alias("high")).collect(), reverse=True):
        above += row["types"]
        if above > most:
            return row["high"]
    return 0


def score_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score: a row for each input row.

    ``training`` (doc_id, text) is what is counted and learned from. Null, empty and blank
    texts are the end token alone. Tokens that training lacks have a count of 0. Without
    training texts all is smoothing. Rows are independent, also where doc_ids repeat.
    """
    spark = docs.sparkSession
    counts = materialize(token_counts(training))
    rare = F.when(F.col("token") != END, F.crc32(F.substring("token", 1, 3)) % CLASSES).otherwise(-1)
    sums = {r[0]: (r[1], r[2]) for r in counts.groupBy(rare.cast("int").alias("k")).agg(F.sum("n"), F.count("*")).collect()}
    tokens, types = sum(v[0] for v in sums.values()), sum(v[1] for v in sums.values())
    floor = least_count(counts)
    local = {bytes(r[0]): r[1] for r in counts.where((F.col("token") != END) & (F.col("n") > floor)).collect()}
    ranked = sorted(local, key=lambda t: (-local[t], t))
    frequent = min(len(ranked), int(GROWTH * max(0, types) ** (1 / 3)))
    unigram = np.zeros(1 + frequent + CLASSES)
    unigram[0] = sums.get(-1, (0, 0))[0]
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, (n, v) in sums.items():
        if k >= 0:
            mass[k], kinds[k] = n, v
    for i, t in enumerate(ranked[:frequent]):
        unigram[i + 1] = local[t]
        mass[rare_class(t)] -= local[t]
        kinds[rare_class(t)] -= 1
    unigram[1 + frequent :] = mass
    layout, weights = fit(training, ranked, frequent, unigram)
    whole = np.log10(tokens + ADD * (types + 1))
    within = np.concatenate([np.zeros(1 + frequent), np.log10(mass + ADD * (kinds + 1))])
    # Plain arrays, lists and numbers only: what is broadcast is not pickled by value as functions are.
    # The logs are log10 of the counts: what the base and the shares of rare tokens add.
    sent = spark.sparkContext.broadcast((Tables.of(layout, weights), pa.array(ranked, pa.binary()), np.log10(np.array([local[t] for t in ranked], np.float64) + ADD), within))
    end_log = float(np.log10(unigram[0] + ADD))
    ended = unigram[0] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, ranked, heavy, within = sent.value
        numbers, heavy = Numbers(frequent, ranked), np.append(heavy, 0.0)
        for b in _parts(batches, 2):
            words, sizes = space_words_of(b.column(2))
            after = np.cumsum(sizes)
            at, ids = numbers(words)
            ended_ids = np.insert(ids, after, 0)
            scored = np.concatenate([[0.0], np.cumsum(Tables.log10(tables, ended_ids) - within[ended_ids])])
            stop = after + np.arange(1, len(after) + 1)
            neural = scored[stop] - scored[stop - sizes - 1]
            sums = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[after] - c[after - sizes]
            logs = heavy[at]
            base = end_log + sums(logs) - (sizes + 1) * whole
            rare = sums(np.where(ids > frequent, logs, 0.0))
            known = sums(at >= 0) + int(ended)
            # Tokens that ranked lacks, each once a text.
            missing = np.flatnonzero(at < 0)
            far = words.take(pa.array(missing)).dictionary_encode()
            kinds = max(1, len(far.dictionary))
            keys, times = np.unique(np.searchsorted(after, missing, "right") * kinds + far.indices.to_numpy(), return_counts=True)
            begin = pa.array(np.searchsorted(keys, np.arange(len(sizes) + 1) * kinds), pa.int32())
            lists = [pa.ListArray.from_arrays(begin, x) for x in (far.dictionary.take(pa.array(keys % kinds)), pa.array(times, pa.int64()))]
            cols = (sizes + 1, known, base, neural + rare)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), *lists],
                ["row", "doc_id", "n_tokens", "known", "base", "neural", "token", "times"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    near = materialize(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, neural double, token array<binary>, times array<long>"))
    far = near.select("row", F.explode(F.arrays_zip("token", "times")).alias("t")).select("row", "t.token", "t.times")
    others = counts.where(F.col("n") <= floor).select("token", "n") if floor else counts.limit(0).select("token", "n")
    met = far.join(others, "token", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("more")
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return near.drop("token", "times").join(met, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("neural") + logs).alias("score"),
    )


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = load_documents(spark, sf_dir)
    scored = score_documents(docs, docs.where(crc_mod("doc_id", 10) != 0))
    held = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_lm_score": op10_lm_score}
ORACLES: dict[str, str] = {}
