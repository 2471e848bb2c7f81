"""Document scores of a gated recurrent language model, beside a unigram base.

All training words are counted; the most frequent ones are the model's words. Texts are
then split once into word numbers, and training and scoring read those. Training
documents are dealt to shards by a hash of the document, each shard trains the model in
one order from one start, and the models are averaged by their tokens, in several rounds
if asked for: the result doesn't depend on how the input is partitioned, and the number
of shards grows with the tokens. Scoring carries the state over the whole document.
Words beyond the model's are told apart by a tree whose vectors come from the states before
their training tokens: all words of the training texts, however rare, are scored through
the network. The states before a bounded table of frequent words are added up while
training; rare words are dealt to buckets with the states before them, and each bucket
has a tree of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.arrow import batch, map_batches
from riskweave.llm.gru import HIDDEN, INPUTS, Adagrad, Model, WordTree, add_rows, initial, word_classes
from riskweave.llm.word_ids import byte_slices
from riskweave.session import observed_table, written_table

#: Words with outputs of their own in the network at most, the end of a document among them.
MODEL_WORDS = 1023
#: Words at most whose counts and vectors are sent to every task; all others are dealt to buckets.
FREQUENT = 150_000
#: Training tokens of a shard, about, and rounds of training and averaging.
SHARD_TOKENS = 6_000_000
ROUNDS = 1
#: Documents, and their tokens, that a task runs through the model together.
DOCS_AT_ONCE = 6000
TOKENS_AT_ONCE = 3_000_000
#: Tokens of rare words in a bucket and in a task, about.
BUCKET_TOKENS = 25_000
TASK_TOKENS = 200_000
#: Steps of the histogram of counts, to each doubling.
STEPS = 16

# White space becomes a space; A-Z become lower case.
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[9:14] = 32
_SPACED[65:91] += 32


def words_of(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return text.translate(_SPACED.tobytes()).split() if text else []


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of some binary texts, the word at each place, and each text's end."""
    texts = texts.fill_null(b"")
    if not len(texts):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    spaced = pa.Array.from_buffers(
        pa.binary(), len(texts),
        [None, pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(_SPACED[raw])],
    )
    split = pc.split_pattern(spaced, b" ")
    edges = split.offsets.to_numpy().astype(np.int64)
    edges -= edges[0]
    words = split.flatten().dictionary_encode()
    index = words.indices.to_numpy()
    full = (pc.binary_length(words.dictionary).to_numpy() > 0)[index]
    ends = np.concatenate([[0], np.cumsum(full)])[edges[1:]]
    return words.dictionary, index[full], ends


def _with_bytes(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("binary").alias("_text"),
    )


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over the texts of ``docs``; the end of a document is the empty word."""

    def make(arrow):
        def run(batches):
            for b in byte_slices(batches, "_text"):
                words, index, ends = split_words(b.column("_text"))
                counts = np.bincount(index, minlength=len(words))
                met = np.flatnonzero(counts)
                words = pa.concat_arrays([words.take(pa.array(met)), pa.array([b""], pa.binary())])
                yield batch(arrow, {"word": words, "n": np.append(counts[met], len(ends))})

        return run

    counted = map_batches(docs.select("_text"), "word binary, n long", make)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words of the highest counts, by falling count; at most ``most``, of a count all or none.

    A histogram of the counts says where to cut, so that no more than ``most`` rows leave
    the tasks.
    """
    step = F.floor(F.log2("n") * STEPS)
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, held = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):  # a few hundred rows at most
        held += r["words"]
        if held > most:
            break
        least = r["step"]
    if least is None:
        return []
    rows = counts.filter(step >= least).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """Numbers of the frequent words; the model knows the first ``model_words`` of them."""

    def __init__(self, words: list[bytes], counts: list[int], model_words: int):
        self.words = pa.array(words, pa.binary())
        self.counts = np.array(counts, dtype=float)
        self.model_words = min(model_words, len(words))
        self.end = words.index(b"")

    @classmethod
    def of(cls, found: list[tuple[bytes, int]], model_words: int, docs: int) -> Vocabulary:
        """The end of a document is always a word of the model."""
        ranked = [x for x in found if x[0] != b""]
        at = sum(n > docs for _, n in ranked)
        ranked.insert(min(at, model_words - 1), (b"", docs))
        return cls([w for w, _ in ranked], [n for _, n in ranked], model_words)


def numbered(given: DataFrame, vocabulary: Vocabulary, total: int, distinct: int) -> DataFrame:
    """Sums over the frequent words of every text, the numbers of all its words, its rare words.

    A frequent word's number is its rank; rare words get higher ones by a hash, and are
    themselves kept in the order of the text.
    """
    floor = math.log10(total + distinct + 1)
    # The last entry is for number -1, a word that isn't frequent.
    logs = np.append(np.log10(vocabulary.counts + 1), 0.0)
    seen = np.append(vocabulary.counts > 0, False)
    frequent = len(vocabulary.counts)

    def make(arrow):
        def run(batches):
            for b in byte_slices(batches, "_text"):
                words, index, ends = split_words(b.column("_text"))
                found = pc.index_in(words, value_set=vocabulary.words).fill_null(-1).to_numpy()
                lost = np.flatnonzero(found[index] < 0)
                met = np.unique(index[lost])
                hashed = found.astype(np.int64)
                hashed[met] = [frequent + zlib.crc32(w) % INPUTS for w in words.take(pa.array(met)).to_pylist()]
                number = np.insert(found[index].astype(np.int64), ends, vocabulary.end)
                code = np.insert(hashed[index], ends, vocabulary.end)
                lengths = np.diff(ends, prepend=0) + 1
                owner = np.repeat(np.arange(len(lengths)), lengths)
                total_of = lambda values: np.bincount(owner, values, len(lengths))
                offsets = np.searchsorted(lost, np.append(0, ends))
                cuts = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                yield batch(
                    arrow,
                    {
                        "doc_id": b.column("doc_id"),
                        "held_out": b.column("held_out"),
                        "n_tokens": lengths,
                        "n_known": total_of(seen[number]).astype(np.int64),
                        "base": total_of(logs[number] - floor),
                        "targets": pa.ListArray.from_arrays(cuts, pa.array(code, pa.int32())),
                        "n_rare": np.diff(offsets),
                        "rare": pa.ListArray.from_arrays(
                            pa.array(offsets, pa.int32()), words.take(pa.array(index[lost]))
                        ),
                        "text_hash": b.column("text_hash"),
                    },
                )

        return run

    kind = given.schema["doc_id"].dataType.simpleString()
    return map_batches(
        given.withColumn("text_hash", F.xxhash64("_text")),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, "
        "targets array<int>, n_rare long, rare array<binary>, text_hash long",
        make,
    )


def _groups(batches):
    """Few documents at a time, cut by documents and tokens and not by how batches lie."""
    held, size = [], 0
    for b in batches:
        lists = b.column("targets")
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        at = at - at[0]
        extra = b.column("shard").to_pylist() if "shard" in b.schema.names else [0] * b.num_rows
        for i, shard in enumerate(extra):
            doc = flat[at[i] : at[i + 1]]
            full = len(held) >= DOCS_AT_ONCE or size + len(doc) > TOKENS_AT_ONCE
            if held and (full or held[-1][0] != shard):
                yield held
                held, size = [], 0
            held.append((shard, doc, b, i))
            size += len(doc)
    if held:
        yield held


def fit_model(training: DataFrame, vocabulary: Vocabulary, total: int) -> Model:
    """A model with the parameters' means over the shards' models, and the tree of the
    frequent words beyond the model's.

    ``training`` has doc_id, text_hash and targets.
    """
    known, frequent = vocabulary.model_words, len(vocabulary.counts)
    counts, others = vocabulary.counts[:known], vocabulary.counts[known:]
    edges = word_classes(counts)
    rest = (others.sum(), max(total - counts.sum() - others.sum(), 0))
    params = initial(counts, rest, edges)
    names = sorted(params)
    shapes = [params[k].shape for k in names]
    sizes = np.cumsum([int(np.prod(s)) for s in shapes])
    shards = max(1, round(total / SHARD_TOKENS))
    shard = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(shards)).cast("int")
    dealt = training.select(shard.alias("shard"), "doc_id", "text_hash", "targets")
    order = ["shard", "doc_id", "text_hash"]
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions(*order).select("shard", "targets")
    lines = -(-int(sizes[-1]) // HIDDEN)  # of parameters; sums of states follow
    sums = np.zeros((frequent - known + HIDDEN, HIDDEN))
    for _ in range(ROUNDS):
        found = _trained(dealt, params, edges, names, frequent)
        # Written once: a lost executor must not lead to a second, different training.
        rows = written_table(found, "lm").toArrow()  # a row for a few parameters or a word of the table
        at = rows.column("at").to_numpy()
        if not len(at):
            break
        values = np.stack([rows.column(f"c{k}").to_numpy() for k in range(HIDDEN)], axis=1)
        flat = np.empty((lines, HIDDEN))
        flat[at[at < lines]] = values[at < lines] / rows.column("weight").to_numpy()[at < lines, None]
        parts = np.split(flat.ravel()[: sizes[-1]], sizes[:-1])
        params = {k: p.reshape(s) for k, p, s in zip(names, parts, shapes, strict=True)}
        sums[:] = 0.0
        sums[at[at >= lines] - lines] = values[at >= lines]
    unigram = (others + 1) / max((others + 1).sum(), 1)
    tree = WordTree(unigram, others, sums[:-HIDDEN], sums[-HIDDEN:], depth=3)
    return Model(params, edges, frequent, tree)


def _trained(dealt: DataFrame, params: dict, edges: np.ndarray, names: list[str], frequent: int) -> DataFrame:
    """Sums of the parameters of all shards' models, times their tokens, a few to a row; then
    each frequent word beyond the model's the sums of the states before its tokens, and at
    last the sums of these states' products."""

    def make(arrow):
        def run(batches):
            summed, tokens = None, 0
            sums = np.zeros((frequent - int(edges[-1]) + HIDDEN, HIDDEN), np.float32)

            def close(model, seen):
                nonlocal summed, tokens
                flat = np.concatenate([model.p[k].ravel() for k in names]).astype(float) * seen
                summed = flat if summed is None else summed + flat
                tokens += seen

            shard, model, seen = None, None, 0
            for group in _groups(batches):
                if model is None or group[0][0] != shard:
                    if model is not None:
                        close(model, seen)
                    shard, model, seen = group[0][0], Model(params, edges, frequent), 0
                    learn = Adagrad(model)
                docs = [d for _, d, *_ in group]
                model.run(docs, learn, sums)
                seen += sum(map(len, docs))
            if model is not None:
                close(model, seen)
                lines = np.append(summed, np.zeros(-len(summed) % HIDDEN)).reshape(-1, HIDDEN)
                met = np.flatnonzero(sums.any(axis=1))
                values = np.concatenate([lines, sums[met]])
                columns = {f"c{k}": values[:, k] for k in range(HIDDEN)}
                columns["at"] = np.append(np.arange(len(lines)), len(lines) + met)
                columns["weight"] = np.append(np.full(len(lines), float(tokens)), np.zeros(len(met)))
                yield batch(arrow, columns)

        return run

    columns = ["weight", *[f"c{k}" for k in range(HIDDEN)]]
    models = map_batches(dealt, "at int, " + ", ".join(f"{c} double" for c in columns), make)
    return models.groupBy("at").agg(*[F.sum(c).alias(c) for c in columns])


def _doc_scores(found: DataFrame, model: Model) -> DataFrame:
    """A row for each text, its score without the rare words' within their class, and a row
    for each of these words with the state before it."""

    def make(arrow):
        def run(batches):
            for group in _groups(batches):
                scores, states = model.run([d for _, d, *_ in group])
                rows = np.array([b.column("_row")[i].as_py() for *_, b, i in group], dtype=np.int64)
                held = np.array([b.column("held_out")[i].as_py() for *_, b, i in group], dtype=bool)
                none = pa.nulls(len(rows), pa.binary())
                columns = {"_row": rows, "held_out": held, "word": none, "state": none}
                yield batch(arrow, columns | {"model": scores / math.log(10)})
                words = [b.column("rare")[i].values for *_, b, i in group]
                lengths = [len(w) for w in words]
                words = pa.concat_arrays([w.cast(pa.binary()) for w in words])
                rows, held = np.repeat(rows, lengths), np.repeat(held, lengths)
                step = 10_000
                for at in range(0, len(rows), step):
                    cut = slice(at, at + step)
                    yield batch(
                        arrow,
                        {
                            "_row": rows[cut],
                            "held_out": held[cut],
                            "word": words[cut],
                            "state": _as_binary(states[cut]),
                            "model": np.zeros(len(rows[cut])),
                        },
                    )

        return run

    kept = found.select("_row", "held_out", "targets", "rare")
    return map_batches(kept, "_row long, held_out boolean, word binary, state binary, model double", make)


def _as_binary(states: np.ndarray) -> pa.Array:
    offsets = np.arange(len(states) + 1, dtype=np.int32) * (HIDDEN * 2)
    data = pa.py_buffer(np.ascontiguousarray(states))
    return pa.Array.from_buffers(pa.binary(), len(states), [None, pa.py_buffer(offsets), data])


def _from_binary(states: pa.Array) -> np.ndarray:
    _, offsets, data = states.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[states.offset : states.offset + len(states) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(np.float16).reshape(-1, HIDDEN)


class _Bucket:
    """Rare words of one bucket: training tokens first, then scores of any of them."""

    def __init__(self, floor: float):
        self.floor = floor
        self.held: list[tuple] = []
        self.tree = None

    def add(self, rows: np.ndarray, words: pa.Array, states: np.ndarray) -> None:
        self.held.append((rows, words, states))

    def close(self) -> Iterator[dict]:
        """The tree of the training tokens, and these tokens' scores."""
        if self.tree is not None:
            return
        held, self.held = self.held, []
        met = pa.concat_arrays([pa.array([], pa.binary()), *[w for _, w, _ in held]]).unique()
        self.words = met.take(pc.array_sort_indices(met))  # a tree of them must not depend on how rows lie
        self.counts = np.zeros(len(self.words))
        sums, second = np.zeros((len(self.words), HIDDEN)), np.zeros((HIDDEN, HIDDEN))
        for _, words, states in held:
            index = pc.index_in(words, value_set=self.words).to_numpy()
            states = states.astype(float)
            self.counts += np.bincount(index, minlength=len(self.words))
            add_rows(sums, index, states)
            second += states.T @ states
        self.tree = WordTree((self.counts + 1) / self.floor, self.counts, sums, second, depth=2)
        if held:
            rows, words, states = zip(*held, strict=True)
            yield self.scores(np.concatenate(rows), pa.concat_arrays(words), np.concatenate(states))

    def scores(self, rows: np.ndarray, words: pa.Array, states: np.ndarray) -> dict:
        index = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        seen = np.flatnonzero(index >= 0)
        found = index[seen]
        model = np.full(len(rows), -math.log10(self.floor))  # of a word that training never met
        model[seen] = self.tree.log_probabilities(found, states[seen].astype(np.float32)) / math.log(10)
        gain = np.zeros(len(rows))
        gain[seen] = np.log10(self.counts[found] + 1)
        return {"_row": rows, "model": model, "gain": gain, "more": (index >= 0).astype(np.int64)}


def _rare_scores(dealt: DataFrame, floor: float) -> DataFrame:
    """Scores of rare words within their class, by text; ``dealt`` lies by bucket, training first.

    A bucket's words are as probable together as their counts make them; words that
    training never met are one more, so that all of them sum to 1.
    """

    def make(arrow):
        def run(batches):
            out = lambda columns: batch(arrow, columns)
            bucket, at = _Bucket(floor), None
            for b in batches:
                texts = b.filter(b.column("word").is_null())
                zeros = np.zeros(texts.num_rows)
                columns = {"_row": texts.column("_row"), "model": texts.column("model"), "gain": zeros}
                yield out(columns | {"more": zeros.astype(np.int64)})
                b = b.filter(b.column("word").is_valid())
                if not b.num_rows:
                    continue
                numbers, held = b.column("bucket").to_numpy(), b.column("held_out").to_numpy(zero_copy_only=False)
                rows = b.column("_row").to_numpy()
                states = _from_binary(b.column("state"))
                change = (numbers[1:] != numbers[:-1]) | (held[1:] != held[:-1])
                cuts = [0, *(np.flatnonzero(change) + 1), len(numbers)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if numbers[lo] != at:
                        yield from map(out, bucket.close())
                        bucket, at = _Bucket(floor), numbers[lo]
                    piece = rows[lo:hi], b.column("word")[lo:hi], states[lo:hi]
                    if not held[lo]:
                        bucket.add(*piece)
                        continue
                    yield from map(out, bucket.close())
                    yield out(bucket.scores(*piece))
            yield from map(out, bucket.close())

        return run

    return map_batches(dealt, "_row long, model double, gain double, more long", make)


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``held_out`` is a condition on doc_id; rows where it isn't true are learnt from, all of
    them and whole. Scores are base-10 log probabilities of all words and the end. NULL and
    empty texts are the end alone, and texts are split by bytes, valid UTF-8 or not. Repeated
    rows are scored each; a NULL condition counts as false. Without training rows all counts
    are 0 and the model is even over its classes. An empty table gives no rows.
    """
    given = _with_bytes(docs, held_out)
    counts = written_table(count_words(given.filter(~F.col("held_out"))), "counts")
    ends = F.sum(F.when(F.col("word") == F.lit(b""), F.col("n")))
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), ends.alias("docs")).first()
    total, distinct = int(sums["n"] or 0), int(sums["v"])
    vocabulary = Vocabulary.of(frequent_words(counts, FREQUENT), MODEL_WORDS, int(sums["docs"] or 0))
    frequent = len(vocabulary.counts)
    found = numbered(given, vocabulary, total, distinct).withColumn("_row", F.monotonically_increasing_id())
    found, seen = observed_table(found, "numbered", {"rare": F.sum("n_rare")})
    training = found.filter(~F.col("held_out")).select("doc_id", "text_hash", "targets")
    model = fit_model(training, vocabulary, total)

    rare = int(seen["rare"] or 0)
    buckets, tasks = -(-rare // BUCKET_TOKENS) or 1, -(-rare // TASK_TOKENS) or 1
    key = F.when(F.col("word").isNull(), F.col("_row")).otherwise(F.xxhash64("word"))
    scores = _doc_scores(found, model)
    dealt = scores.withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("int")).repartition(tasks, "bucket")
    # Rare words: their counts, each one more, and one for all unseen words.
    floor = max(total - int(vocabulary.counts.sum()), 0) + max(distinct - frequent, 0) + 1
    parts = _rare_scores(dealt.sortWithinPartitions("bucket", "held_out"), floor)
    more = parts.groupBy("_row").agg(F.sum("model").alias("model"), F.sum("gain").alias("gain"), F.sum("more").alias("more"))
    plain = found.select("_row", "doc_id", "held_out", "n_tokens", "n_known", "base")
    return plain.join(more, "_row").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("more")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("gain")).alias("base_score"),
        F.col("model").alias("score"),
    )
