"""Brown class-based bigram scoring: exchange clustering, class transitions and word emissions.

A text is its words, lower-cased A-Z, and one end token. Counts are taken over all training texts:

* Vocabulary: every task counts its words by 64-bit hash; a partially aggregated group-by sums them.
* First classes: the ITEMS most frequent words are items of their own and all others are bundled by
  their last two bytes into BUNDLES items. Item bigrams (a fixed ITEMS + BUNDLES + 1 squared matrix,
  summed over all training texts by slices) feed exchange clustering on the driver: every item moves
  to the class that most raises the likelihood of the class bigrams, until a sweep moves none.
* Classes of all words: every other word of the full vocabulary moves from its bundle to its own best
  class, by its counts of first classes before and after it over all training texts (grouped by
  word in one shuffle) and the gain in likelihood to first order in these counts. One such sweep is made; a
  bundle's class remains for words that training texts don't have.
* Probabilities: P(word | history) = P(class | class before) P(word | class), counted with the final
  classes. Transitions are smoothed towards class frequencies with TRANSITION_PRIOR pseudo-counts;
  emissions add 1/2 to each word of a class and to one unknown word.
* Scoring: counts and classes of the most frequent words (at most HEAD) are broadcast; rarer words of
  a text go to the full class table by a join on the hash, in which no key is frequent, and their
  classes come back by text. Transitions are summed over the classes of whole texts.

The base score is the unigram model with 1/2 added to each word. Both scores are sums of log10
over all tokens of the whole text.

Defined cases: null and empty texts are the end token alone; repeated rows count as often as they
occur and each give a row; null ids are trained on as the empty string's hash says; without training
texts every token is unknown and N is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.bytes_text import binary_buffers, bounded_batches, mix64, slices, word_hashes
from corpuslens.llm.tables import documents
from corpuslens.plans.scratch import Scratch

ITEMS, BUNDLES, CLASSES = 1_024, 256, 48
HEAD = 1 << 18
TRANSITION_PRIOR = 50.0
_ALL = ITEMS + BUNDLES + 1
_END_ITEM = _ALL - 1
_END = mix64(np.array([0xE0F], np.uint64))[0]
_SLICES = 64
_COUNT_CHUNK, _CONTEXT_CHUNK = 4 << 20, 1 << 19
_END_CLASS, _CLASSES = CLASSES, CLASSES + 1
_CONTEXTS = 2 * _CLASSES


def training(id_column: str) -> Column:
    """True for texts that the model learns from; the others are held out."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 != 1


def bundle_of(tails: np.ndarray) -> np.ndarray:
    return (mix64(tails.astype(np.uint64)) % np.uint64(BUNDLES)).astype(np.int64)


@dataclass
class Tokens:
    hashes: np.ndarray
    bundles: np.ndarray
    offsets: np.ndarray


def tokens_of(column: pa.Array) -> Tokens:
    """Words and the end token of each text."""
    words = word_hashes(column, fold_case=True)
    n = len(column)
    offsets = words.offsets + np.arange(n + 1)
    hashes, bundles = np.full(offsets[-1], _END, np.uint64), np.full(offsets[-1], -1, np.int64)
    inside = np.ones(offsets[-1], bool)
    inside[offsets[1:] - 1] = False
    hashes[inside], bundles[inside] = words.hashes, bundle_of(words.tails)
    return Tokens(hashes, bundles, offsets)


# -- vocabulary ------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    for batch in (part for whole in batches for part in slices(whole)):
        held.append(tokens_of(batch.column("text")).hashes)
        size += len(held[-1])
        if size >= _COUNT_CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


class Head:
    """The most frequent words: sorted hashes with their counts and item numbers (beyond ITEMS: -1, then _ALL + class)."""

    def __init__(self, top: pd.DataFrame):
        hashes = top["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.counts = top["n"].to_numpy(np.int64)[order]
        item, rank = np.full(len(top), -1), 0
        for i, h in enumerate(hashes):
            if h == _END:
                item[i] = _END_ITEM
            elif rank < ITEMS:
                item[i] = rank
                rank += 1
        self.items = item[order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if it isn't here."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def item(self, tokens: Tokens, at: np.ndarray) -> np.ndarray:
        own = np.where(at >= 0, self.items[np.maximum(at, 0)] if len(self.items) else -1, -1)
        return np.where(own >= 0, own, np.where(tokens.bundles < 0, _END_ITEM, ITEMS + tokens.bundles))


# -- clustering ------------------------------------------------------------------------------


def _before(items: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Item before each token; the end token stands before a text."""
    previous = np.empty_like(items)
    previous[1:] = items[:-1]
    previous[offsets[:-1]] = _END_ITEM
    return previous


def _count_bigrams(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_ALL * _ALL, np.int64)
        for batch in (part for whole in batches for part in slices(whole)):
            if batch.num_rows:
                t = tokens_of(batch.column("text"))
                items = shared.value.item(t, shared.value.find(t.hashes))
                total += np.bincount(_before(items, t.offsets) * _ALL + items, minlength=len(total))
        at = np.flatnonzero(total)
        cuts = np.searchsorted(at, np.linspace(0, len(total), _SLICES + 1).astype(np.int64))
        rows = [(i, at[a:b].astype(np.int32).tobytes(), total[at[a:b]].tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["slice", "cell", "n"])

    return count


def _add_up(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_ALL * _ALL, np.int64)
    for batch in parts:
        for cell, n in zip(batch.column("cell").to_pylist(), batch.column("n").to_pylist(), strict=True):
            total[np.frombuffer(cell, np.int32)] += np.frombuffer(n, np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([total[at].tobytes()])], names=["cell", "n"])


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange_classes(bigrams: np.ndarray, n_classes: int = CLASSES) -> np.ndarray:
    """Class of each item (the last item, the end token, keeps the last class for itself).

    Starts from classes dealt in order of frequency; an item moves only for a real gain, to the
    lowest numbered of equally good classes, so the result depends on the counts alone. Gains are
    exact changes of the likelihood, and less than rounding can feign is none: every move raises the
    likelihood, no classes come back and the sweeps end.
    """
    m = bigrams.astype(np.float64)
    n = m.sum(0) + m.sum(1)
    order = [i for i in np.argsort(-n[:-1], kind="stable").tolist() if n[i] > 0]
    cls = np.zeros(len(m), np.int64)
    cls[order] = np.arange(len(order)) % n_classes
    cls[-1] = n_classes
    k = n_classes + 1
    one_hot = np.eye(k)[cls]
    g = one_hot.T @ m @ one_hot
    least = 1e-13 * float(_phi(m.sum()))  # over 400 roundings of the largest term
    moved = 1
    while moved:
        moved = 0
        for w in order:
            r = np.bincount(cls, weights=m[w], minlength=k)
            c = np.bincount(cls, weights=m[:, w], minlength=k)
            own, a = m[w, w], cls[w]
            r[a] -= own
            c[a] -= own
            g[a, :] -= r
            g[:, a] -= c
            g[a, a] -= own
            rows, cols = g.sum(1) + c, g.sum(0) + r  # the neighbours' own pairs with w stay theirs wherever it goes
            out_w, in_w = r.sum() + own, c.sum() + own
            base = _phi(g)
            across, down = _phi(g + r[None, :]) - base, _phi(g + c[:, None]) - base
            diagonal = np.diag(g)
            gain = across.sum(1) - np.diag(across) + down.sum(0) - np.diag(down) + _phi(diagonal + r + c + own) - _phi(diagonal)
            gain -= _phi(rows + out_w) - _phi(rows) + _phi(cols + in_w) - _phi(cols)
            best = int(np.argmax(gain[:n_classes]))
            if best != a and gain[best] <= gain[a] + least:
                best = int(a)
            moved += best != a
            cls[w] = best
            g[best, :] += r
            g[:, best] += c
            g[best, best] += own
    return cls


# -- classes of all words --------------------------------------------------------------------


def smoothed_transitions(pairs: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """P(class | class before), smoothed towards class frequencies."""
    alone = (tokens + 0.5) / (tokens.sum() + 0.5 * len(tokens))
    return (pairs + TRANSITION_PRIOR * alone[None, :]) / (pairs.sum(1)[:, None] + TRANSITION_PRIOR)


def context_gains(pairs: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """What one neighbour adds to a word's gain in each class: rows are classes before, then classes after.

    The likelihood of the class bigrams to first order in the word's count.
    """
    log_transition = np.log(smoothed_transitions(pairs, tokens))
    alone = (tokens + 0.5) / (tokens.sum() + 0.5 * len(tokens))
    return np.vstack([log_transition - np.log(alone)[None, :], log_transition.T])[:, :CLASSES]


def _count_contexts(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per chunk and word that is no item: counts of classes before and after, each packed with its class."""
        head, classes = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            hashes, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
            words, word = np.unique(hashes, return_inverse=True)
            cell, n = np.unique(np.concatenate([word * _CONTEXTS + left, word * _CONTEXTS + _CLASSES + right]), return_counts=True)
            packed = n.astype(np.int64) * _CONTEXTS + cell % _CONTEXTS
            bounds = np.searchsorted(cell, np.arange(len(words) + 1) * _CONTEXTS).astype(np.int32) * 8
            contexts = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), contexts], names=["h", "contexts"])

        for batch in (part for whole in batches for part in slices(whole)):
            if not batch.num_rows:
                continue
            t = tokens_of(batch.column("text"))
            items = head.item(t, head.find(t.hashes))
            cls = classes[items]
            at = np.flatnonzero((items >= ITEMS) & (items != _END_ITEM))
            held.append((t.hashes[at], classes[_before(items, t.offsets)[at]], cls[at + 1]))
            size += len(at)
            if size >= _CONTEXT_CHUNK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return count


def _assign(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count and best class of every word; rows come in the order of h."""
        gains, closed = shared.value

        def best(h: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
            first = np.concatenate([[True], h[1:] != h[:-1]])
            cell = (np.cumsum(first) - 1) * _CONTEXTS + packed % _CONTEXTS
            counts = np.bincount(cell, weights=packed // _CONTEXTS, minlength=int(first.sum()) * _CONTEXTS).reshape(-1, _CONTEXTS)
            cls = (counts @ gains + closed).argmax(1)
            return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(counts[:, :_CLASSES].sum(1).astype(np.int64)), pa.array(cls.astype(np.int32))], names=["h", "n", "cls"])

        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            raw, offsets = binary_buffers(batch.column("contexts"))
            h = np.concatenate([rest[0], np.repeat(batch.column("h").to_numpy(), np.diff(offsets) // 8)])
            packed = np.concatenate([rest[1], np.frombuffer(raw.tobytes(), np.int64)])
            if len(h):
                whole = int(np.searchsorted(h, h[-1]))  # the last word may go on in the next batch
                rest = (h[whole:], packed[whole:])
                if whole:
                    yield best(h[:whole], packed[:whole])
        if len(rest[0]):
            yield best(*rest)

    return assign


@dataclass
class Classes:
    head: Head
    numbers: np.ndarray  # class of each item, then of each number from _ALL on: the classes themselves
    assigned: DataFrame  # h, n, cls of every word that is no item
    threshold: int  # words with this count or more are in the head
    tokens: np.ndarray  # of each class
    words: np.ndarray  # of each class
    n_total: int
    v_total: int


def _head_threshold(vocabulary: DataFrame) -> int:
    """Least count that at most HEAD words reach, to seven significant bits: a histogram instead of a global sort."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin("n")) - 7, F.lit(0)))
    bins = vocabulary.groupBy((F.floor(F.col("n") / step).cast("long") * step).alias("least")).count().collect()  # at most 64 rows an octave
    total, threshold = 0, 1 << 62
    for r in sorted(bins, key=lambda r: -r["least"]):
        total += r["count"]
        if total > HEAD:
            break
        threshold = r["least"]
    return threshold


def fit_classes(texts: DataFrame, scratch: Scratch) -> Classes:
    """A class for every word of all texts given."""
    spark = texts.sparkSession
    vocabulary = texts.select("text").mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    vocabulary = scratch.save(vocabulary, "vocabulary")
    threshold = _head_threshold(vocabulary)
    top = vocabulary.filter(F.col("n") >= threshold).toArrow().to_pandas().sort_values(["n", "h"], ascending=[False, True], ignore_index=True)
    head = Head(top)
    shared = spark.sparkContext.broadcast(head)
    slices_ = texts.select("text").mapInArrow(_count_bigrams(shared), "slice int, cell binary, n binary").groupBy("slice").applyInArrow(_add_up, "cell binary, n binary").collect()
    bigrams = np.zeros(_ALL * _ALL, np.int64)
    for r in slices_:
        bigrams[np.frombuffer(r["cell"], np.int32)] = np.frombuffer(r["n"], np.int64)
    bigrams = bigrams.reshape(_ALL, _ALL)
    classes = exchange_classes(bigrams)
    one_hot = np.eye(_CLASSES)[classes]
    item_tokens = bigrams.sum(0).astype(np.float64)
    started = np.bincount(classes, weights=item_tokens, minlength=_CLASSES)
    gains = spark.sparkContext.broadcast((context_gains(one_hot.T @ bigrams @ one_hot, started), np.where(started[:CLASSES] > 0, 0.0, -np.inf)))
    first = spark.sparkContext.broadcast((head, classes))
    contexts = texts.select("text").mapInArrow(_count_contexts(first), "h long, contexts binary")
    assigned = scratch.save(contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_assign(gains), "h long, n long, cls int"), "assigned")
    found = assigned.filter(F.col("n") >= threshold).select("h", "cls").toArrow()  # at most HEAD rows
    at = head.find(found.column("h").to_numpy().view(np.uint64))
    head.items[at] = _ALL + found.column("cls").to_numpy()
    is_item = (head.items >= 0) & (head.items < ITEMS)
    own = np.append(classes[head.items[is_item]], _END_CLASS)
    counts = np.append(head.counts[is_item], item_tokens[_END_ITEM])
    tokens, words = np.bincount(own, weights=counts, minlength=_CLASSES), np.bincount(own, minlength=_CLASSES).astype(np.float64)
    words[_END_CLASS] = (head.items == _END_ITEM).sum()
    for r in assigned.groupBy("cls").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect():  # at most CLASSES rows
        tokens[r["cls"]] += r["n"]
        words[r["cls"]] += r["v"]
    return Classes(head, np.append(classes, np.arange(_CLASSES)), assigned, threshold, tokens, words, int(tokens.sum()), int(words.sum()))


# -- class sequences -------------------------------------------------------------------------


def _sequence(shared):
    def sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text (h null) with what is known here, and a row (rid, h, m = place) for each word beyond the head."""
        head, numbers = shared.value
        rid = TaskContext.get().partitionId() << 40
        log_count = np.log10(head.counts + 0.5)
        for batch in (part for whole in batches for part in slices(whole)):
            n = batch.num_rows
            if not n:
                continue
            t = tokens_of(batch.column("text"))
            at = head.find(t.hashes)
            cls = numbers[head.item(t, at)].astype(np.uint8)
            known = at >= 0
            seen = np.where(known, log_count[np.maximum(at, 0)] if len(log_count) else 0.0, np.log10(0.5))
            sums = lambda x: np.add.reduceat(x, t.offsets[:-1])
            sizes = np.diff(t.offsets)
            ids = rid + np.arange(n)
            rid += n
            classes = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(t.offsets.astype(np.int32)), pa.py_buffer(cls)])
            yield _rows(ids, batch.column("doc_id"), batch.column("held_out"), None, sizes, sums(known.astype(np.int64)), sums(seen), classes)
            rare = np.flatnonzero(~known)
            if len(rare):
                owner = np.repeat(np.arange(n), sizes)[rare]
                yield _rows(ids[owner], None, None, t.hashes[rare].view(np.int64), rare - t.offsets[owner], None, None, None)

    return sequence


_SEQUENCE = "rid long, doc_id long, held_out boolean, h long, m long, known long, seen double, classes binary"


def _rows(rid, doc_id, held_out, h, m, known, seen, classes) -> pa.RecordBatch:
    n = len(rid)
    made = [(rid, pa.int64()), (doc_id, pa.int64()), (held_out, pa.bool_()), (h, pa.int64()), (m, pa.int64()), (known, pa.int64()), (seen, pa.float64()), (classes, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.nulls(n, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in made], names=[c.split(" ")[0] for c in _SEQUENCE.split(", ")])


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the classes of words beyond the head into the texts' classes.

    Rows come in the order of rid, each text before its words (m = place, known = class).
    """

    def texts(doc_id, held_out, m, known, seen, cls, offsets) -> pa.RecordBatch:
        classes = pa.BinaryArray.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(cls[offsets[0] : offsets[-1]].copy())])
        return pa.RecordBatch.from_arrays([doc_id, held_out, *(pa.array(x) for x in (m, known, seen)), classes], names=[c.split(" ")[0] for c in _FILLED.split(", ")])

    last: pa.RecordBatch | None = None  # its words may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        is_text = batch.column("classes").is_valid()
        whole = batch.filter(is_text).select(["doc_id", "held_out", "m", "known", "seen", "classes"])
        words = batch.filter(pa.compute.invert(is_text))
        at = np.cumsum(is_text.to_numpy(zero_copy_only=False))[~is_text.to_numpy(zero_copy_only=False)] - 1
        if last is not None:
            whole, at = pa.concat_batches([last, whole]), at + 1
        n = whole.num_rows
        raw, offsets = binary_buffers(whole.column("classes"))
        cls = raw.copy()
        cls[offsets[at] + words.column("m").to_numpy()] = words.column("known").to_numpy()
        known = whole.column("known").to_numpy() + np.bincount(at, minlength=n)
        seen = whole.column("seen").to_numpy() + np.bincount(at, weights=words.column("seen").to_numpy(), minlength=n)
        done = texts(whole.column("doc_id"), whole.column("held_out"), whole.column("m").to_numpy(), known, seen, cls, offsets)
        if n > 1:
            yield done.slice(0, n - 1)
        last = done.slice(n - 1)
    if last is not None:
        yield last


_FILLED = "doc_id long, held_out boolean, m long, known long, seen double, classes binary"


def class_sequences(rows: DataFrame, fitted: Classes, scratch: Scratch) -> DataFrame:
    """(doc_id, held_out, m tokens, known of them, sum of log10(count + 1/2), class of each token) for every row."""
    shared = rows.sparkSession.sparkContext.broadcast((fitted.head, fitted.numbers))
    made = scratch.save(rows.mapInArrow(_sequence(shared), _SEQUENCE), "sequences")
    beyond = fitted.assigned.filter(F.col("n") < fitted.threshold).select(F.col("h").alias("k"), "n", "cls")
    rare = made.filter("h IS NOT NULL").select("rid", "h", "m").join(beyond, F.col("h") == F.col("k"))
    rare = rare.select("rid", "m", F.col("cls").cast("long").alias("known"), (F.log10(F.col("n") + F.lit(0.5)) - F.log10(F.lit(0.5))).alias("seen"))
    both = made.filter("h IS NULL").drop("h").unionByName(rare, allowMissingColumns=True)
    return scratch.save(both.repartition("rid").sortWithinPartitions("rid", F.col("classes").isNull()).mapInArrow(_fill, _FILLED), "filled")


# -- model -----------------------------------------------------------------------------------


@dataclass
class ClassModel:
    head: Head
    classes: np.ndarray  # of items
    log_transition: np.ndarray  # [class before, class]
    log_emission_total: np.ndarray  # of classes: log10(tokens + (words + 1) / 2)
    log_base_total: float


def _class_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, offsets) of all tokens; the end token stands before a text."""
    raw, offsets = binary_buffers(column)
    cls = raw.astype(np.int64)
    previous = np.empty_like(cls)
    previous[1:] = cls[:-1]
    previous[offsets[:-1]] = _END_CLASS
    return previous, cls, offsets


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CLASSES * _CLASSES, np.int64)
    for batch in (part for whole in batches for part in slices(whole, "classes")):
        previous, cls, _ = _class_pairs(batch.column("classes"))
        total += np.bincount(previous * _CLASSES + cls, minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])


def fit_model(fitted: Classes, sequences: DataFrame) -> ClassModel:
    """Transitions and emissions of the final classes; sequences: those of the training texts."""
    pairs = np.zeros(_CLASSES * _CLASSES)
    for r in sequences.select("classes").mapInArrow(_count_pairs, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most 49 squared
        pairs[r["cell"]] = r["n"]
    transition = smoothed_transitions(pairs.reshape(_CLASSES, _CLASSES), fitted.tokens)
    return ClassModel(fitted.head, fitted.numbers, np.log10(transition), np.log10(fitted.tokens + 0.5 * (fitted.words + 1)), float(np.log10(fitted.n_total + 0.5 * (fitted.v_total + 1))))


def train(texts: DataFrame, scratch: Scratch) -> tuple[ClassModel, DataFrame, int]:
    """Model, class table (h, n, cls) of the words that are no items, and N, from all texts given."""
    fitted = fit_classes(texts, scratch)
    rows = texts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out"))
    return fit_model(fitted, class_sequences(rows, fitted, scratch)), fitted.assigned, fitted.n_total


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ClassModel = shared.value
        for batch in (part for whole in batches for part in slices(whole, "classes")):
            previous, cls, offsets = _class_pairs(batch.column("classes"))
            local = np.add.reduceat(model.log_transition[previous, cls] - model.log_emission_total[cls], offsets[:-1])
            m, seen = batch.column("m").to_numpy(), batch.column("seen").to_numpy()
            made = [pa.array(seen - m * model.log_base_total), pa.array(seen + local)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "m", "known")), *made], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "class-lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~training("doc_id")).alias("held_out"))
    with bounded_batches(spark):
        fitted = fit_classes(rows.filter(~F.col("held_out")), scratch)
        sequences = class_sequences(rows, fitted, scratch)
        model = fit_model(fitted, sequences.filter(~F.col("held_out")))
        shared = spark.sparkContext.broadcast(ClassModel(None, None, model.log_transition, model.log_emission_total, model.log_base_total))
        scored = sequences.mapInArrow(_score(shared), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        scored = scratch.save(scored, "scored")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(fitted.n_total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_class_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
