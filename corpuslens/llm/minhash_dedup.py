"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles: weight = count in the text times
1 + log10((1 + N) / (1 + df)), where N counts the distinct texts and df those that hold the shingle, both exactly.

* Document frequencies: texts are dealt into chunks of about CHUNK_BYTES. Each chunk counts its texts by shingle, so that a
  shingle that every text has is one number a chunk, and sends the counts, as sorted arrays, to hash ranges. A range
  adds them up and answers each chunk with the shingles that two texts or more have; all others have a frequency of 1.
* Signatures: for each of BANDS * ROWS hash functions, improved consistent weighted sampling draws
  r, c ~ Gamma(2, 1) and beta ~ U(0, 1) from the shingle's hash; t = floor(ln w / r + beta),
  ln a = ln c - r (t - beta + 1). The least ln a is the sample; two documents share it with a
  probability that is their weighted Jaccard similarity. Its bits are the signature.
* Bands of ROWS signatures give buckets. Each member is compared with its bucket's first text (the hub),
  by weighted Jaccard over the whole texts; pairs at THRESHOLD or more are links. A hub's members are dealt into blocks
  of about BLOCK, each with one copy of the hub's text, so that no task holds all members of a hub.
* Exact way for the rest: members of one bucket that are still in different components are compared
  with each other too, in blocks and by matrix products, so no link between band partners is lost,
  while a group of thousands of copies needs one comparison a member.
* Classes are the connected components, named by their smallest doc_id.

Equal texts are collapsed first. Tables of places or ids that a later step needs are broadcast if they have at most
MAX_BROADCAST_IDS rows and joined by a shuffle beyond; results are the same.

Defined cases: null texts and texts without a word are like nothing, each its own class (equal
empty texts included), and so are rows with a null id; a text of under five words is one shingle; an id that occurs with
several texts is one document, which links whatever is like any of them; repeated rows count once and each give a row; an
empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.bytes_text import binary_buffers, bounded_batches, mix64, shingle_hashes, slices, word_hashes
from corpuslens.llm.components import connected_components
from corpuslens.llm.tables import SPACE_CHARS, documents
from corpuslens.plans.scratch import Scratch

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
BLOCK, COLUMNS = 512, 4_096
#: Shingles that a block is planned for; blocks of long texts have fewer members.
BLOCK_SHINGLES = 1 << 19
CHUNK_BYTES = 2 << 20
#: Shingles that a hash range of the frequency count is planned for.
RANGE_SHINGLES = 1 << 20
MAX_BROADCAST_IDS = 2_000_000
_CHUNK = 1 << 15


# -- weighted sets ---------------------------------------------------------------------------


def weighted_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes, their counts, offsets per text), sorted inside each text."""
    shingles = shingle_hashes(word_hashes(column), SHINGLE_WORDS)
    hashes, counts, sizes = [], [], np.zeros(len(column), np.int64)
    for i, (a, b) in enumerate(zip(shingles.offsets[:-1], shingles.offsets[1:], strict=True)):
        if a == b:
            continue
        s = np.sort(shingles.hashes[a:b])
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        hashes.append(s[first])
        counts.append(np.diff(np.append(first, len(s))))
        sizes[i] = len(first)
    empty = np.zeros(0, np.uint64)
    return np.concatenate(hashes or [empty]), np.concatenate(counts or [empty.astype(np.int64)]), np.concatenate([[0], np.cumsum(sizes)])


def inverse_document_frequency(df: np.ndarray, n: int) -> np.ndarray:
    return 1 + np.log10((1 + n) / (1 + df))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum of minima over sum of maxima of two sorted weighted sets."""
    (x, xw), (y, yw) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = y[at] == x
    least = np.minimum(xw[both], yw[at[both]]).sum()
    total = xw.sum() + yw.sum() - least
    return float(least / total) if total > 0 else 0.0


def jaccard_matrix(hashes: np.ndarray, counts: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of a block of texts; idf: of each hash.

    A shingle that occurs m times is m binary features of equal weight, so sums of minima are
    products of binary matrices; features are taken COLUMNS at a time.
    """
    texts = len(offsets) - 1
    owner = np.repeat(np.repeat(np.arange(texts), np.diff(offsets)), counts)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    weight = np.repeat(idf, counts)
    total = np.bincount(owner, weights=weight, minlength=texts)
    with np.errstate(over="ignore"):
        keys = mix64(np.repeat(hashes, counts) + mix64(level.astype(np.uint64)))
    _, first, column, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    place = np.full(len(n), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    least = np.zeros((texts, texts))
    for i in range(0, len(shared), COLUMNS):
        here = (column >= i) & (column < i + COLUMNS)
        x = np.zeros((texts, min(COLUMNS, len(shared) - i)))
        x[owner[here], column[here] - i] = 1.0
        least += (x * weight[first[shared[i : i + COLUMNS]]]) @ x.T
    most = total[:, None] + total[None, :] - least
    return np.divide(least, most, out=np.zeros_like(least), where=most > 0)


# -- consistent weighted sampling ------------------------------------------------------------


def _gamma2_quantile(p: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1) by bisection of its distribution function 1 - (1 + x) e^-x."""
    lo, hi = np.full(len(p), 1e-30), np.full(len(p), 60.0)
    for _ in range(200):
        mid = np.sqrt(lo * hi)
        below = -np.expm1(np.log1p(mid) - mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return hi


class Sampler:
    """Tables for the random variates; 16 hash bits for r, 16 for beta and 32 for c."""

    def __init__(self, n: int):
        self.seeds = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        r = _gamma2_quantile((np.arange(1 << 16) + 0.5) / (1 << 16))
        self.r, self.one_over_r = r.astype(np.float32), (1 / r).astype(np.float32)
        # c by the leading bits of a uniform as a float: fine steps where c is small
        exponents = np.arange(-33, 0)[:, None]
        uniforms = 2.0**exponents * (1 + (np.arange(1 << 10)[None, :] + 0.5) / (1 << 10))
        u = np.minimum(uniforms.ravel(), 1 - 1e-9)
        # 1 - (1 + x) e^-x loses precision for small x, where it is x^2 / 2 - x^3 / 3
        small = np.sqrt(2 * u) * (1 + np.sqrt(2 * u) / 3)
        self.log_c = np.log(np.where(u < 1e-6, small, _gamma2_quantile(u))).astype(np.float32)
        self._base = int(np.float32(2.0**-33).view(np.uint32) >> 13)

    def signatures(self, hashes: np.ndarray, log_w: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """uint32 array (texts, functions); every text must have a shingle."""
        out = np.empty((len(offsets) - 1, len(self.seeds)), np.uint32)
        starts = 0
        while starts < len(offsets) - 1:
            end = max(starts + 1, int(np.searchsorted(offsets, offsets[starts] + _CHUNK, "right")) - 1)
            out[starts:end] = self._chunk(hashes[offsets[starts] : offsets[end]], log_w[offsets[starts] : offsets[end]], offsets[starts:end] - offsets[starts])
            starts = end
        return out

    def _chunk(self, hashes: np.ndarray, log_w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), len(self.seeds)), np.uint32)
        with np.errstate(over="ignore"):
            for k, seed in enumerate(self.seeds):
                x = mix64(hashes ^ seed)
                r_at = (x & np.uint64(0xFFFF)).astype(np.intp)
                beta = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
                u = ((x >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)
                c_at = np.minimum((u.view(np.uint32) >> np.uint32(13)).astype(np.intp) - self._base, len(self.log_c) - 1)
                t = np.floor(log_w * self.one_over_r[r_at] + beta)
                log_a = self.log_c[c_at] - self.r[r_at] * (t - beta + 1)
                out[:, k] = np.minimum.reduceat(log_a, starts).view(np.uint32)
        return out


# -- distinct texts --------------------------------------------------------------------------


def keep_ids(df: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with a table of distinct ids (id): broadcast if it is small, shuffled beyond."""
    return keep_rows(df, {column: "id"}, ids, how)


def keep_rows(df: DataFrame, on: dict[str, str], side: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on several columns (of df: of the side): broadcast if the side is small, shuffled beyond."""
    wanted = side.select(*[F.col(c).alias(f"__wanted_{c}") for c in on.values()])
    same = F.lit(True)
    for c, w in on.items():
        same = same & (F.col(c) == F.col(f"__wanted_{w}"))
    return df.join(F.broadcast(wanted) if side.count() <= MAX_BROADCAST_IDS else wanted, same, how)


def _text_key() -> Column:
    """MD5 of a text that has a word and an id; null for others."""
    has_word = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE_CHARS)) != ""
    return F.when(has_word & F.col("id").isNotNull(), F.unhex(F.md5(F.col("text").cast("binary"))))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the texts (place) and deal them into chunks of about CHUNK_BYTES or one text."""
    place = chunk = TaskContext.get().partitionId() << 40
    held = 0
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("text")).to_numpy()
        chunks = np.empty(len(sizes), np.int64)
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > CHUNK_BYTES:
                chunk, held = chunk + 1, 0
            held += size
            chunks[i] = chunk
        yield pa.RecordBatch.from_arrays([pa.array(place + np.arange(len(sizes))), pa.array(chunks), *batch.columns], names=["place", "chunk", *batch.schema.names])
        place += len(sizes)


def _distinct_texts(texts: DataFrame, by_id: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(place, chunk, id, key, text), one row for each text that has a word; id is the least that has it."""
    one = F.col("key") == F.col("k")
    copies = by_id.join(classes.filter("ids > 1").select(F.col("key").alias("k"), "least"), one).filter("id <> least")
    copies = scratch.save(copies.select("id", "key"), "copies")
    pair = {"id": "id", "key": "key"}
    first = keep_rows(texts.withColumn("key", _text_key()).filter("key IS NOT NULL"), pair, copies, "left_anti")
    repeated = scratch.save(classes.filter("rows > 1").select(F.col("least").alias("id"), "key"), "repeated")
    if not repeated.isEmpty():
        again = keep_rows(first, pair, repeated, "left_semi").groupBy("id", "key").agg(F.min("text").alias("text"))
        first = keep_rows(first, pair, repeated, "left_anti").select("id", "key", "text").unionByName(again)
    columns = first.select("id", "key", "text")
    return scratch.save(columns.mapInArrow(_placed, "place long, chunk long, id long, key binary, text string"), "texts")


def _same_id(by_id: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) between the texts of ids that occur with several; None if no id does."""
    several = scratch.save(by_id.groupBy("id").count().filter("count > 1").select("id"), "several")
    if several.isEmpty():
        return None
    theirs = keep_ids(by_id, "id", several, "left_semi").select(F.col("id").alias("i"), F.col("key").alias("k"))
    places = scratch.save(theirs.join(texts.select("key", "place"), F.col("key") == F.col("k")).select("i", "place"), "places")
    first = places.groupBy("i").agg(F.min("place").alias("a")).withColumnRenamed("i", "j")
    return places.join(first, F.col("i") == F.col("j")).filter("place <> a").select("a", F.col("place").alias("b"))


# -- document frequencies --------------------------------------------------------------------


def packed(hashes: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte plane by byte plane: the leading planes are mostly zero and compress away."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _count_by_range(ranges: int) -> Callable:
    """Texts by shingle of each chunk, as sorted arrays for each hash range; a chunk may come in parts."""
    limits = np.array([-(-(i << 64) // ranges) for i in range(1, ranges)], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.concatenate([[0], np.searchsorted(h, limits), [len(h)]])
            full = np.flatnonzero(np.diff(cuts))
            parts = lambda x, code: pa.array([code(x[cuts[i] : cuts[i + 1]]) for i in full], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), now)), parts(h, packed), parts(n.astype(np.uint32), np.ndarray.tobytes)], names=["range", "chunk", "hashes", "n"])

        for batch in (part for whole in batches for part in slices(whole)):
            hashes, _, offsets = weighted_sets(batch.column("text"))
            chunks = batch.column("chunk").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1], [True]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if chunks[a] != now and held:
                    yield flush()
                    held = []
                now = chunks[a]
                held.append(hashes[offsets[a] : offsets[b]])
        if held:
            yield flush()

    return count


def _add_up(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk the shingles of one hash range that two texts or more have, with their frequencies."""
    chunks, hashes, counts = [], [], []
    for batch in parts:
        chunks += batch.column("chunk").to_pylist()
        hashes += [unpacked(x) for x in batch.column("hashes").to_pylist()]
        counts += [np.frombuffer(x, np.uint32) for x in batch.column("n").to_pylist()]
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    df = np.bincount(at, weights=np.concatenate(counts)).astype(np.uint32)
    begin = 0
    for chunk, h in zip(chunks, hashes, strict=True):
        n = df[at[begin : begin + len(h)]]
        begin += len(h)
        if (n > 1).any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([packed(h[n > 1])], pa.binary()), pa.array([n[n > 1].tobytes()], pa.binary())], names=["chunk", "hashes", "df"])


def document_frequencies(texts: DataFrame, n_bytes: int) -> DataFrame:
    """(chunk, hashes, df): of each chunk, the shingles that two texts or more have."""
    ranges = max(1, min(1 << 22, n_bytes // (6 * RANGE_SHINGLES)))
    counted = texts.select("chunk", "text").mapInArrow(_count_by_range(ranges), "range int, chunk long, hashes binary, n binary")
    return counted.groupBy("range").applyInArrow(_add_up, "chunk long, hashes binary, df binary")


# -- signatures ------------------------------------------------------------------------------


def _signer(n_texts: int) -> Callable:
    def sign(key: tuple[pa.Scalar, ...], texts: pa.Table, frequent: pa.Table) -> pa.Table:
        """Bands of the texts of a chunk, and the frequencies of their shingles in sorted order."""
        sampler = _sampler()
        known = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x) for x in frequent.column("hashes").to_pylist())])
        df = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in frequent.column("df").to_pylist())])
        known, first = np.unique(known, return_index=True)  # a chunk that came in parts has two answers, which agree
        df = df[first]
        out = []
        for batch in (part for whole in texts.to_batches() for part in slices(whole)):
            hashes, counts, offsets = weighted_sets(batch.column("text"))
            n = np.ones(len(hashes), np.uint32)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                n = np.where(known[at] == hashes, df[at], n)
            weights = counts * inverse_document_frequency(n.astype(np.float64), n_texts)
            signatures = sampler.signatures(hashes, np.log(weights).astype(np.float32), offsets)
            size = batch.num_rows
            bands = np.zeros((size, BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for b in range(BANDS):
                    value = np.full(size, b, np.uint64)
                    for j in range(ROWS):
                        value = mix64(value ^ signatures[:, b * ROWS + j].astype(np.uint64))
                    bands[:, b] = value
            lists = pa.ListArray.from_arrays(np.arange(0, BANDS * size + 1, BANDS, dtype=np.int32), pa.array(bands.view(np.int64).ravel()))
            frequencies = pa.array([n[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            shingles = pa.array(np.add.reduceat(counts, offsets[:-1]).astype(np.int64))  # every text has a word
            out.append(pa.Table.from_arrays([batch.column("place"), shingles, lists, frequencies], names=["place", "size", "bands", "df"]))
        return pa.concat_tables(out) if out else pa.table({"place": pa.array([], pa.int64()), "size": pa.array([], pa.int64()), "bands": pa.array([], pa.list_(pa.int64())), "df": pa.array([], pa.binary())})

    return sign


@cache
def _sampler() -> Sampler:
    """The tables are made once a Python worker."""
    return Sampler(BANDS * ROWS)


def _sets(batch: pa.RecordBatch | pa.Table, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, offsets, inverse document frequencies) of texts with their saved frequencies."""
    texts, saved = batch.column("text"), batch.column("df")
    if isinstance(texts, pa.ChunkedArray):
        texts, saved = texts.combine_chunks(), saved.combine_chunks()
    hashes, counts, offsets = weighted_sets(texts)
    raw, _ = binary_buffers(saved)
    return hashes, counts, offsets, inverse_document_frequency(np.frombuffer(raw.tobytes(), np.uint32).astype(np.float64), n_texts)


# -- links -----------------------------------------------------------------------------------


def _hub_verifier(n_texts: int, threshold: float) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of members with their hub; rows come block by block, the hub's own row first."""
        hub, hub_set = None, None
        for batch in (part for whole in batches for part in slices(whole)):
            hashes, counts, offsets, idf = _sets(batch, n_texts)
            weights = counts * idf
            a, b = [], []
            for i, (of, place) in enumerate(zip(batch.column("hub").to_pylist(), batch.column("place").to_pylist(), strict=True)):
                own = hashes[offsets[i] : offsets[i + 1]], weights[offsets[i] : offsets[i + 1]]
                if place == of:
                    hub, hub_set = of, (own[0].copy(), own[1].copy())
                elif of != hub:
                    raise ValueError("a member came before its hub")
                elif weighted_jaccard(hub_set, own) >= threshold:
                    a.append(of)
                    b.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return verify


def _contents(texts: DataFrame, signed: DataFrame, places: DataFrame) -> DataFrame:
    """(t, text, df) of the wanted places (id)."""
    some = keep_ids(texts.select("place", "text"), "place", places, "left_semi")
    frequencies = keep_ids(signed.select(F.col("place").alias("t"), "df"), "t", places, "left_semi")
    return some.join(frequencies, F.col("place") == F.col("t")).select("t", "text", "df")


def _hub_links(stars: DataFrame, texts: DataFrame, signed: DataFrame, n_texts: int, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a = hub, b = member) that are similar enough, compared over their whole texts."""
    wanted = scratch.save(stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id"))).distinct(), "wanted")
    blocks = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).withColumnRenamed("a", "h")
    members = stars.join(blocks, F.col("a") == F.col("h")).select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.col("b").alias("place"))
    hubs = blocks.select(F.col("h").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("h").alias("place"))
    asked = scratch.save(members.unionByName(hubs), "asked")
    found = asked.join(_contents(texts, signed, wanted), F.col("place") == F.col("t")).select("hub", "block", "place", "text", "df")
    ordered = found.repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("place") != F.col("hub"))
    return scratch.save(ordered.mapInArrow(_hub_verifier(n_texts, threshold), "a long, b long"), "links")


def _block_linker(n_texts: int, threshold: float) -> Callable:
    def link(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Links between components of one block pair, one for each two components that they join."""
        similar = jaccard_matrix(*_sets(group, n_texts)) >= threshold
        parts, ids, left = (group.column(c).to_numpy() for c in ("component", "id", "left"))
        similar &= (parts[:, None] != parts[None, :]) & left.astype(bool)[:, None]
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        links = []
        for i, j in zip(*np.nonzero(similar), strict=True):
            a, b = find(int(parts[i])), find(int(parts[j]))
            if a != b:
                up[max(a, b)] = min(a, b)
                links.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return link


def _links_left_apart(bands: DataFrame, buckets: DataFrame, parts: DataFrame, texts: DataFrame, signed: DataFrame, n_texts: int, threshold: float, scratch: Scratch) -> DataFrame:
    """Links between members of one bucket in different components, its hub aside.

    The members outside the bucket's largest component (strays) are compared with each other and with all
    others, in blocks of about BLOCK members or BLOCK_SHINGLES shingles; a group returns at most one link for two components.
    """
    inside = bands.join(buckets.select(F.col("band").alias("k"), "least"), F.col("band") == F.col("k")).filter("id <> least").select("band", "id", "size")
    placed = scratch.save(inside.join(parts, F.col("id") == F.col("node"), "left").select("band", "id", "size", F.coalesce("component", "id").alias("component")), "placed")
    by_part = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("size"))
    main = F.max(F.struct("count", "component", "size"))
    mixed = by_part.groupBy("band").agg(main.alias("main"), F.sum("count").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    strays, others = blocks(F.col("n") - F.col("main.count"), F.col("size") - F.col("main.size")), blocks(F.col("main.count"), F.col("main.size"))
    mixed = scratch.save(mixed.select(F.col("band").alias("k"), F.col("main.component").alias("main"), strays.alias("strays"), others.alias("others")), "mixed")
    stray = F.col("component") != F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(stray, F.col("strays")).otherwise(F.col("others"))).cast("int")
    members = placed.join(mixed, F.col("band") == F.col("k")).select("band", "id", "component", "strays", "others", stray.alias("left"), own.alias("own"))
    members = scratch.save(members, "members")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = members.filter("left")
    pairs = (
        strays.select("band", "id", "component", "left", "own", numbers("strays").alias("other")).select("band", "id", "component", "left", F.lit(True).alias("both"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .unionByName(strays.select("band", "id", "component", "left", F.lit(False).alias("both"), F.col("own").alias("i"), numbers("others").alias("j")))
        .unionByName(members.filter("NOT left").select("band", "id", "component", "left", F.lit(False).alias("both"), numbers("strays").alias("i"), F.col("own").alias("j")))
    )
    wanted = scratch.save(members.select("id").distinct(), "wanted")
    grouped = pairs.join(_contents(texts, signed, wanted), F.col("id") == F.col("t")).groupBy("band", "both", "i", "j")
    return scratch.save(grouped.applyInArrow(_block_linker(n_texts, threshold), "a long, b long").distinct(), "apart")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = scratch.save(texts.select("id", _text_key().alias("key"), F.octet_length("text").alias("bytes")), "rows")
    by_id = scratch.save(rows.filter("key IS NOT NULL").groupBy("key", "id").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes")), "by_id")
    first = F.min(F.struct("id", "rows"))
    classes = by_id.groupBy("key").agg(first.alias("first"), F.count(F.lit(1)).alias("ids"), F.max("bytes").alias("bytes"))
    classes = scratch.save(classes.select("key", F.col("first.id").alias("least"), F.col("first.rows").alias("rows"), "ids", "bytes"), "classes")
    n_texts, n_bytes = classes.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    with bounded_batches(spark):
        distinct = _distinct_texts(texts, by_id, classes, scratch)
        frequencies = document_frequencies(distinct, n_bytes or 0)
        chunks = distinct.select("place", "chunk", "text").groupBy("chunk").cogroup(frequencies.groupBy("chunk"))
        signed = scratch.save(chunks.applyInArrow(_signer(n_texts), "place long, size long, bands array<long>, df binary"), "signed")
        bands = scratch.save(signed.select(F.col("place").alias("id"), "size", F.explode("bands").alias("band")), "bands")
        buckets = scratch.save(bands.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most"), "buckets")
        stars = bands.join(buckets.select(F.col("band").alias("k"), "least"), F.col("band") == F.col("k")).filter("id <> least")
        stars = scratch.save(stars.select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "stars")
        links = _hub_links(stars, distinct, signed, n_texts, threshold, scratch)
        same = _same_id(by_id, distinct, scratch)
        parts = scratch.save(connected_components(links if same is None else links.unionByName(same), scratch), "parts")
        more = _links_left_apart(bands, buckets, parts, distinct, signed, n_texts, threshold, scratch)
        if not more.isEmpty():
            parts = scratch.save(connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch), "parts")
    members = distinct.select("place", "id", "key").join(parts, F.col("place") == F.col("node"), "left").select("id", "key", F.coalesce("component", "place").alias("c"))
    members = scratch.save(members, "members")
    least = members.groupBy("c").agg(F.min("id").alias("class")).withColumnRenamed("c", "of")
    named = scratch.save(members.join(least, F.col("c") == F.col("of")).select(F.col("key").alias("k"), "class"), "named")
    out = rows.join(named, F.col("key") == F.col("k"), "left").select(F.col("id").alias("doc_id"), F.coalesce("class", "id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(documents(spark, sf_dir))
