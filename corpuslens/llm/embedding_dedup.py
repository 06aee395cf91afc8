"""Near-duplicate embeddings by product quantisation.

Vectors are scaled to length 1, so cosine >= t means distance <= D = sqrt(2 - 2 t).

* Coarse inverted lists: k-means centroids; a vector is in the list of its nearest centroid c. Its margin to another centroid
  e is its distance from the plane between the cells of c and e, (|q-e|^2 - |q-c|^2) / (2 |c-e|). For two vectors on different
  sides of a plane the margins add up to no more than their distance, so one of them is at most D / 2. A vector probes the lists
  to which its margin is at most ``reach``: with reach D / 2 no link can be lost (``exact=True``).
* By default reach is smaller. The part of a difference of length D across a given plane has a deviation of
  D / sqrt(dimensions) if no direction is favoured; reach is half of SIGMAS deviations, or more if linked vectors of the fit
  sample need more, and D / 2 at most. A link at the very threshold is then lost with a probability of about 1 in 700 for
  a pair of neighbouring cells, closer ones less often; the README has the recall measured against all pairs.
* Residual codes: x - c is coded in SUBSPACES parts of up to CODES codewords, and the coding error
  |x - x'| is kept. Table lookups give |q - x'|, and |q - x| <= D implies |q - x'| <= D + error, so
  the candidates that pass that test hold every link with a probed list.
* Exact rerank: candidates are compared by cosine in double precision, and pairs below t go.

A pair that both sides' probes find counts from the list with the smaller number. Lists are cut into
blocks of about BLOCK vectors by a hash of the id, and each (query block, list block) is one
group, so a crowded list is many small tasks. A group returns a link count for each vector and a
spanning forest of its links, never all pairs. Equal vectors are collapsed first and counted by
their number, so copies cost nothing.

The model (centroids, codebooks, reach) is fitted on a bounded sample: the share of the vectors, by a hash of
the id, that makes FIT_ROWS expected (all if there are fewer). It has a fixed size (MAX_LISTS centroids at most); the number of
lists grows with the square root of the row count up to MAX_LISTS. Every vector is indexed. Encoding and comparing take
_CELLS distances at a time.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, nor do rows with a null id; vectors of different lengths never link; rows repeated with the
same id and vector are linked to each other and each give a row (an id must not stand for two
vectors); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.bytes_text import binary_buffers
from corpuslens.llm.components import connected_components
from corpuslens.llm.tables import table, uniform
from corpuslens.plans.scratch import Scratch

THRESHOLD = 0.9
FIT_ROWS = 32_768
MAX_LISTS = 4_096
SUBSPACES = 8
CODES = 256
BLOCK = 2_048
SIGMAS = 3.0
_CELLS = 1 << 21
#: Slack for rounding in the distance bounds; links are decided by the exact cosine alone.
_SLACK = 1e-6


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from k distinct random rows; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0.0)


def in_parts(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows so that rows times width is about _CELLS."""
    rows = max(1, _CELLS // max(1, width))
    return (slice(i, min(n, i + rows)) for i in range(0, n, rows))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared_distances(x[i], centres).argmin(1) for i in in_parts(len(x), len(centres))] or [np.zeros(0, int)])


class Model:
    """Centroids and residual codebooks; vectors are padded with zeros to a multiple of SUBSPACES."""

    def __init__(self, sample: np.ndarray, n_lists: int, distance: float, exact: bool = False):
        self.width = sample.shape[1]
        self.centroids = k_means(sample, n_lists, 10, 1)
        home = nearest(sample, self.centroids)
        residual = sample - self.centroids[home]
        self.books = [k_means(part, CODES, 8, 2 + m) for m, part in enumerate(self.parts(residual))]
        self.reach = distance / 2
        if not exact:
            spread = SIGMAS * distance / (2 * math.sqrt(self.width))
            self.reach = min(self.reach, max(spread, self._needed(sample, home, distance)))

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, SUBSPACES, axis=1)

    def _needed(self, sample: np.ndarray, home: np.ndarray, distance: float) -> float:
        """Least reach that finds all pairs of the sample within the distance."""
        most = 0.0
        for i in in_parts(len(sample), len(sample)):
            a, b = np.nonzero(squared_distances(sample[i], sample) <= distance**2)
            a += i.start
            a, b = a[home[a] != home[b]], b[home[a] != home[b]]
            for j in in_parts(len(a), self.width):
                one, other = (self._margin(sample[x[j]], home[x[j]], home[y[j]]) for x, y in ((a, b), (b, a)))
                most = max(most, float(np.minimum(one, other).max(initial=0.0)))
        return most

    def _margin(self, x: np.ndarray, home: np.ndarray, to: np.ndarray) -> np.ndarray:
        c, e = self.centroids[home], self.centroids[to]
        return (((x - e) ** 2).sum(1) - ((x - c) ** 2).sum(1)) / (2 * np.maximum(np.sqrt(((c - e) ** 2).sum(1)), 1e-300))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, coding error) of unit vectors."""
        home = nearest(x, self.centroids)
        residual = x - self.centroids[home]
        codes = np.stack([nearest(p, b) for p, b in zip(self.parts(residual), self.books, strict=True)], 1).astype(np.uint8)
        coded = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return home, codes, np.sqrt(((residual - coded) ** 2).sum(1))

    def probes(self, x: np.ndarray, home: np.ndarray) -> list[np.ndarray]:
        """Other lists that each vector must look into."""
        out = []
        for i in in_parts(len(x), len(self.centroids)):
            d = squared_distances(x[i], self.centroids)
            margin = d - d[np.arange(len(d)), home[i]][:, None]
            gaps = np.sqrt(squared_distances(self.centroids[home[i]], self.centroids))
            near = margin <= 2 * gaps * (self.reach + _SLACK) + _SLACK
            near[np.arange(len(d)), home[i]] = False
            out += [np.flatnonzero(row).astype(np.int32) for row in near]
        return out

    def lookup(self, q: np.ndarray, lists: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to coded vectors of one list, by summing table entries."""
        total = np.zeros((len(q), len(codes)))
        for m, part in enumerate(self.parts(q - self.centroids[lists])):
            total += squared_distances(part, self.books[m])[:, codes[:, m]]
        return np.sqrt(total)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as doubles, padded with zeros; their lengths)."""
    values, sizes = _lists(column)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out, sizes


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _compare(model: Model, threshold: float, lists: int, asking: pa.Table, members: pa.Table) -> list[tuple[int, int | None, int]]:
    """Links between asking rows and coded members of one list block: (vector, None, links) and a spanning forest (a, b, 0)."""
    distance = math.sqrt(max(0.0, 2 - 2 * threshold))
    xv, x_dim = _matrix(members.column("v"), model.width)
    xu = _unit(xv)
    codes = binary_buffers(members.column("codes").combine_chunks())[0].reshape(len(xv), SUBSPACES)
    x_id, x_n, error = (members.column(c).to_numpy() for c in ("id", "n", "error"))
    probed, sizes = _lists(members.column("probes"))
    # member * lists + list of all probes of the members, sorted
    k = len(model.centroids)
    own_probes = np.sort(np.repeat(np.arange(len(xv)), sizes) * k + probed)
    x_links = np.zeros(len(xv), np.int64)
    forest, found = _Forest(), []
    for i in in_parts(asking.num_rows, len(xv)):
        part = asking.slice(i.start, i.stop - i.start)
        qv, q_dim = _matrix(part.column("v"), model.width)
        qu = _unit(qv)
        q_id, q_n, home = (part.column(c).to_numpy() for c in ("id", "n", "home"))
        q_links = np.zeros(len(qv), np.int64)
        r, c = np.nonzero(model.lookup(qu, lists, codes) <= distance + error[None, :] + _SLACK)
        # inside a list from the smaller id; across lists from the smaller list, or from the larger if only it probes the other
        cell = c * k + home[r]
        at = np.minimum(np.searchsorted(own_probes, cell), max(0, len(own_probes) - 1))
        twice = (own_probes[at] == cell) if len(own_probes) else np.zeros(len(cell), bool)
        keep = np.where(home[r] == lists, q_id[r] < x_id[c], (home[r] < lists) | ~twice)
        r, c = r[keep], c[keep]
        for j in in_parts(len(r), model.width):
            rr, cc = r[j], c[j]
            keep = (np.einsum("ij,ij->i", qu[rr], xu[cc]) >= threshold) & (q_dim[rr] == x_dim[cc])
            rr, cc = rr[keep], cc[keep]
            np.add.at(q_links, rr, x_n[cc])
            np.add.at(x_links, cc, q_n[rr])
            found += [(a, b, 0) for a, b in zip(q_id[rr].tolist(), x_id[cc].tolist(), strict=True) if forest.join(a, b)]
        found += [(a, None, n) for a, n in zip(q_id.tolist(), q_links.tolist(), strict=True) if n]
    return found + [(a, None, n) for a, n in zip(x_id.tolist(), x_links.tolist(), strict=True) if n]


def near_duplicate_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(id, n_links, component_id, kept) for every row. exact: probe so widely that no link can be lost."""
    spark = df.sparkSession
    scratch = Scratch(spark, "embedding")
    v = F.col(vector_column)
    good = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    element = df.schema[vector_column].dataType.elementType.typeName()
    numbers = v if element in ("float", "double") else F.transform(v, lambda c: c.cast("double"))
    rows = scratch.save(
        df.select(F.col(id_column).cast("long").alias("id"), F.when(good & F.col(id_column).isNotNull(), numbers).alias("v")).withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json("v"), 256))), "rows"
    )
    classes = rows.filter("v IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = scratch.save(classes, "classes")
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if n:
        width = -(-width // SUBSPACES) * SUBSPACES
        sample = classes.filter(uniform(F.col("id"), "fit") < min(1.0, FIT_ROWS / n)).select("id", "v").toArrow().sort_by("id")
        links, edges = _links(spark, scratch, classes, fit_model(sample, width, n, threshold, exact), threshold)
        parts = connected_components(edges, scratch)
    else:
        links = spark.sql("SELECT 0L AS k, 0L AS links WHERE false")
        parts = spark.sql("SELECT 0L AS node, 0L AS component WHERE false")
    found = scratch.save(
        classes.select("key", "id", "n")
        .join(links, F.col("id") == F.col("k"), "left")
        .join(parts, F.col("id") == F.col("node"), "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")),
        "found",
    )
    out = rows.select("id", "key").join(found.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def fit_model(sample: pa.Table, width: int, n: int, threshold: float = THRESHOLD, exact: bool = False) -> Model:
    n_lists = int(min(MAX_LISTS, max(1, round(math.sqrt(n))), sample.num_rows))
    return Model(_unit(_matrix(sample.column("v"), width)[0]), n_lists, math.sqrt(max(0.0, 2 - 2 * threshold)), exact)


def _links(spark, scratch: Scratch, classes: DataFrame, model: Model, threshold: float) -> tuple[DataFrame, DataFrame]:
    shared = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = _unit(_matrix(batch.column("v"), m.width)[0])
            home, codes, error = m.encode(x)
            probes = pa.array(m.probes(x, home), pa.list_(pa.int32()))
            made = [pa.array(home.astype(np.int32)), probes, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "home", "probes", "codes", "error"])

    vector = classes.schema["v"].dataType.simpleString()
    coded = scratch.save(classes.select("id", "n", "v").mapInArrow(encode, f"id long, n long, v {vector}, home int, probes array<int>, codes binary, error double"), "coded")
    blocks = coded.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = F.broadcast(scratch.save(blocks.withColumnRenamed("home", "of"), "blocks"))  # at most MAX_LISTS rows
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # each vector as a member of its list block, for every block of queries, and as a query to every block that it must see
    members = coded.join(blocks, F.col("home") == F.col("of"))
    members = members.select("id", "n", "v", "home", "probes", "codes", "error", F.col("home").alias("list"), mine.alias("block"), every.alias("part"))
    queries = coded.select("id", "n", "v", "home", F.explode(F.concat(F.array("home"), "probes")).alias("list")).join(blocks, F.col("list") == F.col("of"))
    queries = queries.select("id", "n", "v", "home", "list", every.alias("block"), mine.alias("part"))

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        is_member = group.column("codes").is_valid()
        inside, asking = group.filter(is_member), group.filter(pa.compute.invert(is_member))
        found = _compare(shared.value, threshold, key[0].as_py(), asking, inside) if inside.num_rows and asking.num_rows else []
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

    routed = members.unionByName(queries, allowMissingColumns=True)
    found = scratch.save(routed.groupBy("list", "block", "part").applyInArrow(compare, "a long, b long, n long"), "links")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("links"))
    return links, found.filter("b IS NOT NULL").select("a", "b")


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT reach.node, l.b FROM reach JOIN l ON l.a = reach.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
