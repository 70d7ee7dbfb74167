"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Every row gets a number, written once to the shared folder with its columns; all later
   steps read that table, so a row keeps its number whatever is recomputed.
2. Texts with equal sets of five-word shingles become one representative.
3. Representatives that share a band of MinHash values are candidates. They are compared by
   their values, a few at a time, a pair being dropped once the posterior probability that
   its similarity reaches the threshold falls below ``TOLERANCE``. Of the pairs that stay
   only a spanning forest leaves a task; its components hold every pair that can be linked.
4. Only members of components bring their shingles. Pairs are compared inside components,
   by values first, and verified on the whole shingle sets. A task emits links counted per
   representative and a spanning forest of the links: never a list of all pairs.

No group meets in one task: bands and components beyond a block's size are dealt into
blocks, each pair of blocks being one run of sorted rows, bounded in rows and bytes. Joins
by a key that many rows share go through ``join_heavy``.

Defined cases: words are runs of letters and digits in lower case; a text of one to four
words has one shingle, all of them; a null or empty text, or one without words, has no
links and is a class by itself; ids may be null or repeated, since rows are told apart by
their number (a class whose ids are all null has a null class_id; an empty table gives an
empty result); other columns, whatever their names, are never looked at. Very long texts
are compared whole: blocks are bounded in bytes, but for a single text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearspan.llm.common import fresh, join_heavy, ship, stored

SHINGLE = 5
THRESHOLD = 0.8
#: 32 bands of 4 values: at the threshold a pair shares no band once in 2e7.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Values compared before each look at the posterior.
STEP = 16
TOLERANCE = 1e-6
#: Rows of a block of a band (values only), of a component (with shingles), and the shingles of the latter in bytes.
BAND_BLOCK, BLOCK, BLOCK_BYTES = 2048, 512, 8 << 20
#: A component of more than SMALL_BLOCK rows is dealt into up to SPREAD blocks, so that many tasks share it, before blocks grow to BLOCK.
SMALL_BLOCK, SPREAD = 64, 64
#: Words hashed at once, about what a core's cache holds.
CHUNK = 1 << 15

_HALF = np.random.default_rng(7).integers(1, 1 << 63, size=(HASHES, 2), dtype=np.uint64)
_MULTIPLY, _ADD = _HALF[:, 0] * np.uint64(2) + np.uint64(1), _HALF[:, 1]
_COMBINE = np.random.default_rng(11).integers(1, 1 << 63, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of one text's word hashes."""
    if not len(words):
        return words
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    total = np.full(n, np.uint64(k))
    for j in range(k):
        total += _mix(words[j : j + n] * _COMBINE[j])
    return np.unique(_mix(total))


def signature(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits each, of the shingle sets that begin at ``starts`` in s."""
    out = np.empty((len(starts), HASHES), np.uint16)
    for j in range(HASHES):
        # The least product has the least upper half.
        out[:, j] = (np.minimum.reduceat(s * _MULTIPLY[j] + _ADD[j], starts) >> np.uint64(32)) & np.uint64(0xFFFF)
    return out


def shingle_sets(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of many texts in one array, and where each text's begin (and the end)."""
    sets = np.empty(0, np.uint64)
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        sets = np.full(n, np.uint64(SHINGLE))
        for j in range(SHINGLE):
            sets += _mix(words[j : j + n] * _COMBINE[j])
        sets = _mix(sets)
    parts = []
    for a, b in zip(offsets, offsets[1:], strict=False):
        if b - a > SHINGLE:
            own = np.sort(sets[a : b - SHINGLE + 1])
            parts.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            parts.append(shingles(words[a:b]))
    return np.concatenate(parts) if parts else sets[:0], np.cumsum([0, *map(len, parts)])


@lru_cache
def least_matches() -> list[int]:
    """For each look at the values: matches below which a pair is dropped.

    The prior of the similarity is uniform; two values also agree by chance once in 65536.
    """
    s = np.linspace(0.0005, 0.9995, 1000)
    agree = s + (1 - s) / 65536
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        least = 0
        for m in range(n + 1):
            logs = m * np.log(agree) + (n - m) * np.log1p(-agree)
            p = np.exp(logs - logs.max())
            if p[s >= THRESHOLD].sum() / p.sum() >= TOLERANCE:
                break
            least = m + 1
        out.append(least)
    return out


def surviving(signs: np.ndarray, sizes: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    """Places of the pairs (i, j) that the sizes' ratio and the values leave."""
    # No similarity can exceed the ratio of the sizes.
    at = np.flatnonzero(np.minimum(sizes[j], sizes[i]) >= THRESHOLD * np.maximum(sizes[j], sizes[i]))
    matches = np.zeros(len(at), np.int64)
    for look, least in enumerate(least_matches()):
        if not len(at):
            break
        values = slice(look * STEP, (look + 1) * STEP)
        own = signs[i, values] if np.isscalar(i) else signs[i[at], values]
        matches += (signs[j[at], values] == own).sum(1)
        stay = matches >= least
        at, matches = at[stay], matches[stay]
    return at


def _word_hashes(text: str) -> str:
    return f"transform(regexp_extract_all(lower(coalesce(`{text}`, '')), '[\\\\p{{L}}\\\\p{{N}}]+', 0), x -> xxhash64(x))"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column of longs as one unsigned array and the lists' offsets in it."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return values, offsets - offsets[0]


def _chunks(values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of lists of about CHUNK words."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        yield values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


_SIGNED = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("signature", T.BinaryType())])
_BANDED = T.StructType([T.StructField("row", T.LongType()), T.StructField("band", T.LongType())])
_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_FOUND = T.StructType([T.StructField("row", T.LongType()), T.StructField("links", T.LongType()), T.StructField("to", T.LongType())])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(_SIGNED)
    for batch in batches:
        keys, sizes, signs = [], [], []
        for words, offsets in _chunks(*_lists(batch.column(2))):
            sets, edges = shingle_sets(words, offsets)
            full = np.flatnonzero(edges[1:] > edges[:-1])
            starts, size = edges[full], np.diff(edges)
            rows_keys: list[bytes | None] = [None] * len(size)
            rows_signs: list[bytes | None] = [None] * len(size)
            if len(full):
                key = np.stack([size[full].astype(np.uint64), np.add.reduceat(sets, starts), np.bitwise_xor.reduceat(_mix(sets), starts)], 1)
                for k, x, s in zip(full, key, signature(sets, starts), strict=True):
                    rows_keys[k], rows_signs[k] = x.tobytes(), s.tobytes()
            keys += rows_keys
            signs += rows_signs
            sizes.append(size)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.array(signs, pa.binary())], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, the words' hashes, becomes the shingles."""
    for batch in batches:
        out = []
        for words, offsets in _chunks(*_lists(batch.column(batch.num_columns - 1))):
            sets, edges = shingle_sets(words, offsets)
            out += [sets[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(_BANDED)
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = _signs(batch.column(1)).reshape(batch.num_rows, BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for j in range(ROWS):
            key = _mix(key + signs[:, :, j].astype(np.uint64) + np.uint64(j + 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(key.reshape(-1).view(np.int64))], schema=schema)


def in_blocks(df: DataFrame, key: str, n: str) -> DataFrame:
    """df once for each pair of blocks its row takes part in, each pair of a key's n blocks being one run.

    Rows come sorted by ``key``, ``left`` and ``right`` within partitions.
    """
    return (
        df.withColumn("block", F.expr(f"CAST(pmod(xxhash64(row), {n}) AS INT)"))
        .withColumn("other", F.explode(F.expr(f"sequence(0, CAST({n} AS INT) - 1)")))
        .withColumn("left", F.least("block", "other"))
        .withColumn("right", F.greatest("block", "other"))
        .repartition(key, "left", "right")
        .sortWithinPartitions(key, "left", "right", "row")
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs (rows equal in the first three columns) and where the runs begin, and the end."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        keys = np.stack([table.column(k).to_numpy().astype(np.int64) for k in range(3)])
        starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1])
        # The last run may go on in the next batch.
        kept = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]).combine_chunks(), starts
    if kept is not None:
        yield kept.combine_chunks(), np.array([0, kept.num_rows])


#: Runs of up to so many rows are compared together, by offsets.
SMALL_RUN = 8


def forest(starts: np.ndarray, link: Callable[[int, np.ndarray], np.ndarray], links: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each row the first row it is connected to inside its run.

    ``link(i, j)`` and ``links(i, j)`` give the places of linked pairs. Rows that are
    connected already are not compared any more.
    """
    n = starts[-1]
    first = np.arange(n)
    run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    length = np.repeat(np.diff(starts), np.diff(starts))

    def join(i: int, j: int) -> None:
        a, b = first[i], first[j]
        if a != b:
            own = first[starts[run[i]] : starts[run[i] + 1]]
            own[own == max(a, b)] = min(a, b)

    for d in range(1, min(SMALL_RUN, n)):
        i = np.flatnonzero((run[:-d] == run[d:]) & (length[d:] <= SMALL_RUN))
        at = links(i, i + d)
        for k in i[at]:
            join(k, k + d)
    for a, b in zip(starts, starts[1:], strict=False):
        if b - a <= SMALL_RUN:
            continue
        own = first[a:b]
        for i in range(b - a - 1):
            j = np.flatnonzero(own[i + 1 :] != own[i]) + i + 1
            if len(j):
                hit = np.unique(own[j[link(a + i, a + j)]])
                if len(hit):
                    all_ = np.append(hit, own[i])
                    own[np.isin(own, all_)] = all_.min()
    return first


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each run's pairs that the values leave, as edges to the component's first row."""
    schema = to_arrow_schema(_EDGES)
    for table, starts in _runs(batches):
        rows, sizes = table.column(3).to_numpy(), table.column(4).to_numpy()
        signs = _signs(table.column(5).combine_chunks())
        first = forest(starts, lambda i, j, s=signs, z=sizes: surviving(s, z, int(i), j), lambda i, j, s=signs, z=sizes: surviving(s, z, i, j))
        some = np.flatnonzero(first != np.arange(len(first)))
        yield pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(rows[first[some]])], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); a component's name is its least node.

    Alternating large-star and small-star steps, each a partial aggregation and a join in
    which a hub's many rows are spread; every round is written to the shared folder.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == total:
            break
        total = now
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.expr("b > a")).alias("n"))
        large = stored(join_heavy(both.where("b > a"), least, "a", "n", total[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        linked = join_heavy(large, small, "a", "n", total[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(linked.unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside a block, or between two blocks: per row its links (in copies) and the first row it is connected to."""
    schema = to_arrow_schema(_FOUND)
    for table, starts in _runs(batches):
        left, right, side = (table.column(k).to_numpy() for k in (1, 2, 6))
        rows, sizes, copies = (table.column(k).to_numpy() for k in (3, 4, 7))
        signs = _signs(table.column(5).combine_chunks())
        blobs = table.column(8)
        linked, first = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for a, b in zip(starts, starts[1:], strict=False):
            own, sets = first[a:b], [np.frombuffer(x.as_py(), np.uint64) for x in blobs.slice(a, b - a)]
            within = left[a] == right[a]
            at_left, at_right = np.flatnonzero(side[a:b] == left[a]), np.flatnonzero(side[a:b] == right[a])
            for k, i in enumerate(at_left):
                j = at_left[k + 1 :] if within else at_right
                j = j[surviving(signs[a:b], sizes[a:b], int(i), j)]
                if not len(j):
                    continue
                # The rarer way round: all partners' shingles are looked up in this row's.
                joined = np.concatenate([sets[x] for x in j])
                at = np.minimum(np.searchsorted(sets[i], joined), len(sets[i]) - 1)
                common = np.add.reduceat((sets[i][at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[a:b][j])[:-1]]))
                j = j[common >= THRESHOLD * (sizes[a:b][j] + sizes[a + i] - common) - 1e-9]
                if len(j):
                    linked[a + i] += copies[a:b][j].sum()
                    linked[a + j] += copies[a + i]
                    all_ = np.append(own[j], own[i])
                    own[np.isin(own, all_)] = all_.min()
        some = np.flatnonzero(linked)
        yield pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(linked[some]), pa.array(rows[first[some]])], schema=schema)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written once to the shared folder, and the number's column."""
    row = fresh(docs, "__row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def jaccard_classes(rows: DataFrame, row: str, text: str = "text", ids: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and per distinct set of shingles its class.

    The first table has row, id, set_key (null: no words), size and signature. The second has
    set_key, row (the first with this set), copies, class_row (the class's first row), class_id
    (its least id) and n_links, the other rows, copies included, that are similar enough.
    """
    ship(rows.sparkSession)
    key = F.col(ids).cast("long") if ids else F.lit(None).cast("long")
    signed = stored(rows.select(F.col(row).alias("row"), key.alias("id"), F.expr(_word_hashes(text)).alias("words")).mapInArrow(_signed, _SIGNED), "signed")
    reps = stored(
        signed.where("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("row").alias("row"), F.min("id").alias("id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature")),
        "reps",
    )
    total = reps.count()
    bands = reps.select("row", "signature").mapInArrow(_bands, _BANDED)
    counts = stored(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("rows", F.col("n")), "bands")
    values = reps.select("row", "size", "signature")
    banded = join_heavy(bands, counts, "band", "n", BANDS * total).join(values, "row").withColumn("n", F.ceil(F.col("rows") / BAND_BLOCK))
    edges = in_blocks(banded, "band", "n").select("band", "left", "right", "row", "size", "signature").mapInArrow(_candidates, _EDGES)
    coarse = stored(components(edges).withColumnRenamed("node", "row").join(reps.select("row", "size", "copies", "signature"), "row"), "coarse")
    sizes = stored(coarse.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("all")), "sizes")
    n = F.ceil(F.greatest(F.least(F.col("members") / SMALL_BLOCK, F.lit(SPREAD)), F.col("members") / BLOCK, F.col("all") * 8 / BLOCK_BYTES))
    members = join_heavy(coarse, sizes.withColumn("members", F.col("n")), "component", "n", total).withColumn("n", n)
    # Only members of components bring their shingles, once each, then one copy for each pair of blocks.
    texts = (
        rows.select(F.col(row).alias("row"), F.col(text).alias("text"))
        .join(members, "row")
        .select("row", "component", "size", "signature", "copies", "n", F.expr(_word_hashes("text")).alias("words"))
        .mapInArrow(_sets, "row long, component long, size long, signature binary, copies long, n long, shingles binary")
    )
    blocks = in_blocks(texts, "component", "n").select("component", "left", "right", "row", "size", "signature", "block", "copies", "shingles")
    found = stored(blocks.mapInArrow(_verify, _FOUND), "found")
    links = found.groupBy("row").agg(F.sum("links").alias("others"))
    classes = components(found.select(F.col("row").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "row")
    named = stored(
        reps.select("set_key", "row", "id", "copies")
        .join(links, "row", "left")
        .join(classes, "row", "left")
        .select("set_key", "row", "id", "copies", F.col("component").alias("class_row"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")),
        "named",
    )
    alone, linked = named.where("class_row IS NULL"), named.where("class_row IS NOT NULL")
    least = linked.groupBy("class_row").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    columns = ("set_key", "row", "copies", "class_row", "class_id", "n_links")
    return signed, alone.withColumns({"class_row": F.col("row"), "class_id": F.col("id")}).select(*columns).unionByName(join_heavy(linked, least, "class_row", "n", total).select(*columns))


def jaccard_join(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class) and n_links."""
    rows, row = numbered(docs.select("doc_id", text))
    signed, named = jaccard_classes(rows, row, text, "doc_id")
    keyed = signed.select("set_key", "id")
    found = join_heavy(keyed.where("set_key IS NOT NULL"), named.select("set_key", "copies", "class_id", "n_links"), "set_key", "copies", signed.count())
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links").unionByName(
        keyed.where("set_key IS NULL").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    )


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each class, its first, in their own columns."""
    rows, row = numbered(docs)
    signed, named = jaccard_classes(rows, row, text)
    kept = named.where("row = class_row").select("row").unionByName(signed.where("set_key IS NULL").select("row"))
    return rows.join(kept.withColumnRenamed("row", row), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def jaccard_sql() -> str:
    """The same join for DuckDB over the table documents: all pairs that share a shingle, and their closure."""
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
k AS (SELECT r, w, least({SHINGLE}, len(w)) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS g FROM k),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE c >= {THRESHOLD} * (a.n + b.n - c) - 1e-9),
reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT x, min(doc_id) AS class_id FROM reach JOIN d ON d.r = y GROUP BY x),
m AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM d JOIN c ON c.x = r LEFT JOIN m ON m.x = r"""
