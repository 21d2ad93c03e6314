"""Near-duplicate detection with set sketches: bands of registers find candidates, a joint likelihood sorts them, full sets confirm.

Equal sets are one class. Classes that share a band meet in the bucket of that band, buckets are cut into blocks. A first
round confirms only the most likely forest of each block, which joins groups of copies without looking at all their pairs.
A last round looks at every candidate pair of classes that are still apart, so no link between them is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparkloom.llm.common import WordHashes, maybe_in, slices, store
from sparkloom.llm.components import components
from sparkloom.llm.setsketch import Sketcher, text_shingles

BLOCK_ROWS, BLOCK_SHINGLES, PAIRS_AT_ONCE = 512, 4_000_000, 40_000
TILE = ("bucket", "i", "j")


def digest_of(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def sketch_rows(documents: DataFrame, sketcher: Sketcher, size: int) -> DataFrame:
    """Stored (row, doc_id, n, digest, regs): set size, 128-bit digest of the set and its registers for every input row."""
    id_type = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("n", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("regs", T.BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, digests, regs = [], [], []
            for text in batch.column("text"):
                found = text_shingles(text.as_py(), size, hashes)
                n.append(len(found))
                digests.append(digest_of(found))
                regs.append(sketcher.registers(found).tobytes() if len(found) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, type=pa.int64()),
                                              pa.array(digests, type=pa.binary()), pa.array(regs, type=pa.binary())], names=schema.names)

    return store(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(rows, schema), "sketches")


def register_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def band_rows(classes: DataFrame, sketcher: Sketcher) -> DataFrame:
    """(bucket, band, c, n) for each band of each class."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            keys = sketcher.band_keys(register_matrix(batch.column("regs")))
            times = np.repeat(np.arange(len(keys)), sketcher.bands)
            bands = np.tile(np.arange(sketcher.bands, dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(bands), *(batch.column(c).take(pa.array(times)) for c in ("c", "n"))],
                                             names=["bucket", "band", "c", "n"])

    return classes.select("c", "n", "regs").mapInArrow(rows, "bucket long, band int, c long, n long")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by ``keys``, with the borders of the groups; a group may span batches."""
    held: list[pa.RecordBatch] = []

    def split(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        for key in keys:
            v = table.column(key).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(new), [table.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if any(batch.column(k)[0] != batch.column(k)[-1] for k in keys) or sum(b.num_rows for b in held) > 2 * BLOCK_ROWS:
            table = pa.Table.from_batches(held)
            borders = split(table)
            if len(borders) > 2:
                yield table.slice(0, borders[-2]), borders[:-1]
                held = table.slice(borders[-2]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, split(table)


def block_pairs(borders: np.ndarray, side: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows inside each group; in a tile of two blocks only those with one row of either. Some ten thousand pairs at once."""
    left, right, held = [], [], 0
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        if i[a] == j[a]:
            x, y = np.triu_indices(b - a, 1)
        else:
            first, second = np.flatnonzero(side[a:b] == i[a]), np.flatnonzero(side[a:b] == j[a])
            x, y = np.repeat(first, len(second)), np.tile(second, len(first))
        left.append(x + a)
        right.append(y + a)
        held += len(x)
        if held >= PAIRS_AT_ONCE:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def likely_pairs(table: pa.Table, borders: np.ndarray, sketcher: Sketcher, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (left, right) and likely similarity of the pairs whose first common band is this bucket's and that are not joined yet."""
    regs = register_matrix(table.column("regs").combine_chunks())
    n, label, band = (table.column(c).to_numpy() for c in ("n", "label", "band"))
    side, i, j = (table.column(c).to_numpy() for c in ("side", "i", "j"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for all_left, all_right in block_pairs(borders, side, i, j):
        for at in range(0, len(all_left), PAIRS_AT_ONCE):
            left, right = all_left[at:at + PAIRS_AT_ONCE], all_right[at:at + PAIRS_AT_ONCE]
            apart = label[left] != label[right]
            left, right = left[apart], right[apart]
            equal = regs[left] == regs[right]
            common = equal.reshape(len(left), sketcher.bands, sketcher.rows).all(axis=2)
            # a pair is looked at in its first common band only; few equal registers rule out the likelihood's high values
            mine = (common.argmax(axis=1) == band[left]) & (equal.sum(axis=1) >= (least - 0.12) * sketcher.size)
            left, right = left[mine], right[mine]
            if len(left):
                likely = sketcher.similarity(regs[left], regs[right], n[left], n[right])
                good = likely >= least
                out.append((left[good], right[good], likely[good]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def forest(left: np.ndarray, right: np.ndarray, likely: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the pairs of a most likely forest over the labels."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    chosen = []
    for at in np.lexsort((right, left, -likely)):
        a, b = find(int(label[left[at]])), find(int(label[right[at]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            chosen.append(at)
    return np.array(chosen, dtype=np.int64)


def propose(sketcher: Sketcher, least: float, all_pairs: bool) -> Callable:
    """Rows (bucket, i, j, c, partners): the classes of a block to be compared, and with whom; partners may be empty."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in whole_groups(batches, TILE):
            left, right, likely = likely_pairs(table, borders, sketcher, least)
            c, label = table.column("c").to_numpy(), table.column("label").to_numpy()
            group = np.searchsorted(borders, np.arange(len(c)), side="right")
            if not all_pairs and len(left):
                order = np.argsort(group[left], kind="stable")
                cuts = np.flatnonzero(np.diff(group[left][order], prepend=-1, append=-1))
                picked = [order[a:b][forest(left[order[a:b]], right[order[a:b]], likely[order[a:b]], label)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                chosen = np.concatenate(picked)
                left, right = left[chosen], right[chosen]
            needed = np.unique(np.concatenate([left, right]))
            order = np.argsort(left, kind="stable")
            ends = np.searchsorted(left[order], needed, side="right")
            starts = np.searchsorted(left[order], needed, side="left")
            partners = pa.array([c[right[order[a:b]]] for a, b in zip(starts, ends, strict=True)], type=pa.list_(pa.int64()))
            at = pa.array(needed)
            yield pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks().take(at) for k in (*TILE, "c")), partners], names=[*TILE, "c", "partners"])

    return rows


def confirm(percent: int) -> Callable:
    """Links (a, b) of the proposed pairs whose sets have 100 * intersection >= percent * union."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in whole_groups(batches, TILE):
            c, partners = table.column("c").to_pylist(), table.column("partners").to_pylist()
            elements = [np.frombuffer(x, dtype=np.uint64) for x in table.column("elements").to_pylist()]
            links = []
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                of = dict(zip(c[a:b], elements[a:b], strict=True))
                for one, others in zip(c[a:b], partners[a:b], strict=True):
                    for other in others:
                        x, y = of[one], of[other]
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * common >= percent * (len(x) + len(y) - common):
                            links.append((one, other))
            yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in links], type=pa.int64()) for s in (0, 1)], names=["a", "b"])

    return rows


def tiled(members: DataFrame, seed: int, all_pairs: bool) -> DataFrame:
    """Rows with their tile (bucket, i, j): block i against block j of a bucket, for the forest only i = j."""
    side = F.pmod(F.xxhash64("c", F.lit(seed)), F.col("blocks")).cast("int")
    rows = members.withColumn("side", side)
    if not all_pairs:
        return rows.withColumn("i", F.col("side")).withColumn("j", F.col("side"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    return rows.withColumn("other", other).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other")


def one_round(members: DataFrame, classes: DataFrame, sets: DataFrame, labels: DataFrame | None, sketcher: Sketcher, least: float, percent: int,
              seed: int, all_pairs: bool) -> DataFrame:
    """Stored confirmed links (a, b) between classes with different labels."""
    if labels is None:
        rows = members.withColumn("label", F.col("c"))
    else:
        rows = members.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
        apart = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") != F.col("high"))
        rows = rows.join(apart.select("bucket"), "bucket", "left_semi")
    rows = rows.join(classes.select("c", "regs"), "c")
    placed = tiled(rows, seed, all_pairs).select(*TILE, "side", "band", "c", "n", "label", "regs").repartition(*TILE).sortWithinPartitions(*TILE, "c")
    proposed = store(placed.mapInArrow(propose(sketcher, least, all_pairs), "bucket long, i int, j int, c long, partners array<long>"), "proposed")
    with_sets = proposed.join(sets, "c").select(*TILE, "c", "partners", "elements").repartition(*TILE).sortWithinPartitions(*TILE, "c")
    return store(with_sets.mapInArrow(confirm(percent), "a long, b long"), "confirmed")


def full_sets(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Stored (c, elements) for the classes (c, rep_id, digest) that share a band with another: their sets from the whole texts."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 128):
            found = [text_shingles(t.as_py(), size, hashes) for t in batch.column("text")]
            same = [digest_of(x) == d.as_py() for x, d in zip(found, batch.column("digest"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("c").filter(pa.array(same)),
                                              pa.array([x.tobytes() for x, s in zip(found, same, strict=True) if s], type=pa.binary())],
                                             names=["c", "elements"])

    likely = maybe_in(wanted.select("rep_id"))
    texts = documents.select(F.col("doc_id").alias("rep_id"), "text").where(likely(F.col("rep_id"))).join(wanted, "rep_id").select("c", "digest", "text")
    return store(texts.mapInArrow(rows, "c long, elements binary"), "full-sets")


def relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Stored (c, label) of the classes that are not their own label, after more links (a, b): only labels are joined anew."""
    if labels is None:
        return store(components(links).select(F.col("node").alias("c"), F.col("root").alias("label")), "labels")
    for side in ("a", "b"):
        links = links.join(labels.withColumnsRenamed({"c": side, "label": "__label"}), side, "left").withColumn(
            side, F.coalesce("__label", side)).drop("__label")
    moved = store(components(links), "moved")
    old = labels.join(moved.select(F.col("node").alias("label"), "root"), "label", "left").select("c", F.coalesce("root", "label").alias("label"))
    return store(old.unionAll(moved.select(F.col("node").alias("c"), F.col("root").alias("label"))), "labels")


def link_documents(documents: DataFrame, size: int = 5, percent: int = 80, sketcher: Sketcher = Sketcher(), slack: float = 0.16) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; also class_id, the class of equal sets.

    Documents are linked if 100 * intersection >= percent * union of their sets of word runs. A null or empty text
    has an empty set and is linked with nothing, as is a row with a null id (component null, kept). Rows with one id
    are one document for linking. Ties do not arise: the smallest id of a component stands for it.
    Pairs whose likely similarity lies more than ``slack`` below the limit, over four standard errors, are not looked at.
    """
    sketches = sketch_rows(documents, sketcher, size)
    usable = sketches.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = store(usable.groupBy("digest", "n").agg(F.min("row").alias("c"), F.min_by("doc_id", "row").alias("rep_id"),
                                                      F.min("doc_id").alias("least_id"), F.min_by("regs", "row").alias("regs")), "classes")
    bands = band_rows(classes, sketcher)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where(F.col("size") > 1)
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_ROWS, F.col("weight") / BLOCK_SHINGLES))
    members = store(bands.join(shared.select("bucket", blocks.alias("blocks")), "bucket"), "members")
    wanted = store(members.select("c").distinct().join(classes.select("c", "rep_id", "digest"), "c"), "wanted")
    sets = full_sets(documents, wanted, size)
    repeated = usable.groupBy("doc_id").agg(F.count("*").alias("times")).where(F.col("times") > 1).select("doc_id")
    again = usable.join(repeated, "doc_id").join(classes.select("digest", "c"), "digest").select("doc_id", "c").distinct()
    links = again.join(again.groupBy("doc_id").agg(F.min("c").alias("b")), "doc_id").where(F.col("c") != F.col("b")).select(F.col("c").alias("a"), "b")

    least, labels = percent / 100 - slack, None
    most = members.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0]
    for seed, all_pairs in [(1, False), *([(2, False)] if most > 1 else []), (3, True)]:
        found = one_round(members, classes, sets, labels, sketcher, least, percent, seed, all_pairs)
        labels = relabel(labels, links.unionAll(found) if labels is None else found)
    return summary(sketches, classes, labels)


def summary(sketches: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    rooted = classes.select("digest", "c", "least_id").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    found = store(rooted.join(rooted.groupBy("label").agg(F.min("least_id").alias("component_id")), "label")
                  .select("digest", F.col("c").alias("class_id"), "component_id"), "components")
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    joined = sketches.select("row", "doc_id", "n", F.when(linkable, F.col("digest")).alias("digest")).join(found, "digest", "left")
    component: Column = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "class_id", "row")


def keep_one(documents: DataFrame, **settings) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that with the smallest id.

    Rows with an empty set or a null id all stay; of rows with one id that stands for its group, the one with the smallest hash.
    """
    found = link_documents(documents, **settings)
    keep = found.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("n_shingles") > 0)).alias("one"))
    columns = [F.col(f"d.`{c}`") for c in documents.columns]
    rows = documents.alias("d").join(keep.select(F.col("doc_id").alias("k"), "one").alias("k"), F.col("d.doc_id") == F.col("k.k"))
    first = F.row_number().over(Window.partitionBy("k.k").orderBy(F.xxhash64(*columns)))
    chosen = rows.select(*columns, F.col("k.one").alias("__one"), first.alias("__first")).where(~F.col("__one") | (F.col("__first") == 1))
    return chosen.drop("__one", "__first").unionByName(documents.where(F.col("doc_id").isNull()))
