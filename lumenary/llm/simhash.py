"""SimHash near-dedup over a segment-popcount embedding: components of all fingerprints that differ in at most three bits.

1. Fingerprints. Each run of `shingle` words is hashed (XXH64, seed 42); a bit of the fingerprint is set if over half of a
   text's hashes have it. Equal fingerprints are one class, merged with partial aggregation, so thousands of copies are a
   row per task.
2. Embedding. A fingerprint becomes the bit counts of its 32 segments of two bits, packed in one long. Each differing bit
   moves one count by one at most, so the Manhattan distance of two embeddings is never over their Hamming distance.
3. Grid range join. The embedding's four blocks of eight counts are four grids. Within a Manhattan distance of 3 one block
   at least does not differ, so such fingerprints share a cell of that block's grid. In a cell, rows are sorted by their total
   bit count and compared while it differs by 3 at most; what remains is verified by the bits themselves.
4. Full cells. Where a block is equal, another one differs by 1 at most. A cell over the bound is divided by the counts of
   each other block; a fingerprint is at home in its cell there and a guest in those one step up. A cell that is still over
   the bound is dealt into blocks that meet in pairs, so that no task holds more than the bound.
5. A cell gives links that connect what is connected, at most one less than it has rows, not all pairs. Components are
   found by stars, in Spark.

Defined results: a null text, an empty one and one without words have fingerprint zero, which is linked like any other; with
fewer words than a shingle the whole sequence is the only shingle; rows with equal doc_id are one node with the links of all
its texts, and each keeps a row; a null doc_id is a node that sorts before all others and stays null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import fold, join_words, pieces, space_words, starts_of, string_parts
from .components import components
from .runtime import NULL_ID, checkpointed, small_batches, table

SHINGLE, SEED = 3, 42
#: Bits that linked fingerprints may differ in. The grids below hold for 3 and less.
MOST_BITS = 3
#: Fingerprints that are compared in one cell.
CELL_ROWS = 4096
SLICE_BYTES = 1 << 20
#: Rows of whole cells that are compared at once.
CHUNK_ROWS = 1 << 16
#: The lower bit of every two.
_LOW = 0x5555555555555555
_TASK = ["cell", "part", "fp", "home"]


def text_fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprints of some texts."""
    data, offsets = string_parts(texts)
    data = fold(data)
    start, end, first = space_words(data, offsets)
    n = np.diff(first)
    # The words again, one space apart.
    raw = np.ascontiguousarray(string_parts(join_words(data, start, end, first[:-1], n))[0]).tobytes()
    size = end - start
    begin = starts_of(size + 1)[:-1]
    stop = begin + size
    runs = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    of_text = np.repeat(np.arange(len(n)), runs)
    at = np.arange(len(of_text)) - starts_of(runs)[:-1][of_text] + first[:-1][of_text]
    last = at + np.minimum(n, shingle)[of_text] - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(raw[a:b], SEED) for a, b in zip(begin[at].tolist(), stop[last].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros(len(n), np.int64)
    some = np.flatnonzero(runs)
    if len(some):
        held = np.add.reduceat(bits, starts_of(runs)[:-1][some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * held > runs[some, None], axis=1).view(">i8")[:, 0]
    return out


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, SLICE_BYTES)):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text_fingerprints(batch.column("text").fill_null(""), shingle))], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, a signed long, for each row."""
    read = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(_prints(shingle), "doc_id long, fp long")


def counts(fp: Column) -> Column:
    """The embedding: bit counts (0 to 2) of all segments of two bits, two bits each."""
    up = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(up.bitwiseAND(fp).bitwiseAND(F.lit(_LOW)), 1).bitwiseOR(up.bitwiseXOR(fp).bitwiseAND(F.lit(_LOW)))


def _block(b: int) -> Column:
    return F.shiftrightunsigned("counts", 16 * b).bitwiseAND(F.lit(0xFFFF))


def _cell(b: int) -> Column:
    return _block(b) + F.lit(b << 16)


def grid(prints: DataFrame) -> DataFrame:
    """cell and fp: each fingerprint in its cell of the four grids."""
    return prints.withColumn("counts", counts(F.col("fp"))).select("fp", F.explode(F.array(*[_cell(b) for b in range(4)])).alias("cell"))


def _steps(b: int) -> list[Column]:
    """The counts of a block, and those with one count a step higher; null where it is at its most."""
    def up(i: int) -> Column:
        return F.when(F.shiftrightunsigned(_block(b), 2 * i).bitwiseAND(F.lit(3)) < 2, _block(b) + F.lit(1 << 2 * i))
    return [_block(b), *[up(i) for i in range(8)]]


def refined(full: DataFrame) -> DataFrame:
    """cell, fp and home: the rows (cell, fp) of cells that are over the bound, by the counts of each other block."""
    rows = full.withColumn("counts", counts(F.col("fp"))).withColumn("own", F.shiftright("cell", 16))
    # A cell of two blocks: 18 bits of the first, 18 of the second, and a mark that keeps it apart from cells of one block.
    places = F.array(*[F.when(F.col("own") != b, F.struct((F.lit(1 << 40) + F.shiftleft("cell", 18) + F.lit(b << 16) + key).alias("cell"), F.lit(k == 0).alias("home"))) for b in range(4) for k, key in enumerate(_steps(b))])
    return rows.select("fp", F.explode(places).alias("place")).where("place.cell IS NOT NULL").select("place.cell", "fp", "place.home")


def _in_pairs(full: DataFrame, most: int) -> DataFrame:
    """Rows (cell, fp, home, n) of cells of n rows in blocks of half the bound, each pair of blocks a part of its own."""
    blocks = F.ceil(2 * F.col("n") / most).cast("int")
    dealt = full.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("fp", "home"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("mine != other")
    return met.select("cell", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("long").alias("part"), "fp", "home")


def tasks(prints: DataFrame, most: int = CELL_ROWS) -> DataFrame:
    """cell, part, fp, home: rows of equal cell and part are to be compared, `most` at most."""
    whole = lambda df: df.withColumn("part", F.lit(0).cast("long")).select(_TASK)
    first = grid(prints)
    # Cells of one block are 4 * 3**8 at most, so they may be broadcast however many fingerprints there are.
    full = checkpointed(first.groupBy("cell").count().where(F.col("count") > most).select("cell"))
    out = [whole(first.join(F.broadcast(full), "cell", "left_anti").withColumn("home", F.lit(True)))]
    if not full.isEmpty():
        second = checkpointed(refined(first.join(F.broadcast(full), "cell", "left_semi")))
        dense = checkpointed(second.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most))
        if dense.isEmpty():
            out.append(whole(second))
        else:
            out.append(whole(second.join(dense.hint("merge"), "cell", "left_anti")))
            out.append(_in_pairs(second.join(dense.hint("merge"), "cell"), most))
    return reduce(DataFrame.unionByName, out)


def cell_links(group: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within each group of rows; two guests are not compared."""
    total = np.bitwise_count(fp.view(np.uint64)).astype(np.int16)
    order = np.lexsort((total, group))
    group, fp, home, total = group[order], fp[order], home[order], total[order]
    label = np.arange(len(fp))
    left, right = [], []
    at, step = label, 1
    while len(at):
        at = at[at + step < len(fp)]
        # Rows are sorted, so one that has no partner this far on has none farther on.
        at = at[(group[at] == group[at + step]) & (total[at + step] - total[at] <= bits)]
        hit = at[(label[at] != label[at + step]) & (home[at] | home[at + step])]
        hit = hit[np.bitwise_count((fp[hit] ^ fp[hit + step]).view(np.uint64)) <= bits]
        if len(hit):
            parent = {}

            def root(x: int, parent=parent) -> int:
                while x in parent:
                    x = parent[x]
                return x

            for i, a, b in zip(hit.tolist(), label[hit].tolist(), label[hit + step].tolist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    left.append(i)
                    right.append(i + step)
            moved = np.arange(len(fp))
            for a in parent:
                moved[a] = root(a)
            label = moved[label]
        step += 1
    return fp[left], fp[right]


def _meet(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and part; a chunk is some whole groups."""
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            cell, part, fp, home = (rows[c].to_numpy() for c in _TASK)
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])
            u, v = cell_links(np.cumsum(new), fp.copy(), home.astype(bool), bits)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            last = (rows["cell"].to_numpy() != rows["cell"][-1].as_py()) | (rows["part"].to_numpy() != rows["part"][-1].as_py())
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield done(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))
    return run


def near_links(prints: DataFrame, bits: int = MOST_BITS, most: int = CELL_ROWS) -> DataFrame:
    """(u, v): links between different fingerprints (column fp, each once) that connect all that are within `bits` of each other."""
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"fingerprints may differ in 0 to {MOST_BITS} bits")
    dealt = tasks(prints, most).repartition("cell", "part").sortWithinPartitions("cell", "part")
    return dealt.select(_TASK).mapInArrow(_meet(bits), "u long, v long")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = MOST_BITS, most: int = CELL_ROWS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach), one row per row of `docs`."""
    held = checkpointed(fingerprints(docs, shingle).withColumn("node", F.coalesce("doc_id", F.lit(NULL_ID))))
    classes = checkpointed(held.groupBy("fp").agg(F.min("node").alias("least")))
    links = near_links(classes.select("fp"), bits, most)
    several = checkpointed(held.groupBy("node").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where("v != top").drop("top"))
    if not several.isEmpty():
        links = links.unionByName(held.join(several.hint("merge"), "node").select(F.col("fp").alias("u"), "v"))
    label = components(links).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    label = checkpointed(label.unionByName(label.select(F.col("root").alias("fp"), "root").distinct()))
    least = checkpointed(label.join(classes.hint("merge"), "fp").groupBy("root").agg(F.min("least").alias("component")))
    linked = label.join(least.hint("merge"), "root").select("fp", "component")
    of_class = checkpointed(classes.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("component", "least").alias("component")))
    out = held.join(of_class.hint("merge"), "fp")
    return out.select("doc_id", "fp", F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
