"""Hard-negative mining by a block matrix multiplication in two dimensions.

Rows are dealt into row blocks, their components into chunks. A panel is one block's integers in one chunk. Panels of anchors
and of rows that share a chunk meet in the cells of a grid, as in SUMMA, and each meeting gives a partial tile of scores;
partial tiles of one place are shuffled together and added as 64-bit integers. What is needed of a tile is reduced there: the
first rows of a label for the anchors' positives, the first rows inside each window of an anchor and a positive for negatives.

Positives need tiles of equal labels only, so blocks for them hold the rows of one group of labels (a hash of the label) and
only equal groups meet; a group of any size has as many blocks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, stash, tidy

#: Rows of a row block, anchors of an anchor block, components of a chunk.
ROWS, ANCHORS, CHUNK = 1024, 256, 32
#: Labels are hashed into so many groups.
GROUPS = 64
#: Row blocks that meet an anchor block in one cell of the grid.
CELL = 8
_NONE = np.iinfo(np.int64).min


def integers(vectors: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``rid, id, label, x``: rows that take part, their components as integers; written once."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    label = F.col(label_col).cast("long")
    ok = vectors.filter(label.isNotNull() & x.isNotNull() & ~odd)
    # 2 to the power of 62 is further than any component may be; limits by the number of components follow
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.least(e.cast("double") * scale, F.lit(float(1 << 62))), F.lit(-float(1 << 62)))).cast("long"))
    return stash(ok.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), label.alias("label"), whole.alias("x")), "vectors")


def _narrow(x: np.ndarray) -> tuple[bytes, int]:
    """The panel in the fewest bytes that hold its integers, and their width."""
    most = int(np.abs(x).max()) if x.size else 0
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return x.astype(f"<i{width}").tobytes(), width


def _panels(dims: int, limit: int, windows: bool):
    """Rows of one block as a panel a chunk; the first chunk's carries ids and labels (and the anchors' windows)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["id"].to_numpy(zero_copy_only=False) if not table["id"].null_count else table["id"].fill_null(0).to_numpy()
        lost = table["id"].is_null().to_numpy()
        order = np.lexsort((table["rid"].to_numpy(), ids, lost))
        lists = table["x"].combine_chunks()
        flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        x = np.zeros((len(size), dims), np.int64)
        x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.clip(flat, -limit, limit)
        x = x[order]
        meta = [np.ascontiguousarray(table[c].to_numpy()[order] if c != "id" else ids[order]).astype("<i8") for c in ("rid", "id", "label")] + [lost[order].astype("<i8")]
        if windows:
            slots = table["scores"].combine_chunks()
            p = np.full((len(slots), 5), _NONE, np.int64)
            n = np.diff(slots.offsets.to_numpy())
            p[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = slots.flatten().to_numpy()
            meta += list(p[order].T)
        head = np.concatenate(meta).astype("<i8").tobytes()
        rows = [(table["block"][0].as_py(), table["grp"][0].as_py(), k, len(order), *_narrow(x[:, k * CHUNK : (k + 1) * CHUNK]), head if k == 0 else b"") for k in range(-(-dims // CHUNK))]
        return pa.table(dict(zip(("block", "grp", "chunk", "n", "panel", "width", "head"), map(list, zip(*rows)))), schema=_PANEL)

    return run


_PANEL = pa.schema([("block", pa.int64()), ("grp", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("panel", pa.binary()), ("width", pa.int32()), ("head", pa.binary())])
_PANEL_SQL = "block long, grp int, chunk int, n int, panel binary, width int, head binary"
_TILE_SQL = "a long, b long, chunk int, na int, nb int, tile binary, ahead binary, bhead binary"


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly, in 64-bit integers: by floating point where every sum fits its 53 bits."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            a = np.frombuffer(r["apanel"], f"<i{r['awidth']}").reshape(r["na"], -1)
            b = np.frombuffer(r["bpanel"], f"<i{r['bwidth']}").reshape(r["nb"], -1)
            out = {k: [r[k]] for k in ("a", "b", "chunk", "na", "nb")} | {"tile": [product(a, b).tobytes()], "ahead": [r["ahead"]], "bhead": [r["bhead"]]}
            yield pa.RecordBatch.from_pydict(out, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("chunk", pa.int32()), ("na", pa.int32()), ("nb", pa.int32()), ("tile", pa.binary()), ("ahead", pa.binary()), ("bhead", pa.binary())]))


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whole tile, and what the first chunk's panels say of its anchors and rows."""
    na, nb = table["na"][0].as_py(), table["nb"][0].as_py()
    tile, ahead, bhead = np.zeros((na, nb), np.int64), b"", b""
    for t, a, b in zip(table["tile"], table["ahead"], table["bhead"]):
        tile += np.frombuffer(t.as_buffer(), np.int64).reshape(na, nb)
        ahead, bhead = ahead or a.as_py(), bhead or b.as_py()
    return tile, np.frombuffer(ahead, "<i8").reshape(-1, na), np.frombuffer(bhead, "<i8").reshape(-1, nb)


def _ranked(tile: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in falling order of score; a block's rows are ordered by id, so a stable order breaks ties. Others come last."""
    low = np.where(ok, -tile, np.iinfo(np.int64).max)
    order = np.argsort(low, axis=1, kind="stable")
    return order, np.take_along_axis(low, order, 1)


def _positives(each: int):
    def run(table: pa.Table) -> pa.Table:
        tile, a, b = _summed(table)
        order, low = _ranked(tile, (a[2][:, None] == b[2][None, :]) & (a[0][:, None] != b[0][None, :]))
        order, low = order[:, :each], low[:, :each]
        i, j = np.nonzero(low != np.iinfo(np.int64).max)
        row = order[i, j]
        return pa.table({"anchor": a[0][i], "rid": b[0][row], "id": pa.array(b[1][row], mask=b[3][row] == 1), "score": -low[i, j]})

    return run


def _negatives(each: int, least: tuple[int, int]):
    over, under = least

    def run(table: pa.Table) -> pa.Table:
        tile, a, b = _summed(table)
        order, low = _ranked(tile, a[2][:, None] != b[2][None, :])
        i, j, slot = [], [], []
        for s in range(5):
            p = a[4 + s]
            first = (low < -p[:, None]).sum(1)  # rows that score more than the positive
            at = first[:, None] + np.arange(each)[None, :]
            inside = np.minimum(at, low.shape[1] - 1)
            score = np.take_along_axis(low, inside, 1)
            hit = (at < low.shape[1]) & (score != np.iinfo(np.int64).max) & (p != _NONE)[:, None]
            hit[hit] = (over * np.broadcast_to(p[:, None], hit.shape)[hit]) <= (-under * score[hit])
            x, y = np.nonzero(hit)
            i.append(x), j.append(inside[x, y]), slot.append(np.full(len(x), s + 1))
        i, j, slot = (np.concatenate(v) for v in (i, j, slot))
        row = order[i, j]
        return pa.table({"anchor": a[0][i], "slot": pa.array(slot, pa.int32()), "rid": b[0][row], "id": pa.array(b[1][row], mask=b[3][row] == 1), "score": -low[i, j]})

    return run


Counts = dict[int, int]


def _lookup(table: Counts, key: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for item in table.items() for v in item)), F.col(key)) if table else F.lit(None).cast("int")


def _blocks(rows: DataFrame, size: int, group: Column, name: str, dims: int, limit: int, windows: bool = False) -> tuple[DataFrame, Counts]:
    """Panels of ``rows`` in blocks of about ``size`` rows of one group, and each group's number of blocks. At most GROUPS counts come to the driver."""
    rows = rows.withColumn("grp", group.cast("int"))
    of = {r["grp"]: -(-r["n"] // size) for r in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, total = {}, 0
    for g in sorted(of):
        first[g], total = total, total + of[g]
    block = (_lookup(first, "grp") + F.pmod(F.xxhash64("rid"), _lookup(of, "grp"))).cast("long")
    return stash(rows.withColumn("block", block).groupBy("block").applyInArrow(_panels(dims, limit, windows), _PANEL_SQL), name), of


def _tiles(anchors: DataFrame, rows: DataFrame, anchor_blocks: Counts, row_blocks: Counts) -> DataFrame:
    """Partial tiles of every anchor block with every row block of its group.

    The grid: a group's anchor blocks are dealt into parts, its row blocks too; a panel goes to all cells of its part, so each cell
    holds at most about CELL panels of either side in one chunk, and a group of any size is spread over as many cells as it needs.
    """
    up, across = ({g: max(1, -(-n // CELL)) for g, n in x.items()} for x in (anchor_blocks, row_blocks))
    places = lambda table: F.explode(F.sequence(F.lit(0), _lookup(table, "grp") - 1))
    side = lambda df, own, other, parts, x: df.select(
        "grp", "chunk", F.col("block").alias(x), F.col("n").alias(f"n{x}"), F.col("panel").alias(f"{x}panel"), F.col("width").alias(f"{x}width"), F.col("head").alias(f"{x}head"), F.pmod("block", _lookup(parts, "grp")).cast("int").alias(own),
    ).select("*", places(across if x == "a" else up).alias(other))
    met = side(anchors, "row", "column", up, "a").join(side(rows, "column", "row", across, "b"), ["grp", "row", "column", "chunk"])
    return met.select("a", "b", "chunk", "na", "nb", "apanel", "awidth", "ahead", "bpanel", "bwidth", "bhead").mapInArrow(tidy(_multiply), _TILE_SQL)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, margin: tuple[int, int] = (4, 5), scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of each anchor and positive.

    Anchors are rows whose id is divisible by ``every``; their positives are the first ``positives`` (at most five) other rows
    of their label, by falling score, then rising id. For each, the first ``negatives`` rows of other labels are returned that score
    at most as much as the positive and at least margin[0] / margin[1] of it.

    Rows with a null label, a null vector or a null or non-finite component take no part. Rows with a null id take part but are
    never anchors, and come last among ties; repeated rows and repeated ids are rows of their own. Missing components of a
    shorter vector are zero; an empty vector scores zero. Components are held within the square root of 2**63 / (5 * components),
    so that no sum overflows. An empty table, or one without anchors, gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    with arrow_batches(spark, "8m"):
        rows = integers(vectors, scale, id_col, label_col, vector_col)
        dims = max(1, rows.agg(F.max(F.size("x"))).first()[0] or 1)
        limit = int((((1 << 63) - 1) // (max(margin) * dims)) ** 0.5) - 1
        by_label = F.pmod(F.xxhash64("label"), F.lit(GROUPS))
        right, row_blocks = _blocks(rows, ROWS, by_label, "rows", dims, limit)
        anchors = rows.filter(F.col("id") % every == 0)
        left, anchor_blocks = _blocks(anchors, ANCHORS, by_label, "anchors", dims, limit)
        found = _tiles(left, right, anchor_blocks, row_blocks).groupBy("a", "b").applyInArrow(_positives(positives), "anchor long, rid long, id long, score long")
        best = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
        first = stash(found.withColumn("slot", F.row_number().over(best)).filter(F.col("slot") <= positives), "positives")
        # a window of a positive that scores less than nothing is empty
        scores = first.filter("score >= 0").groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "score"))), lambda e: e["score"]).alias("scores"))
        left, anchor_blocks = _blocks(anchors.join(scores, F.col("rid") == F.col("anchor")).drop("anchor"), ANCHORS, F.lit(0), "windows", dims, limit, windows=True)
        met = _tiles(left, right.withColumn("grp", F.lit(0)), anchor_blocks, {0: sum(row_blocks.values())}).groupBy("a", "b").applyInArrow(_negatives(negatives, margin), "anchor long, slot int, rid long, id long, score long")
        best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
        hard = stash(met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives), "negatives")
    pairs = first.select("anchor", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "slot"])
    names = anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    return out.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
