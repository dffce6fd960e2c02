"""Most similar vectors of every vector, by additive quantisation.

A vector is encoded by beam search as a sum of codewords, one from each of several full-dimensional codebooks fitted to
the residuals of the ones before; the norm of the sum and its inner product with the vector are stored beside the codes.
A query is scored against codes through a table of its inner products with all codewords (one lookup per codebook), and
what passes is reranked by exact cosine. The first codebook also deals the vectors to cells: each asks and can be found
in its two nearest and in all others whose cost is nearly as low, up to `MOST_SPREAD`; how near is chosen on vectors held
out from the fit so that it is `spread` cells in the mean. So a vector between many cells is dealt to more of them, and a
pair meets as soon as any one cell is common to both. Inside a cell all vectors share that direction, so scores there
(and the stored norm and product) are of the sum without the first codeword, which tells them apart; every pair whose
score lies within `SIGMAS` deviations of the least cosine is compared exactly, however many they are. The number of cells
follows the number of vectors, so that a cell keeps its size; a cell far larger than others is cut into tiles of queries
by vectors, and no task holds a whole cell.

Fitting takes a sample of at most `FIT_ROWS` vectors (8 for each cell if that is more, at most `MOST_FIT_ROWS`); all
vectors are encoded and searched.

Defined results: null vectors and those of another dimension, with NaN or infinite values or of zeros only take no part;
vectors need not be of unit length; rows repeated for one id count once; no vector is its own neighbour, another id with
an equal vector is; ties go to the smaller id; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOOKS, WORDS, BEAM = 8, 256, 4
FIT_ROWS, MOST_FIT_ROWS, CELL_ROWS, LEAST_CELLS, FIRST_CELLS, ROUNDS = 16_384, 65_536, 512, 4, 16_384, 5
#: Cells of a vector in the mean, at least and at most; rows of a tile's side among blocks and in a cell.
SPREAD, LEAST_SPREAD, MOST_SPREAD, TILE, CELL_TILE = 3, 2, 8, 4096, 16_384
#: Deviations by which the score of a pair from codes may fall short of the one expected at the least cosine.
SIGMAS = 4
#: Cells may grow to so many times CELL_ROWS before a second codebook parts them, which parts near copies more often.
GROWN = 4
#: Vectors of a tile that are compared exactly with a query where no least cosine is asked for (with equal scores the smaller
#: id goes first): for each of its k places, the share of a tile, and the least number.
FEW, RERANK_SHARE, RERANK_LEAST = 8, 0.05, 64
#: Scores of rows by words that are held at once in encoding.
SCORES = 1 << 22
#: Rows that a task of the search reads (about 7 MB of vectors), so that tasks grow in number and not in size; beyond MOST_TASKS tasks up to 32 times as many.
TASK_ROWS, MOST_TASKS = 4096, 20_000


def clean(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors and the vectors at unit length."""
    sizes = np.diff(column.offsets.to_numpy())
    valid = (sizes == dim) & ~column.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(valid)
    begin = column.offsets.to_numpy()[:-1][rows]
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    x = flat[(begin[:, None] + np.arange(dim)).ravel()].reshape(-1, dim) if len(rows) else np.zeros((0, dim), np.float32)
    x = x.astype(np.float64)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], (x[good] / norm[good, None]).astype(np.float32)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    rows = max(64, SCORES // k)
    for step in range(ROUNDS + 1):
        half = 0.5 * (words * words).sum(1)
        own = np.concatenate([(x[a : a + rows] @ words.T - half).argmax(1) for a in range(0, len(x), rows)])
        if step < ROUNDS:
            order = np.argsort(own, kind="stable")
            used, begin = np.unique(own[order], return_index=True)
            words[used] = np.add.reduceat(x[order], begin, axis=0) / np.diff(np.append(begin, len(x)))[:, None]
    return words, own


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n highest scores of each row, the highest first."""
    n = min(n, score.shape[1])
    top = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.tile(np.arange(n), (len(score), 1))
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)


class Quantiser:
    """Codebooks, their inner products, the words that part the cells of the first one, and the salts of cells that need more than one."""

    def __init__(self, sample: np.ndarray, cells: int, total: int, tile: int, seed: int = 1, first_cells: int = FIRST_CELLS, spread: int = SPREAD):
        rng = np.random.default_rng(seed)
        apart = min(2048, len(sample) // 8)  # fitted vectors lie nearer to their words than others do
        judged, rest = sample[:apart] if apart >= 8 else sample, sample[apart if apart >= 8 else 0 :].copy()
        self.books, self.parts = [], None
        first = min(cells, first_cells)
        for m in range(BOOKS):
            words, own = _means(rest, first if m == 0 else WORDS, rng)
            self.books.append(words)
            rest = rest - words[own]
            if m == 0 and cells > first:
                self.parts = _means(rest, min(first_cells, -(-cells // first)), rng)[0]
        self.norms = [(b * b).sum(1) for b in self.books]
        self.gram = {(j, m): 2 * self.books[j] @ self.books[m].T for m in range(BOOKS) for j in range(m)}
        _, cost = self._near(judged, MOST_SPREAD)
        gap = np.sort((cost[:, :1] - cost)[:, LEAST_SPREAD:], axis=None)
        more = int((spread - LEAST_SPREAD) * len(judged))
        self.gap = float(gap[min(more, len(gap) - 1)]) if len(gap) and more > 0 else -1.0
        cell, n = np.unique(self.cells(sample), return_counts=True)  # a cell may be the second choice of many
        cell, n = cell[cell >= 0], n[cell >= 0]
        salts = np.ceil(n / len(sample) * total / tile).astype(np.int64)
        self.total = total
        self.salts = {int(c): int(s) for c, s in zip(cell, salts) if s > 1}

    def nearest_cells(self, x: np.ndarray, spread: int) -> np.ndarray:
        """Numbers of the nearest cells of each vector, the nearest first."""
        return self._near(x, spread)[0]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the cells of each vector, the nearest first, filled up with -1."""
        cell, cost = self._near(x, MOST_SPREAD)
        take = cost[:, :1] - cost <= self.gap
        take[:, :LEAST_SPREAD] = True
        return np.where(take, cell, -1)

    def _near(self, x: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cells and by how much half the squared distance to each is lower than to the origin."""
        rows = max(64, SCORES // len(self.books[0]))
        parts = [self._near_rows(x[a : a + rows], spread) for a in range(0, max(1, len(x)), rows)]
        return np.concatenate([c for c, _ in parts]), np.concatenate([c for _, c in parts])

    def _near_rows(self, x: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray]:
        score = x @ self.books[0].T - 0.5 * self.norms[0]
        first = _best(score, spread)
        if self.parts is None:
            return first, np.take_along_axis(score, first, 1)
        norms = 0.5 * (self.parts * self.parts).sum(1)
        cells, costs = [], []
        for place in range(first.shape[1]):
            own = first[:, place]
            near = (x - self.books[0][own]) @ self.parts.T - norms
            part = _best(near, spread)
            cells.append(own[:, None] * len(self.parts) + part)
            # |x - word - part|^2 = |x - word|^2 - 2 near
            costs.append(np.take_along_axis(near, part, 1) + np.take_along_axis(score, own[:, None], 1))
        cell, cost = np.concatenate(cells, 1), np.concatenate(costs, 1)
        best = _best(cost, spread)
        return np.take_along_axis(cell, best, 1), np.take_along_axis(cost, best, 1)

    def encode(self, x: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes by beam search; norms of the sums from codebook `skip` on, and inner products of the unit sums with the vectors."""
        rows = max(64, SCORES // len(self.books[0]))
        parts = [self._encode_rows(x[a : a + rows], skip) for a in range(0, max(1, len(x)), rows)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _encode_rows(self, x: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(x)
        codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for m, book in enumerate(self.books):
            step = np.repeat((self.norms[m] - 2 * (x @ book.T))[:, None, :], codes.shape[1], 1)
            for j in range(m):
                step += self.gram[j, m][codes[:, :, j]]
            total = (cost[:, :, None] + step).reshape(n, -1)
            width = min(BEAM, total.shape[1])
            at = np.argpartition(total, width - 1, axis=1)[:, :width]
            cost = np.take_along_axis(total, at, 1)
            parent, word = at // len(book), at % len(book)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None].repeat(m, 2), 1), word[:, :, None]], 2)
        best = codes[np.arange(n), cost.argmin(1)]
        sums = sum(book[best[:, m]] for m, book in enumerate(self.books) if m >= skip)
        norm = np.maximum(np.sqrt((sums * sums).sum(1)), 1e-9)
        return best.astype(np.uint16), norm.astype(np.float32), ((x * sums).sum(1) / norm).astype(np.float32)

    def scores(self, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, skip: int = 0) -> np.ndarray:
        """Inner products of queries with the unit sums behind the codes, by table lookups."""
        out = np.zeros((len(x), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            if m >= skip:
                out += np.take(x @ book.T, codes[:, m], axis=1)
        return out / norm


def _salt(ids: list, salts: int) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(str(i).encode()) % salts for i in ids], np.int64)


FIELDS = ["key", "role", "id", "vec", "codes", "norm", "fit"]
QUERY, INDEX = 1, 2


def _rows(key, role, at, ids: pa.Array, x, codes, norm, fit) -> pa.RecordBatch:
    at = np.asarray(at, np.int64)
    vec = pa.array([v.tobytes() for v in x[at]], pa.binary())
    code = pa.array([c.tobytes() for c in codes[at]], pa.binary())
    columns = [pa.array(key, pa.int64()), pa.array(role, pa.int32()), ids.take(pa.array(at)), vec, code, pa.array(norm[at]), pa.array(fit[at])]
    return pa.RecordBatch.from_arrays(columns, FIELDS)


def _deal_cells(batches: Iterator[pa.RecordBatch], model: Quantiser, dim: int) -> Iterator[pa.RecordBatch]:
    """Each vector to its tiles, with its codes."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 2048):
            batch = whole.slice(begin, 2048)
            rows, x = clean(batch.column(1), dim)
            if not len(rows):
                continue
            ids = batch.column(0).take(pa.array(rows))
            names = ids.to_pylist()
            cells = model.cells(x)
            at, key, role = [], [], []
            for i, own in enumerate(cells.tolist()):
                for cell in own:
                    if cell < 0:
                        continue
                    s = model.salts.get(cell, 1)
                    mine = int(_salt(names[i : i + 1], s)[0]) if s > 1 else 0
                    # role INDEX in tiles (any query block, mine), role QUERY in tiles (mine, any index block)
                    tiles = {(q, mine): INDEX for q in range(s)}
                    for d in range(s):
                        tiles[mine, d] = tiles.get((mine, d), 0) | QUERY
                    for (q, d), r in tiles.items():
                        at.append(i)
                        key.append((cell << 36) | (q << 18) | d)
                        role.append(r)
            yield _rows(key, role, at, ids, x, *model.encode(x, 1))


def _deal_blocks(batches: Iterator[pa.RecordBatch], model: Quantiser, dim: int, query_blocks: int, index_blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector, is_query): queries to every block of vectors, vectors to every block of queries."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 2048):
            batch = whole.slice(begin, 2048)
            rows, x = clean(batch.column(1), dim)
            if not len(rows):
                continue
            ids = batch.column(0).take(pa.array(rows))
            names, asks = ids.to_pylist(), batch.column(2).take(pa.array(rows)).to_pylist()
            qs, ds = _salt(names, query_blocks), _salt(names, index_blocks)
            at, key, role = [], [], []
            for i, ask in enumerate(asks):
                tiles = {(q, int(ds[i])): INDEX for q in range(query_blocks)}
                if ask:
                    for d in range(index_blocks):
                        tiles[int(qs[i]), d] = tiles.get((int(qs[i]), d), 0) | QUERY
                for (q, d), r in tiles.items():
                    at.append(i)
                    key.append((q << 20) | d)
                    role.append(r)
            yield _rows(key, role, at, ids, x, *model.encode(x))


def _search_tile(table: pa.Table, model: Quantiser, dim: int, k: int, least: float | None) -> Iterator[pa.RecordBatch]:
    ids = table.column("id").to_numpy(zero_copy_only=False)
    _, first = np.unique(ids.astype(str), return_index=True)
    role = table.column("role").to_numpy()[first]
    ids = ids[first]
    raw = table.column("vec").take(pa.array(first)).to_pylist()
    x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim)
    codes = np.frombuffer(b"".join(table.column("codes").take(pa.array(first)).to_pylist()), np.uint16).reshape(-1, BOOKS)
    norm, fit = (table.column(c).to_numpy()[first] for c in ("norm", "fit"))
    d = np.flatnonzero(role & INDEX)
    asks = np.flatnonzero(role & QUERY)
    if not len(d) or not len(asks):
        return
    if least is not None:
        d = d[_copies([raw[i] for i in d]) <= k]  # of equal vectors the first k besides the query itself
        bound = least * fit - SIGMAS * np.sqrt((1 - least * least) * np.maximum(1 - fit * fit, 0) / dim)
    for begin in range(0, len(asks), QUERIES):
        q = asks[begin : begin + QUERIES]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for block in range(0, len(d), TILE):
            own = d[block : block + TILE]
            if least is not None:
                a, b = _near_enough(x, q, own, model.scores(x[q], codes[own], norm[own], 1) >= bound[own], k, least)
            else:
                take = max(RERANK_LEAST, FEW * k, int(RERANK_SHARE * len(own))) + 1  # the query itself may be among them
                a, b = best_scored(model.scores(x[q], codes[own], norm[own]), take)
                a, b = q[a], own[b]
                a, b = a[a != b], b[a != b]
            exact = np.concatenate([np.einsum("ij,ij->i", x[a[s : s + 20_000]], x[b[s : s + 20_000]], dtype=np.float64) for s in range(0, len(a), 20_000)] or [np.zeros(0)])
            keep = exact >= (least - 1e-7 if least is not None else -np.inf)
            found.append((a[keep], b[keep], exact[keep]))
        a, b, exact = (np.concatenate(part) for part in zip(*found))
        # ids ascend with their position, so position breaks ties
        order = np.lexsort((b, -np.round(exact, 9), a))
        a, b, exact = a[order], b[order], exact[order]
        start = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
        keep = place < k
        yield pa.RecordBatch.from_arrays([pa.array(ids[a[keep]]), pa.array(ids[b[keep]]), pa.array(exact[keep])], ["id", "other", "cosine"])


#: Queries of a tile that are scored at once; what a cosine of single precision may be off.
QUERIES, ROUGH = 256, 1e-5


def _copies(raw: list[bytes]) -> np.ndarray:
    """How many equal vectors stand before each."""
    seen: dict[bytes, int] = {}
    out = np.empty(len(raw), np.int64)
    for i, v in enumerate(raw):
        out[i] = seen[v] = seen.get(v, -1) + 1
    return out


def _near_enough(x: np.ndarray, q: np.ndarray, own: np.ndarray, passed: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the vectors that passed and may be among its k most similar ones, by cosines of single precision."""
    a, b = [], []
    for i, row in zip(q, passed):
        cols = own[row]
        cols = cols[cols != i]
        rough = x[cols] @ x[i]
        near = rough >= least - ROUGH
        cols, rough = cols[near], rough[near]
        if len(cols) > k:
            cols = cols[rough >= np.partition(rough, -k)[-k] - 2 * ROUGH]
        a.append(np.full(len(cols), i))
        b.append(cols)
    return np.concatenate(a), np.concatenate(b)


def best_scored(score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the n highest finite scores of each row; of equal ones those that come first."""
    if n < score.shape[1]:
        least = np.partition(score, -n, axis=1)[:, -n, None]
        above, equal = score > least, score == least
        take = above | (equal & (np.cumsum(equal, axis=1) <= n - above.sum(1, keepdims=True)))
        return np.nonzero(take & np.isfinite(score))
    return np.nonzero(np.isfinite(score))


def _search(batches: Iterator[pa.RecordBatch], model: Quantiser, dim: int, k: int, least: float | None, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Tiles, in the order of their keys; the last one of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []

    def run(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _search_tile(pa.Table.from_batches(parts), model, dim, k, least):
            yield pa.RecordBatch.from_arrays([out.column(0).cast(kind), out.column(1).cast(kind), out.column(2)], out.schema.names)

    for batch in batches:
        keys = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if held and held[-1].column(0)[0].as_py() != keys[a]:
                yield from run(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from run(held)


def fit(src: DataFrame, dim: int, tile: int = TILE, cells: int | None = None, first_cells: int = FIRST_CELLS, spread: int = SPREAD) -> Quantiser | None:
    """Codebooks from a bounded sample of rows (id, vec), chosen by the hash of their ids."""
    total = src.count()
    if not total:
        return None
    if not cells:
        cells = int(max(LEAST_CELLS, 2 ** round(np.log2(max(1, total / CELL_ROWS)))))
        cells = first_cells if first_cells < cells <= GROWN * first_cells else cells
    wanted = max(FIT_ROWS, min(8 * min(cells, first_cells), MOST_FIT_ROWS))
    # the smallest hashes, in their order: the same sample however the rows lie in files
    order = F.xxhash64("id")
    share = min(1.0, 1.2 * wanted / total)
    near = src.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = near.orderBy(F.pmod(order, F.lit(1 << 30)), "id").select("vec").limit(wanted).toArrow()
    column = sample.column(0).combine_chunks()
    _, x = clean(column, dim)
    return Quantiser(x, cells, total, tile, first_cells=min(first_cells, len(x)), spread=spread) if len(x) else None


def _tasks(dealt: DataFrame, rows: int) -> DataFrame:
    """Dealt rows in the order of their tiles, in tasks of a bounded number of rows."""
    tasks = min(-(-rows // TASK_ROWS), max(MOST_TASKS, -(-rows // (32 * TASK_ROWS))))
    return dealt.repartition(max(tasks, dealt.sparkSession.sparkContext.defaultParallelism), "key").sortWithinPartitions("key")


EMPTY = "id {kind}, other {kind}, cosine double"
DEALT = "key bigint, role int, id {kind}, vec binary, codes binary, norm float, fit float"


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def _source(df: DataFrame, id_col: str, vec_col: str, dim: int) -> tuple[DataFrame, str]:
    kind = df.schema[id_col].dataType.simpleString()
    src = df.filter(F.col(id_col).isNotNull() & (F.size(vec_col) == dim))
    return src.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec")), kind


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("id").orderBy(F.round("cosine", 9).desc(), "other")
    return found.groupBy("id", "other").agg(F.max("cosine").alias("cosine")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def nearest(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, least: float = 0.8, spread: int = SPREAD, tile: int = CELL_TILE, cells: int | None = None, first_cells: int = FIRST_CELLS) -> DataFrame:
    """(id, other, cosine, place): the up to k most similar others of every vector with a cosine of at least `least`."""
    src, kind = _source(df, id_col, vec_col, dim)
    model = fit(src, dim, tile, cells, first_cells, spread)
    if model is None:
        return src.sparkSession.createDataFrame([], EMPTY.format(kind=kind) + ", place int")
    arrow = _arrow(kind)
    dealt = src.mapInArrow(lambda it: _deal_cells(it, model, dim), DEALT.format(kind=kind))
    found = _tasks(dealt, model.total * spread).mapInArrow(lambda it: _search(it, model, dim, k, least, arrow), EMPTY.format(kind=kind))
    both = F.explode(F.array(F.struct("id", "other"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"))))
    return _ranked(found.select(both.alias("p"), "cosine").select("p.*", "cosine"), k)


def nearest_of(df: DataFrame, is_query, id_col: str, vec_col: str, dim: int, k: int = 5, tile: int = TILE) -> DataFrame:
    """(id, other, cosine, place): the k most similar others of the rows for which is_query holds, among all rows, in blocks."""
    kind = df.schema[id_col].dataType.simpleString()
    flagged = df.filter(F.col(id_col).isNotNull() & (F.size(vec_col) == dim))
    flagged = flagged.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    model = fit(flagged.select("id", "vec"), dim, tile)
    if model is None:
        return df.sparkSession.createDataFrame([], EMPTY.format(kind=kind) + ", place int")
    counts = flagged.agg(F.count("*").alias("n"), F.count_if("ask").alias("q")).first()
    query_blocks, index_blocks = -(-max(1, counts.q) // tile), -(-counts.n // tile)
    arrow = _arrow(kind)
    dealt = flagged.mapInArrow(lambda it: _deal_blocks(it, model, dim, query_blocks, index_blocks), DEALT.format(kind=kind))
    found = _tasks(dealt, counts.n * query_blocks + counts.q * index_blocks).mapInArrow(lambda it: _search(it, model, dim, k, None, arrow), EMPTY.format(kind=kind))
    return _ranked(found, k)
