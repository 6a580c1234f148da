"""Truncated SVD of a sparse matrix by randomised subspace iteration over blocks of rows in shared files.

The matrix and its transpose are written once, a file for each block of rows, with the cells in order of their block of columns.
A product is one task a block of rows: it reads the blocks of the dense factor one after the other and writes its rows of the
result.  Orthonormalising takes a small matrix only, which the next product applies to its own result.  The driver holds the
names and places of blocks and matrices of dimensions squared; no task holds more than two dense blocks.

Co-occurrences need no cells: with B, how often a word stands in a sentence, and D, how often at all, they are B'B - D (Folded).
A product then goes through the sentences' words, whose number is in proportion to the text, and not through pairs of words.
"""

from __future__ import annotations

import re
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .annotate import _differs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: As in the original: further dimensions that are iterated, rounds, seed.
OVER, ROUNDS, SEED = 10, 7, 42
#: Blocks that a matrix is cut into, and the least and most rows of one; cells that are written, and multiplied, at once.
BLOCKS, LEAST, MOST = 16, 256, 1 << 15
CHUNK, STEP = 1 << 18, 1 << 14
#: Words of sentences, one counted once a sentence, in a block of sentences, and as many as are multiplied at once.
CELLS, TOGETHER = 1 << 21, 1 << 11
#: Expressions of a sentence that meet as many as TOGETHER of its words at once, and those whose vectors are summed before they are dealt.
PAIRS, DEALT = 1 << 9, 1 << 13
#: Singular values under this share of the largest are taken for zero.
ZERO = 1e-9


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """Where the path lies; local files are mapped, so that what is not looked at is not copied."""
    where, base = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return (fs.LocalFileSystem(use_mmap=True) if isinstance(where, fs.LocalFileSystem) else where), base


def _read(f: pa.NativeFile, at: int, size: int, kind: type) -> np.ndarray:
    f.seek(at)
    return np.frombuffer(f.read_buffer(size), kind)


def shared(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent in a session of one process, as in tests, a folder of /tmp takes its place; a cluster must set it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives a lost executor."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clustered(df: DataFrame, name: str, partitions: int, *keys: str) -> DataFrame:
    """kept(), in `partitions` buckets by the hash of keys: what is grouped or joined by keys (and more) later needs no shuffle.

    df had better lie in as many partitions by these keys already, as after repartition(partitions, *keys): each task then writes one
    file.  A bucketed table has to stand in the session's catalog, under a name of its own; its files lie in the shared folder.
    """
    spark = df.sparkSession
    path = shared(spark, name)
    table = re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    df.write.bucketBy(partitions, *keys).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with `id`: its rows' numbers from 0, in their order.  The rows are written first, so that the numbers stay."""
    bits = 33  # of a row's place in its partition, in what Spark gives out
    rows = kept(df.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", bits))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))  # a row a partition
    place = F.col("_at") - F.shiftleft("_part", bits)
    return rows.join(F.broadcast(first), "_part").select(*df.columns, (F.col("_first") + place).alias("id"))


def _size(n: int) -> int:
    return min(max(-(-n // BLOCKS), LEAST), MOST)


def _cells(top: str):
    """Write cells that come in order of (ib, jb, i): a file for each ib; reports (ib, jb, file, at, n) of each piece."""

    def run(batches):
        where, base = _opened(top)
        out, name, at, now, held, n = None, "", 0, None, [], 0

        def piece():
            nonlocal at, held, n
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            raw = b"".join(x.tobytes() for x in whole)
            out.write(raw)
            row = pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([name]), pa.array([at], pa.int64()), pa.array([n], pa.int64())], ["ib", "jb", "file", "at", "n"])
            at, held, n = at + len(raw), [], 0
            return row

        try:
            for b in batches:
                ib, jb, i, j, v = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
                cut = [0, *(np.flatnonzero((np.diff(ib) != 0) | (np.diff(jb) != 0)) + 1).tolist(), len(ib)]
                for s, e in zip(cut, cut[1:], strict=False):
                    if s == e:
                        continue
                    key = (int(ib[s]), int(jb[s]))
                    if held and (key != now or n >= CHUNK):
                        yield piece()
                    if now is None or key[0] != now[0]:
                        if out is not None:
                            out.close()
                        name, at = f"cells-{uuid.uuid4().hex}", 0
                        out = where.open_output_stream(f"{base}/{name}", compression=None)
                    now = key
                    held.append((i[s:e].astype(np.int32), j[s:e].astype(np.int32), v[s:e].astype(np.float64)))
                    n += e - s
            if held:
                yield piece()
        finally:
            if out is not None:
                out.close()

    return run


class Sparse:
    """Cells (i, j, v) of a matrix of `height` by `width`, written in blocks."""

    def __init__(self, cells: DataFrame, height: int, width: int, top: str) -> None:
        self.height, self.size, self.spark, self.top = height, _size(height), cells.sparkSession, top
        across = _size(width)
        self.blocks = -(-height // self.size)
        where, base = _opened(top)
        where.create_dir(base, recursive=True)
        part = lambda c, s: F.floor(F.col(c) / s).cast("int")
        keyed = cells.select(part("i", self.size).alias("ib"), part("j", across).alias("jb"), F.pmod("i", F.lit(self.size)).cast("int").alias("i"), F.pmod("j", F.lit(across)).cast("int").alias("j"), F.col("v").cast("double").alias("v"))
        dealt = keyed.repartitionByRange(self.blocks, "ib").sortWithinPartitions("ib", "jb", "i")
        self.pieces: dict[int, list] = {}
        for r in dealt.mapInArrow(_cells(top), "ib int, jb int, file string, at long, n long").collect():  # places of pieces
            self.pieces.setdefault(r["ib"], []).append((r["jb"], r["at"], r["n"], r["file"]))

    def times(self, dense: Dense, turn: np.ndarray | None) -> tuple[Dense, np.ndarray]:
        """The product with dense @ turn, and the product's Gram matrix."""
        top, height, size, factor, columns = self.top, self.height, self.size, dense, dense.columns

        def block(task):
            ib, pieces = task
            where, base = _opened(top)
            acc, have, q = np.zeros((min(size, height - ib * size), columns)), None, None
            for jb, at, n, name in sorted(pieces):
                if jb != have:
                    have, q = jb, factor.read(jb)
                with where.open_input_file(f"{base}/{name}") as f:
                    raw = f.read_at(16 * n, at)
                i, j, v = np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.int32, n, 4 * n), np.frombuffer(raw, np.float64, n, 8 * n)
                for s in range(0, n, STEP):
                    rows = i[s : s + STEP]
                    starts = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
                    part = q[j[s : s + STEP]]
                    part *= v[s : s + STEP, None]
                    acc[rows[starts]] += np.add.reduceat(part, starts, axis=0)
            acc = acc if turn is None else acc @ turn
            return ib, _put(top, acc), (acc.T @ acc).tobytes()

        tasks = [(b, self.pieces.get(b, [])) for b in range(self.blocks)]
        wide = columns if turn is None else turn.shape[1]
        names, gram = {}, np.zeros((wide, wide))
        for b, name, g in self.spark.sparkContext.parallelize(tasks, len(tasks)).map(block).collect():
            names[b] = name
            gram += np.frombuffer(g).reshape(wide, wide)
        return Dense(top, height, wide, names), gram


def _product(starts: np.ndarray, at: np.ndarray, m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row r of the result is the sum of m * x[at] over the places from starts[r] to starts[r + 1]; rows of one length at once."""
    out = np.zeros((len(starts) - 1, x.shape[1]))
    near, sums, factors = np.empty((TOGETHER, x.shape[1])), np.empty((TOGETHER, 1, x.shape[1])), np.empty(TOGETHER)
    size = np.diff(starts)
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for length, s, e in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        if not length:
            continue
        if length > TOGETHER:
            for r in order[s:e]:
                for p in range(starts[r], starts[r + 1], TOGETHER):
                    q = slice(p, min(p + TOGETHER, starts[r + 1]))
                    out[r] += m[q].astype(np.float64) @ x[at[q]]
            continue
        step = TOGETHER // length
        for k in range(s, e, step):
            some = order[k : min(k + step, e)]
            n = len(some) * length
            places = (starts[some][:, None] + np.arange(length)).ravel()
            each, by = near[:n], factors[:n]
            np.take(x, at[places], axis=0, out=each, mode="clip")
            by[:] = m[places]
            if length == 1:
                each *= by[:, None]
                out[some] = each
            else:
                out[some] = np.matmul(by.reshape(-1, 1, length), each.reshape(-1, length, x.shape[1]), out=sums[: len(some)])[:, 0]
    return out


#: The arrays of a block of sentences, in the order in which they stand in its file: places of the blocks of words in ids, the
#: numbers of the words, how often each stands there; sentences by words and words by sentences, with how often.
_PARTS = (("cut", np.int64), ("ids", np.int64), ("often", np.float64), ("starts", np.int64), ("at", np.int32), ("m", None), ("starts2", np.int64), ("at2", np.int32), ("m2", None))


def _bagged(top: str, size: int, blocks: int):
    """Rows (sentence keys, id, m), a sentence's behind one another, to a file a partition; reports its name.  Sentences of one token
    leave."""

    def run(batches):
        rows = pa.Table.from_batches(held).combine_chunks() if (held := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        *keys, id_, m = (c.chunk(0) for c in rows.columns)
        new = np.concatenate([[True], np.logical_or.reduce([_differs(k) for k in keys])])
        id_, m = id_.to_numpy(), m.to_numpy()
        sentence = np.cumsum(new) - 1
        some = (np.add.reduceat(m, np.flatnonzero(new)) > 1)[sentence]
        id_, m, sentence = id_[some], m[some], np.unique(sentence[some], return_inverse=True)[1]
        if not len(id_):
            return
        ids, word = np.unique(id_, return_inverse=True)
        m = m.astype(np.min_scalar_type(int(m.max())))
        order = np.argsort(word, kind="stable")
        until = lambda x: np.append(0, np.cumsum(np.bincount(x)))
        out = {"cut": np.searchsorted(ids, np.arange(blocks + 1) * size), "ids": ids, "often": np.bincount(word, m.astype(np.float64)), "starts": until(sentence), "at": word, "m": m, "starts2": until(word), "at2": sentence[order], "m2": m[order]}
        raw = [np.ascontiguousarray(out[k], kind or m.dtype) for k, kind in _PARTS]
        where, base = _opened(top)
        name = f"bags-{uuid.uuid4().hex}"
        with where.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(np.array([m.itemsize, *map(len, raw)], np.int64).tobytes())
            for a in raw:
                f.write(a.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return run


def _bags(top: str, name: str) -> dict[str, np.ndarray]:
    where, base = _opened(top)
    with where.open_input_file(f"{base}/{name}") as f:
        raw = f.read_buffer()
    head, at, out = np.frombuffer(raw, np.int64, 1 + len(_PARTS)), 8 * (1 + len(_PARTS)), {}
    for (k, kind), n in zip(_PARTS, head[1:].tolist(), strict=True):
        kind = np.dtype(kind or f"u{head[0]}")
        out[k] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return out


class Folded:
    """Co-occurrences of `words` words, B'B - D, from rows of sentence keys, id and m (how often the word stands in the sentence).

    Sentences lie in blocks of about CELLS rows, each a file.  A product is one task a block of sentences, which sums up what its
    sentences give each of its words, and one a block of words, which adds up these sums.
    """

    def __init__(self, rows: DataFrame, keys: list[str], words: int, cells: int, top: str) -> None:
        self.height, self.size, self.spark, self.top = words, _size(words), rows.sparkSession, top
        self.blocks = -(-words // self.size)
        where, base = _opened(top)
        where.create_dir(base, recursive=True)
        dealt = rows.select(*keys, F.col("id").cast("long").alias("id"), F.col("m").cast("long").alias("m")).repartition(max(BLOCKS, -(-cells // CELLS)), *keys).sortWithinPartitions(*keys)
        self.names = [r["name"] for r in dealt.mapInArrow(_bagged(top, self.size, self.blocks), "name string").collect()]  # names of files
        self.sums, _ = self.times(Ones(top, words, 1), None)

    def times(self, dense: Dense, turn: np.ndarray | None, over: Dense | None = None, under: Dense | None = None) -> tuple[Dense, np.ndarray]:
        """The product with dense @ turn, and the product's Gram matrix.  over: what divides the rows of dense; under: those of the product."""
        top, height, size, blocks, columns, names = self.top, self.height, self.size, self.blocks, dense.columns, self.names

        def sentences(name):
            b = _bags(top, name)
            x, cut, ids = np.empty((len(b["ids"]), columns)), b["cut"], b["ids"]
            for w in np.flatnonzero(np.diff(cut)).tolist():
                own = ids[cut[w] : cut[w + 1]] - w * size
                x[cut[w] : cut[w + 1]] = dense.read(w)[own]
                if over is not None:
                    x[cut[w] : cut[w + 1]] /= over.read(w)[own]
            t = _product(b["starts"], b["at"], b["m"], x)
            x *= -b["often"][:, None]
            x += _product(b["starts2"], b["at2"], b["m2"], t)
            return name, _put(top, x)

        parts = self.spark.sparkContext.parallelize(names, max(len(names), 1)).map(sentences).collect()  # names of files

        def words(w):
            where, base = _opened(top)
            acc = np.zeros((min(size, height - w * size), columns))
            ahead = 8 * (1 + len(_PARTS))
            for name, part in parts:
                with where.open_input_file(f"{base}/{name}") as f:
                    s, e = _read(f, ahead + 8 * w, 16, np.int64).tolist()
                    ids = _read(f, ahead + 8 * (blocks + 1 + s), 8 * (e - s), np.int64)
                with where.open_input_file(f"{base}/{part}") as f:
                    acc[ids - w * size] += _read(f, 8 * columns * s, 8 * columns * (e - s), np.float64).reshape(-1, columns)
            if under is not None:
                acc /= under.read(w)
            acc = acc if turn is None else acc @ turn
            return w, _put(top, acc), (acc.T @ acc).tobytes()

        wide = columns if turn is None else turn.shape[1]
        files, gram = {}, np.zeros((wide, wide))
        for w, name, g in self.spark.sparkContext.parallelize(range(blocks), blocks).map(words).collect():
            files[w] = name
            gram += np.frombuffer(g).reshape(wide, wide)
        Dense(top, 0, 0, dict(enumerate(p for _, p in parts))).drop()
        return Dense(top, height, wide, files), gram


def _near(folded: Folded, dense: Dense, turn: np.ndarray):
    """Rows (sentence keys, id, m, noun, verb, n, v), a sentence's behind one another, to (noun, verb, vec): of each expression, which has
    n and v as its nouns' and verbs' ids, the sum of its sentences' other words by dense @ turn over the words' sums.  A task's rows are summed in part."""
    size, blocks, sums, columns, wide = folded.size, folded.blocks, folded.sums, dense.columns, turn.shape[1]

    def run(batches):
        rows = pa.Table.from_batches(held).combine_chunks() if (held := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        *keys, id_, m, noun, verb, n, v = (c.chunk(0) for c in rows.columns)
        sentence = np.cumsum(np.concatenate([[True], np.logical_or.reduce([_differs(k) for k in keys])])) - 1
        word = id_.is_valid().to_numpy(zero_copy_only=False)
        pair = np.flatnonzero(~word)
        id_, m, n, v = (x.fill_null(-1).to_numpy() for x in (id_, m, n, v))
        id_, m, n, v, places = id_[word], m[word].astype(np.float64), n[pair], v[pair], pa.array(pair)
        noun, verb = noun.take(places), verb.take(places)
        ends = np.arange(sentence[-1] + 2)
        first, pairs = np.searchsorted(sentence[word], ends), np.searchsorted(sentence[pair], ends)
        ids, at = np.unique(id_, return_inverse=True)
        x, cut = np.empty((len(ids), columns)), np.searchsorted(ids, np.arange(blocks + 1) * size)
        for w in np.flatnonzero(np.diff(cut)).tolist():
            own = ids[cut[w] : cut[w + 1]] - w * size
            x[cut[w] : cut[w + 1]] = dense.read(w)[own] / sums.read(w)[own]

        def summed(found: list[np.ndarray], acc: list[np.ndarray]) -> pa.RecordBatch:
            which, a = np.concatenate(found), np.concatenate(acc)
            order = np.lexsort((v[which], n[which]))
            which = which[order]
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(n[which]) != 0) | (np.diff(v[which]) != 0)]))
            a, names = np.add.reduceat(a[order], starts, axis=0) @ turn, pa.array(which[starts])
            ends = pa.array(np.arange(0, a.size + 1, wide, dtype=np.int32))
            return pa.RecordBatch.from_arrays([noun.take(names), verb.take(names), pa.ListArray.from_arrays(ends, pa.array(a.ravel()))], ["noun", "verb", "vec"])

        found, acc, count = [], [], 0
        for s in np.flatnonzero(np.diff(pairs)).tolist():
            for p in range(pairs[s], pairs[s + 1], PAIRS):
                which = np.arange(p, min(p + PAIRS, pairs[s + 1]))
                near, some = np.zeros((len(which), columns)), np.zeros(len(which), bool)
                for k in range(first[s], first[s + 1], TOGETHER):
                    own = slice(k, min(k + TOGETHER, first[s + 1]))
                    other = (id_[own] != n[which, None]) & (id_[own] != v[which, None])
                    near += (other * m[own]) @ x[at[own]]
                    some |= other.any(axis=1)
                found.append(which[some])
                acc.append(near[some])
                count += len(found[-1])
                if count >= DEALT:
                    yield summed(found, acc)
                    found, acc, count = [], [], 0
        if count:
            yield summed(found, acc)

    return run


def _added(batches):
    """(noun, verb, vec), in order of nouns and verbs, with the vectors of one pair added up."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if last is None else [last, b]).combine_chunks()
        noun, verb, vec = (c.chunk(0) for c in t.columns)
        starts = np.flatnonzero(np.concatenate([[True], _differs(noun) | _differs(verb)]))
        a = np.add.reduceat(vec.flatten().to_numpy().reshape(len(vec), -1), starts, axis=0)
        ends = pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32))
        out = pa.RecordBatch.from_arrays([noun.take(pa.array(starts)), verb.take(pa.array(starts)), pa.ListArray.from_arrays(ends, pa.array(a.ravel()))], ["noun", "verb", "vec"])
        last = out.slice(out.num_rows - 1)
        yield out.slice(0, out.num_rows - 1)
    if last is not None:
        yield last


def near(folded: Folded, rows: DataFrame, pairs: DataFrame, keys: list[str], dense: Dense, turn: np.ndarray) -> DataFrame:
    """(noun, verb, vec) of expressions: the sum of what their sentences' other words are in dense @ turn, over these words' sums.

    rows: sentence keys, id, m, of which folded is made; pairs: sentence keys, noun, verb, and their ids n and v.  An expression and its
    words meet in their sentence, and only sums of vectors leave it.
    """
    void = lambda df, *names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    words = rows.select(*keys, F.col("id").cast("long").alias("id"), F.col("m").cast("long").alias("m"), *void(pairs, "noun", "verb", "n", "v"))
    both = words.unionByName(pairs.select(*keys, *void(words, "id", "m"), "noun", "verb", "n", "v"))
    dealt = both.repartition(max(len(folded.names), 1), *keys).sortWithinPartitions(*keys)
    parts = dealt.mapInArrow(_near(folded, dense, turn), "noun string, verb string, vec array<double>")
    return parts.repartition("noun", "verb").sortWithinPartitions("noun", "verb").mapInArrow(_added, parts.schema)


class Normalised:
    """A Folded whose columns sum to one, or its transpose, to be multiplied as a Sparse is."""

    def __init__(self, folded: Folded, transposed: bool) -> None:
        self.folded, self.transposed, self.blocks = folded, transposed, folded.blocks

    def times(self, dense: Dense, turn: np.ndarray | None) -> tuple[Dense, np.ndarray]:
        by = self.folded.sums
        return self.folded.times(dense, turn, under=by) if self.transposed else self.folded.times(dense, turn, over=by)


def _put(top: str, a: np.ndarray) -> str:
    where, base = _opened(top)
    name = f"dense-{uuid.uuid4().hex}"
    with where.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(pa.py_buffer(np.ascontiguousarray(a, np.float64)))
    return name


class Dense:
    """A matrix of `height` by `columns` in files of block rows; without files, random."""

    def __init__(self, top: str, height: int, columns: int, names: dict[int, str] | None = None) -> None:
        self.top, self.height, self.columns, self.names, self.size = top, height, columns, names, _size(height)

    def read(self, b: int) -> np.ndarray:
        if self.names is None:
            return np.random.default_rng([SEED, b]).normal(size=(min(self.size, self.height - b * self.size), self.columns))
        where, base = _opened(self.top)
        with where.open_input_file(f"{base}/{self.names[b]}") as f:
            return np.frombuffer(f.read_buffer()).reshape(-1, self.columns)

    def drop(self) -> None:
        where, base = _opened(self.top)
        for name in (self.names or {}).values():
            where.delete_file(f"{base}/{name}")

    def named(self, names: DataFrame, turn: np.ndarray) -> DataFrame:
        """names (id, name) with name and vec, the row of self @ turn; the names come to the vectors, which are not shuffled."""
        own, kind = self, names.schema["name"].dataType.simpleString()

        def run(batches):
            for x in batches:
                for k, b in enumerate(x.column(0).to_pylist()):
                    a, said = np.ascontiguousarray(own.read(b) @ turn), x.column(1).slice(k, 1).flatten()
                    for s in range(0, len(a), 4096):
                        part = a[s : s + 4096]
                        ends = pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32))
                        yield pa.RecordBatch.from_arrays([said.slice(s, 4096), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], ["name", "vec"])

        each = names.groupBy(F.floor(F.col("id") / self.size).cast("int").alias("b")).agg(F.expr("transform(sort_array(collect_list(struct(id, name))), x -> x.name)").alias("said"))
        return each.repartitionByRange(len(self.names), "b").mapInArrow(run, f"name {kind}, vec array<double>")

    def rows(self, spark: SparkSession, turn: np.ndarray) -> DataFrame:
        """(id, vec) of the rows of self @ turn."""
        own = self

        def run(batches):
            for x in batches:
                for b in x.column(0).to_pylist():
                    a = np.ascontiguousarray(own.read(b) @ turn)
                    for s in range(0, len(a), 4096):
                        part = a[s : s + 4096]
                        ends = pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part)) + s + b * own.size), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], ["id", "vec"])

        blocks = sorted(self.names)
        return spark.sparkContext.parallelize([(b,) for b in blocks], len(blocks)).toDF("b int").mapInArrow(run, "id long, vec array<double>")


class Ones(Dense):
    """All ones."""

    def read(self, b: int) -> np.ndarray:
        return np.ones((min(self.size, self.height - b * self.size), self.columns))


def _whiten(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes columns of this Gram matrix orthonormal; dependent columns leave."""
    w, v = np.linalg.eigh(gram)
    good = w > max(w[-1], 0) * 1e-14
    return v[:, good] / np.sqrt(w[good])


def svd(cells: DataFrame, n: int, k: int, top: str) -> tuple[np.ndarray, Dense, np.ndarray, Dense, np.ndarray]:
    """factored() of the n by n matrix of cells (i, j, v)."""
    return factored(Sparse(cells, n, n, top), Sparse(cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), n, n, top), cells.sparkSession, n, k, top)


def factored(a: Sparse | Normalised, b: Sparse | Normalised, spark: SparkSession, n: int, k: int, top: str) -> tuple[np.ndarray, Dense, np.ndarray, Dense, np.ndarray]:
    """Of the n by n matrix a, whose transpose is b: the k largest singular values, its product with the right singular vectors and
    these, each as a Dense and a small matrix to multiply it by.  The vectors' largest entries by size are positive."""
    z, turn = Dense(top, n, min(k + OVER, n)), None
    for _ in range(ROUNDS + 1):
        y, gram = a.times(z, turn)
        z.drop()
        z, gram = b.times(y, _whiten(gram))
        y.drop()
        turn = _whiten(gram)
    y, gram = a.times(z, turn)
    w, v = np.linalg.eigh(gram)
    s, v = np.sqrt(np.maximum(w[::-1], 0))[:k], v[:, ::-1][:, :k]
    good = s > s[0] * ZERO
    s, v = s[good], v[:, good]
    whole = turn @ v

    def peak(block):
        x = z.read(block) @ whole
        return x[np.abs(x).argmax(axis=0), range(x.shape[1])]

    peaks = np.array(spark.sparkContext.parallelize(range(a.blocks), a.blocks).map(peak).collect())
    signs = np.sign(peaks[np.abs(peaks).argmax(axis=0), range(peaks.shape[1])])
    return s, y, v * signs, z, whole * signs
