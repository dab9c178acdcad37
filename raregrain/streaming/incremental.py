"""Chunk-incremental training in chunk order, and scoring and counting of chunk streams.

Training depends on the order of the chunks, so it walks the listed files by the
number of their ``chunk_no=<n>`` folder and notes the files of every finished chunk. The model of a chunk is stored
before the note, and training resumes from the last noted one, so a lost driver
costs at most the chunk in work. Scoring and counting do not depend on the order and run as file streams
with one file per micro-batch; the chunk is taken from the path. Repeated work
overwrites its own output.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.ml import Model
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregrain.functions.hashing import hash_key
from raregrain.functions.vectors import as_array, class1_probability
from raregrain.operators.boosting import NODES_SCHEMA, BoostedTrees, boost, mean_probability, round_metrics
from raregrain.operators.classifiers import fit_mlp, perceptron_model
from raregrain.operators.evaluate import average_precision, log_loss
from raregrain.operators.few_perceptron import class1, copies, loss_of, minimized, score_metrics
from raregrain.operators.few_rows import MOST_CELLS, MOST_ROWS, SETTINGS, FewRows
from raregrain.operators.sampling import WEIGHT_UNITS, resample_weighted
from raregrain.operators.stats import class_weights
from raregrain.session import freeze
from raregrain.sources.readers import widen_scan
from raregrain.sources.sinks import write_pred_chunks

#: Files of a micro-batch where chunks are small and have folders.
TOGETHER = 256


def _folder_number(path: Column) -> Column:
    """Number in the path of a chunk's folder, null where there is none."""
    return F.regexp_extract(path, r"chunk_no=(\d+)/", 1).try_cast("int")


def _options(reader):
    return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)


def chunk_files(spark: SparkSession, path: str, noted: Mapping[int, Collection[str]] | None = None) -> list[tuple[int, list[str]]]:
    """``chunk_no`` and files of every chunk that is not in ``noted``, the files of the finished ones, in order.

    The number is that of the ``chunk_no=<n>`` folder. Files outside such folders are a
    chunk each, numbered from 1 or behind the last folder and the last finished number in the order they were written
    (ties by name); a finished one keeps its number. A folder whose number is finished but which has files that
    were not noted is an error, since they would never be trained. Only
    the listing, a line per file, comes to the driver; files without rows are no chunk.
    """
    noted = noted or {}
    meta = F.col("_metadata")
    rows = _options(spark.read).parquet(path).select(meta["file_path"].alias("file"), meta["file_modification_time"].alias("at")).distinct()
    listed = rows.select("file", "at", _folder_number(F.col("file")).alias("no")).collect()
    chunks: dict[int, list[str]] = {}
    for row in sorted((r for r in listed if r.no is not None), key=lambda r: (r.no, r.file)):
        chunks.setdefault(row.no, []).append(unquote(row.file))
    missed = [(no, f) for no in chunks if no in noted for f in chunks[no] if f not in noted[no]]
    if missed:
        raise ValueError(f"{len(missed)} files of chunks whose number is finished were not trained, the first is {missed[0][1]} of chunk {missed[0][0]}")
    done = {f for files in noted.values() for f in files}
    last = max([*chunks, *noted], default=0)
    loose = sorted((r for r in listed if r.no is None and unquote(r.file) not in done), key=lambda r: (r.at, r.file))
    for i, row in enumerate(loose):
        chunks[last + i + 1] = [unquote(row.file)]
    return [(no, chunks[no]) for no in sorted(chunks) if no not in noted]


def _finished(spark: SparkSession, progress: str) -> dict[int, set[str]]:
    """Files of the noted chunks, in order of their numbers."""
    try:
        rows = spark.read.schema("file string, chunk_no int").parquet(progress).collect()
    except AnalysisException:  # nothing noted so far
        return {}
    if any(r.file is None for r in rows):
        raise ValueError(f"the notes in {progress} do not name files; start again with another folder")
    noted: dict[int, set[str]] = {}
    for row in sorted(rows, key=lambda r: r.chunk_no):
        noted.setdefault(row.chunk_no, set()).add(row.file)
    return noted


def _note(spark: SparkSession, chunks: Sequence[tuple[int, Sequence[str]]], progress: str) -> None:
    """Note the files of finished chunks."""
    files, numbers = zip(*((f, no) for no, found in chunks for f in found))
    notes = pa.table({"file": pa.array(files), "chunk_no": pa.array(numbers, pa.int32())})
    write_pred_chunks(spark.createDataFrame(notes, "file string, chunk_no int").coalesce(1), progress)


#: Fits of chunks, or loads of models, that are in work at a time.
AT_ONCE = 8
#: Small chunks that are read and noted together.
CHUNKS_A_BLOCK = 64
#: Models of small chunks that wait to be stored.
MODELS_WAITING = 16


def _known_array(df: DataFrame, col: str) -> Column:
    """Array of a vector column, null where that is null."""
    known = F.col(col).isNotNull()
    return F.when(known, as_array(df, col))


def small_blocks(spark: SparkSession, path: str, schema: T.StructType, features: str, chunks: Sequence[tuple[int, list[str]]]) -> list[tuple[bool, list[tuple[int, list[str]]]]]:
    """The chunks in order, those of few rows in blocks that fit into memory together (true), each of the others by itself (false).

    Rows are counted from the files' footers; the width of the features is that of the first chunk.
    """
    if not chunks or schema[features].metadata.get("ml_attr"):  # nominal features are told by it
        return [(False, [c]) for c in chunks]
    counted = _options(spark.read).parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    rows = {unquote(r.file): r.n for r in counted.collect()}
    first = spark.read.schema(schema).parquet(*chunks[0][1])
    width = first.agg(F.max(F.size(_known_array(first, features)))).first()[0]
    width = max(width or 1, 1)
    blocks: list[tuple[bool, list[tuple[int, list[str]]]]] = []
    held = 0
    for chunk in chunks:
        n = sum(rows.get(f, MOST_ROWS + 1) for f in chunk[1])
        small = n <= MOST_ROWS and n * width <= MOST_CELLS
        if small and blocks and blocks[-1][0] and len(blocks[-1][1]) < CHUNKS_A_BLOCK and (held + n) * width <= MOST_CELLS:
            blocks[-1][1].append(chunk)
            held += n
        else:
            blocks.append((small, [chunk]))
            held = n
    return blocks


def read_block(
    spark: SparkSession, schema: T.StructType, chunks: Sequence[tuple[int, list[str]]], select: Callable[[DataFrame], list[Column]]
) -> Iterator[pa.Table]:
    """What ``select`` takes of the rows of every one of several small chunks, read by one job; rows come by file."""
    number = {f: i for i, (_, files) in enumerate(chunks) for f in files}
    order = {f: i for i, f in enumerate(number)}
    df = spark.read.schema(schema).parquet(*number)
    table = df.select(*select(df), F.col("_metadata.file_path").alias("_file")).toArrow().combine_chunks()
    files = [unquote(f) for f in table.column("_file").to_pylist()]
    at = np.array([number[f] for f in files], np.int64)
    by = np.argsort(np.array([order[f] for f in files], np.int64), kind="stable")
    table, at = table.drop_columns("_file").take(pa.array(by)), at[by]
    for i in range(len(chunks)):
        lo, hi = np.searchsorted(at, (i, i + 1))
        yield table.slice(lo, hi - lo)


def walk_chunks(
    spark: SparkSession, path: str, schema: T.StructType, progress: str,
    each: Callable[[DataFrame, int, int | None], Callable[[], None] | None],
    several: Callable[[list[tuple[int, list[str]]], int | None], bool] | None = None, features: str = "vectors",
) -> list[int]:
    """Call ``each(chunk, chunk_no, chunk_no before it)`` for every chunk not yet finished, in order; returns all finished.

    What ``each`` returns, if anything, is called to end the chunk while the next one is in work; then the chunk is noted.
    Ends run one after the other, so that a chunk is noted only after those before it. ``several(chunks, chunk_no before them)``
    may take a block of small chunks (:func:`small_blocks`) instead and note them itself; if it returns false, each is walked.
    """
    noted = _finished(spark, progress)
    finished = list(noted)

    def close(end: Callable[[], None] | None, chunk_no: int, files: list[str]) -> None:
        if end is not None:
            end()
        _note(spark, [(chunk_no, files)], progress)

    ending = None

    def rest() -> Iterator[tuple[int, list[str]]]:
        """Chunks that ``several`` does not take."""
        nonlocal ending
        waiting = chunk_files(spark, path, noted)
        for small, block in small_blocks(spark, path, schema, features, waiting) if several is not None else [(False, waiting)]:
            if small:
                if ending is not None:
                    before, ending = ending, None
                    before.result()
                if several(block, finished[-1] if finished else None):
                    finished.extend(no for no, _ in block)
                    continue
            yield from block

    with ThreadPoolExecutor(1) as pool:
        try:
            for chunk_no, files in rest():
                end = each(spark.read.schema(schema).parquet(*files), chunk_no, finished[-1] if finished else None)
                before, ending = ending, None
                if before is not None:
                    before.result()
                ending = pool.submit(close, end, chunk_no, files)
                finished.append(chunk_no)
        finally:
            if ending is not None:
                ending.result()
    return finished


def read_chunks(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Stream of the parquet files under ``path``, with the ``chunk_no`` of their folder (null without one).

    Where every file has a folder, ``files_per_batch`` only says how many chunks share the fixed cost of a micro-batch
    (``TOGETHER`` for small ones); files without one are told apart by their micro-batch and need one each.
    """
    stream = _options(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)).parquet(path)
    return stream.select(*schema.names, _folder_number(F.col("_metadata.file_path")).alias("chunk_no"))


def run_chunks(chunks: DataFrame, checkpoint: str, each: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Write ``each(batch)`` for all files there are now by ``chunk_no`` and ``batch_no``, then stop.

    Files without a folder number have that of their micro-batch, from 1. The files of one
    folder may come in several batches, each of which keeps its own part.
    """

    def run(df: DataFrame, batch: int) -> None:
        numbered = df.withColumn("chunk_no", F.coalesce("chunk_no", F.lit(batch + 1)))
        write_pred_chunks(each(numbered).withColumn("batch_no", F.lit(batch)), out, within=["batch_no"])

    query = chunks.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()
    query.awaitTermination()


def count_chunks(chunks: DataFrame, out: str, checkpoint: str, label: str = "y") -> None:
    """Store rows and positives of every chunk."""
    counts = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label) == 1).alias("n_positive")]
    run_chunks(chunks, checkpoint, lambda df: df.groupBy("chunk_no").agg(*counts), out)


def model_path(root: str, chunk_no: int) -> str:
    """Where the model after a chunk is stored."""
    return f"{root}/models/_{chunk_no}_ckpt"


@contextmanager
def stored_in_order(spark: SparkSession, root: str, log_schema: str) -> Iterator[Callable[[int, list[str], Callable[[str], None], pa.Table], None]]:
    """A function ``(chunk_no, files, save to a path, log)`` that stores models while the next ones are fitted.

    At the end, after an error too, the chunks whose models and all before them are stored get their log and are noted, in one write each.
    """
    begun: list[tuple[int, list[str], Future, pa.Table]] = []
    with ThreadPoolExecutor(AT_ONCE) as pool:

        def store(chunk_no: int, files: list[str], save: Callable[[str], None], log: pa.Table) -> None:
            if len(begun) >= MODELS_WAITING:
                begun[-MODELS_WAITING][2].result()
            begun.append((chunk_no, files, pool.submit(save, model_path(root, chunk_no)), log))

        try:
            yield store
        finally:
            done, failed = [], None
            for item in begun:
                failed = failed or item[2].exception()
                if failed is None:
                    done.append(item)
            if done:
                log = pa.concat_tables([log.append_column("chunk_no", pa.array([no] * len(log), pa.int32())) for no, _, _, log in done])
                write_pred_chunks(spark.createDataFrame(log, f"{log_schema}, chunk_no int").coalesce(1), f"{root}/log")
                _note(spark, [(no, files) for no, files, *_ in done], f"{root}/progress")
            if failed is not None:
                raise failed


def train_incremental(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    root: str,
    layers: Sequence[int],
    label: str = "binds",
    features: str = "vectors",
    max_iter: int = 100,
    seed: int = 42,
    key: str = "id",
) -> MultilayerPerceptronClassificationModel:
    """Train on chunk after chunk of ``path`` in order, each fit starting from the weights of the last.

    Per chunk: fit, model checkpoint, log loss (rows weighted to balance the
    classes) and average precision. The perceptron takes no row weights, so it is fitted on rows that are repeated
    or left out in proportion to theirs (:func:`resample_weighted`): both classes have half of the copies. Logs are
    stored under ``<root>/log``, with the copies of both classes.
    """

    weights = {}  # of the chunk that was fitted last

    def each(df: DataFrame, chunk_no: int, before: int | None) -> Callable[[], None]:
        chunk = class_weights(df, label).persist()
        try:
            start = weights.pop(before, None)
            start = Vectors.dense(start) if isinstance(start, np.ndarray) else start
            if before is not None and start is None:
                start = MultilayerPerceptronClassificationModel.load(model_path(root, before)).weights
            n_rows = chunk.count()
            balanced = freeze(resample_weighted(chunk, "sample_weights", [label], key, seed, rows=n_rows).select(label, features))
            model = fit_mlp(balanced, layers, label, features, max_iter, seed, start)
            weights[chunk_no] = model.weights
        except BaseException:
            chunk.unpersist()
            raise

        def end() -> None:
            try:
                model.write().overwrite().save(model_path(root, chunk_no))
                scored = model.transform(chunk)
                scored = scored.select(F.col(label).alias("y"), "sample_weights", class1_probability(scored).alias("score"))
                loss, precision = log_loss(scored, weight="sample_weights").first()[0], average_precision(scored, rows=n_rows).first()[0]
                fitted = balanced.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
                entry = [(n_rows, *fitted, loss, precision)]
                log = spark.createDataFrame(entry, "n_rows bigint, n_fit_0 bigint, n_fit_1 bigint, logloss double, aucpr double").coalesce(1)
                write_pred_chunks(log.withColumn("chunk_no", F.lit(chunk_no)), f"{root}/log")
            finally:
                chunk.unpersist()

        return end

    def several(chunks: list[tuple[int, list[str]]], before: int | None) -> bool:
        """Small chunks one after the other in memory; rows are repeated in the order of their hashes, as those of large ones."""

        def columns(df: DataFrame) -> list[Column]:
            kept = [F.col(label).cast("double").alias("y"), _known_array(df, features).alias("x"), F.lit(0.0).alias("margin")]
            return [*kept, hash_key(key, seed).alias("h"), F.col(key).alias("key"), F.xxhash64(*df.columns).alias("content")]

        turns = [(c, "ascending") for c in ("h", "key", "content")]
        tables = [t.take(pc.sort_indices(t, turns, null_placement="at_start")) for t in read_block(spark, schema, chunks, columns)]
        held = [FewRows.of(t, "x", "y", "margin") for t in tables]
        if layers[-1] < 2 or any(h is None or len(h.label) < t.num_rows or not h.trained().all() or h.x.shape[1] != layers[0] for h, t in zip(held, tables)):
            return False
        now = weights.get(before)
        if now is None:
            if before is not None:
                now = MultilayerPerceptronClassificationModel.load(model_path(root, before)).weights
            else:  # the weights that a fit begins with depend on the seed alone
                one = spark.read.schema(schema).parquet(*chunks[0][1]).limit(1)
                now = fit_mlp(one, layers, label, features, 0, seed).weights
        now = np.array(now)
        with stored_in_order(spark, root, "n_rows bigint, n_fit_0 bigint, n_fit_1 bigint, logloss double, aucpr double") as store:
            for (chunk_no, files), rows in zip(chunks, held):
                parts = [np.flatnonzero(rows.label == k) for k in (0, 1)]
                taken = [np.repeat(at, copies(rows.weight[at], WEIGHT_UNITS)) for at in parts]
                fit = np.concatenate(taken)
                now = minimized(loss_of(rows.x[fit], rows.label[fit], layers), now, max_iter)
                metrics = score_metrics(rows.label, rows.weight, class1(rows.x, now, layers))
                entry = (len(rows.label), *map(len, taken), *metrics)
                log = pa.table({n: pa.array([v], t) for n, v, t in zip(("n_rows", "n_fit_0", "n_fit_1", "logloss", "aucpr"), entry, [pa.int64()] * 3 + [pa.float64()] * 2)})
                store(chunk_no, files, lambda at, w=now: perceptron_model(spark, w, layers, label, features, max_iter, seed).write().overwrite().save(at), log)
        weights.clear()
        weights[chunks[-1][0]] = now
        return True

    finished = walk_chunks(spark, path, schema, f"{root}/progress", each, several, features)
    if not finished:
        raise ValueError(f"no chunks under {path}")
    final = MultilayerPerceptronClassificationModel.load(model_path(root, finished[-1]))
    final.write().overwrite().save(f"{root}/models/Final_ckpt")
    return final


def train_boosted(
    spark: SparkSession, path: str, schema: T.StructType, root: str, rounds: int, label: str = "binds", features: str = "vectors",
    step: float = 0.1, **tree: object,
) -> BoostedTrees:
    """Boost on chunk after chunk of ``path`` in order, each adding ``rounds`` trees to those of the chunks before it.

    Rows of a chunk are weighted to balance its classes. Per chunk the whole ensemble is stored, and metrics after each of its rounds
    go to ``<root>/log`` (``chunk_no, n_rows, round, logloss, aucpr``). After a loss the chunk in work is fitted again from the
    stored ensemble before it, which gives the same trees.
    """

    models = {}  # of the chunk that was fitted last

    def each(df: DataFrame, chunk_no: int, before: int | None) -> Callable[[], None]:
        chunk = class_weights(df, label).persist()
        try:
            start = models.pop(before, None)
            if before is not None and start is None:
                start = BoostedTrees.load(spark, model_path(root, before), features)
            n_rows = chunk.count()
            models[chunk_no] = model = boost(chunk, rounds, start, label, features, "sample_weights", step, **tree)
        except BaseException:
            chunk.unpersist()
            raise

        def end() -> None:
            try:
                model.save(spark, model_path(root, chunk_no))
                log = round_metrics(chunk, model, model.rounds - rounds + 1, label, "sample_weights", n_rows)
                log = log.withColumns({"n_rows": F.lit(n_rows), "chunk_no": F.lit(chunk_no)})
                write_pred_chunks(log.coalesce(1), f"{root}/log")
            finally:
                chunk.unpersist()

        return end

    def several(chunks: list[tuple[int, list[str]]], before: int | None) -> bool:
        """Small chunks one after the other in memory; margins of the trees before them come with their rows."""
        model = models.get(before)
        if before is not None and model is None:
            model = BoostedTrees.load(spark, model_path(root, before), features)

        def columns(df: DataFrame) -> list[Column]:
            margin = F.element_at(model.margins(df, model.rounds), 1) if model is not None else F.lit(0.0)
            return [F.col(label).cast("double").alias("y"), _known_array(df, features).alias("x"), margin.alias("margin")]

        tables = list(read_block(spark, schema, chunks, columns))
        held = [FewRows.of(t, "x", "y", "margin") for t in tables]
        if any(h is None for h in held):
            return False
        with stored_in_order(spark, root, "round int, logloss double, aucpr double, n_rows int") as store:
            grown = None  # nodes since the block began
            for (chunk_no, files), table, rows in zip(chunks, tables, held):
                rows.add(grown)
                first = model.rounds + 1 if model is not None else 1
                model = boost(rows, rounds, model, label, features, "sample_weights", step, **tree)
                log = round_metrics(rows, model, first, label, "sample_weights", table.num_rows)
                fresh = model.nodes[model.nodes["round"] >= first]
                grown = fresh if grown is None else pd.concat([grown, fresh], ignore_index=True)
                store(chunk_no, files, lambda at, model=model: model.save(spark, at), log.append_column("n_rows", pa.array([table.num_rows] * len(log), pa.int32())))
        models.clear()
        models[chunks[-1][0]] = model
        return True

    follows = not set(tree) - set(SETTINGS)
    finished = walk_chunks(spark, path, schema, f"{root}/progress", each, several if follows else None, features)
    if not finished:
        raise ValueError(f"no chunks under {path}")
    final = BoostedTrees.load(spark, model_path(root, finished[-1]), features)
    final.save(spark, f"{root}/models/Final_ckpt")
    return final


#: Chunks of few rows that are fitted by one job and noted together.
FITS_A_JOB = 512
#: Models that score in one pass over the rows; more would make plans that grow with the number of chunks.
MODELS_A_PASS = 16


def train_ensemble(
    spark: SparkSession, path: str, schema: T.StructType, root: str, fit: Callable[[DataFrame], Model], label: str | None = None,
    at_once: int = AT_ONCE, fit_few: Callable[[FewRows], BoostedTrees] | None = None, features: str = "vectors",
) -> list[str]:
    """One model per chunk for learners that cannot continue a fit, such as trees; returns their paths in chunk order.

    With a ``label`` the chunk has ``sample_weights`` that balance its classes. The fits do not depend on each other: ``at_once`` are
    in work at a time, and finished chunks are noted in order, so many together. A lost driver costs the chunks in work.
    Chunks of few rows (and in a ``chunk_no=<n>`` folder) are fitted by ``fit_few``, if given with a ``label``: hundreds by one
    job, a chunk in a task, and their models are stored by one write. :func:`load_models` reads both kinds.
    """

    def one(chunk: tuple[int, list[str]]) -> int:
        df = spark.read.schema(schema).parquet(*chunk[1])
        fit(class_weights(df, label) if label else df).write().overwrite().save(model_path(root, chunk[0]))
        return df.count()

    def note(done: list[tuple[int, list[str], int]]) -> None:
        log = pa.table({"n_rows": pa.array([n for *_, n in done], pa.int64()), "chunk_no": pa.array([no for no, *_ in done], pa.int32())})
        write_pred_chunks(spark.createDataFrame(log, "n_rows bigint, chunk_no int").coalesce(1), f"{root}/log")
        _note(spark, [(no, files) for no, files, _ in done], progress)

    progress = f"{root}/progress"
    noted = _finished(spark, progress)
    waiting = chunk_files(spark, path, noted)
    every = [no for no, _ in waiting]
    paths = {no: model_path(root, no) for no in (*noted, *every)}
    if fit_few is not None and label is not None:
        foldered = [c for c in waiting if all((found := re.search(r"chunk_no=(\d+)/", f)) and int(found[1]) == c[0] for f in c[1])]
        small = [c for few, block in small_blocks(spark, path, schema, features, foldered) if few for c in block]
        for begin in range(0, len(small), FITS_A_JOB):
            some = small[begin : begin + FITS_A_JOB]
            sizes = _fit_few(spark, some, schema, root, fit_few, label, features)
            note([(no, files, sizes[no]) for no, files in some])
        taken = {no for no, _ in small}
        waiting = [c for c in waiting if c[0] not in taken]
        paths |= {no: few_path(root, no) for no in _fitted_few(spark, root) if no in paths}
    done: list[tuple[int, list[str], int]] = []
    with ThreadPoolExecutor(at_once) as pool:
        try:
            for chunk, n_rows in zip(waiting, pool.map(one, waiting)):  # an error cancels fits not yet begun
                done.append((*chunk, n_rows))
                if len(done) == at_once:
                    note(done)
                    done = []
        finally:
            if done:
                note(done)
    return [paths[no] for no in (*noted, *every)]


def few_path(root: str, chunk_no: int) -> str:
    """Where the model of a chunk of few rows is stored, beside those of the others."""
    return f"{root}/few-models/chunk_no={chunk_no}"


def _fitted_few(spark: SparkSession, root: str) -> list[int]:
    """Chunks whose models are stored at :func:`few_path`."""
    try:
        rows = spark.read.schema(f"{NODES_SCHEMA}, chunk_no int").parquet(f"{root}/few-models").select("chunk_no").distinct().collect()
    except AnalysisException:  # none so far
        return []
    return [r.chunk_no for r in rows]


def _fit_few(
    spark: SparkSession, chunks: Sequence[tuple[int, list[str]]], schema: T.StructType, root: str, fit: Callable[[FewRows], BoostedTrees], label: str, features: str
) -> dict[int, int]:
    """Fit and store the models of chunks of few rows, a chunk in a task; returns their rows."""
    df = spark.read.schema(schema).parquet(*[f for _, files in chunks for f in files])
    rows = df.select(
        _folder_number(F.col("_metadata.file_path")).alias("chunk_no"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"),
        F.col(label).cast("double").alias("y"), _known_array(df, features).alias("x"), F.lit(0.0).alias("margin"),
    )

    def run(table: pa.Table) -> pa.Table:
        held = FewRows.of(table.sort_by([("_file", "ascending"), ("_at", "ascending")]), "x", "y", "margin")
        if held is None or len(held.label) < table.num_rows or np.isnan(held.label).any():
            raise ValueError("labels and features of a fit must be there, finite, and of one length")
        nodes = pa.Table.from_pandas(fit(held).nodes, preserve_index=False)
        return nodes.append_column("chunk_no", pa.array([table["chunk_no"][0].as_py()] * len(nodes), pa.int32()))

    parts = max(1, min(len(chunks), 4 * spark.sparkContext.defaultParallelism))
    fitted = rows.repartition(parts, "chunk_no").groupBy("chunk_no").applyInArrow(run, f"{NODES_SCHEMA}, chunk_no int")
    write_pred_chunks(freeze(fitted).repartition(parts, "chunk_no"), f"{root}/few-models")
    return {r.chunk_no: r["count"] for r in rows.groupBy("chunk_no").count().collect()}


def load_models(load: Callable[[str], Model], paths: Sequence[str], at_once: int = AT_ONCE) -> list[Model | BoostedTrees]:
    """Stored models in the order of ``paths``; those of chunks of few rows are read by one job, the others by ``load``."""
    few = [p for p in paths if re.search(r"/few-models/chunk_no=\d+$", p)]
    models: dict[str, Model | BoostedTrees] = {}
    for root in dict.fromkeys(p.rsplit("/", 1)[0] for p in few):
        table = SparkSession.active().read.schema(f"{NODES_SCHEMA}, chunk_no int").parquet(root).orderBy("chunk_no", "round", "node").toPandas()
        models |= {f"{root}/chunk_no={no}": BoostedTrees.of(nodes.drop(columns="chunk_no")) for no, nodes in table.groupby("chunk_no")}
    rest = [p for p in paths if p not in models]
    with ThreadPoolExecutor(at_once) as pool:
        models |= dict(zip(rest, pool.map(load, rest)))
    return [models[p] for p in paths]


def score_ensemble(df: DataFrame, models: Sequence[Model], key: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """Mean class-1 probability of several models, ``MODELS_A_PASS`` of them in one pass over the rows; the sums between passes are stored.

    :class:`BoostedTrees` are small tables and score in one pass, however many they are.
    """
    columns = [key, *keep]
    trees, models = [m for m in models if isinstance(m, BoostedTrees)], [m for m in models if not isinstance(m, BoostedTrees)]
    n_models = len(trees) + len(models)
    if trees:
        df = widen_scan(df)
    inputs = df.columns
    df = df.withColumn("_sum", mean_probability(df, trees) * len(trees) if trees else F.lit(0.0))
    if trees and models:
        df = freeze(df)
    for begin in range(0, len(models), MODELS_A_PASS):
        some = models[begin : begin + MODELS_A_PASS]
        if begin:
            df = freeze(df)
        for i, model in enumerate(some):
            scored = model.transform(df.select(*inputs, "_sum", *[f"_p{j}" for j in range(i)]))
            df = scored.withColumn(f"_p{i}", class1_probability(scored))
        df = df.select(*inputs, sum((F.col(f"_p{i}") for i in range(len(some))), F.col("_sum")).alias("_sum"))
    mean = F.col("_sum") / n_models
    return df.select(*columns, mean.alias("p1"), (mean > 0.5).cast("double").alias("prediction"))


def score_incremental(
    model: Model, chunks: DataFrame, out: str, checkpoint: str, key: str = "id", label: str | None = None
) -> None:
    """Score chunk after chunk into ``out``, partitioned by ``chunk_no`` and ``batch_no``.

    Use it on tables that keep growing; a finished table is scored in one job
    with ``predict``.
    """
    keep = [label] if label else []

    def each(df: DataFrame) -> DataFrame:
        scored = model.transform(df)
        return scored.select(key, *keep, "prediction", class1_probability(scored).alias("p1"), "chunk_no")

    run_chunks(chunks, checkpoint, each, out)
