"""What the operators share: the shared folder, written tables in place of lineage, and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a table of a few numbers a row at most that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch at most where batches hold texts.
BATCH_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``; in local mode one of our own where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="skarn-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skarn/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read as often as needed, safe against lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path.getParent(), True)


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, a written one of narrow rows, marked for broadcast if its count allows it."""
    return F.broadcast(table) if table.count() <= rows else table


def chunks(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with at most ``BATCH_ROWS`` rows in a batch.

    An executor holds each batch of texts several times (buffers that grow by doubling, the worker's copy, the answer), so
    it is rows in a batch and not in a table that its memory follows. The bound is a setting of the session and stays
    set; a session with a smaller one keeps its own.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, judge_of: Callable[[], Callable[[list[str | None]], list[bool]]], together: int = 512) -> DataFrame:
    """Rows of ``docs`` whose ``text`` a judge keeps, all columns as they were; one pass, nothing shuffled.

    Each task makes a judge of its own, which is asked about some texts at a time.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judge_of()
        for batch in batches:
            for low in range(0, batch.num_rows, together):
                part = batch.slice(low, together)
                kept = part.filter(pa.array(judge(part.column(at).cast(pa.string()).to_pylist()), pa.bool_()))
                if kept.num_rows:
                    yield kept

    return map_texts(docs, run, docs.schema)


def fresh_name(docs: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """A 64-bit number of a text as it stands, by which a row is found again without moving its text."""
    return F.xxhash64(text)


def keep_one(docs: DataFrame, marks: DataFrame, roots: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id, nulls last, then the smallest text key; all columns stay.

    ``marks`` (key, node, doc_id) is the written table of each row's text key, node and doc_id, and ``roots`` (node, root)
    has the component of each node that isn't one by itself. Rows are told apart by text and doc_id, so null and repeated
    doc_ids lose no text of another component; of rows that repeat both, the first by its other columns stays. What goes
    is worked out from these numbers alone; texts are shuffled only if too many rows go for a broadcast.
    """
    ids = marks.groupBy("node", F.col("key").alias("k_"), F.col("doc_id").alias("d_")).agg(F.count("*").alias("rows_"))
    ids = ids.join(roots, "node", "left").withColumn("r_", F.coalesce("root", "node")).drop("root", "node")
    ids = written(ids, "rooted")
    order = F.struct(F.col("d_").isNull().alias("late"), F.col("d_").alias("d"), F.col("k_").alias("k"))
    least = ids.groupBy("r_").agg(F.min(order).alias("least_"), F.sum("rows_").alias("all_")).filter("all_ > 1").drop("all_")
    more = ids.join(least, "r_").withColumn("first_", (F.col("k_") == F.col("least_.k")) & F.col("d_").eqNullSafe(F.col("least_.d")))
    goes = written(more.filter("not first_ or rows_ > 1").select("k_", "d_", "first_"), "goes")
    discard(ids)
    name = fresh_name(docs, "key_")
    rows = docs.withColumn(name, text_key(docs["text"]))
    same = lambda table: (rows[name] == table["k_"]) & rows["doc_id"].eqNullSafe(table["d_"])
    gone = goes.select("k_", "d_")
    kept = rows.join(small(gone), same(gone), "left_anti").select(*(rows[c] for c in docs.columns))
    tied = goes.filter("first_")
    if tied.isEmpty():
        return kept
    tied = rows.join(small(tied), same(tied)).select(F.struct(*(rows[c] for c in docs.columns)).alias("row_"), tied["k_"].alias("k_"), tied["d_"].alias("d_"))
    best = tied.groupBy("k_", "d_").agg(F.min_by("row_", F.to_json("row_")).alias("row_"))
    return kept.unionByName(best.select("row_.*"))
