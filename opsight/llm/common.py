"""Reading tables, materialising intermediate results and small task-side helpers."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder named by spark.checkpoint.dir, apart for each application."""
    app = spark.sparkContext.applicationId
    return f"{checkpoint_dir(spark).rstrip('/')}/opsight-{app}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back.

    The table survives lost executors, and what follows computes the rows before it only once.
    """
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._opsight_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a materialised table that nothing reads any more."""
    path = getattr(df, "_opsight_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def spread(files: DataFrame, column: str, most: int = 10_000) -> DataFrame:
    """One small row for each file, dealt to as many tasks as there are files (at most `most`).

    The number is given, so that adaptive execution doesn't join tasks whose rows are few but whose files are large.
    """
    return files.repartition(max(1, min(most, files.count())), column)


def free_names(columns, *stems: str) -> list[str]:
    """Names for working columns beside `columns`, none of which they meet (Spark looks at no case)."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


BATCH_BYTES = 8 << 20


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, as --py-files would, so that tasks can import it on any cluster.

    Also bounds the Arrow batches of the session by bytes: with long texts the default of 10,000 rows or 64 MB, held by the
    JVM and by Python in several forms, is a large part of a small executor.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(limit)) or 0) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_opsight_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent).as_posix())
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "code") + "/opsight.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(path.toString())
    sc._opsight_shipped = True


def encode_text(text) -> bytes:
    """UTF-8 of a text; null counts as empty. Spark strings are valid UTF-8 or replaced on the way in."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def add_column(df: DataFrame, name: str, kind: T.DataType, source: str, start, keep: list[str] | None = None, rows: int = 1000) -> DataFrame:
    """df with a new last column `name`: start() gives each task a function from an arrow array of `source` to its values.

    The function gets `rows` rows at a time and what it keeps goes with the task. Only the columns in `keep` (default: all) come back from the tasks; an input column called `name` is replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != name]
    sent = kept if source in kept else [*kept, source]
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([fields[c] for c in kept] + [T.StructField(name, kind)])
    at = sent.index(source)

    def run(batches):
        make = start()
        for b in batches:
            for i in range(0, b.num_rows, rows):
                s = b.slice(i, rows)
                yield pa.RecordBatch.from_arrays([s.column(j) for j in range(len(kept))] + [make(s.column(at))], names=[*kept, name])

    return df.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, schema)
