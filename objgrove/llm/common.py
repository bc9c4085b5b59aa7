"""What the operators share: the cluster's shared folder, lineage cuts and text constants."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of a batch that is handed to Python.
BATCH_ROWS = 2000

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine only, a local one where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="objgrove-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = "file://" + _own[app]
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    # a path without a scheme is on the default file system, which Python on executors has to be told
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder; Spark's cleaner removes it."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, folder: str, codec: str = "zstd") -> DataFrame:
    """Writes a table in the shared folder and reads it again, each column once and compressed."""
    df.write.option("compression", codec).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared one, once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(df: DataFrame) -> Column:
    """All columns of a row in a struct, so that no working column clashes with one, whatever its name."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once, inside one expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def open_fs(uri: str):
    """(file system, path) of a URI, for executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Files:
    """The files of a stored table, by the number of the task that wrote each; readers on executors get paths alone."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.folder = folder
        system, path = open_fs(folder)
        names = [x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")]
        self.paths = {int(re.search(r"part-(\d+)-", x.rsplit("/", 1)[1])[1]): x for x in names}

    def batches(self, unit: int, columns: list[str], size: int = 1000):
        import pyarrow.parquet as pq

        if unit in self.paths:
            system, _ = open_fs(self.folder)
            with system.open_input_file(self.paths[unit]) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=size, columns=columns)


def trimmed() -> None:
    """Gives freed memory back to the system, where the C library can; an idle Python worker would keep it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
