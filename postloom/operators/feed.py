"""Published versions of a table: claimed once, checked when read, with default pages kept beside them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

_SCHEMA = 1


def snapshot_hash(df: DataFrame) -> DataFrame:
    """(rows, digest), the same whatever the order of rows."""
    row = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointer_path(path: str, version: int) -> str:
    return f"{path}/versions/{version:020d}.json"


def _claim(spark: SparkSession, path: str, pointer: dict) -> bool:
    """Make the pointer of a version, whole or not at all: a rename that fails where the name is taken."""
    target, fs = _at(spark, _pointer_path(path, pointer["version"]))
    draft, _ = _at(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(pointer).encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, target, options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e.java_exception) or fs.exists(target):
            return False
        raise
    return True


def pointers(spark: SparkSession, path: str) -> Iterator[dict]:
    """Pointers of versions, newest first; those that can't be read are passed over."""
    folder, fs = _at(spark, f"{path}/versions")
    if not fs.exists(folder):
        return
    names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), reverse=True)
    for name in names:
        if name.startswith(".") or not name.endswith(".json"):
            continue
        at, _ = _at(spark, f"{path}/versions/{name}")
        try:
            stream = fs.open(at)
            try:
                pointer = json.loads(bytes(stream.readAllBytes()).decode("utf-8", "replace"))
            finally:
                stream.close()
        except (ValueError, Py4JJavaError):  # no JSON, or a checksum that doesn't hold
            continue
        if isinstance(pointer, dict) and pointer.get("schema") == _SCHEMA and pointer.get("rows", 0) > 0:
            yield pointer


def last_pointer(spark: SparkSession, path: str) -> dict | None:
    """The newest pointer of this schema that has rows, or None."""
    return next(pointers(spark, path), None)


def read_version(spark: SparkSession, path: str, pointer: dict) -> DataFrame:
    return spark.read.parquet(f"{path}/{pointer['data']}/rows")


def publish(
    df: DataFrame, path: str, *, version: int, day: str, profile: str = "", pages: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None
) -> bool:
    """Write a version with its default pages and claim its number. True if this call published it.

    Refused: no rows, the content and day of the last version, or a version that isn't above the last. Rows and pages go to
    a folder of their own first, so nothing that a reader may follow is ever changed; then the pointer takes the
    version's name by a rename without overwriting, so of several writers one wins and the others' folders go.
    The store must have such a rename (HDFS and local ones do). profile names the rules behind the pages.
    """
    spark = df.sparkSession
    last = last_pointer(spark, path)
    if last is not None and version <= last["version"]:
        return False
    folder = f"data/{uuid.uuid4().hex}"
    home, fs = _at(spark, f"{path}/{folder}")
    df.write.parquet(f"{path}/{folder}/rows")  # what is counted is what was written, whatever df gives when it runs again
    written = spark.read.schema(df.schema).parquet(f"{path}/{folder}/rows")
    mark = snapshot_hash(written).first()
    same = last is not None and (last["rows"], last["digest"], last["day"]) == (mark["rows"], str(mark["digest"]), day)
    if not mark["rows"] or (same and last["profile"] == profile):
        fs.delete(home, True)
        return False
    made = {}
    for name, make in (pages or {}).items():
        page = make(written)
        page.write.parquet(f"{path}/{folder}/pages/{name}")
        made[name] = spark.read.schema(page.schema).parquet(f"{path}/{folder}/pages/{name}").count()
    pointer = {"schema": _SCHEMA, "version": version, "day": day, "rows": mark["rows"], "digest": str(mark["digest"]), "profile": profile, "data": folder, "pages": made}
    newest = last_pointer(spark, path)
    if (newest is not None and newest["version"] >= version) or not _claim(spark, path, pointer):
        fs.delete(home, True)
        return False
    return True


def _whole(spark: SparkSession, path: str, pointer: dict) -> DataFrame | None:
    """The rows of a version if they are those that were published, else None."""
    try:
        df = read_version(spark, path, pointer)
        mark = snapshot_hash(df).first()
    except PySparkException:
        return None
    return df if (mark["rows"], str(mark["digest"])) == (pointer["rows"], pointer["digest"]) else None


def _latest_whole(spark: SparkSession, path: str, verify: bool) -> tuple[DataFrame, dict, bool] | None:
    for k, pointer in enumerate(pointers(spark, path)):
        df = _whole(spark, path, pointer) if verify else read_version(spark, path, pointer)
        if df is not None:
            return df, pointer, k > 0
    return None


def read_published(spark: SparkSession, path: str, *, day: str | None = None, verify: bool = True) -> DataFrame | None:
    """The newest version that is whole, with ``stale``: true if it is of another day or a newer one is damaged. None if there is none.

    With verify the rows are counted and hashed again (a pass over the table) before they are handed out; older
    versions stand in for damaged ones. Without it the newest pointer is followed.
    """
    found = _latest_whole(spark, path, verify)
    if found is None:
        return None
    df, pointer, older = found
    return df.withColumn("stale", F.lit(older or (day is not None and pointer["day"] != day)))


def read_page(
    spark: SparkSession, path: str, name: str, make: Callable[[DataFrame], DataFrame], *, day: str, profile: str = "", verify: bool = True
) -> tuple[DataFrame, bool] | None:
    """A default page, and whether it was kept: the stored one only if day and profile are those asked for and its rows are all there,
    else one made from the newest whole version. None if nothing was published."""
    newest = last_pointer(spark, path)
    if newest is not None and name in newest["pages"] and (newest["day"], newest["profile"]) == (day, profile):
        try:
            page = spark.read.parquet(f"{path}/{newest['data']}/pages/{name}")
            if page.count() == newest["pages"][name]:
                return page, True
        except PySparkException:
            pass
    found = _latest_whole(spark, path, verify)
    return None if found is None else (stored(make(found[0]), f"page-{name}"), False)
