"""Files and archives as DataFrames: tree scan, nested ZIP entries, size budget, text decoding."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import naming
from rowloom.plans.ranking import number_rows
from rowloom.session import pin

ENTRY_SCHEMA = (
    "archive string, entry_no long, path string, filename string, zip_chain array<string>, "
    "size long, compressed_size long, content binary, error string"
)
BATCH_BYTES, BATCH_ROWS = 32 << 20, 4096  # what is gathered before it is handed on, whichever is reached first


def scan_files(spark: SparkSession, root: str, suffix: str = ".xml", content: bool = True) -> DataFrame:
    """Files below ``root`` with the suffix in any case; hidden folders are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    found = files.select(
        F.col("path").alias("abs_path"),
        rel.alias("path"),
        naming.base_name(rel).alias("filename"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        *([F.col("content")] if content else []),
    )
    return found.filter(F.lower("path").endswith(suffix) & ~F.rlike("path", F.lit(r"(^|/)[._][^/]*/")))


def _open_entries(content: bytes, name: str, max_depth: int | None, max_ratio: float | None, max_bytes: int | None):
    """Walk one archive and the archives in it; yields ``(path, chain, info, data, error)``, without data where there is an error."""
    spent = 0
    todo = [(content, "", [name], 1)]
    while todo:
        blob, prefix, chain, depth = todo.pop(0)
        with zipfile.ZipFile(io.BytesIO(blob)) as zf:
            for info in zf.infolist():
                if info.is_dir():
                    continue
                folders = info.filename.replace("\\", "/").split("/")[:-1]
                leaf = posixpath.basename(info.filename)
                where = "/".join([p for p in (prefix, *folders) if p] + [leaf])
                if max_ratio is not None and info.compress_size and info.file_size / info.compress_size > max_ratio:
                    yield where, chain + folders, info, None, f"packed more than {max_ratio:g} to 1"
                    continue
                spent += info.file_size
                if max_bytes is not None and spent > max_bytes:
                    return
                if any(f[:1] in (".", "_") for f in folders):
                    continue
                suffix = posixpath.splitext(leaf)[1].lower()
                if suffix == ".zip":
                    if max_depth is not None and depth >= max_depth:
                        yield where, chain + folders, info, None, f"nested deeper than {max_depth}"
                        continue
                    inner = f"_nested_{depth}_{leaf[:-4]}"
                    try:
                        data = zf.read(info)
                        zipfile.ZipFile(io.BytesIO(data)).close()
                    except (zipfile.BadZipFile, RuntimeError, EOFError) as e:
                        yield where, chain + folders, info, None, str(e)
                        continue
                    todo.append((data, inner, chain + folders + [leaf], depth + 1))
                else:
                    yield where, chain + folders, info, zf.read(info), None


def expand_archives(
    df: DataFrame,
    path: str = "path",
    content: str = "content",
    suffixes: tuple[str, ...] = (".xml", ".csv"),
    max_depth: int | None = None,
    max_ratio: float | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Entries of ZIP archives and of the ZIPs in them, one row each.

    ``zip_chain`` lists the archives and folders down to the entry. An archive
    that cannot be read, at any depth, gives one row with ``error``, and so does
    an entry beyond ``max_depth`` or ``max_ratio``. ``max_bytes`` stops an
    archive at the entry that passes the budget. No limit holds unless given.
    """
    expand = _expander(path, content, suffixes, max_depth, max_ratio, max_bytes)
    return df.select(path, content).mapInPandas(expand, ENTRY_SCHEMA)


def _expander(path: str, content: str, suffixes: tuple[str, ...], max_depth: int | None, max_ratio: float | None, max_bytes: int | None):
    cols = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for pdf in batches:
            for name, blob in zip(pdf[path], pdf[content]):
                try:
                    n = -1
                    for entry, chain, info, data, error in _open_entries(
                        bytes(blob), posixpath.basename(name), max_depth, max_ratio, max_bytes
                    ):
                        n += error is None
                        if error is None and not entry.lower().endswith(suffixes):
                            continue
                        at = n if error is None else None
                        rows.append(
                            (name, at, entry, posixpath.basename(entry), chain, info.file_size, info.compress_size, data, error)
                        )
                        held += len(data or b"")
                        if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield pd.DataFrame(rows, columns=cols)
                            rows, held = [], 0
                except (zipfile.BadZipFile, RuntimeError, EOFError) as e:
                    rows.append((name, None, None, None, None, None, None, None, str(e)))
        if rows:
            yield pd.DataFrame(rows, columns=cols)

    return expand




LISTED = (
    "archive string, depth int, place array<int>, path string, chain array<string>, kind string, size long, compressed_size long, "
    "method int, crc long, data binary, error string"
)


def _packed(blob: bytes, info: zipfile.ZipInfo) -> bytes:
    """An entry's bytes as they lie in its archive."""
    name, extra = struct.unpack_from("<HH", blob, info.header_offset + 26)
    start = info.header_offset + 30 + name + extra
    return blob[start : start + info.compress_size]


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries as ``LISTED`` with their data unpacked; one that fails loses it and says why."""
    for batch in batches:
        method, crc, kind = (batch.column(c).to_pylist() for c in ("method", "crc", "kind"))
        data, error, start, held = [], [], 0, 0
        for i in range(len(batch)):
            blob, why = batch.column("data")[i].as_py(), None
            try:
                blob = blob if method[i] == zipfile.ZIP_STORED else zlib.decompress(blob, -15)
                why = None if zlib.crc32(blob) == crc[i] else "its checksum does not agree"
            except zlib.error as e:
                why = str(e)
            kind[i] = "error" if why else kind[i]
            data.append(None if why else blob)
            error.append(why)
            held += len(blob)
            if held > BATCH_BYTES or i + 1 == len(batch):
                new = {"kind": kind[start : i + 1], "data": data, "error": error}
                done = batch.slice(start, i + 1 - start)
                arrays = [pa.array(new[f.name], f.type) if f.name in new else done.column(f.name) for f in batch.schema]
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
                data, error, start, held = [], [], i + 1, 0


def spread_archives(
    df: DataFrame, path: str = "path", content: str = "content", suffixes: tuple[str, ...] = (".xml", ".csv"),
    max_depth: int | None = None, max_ratio: float | None = None,
) -> DataFrame:
    """The entries of ``expand_archives``, each unpacked in a task of its own: for few or large archives.

    One task reads an archive's directory and passes its entries on as they are
    packed; they are dealt to all tasks and unpacked there, so that no task
    holds more than one archive packed, or one entry unpacked beyond
    ``BATCH_BYTES``. Archives among the
    entries take the next round, all of one depth together. An entry that
    cannot be unpacked gives a row with ``error``.
    """
    names = [c.split()[0] for c in LISTED.split(", ")]
    spark = df.sparkSession

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for archive, depth, place, prefix, chain, own, blob in zip(*(batch.column(c).to_pylist() for c in ("archive", "depth", "place", "prefix", "chain", "own", "data"))):
                try:
                    zf = zipfile.ZipFile(io.BytesIO(blob))
                except (zipfile.BadZipFile, RuntimeError, EOFError, TypeError) as e:
                    rows.append((archive, depth - 1, place, own["path"], own["chain"], "error", own["size"], own["compressed_size"], None, None, None, str(e)))
                    continue
                for n, info in enumerate(zf.infolist()):
                    if info.is_dir():
                        continue
                    folders = info.filename.replace("\\", "/").split("/")[:-1]
                    leaf = posixpath.basename(info.filename)
                    where = "/".join([p for p in (prefix, *folders) if p] + [leaf])
                    row = [archive, depth, [*place, n], where, chain + folders, "other", info.file_size, info.compress_size, info.compress_type, info.CRC, None, None]
                    nested = leaf.lower().endswith(".zip")
                    if max_ratio is not None and info.compress_size and info.file_size / info.compress_size > max_ratio:
                        row[5], row[11] = "error", f"packed more than {max_ratio:g} to 1"
                    elif any(f[:1] in (".", "_") for f in folders):
                        continue
                    elif nested and max_depth is not None and depth >= max_depth:
                        row[5], row[11] = "error", f"nested deeper than {max_depth}"
                    elif info.flag_bits & 1:
                        row[5], row[11] = "error", "encrypted"
                    elif nested or where.lower().endswith(suffixes):
                        row[5] = "zip" if nested else "file"
                        if info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                            row[10] = _packed(blob, info)
                        else:
                            row[8], row[10] = zipfile.ZIP_STORED, zf.read(info)
                        held += len(row[10])
                    rows.append(tuple(row))
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(spark.createDataFrame([], LISTED).schema)
    none = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("chain", "array<string>"), ("size", "long"), ("compressed_size", "long"))])
    level = df.select(
        F.col(path).alias("archive"), F.lit(1).alias("depth"), F.array().cast("array<int>").alias("place"), F.lit("").alias("prefix"),
        F.array(naming.base_name(F.col(path))).alias("chain"), none.alias("own"), F.col(content).alias("data"),
    )
    found = None
    while True:
        entries = pin(level.mapInArrow(listed, LISTED))
        packed = entries.filter(F.col("kind").isin("file", "zip"))
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        opened = pin(packed.repartition(tasks, "archive", "place").mapInArrow(_unpack, LISTED))
        done = entries.filter(F.col("kind").isin("other", "error")).unionByName(opened.filter("kind <> 'zip'"))
        found = done if found is None else found.unionByName(done)
        nested = opened.filter("kind = 'zip'")
        if nested.isEmpty():
            break
        leaf = naming.base_name(F.col("path"))
        inner = F.concat(F.lit("_nested_"), F.col("depth").cast("string"), F.lit("_"), F.expr("substring(substring_index(path, '/', -1), 1, length(substring_index(path, '/', -1)) - 4)"))
        level = nested.select(
            "archive", (F.col("depth") + 1).alias("depth"), "place", inner.alias("prefix"), F.concat("chain", F.array(leaf)).alias("chain"),
            F.struct("path", "chain", "size", "compressed_size").alias("own"), "data",
        )
    # entries are numbered level by level, those that failed aside
    order = number_rows(found.filter("kind <> 'error'").select("archive", "depth", "place"), ["archive"], ["depth", "place"], number="n")
    numbered = found.filter("kind <> 'other'").join(order.select("archive", "place", (F.col("n") - 1).alias("entry_no")), ["archive", "place"], "left")
    return numbered.select(
        "archive", F.when(F.col("kind") == "file", F.col("entry_no")).alias("entry_no"), "path", naming.base_name(F.col("path")).alias("filename"),
        F.col("chain").alias("zip_chain"), "size", "compressed_size", F.col("data").alias("content"), "error",
    )


def inventory(entries: DataFrame) -> DataFrame:
    """Entries with their group and place: the table that conversion starts from."""
    folder = F.when(F.contains("path", F.lit("/")), naming.parent_path(F.col("path"))).otherwise(F.lit(""))
    last = F.element_at("zip_chain", -1)
    return entries.filter(F.col("error").isNull()).select(
        "archive",
        "entry_no",
        "path",
        "filename",
        naming.canonical_group(naming.group_from_chain(F.col("zip_chain"))).alias("group"),
        "size",
        "compressed_size",
        "zip_chain",
        folder.alias("folder_path"),
        F.substring_index(folder, "/", 1).alias("root_folder"),
        F.when(F.lower(last).endswith(".zip"), last).otherwise(F.lit("")).alias("business_zip"),
        "content",
    )


def budget(
    df: DataFrame,
    order: str,
    size: str,
    compressed: str | None = None,
    keys: tuple[str, ...] = (),
    max_bytes: int | None = None,
    max_files: int | None = None,
    max_ratio: float | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Entries in order while their running size and count stay within the budget.

    Entries packed tighter than ``max_ratio`` are dropped and do not count. No
    limit holds unless given.
    """
    if compressed and max_ratio is not None:
        df = df.filter((F.col(compressed) <= 0) | (F.col(size) / F.col(compressed) <= max_ratio))
    placed = number_rows(df, list(keys), [order], number="__file", sums={"__bytes": F.col(size)}, block=block)
    if max_bytes is not None:
        placed = placed.filter(F.col("__bytes") <= max_bytes)
    if max_files is not None:
        placed = placed.filter(F.col("__file") <= max_files)
    return placed.drop("__file", "__bytes")


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-8 where they are valid, else Latin-1; a leading BOM goes."""
    s = F.when(
        F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")
    ).otherwise(F.decode(content, "ISO-8859-1"))
    return F.when(s.startswith("\ufeff"), F.substring(s, 2, 2147483647)).otherwise(s)


def file_signature(size: Column, modified: Column) -> Column:
    """``size:seconds``, the mark that tells an unchanged file."""
    return F.concat(size.cast("string"), F.lit(":"), F.unix_timestamp(modified).cast("string"))


def unchanged_filter(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files to index: not yet completed under their present signature."""
    done = state.filter("completed").select("group", "filename", "file_sig").distinct()
    return files.join(done, ["group", "filename", "file_sig"], "left_anti")
