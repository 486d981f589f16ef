"""Group names from archive names, folders and files; safe paths; short hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and names that decide grouping.
BATCH = r"(?i)^\d+[_\-]?BATCH"
ROOT_ARCHIVE = r"(?i)^.*_\d{8}_\d{4,6}.*\.zip$"
NUMBERED = r"^(\d+)[_-](.+)$"
GENERIC_FOLDERS = ["businessobjectdata", "data", "files", "content", "extracted"]
WORK_FOLDERS = ["output", "temp", "extracted"]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Everything before the last slash, ``.`` for a bare name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(name), r"^(.+)\.[^.]+$", "$1")


def alpha_prefix(s: Column) -> Column:
    """Leading letters, upper case."""
    return F.upper(F.regexp_extract(s, r"^(\p{L}+)", 1))


def is_batch_archive(name: Column) -> Column:
    return F.rlike(stem(name), F.lit(BATCH))


def is_root_archive(name: Column) -> Column:
    s = stem(name)
    return F.rlike(name, F.lit(ROOT_ARCHIVE)) | (F.contains(s, F.lit(" ")) & (F.length(s) > 30))


def _unnumbered(s: Column) -> Column:
    return F.upper(
        F.when(F.rlike(s, F.lit(NUMBERED)), F.regexp_extract(s, NUMBERED, 2)).otherwise(s)
    )


def group_from_archive(name: Column) -> Column:
    """Group named by an archive; null for batch and root archives."""
    return F.when(~(is_batch_archive(name) | is_root_archive(name)), _unnumbered(stem(name)))


def infer_group(path: Column, filename: Column) -> Column:
    """Group from the first folder, else from the file name, else ``EXTRAS``."""
    folder = F.when(F.contains(path, F.lit("/")), alpha_prefix(F.substring_index(path, "/", 1)))
    by_name = alpha_prefix(F.substring_index(stem(filename), "_", 1))
    none = F.lit("")
    return F.coalesce(F.nullif(folder, none), F.nullif(by_name, none), F.lit("EXTRAS"))


def _is_zip(name: Column) -> Column:
    return F.lower(name).endswith(".zip")


def group_from_chain(chain: Column) -> Column:
    """First usable name in a chain of archives and folders, else ``ROOT``.

    A batch archive inherits the group of what holds it, so the chain is read
    only up to its last archive that is no batch.
    """
    kept = F.transform(
        chain,
        lambda name, i: F.when(_is_zip(name) & ((i == 0) | ~is_batch_archive(name)), i + 1).otherwise(1),
    )

    def usable(name: Column) -> Column:
        folder = base_name(name)
        return F.when(_is_zip(name), group_from_archive(name)).otherwise(
            F.when(~F.lower(folder).isin(GENERIC_FOLDERS), _unnumbered(folder))
        )

    names = F.filter(
        F.transform(F.slice(chain, 1, F.coalesce(F.array_max(kept), F.lit(1))), usable),
        lambda g: g.isNotNull() & (g != ""),
    )
    return F.coalesce(F.get(names, F.lit(0)), F.lit("ROOT"))


def group_from_path(path: Column) -> Column:
    """Group of an output table: its folder, or the name prefix inside work folders."""
    parent = F.when(
        F.contains(path, F.lit("/")), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    ).otherwise(F.lit(""))
    s = F.upper(stem(path))
    prefix = F.when(F.contains(s, F.lit("_")), F.substring_index(s, "_", 1)).otherwise(F.lit("MISC"))
    return F.coalesce(F.nullif(F.when(parent.isin(WORK_FOLDERS), prefix).otherwise(parent), F.lit("")), F.lit("MISC"))


def canonical_group(g: Column) -> Column:
    return F.upper(F.trim(F.coalesce(g, F.lit("EXTRAS"))))


def safe_path(p: Column) -> Column:
    """Forward slashes, without empty, ``.`` and ``..`` parts."""
    parts = F.split(F.replace(F.coalesce(p, F.lit("")), F.lit("\\"), F.lit("/")), "/")
    kept = F.filter(parts, lambda x: ~x.isin("", ".", ".."))
    return F.coalesce(F.nullif(F.array_join(kept, "/"), F.lit("")), F.lit("file"))


def output_path(p: Column, ext: str = ".csv") -> Column:
    """Path of the table made from a markup file: same folders, other extension."""
    lp = safe_path(p)
    folder = F.when(F.contains(lp, F.lit("/")), F.concat(parent_path(lp), F.lit("/"))).otherwise(F.lit(""))
    swapped = F.regexp_replace(lp, r"(?i)\.xml$", ext)
    return F.when(F.lower(lp).endswith(".xml"), swapped).otherwise(F.concat(folder, stem(lp), F.lit(ext)))


def short_hash(s: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(s), 1, n)


def stub(filename: Column, logical_path: Column) -> Column:
    return F.concat(stem(filename), F.lit("__"), short_hash(logical_path))


def chunk_id(session: Column, filename: Column, group: Column, doc_type: Column, index: Column, text: Column) -> Column:
    """Deterministic chunk key, so that indexing again overwrites instead of duplicating."""
    return F.md5(
        F.concat_ws("::", session, filename, group, doc_type, index.cast("string"), F.substring(F.sha1(text), 1, 12))
    )
