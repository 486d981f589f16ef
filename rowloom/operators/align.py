"""File-level comparison of two collections: exact, then most similar, then left over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import naming, text
from rowloom.plans.matching import MATCH_SCHEMA, bin_count, greedy_match, one_round
from rowloom.plans.ranking import number_rows
from rowloom.plans.similarity import band_thresholds, best_partners, cosine_pairs, term_suffixes
from rowloom.session import fresh, pin, small_side

# Fixed values.
SAME_MESSAGE = "✅ Content identical (SHA256 match)."
MODIFIED_MESSAGE = "🔴 Content differs (SHA mismatch)."
REMOVED_MESSAGE = "🗑️ Present in Side A only."
ADDED_MESSAGE = "➕ Present in Side B only."

SMALL_FILES = 200  # per side and bucket
SMALL_TERMS = 500_000  # term rows per bucket
TERM_CHARS = 4  # characters a term row stands for at least
BAND_ROWS = 2_000_000  # candidate rows of a bucket in a band
ID_BLOCK = 100_000
PAIR_ROWS = 512  # pairs of vectors multiplied at once
TASK_CHARS = 4_000_000  # characters whose terms a task counts
PIECE = r"(?s).{65536}[^\n]*+|.++"  # a text in pieces that end with a line, which no term crosses


def fingerprint(content: Column) -> Column:
    """SHA-256 of the UTF-8 bytes of a text."""
    return F.sha2(content.cast("binary"), 256)


def table_fingerprint(rows: DataFrame, key: str, row_idx: str, row_text: Column, fan_out: int = 1024) -> DataFrame:
    """One digest per table from its rows in order, as a hash tree with bounded groups.

    Every level hashes at most ``fan_out`` neighbours into one digest, so no
    task ever holds a whole table. The tree has four levels, or as many more as
    the longest table needs.
    """
    top = rows.agg(F.max(F.col(row_idx).cast("long")).alias("n")).first()["n"] or 0
    levels = 4
    while fan_out**levels <= top:
        levels += 1
    level = rows.select(F.col(key), F.col(row_idx).cast("long").alias("__i"), F.sha2(row_text, 256).alias("__h"))
    for _ in range(levels):
        level = (
            level.withColumn("__b", F.expr(f"__i div {fan_out}"))
            .groupBy(key, "__b")
            .agg(F.sort_array(F.collect_list(F.struct("__i", "__h"))).alias("__l"))
            .select(key, F.col("__b").alias("__i"), F.sha2(F.array_join(F.col("__l.__h"), ""), 256).alias("__h"))
        )
    return level.select(key, F.col("__h").alias("fingerprint"))


def term_counts(df: DataFrame, key: str, content: str) -> DataFrame:
    """Sparse term vectors in long form ``(key, term, tf)``; texts are dealt by key, so that their terms stay where they are."""
    return (
        df.select(key, content).repartition(key).select(key, F.explode(text.tokens(F.col(content))).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vector_norms(terms: DataFrame, key: str) -> DataFrame:
    return terms.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))


def cosine(terms: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Cosine of given pairs ``(id_a, id_b)`` over a term table; 0 without a common term.

    The vector of a document travels as one row, its terms do not. A pair that
    is given n times counts n times in its product, and comes back n times.
    """
    vectors = pin(terms.groupBy(key).agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs")))
    both = pairs.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n"))
    for s in ("a", "b"):
        both = both.join(vectors.select(F.col(key).alias(f"id_{s}"), F.col("terms").alias(f"terms_{s}"), F.col("tfs").alias(f"tfs_{s}")), f"id_{s}", "left")
    ids = [f"{c} {t}" for c, t in both.select("id_a", "id_b").dtypes]
    dots = both.mapInArrow(_dots, ", ".join([*ids, "n long, dot long, square_a long, square_b long"]))
    similarity = F.try_divide(F.col("n") * F.col("dot"), F.sqrt("square_a") * F.sqrt("square_b"))
    return dots.select("id_a", "id_b", F.coalesce(similarity, F.lit(0.0)).alias("similarity"), F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of the two vectors of every row, and of either with itself."""
    for batch in batches:
        for at in range(0, len(batch), PAIR_ROWS):
            part = batch.slice(at, PAIR_ROWS)
            owner, tf, terms = {}, {}, {}
            for s in ("a", "b"):
                n = pc.fill_null(pc.list_value_length(part.column(f"terms_{s}")), 0).to_numpy(zero_copy_only=False)
                owner[s] = np.repeat(np.arange(len(part)), n)
                tf[s], terms[s] = part.column(f"tfs_{s}").flatten().to_numpy(), part.column(f"terms_{s}").flatten()
            codes = pa.concat_arrays([terms["a"], terms["b"]]).dictionary_encode().indices.to_numpy().astype(np.int64)
            names = np.concatenate([owner["a"], owner["b"]]) * (len(codes) + 1) + codes
            _, in_a, in_b = np.intersect1d(names[: len(owner["a"])], names[len(owner["a"]) :], assume_unique=True, return_indices=True)
            dot, square_a, square_b = np.zeros((3, len(part)), dtype=np.int64)
            np.add.at(dot, owner["a"][in_a], tf["a"][in_a] * tf["b"][in_b])
            np.add.at(square_a, owner["a"], tf["a"] * tf["a"])
            np.add.at(square_b, owner["b"], tf["b"] * tf["b"])
            columns = [part.column(c) for c in ("id_a", "id_b", "n")] + [pa.array(x) for x in (dot, square_a, square_b)]
            yield pa.RecordBatch.from_arrays(columns, names=["id_a", "id_b", "n", "dot", "square_a", "square_b"])


def artifacts(df: DataFrame, artifact_id: str, path: Column, content: str, group: Column | None = None) -> DataFrame:
    """Artifact table from one row per file with its text."""
    name = naming.base_name(path)
    header = F.substring_index(F.col(content), "\n", 1)
    body = F.size(text.lines(F.col(content)))
    return df.select(
        F.col(artifact_id).cast("long").alias("artifact_id"),
        path.alias("logical_path"),
        name.alias("filename"),
        (group if group is not None else naming.infer_group(path, name)).alias("group"),
        naming.stub(name, path).alias("stub"),
        fingerprint(F.col(content)).alias("sha256"),
        F.greatest(body - 1, F.lit(0)).cast("long").alias("rows"),
        F.size(F.split(header, ",")).alias("cols"),
        F.col(content).alias("content"),
    )


def _bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return df.withColumn("bucket", F.concat_ws("\x1f", *parts))


def align(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("group", "filename")) -> DataFrame:
    """How many files each side has per key, over the union of keys."""
    na = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a"))
    nb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b"))
    zero = F.lit(0).cast("long")
    return na.join(nb, list(keys), "full_outer").select(
        *keys, F.coalesce("n_a", zero).alias("n_a"), F.coalesce("n_b", zero).alias("n_b")
    )


def match_exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """The k-th left file with a digest pairs with the k-th right file of that digest and bucket."""
    def ordinal(side: DataFrame, name: str) -> DataFrame:
        return number_rows(
            side.select("bucket", "sha256", "artifact_id"),
            ["bucket", "sha256"],
            ["artifact_id"],
            block=F.expr(f"artifact_id div {ID_BLOCK}"),
        ).withColumnRenamed("artifact_id", name)

    return ordinal(a, "id_a").join(ordinal(b, "id_b"), ["bucket", "sha256", "rn"]).select("bucket", "id_a", "id_b")


def _match_small(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Greedy cosine pairs of a bin of small buckets; pairs without a common term are left out."""
    found = []
    codes, terms = pd.factorize(np.concatenate([a.term.to_numpy(object), b.term.to_numpy(object)]))
    code_a, code_b = codes[: len(a)], codes[len(a):]
    tf_a, tf_b = a.tf.to_numpy(float), b.tf.to_numpy(float)
    id_a, id_b = a.row_id.to_numpy(), b.row_id.to_numpy()
    norm_a, norm_b = a.norm.to_numpy(), b.norm.to_numpy()
    right = b.groupby("bucket").indices
    weight = np.zeros(len(terms))
    for bucket, rows_a in a.groupby("bucket").indices.items():
        rows_b = right.get(bucket)
        if rows_b is None:
            continue
        ids_b, first_b, doc_b = np.unique(id_b[rows_b], return_index=True, return_inverse=True)
        norms_b = norm_b[rows_b][first_b]
        cand = []
        for i in np.unique(id_a[rows_a]):
            mine = rows_a[id_a[rows_a] == i]
            weight[code_a[mine]] = tf_a[mine]
            dot = np.bincount(doc_b, weights=weight[code_b[rows_b]] * tf_b[rows_b], minlength=len(ids_b))
            weight[code_a[mine]] = 0
            sim = dot / (norm_a[mine[0]] * norms_b)
            cand.extend((-s, i, j) for s, j in zip(sim[dot > 0], ids_b[dot > 0]))
        used_a, used_b = set(), set()
        for neg, i, j in sorted(cand):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                found.append((bucket, i, j, -neg))
    return pd.DataFrame(found, columns=["bucket", "id_a", "id_b", "score"])


def match_cosine(
    a: DataFrame, b: DataFrame, small_files: int = SMALL_FILES, small_terms: int = SMALL_TERMS, band_rows: int = BAND_ROWS
) -> DataFrame:
    """Greedy one-to-one pairs by cosine; with no threshold, so dissimilar files pair too.

    ``a`` and ``b`` hold ``(bucket, artifact_id, sha256, content)``. Small
    buckets are settled in bins of bounded size. In large ones pairs are found
    in bands from the most similar down, each as wide as ``band_rows`` candidates
    allow, and by mutually best pairs of blocks where one more step would take
    more; whatever shares no term is paired in order of appearance.
    """
    both = (
        a.select("bucket", "artifact_id", "sha256", "content", F.lit("a").alias("side"))
        .unionByName(b.select("bucket", "artifact_id", "sha256", "content", F.lit("b").alias("side")))
    )
    sizes = (
        both.groupBy("bucket")
        .agg(
            F.count_if(F.col("side") == "a").alias("n_a"),
            F.count_if(F.col("side") == "b").alias("n_b"),
            F.sum(F.length("content")).alias("chars"),
        )
        .filter("n_a > 0 and n_b > 0")
        .withColumn("small", F.expr(f"n_a <= {small_files} and n_b <= {small_files} and chars <= {small_terms} * {TERM_CHARS}"))
    )
    both = pin(both.join(sizes.select("bucket", "small"), "bucket"))
    chars = both.filter("small").agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    bins = F.pmod(F.xxhash64("bucket"), F.lit(bin_count(both, chars // TERM_CHARS))).alias("bin")
    vec = (
        both.select("side", "bucket", "small", F.col("artifact_id").alias("row_id"), F.explode(text.tokens(F.col("content"))).alias("term"))
        .groupBy("side", "bucket", "small", "row_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    norms = vec.groupBy("side", "row_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    small = vec.filter("small").join(norms, ["side", "row_id"]).select("side", "bucket", "row_id", "term", "tf", "norm", bins)
    pick = lambda d, s: d.filter(F.col("side") == s)
    similar = (
        pick(small, "a").groupBy("bin").cogroup(fresh(pick(small, "b")).groupBy("bin")).applyInPandas(_match_small, MATCH_SCHEMA)
    )
    large = both.filter(~F.col("small")).select("side", "bucket", "sha256", "artifact_id", "content")
    if not large.isEmpty():
        similar = similar.unionByName(_match_large(large, band_rows))
    similar = pin(similar)

    def rest(side: str, name: str) -> DataFrame:
        left = pick(both, side).select("bucket", "artifact_id").join(
            similar.select(F.col(name).alias("artifact_id")), "artifact_id", "left_anti"
        )
        return number_rows(left, ["bucket"], ["artifact_id"], block=F.expr(f"artifact_id div {ID_BLOCK}")).withColumnRenamed(
            "artifact_id", name
        )

    unlike = rest("a", "id_a").join(rest("b", "id_b"), ["bucket", "rn"]).select("bucket", "id_a", "id_b", F.lit(0.0).alias("score"))
    return similar.unionByName(unlike)


def _dealt_terms(files: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """``keys, term, tf`` of texts ``(keys, content)`` of any length: their pieces are dealt to ``tasks`` tasks, and so are their terms."""
    pieces = files.select(*keys, F.posexplode(F.regexp_extract_all("content", F.lit(PIECE), F.lit(0))).alias("piece", "part"))
    found = pieces.repartition(tasks, *keys, "piece").select(*keys, "piece", F.explode(text.tokens(F.col("part"))).alias("term"))
    found = found.groupBy(*keys, "piece", "term").agg(F.count(F.lit(1)).alias("tf"))
    return found.repartition(tasks, *keys, "term").groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def _match_large(files: DataFrame, band_rows: int) -> DataFrame:
    """Bands of falling cosine, each bucket at its own pace; a band sees only files that are still free.

    ``files`` is pinned, or rows of a pinned table. Of files with equal texts one is read.

    Where no band fits ``band_rows`` candidates, the two best partners of every
    class are worked out block against block and the mutually best pairs are
    settled; with fewer files left the next band may fit again. No band compares
    all pairs of a bucket, and no more rows than a few a class leave a block.
    """
    cls = ["side", "bucket", "cls"]
    files = files.withColumnRenamed("sha256", "cls").withColumn("at", F.monotonically_increasing_id())
    rows = pin(files.select(*cls, F.col("artifact_id").alias("row_id"), "at", F.length("content").alias("chars")))
    one = pin(rows.groupBy(*cls).agg(F.min_by(F.struct("at", "chars"), "at").alias("one")).select("one.*"))
    tasks = max(1, -(-one.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0] // TASK_CHARS))
    rows = rows.drop("at", "chars")
    terms = pin(_dealt_terms(files.join(small_side(one.select("at")), "at", "left_semi"), cls, tasks))
    norms = pin(terms.groupBy(*cls).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm")))
    terms = pin(terms.join(small_side(norms), cls))
    state = pin(rows.select("bucket").distinct().withColumn("threshold", F.lit(2.0)))
    out = None
    while True:
        open_ = rows.join(state.filter("threshold > 0").select("bucket"), "bucket", "left_semi")
        open_ = open_.groupBy("bucket").agg(F.count_distinct("side").alias("n")).filter("n = 2").select("bucket")
        rows = pin(rows.join(open_, "bucket", "left_semi"))
        if rows.isEmpty():
            break
        heads = pin(rows.groupBy("side", "bucket", "cls").agg(F.min("row_id").alias("head")))
        live = pin(term_suffixes(terms.join(heads.select("side", "bucket", "cls"), ["side", "bucket", "cls"], "left_semi")))
        state = state.join(heads.select("bucket").distinct(), "bucket", "left_semi")
        band = pin(band_thresholds(live, state, band_rows))
        state = pin(state.join(band.withColumnRenamed("threshold", "next"), "bucket", "left"))
        dense = pin(state.filter("next is null").select("bucket"))
        got = []
        if not band.isEmpty():
            mine = rows.join(band.select("bucket"), "bucket", "left_semi")
            pairs = cosine_pairs(live.join(band.select("bucket"), "bucket", "left_semi"), band)
            got.append(greedy_match(pairs, mine.filter("side = 'a'"), mine.filter("side = 'b'")))
        stuck = None
        if not dense.isEmpty():
            pairs = pin(best_partners(live.join(dense, "bucket", "left_semi").drop("suffix"), heads))
            got.append(one_round(pairs, rows.join(dense, "bucket", "left_semi"), ID_BLOCK, whole=False))
            # classes without a common term have no pair left
            stuck = dense.join(pairs.select("bucket").distinct(), "bucket", "left_anti").withColumn("none", F.lit(True))
        found = got[0] if len(got) == 1 else got[0].unionByName(got[1])
        found = pin(found)
        out = found if out is None else out.unionByName(found)
        reached = F.coalesce("next", "threshold")
        if stuck is None:
            state = pin(state.select("bucket", reached.alias("threshold")))
        else:
            state = state.join(stuck, "bucket", "left").select("bucket", F.when(F.col("none"), F.lit(0.0)).otherwise(reached).alias("threshold"))
            state = pin(state)
        taken = found.select(F.lit("a").alias("side"), F.col("id_a").alias("row_id")).unionByName(
            found.select(F.lit("b").alias("side"), F.col("id_b").alias("row_id"))
        )
        rows = rows.join(taken, ["side", "row_id"], "left_anti")
    if out is None:
        return files.sparkSession.createDataFrame([], MATCH_SCHEMA)
    return out


def compare_files(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("group", "filename")) -> DataFrame:
    """Status of every file of two artifact tables: SAME, MODIFIED, REMOVED or ADDED."""
    texts = [d.select("artifact_id", "content") for d in (a, b)]
    # digests are taken once; texts are read again only for files that have no identical partner
    a, b = (pin(_bucketed(d, list(keys)).drop("content")) for d in (a, b))
    exact = pin(match_exact(a, b))

    def free(side: DataFrame, content: DataFrame, mine: str) -> DataFrame:
        left = side.select("bucket", "artifact_id", "sha256").join(
            exact.select(F.col(mine).alias("artifact_id")), "artifact_id", "left_anti"
        )
        return left.join(content, "artifact_id")

    near = match_cosine(free(a, texts[0], "id_a"), free(b, texts[1], "id_b"))
    pairs = pin(exact.select("id_a", "id_b", F.lit(1.0).alias("score")).unionByName(near.select("id_a", "id_b", "score")))

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(
            F.col("artifact_id").alias(f"id_{s}"),
            F.col("group").alias(f"group_{s}"),
            F.col("filename").alias(f"filename_{s}"),
            F.col("rows").alias(f"rows_{s}"),
            F.col("cols").alias(f"cols_{s}"),
            F.col("sha256").alias(f"sha_{s}"),
            F.col("logical_path").alias(f"path_{s}"),
        )

    wide = side(a, "a").join(pairs, "id_a", "left").join(side(b, "b"), "id_b", "full_outer")
    paired = F.col("id_a").isNotNull() & F.col("id_b").isNotNull()
    same = paired & (F.col("sha_a") == F.col("sha_b"))
    status = (
        F.when(same, "SAME").when(paired, "MODIFIED").when(F.col("id_b").isNull(), "REMOVED").otherwise("ADDED")
    )
    zero, none = F.lit(0).cast("long"), F.lit("")
    return wide.select(
        F.coalesce("group_a", "group_b").alias("group"),
        F.coalesce("filename_a", "filename_b").alias("filename"),
        status.alias("status"),
        F.when(same, 1.0).when(paired, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("similarity"),
        F.coalesce("rows_a", zero).alias("rows_a"),
        F.coalesce("rows_b", zero).alias("rows_b"),
        F.coalesce("cols_a", F.lit(0)).alias("cols_a"),
        F.coalesce("cols_b", F.lit(0)).alias("cols_b"),
        F.coalesce("sha_a", none).alias("sha_a"),
        F.coalesce("sha_b", none).alias("sha_b"),
        F.when(same, SAME_MESSAGE).when(paired, MODIFIED_MESSAGE)
        .when(F.col("id_b").isNull(), REMOVED_MESSAGE).otherwise(ADDED_MESSAGE).alias("message"),
        F.coalesce("path_a", none).alias("path_a"),
        F.coalesce("path_b", none).alias("path_b"),
    )


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of one side whose key the other side lacks, as REMOVED and ADDED."""
    gone = a.join(b.select(key), key, "left_anti").withColumn("status", F.lit("REMOVED"))
    new = b.join(a.select(key), key, "left_anti").withColumn("status", F.lit("ADDED"))
    return gone.unionByName(new)


def compare_summary(rows: DataFrame) -> DataFrame:
    """Counts per status and the share of identical files in percent."""
    n = lambda s: F.count_if(F.col("status") == s)
    total = F.count(F.lit(1))
    return rows.agg(
        n("SAME").alias("same"),
        n("MODIFIED").alias("modified"),
        n("ADDED").alias("added"),
        n("REMOVED").alias("removed"),
        total.alias("total_files"),
        F.when(total > 0, n("SAME") / total * 100).otherwise(0.0).alias("overall_similarity"),
    )


def session_summary(rows: DataFrame) -> DataFrame:
    """Files on both sides together, matched files and the mean share of identical ones."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    total = F.count(F.lit(1))
    return rows.agg(
        (2 * n("SAME", "MODIFIED") + n("ADDED", "REMOVED")).alias("total_files"),
        n("SAME", "MODIFIED").alias("matched_files"),
        F.when(total > 0, n("SAME") / total).otherwise(0.0).alias("average_similarity"),
    )


def status_by_group(rows: DataFrame) -> DataFrame:
    """One row per group with a column per status."""
    name = F.coalesce(F.nullif(F.col("group"), F.lit("")), F.lit("ROOT"))
    n = lambda s: F.count_if(F.upper("status") == s)
    return rows.groupBy(name.alias("name")).agg(
        n("SAME").alias("same"),
        n("MODIFIED").alias("modified"),
        n("ADDED").alias("added"),
        n("REMOVED").alias("removed"),
        F.count(F.lit(1)).alias("total"),
    )


def structure_changes(a: DataFrame, b: DataFrame, by: Column, name: str) -> DataFrame:
    """Count deltas of folders or groups, only where the sides differ."""
    na = a.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("count_a"))
    nb = b.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("count_b"))
    zero = F.lit(0).cast("long")
    return (
        na.join(nb, name, "full_outer")
        .select(name, F.coalesce("count_a", zero).alias("count_a"), F.coalesce("count_b", zero).alias("count_b"))
        .filter("count_a <> count_b")
        .withColumn("delta", F.col("count_b") - F.col("count_a"))
    )


def folder_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    return structure_changes(a, b, naming.parent_path(F.col("logical_path")), "folder")


def group_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    return structure_changes(a, b, F.coalesce("group", F.lit("")), "group")


def filter_changes(rows: DataFrame, choice: str = "ALL", statuses: list[str] | None = None, search: str = "") -> DataFrame:
    """Status choice, status set and case-insensitive text on group or file name."""
    if choice == "MODIFIED":
        rows = rows.filter(F.col("status") == "MODIFIED")
    elif choice == "ADDED_REMOVED":
        rows = rows.filter(F.col("status").isin("ADDED", "REMOVED"))
    if statuses:
        rows = rows.filter(F.col("status").isin(*statuses))
    if search:
        q = F.lit(search.lower())
        rows = rows.filter(F.contains(F.lower("group"), q) | F.contains(F.lower("filename"), q))
    return rows


def folder_tree(changes: DataFrame) -> DataFrame:
    """Folder nodes with their files below them; sort by ``path_order`` to read the tree."""
    folder = F.coalesce(F.nullif(F.col("group"), F.lit("")), F.lit("root"))
    files = changes.select(
        F.concat_ws("/", folder, "filename").alias("path"),
        F.col("filename").alias("name"),
        F.lit(False).alias("is_folder"),
        F.lit(1).alias("depth"),
        F.col("status"),
        F.concat(folder, F.lit("\x00"), F.lower("filename")).alias("path_order"),
    )
    folders = changes.select(folder.alias("path")).distinct().select(
        "path",
        F.col("path").alias("name"),
        F.lit(True).alias("is_folder"),
        F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("status"),
        F.col("path").alias("path_order"),
    )
    return folders.unionByName(files)
