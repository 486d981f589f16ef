"""Markup to records: choose record elements, flatten them to paths, describe their tags.

One row holds one document; documents are parsed where they lie and only the
flat result moves.
"""

from __future__ import annotations

import re
import sys
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.plans.ranking import number_rows
from rowloom.session import pin, small_side

# Fixed values.
COMMON_RECORD_TAGS = [
    "record", "item", "entry", "row", "element",
    "document", "article", "work", "resource",
    "journal_article", "book", "peer_review",
    "dissertation", "posted_content", "component",
]
NO_RECORDS = "No records found in XML"

HELD_FIELDS = 200_000  # fields gathered before they are handed on

RECORD_COLS = "record_idx long, record_tag string, field_order array<string>, fields map<string,string>"
SUMMARY_COLS = "rows long, columns int, error string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2] if "}" in tag else tag


@dataclass
class Nodes:
    """A document as columns, one entry per element in document order.

    ``stops`` has the first element behind each one. ``events`` lists starts (an
    element's number), ends (its complement) and comments (the comment itself);
    an element's content lies between its ``opened`` and ``closed`` event.
    """

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    elements: list[ET.Element] = field(default_factory=list)
    opened: list[int] = field(default_factory=list)
    closed: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    events: list[int | ET.Element] = field(default_factory=list)

    def inside(self, i: int) -> range:
        """The element and all below it."""
        return range(i, self.stops[i])

    def children(self, i: int) -> list[int]:
        out, at = [], i + 1
        while at < self.stops[i]:
            out.append(at)
            at = self.stops[at]
        return out


def _columns(root: ET.Element) -> Nodes:
    """The columns of a tree. Comments are nodes of the tree but not of the columns."""
    n = Nodes()
    path, todo = [-1], [iter((root,))]
    while todo:
        for element in todo[-1]:
            if not isinstance(element.tag, str):
                n.events.append(element)
                continue
            at = len(n.tags)
            n.tags.append(_local(element.tag))
            n.parents.append(path[-1])
            n.elements.append(element)
            n.opened.append(len(n.events))
            n.events.append(at)
            if len(element):
                n.closed.append(-1)
                n.stops.append(-1)
                path.append(at)
                todo.append(iter(element))
                break
            n.closed.append(len(n.events))
            n.stops.append(at + 1)
            n.events.append(~at)
        else:
            todo.pop()
            at = path.pop()
            if at >= 0:
                n.closed[at] = len(n.events)
                n.stops[at] = len(n.tags)
                n.events.append(~at)
    return n


def _parse(content) -> Nodes | None:
    """The document's elements; None for what is no well-formed XML."""
    if content is None:
        return None
    reader = ET.XMLParser(target=ET.TreeBuilder(insert_comments=True, insert_pis=True))
    try:
        root = ET.fromstring(content if isinstance(content, str) else bytes(content), reader)
    except (ET.ParseError, ValueError, LookupError):
        return None
    return _columns(root)


def _choose(doc: Nodes, tag: str | None, auto: bool) -> tuple[str, list[int]]:
    """Record elements: those of the tag, else the first child tag that occurs again, else all children; the root if none."""
    if tag:
        label, found = tag, [i for i, t in enumerate(doc.tags) if t == tag]
    else:
        label, found = "FALLBACK:root_children", doc.children(0)
        again = {t for t, n in Counter(doc.tags[i] for i in found).items() if n > 1} if auto else set()
        name = next((doc.tags[i] for i in found if doc.tags[i] in again), None)
        if name is not None:
            label, found = f"AUTO:{name}", [i for i in found if doc.tags[i] == name]
    return label, found or [0]


def _fields(doc: Nodes, record: int, sep: str, include_root: bool, max_len: int | None) -> dict[str, str]:
    """Paths and values of one record in document order; of equal paths the first counts.

    Siblings of one tag are numbered from the last, which carries no number:
    the number is how many of them are still to come, itself included.
    """
    own = doc.inside(record)
    left: dict[tuple[int, str], int] = {}
    for i in own:
        kin = doc.parents[i], doc.tags[i]
        left[kin] = left.get(kin, 0) + 1
    paths = {record: doc.tags[record] if include_root else ""}
    out: dict[str, str] = {}
    for i in own:
        if i != record:
            kin = doc.parents[i], doc.tags[i]
            number = f"[{left[kin]}]" if left[kin] > 1 else ""
            left[kin] -= 1
            above = paths[kin[0]]
            paths[i] = (above + sep + kin[1] if above else kin[1]) + number
        path, element = paths[i], doc.elements[i]
        if not path:
            continue
        for name, value in element.items():
            out.setdefault(f"{path}@{name}", value[:max_len])
        if not len(element):
            out.setdefault(path, (element.text or "").strip()[:max_len])
    return out


def flatten(
    df: DataFrame,
    keys: list[str],
    content: str = "content",
    record_tag: str | None = None,
    auto: bool = True,
    sep: str = ".",
    include_root: bool = False,
    max_len: int | None = None,
) -> DataFrame:
    """Records of every document plus one summary row per document.

    Record rows carry ``record_idx, record_tag, field_order, fields``; the
    summary row has ``record_idx`` null and ``rows, columns, error``. Values
    are whole unless ``max_len`` cuts them.
    """
    kept = df.select(*keys, content)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keys)
    strings = pa.map_(pa.string(), pa.string())

    def pack(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        src, idx, tags, order, fields, counts, columns, errors = zip(*rows)
        take = pa.array(src, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(k).take(take) for k in keys]
            + [
                pa.array(idx, pa.int64()),
                pa.array(tags, pa.string()),
                pa.array(order, pa.list_(pa.string())),
                pa.array(fields, strings),
                pa.array(counts, pa.int64()),
                pa.array(columns, pa.int32()),
                pa.array(errors, pa.string()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for at, doc in enumerate(batch.column(content)):
                tree, n, header = _parse(doc.as_py()), 0, set()
                if tree is not None:
                    tag, found = _choose(tree, record_tag, auto)
                    for record in found:
                        flat = _fields(tree, record, sep, include_root, max_len)
                        if flat:
                            rows.append((at, n, tag, list(flat), list(flat.items()), None, None, None))
                            header.update(flat)
                            n += 1
                            held += len(flat)
                            if held > HELD_FIELDS:
                                yield pack(batch, rows)
                                rows, held = [], 0
                rows.append((at, None, None, None, None, n, len(header), None if n else NO_RECORDS))
            if rows:
                yield pack(batch, rows)

    names = [*keys, "record_idx", "record_tag", "field_order", "fields", "rows", "columns", "error"]
    return kept.mapInArrow(run, f"{schema}, {RECORD_COLS}, {SUMMARY_COLS}")


def records(flat: DataFrame) -> DataFrame:
    return flat.filter(F.col("record_idx").isNotNull()).drop("rows", "columns", "error")


def outcomes(flat: DataFrame) -> DataFrame:
    """One row per document: success, rows, columns, error."""
    done = flat.filter(F.col("record_idx").isNull())
    return done.drop("record_idx", "record_tag", "field_order", "fields").withColumn("success", F.col("error").isNull())


def convert(inventory: DataFrame, groups: list[str] | None = None, keys: tuple[str, ...] = ("path", "group"), **options) -> DataFrame:
    """Flatten the documents of the chosen groups; a bad one gives an error row, not a failed job."""
    chosen = inventory.filter(F.col("group").isin(groups)) if groups else inventory
    return flatten(chosen, list(keys), **options)


def header_of(recs: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of every table in order of first appearance: ``(keys, column, position)``."""
    seen = recs.select(*keys, "record_idx", F.posexplode("field_order").alias("pos", "column"))
    first = seen.groupBy(*keys, "column").agg(F.min(F.struct("record_idx", "pos")).alias("at"))
    w = Window.partitionBy(*keys).orderBy("at")
    return first.select(*keys, "column", F.row_number().over(w).alias("position"))


def to_wide(recs: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Wide table over the given columns; a field a record lacks is an empty string."""
    return recs.select(
        *keys, "record_idx", *[F.coalesce(F.try_element_at("fields", F.lit(c)), F.lit("")).alias(c) for c in columns]
    )


def elements(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Every element of every document: ``(keys, seq, depth, tag)``; the root has depth 1."""
    kept = df.select(*keys, content)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keys)

    def made(batch: pa.RecordBatch, src: list, seq: list, depth: list, tags: list) -> pa.RecordBatch:
        take = pa.array(src, pa.int64())
        arrays = [batch.column(k).take(take) for k in keys] + [pa.array(seq, pa.int64()), pa.array(depth, pa.int32()), pa.array(tags, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, "seq", "depth", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, seq, depth, tags = [], [], [], []
            for at, doc in enumerate(batch.column(content)):
                tree = _parse(doc.as_py())
                if tree is not None:
                    n, depths = len(tree.tags), []
                    for parent in tree.parents:
                        depths.append(depths[parent] + 1 if parent >= 0 else 1)
                    src.extend([at] * n)
                    seq.extend(range(n))
                    depth.extend(depths)
                    tags.extend(tree.tags)
                if len(seq) >= 50_000:
                    yield made(batch, src, seq, depth, tags)
                    src, seq, depth, tags = [], [], [], []
            yield made(batch, src, seq, depth, tags)

    return kept.mapInArrow(run, f"{schema}, seq long, depth int, tag string")


def tag_counts(elems: DataFrame, keys: list[str]) -> DataFrame:
    return elems.groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("n"))


def guess_record_tag(elems: DataFrame, keys: list[str], sample: int | None = None, least: int = 5) -> DataFrame:
    """Likely record tag per document from its elements, or from the first ``sample`` of them.

    Candidates first occur at depth 2 to 4 and more than ``least`` times; a
    common record name wins over a more frequent other one.
    """
    stats = (
        (elems if sample is None else elems.filter(F.col("seq") < sample))
        .groupBy(*keys, "tag")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("depth", "seq").alias("depth"), F.min("seq").alias("first"))
        .filter((F.col("n") > least) & F.col("depth").between(2, 4))
    )
    best = F.struct(F.lower("tag").isin(COMMON_RECORD_TAGS).alias("c"), F.col("n"), (-F.col("first")).alias("f"))
    return stats.groupBy(*keys).agg(F.max_by("tag", best).alias("record_tag"))


def top_child_tag(elems: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent tag right below the root; the earlier one of equals."""
    stats = (
        elems.filter("depth = 2").groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    )
    return stats.groupBy(*keys).agg(F.max_by("tag", F.struct("n", (-F.col("first")).alias("f"))).alias("record_tag"))


def _as_text(doc: Nodes, record: int, max_len: int | None) -> str:
    """Tag, attributes and texts of a record in document order; a record of the same tag inside shows by its tag."""
    parts: list[str] = []

    def add(prefix: str, value: str | None) -> None:
        value = (value or "").strip()
        if value:
            parts.append(prefix + value[:max_len])

    at, last = doc.opened[record], doc.closed[record]
    while at < last:
        event = doc.events[at]
        if not isinstance(event, int):
            add("", event.tail)
        elif event < 0:
            add("", doc.elements[~event].tail)
        else:
            element = doc.elements[event]
            parts.append(doc.tags[event])
            if event != record and doc.tags[event] == doc.tags[record]:
                at = doc.closed[event]
                continue
            for name, value in element.attrib.items():
                add(f"{_local(name)}=", value)
            add("", element.text)
        at += 1
    return " | ".join(parts)


def _as_xml(doc: Nodes, record: int) -> str:
    """A record written out; the writer calls itself for each level, so a deep record gets a higher limit."""
    try:
        return ET.tostring(doc.elements[record], encoding="unicode")
    except RecursionError:
        levels = {record: 1}
        for i in doc.inside(record):
            levels.setdefault(i, levels.get(doc.parents[i], 0) + 1)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(limit + 2 * max(levels.values()))
    try:
        return ET.tostring(doc.elements[record], encoding="unicode")
    finally:
        sys.setrecursionlimit(limit)


def _render(df: DataFrame, keys: list[str], content: str, make) -> DataFrame:
    kept = df.select(*keys, content)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *key, doc in pdf[[*keys, content]].itertuples(index=False, name=None):
                tree = _parse(doc)
                if tree is not None:
                    rows.extend((*key, *r) for r in make(tree))
            yield pd.DataFrame(rows, columns=[*keys, "record_idx", "record_tag", "content"])

    return kept.mapInPandas(run, f"{schema}, record_idx long, record_tag string, content string")


def record_text(
    df: DataFrame, keys: list[str], tag: str, content: str = "content",
    max_chars: int | None = None, max_records: int | None = None, max_field: int | None = None, min_chars: int = 0,
) -> DataFrame:
    """Records of a tag as ``tag | attr=value | text | child...``; those of ``min_chars`` or fewer are dropped.

    Within a record that holds records of the same tag the inner ones show by
    tag only, since they were rendered on their own. Nothing is cut unless a
    limit is given.
    """
    def make(doc: Nodes):
        found = sorted((i for i, t in enumerate(doc.tags) if t == tag), key=doc.closed.__getitem__)
        for n, i in enumerate(found[:max_records]):
            s = _as_text(doc, i, max_field)
            if max_chars is not None and len(s) > max_chars:
                s = s[:max_chars] + "..."
            if len(s) > min_chars:
                yield n, tag, s

    return _render(df, keys, content, make)


def record_xml(
    df: DataFrame, keys: list[str], content: str = "content", record_tag: str | None = None,
    max_records: int | None = None, max_chars: int | None = None,
) -> DataFrame:
    """Records as XML text with their index, however deep they are nested; longer ones than ``max_chars`` are cut and marked with dots."""
    def make(doc: Nodes):
        tag, found = _choose(doc, record_tag, True)
        for n, i in enumerate(found[:max_records]):
            s = _as_xml(doc, i)
            yield n, tag, s if max_chars is None or len(s) <= max_chars else s[:max_chars] + "..."

    return _render(df, keys, content, make)


def read_records(spark: SparkSession, path: str, tag: str, **options) -> DataFrame:
    """Records of one tag from files of any size, a large file read by many tasks: ``file, record_idx, record_tag, field_order, fields``.

    ``tag`` is the name as it is written, prefix included. Files are cut behind
    each closing tag, so a record is parsed on its own, under the name spaces
    that the file's root declares. The tag may not occur inside itself, and its
    closing tag not in comments or CDATA. ``options`` are those of ``flatten``;
    the result is that of ``flatten`` with this tag on whole documents.
    """
    end = f"</{tag}>"
    opened = re.compile(rf"<{re.escape(tag)}(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?/?>")
    spaces = re.compile(r"\sxmlns(?::[\w.-]+)?\s*=\s*(?:\"[^\"]*\"|'[^']*')")
    root = re.compile(r"<[A-Za-z_](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>")
    pieces = spark.read.option("recursiveFileLookup", "true").option("lineSep", end).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")

    def declared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [root.search(v) for v in pdf["value"]]
            yield pd.DataFrame({"file": pdf["file"], "spaces": ["".join(spaces.findall(m[0])) if m else "" for m in found]})

    first = pieces.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("value"))
    heads = pin(first.mapInPandas(declared, "file string, spaces string"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, order, records_ = [], [], []
            for at, value in enumerate(batch.column("value").to_pylist()):
                for k, m in enumerate(opened.finditer(value)):
                    src.append(at)
                    order.append(k)
                    if not m[0].endswith("/>"):
                        records_.append(value[m.start() :] + end)
                        break
                    records_.append(m[0])
            take = pa.array(src, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("file").take(take), batch.column("start").take(take), batch.column("at").take(take), pa.array(order, pa.int64()), pa.array(records_, pa.string())],
                names=["file", "start", "at", "k", "content"],
            )

    found = pieces.mapInArrow(cut, "file string, start long, at long, k long, content string").join(small_side(heads), "file")
    found = found.withColumn("content", F.concat(F.lit("<root"), "spaces", F.lit(">"), "content", F.lit("</root>")))
    flat = records(flatten(found, ["file", "start", "at", "k"], record_tag=_local_name(tag), **options)).drop("record_idx")
    placed = number_rows(pin(flat), ["file"], ["start", "at", "k"], number="n", block=F.col("start"))
    return placed.select("file", (F.col("n") - 1).alias("record_idx"), "record_tag", "field_order", "fields")


def _local_name(tag: str) -> str:
    return tag.rpartition(":")[2]
