"""Splitting oversized texts at natural boundaries; long ones by ranges of bytes.

A text of one range is split where it is. A longer one is a file, or is written to the shared folder as one, and no
worker loads it whole: (1) the worker of a range reads its bytes with a halo and finds, for every place at which a cut
may come in from the range before, where the cuts leave the range and how many there are; (2) these small tables of
boundaries are stitched in order, with the prefix sums of lengths and numbers of pieces; (3) the worker of a range,
which now knows where its first piece begins, reads its bytes again and gives its pieces by their places. The pieces
are those that one worker with the whole text would make.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.ranks import bucketed_prefix_sum
from marlstone.functions.strings import folded
from marlstone.session import cut, new_path

#: Bytes of a range; it has at least eight limits in bytes.
RANGE_BYTES = 4096
#: Kinds of boundaries, best first: what stands before the cut.
BOUNDARIES = (("paragraph", ("\n\n", "\r\n\r\n", "\r\r")), ("line", ("\n", "\r")), ("sentence", (". ", "! ", "? ", ".\t")), ("space", (" ", "\t")))


def best_cut(text: str, low: int, soft: int, high: int) -> tuple[int, str]:
    """The last position in (low, high] that follows a boundary, the better kinds in (soft, high] first."""
    for floor in (soft, low) if soft > low else (low,):
        for kind, marks in BOUNDARIES:
            at = max(text.rfind(m, max(0, floor + 1 - len(m)), high) + len(m) if (text.rfind(m, max(0, floor + 1 - len(m)), high)) >= 0 else -1 for m in marks)
            if at > floor and at <= high:
                if text[at - 1] == "\r" and text[at : at + 1] == "\n":  # not between the two of a line end
                    at = at + 1 if at < high else at - 1
                if at > floor:
                    return at, kind
    return high, "forced"


def pieces_of(text: str, begin: int, end: int, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at end) of text[begin:end], each at most limit long, each starting overlap
    characters before the end of the one before."""
    out, at = [], begin
    while end - at > limit:
        cut, kind = best_cut(text, at + overlap, at + max(overlap, limit // 2), at + limit)
        out.append((at, cut, kind))
        at = cut - overlap
    out.append((at, end, "end"))
    return out


def _sane(limit: int, overlap: int) -> tuple[int, int]:
    limit = max(1, int(limit))
    return limit, min(max(0, int(overlap)), limit // 2)


def holds_stretch(text: str, limit: int) -> bool:
    """Whether a text holds a stretch longer than limit without white space."""
    return any(len(x) > limit for x in _blanks.split(text))


_blanks = re.compile(r"[ \t\r\n]")

# --- ranges of bytes -----------------------------------------------------------------------------------------------

_files: dict = {}


def read_range(path: str, offset: int, n: int) -> bytes:
    """n bytes of a file from offset on, of any file system that Arrow knows; the file is not read otherwise."""
    from pyarrow import fs

    if path not in _files:
        if len(_files) > 64:
            _files.clear()
        system, at = fs.FileSystem.from_uri(path)
        _files[path] = system.open_input_file(at)
    return _files[path].read_at(n, offset)


def _start(data: bytes, at: int) -> int:
    """The first code point that starts at at or later."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def load_range(path: str, base: int, total: int, no: int, size: int, limit: int) -> tuple[str, int, int, bool]:
    """(text, first, last, ends) of range no of the text in total bytes from base on: the range is text[first:last], with
    halos of more than a limit on either side; ends if the halo reaches the end of the text. A code point belongs to
    the range in which it starts; bytes that are no UTF-8 count as one code point each."""
    halo = 4 * (limit + 8)
    a, z = max(0, no * size - halo), min(total, (no + 1) * size + halo)
    data = read_range(path, base + a, z - a)
    begin = _start(data, 0) if a else 0
    stop = len(data)
    if z < total:  # the last code point may be cut off
        stop -= 1
        while stop > 0 and data[stop] & 0xC0 == 0x80:
            stop -= 1
    read = lambda x, y: data[x:y].decode("utf-8", "surrogateescape")
    text = read(begin, stop)
    first, last = (len(read(begin, min(stop, _start(data, x - a)))) for x in (no * size, min(total, (no + 1) * size)))
    return text, first, last, z == total


def _chain(text: str, ends: bool, limit: int, overlap: int):
    """A function from the place at which a piece begins to where it ends and what it ends at."""

    def step(at: int) -> tuple[int, str]:
        if ends and len(text) - at <= limit:
            return len(text), "end"
        return best_cut(text, at + overlap, at + max(overlap, limit // 2), at + limit)

    return step


def entries(text: str, first: int, limit: int, overlap: int) -> list[int]:
    """The places within a limit of first at which a cut from before may lie: behind a blank, before the end of a line, or
    where no blank has stood for so long that a cut may be forced."""
    blank, out = -1, []
    for i in range(max(0, first - limit), min(first + limit, len(text)) + 1):
        if i > 0 and text[i - 1] in " \t\r\n":
            blank = i
        if i >= first and (blank == i or text[i : i + 1] == "\r" or i - blank >= limit - overlap or i == len(text)):
            out.append(i)
    return out


def boundaries(text: str, first: int, last: int, ends: bool, limit: int, overlap: int, initial: bool) -> tuple[list[int], list[int], list[int]]:
    """(entry, exit, pieces): for each place, counted from first, at which a cut may come in, where the cuts leave the
    range, counted from last (-1 if the text ends before), and how many pieces begin in between. initial: the text
    begins here, and the only entry is its begin."""
    step, known = _chain(text, ends, limit, overlap), {}

    def follow(at: int) -> tuple[int, int]:
        way = []
        while at not in known:
            way.append(at)
            end, kind = step(at)
            if kind == "end":
                known[at] = (-1, 1)
            elif end >= last:
                known[at] = (end - last, 1)
            else:
                at = end - overlap
        out = known[at]
        for x in reversed(way):
            if x not in known:
                out = known[x] = (out[0], out[1] + 1)
        return out

    starts = [(0, first)] if initial else [(c - first, c - overlap) for c in entries(text, first, limit, overlap)]
    made = [(c, *follow(at)) for c, at in starts]
    return [m[0] for m in made], [m[1] for m in made], [m[2] for m in made]


def pieces_in(text: str, first: int, last: int, ends: bool, limit: int, overlap: int, entry: int, initial: bool) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pieces that begin in a range, whose first cut came in at entry."""
    step, out, at = _chain(text, ends, limit, overlap), [], first if initial else first + entry - overlap
    while True:
        end, kind = step(at)
        out.append((at, end, kind))
        if kind == "end" or end >= last:
            return out
        at = end - overlap


def limit_of(doc_type: Column, limits: DataFrame, most: int = 10_000) -> Column:
    """struct(max_chars, overlap_chars) for a type, by the fixed table of limits; more than most rows raise an error."""
    rows = limits.select(folded(F.col("doc_type")).alias("t"), "max_chars", "overlap_chars").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} limits")
    table = {r["t"]: (r["max_chars"], r["overlap_chars"]) for r in rows if r["t"] is not None and r["max_chars"] is not None}
    value = lambda m, o: F.struct(F.lit(m).cast("int").alias("max_chars"), F.lit(o or 0).cast("int").alias("overlap_chars"))
    rest = value(*table["*"]) if "*" in table else value(2**31 - 1, 0)
    named = [(F.lit(t), value(*v)) for t, v in table.items() if t != "*"]
    if not named:
        return rest
    return F.coalesce(F.create_map(*[c for pair in named for c in pair])[folded(doc_type)], rest)


def spooled(df: DataFrame, key: str = "_key", at: str = "_at", text: str = "_text") -> DataFrame:
    """(key, at, path, base, total, max_chars, overlap_chars): each text as bytes in a file of the shared folder, one for
    each batch; a task that is run again writes files of its own."""
    folder = new_path(df.sparkSession, "texts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            system, place = fs.FileSystem.from_uri(folder)
            system.create_dir(place, recursive=True)
            name, base, out = f"{uuid.uuid4().hex}.txt", 0, []
            with system.open_output_stream(f"{place}/{name}") as f:
                for k, t, x, m, o in zip(b[key], b[at], b[text], b["max_chars"], b["overlap_chars"]):
                    data = x.encode("utf-8", "surrogateescape")
                    f.write(data)
                    out.append((k, t, f"{folder}/{name}", base, len(data), m, o))
                    base += len(data)
            yield pd.DataFrame(out, columns=[key, at, "path", "base", "total", "max_chars", "overlap_chars"])

    kind = lambda c: df.schema[c].dataType.simpleString()
    made = df.select(key, at, text, "max_chars", "overlap_chars").mapInPandas(run, f"{key} {kind(key)}, {at} {kind(at)}, path string, base long, total long, max_chars int, overlap_chars int")
    return cut(made, "spooled")


def stitched(files: DataFrame, range_bytes: int = RANGE_BYTES, key: str = "_key", at: str = "_at") -> DataFrame:
    """A row for each range of files(key, at, path, base, total, max_chars, overlap_chars), stitched in order: range_no,
    size, entry (-1 if no piece begins in it), n_pieces, first_piece, first_char and forced, which is the text's."""
    kind = lambda c: files.schema[c].dataType.simpleString()
    own = f"{key} {kind(key)}, {at} {kind(at)}, path string, base long, total long, max_chars int, overlap_chars int, size long, range_no int"
    ranged = files.withColumn("size", F.greatest(F.lit(range_bytes), 8 * F.col("max_chars").cast("bigint")))
    ranged = ranged.withColumn("range_no", F.explode(F.sequence(F.lit(0), F.floor((F.greatest("total", F.lit(1)) - 1) / F.col("size")).cast("int"))))
    # ranges, not texts, are spread over the tasks; ranges next to each other may go to different ones
    ranged = ranged.select(*[c.strip().split(" ")[0] for c in own.split(",")]).repartition(F.col("path"), F.col("base"), F.floor(F.col("range_no") / 16))

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False, name=None):
                row = dict(zip(b.columns, r))
                limit, overlap = _sane(row["max_chars"], row["overlap_chars"])
                text, first, last, ends = load_range(row["path"], row["base"], row["total"], row["range_no"], row["size"], limit)
                body = text[first:last]
                runs = _blanks.split(body)
                row["entries"], row["exits"], row["pieces"] = boundaries(text, first, last, ends, limit, overlap, row["range_no"] == 0)
                row |= {"body": len(body), "lead": len(runs[0]), "trail": len(runs[-1]), "inner": max(map(len, runs))}
                rows.append(row)
            yield pd.DataFrame(rows, columns=[*b.columns, "entries", "exits", "pieces", "body", "lead", "trail", "inner"])

    table = cut(ranged.mapInPandas(bounds, f"{own}, entries array<int>, exits array<int>, pieces array<int>, body int, lead int, trail int, inner int"), "boundaries")

    def stitch(g: pd.DataFrame) -> pd.DataFrame:
        """The ranges of one text, in order: small tables, as many as the text has ranges."""
        g = g.sort_values("range_no")
        entry, piece, char, open_, most, out = 0, 0, 0, 0, 0, []
        for r in g.itertuples(index=False):
            n = 0
            leaves = -1
            if entry >= 0:
                i = int(np.searchsorted(np.asarray(r.entries), entry))
                if r.entries[i] != entry:
                    raise ValueError(f"no boundary at {entry} in range {r.range_no} of {r.path}")
                n, leaves = int(r.pieces[i]), int(r.exits[i])
            out.append((entry, n, piece, char))
            entry, piece, char = leaves, piece + n, char + r.body
            whole = open_ + r.lead
            most = max(most, whole, r.inner)
            open_ = whole if r.lead == r.body else r.trail
        g[["entry", "n_pieces", "first_piece", "first_char"]] = out
        g["forced"] = int(most > g["max_chars"].iloc[0])
        return g[[*stitched_columns]]

    stitched_columns = [*[c.strip().split(" ")[0] for c in own.split(",")], "entry", "n_pieces", "first_piece", "first_char", "forced"]
    return table.groupBy("path", "base").applyInPandas(stitch, f"{own}, entry int, n_pieces int, first_piece int, first_char long, forced int")


def _emit(row: dict) -> Iterator[tuple[int, int, int, str, str]]:
    """(piece_no, start, length, kind, piece) of a stitched range."""
    limit, overlap = _sane(row["max_chars"], row["overlap_chars"])
    text, first, last, ends = load_range(row["path"], row["base"], row["total"], row["range_no"], row["size"], limit)
    for k, (a, z, kind) in enumerate(pieces_in(text, first, last, ends, limit, overlap, row["entry"], row["range_no"] == 0)):
        yield row["first_piece"] + k, row["first_char"] + a - first, z - a, kind, text[a:z].encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def split_files(spark: SparkSession, folder: str, max_chars: int, overlap_chars: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, piece_no, start_pos, n_chars, cut_kind, piece) of the text files below a folder, none of which is read whole.

    Files of up to max_chars are one piece; empty files give none. Positions and lengths are code points.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("_key"), F.lit(0).alias("_at"), "path", F.lit(0).cast("bigint").alias("base"), F.col("length").alias("total"))
    ranges = stitched(listed.filter("total > 0").select("*", F.lit(max_chars).alias("max_chars"), F.lit(overlap_chars).alias("overlap_chars")), range_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(r["path"], *p) for r in b.to_dict("records") for p in _emit(r)]
            yield pd.DataFrame(out, columns=["path", "piece_no", "start_pos", "n_chars", "cut_kind", "piece"])

    return cut(ranges, "stitched").filter("entry >= 0").mapInPandas(run, "path string, piece_no int, start_pos long, n_chars int, cut_kind string, piece string")


def _oversized(df: DataFrame, limits: DataFrame, key: str, at: str, text: str, type_: str, range_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(of one range, of more): the texts longer than their limits."""
    rows = df.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(text).alias("_text"), limit_of(F.col(type_), limits).alias("_l")).select("_key", "_at", "_text", "_l.*")
    rows = rows.filter(F.length("_text") > F.col("max_chars"))
    long = F.octet_length("_text") > F.greatest(F.lit(range_bytes), 8 * F.col("max_chars").cast("bigint"))
    return rows.filter(~long), rows.filter(long)


def counted(df: DataFrame, limits: DataFrame, key: str = "chunk_id", at: str = "loaded_at", text: str = "text", type_: str = "doc_type", range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """((key, at, n_pieces, forced), the stitched ranges of the longer ones) of each text that is longer than its limit.

    forced is 1 if the text holds a stretch longer than the limit without space, tab, carriage return or line feed. Null
    and empty texts and ones within the limit give no rows. The overlap is at most half the limit. Texts whose type has
    no limit and no '*' is given are never split. Repeated rows give repeated rows. Lengths are code points.
    """
    kind = lambda c: df.schema[c].dataType.simpleString()
    short, long = _oversized(df, limits, key, at, text, type_, range_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, m, o in zip(b["_text"], b["max_chars"], b["overlap_chars"]):
                limit, overlap = _sane(m, o)
                out.append((len(pieces_of(t, 0, len(t), limit, overlap)), int(holds_stretch(t, limit))))
            n, forced = zip(*out) if out else ((), ())
            yield pd.DataFrame({"_key": b["_key"], "_at": b["_at"], "n_pieces": pd.Series(n, dtype="int32", index=b.index), "forced": pd.Series(forced, dtype="int32", index=b.index)})

    one = short.mapInPandas(run, f"_key {kind(key)}, _at {kind(at)}, n_pieces int, forced int")
    ranges = cut(stitched(spooled(long), range_bytes), "stitched")
    many = ranges.groupBy("path", "base").agg(F.first("_key").alias("_key"), F.first("_at").alias("_at"), F.sum("n_pieces").cast("int").alias("n_pieces"), F.max("forced").alias("forced")).drop("path", "base")
    names = {"_key": key, "_at": at}
    return one.unionByName(many).withColumnsRenamed(names), ranges


def split_chunks(chunks: DataFrame, limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All chunks within their limits: section_name kept, chunk_index renumbered from 0 within doc_id.

    Of a chunk indexed again, the latest delivery counts. Chunks within their limit, and null and empty ones, are one
    piece. Order within a document: the old chunk_index, then chunk_id, then the piece. First pieces are counted and
    numbered, by ids alone; then the texts of one range move once, to the latest delivery and its numbers, and the pieces
    of longer ones are read from their files.
    """
    made, ranges = counted(chunks, limits, range_bytes=range_bytes)
    n = made.groupBy(F.col("chunk_id").alias("_id"), F.col("loaded_at").alias("_at")).agg(F.max("n_pieces").alias("_n"))
    last = F.struct("loaded_at", "doc_id", "chunk_index")
    head = chunks.groupBy("chunk_id").agg(F.max_by(last, last).alias("h")).select("chunk_id", "h.*")
    rows = head.join(n, F.col("chunk_id").eqNullSafe(F.col("_id")) & F.col("loaded_at").eqNullSafe(F.col("_at")), "left")
    rows = rows.select("chunk_id", "doc_id", "chunk_index", "loaded_at", F.coalesce("_n", F.lit(1)).alias("_n"), F.coalesce(F.floor(F.col("chunk_index") / 1024), F.lit(-1)).alias("_bucket"))
    rows = bucketed_prefix_sum(rows, ["doc_id"], ["_bucket"], [F.col("chunk_index"), F.col("chunk_id")], F.col("_n"), "_upto")
    numbers = cut(rows.select(F.col("chunk_id").alias("_id"), F.col("loaded_at").alias("_at"), (F.col("_upto") - F.col("_n")).cast("int").alias("_first")), "numbers")

    meta = ["chunk_id", "doc_id", "doc_name", "doc_type", "section_name", "section_number"]
    best = F.row_number().over(W.partitionBy("chunk_id").orderBy(F.desc_nulls_last("loaded_at"), F.desc("doc_id"), F.desc("chunk_index")))
    # the texts of several ranges stay behind
    size = F.greatest(F.lit(range_bytes), 8 * F.col("_l.max_chars").cast("bigint"))
    kept = chunks.select(*meta, "chunk_index", "loaded_at", "text").withColumn("_l", limit_of(F.col("doc_type"), limits))
    kept = kept.withColumn("_long", F.coalesce((F.octet_length("text") > size) & (F.length("text") > F.col("_l.max_chars")), F.lit(False)))
    kept = kept.withColumn("text", F.when(~F.col("_long"), F.col("text")))
    latest = kept.withColumn("_best", best).filter("_best = 1").drop("_best", "chunk_index", "loaded_at")
    latest = latest.join(numbers, F.col("chunk_id").eqNullSafe(F.col("_id"))).select(*meta, "text", "_l.*", "_long", "_first", "_at")

    def one_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                own = tuple(getattr(r, c) for c in meta)
                if r.text is None or len(r.text) <= r.max_chars:
                    out.append((*own, r.first, 0, 0, 0 if r.text is None else len(r.text), "whole", r.text))
                    continue
                for k, (a, z, kind) in enumerate(pieces_of(r.text, 0, len(r.text), *_sane(r.max_chars, r.overlap_chars))):
                    out.append((*own, r.first + k, k, a, z - a, kind, r.text[a:z]))
            yield pd.DataFrame(out, columns=[*meta, *made_columns])

    def of_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(*(r[c] for c in meta), r["first"] + p[0], *p) for r in b.to_dict("records") for p in _emit(r)]
            yield pd.DataFrame(out, columns=[*meta, *made_columns])

    made_columns = ["chunk_index", "piece_no", "start_pos", "n_chars", "cut_kind", "text"]
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in meta)
    schema = f"{kinds}, chunk_index int, piece_no int, start_pos int, n_chars int, cut_kind string, text string"
    short = latest.filter("NOT _long").withColumnRenamed("_first", "first").mapInPandas(one_range, schema)
    once = ranges.filter("entry >= 0").dropDuplicates(["_key", "_at", "range_no"])  # deliveries that were repeated
    long = once.join(latest.filter("_long").drop("text", "max_chars", "overlap_chars").withColumnsRenamed({"_first": "first", "_at": "_when"}), F.col("_key").eqNullSafe(F.col("chunk_id")) & F.col("_at").eqNullSafe(F.col("_when")))
    return short.unionByName(long.drop("_key", "_at", "_when", "_long").mapInPandas(of_ranges, schema))
