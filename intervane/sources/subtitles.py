"""Timed-text documents: decoding, lines, timed lines, and byte-preserving rewriting.

A document row is (doc_id, content); a line row (doc_id, line_ix, raw) keeps its terminator, so that the lines of a document in
order are its text again. A timed line also says where its fields lie in raw (in code points, from 0).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from intervane.functions import ass as A
from intervane.functions import timing as T
from intervane.functions.rounding import bind

# The order in which encodings are tried once no byte-order mark is found.
ENCODINGS = (("utf-8", "utf-8"), ("cp932", "shift-jis"), ("euc_jp", "euc-jp"))


def decode_bytes(raw: bytes) -> tuple[str, str]:
    """(text, encoding): by byte-order mark, else the first encoding that fits strictly, else Latin-1."""
    for mark, codec, name in ((b"\xef\xbb\xbf", "utf-8", "utf-8-bom"), (b"\xff\xfe", "utf-16-le", "utf-16le"), (b"\xfe\xff", "utf-16-be", "utf-16be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(codec, "replace"), name
    for codec, name in ENCODINGS:
        try:
            return raw.decode(codec), name
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1"), "latin-1"


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def decode(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if b is None else decode_bytes(bytes(b)) for b in content], columns=["text", "encoding"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, text, encoding) of all files below path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.withColumn("d", decode("content")).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "d.text", "d.encoding")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_ix, raw, kind) with terminators kept; kind is ass if any line opens like one, else srt.

    kind is found before lines become rows: beside an explode it would be found again over the whole document for each of its lines.
    """
    text = F.coalesce("content", F.lit(""))
    styled = text.rlike(r"(?imd)^(\[Script Info\]|Dialogue:|\[V4\+? Styles\])")
    parts = F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0))
    return docs.select("doc_id", F.when(styled, "ass").otherwise("srt").alias("kind"), parts.alias("_parts")).select("doc_id", "kind", F.posexplode("_parts").alias("line_ix", "raw"))


def _offsets(fields: Column, at: Column) -> Column:
    """Place of field at (from 0) of fields that were split at commas."""
    return F.aggregate(F.slice(fields, 1, at), F.lit(0), lambda a, x: a + F.length(x) + 1)


def timed_styled(of: DataFrame) -> DataFrame:
    """Events of styled documents. Columns come from the latest Format line of the events section, or the usual ones."""
    w = Window.partitionBy("doc_id").orderBy("line_ix").rowsBetween(Window.unboundedPreceding, 0)
    line = F.regexp_replace("raw", r"[\r\n]+$", "")
    x = of.where("kind = 'ass'").withColumn("_l", line)
    section = F.when(F.col("_l").startswith("["), F.when(F.lower("_l").startswith("[events]"), "events").otherwise("other"))
    x = x.withColumn("_in", F.last(section, ignorenulls=True).over(w) == "events")
    form = F.when(F.col("_in") & F.lower("_l").startswith("format:"), F.transform(F.split(F.substring("_l", 8, 1 << 20), ","), lambda c: F.lower(F.trim(c))))
    usual = F.array(*map(F.lit, ("layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text")))
    x = x.withColumn("_f", F.coalesce(F.last(form, ignorenulls=True).over(w), usual))
    x = x.where(F.col("_in") & F.col("_l").rlike(r"(?i)^(dialogue|comment):"))
    x = x.withColumn("_n", F.size("_f")).withColumn("_p", F.instr("_l", ":")).withColumn("_body", F.expr("substring(_l, _p + 1)"))
    x = x.withColumn("_v", F.expr("split(_body, ',', _n)"))
    for name in ("start", "end", "text"):
        x = x.withColumn(f"_{name}", F.array_position("_f", name).cast("int") - 1)
    x = x.where("_start >= 0 and _end >= 0 and size(_v) > greatest(_start, _end)")
    get = lambda c: F.element_at("_v", F.col(c) + 1)
    x = x.withColumn("start", T.parse_time(F.trim(get("_start")))).withColumn("stop", T.parse_time(F.trim(get("_end")))).where("start is not null and stop is not null")
    has_text = (F.col("_text") >= 0) & (F.col("_text") < F.size("_v"))
    place = lambda c: F.col("_p") + _offsets(F.col("_v"), F.col(c))
    return x.select(
        "doc_id", "kind", "line_ix", "raw", "start", "stop",
        place("_start").alias("start_at"), F.length(get("_start")).alias("start_len"),
        place("_end").alias("stop_at"), F.length(get("_end")).alias("stop_len"),
        F.lower("_l").startswith("comment:").alias("comment"),
        F.when(has_text, F.col("_p") + F.aggregate(F.slice("_v", 1, F.greatest("_text", F.lit(0))), F.lit(0), lambda a, v: a + F.length(v) + 1)).alias("text_at"),
        F.when(has_text, F.element_at("_v", F.greatest("_text", F.lit(0)) + 1)).alias("text"),
    )


_SECONDS = r"[+-]?(?:\d+[.,]?\d*|[.,]\d+)(?:[eE][+-]?\d+)?"
#: Lines with a time on both sides of their first arrow, as T.parse_time reads it; the second ends at a space or the end of the line.
_TIMED = (
    rf"^\s*[+-]?\d+:[+-]?\d+:\s*{_SECONDS}\s*[\x{{85}}\x{{2028}}\x{{2029}}]?\x20*-->\x20*[^\S\x20]*[+-]?\d+:[+-]?\d+:"
    rf"[^\S\x20]*{_SECONDS}[^\S\x20]*[\x{{85}}\x{{2028}}\x{{2029}}]?(?:\x20|[\r\n]*\z)"
)


def timed_plain(of: DataFrame) -> DataFrame:
    """Timecode lines of plain documents; what follows the second time (coordinates) stays as it is. They have no text field.

    One pattern on raw says which lines are timed: a test of the parsed times would be pushed below their columns and find each of them anew.
    """
    x = of.where("kind = 'srt' and instr(raw, '-->') > 0").where(F.col("raw").rlike(_TIMED)).withColumn("_l", F.regexp_replace("raw", r"[\r\n]+$", ""))
    x = x.withColumn("_a", F.instr("_l", "-->") - 1).withColumn("_left", F.expr("substring(_l, 1, _a)")).withColumn("_right", F.expr("substring(_l, _a + 4)"))
    x = x.withColumn("_rt", F.ltrim("_right")).withColumn("_e", F.split_part("_rt", F.lit(" "), F.lit(1)))
    x = x.withColumn("start", T.parse_time(F.trim("_left"))).withColumn("stop", T.parse_time(F.col("_e")))
    return x.select(
        "doc_id", "kind", "line_ix", "raw", "start", "stop",
        (F.length("_left") - F.length(F.ltrim("_left"))).alias("start_at"), F.length(F.trim("_left")).alias("start_len"),
        (F.col("_a") + 3 + F.length("_right") - F.length("_rt")).alias("stop_at"), F.length("_e").alias("stop_len"),
        F.lit(False).alias("comment"), F.lit(None).cast("int").alias("text_at"), F.lit(None).cast("string").alias("text"),
    )


def timed(of: DataFrame) -> DataFrame:
    """All timed lines, numbered in order within a document as timed_ix."""
    both = timed_styled(of).unionByName(timed_plain(of))
    return both.withColumn("timed_ix", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_ix")) - 1)


def marks(of_timed: DataFrame) -> tuple[bool, bool]:
    """Whether any text has override blocks, and whether any has inline tags: where none has, no line need go through Python."""
    has = lambda c: F.coalesce(F.max(F.col("text").contains(c)), F.lit(False))
    return tuple(of_timed.agg(has("{"), has("\\")).first())


def dialogue(of_timed: DataFrame, blocks: bool = True) -> DataFrame:
    """Cues (doc_id, cue_ix, timed_ix, src_ix, start, stop): no comments, no empty or musical lines, in stable order of start.

    blocks: False if no text has override blocks; see marks().
    """
    text = F.coalesce("text", F.lit(""))
    words = F.when(F.col("text").isNull(), False).otherwise(A.non_dialogue(A.strip_blocks(text) if blocks else text))
    x = of_timed.where("not comment and stop > start").where(~words)
    w = Window.partitionBy("doc_id").orderBy("start", "timed_ix")
    return x.select("doc_id", (F.row_number().over(w) - 1).alias("cue_ix"), "timed_ix", F.col("timed_ix").alias("src_ix"), "start", "stop")


def karaoke(of_timed: DataFrame) -> DataFrame:
    """(doc_id, karaoke): whether any styled line has karaoke tags."""
    return of_timed.groupBy("doc_id").agg(F.bool_or(F.coalesce(A.has_karaoke(F.col("text")), F.lit(False))).alias("karaoke"))


def rewrite(of_lines: DataFrame, of_timed: DataFrame, transforms: DataFrame, scale_inline: bool = True) -> DataFrame:
    """(doc_id, content, rewritten, clamped): documents with new times and all other characters as they were.

    transforms: (doc_id, scale, shift), or with timed_ix one for each timed line. Times below zero become zero and are counted.
    Inline tags of styled text are scaled with a scale other than one, unless scale_inline is False. A document whose transform is the identity stays itself.
    """
    on = ["doc_id", "timed_ix"] if "timed_ix" in transforms.columns else ["doc_id"]
    x = of_timed.join(transforms, on)
    x = x.where(~T.identity(F.col("scale"), F.col("shift")) | F.lit("timed_ix" in transforms.columns))
    for c in ("start", "stop"):
        x = x.withColumn(f"_{c}", T.apply(F.col("scale"), F.col("shift"), F.col(c)))
        text = F.when(F.col("kind") == "srt", T.format_time(F.col(f"_{c}"), "srt")).otherwise(T.format_time(F.col(f"_{c}"), "ass"))
        x = x.withColumn(f"_new_{c}", text)
    scaled = F.col("text")
    if scale_inline:
        scaled = F.when(T.shift_only(F.col("scale")) | F.col("text").isNull(), F.col("text")).otherwise(A.scale_tags(F.coalesce("text", F.lit("")), F.col("scale")))
    x = x.withColumn("_new_text", scaled)
    edits = [F.struct(F.col("start_at").alias("at"), F.col("start_len").alias("n"), F.col("_new_start").alias("new")), F.struct(F.col("stop_at").alias("at"), F.col("stop_len").alias("n"), F.col("_new_stop").alias("new")), F.struct(F.coalesce("text_at", F.lit(-1)).alias("at"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.col("_new_text").alias("new"))]
    edits = F.array_sort(F.filter(F.array(*edits), lambda e: (e["at"] >= 0) & e["new"].isNotNull()))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    part = lambda at, n=None: F.substring(F.col("raw"), at + 1, F.length("raw") if n is None else n)

    def step(a: Column, e: Column) -> Column:
        new = F.concat(a["out"], part(a["at"], e["at"] - a["at"]), e["new"])
        return F.when(e["at"] < a["at"], a).otherwise(F.struct((e["at"] + e["n"]).alias("at"), new.alias("out")))

    # A line without a text field has two edits, in order; only other lines are edited one by one.
    begin, end = F.col("start_at") + F.col("start_len"), F.col("stop_at") + F.col("stop_len")
    two = F.col("text_at").isNull() & (F.col("start_at") >= 0) & (begin <= F.col("stop_at")) & F.col("_new_start").isNotNull() & F.col("_new_stop").isNotNull()
    both = F.concat(part(F.lit(0), F.col("start_at")), "_new_start", part(begin, F.col("stop_at") - begin), "_new_stop", part(end))
    each = bind(F.aggregate(edits, zero, step), lambda d: F.concat(d["out"], part(d["at"])))
    x = x.withColumn("_raw", F.when(two, both).otherwise(each))
    low = (F.col("_start") < 0).cast("int") + (F.col("_stop") < 0).cast("int")
    x = x.select("doc_id", "line_ix", "_raw", low.alias("_low"))
    y = of_lines.join(x, ["doc_id", "line_ix"], "left").withColumn("raw", F.coalesce("_raw", "raw"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "raw"))), lambda s: s["raw"]), "")
    return y.groupBy("doc_id").agg(whole.alias("content"), F.count("_raw").alias("rewritten"), F.coalesce(F.sum("_low"), F.lit(0)).alias("clamped"))


def stamp(docs: DataFrame, note: Column, mark: str = "; intervane:") -> DataFrame:
    """Styled documents (doc_id, kind, content) with one line mark + note after [Script Info], or first; older such lines go. Others stay."""
    end = F.when(F.col("content").contains("\r\n"), "\r\n").otherwise("\n")
    rows = F.transform(F.filter(F.split("content", "\n"), lambda r: ~F.ltrim(r).startswith(mark)), lambda r: F.regexp_replace(r, "\r+$", ""))
    at = F.array_position(F.transform(rows, lambda r: F.lower(F.trim(r)).startswith("[script info]")), True).cast("int")
    line = F.array(F.concat(F.lit(mark + " "), note))
    x = docs.withColumn("_rows", rows).withColumn("_at", at)
    with_line = F.concat(F.expr("slice(_rows, 1, _at)"), line, F.expr("slice(_rows, _at + 1, size(_rows))"))
    return x.withColumn("content", F.when(F.col("kind") == "ass", _joined(with_line, end)).otherwise(F.col("content"))).drop("_rows", "_at")


def _joined(rows: Column, end: Column) -> Column:
    return F.aggregate(F.slice(rows, 2, 1 << 30), F.element_at(rows, 1), lambda a, r: F.concat(a, end, r))


def read_stamp(content: Column, mark: str = "; intervane:") -> Column:
    """The note of the first stamp within the first 40 lines, NULL if there is none."""
    bare = lambda r: F.regexp_replace(r, r"^\s+|\s+$", "")
    found = F.filter(F.transform(F.slice(F.split(content, "\n"), 1, 40), bare), lambda r: r.startswith(mark))
    return F.when(F.size(found) > 0, bare(F.substring(F.try_element_at(found, F.lit(1)), len(mark) + 1, 1 << 20)))
