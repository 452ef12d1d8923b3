"""Line deduplication by overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is hashed; hashes that occur more than once anywhere are repeated
windows. A window's first occurrence, by document and line, stays; each later one covers its three lines,
and a document loses the lines that its covered windows have together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotmark.llm import common

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2): the windows of all texts; pos is that of the first line, from 0. Windows
    of blank lines alone are left out, or paragraphs' spacing would count as a repeated passage."""
    lines = "split(text, '\\n')"
    # a window's hash is that of its lines, two of 64 bits; -1 stands for blank windows
    blank = f"forall(slice(ls, i + 1, {size}), l -> trim(l) = '')"
    each = f"transform(sequence(0, size(ls) - {size}), i -> if({blank}, null, struct(i as pos, xxhash64(slice(ls, i + 1, {size})) as h1, xxhash64(1, slice(ls, i + 1, {size})) as h2)))"
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.expr(lines).alias("ls")).where(f"size(ls) >= {size}")
    return cut.select("doc_id", "text_hash", F.explode(F.expr(each)).alias("w")).where("w is not null").select("doc_id", "text_hash", "w.*")


def covered(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, gone): for each document that loses lines, their positions, ascending."""
    found = windows(docs, size)
    place = F.struct("doc_id", "pos", "text_hash")
    # stored, so that the join below has two plain shuffles and adaptive execution can split a window's occurrences
    repeated = common.checkpoint(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last"))
    later = found.join(repeated, ["h1", "h2"]).where("not (doc_id <=> first.doc_id and pos = first.pos and text_hash = first.text_hash)")
    starts = later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("starts"))
    spread = F.expr(f"array_sort(array_distinct(flatten(transform(starts, p -> sequence(p, p + {size - 1})))))")
    return starts.select("doc_id", "text_hash", spread.alias("gone"))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the lines that later occurrences of repeated windows cover; adds n_lines and n_removed.

    Lines are what line feeds separate, compared as they are. Occurrences are ordered by doc_id (nulls
    first), then by position, then by the text's hash where doc_ids repeat; windows may repeat within one
    text. Rows that are equal in doc_id and text are one document and all lose the same lines. Texts that are
    null or have fewer lines than a window stay as they are (n_lines of a null text is 0). A text may lose
    all its lines and is then empty. n_chars, where docs has it, is made anew for texts that lose lines. An
    empty table gives an empty result; other columns pass through, but for n_lines and n_removed.
    """
    marks = covered(docs, size).toDF("id", "hash", "gone")
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    # the lines take the text's place in the shuffle, and joined again they are the text
    here = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    out = here.join(marks, F.expr("row.doc_id <=> id and text_hash = hash"), "left")
    left = "transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i])"
    text = F.expr(f"array_join(if(gone is null, lines, {left}), '\n')")
    out = out.select(
        "row",
        text.alias("text"),
        F.expr("if(lines is null, 0, size(lines))").alias("n_lines"),
        F.expr("if(gone is null, 0, size(gone))").alias("n_removed"),
    )
    columns = {c: F.col("row").getField(c) for c in rest} | {"text": F.col("text")}
    if "n_chars" in columns:
        made = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, made).otherwise(columns["n_chars"])
    names = [c for c in docs.columns if c in columns]
    return out.select(*[columns[c].alias(c) for c in names], "n_lines", "n_removed")
