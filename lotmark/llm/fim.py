"""Fill-in-middle: documents cut in three and put in an order in which the middle comes last.

The index has a row per distinct text. Rows meet in an aggregation whose keys are the hash of the text and the text
itself, so texts are one only if all of their bytes are equal; the boundaries of the text's units are found once
and stored as an Elias-Fano list, a few bits each. Its documents are joined back to it as a list, and every document's
two seeded cuts are selected from the boundaries, without finding them anew for another document, seed or epoch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotmark.llm import common

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents out of a hundred that stay as they are, and those of the others whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Documents of a text that one row of the index takes; a text that more have gets further rows, in other tasks.
MEMBERS = 512
#: Bits of the upper part behind each entry of its directory.
BLOCK = 4096
HEADER = 3
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def boundaries(text: bytes, unit: str = "char") -> np.ndarray:
    """The byte at which each unit of the text begins, and its end. A unit is a code point (char), a run of characters
    that are no blanks with the blanks behind it (word), or a line with its end (line); blanks are tab to carriage
    return and space. Blanks at the start are a word of their own. An empty text has no unit."""
    b = np.frombuffer(text, dtype=np.uint8)
    if unit == "char":
        starts = np.flatnonzero((b & 0xC0) != 0x80)
    elif unit == "line":
        starts = np.append(0, np.flatnonzero(b[:-1] == 10) + 1) if len(b) else np.zeros(0, dtype=np.int64)
    elif unit == "word":
        blank = (b == 32) | ((b >= 9) & (b <= 13))
        starts = np.append(0, np.flatnonzero(blank[:-1] & ~blank[1:]) + 1) if len(b) else np.zeros(0, dtype=np.int64)
    else:
        raise ValueError(f"no such unit: {unit}")
    return np.append(starts, len(b)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """A rising list of non-negative integers in Elias-Fano form.

    The lower bits of each value stand side by side; the upper ones are a bit string with a 1 at (upper part + place).
    A directory has the number of ones before each BLOCK bits of it.
    """
    n = len(values)
    bits = max(0, int(np.log2(max(int(values[-1]), 1) / n)))
    ones = np.zeros(int(values[-1] >> bits) + n, dtype=np.uint8)
    ones[(values >> bits) + np.arange(n)] = 1
    upper = np.packbits(ones)
    before = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK), dtype=np.int64)
    directory = np.cumsum(before) - before
    lower = np.packbits((values[:, None] >> np.arange(bits)) & 1 == 1)
    return np.array([n, bits, len(directory)], dtype="<i8").tobytes() + directory.astype("<i8").tobytes() + lower.tobytes() + upper.tobytes()


def selected(form: bytes | memoryview, places: list[int]) -> list[int]:
    """The values at the given places of a packed() list. Each is found in one block, whatever the length of the list."""
    n, bits, blocks = (int(x) for x in np.frombuffer(form, dtype="<i8", count=HEADER))
    directory = np.frombuffer(form, dtype="<i8", offset=8 * HEADER, count=blocks)
    rest = np.frombuffer(form, dtype=np.uint8, offset=8 * (HEADER + blocks))
    lower, upper = rest[: (n * bits + 7) // 8], rest[(n * bits + 7) // 8 :]
    out = []
    for place in places:
        block = int(np.searchsorted(directory, place, side="right")) - 1
        part = upper[block * BLOCK // 8 : (block + 1) * BLOCK // 8]
        wanted = place - int(directory[block])
        counts = np.cumsum(ONES[part])
        byte = int(np.searchsorted(counts, wanted, side="right"))
        earlier = int(counts[byte - 1]) if byte else 0
        bit = int(np.flatnonzero(np.unpackbits(part[byte : byte + 1]))[wanted - earlier])
        value = (block * BLOCK + 8 * byte + bit - place) << bits
        if bits:
            first = place * bits
            own = np.unpackbits(lower[first // 8 : (first + bits + 7) // 8])[first % 8 : first % 8 + bits]
            value |= int((own.astype(np.int64) << np.arange(bits)).sum())
        out.append(value)
    return out


def index(docs: DataFrame, keep: list[str] | None = None, unit: str = "char", text: str = "text", members: int = MEMBERS) -> DataFrame:
    """The distinct texts of docs: body, members (an array of structs of the columns `keep`; all but the text, if None),
    n (its units) and bounds (their boundaries, packed).

    A null text counts as empty. A text that more than `members` rows have is in several rows, each with a part of
    them, so that neither a task nor a list grows with the copies; rows with equal columns are as many members. An
    empty table has an empty index.
    """
    keep = [c for c in docs.columns if c.lower() != text.lower()] if keep is None else keep
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("member"))
    rows = rows.select(F.xxhash64("body").alias("hash"), "body", "member")
    many = rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > members)
    many = common.small(common.checkpoint(many.select("hash", F.ceil(F.col("n") / members).alias("parts"))))
    rows = rows.withColumn("place", F.monotonically_increasing_id()).join(many, "hash", "left")
    rows = rows.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("place"), F.col("parts"))).otherwise(0))
    texts = rows.groupBy("hash", "part", "body").agg(F.collect_list("member").alias("members"))

    @F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("bounds", T.BinaryType())]))
    def listed(bodies: pa.Array) -> pa.Array:
        found = [boundaries(b, unit) for b in bodies.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([len(v) - 1 for v in found], pa.int64()), pa.array([packed(v) for v in found], pa.binary())], ["n", "bounds"])

    common.small_batches(docs.sparkSession)
    return texts.select("body", "members", listed("body").alias("list")).select("body", "members", "list.n", "list.bounds")


def drawn(key: Column, seed: int | str, n: Column) -> list[Column]:
    """The cuts, in order, and two numbers below a hundred for the form: from the first 32 hexadecimal digits of the SHA-256
    of seed, colon and key, in groups of eight. A null key counts as empty."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return [F.least(a, b), F.greatest(a, b), h[2] % 100, h[3] % 100]


def cut(indexed: DataFrame, key: str = "doc_id", seed: int | str = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per member of an index(): the members' columns, n, form, prefix_units, middle_units and output.

    form: `plain` (the text itself: `plain` of a hundred, and every text that is empty or holds one of the marks), `psm`
    (prefix, suffix, middle) or `spm` (suffix first). The key and the seed alone decide cuts and form, so a run with the
    same seed gives the same rows, and rows that share a key share them where their texts are equal.
    """
    marked = F.col("body").contains(PREFIX) | F.col("body").contains(SUFFIX) | F.col("body").contains(MIDDLE)
    rows = indexed.withColumn("fixed", marked | (F.col("n") == 0)).select("body", "bounds", "n", "fixed", F.explode("members").alias("member"))
    first, last, third, fourth = drawn(F.col(f"member.`{key}`"), seed, F.col("n"))
    form = F.when(F.col("fixed") | (third >= 100 - plain), "plain").when(fourth < suffix_first, "spm").otherwise("psm")
    rows = rows.select("body", "bounds", "member", "n", form.alias("form"), first.alias("first"), last.alias("last"))
    schema = T.StructType([*rows.select("member", "n", "form", "first", "last").schema.fields, T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        for batch in batches:
            for part in common.chunks(batch, "body"):
                col = {name: part.column(i) for i, name in enumerate(part.schema.names)}
                out = []
                for body, bounds, form, *places in zip(*(col[c].to_pylist() for c in ("body", "bounds", "form", "first", "last")), strict=True):
                    text = body.encode()
                    if form != "plain":
                        a, b = selected(bounds, places)
                        pieces = (s, text[b:], p, text[:a]) if form == "spm" else (p, text[:a], s, text[b:])
                        text = b"".join((*pieces, m, text[a:b]))
                    out.append(text)
                made = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(col[c] for c in ("member", "n", "form", "first", "last")), made], names=["member", "n", "form", "first", "last", "output"])

    done = rows.mapInArrow(run, schema)
    taken = [f.name for f in done.schema["member"].dataType.fields]
    named = {c: common.free(c, taken) for c in ("n", "form", "prefix_units", "middle_units", "output")}
    whole = F.col("form") == "plain"
    return done.select(
        "member.*",
        F.col("n").alias(named["n"]),
        F.col("form").alias(named["form"]),
        F.when(~whole, F.col("first")).alias(named["prefix_units"]),
        F.when(~whole, F.col("last") - F.col("first")).alias(named["middle_units"]),
        F.col("output").alias(named["output"]),
    )


def transform(docs: DataFrame, key: str = "doc_id", seed: int | str = 1, unit: str = "char", keep: list[str] | None = None) -> DataFrame:
    """Every row of docs in its form: cut(index(docs)). Columns of docs that are named as a result keep their name, and the
    result gets an underscore before its own."""
    return cut(index(docs, keep, unit), key, seed)


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form came from. No mark occurs in a text that was cut, so the first of each counts."""
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substr(output, F.length(head) + len(MIDDLE) + 1)
    first, second = F.when(form == "spm", SUFFIX).otherwise(PREFIX), F.when(form == "spm", PREFIX).otherwise(SUFFIX)
    opened = F.substr(head, F.length(first) + 1)
    start = F.call_function("substring_index", opened, second, F.lit(1))
    rest = F.substr(opened, F.length(start) + F.length(second) + 1)
    prefix, suffix = F.when(form == "spm", rest).otherwise(start), F.when(form == "spm", start).otherwise(rest)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))
