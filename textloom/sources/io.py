"""Readers and writers: text lines, line pairs, vectors, fixed-width integers, corpora, JSON."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import corpus as C
from textloom.operators.tables import dense_ids


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value): lines of text files; .gz and .bz2 are read through their codecs."""
    return spark.read.text(path)


def read_xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of .xz text files; one task reads a file, piece by piece, as the format cannot be cut."""

    def lines(frames):
        import lzma

        for pdf in frames:
            for content in pdf["content"]:
                unpack, rest = lzma.LZMADecompressor(), b""
                for k in range(0, len(content), 1 << 20):
                    *done, rest = (rest + unpack.decompress(content[k : k + (1 << 20)])).split(b"\n")
                    yield pd.DataFrame({"value": [x.decode("utf-8", "replace") for x in done]}, dtype="str")
                yield pd.DataFrame({"value": [rest.decode("utf-8", "replace")] if rest else []}, dtype="str")

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(lines, "value string")


def edited(lines: DataFrame, edit: Callable[[Column], Column]) -> DataFrame:
    """Each line after an edit of the caller's; lines that it makes null go."""
    return lines.withColumn("value", edit(F.col("value"))).filter("value IS NOT NULL")


def write_lines(lines: DataFrame, path: str, compression: str = "none", replace: bool = False) -> None:
    """Text files; an existing path is an error unless it is to be replaced."""
    lines.select("value").write.mode("overwrite" if replace else "errorifexists").option("compression", compression).text(path)


def trimmed(lines: DataFrame) -> DataFrame:
    return lines.select(T.trim(F.col("value")).alias("value"))


def without_blank(lines: DataFrame) -> DataFrame:
    return lines.filter(T.trim(F.col("value")) != "")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value): lines by their number in each file, from 0; a large file is read by as many tasks as it has splits.

    Within a split lines are counted as they are read; a first pass counts the lines of each
    split, and a split's first number is how many lines the splits of its file before it have.
    That table has one row a split. Files of a codec that cannot be split are one split each.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("order"), "value"
    )
    splits = lines.groupBy("file", "at").agg(F.min("order").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    shifts = splits.select("file", "at", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(shifts, ["file", "at"]).select("file", (F.col("order") + F.col("shift")).alias("line_no"), "value")


def skip_lines(numbered: DataFrame, n: int) -> DataFrame:
    return numbered.filter(F.col("line_no") >= n)


def line_batches(numbered: DataFrame, size: int) -> DataFrame:
    """(file, batch, lines): runs of so many lines."""
    batch = F.floor(F.col("line_no") / size)
    rows = numbered.groupBy("file", batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("rows"))
    return rows.select("file", "batch", F.transform("rows", lambda r: r["value"]).alias("lines"))


def mono_lines(numbered: DataFrame, which: int) -> DataFrame:
    """Of line pairs the first (which > 0), the second (which < 0) or both lines (0)."""
    if not which:
        return numbered
    return numbered.filter(F.pmod("line_no", F.lit(2)) == (0 if which > 0 else 1))


def read_file_list(spark: SparkSession, path: str) -> list[str]:
    """File names, one a line; blank lines and those that begin with ; or # are left out."""
    lines = trimmed(read_lines(spark, path)).filter((F.col("value") != "") & ~F.col("value").rlike("^[;#]"))
    return [r["value"] for r in lines.collect()]


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): one a line; a ; or # begins a comment."""
    word = T.trim(F.regexp_replace("value", "[;#].*$", ""))
    return read_lines(spark, path).select(word.alias("word")).filter("word <> ''")


def read_classes(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """(word, class) from phrase TAB class lines."""
    parts = F.split("value", "\t", 2)
    phrase = T.trim(F.get(parts, F.lit(0)))
    rows = read_lines(spark, path).filter(F.size(parts) == 2)
    return rows.select((F.lower(phrase) if lower else phrase).alias("word"), T.trim(F.get(parts, F.lit(1))).alias("class"))


def read_vectors(spark: SparkSession, path: str, sparse: bool = False) -> DataFrame:
    """(v): dense "v v v" or sparse "i:v i:v" lines; blank lines are left out."""
    parse = V.parse_sparse if sparse else V.parse_dense
    return without_blank(read_lines(spark, path)).select(parse(T.trim(F.col("value"))).alias("v"))


def fixed_ints(content: Column, width: int, little: bool = True, signed: bool = False) -> Column:
    """The integers of so many bits in a binary column, in order; a rest that is too short is left out."""
    size = width // 8
    raw = F.hex(content)
    n = F.floor(F.length(raw) / (2 * size)).cast("int")
    piece = lambda i: F.substring(raw, i * 2 * size + 1, F.lit(2 * size))

    def value(i: Column) -> Column:
        digits = piece(i)
        if little:
            digits = F.concat(*[F.substring(digits, F.lit(2 * k + 1), F.lit(2)) for k in range(size - 1, -1, -1)])
        number = F.conv(digits, 16, 10).cast("decimal(20,0)")
        half = F.lit(1 << (width - 1)).cast("decimal(20,0)")
        return F.when(number >= half, number - half - half).otherwise(number) if signed else number

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array().cast("array<decimal(20,0)>"))


def to_fixed_ints(values: Column, width: int, little: bool = True) -> Column:
    """Whole numbers as a binary column of so many bits each, the inverse of fixed_ints; two's complement, higher bits are cut."""
    size = width // 8

    def one(x: Column) -> Column:
        digits = F.lpad(F.right(F.hex(x.cast("bigint")), F.lit(2 * size)), 2 * size, "0")
        return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1)]) if little else digits

    return F.unhex(F.array_join(F.transform(values, one), ""))


def save_blocks(rows: DataFrame, path: str, column: str = "block") -> None:
    """Arrays of strings as text lines, a tab between strings; marks inside are escaped, and a line of one blank escape is an empty array."""
    safe = lambda s: F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    line = F.when(F.size(column) == 0, F.lit("\\0")).otherwise(F.array_join(F.transform(column, safe), "\t"))
    write_lines(rows.select(line.alias("value")), path)


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block): arrays of strings as save_blocks wrote them."""
    parts = F.transform(F.split("value", "\t", -1), _unescaped)
    return read_lines(spark, path).select(F.when(F.col("value") == "\\0", F.array().cast("array<string>")).otherwise(parts).alias("block"))


def _unescaped(c: Column) -> Column:
    # From one backslash to the next in turn, so that an escaped backslash never begins another mark.
    marks = F.regexp_extract_all(c, F.lit(r"(?s)(\\.|[^\\]+|\\$)"), F.lit(1))
    one = lambda m: F.when(m == r"\t", "\t").when(m == r"\n", "\n").when(m == r"\\", "\\").otherwise(m)
    return F.array_join(F.transform(marks, one), "")


def save_corpus(docs: DataFrame, path: str) -> None:
    """The tables tokens (doc_id, pos, word_id) and vocab (id, word, freq, first_doc, first_pos) under path."""
    vocab = C.vocabulary_ids(C.tokens(docs))
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    held = docs.sparkSession.read.parquet(f"{path}/vocab").select(F.col("id").alias("word_id"), "word")
    C.tokens(docs).join(held, "word").select("doc_id", "pos", "word_id").write.mode("overwrite").parquet(f"{path}/tokens")


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """tokens (doc_id, pos, word) and vocab."""
    vocab = spark.read.parquet(f"{path}/vocab")
    rows = spark.read.parquet(f"{path}/tokens").join(vocab.select(F.col("id").alias("word_id"), "word"), "word_id")
    return rows.select("doc_id", "pos", "word"), vocab


def vocabulary_lines(vocab: DataFrame) -> DataFrame:
    """(value): "freq TAB word"."""
    return vocab.select(F.concat_ws("\t", F.col("freq").cast("string"), "word").alias("value"))


def from_json(s: Column, schema: str) -> Column:
    """A JSON text by a schema; null where it does not parse."""
    return F.from_json(s, schema, {"mode": "PERMISSIVE"})


def to_json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def symbols(rows: DataFrame, name: str) -> DataFrame:
    """(id, name): a dictionary of the distinct values of a text column, numbered in their order."""
    return dense_ids(rows.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct(), ["name"])


def save_map(m: DataFrame, path: str) -> None:
    """A table (key, value) of two columns as key TAB value lines; white space marks inside are escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    write_lines(m.select(F.concat_ws("\t", safe("key"), safe("value")).alias("value")), path)


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) as text from key TAB value lines."""
    parts = F.split("value", "\t", 2)

    return read_lines(spark, path).select(_unescaped(F.get(parts, F.lit(0))).alias("key"), _unescaped(F.get(parts, F.lit(1))).alias("value"))


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, dir, base, ext) of files."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    return files.select("path", "size", T.file_parts(F.col("path")).alias("p")).select("path", "size", "p.dir", "p.base", "p.ext")


# ---- signed tables, replacement, configuration ----


class WrongSignature(ValueError):
    pass


def save_signed(df: DataFrame, path: str, signature: str, version: int) -> None:
    """A Parquet table whose schema carries a signature and a version."""
    first = df.columns[0]
    df.withMetadata(first, {**df.schema[first].metadata, "signature": signature, "version": version}).write.mode("errorifexists").parquet(path)


def load_signed(spark: SparkSession, path: str, signature: str, least: int = 0) -> DataFrame:
    """The table, if its signature is the one wanted and its version is not below the least."""
    df = spark.read.parquet(path)
    facts = df.schema.fields[0].metadata
    if facts.get("signature") != signature or facts.get("version", -1) < least:
        raise WrongSignature(f"{path}: {facts.get('signature')!r} version {facts.get('version')}")
    return df


def replace_table(df: DataFrame, path: str, backup: bool = True) -> None:
    """Write beside path, then put the new table in its place; the old one stays as path.bak if wanted.

    File systems have no exchange of folders, so there is a moment between two renames. Whatever
    ends the work then leaves the old table whole under path.old; the next call, or
    ``recover_table``, puts it back. An older backup goes only when the new table is in place.
    """
    fs, at = _file_system(df.sparkSession, path)
    new, old, bak, target = (at(path + end) for end in (".new", ".old", ".bak", ""))
    df.write.mode("overwrite").parquet(path + ".new")
    recover_table(df.sparkSession, path)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(new, target):
        recover_table(df.sparkSession, path)
        raise OSError(f"cannot put {path} in its place")
    if fs.exists(old):
        fs.delete(bak, True)
        if backup:
            fs.rename(old, bak)
        else:
            fs.delete(old, True)


def recover_table(spark: SparkSession, path: str) -> bool:
    """Put the old table back where a replacement ended between its two renames; whether it had to."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path + ".old")):
        return False
    if fs.exists(at(path)):  # the new table is in place, only the tidying was left
        fs.delete(at(path + ".bak"), True)
        fs.rename(at(path + ".old"), at(path + ".bak"))
        return False
    return bool(fs.rename(at(path + ".old"), at(path)))


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_config(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Sections of an INI file, by Spark's own readers, so that any store will do."""
    import configparser

    parser = configparser.ConfigParser()
    parser.read_string("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    return {s: dict(parser[s]) for s in parser.sections()}
