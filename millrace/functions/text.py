"""Record functions on text: decoding, words, token ids, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD, BOS, EOS = 0, 1, 2
#: Words are parted by ASCII white space.
BLANKS = "[ \\t\\n\\r\\x0b\\x0c]+"


def decode(column: Column, *, encoding: str = "UTF-8", normalize_newlines: bool = True, lowercase: bool = False, binary: bool = False) -> Column:
    """Bytes or any value as text; CR LF and lone CR become LF."""
    out = F.decode(column, encoding) if binary else column.cast("string")
    if normalize_newlines:
        out = F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.lower(out) if lowercase else out


def decode_text(df: DataFrame, fields: tuple[str, ...] = ("text",), **options) -> DataFrame:
    """Decode the given columns; absent ones are passed over."""
    kinds = dict(df.dtypes)
    return df.withColumns({f: decode(F.col(f), binary=kinds[f] == "binary", **options) for f in fields if f in kinds})


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def word_ids(text: Column) -> Column:
    """Stable ids of the words, from 10 up."""
    return F.transform(words(text), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % 10000 + 10)


def missing(text: Column, mode: str) -> Column:
    """What stands for a null text: an error, or the empty text."""
    if mode == "empty":
        return F.coalesce(text, F.lit(""))
    if mode == "error":
        return F.coalesce(text, F.raise_error(F.lit("the text field is missing")).cast("string"))
    raise ValueError(f"missing_field is 'error' or 'empty', not {mode!r}")


def brackets(special_tokens: str, bos: int = BOS, eos: int = EOS) -> tuple[list[int], list[int]]:
    """Ids before and after the content."""
    if special_tokens not in ("bos_eos", "bos", "eos", "none"):
        raise ValueError(f"unknown special_tokens {special_tokens!r}")
    return [bos] * ("bos" in special_tokens), [eos] * ("eos" in special_tokens)


def _ids(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values]).cast("array<bigint>")


def bracketed(ids: Column, special_tokens: str = "bos_eos", max_length: int | None = None, truncation: bool = False, bos: int = BOS, eos: int = EOS) -> Column:
    """Content within its special ids; a truncated row has at most ``max_length``."""
    before, after = brackets(special_tokens, bos, eos)
    if truncation and max_length is not None:
        ids = F.slice(ids, 1, max(0, max_length - len(before) - len(after)))
    return F.concat(_ids(before), ids, _ids(after))


def padded(ids: Column, length: int, pad: int = PAD) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))


def mask(ids: Column, length: int | None = None) -> Column:
    """Ones for tokens, zeros for padding."""
    ones = F.transform(ids, lambda _: F.lit(1).cast("tinyint"))
    return ones if length is None else F.concat(ones, F.array_repeat(F.lit(0).cast("tinyint"), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))


def tokenize(
    df: DataFrame,
    field: str = "text",
    *,
    ids: Column | None = None,
    special_tokens: str = "bos_eos",
    max_length: int | None = None,
    truncation: bool = False,
    padding: bool = False,
    missing_field: str = "error",
    add_attention_mask: bool = True,
    pad: int = PAD,
    bos: int = BOS,
    eos: int = EOS,
) -> DataFrame:
    """Add input_ids (and attention_mask). ``ids`` replaces the word ids, for
    example by a pandas UDF around a trained tokenizer."""
    if padding and max_length is None:
        raise ValueError("padding to a fixed length needs max_length")
    content = ids if ids is not None else word_ids(missing(F.col(field), missing_field))
    row = bracketed(content, special_tokens, max_length, truncation, bos, eos)
    out = df.withColumn("input_ids", row)
    if add_attention_mask:
        out = out.withColumn("attention_mask", mask(F.col("input_ids"), max_length if padding else None))
    return out.withColumn("input_ids", padded(F.col("input_ids"), max_length, pad)) if padding else out


def split_long(df: DataFrame, max_length: int, *, ids: str = "input_ids", length: str | None = None, padding: bool = False, pad: int = PAD) -> DataFrame:
    """Rows of at most ``max_length`` ids. The specials of a bracketed row
    stay where they are: the first on the first slice, the last on the last.
    Several slices are children whose lineage ends in their number. ``length``
    names a column with the number of ids, which becomes that of the slice;
    what needs only this one makes no ids."""
    size = F.col(length) if length else F.size(ids)
    n = F.greatest(F.lit(1), F.ceil(size / max_length).cast("int"))
    lineage = F.col("lineage") if "lineage" in df.columns else F.array().cast("array<int>")
    # Numbers are spread out, and each row takes its slice: rows don't carry all slices.
    out = df.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    out = out.withColumn("_ids", F.slice(F.col(ids), F.col("_i") * max_length + 1, F.lit(max_length)))
    out = out.withColumn("lineage", F.when(F.col("_n") > 1, F.concat(lineage, F.array("_i"))).otherwise(lineage)).withColumn("segment", F.col("_i"))
    out = out.withColumn(ids, padded(F.col("_ids"), max_length, pad) if padding else F.col("_ids"))
    if length:
        out = out.withColumn(length, F.lit(max_length) if padding else F.least(F.lit(max_length), F.col(length) - F.col("_i") * max_length))
    if "attention_mask" in df.columns:
        out = out.withColumn("attention_mask", mask(F.col("_ids"), max_length if padding else None))
    return out.drop("_n", "_i", "_ids")
