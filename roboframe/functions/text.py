"""Text samples: filters, tokens, chunks, masks, instructions, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_blank_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """Drop null and white-space texts."""
    return rows.where(F.col(text).rlike(r"\S"))


def unwrap(text: Column) -> Column:
    """The `text` member of a JSON object, else the text itself."""
    return F.when(F.ltrim(text).startswith("{"), F.coalesce(F.get_json_object(text, "$.text"), text)).otherwise(text)


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def token_ids(tokens: Column, vocabulary: int) -> Column:
    """Built-in stand-in for a tokenizer: stable ids by crc32. Another tokenizer plugs in as a pandas_udf."""
    return F.transform(tokens, lambda t: (F.crc32(t.cast("binary")) % (vocabulary - 1) + 1).cast("int"))


def tokenize(text: Column, tokenizer, split=whitespace_tokens) -> Column:
    """Ids of a text: `tokenizer` takes the column of its tokens, as `split` makes them, and gives one of ids. A null text
    has no tokens. A tokenizer of whole texts is a pandas_udf with `split` leaving the text as it is."""
    return tokenizer(split(F.coalesce(text, F.lit(""))))


def pad_truncate(ids: Column, length: int, pad: int = 0) -> Column:
    short = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), short))


def filter_min_length(rows: DataFrame, ids: str, length: int) -> DataFrame:
    """Keep lists strictly longer than `length`."""
    return rows.where(F.size(ids) > length)


def next_token_chunk(ids: Column, length: int, start: Column | None = None) -> Column:
    """Inputs [s, s + length) and targets one later; a shorter list is used whole from 0."""
    s = F.lit(0) if start is None else F.least(start, F.greatest(F.size(ids) - 1 - length, F.lit(0)))
    n = F.least(F.lit(length), F.greatest(F.size(ids) - 1, F.lit(0)))
    return F.struct(F.slice(ids, s + 1, n).alias("inputs"), F.slice(ids, s + 2, n).alias("targets"))


def hashed_start(key: Column, ids: Column, length: int, seed: int) -> Column:
    """A start by hash of the seed and the key, each that leaves a whole chunk being as likely."""
    room = F.greatest(F.size(ids) - 1 - length, F.lit(0)) + 1
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(h, 1, 7), 16, 10).cast("long") % room).cast("int")


def loss_mask(targets: Column, ignored: list[int]) -> Column:
    """True where a target is not learned."""
    return F.transform(targets, lambda t: t.isin(ignored))


def text_to_seed(text: Column) -> Column:
    """sha256 of the text as a number, modulo 2**32 - 1: the sum of its 32-bit words, since 2**32 leaves 1."""
    h = F.sha2(text.cast("binary"), 256)
    words = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    total = words[0]
    for w in words[1:]:
        total = total + w
    return (total % F.lit(4294967295).cast("decimal(20,0)")).cast("long")


def select_instruction(by_type: Column, allowed: list[str], key: Column, seed: int) -> Column:
    """One of the instructions of the allowed types, by a hash of the key; none gives an empty string."""
    pool = F.flatten(F.map_values(F.map_filter(by_type, lambda k, _: k.isin(allowed))))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 7), 16, 10).cast("int")
    return F.when(F.size(pool) > 0, F.get(pool, pick % F.size(pool))).otherwise("")


def chat_prompt(text: Column, images: Column) -> Column:
    return F.concat(F.repeat(F.lit("<image> "), images), text)
