"""Numbers, bits, texts and maps as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The attribute bits of files, and the block of the cipher.
READ_ONLY, HIDDEN, SYSTEM, DIRECTORY = 1, 2, 4, 16
CIPHER_BLOCK = 16


def decimal_width(n: Column) -> Column:
    """Digits of a number that is not negative; one for 0."""
    return F.length(n.cast("string")).cast("int")


def bit_length(n: Column) -> Column:
    """Bits up to the highest that is set; none for 0."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n))).cast("int")


def align16(n: Column) -> Column:
    """Up to a multiple of the cipher's block; null where that leaves 64 bits."""
    up = F.ceil(n.cast("decimal(20,0)") / CIPHER_BLOCK).cast("decimal(20,0)") * CIPHER_BLOCK
    return F.when(up < F.lit(2).cast("decimal(20,0)") * (1 << 62) * 2, up).cast("decimal(20,0)")


def checked_block_size(n: Column) -> Column:
    """The size, or null unless it is a positive multiple of four."""
    return F.when((n > 0) & (n % 4 == 0), n)


def checked_volume(n: Column, most: int = 1 << 20) -> Column:
    """The volume's number; null beyond the bound."""
    return F.when((n >= 0) & (n < most), n)


def unix_mode(attributes: Column) -> Column:
    return attributes.bitwiseAND(F.lit(0xFFFF))


def has_attribute(attributes: Column, bit: int) -> Column:
    return attributes.bitwiseAND(F.lit(bit)) != 0


def over_limit(data_size: Column, unpacked_size: Column, dictionary: Column, most_data: int, most_unpacked: int, most_dictionary: int) -> Column:
    """The first bound that a member breaks: data, unpacked (null: unknown, breaks none), dictionary; else null."""
    return F.when(data_size > most_data, "data").when(unpacked_size > most_unpacked, "unpacked").when(dictionary > most_dictionary, "dictionary")


def truncated(text: Column, n: int) -> Column:
    """At most n letters, the last three of a longer text being dots."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 3), F.lit("...")))


def utc_parts(seconds: Column) -> list[Column]:
    """Year, month, day, hour, minute and second in UTC of seconds since 1970."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    return [F.year(day).alias("year"), F.month(day).alias("month"), F.day(day).alias("day"), F.floor(rest / 3600).cast("int").alias("hour"), F.floor(rest % 3600 / 60).cast("int").alias("minute"), (rest % 60).cast("int").alias("second")]


def canonical_json(*columns: Column) -> Column:
    """JSON with the fields in the order given, nulls included, without spaces."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def recorded(values: Column, phase: str | Column) -> Column:
    """A map's value for a phase, null if the phase was not seen."""
    return F.try_element_at(values, F.lit(phase) if isinstance(phase, str) else phase)


def perf_counters(output: Column) -> Column:
    """A map of counters from lines `value,unit,event,...`; values that are no numbers, such as not counted ones, are left out."""
    rows = F.transform(F.split(output, "\n"), lambda line: F.split(line, ","))
    good = F.filter(rows, lambda r: (F.size(r) >= 3) & F.get(r, F.lit(0)).rlike(r"^\d+(\.\d+)?$"))
    return F.map_from_entries(F.transform(good, lambda r: F.struct(F.regexp_replace(F.get(r, F.lit(2)), r":[a-zA-Z]+$", "").alias("key"), F.get(r, F.lit(0)).cast("double").alias("value"))))
