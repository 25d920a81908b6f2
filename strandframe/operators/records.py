"""Recognising and splitting structured records: admissions as predicates on a binary column, molecule texts as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import signed

#: Bytes of a grid record and most records of a grid; the molecule separator; element groups.
GRID_RECORD, GRID_MOST = 28, 8_000_000
SEPARATOR = "$$$$\n"
GROUPS = {"C": 0, "H": 1, "N": 2, "O": 3}


def little_int(data: Column, at: int) -> Column:
    """The signed 32-bit little-endian number at a byte offset; beyond the end: null."""
    octets = [F.hex(F.substring(data, at + k + 1, 1)) for k in (3, 2, 1, 0)]
    value = signed(F.conv(F.concat(*octets), 16, 10).cast("long"), 32)
    return F.when(F.octet_length(data) >= at + 4, value)


def is_record_file(data: Column) -> Column:
    """First byte 1 or 3, and a big-endian 16-bit length that isn't 0."""
    return (F.octet_length(data) >= 3) & F.hex(F.substring(data, 1, 1)).isin("01", "03") & (F.hex(F.substring(data, 2, 2)) != "0000")


def grid_records(data: Column) -> Column:
    """Records of a grid file whose header and length fit; anything else: null."""
    count, start, kind, sign, width = (little_int(data, at) for at in (8, 12, 16, 20, 24))
    n = F.abs(count)
    fits = (n > 0) & (n <= GRID_MOST) & (start == 0) & (kind == 1) & (F.abs(sign) == 1) & (width == GRID_RECORD) & (F.octet_length(data) == GRID_RECORD * (n + 1))
    return F.when(fits, n)


def is_molecule(text: Column) -> Column:
    """Whether the markers of a molecule table are there."""
    return F.contains(text, F.lit("V2000")) & F.contains(text, F.lit("M  END"))


def molecule_records(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, record, text): what stands between separators, the last part too."""
    return df.select(*key, F.posexplode(F.split(F.col(text), r"\$\$\$\$\n", -1)).alias("record", "text"))


def joined_records(records: DataFrame, key: list[str]) -> DataFrame:
    """Inverse of ``molecule_records``."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("record", "text"))), lambda r: r["text"])
    return records.groupBy(*key).agg(F.array_join(parts, SEPARATOR).alias("text"))


def fixed_point(field: Column) -> Column:
    """A ten-character coordinate of four decimals as ten-thousandths; text that isn't canonical (a negative zero too): null."""
    value = F.round(F.trim(field).try_cast("decimal(14,4)") * 10_000).cast("long")
    return F.when(fixed_text(value) == field, value)


def fixed_text(value: Column) -> Column:
    """Inverse of ``fixed_point``."""
    whole, rest = F.floor(F.abs(value) / 10_000), F.abs(value) % 10_000
    return F.lpad(F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 4, "0")), 10, " ")


def atoms(records: DataFrame, key: list[str]) -> DataFrame:
    """(key, record, atom, x, y, z, element group) of each atom line of each molecule record; lines that don't parse: nulls."""
    lines = records.select(*key, "record", F.split("text", "\n").alias("l"))
    counted = lines.where(F.size("l") >= 4).withColumn("n", F.trim(F.substring(F.try_element_at("l", F.lit(4)), 1, 3)).try_cast("int"))
    line = counted.where("n is not null and n > 0").select(*key, "record", F.posexplode(F.slice("l", 5, F.col("n"))).alias("atom", "line"))
    xyz = [fixed_point(F.substring("line", 1 + 10 * k, 10)).alias(c) for k, c in enumerate("xyz")]
    symbol = F.trim(F.substring("line", 31, 4))
    group = F.lit(4)
    for name, code in GROUPS.items():
        group = F.when(symbol == name, code).otherwise(group)
    return line.select(*key, "record", "atom", *xyz, group.alias("group"))


def admissions(data: Column) -> Column:
    """Names of all record kinds that a binary column's value may be."""
    text = F.coalesce(data.cast("string"), F.lit(""))
    kinds = {"records": is_record_file(data), "grid": grid_records(data).isNotNull(), "molecule": is_molecule(text), "hydrogen": is_molecule(text), "executable": F.hex(F.substring(data, 1, 4)) == "7F454C46"}
    return F.array_compact(F.array(*(F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in kinds.items())))
