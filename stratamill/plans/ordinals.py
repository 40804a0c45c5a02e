"""Sets of ordinals as compressed bitmaps, for spaces whose vectors are never proposed twice.

A set is a table of blocks of BITS ordinals: (block, n, bits), where bits is null for a
full block and blocks without members have no row. Tasks make and merge blocks with
Spark's own bitmap aggregates; what a task holds is some 4 kB a block. `OrdinalSet` is
the same for a driver that proposes one vector at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.operators.ordered import running, running_max

#: Ordinals of a block: the size of Spark's bitmaps (a fixed value).
BITS = 32_768
BYTES = BITS // 8
#: Blocks that are numbered by one task.
GROUP = 1 << 12


def _closed(blocks: DataFrame) -> DataFrame:
    n = F.bitmap_count("_b")
    return blocks.select("block", n.alias("n"), F.when(n < BITS, F.col("_b")).alias("bits"))


def build(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The set of a column's ordinals; nulls are none."""
    o = F.col(ordinal).cast("bigint") + 1  # Spark's buckets count from 1
    some = rows.where(F.col(ordinal).isNotNull()).select((F.bitmap_bucket_number(o) - 1).alias("block"), F.bitmap_bit_position(o).alias("_p"))
    return _closed(some.groupBy("block").agg(F.bitmap_construct_agg("_p").alias("_b")))


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return _closed(out.groupBy("block").agg(F.bitmap_or_agg(_bits()).alias("_b")))


def _bits() -> Column:
    return F.coalesce("bits", F.unhex(F.lit("FF" * BYTES)))


def _below(position: Column) -> Column:
    """Members of a block before a position in it."""
    whole, rest = F.floor(position / 8).cast("int"), F.pmod(position, F.lit(8))
    byte = F.conv(F.hex(F.substring(F.col("bits"), whole + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.bit_count(byte.bitwiseAND(F.pow(F.lit(2), rest).cast("int") - 1))
    counted = F.when(whole > 0, F.bitmap_count(F.substring(F.col("bits"), F.lit(1), whole))).otherwise(0) + inside
    return F.when(F.col("bits").isNull(), position).otherwise(counted)


def ranks(members: DataFrame, rows: DataFrame, ordinal: str = "ordinal", out: str = "rank") -> DataFrame:
    """rows with the number of members below each ordinal. Counts of blocks are summed by groups of blocks, not in one task."""
    grouped = members.withColumns({"_group": F.floor(F.col("block") / GROUP), "_none": F.lit(0)})
    starts = running(grouped, ["_none"], "_group", ["block"], F.col("n"), "_with").select("block", "bits", (F.col("_with") - F.col("n")).alias("_before"), "_with")
    o = F.col(ordinal).cast("bigint")
    asked = rows.withColumns({"block": F.floor(o / BITS), "_p": F.pmod(o, F.lit(BITS)).cast("int")})
    # A block without members counts as the nearest one below it, whose members are all counted.
    known = asked.join(starts, "block", "left")
    here = known.where("_before is not null").withColumn(out, F.col("_before") + _below(F.col("_p")))
    missing = known.where("_before is null")
    gaps = missing.select("block").distinct().withColumn("_with", F.lit(None).cast("bigint")).unionByName(starts.select("block", F.col("_with").cast("bigint").alias("_with")))
    carried = running_max(gaps.withColumns({"_group": F.floor(F.col("block") / GROUP), "_none": F.lit(0)}), ["_none"], "_group", ["block"], F.col("_with"), "_upto").where("_with is null")
    rest = missing.join(carried.select("block", "_upto"), "block").withColumn(out, F.coalesce("_upto", F.lit(0)))
    names = [*rows.columns, out]
    return here.select(*names).unionByName(rest.select(*names))


def contains(members: DataFrame, rows: DataFrame, ordinal: str = "ordinal", out: str = "member") -> DataFrame:
    o = F.col(ordinal).cast("bigint")
    asked = rows.withColumns({"block": F.floor(o / BITS), "_p": F.pmod(o, F.lit(BITS)).cast("int")})
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("_p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col("bits").isNull() | (byte.bitwiseAND(F.pow(F.lit(2), F.pmod(F.col("_p"), F.lit(8))).cast("int")) > 0)
    found = asked.join(members, "block", "left").withColumn(out, F.col("n").isNotNull() & F.coalesce(hit, F.lit(False)))
    return found.select(*rows.columns, out)


def lowest_unset(spark: SparkSession, members: DataFrame, size: int, k: int = 1) -> list[int]:
    """The k lowest ordinals below size that aren't members. Each block that isn't full has one, so k blocks are enough to look into."""
    blocks = spark.range(-(-size // BITS)).withColumnRenamed("id", "block")
    free = blocks.join(members.where("bits is null").select("block"), "block", "left_anti").orderBy("block").limit(k)
    bits = free.join(members.select("block", "bits"), "block", "left").select("block", F.coalesce("bits", F.unhex(F.lit("00" * BYTES))).alias("bits"))
    unset = bits.select("block", F.posexplode(F.split(F.hex("bits"), "")).alias("_i", "_h"))
    nibble = F.conv("_h", 16, 10).cast("int")
    # A byte's first hexadecimal digit holds its higher four positions.
    low = (F.floor(F.col("_i") / 2) * 8 + F.when(F.col("_i") % 2 == 0, 4).otherwise(0)).cast("bigint")
    spread = unset.where((F.col("_h") != "") & (F.col("_h") != "F")).withColumn("_low", F.col("block") * BITS + low).withColumn("_n", nibble)
    each = spread.select("_low", "_n", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("_bit"))
    out = each.where(F.col("_n").bitwiseAND(F.pow(F.lit(2), F.col("_bit")).cast("int")) == 0).select((F.col("_low") + F.col("_bit")).alias("ordinal"))
    return [r["ordinal"] for r in out.where(F.col("ordinal") < size).orderBy("ordinal").limit(k).collect()]


class OrdinalSet:
    """A set of ordinals on the driver: a bitmap for each block that has some, nothing but a mark for each full one."""

    def __init__(self, ordinals: Iterable[int] = ()):
        self.bits: dict[int, bytearray] = {}
        self.counts: dict[int, int] = {}
        self.full: set[int] = set()
        self.size, self._lowest = 0, 0
        for o in ordinals:
            self.add(o)

    @classmethod
    def of(cls, blocks: DataFrame) -> "OrdinalSet":
        out = cls()
        for r in blocks.toLocalIterator():
            if r["bits"] is None:
                out.full.add(r["block"])
            else:
                out.bits[r["block"]], out.counts[r["block"]] = bytearray(r["bits"]), r["n"]
            out.size += r["n"]
        return out

    def __len__(self) -> int:
        return self.size

    def __contains__(self, ordinal: int) -> bool:
        block, p = divmod(ordinal, BITS)
        return block in self.full or (block in self.bits and bool(self.bits[block][p >> 3] >> (p & 7) & 1))

    def add(self, ordinal: int) -> None:
        if ordinal in self:
            return
        block, p = divmod(ordinal, BITS)
        self.bits.setdefault(block, bytearray(BYTES))[p >> 3] |= 1 << (p & 7)
        self.counts[block] = self.counts.get(block, 0) + 1
        self.size += 1
        if self.counts[block] == BITS:
            self.full.add(block)
            del self.bits[block], self.counts[block]

    def lowest_unset(self) -> int:
        """The lowest ordinal that isn't a member; members are never taken out, so the search goes on where it ended."""
        while self._lowest in self:
            block, p = divmod(self._lowest, BITS)
            if block in self.full:
                self._lowest = (block + 1) * BITS
            elif self.bits[block][p >> 3] == 255:
                self._lowest = block * BITS + ((p >> 3) + 1) * 8
            else:
                self._lowest += 1
        return self._lowest

    def rank(self, ordinal: int) -> int:
        """Members below an ordinal."""
        block, p = divmod(ordinal, BITS)
        before = BITS * sum(b < block for b in self.full) + sum(n for b, n in self.counts.items() if b < block)
        if block in self.full:
            return before + p
        own = self.bits.get(block, b"")
        return before + sum(x.bit_count() for x in own[: p >> 3]) + ((own[p >> 3] & (1 << (p & 7)) - 1).bit_count() if own else 0)
