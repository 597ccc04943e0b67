"""Hierarchical weighted hash tree.

A row descends region, rack and shard.  At each node every child draws
-ln(u) / weight with u from a hash of the key and the child's name, and the least
draw wins, so a child is chosen in proportion to its weight.  A child's draw
depends on nothing but the key, its own name and its own weight.  When weights
change, rows move only towards children that gained, or away from those that
lost: movement stays in the subtrees whose weights change.  A shard added as a
region of its own therefore takes rows only into itself.

Null keys hash as the text "null"; null texts have size 1 and checksum 0; equal
keys go to one shard; repeated rows each get a slot.  Other columns are not read.
"""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.ranks import BLOCKS, numbered


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, whole: int = 8, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """A balanced tree of up to `whole` shards; each shard beyond it is a region of its own."""
    return [Leaf(f"g{i // (per_rack * racks)}", f"k{i // per_rack}", i) if i < whole else Leaf(f"x{i}", f"x{i}", i) for i in range(shards)]


def hash48(*parts: Column) -> Column:
    """48 bits of an md5 of the parts, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("long")


def _draw(key: Column, name: str, weight: float) -> Column:
    return -F.log((hash48(key, F.lit(name)) + 1) / F.lit(float(1 << 48))) / F.lit(float(weight))


def _best(key: Column, level: str, children: dict[str, float], then) -> Column:
    """The child with the least draw, handed on to `then`; ties go to the earlier child."""
    names = list(children)
    if len(names) == 1:
        return then(names[0])
    win = F.array_min(F.array(*[F.struct(_draw(key, f"{level}:{c}", children[c]).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(names)])).i
    branch = None
    for i, c in enumerate(names[:-1]):
        branch = F.when(win == i, then(c)) if branch is None else branch.when(win == i, then(c))
    return branch.otherwise(then(names[-1]))


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard that a key descends to."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    weight: dict = {}
    for x in leaves:
        weight[x.region] = weight.get(x.region, 0.0) + x.weight

    def racks(region):
        sums: dict = {}
        for x in leaves:
            if x.region == region:
                sums[x.rack] = sums.get(x.rack, 0.0) + x.weight
        return _best(key, "rack", sums, shards)

    def shards(rack):
        own = {str(x.shard): x.weight for x in leaves if x.rack == rack}
        return _best(key, "shard", own, lambda s: F.lit(int(s)))

    return _best(key, "region", weight, racks)


def assign(df: DataFrame, leaves: Sequence[Leaf], grown: Sequence[Leaf], id_column: str = "doc_id", text_column: str = "text",
           blocks: int = BLOCKS) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard); slots run from 0 without gaps in each shard."""
    key, text = F.col(id_column), F.coalesce(F.col(text_column), F.lit(""))
    placed = df.select(
        key.alias(id_column), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, leaves).alias("shard"), shard_of(key, grown).alias("grown_shard"))
    block = F.pmod(hash48(F.coalesce(key.cast("string"), F.lit("null")), F.lit("block")), F.lit(blocks))
    return numbered(placed, ["shard"], block, [id_column, "size", "text_crc32"], "slot")
