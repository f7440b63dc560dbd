"""Nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.numbers import let


def reverse_complement(bases: Column) -> Column:
    """Other characters than ACGT stay themselves; case is kept."""
    return F.translate(F.reverse(bases), "ACGTacgt", "TGCAtgca")


def common_prefix(a: Column, b: Column, most: int | None = None) -> Column:
    """Length of the longest common prefix, up to ``most`` if given: by halving, so a row costs log(length) comparisons.

    Most pairs differ in their first character or have none, and end there.
    """
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(31))])

    def search(x: Column) -> Column:
        def longer(k: Column, s: Column) -> Column:
            same = F.substring(x["a"], k + 1, s) == F.substring(x["b"], k + 1, s)
            return F.when((k + s <= x["room"]) & same, k + s).otherwise(k)

        # only the powers of two up to the room, of which there are as many as it has binary digits
        found = F.aggregate(F.slice(steps, -F.char_length(F.bin(x["room"])), F.lit(31)), F.lit(0), longer)
        return F.when((x["room"] > 0) & (F.substring(x["a"], 1, 1) == F.substring(x["b"], 1, 1)), found).otherwise(F.lit(0))

    room = F.least(F.char_length(a), F.char_length(b), *[] if most is None else [F.lit(most)])
    return let(F.struct(a.alias("a"), b.alias("b"), room.alias("room")), search)
