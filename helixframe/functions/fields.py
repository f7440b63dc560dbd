"""INFO and FORMAT texts rewritten value by value."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.numbers import let, plain_text, to_double
from helixframe.sources.header import Header, HeaderLine


#: Declared Float fields up to which a record is first looked at as a whole.
FEW = 16


def once(value: Column) -> Column:
    """``value``, computed where it stands: the optimizer does not copy it into the expressions and filters above.

    The condition always holds and costs nothing, but it is not deterministic to the optimizer.  Long expressions that many
    others read would otherwise be computed again for each of them, and planning would take minutes.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns added or replaced, each computed once."""
    return rows.select(*[c for c in rows.columns if c not in columns], *[once(c).alias(n) for n, c in columns.items()])


def with_keys(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that a join goes by, as a generator's output.

    The search for partitions to prune follows a join's keys down through projections and writes each expression out on its
    way, which for computed places took half a minute a plan; it ends at a generator.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def info_value(key: str, info: Column | None = None) -> Column:
    """The value of the first entry of the key in INFO that has one, else null."""
    entries, valued = F.concat(F.lit(";"), F.col("info") if info is None else info), f";{key}="
    at = F.instr(entries, valued)
    return F.when(at > 0, F.substring_index(F.substring(entries, at + len(valued), F.lit(1 << 30)), ";", 1))


#: Numbers of at most six significant digits and without needless zeros: single precision gives them back as they are.
SHORT = r"(?:0|[1-9][0-9]{0,5}|0\.[0-9]{0,5}[1-9]|[1-9][0-9]{0,2}\.[0-9]{0,2}[1-9])"
SHORT_LIST = rf"\A{SHORT}(?:,{SHORT})*\z"


def canonical_number(text: Column) -> Column:
    """A single-precision number in its shortest form; other texts stay."""
    return F.when(text.rlike(rf"\A{SHORT}\z"), text).otherwise(let(text, lambda t: F.coalesce(plain_text(to_double(t).cast("float")), t)))


def canonical_list(text: Column) -> Column:
    return F.when(text.rlike(SHORT_LIST), text).otherwise(F.array_join(F.transform(F.split(text, ","), canonical_number), ","))


def allele_values(text: Column, number: str, k: Column) -> Column:
    """Of a value with one part for each allele or genotype those that the k-th alternative keeps; ``.`` for missing parts."""
    parts = F.split(text, ",")
    if number == "A":
        kept = F.array(F.get(parts, k - 1))
    elif number == "R":
        kept = F.array(F.get(parts, F.lit(0)), F.get(parts, k))
    else:
        mixed = (k * (k + 1) / 2).cast("int")
        kept = F.array(F.get(parts, F.lit(0)), F.get(parts, mixed), F.get(parts, mixed + k))
    return F.when(text == ".", text).otherwise(F.array_join(kept, ",", "."))


def keys_of(declared: dict[str, HeaderLine], holds: Callable[[HeaderLine], bool]) -> list[str]:
    return [k for k, v in declared.items() if holds(v)]


def _is_one_of(key: Column, keys: list[str]) -> Column:
    return key.isin(*keys) if keys else F.lit(False)


def rewritten_info(info: Column, header: Header, k: Column | None, canonical: bool) -> Column:
    """INFO with values cut to alternative ``k`` (None or null: as they are) and numbers in canonical form."""

    floats = keys_of(header.infos, lambda x: x.type == "Float") if canonical else []
    by_number = {n: keys_of(header.infos, lambda x, n=n: x.number == n and x.type != "Flag") for n in "ARG"} if k is not None else {}
    if not (wanted := sorted({*floats, *sum(by_number.values(), [])})):
        return info

    def rewritten(e: Column, key: Column) -> Column:
        value = F.substring(e, F.char_length(key) + 2, F.lit(1 << 30))
        new = value
        for number, keys in by_number.items():
            new = F.when(k.isNotNull() & _is_one_of(key, keys), allele_values(value, number, k)).otherwise(new)
        if floats:
            new = let(new, lambda n: F.when(_is_one_of(key, floats), canonical_list(n)).otherwise(n))
        return F.concat(key, F.lit("="), new)

    def entry(e: Column) -> Column:
        return let(F.substring_index(e, "=", 1), lambda key: F.when(key.isin(*wanted) & e.contains("="), rewritten(e, key)).otherwise(e))

    made = let(info, lambda i: F.when(i.isin(".", ""), i).otherwise(F.array_join(F.transform(F.split(i, ";"), entry), ";")))
    if len(floats) > FEW:
        return made
    # a record that keeps all its alleles, and whose numbers are short already, stays as it is
    short = [F.coalesce(info_value(key, info).rlike(SHORT_LIST) & (F.substring_index(F.concat(F.lit(";"), info), f";{key}=", 2) == F.concat(F.lit(";"), info)), ~F.contains(F.concat(F.lit(";"), info), F.lit(f";{key}="))) for key in floats]
    stays = reduce(lambda a, b: a & b, short, F.lit(True)) & (F.lit(True) if k is None else k.isNull())
    return F.when(stays, info).otherwise(made)


def rewritten_samples(samples: Column, format_: Column, header: Header, k: Column | None, canonical: bool) -> Column:
    """The same for all samples; genotypes stay as they are."""
    floats = keys_of(header.formats, lambda x: x.type == "Float") if canonical else []
    by_number = {n: keys_of(header.formats, lambda x, n=n: x.number == n) for n in "ARG"} if k is not None else {}
    if not (wanted := sorted({*floats, *sum(by_number.values(), [])})):
        return samples

    def rewritten(v: Column, key: Column) -> Column:
        new = v
        for number, keys in by_number.items():
            new = F.when(k.isNotNull() & _is_one_of(key, keys), allele_values(v, number, k)).otherwise(new)
        return let(new, lambda n: F.when(_is_one_of(key, floats), canonical_list(n)).otherwise(n)) if floats else new

    def sample(s: Column, keys: Column) -> Column:
        value = lambda v, i: let(F.coalesce(F.get(keys, i), F.lit("")), lambda key: F.when(key.isin(*wanted), rewritten(v, key)).otherwise(v))
        return F.array_join(F.transform(F.split(s, ":"), value), ":")

    made = let(F.split(format_, ":"), lambda keys: F.transform(samples, lambda s: sample(s, keys)))
    return made if floats or k is None else F.when(k.isNull(), samples).otherwise(made)
