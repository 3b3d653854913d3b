"""Components of verified links among rows that share keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, kept, merged, written

#: Members up to which a key's pairs are compared at once, and leaders of the first round of a larger key.
SMALL = 64
#: Words of 64 bits of a sketch.
PARITY = 4


def shared_keys(rows: DataFrame) -> DataFrame:
    """Distinct (key, id, lead) of the keys that have several ids: least and greatest id are summed map-side, then joined back."""
    ends = rows.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("top"))
    several = written(ends.filter("lead < top").select("key", "lead"))
    return written(rows.join(several, "key").select("key", "id", "lead").distinct())


class Sketched:
    """A verify of link_by_keys, and a table by which pairs are ruled out where they are made; see sketch_of and near."""

    def __init__(self, verify: Callable[[DataFrame], DataFrame], sketch: DataFrame):
        self.verify, self.sketch = verify, sketch

    def __call__(self, pairs: DataFrame) -> DataFrame:
        return self.verify(pairs)


def sketch_of(elements: DataFrame) -> DataFrame:
    """(id, d, p0 ..) of (id, e): the number of an id's elements, and for each bit of PARITY words whether an odd number of them falls on it."""
    word, bit = F.shiftrightunsigned("e", 6).bitwiseAND(F.lit(PARITY - 1)), F.expr("shiftleft(1L, CAST(e & 63 AS INT))")
    return elements.groupBy("id").agg(F.count("*").cast("int").alias("d"), *[F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(PARITY)])


def near(a: Callable[[str], Column], b: Callable[[str], Column], percent: int) -> Column:
    """Whether two ids may have `percent` percent of their elements in common, by their sketches (a and b give a column of each).

    Each element that one of them alone has turns one bit, so at least as many are not common as bits differ; no pair that links is ruled out.
    """
    differ = sum((F.bit_count(a(f"p{k}").bitwiseXOR(b(f"p{k}"))) for k in range(PARITY)), F.lit(0))
    sizes = F.least(a("d"), b("d")) * 100 >= F.greatest(a("d"), b("d")) * percent
    return sizes & (differ * (100 + percent) <= (a("d") + b("d")) * (100 - percent))


def suffixed(rows: DataFrame, to: str, end: str) -> DataFrame:
    """rows with id named `to` and all other columns ending in `end`."""
    return rows.select(F.col("id").alias(to), *[F.col(c).alias(f"{c}{end}") for c in rows.columns if c != "id"])


def _bounded(members: DataFrame, elements: Callable[[DataFrame], DataFrame], percent: int, across: bool) -> DataFrame:
    """(key, id, n, s) of the members (key, id, comp) that can be similar to one of their key in another component.

    n: an id's elements; s: those of them that another id of the key has too, and with across any id of another component,
    so no pair has more in common; this leaves little of large groups of copies before elements are taken to keys. At
    least `percent` of an id's elements are common if it is similar to anything. Of keys with the same ids one is left.
    """
    met = found = written(elements(members.select("id", "comp").distinct()))
    sizes = found.groupBy("id").agg(F.count("*").alias("n"))
    if across:
        several = found.groupBy("e").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("e")
        met = written(found.join(several, "e").select("id", "e"))
    some = written(met.groupBy("id").agg(F.count("*").alias("s")).join(sizes, "id").filter(F.col("s") * 100 >= F.col("n") * percent))
    live = written(members.join(some, "id"))
    # keys with the same ids, by a 64-bit hash, make the same pairs
    wide = live.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"))
    wide = wide.filter("c0 < c1").groupBy("m", "x").agg(F.min("key").alias("key")).select("key")
    live = written(live.join(wide, "key").select("key", "id", "n", "s"))
    held = live.select("key", "id").join(met, "id")
    # elements of one id alone are summed where they are read; no join brings the others back
    alone = held.groupBy("key", "e").agg(F.min("id").alias("id"), F.max("id").alias("top")).filter("id = top").groupBy("key", "id").agg(F.count("*").alias("u"))
    own = live.join(alone, ["key", "id"], "left").withColumn("s", F.col("s") - F.coalesce("u", F.lit(0)))
    return own.filter(F.col("s") * 100 >= F.col("n") * percent).select("key", "id", "n", "s")


def link_by_keys(members: DataFrame, verify: Callable[[DataFrame], DataFrame], elements: Callable[[DataFrame], DataFrame], percent: int = 80) -> DataFrame:
    """(id, comp) over all verified links between ids that share a key; members: (key, id, lead), see shared_keys.

    verify(pairs) returns the pairs (a, b) that link, those with `percent` percent of their elements in common;
    elements(ids) returns the columns of ids and e, the distinct elements of the ids. Where verify is Sketched, pairs that
    their sketches rule out are not made.

    First each id is compared with its keys' least ids. From then on only keys that still hold several components count,
    and of these only pairs across components that were not compared before, so a large group of copies costs no more
    than one comparison each. Keys of at most SMALL ids are done at once. Of a larger one, elements that one id alone has
    first bound what each pair can have in common, which leaves little of a group whose members all differ in something
    of their own; then rounds compare leaders with all ids, SMALL of them first and twice as many from round to round,
    until its ids are one component or all have led. No pair is given up unless a bound rules it out.
    """
    spark, sketch = members.sparkSession, getattr(verify, "sketch", None)
    with_sketch = lambda rows: rows if sketch is None else rows.join(sketch, "id")
    maybe = lambda a, b: F.lit(True) if sketch is None else near(a, b, percent)
    tried = written(members.filter("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct())
    comps = kept(spark, lambda: connected_components(verify(tried)))
    # small keys
    wide = _wide(members.select("key", "id"), comps)
    small = with_sketch(wide.filter(F.col("m") <= SMALL).drop("m"))
    # both sides are the same plan, which is moved once
    fits = maybe(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    pairs = small.alias("x").join(small.alias("y"), F.expr("x.key = y.key and x.comp <> y.comp and x.id < y.id") & fits)
    comps = _compared(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), tried, comps, verify)[0]
    # large keys
    large = _wide(wide.filter(F.col("m") > SMALL).select("key", "id"), comps).drop("m")
    if large.isEmpty():
        return comps
    bounded = kept(spark, lambda: _bounded(large, elements, percent, sketch is None))
    salt = F.pmod(F.xxhash64("id"), F.lit(SMALL))
    ranked = written(with_sketch(bounded.select("*", F.row_number().over(Window.partitionBy("key", salt).orderBy("id")).alias("turn"))))
    last = ranked.agg(F.max("turn")).first()[0] or 0
    fits = F.expr(f"comp <> compb and least(s, sb) * {100 + percent} >= (n + nb) * {percent}") & maybe(F.col, lambda c: F.col(f"{c}b"))
    turn = 1
    while turn <= last:
        rest = _wide(ranked, comps).drop("m")
        if rest.isEmpty():
            break
        other = suffixed(rest.filter(F.col("turn").between(turn, 2 * turn - 1)), "b", "b").withColumnRenamed("keyb", "key")
        pairs = rest.join(other, "key").filter(fits).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
        comps, tried = _compared(pairs, tried, comps, verify)
        turn *= 2
    return comps


def _wide(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows (key, id, ...) of keys with several components, with comp and m, the key's number of rows."""

    def make() -> DataFrame:
        named = written(rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
        wide = named.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).filter("c0 < c1")
        return named.join(wide.select("key", "m"), "key")

    return kept(rows.sparkSession, make)


def _compared(pairs: DataFrame, tried: DataFrame, comps: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """comps with the links among the pairs that were not tried before, and all pairs tried."""
    spark = comps.sparkSession
    new = written(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
    links = kept(spark, lambda: verify(new))
    return (comps if links.isEmpty() else kept(spark, lambda: merged(comps, links))), tried.unionByName(new)
