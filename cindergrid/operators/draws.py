"""Exact draws without repetition: keyed permutations of numbered candidates.

`permuted` maps 0 .. size-1 onto itself, so draw number i needs neither a look at the
other draws nor a guess of how many will repeat; `with_number` tells of a place which draw
has it, so where all places are listed no draw is made. Draws go by rounds: in each round
every template (a positive, a city cell) makes one. `drawn` opens rounds until enough
free candidates are found or all rounds are done, so a stratum ends short only when its
candidates are used up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindergrid.session import cut

PRIME = 2**31 - 1
#: Fixed multipliers of the round function and offsets of the four round keys.
FACTORS = (48271, 69621)
OFFSETS = (0, 374761393, 668265263, 1013904223)
WALKS = 24
CHUNK = 20_000  # numbers listed in one task


def _scrambled(x: Column, key: Column) -> Column:
    mixed = F.pmod(F.pmod(x + key, F.lit(PRIME)) * F.lit(FACTORS[0]), F.lit(PRIME))
    return F.pmod(mixed.bitwiseXOR(F.shiftright(mixed, 15)) * F.lit(FACTORS[1]), F.lit(PRIME))


def permuted(i, size, key) -> Column:
    """Where number i of 0 .. size-1 goes: a bijection for every key.

    Four Feistel rounds over (high, low) digits in bases a and b with a * b >= size; numbers
    that land at or beyond `size` are sent on until they land below it. At most a - 1
    numbers lie beyond, so WALKS steps leave none in practice (a chance of a**-WALKS for
    large sizes, none at all for sizes up to WALKS squared).
    """
    i, size, key = (F.col(c) if isinstance(c, str) else c for c in (i, size, key))
    a = F.ceil(F.sqrt(size.cast("double"))).cast("bigint")
    b = F.ceil(size / a).cast("bigint")
    digits = lambda high, low: F.struct(high.cast("bigint").alias("high"), low.cast("bigint").alias("low"))

    def round_(s, n):
        k = key + F.element_at(F.array(*[F.lit(o) for o in OFFSETS]), n).cast("bigint")
        odd = F.pmod(n, F.lit(2)) == 1
        return F.when(odd, digits(F.pmod(s["high"] + _scrambled(s["low"], k), a), s["low"])).otherwise(
            digits(s["high"], F.pmod(s["low"] + _scrambled(s["high"], k), b))
        )

    def once(v):
        start = digits(F.floor(v / b), F.pmod(v, b))
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, round_, lambda s: s["high"] * b + s["low"])

    walk = F.sequence(F.lit(1), F.lit(WALKS))
    return F.aggregate(walk, F.lit(-1).cast("bigint"), lambda v, _: F.when((v >= 0) & (v < size), v).when(v < 0, once(i.cast("bigint"))).otherwise(once(v)))


def with_place(df: DataFrame, i, size, key, out="_v") -> DataFrame:
    """`permuted` as a column of its own: the rounds are plain columns, only numbers beyond the size take the walk."""
    whole, n, k = (F.col(c) if isinstance(c, str) else c for c in (i, size, key))
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    named = df.withColumns({"_pn": n.cast("bigint"), "_pk": k.cast("bigint"), "_pa": a})
    named = named.withColumn("_pb", F.ceil(F.col("_pn") / F.col("_pa")).cast("bigint"))
    named = named.withColumns({"_ph": F.floor(whole / F.col("_pb")).cast("bigint"), "_pl": F.pmod(whole, F.col("_pb")).cast("bigint")})
    for j, offset in enumerate(OFFSETS):
        side, other, base = ("_ph", "_pl", "_pa") if j % 2 == 0 else ("_pl", "_ph", "_pb")
        named = named.withColumn(side, F.pmod(F.col(side) + _scrambled(F.col(other), F.col("_pk") + offset), F.col(base)))
    named = named.withColumn(out, F.col("_ph") * F.col("_pb") + F.col("_pl"))
    walked = F.when(F.col(out) < F.col("_pn"), F.col(out)).otherwise(permuted(out, "_pn", "_pk"))
    return named.withColumn(out, walked).drop("_pn", "_pk", "_pa", "_pb", "_ph", "_pl")


def with_number(df: DataFrame, place, size, key, out="_i") -> DataFrame:
    """The number that `with_place` sends to each place of 0 .. size-1: its rounds undone, last first."""
    v, n, k = (F.col(c) if isinstance(c, str) else c for c in (place, size, key))
    named = df.withColumns({"_pv": v.cast("bigint"), "_pn": n.cast("bigint"), "_pk": k.cast("bigint"), "_pa": F.ceil(F.sqrt(n.cast("double"))).cast("bigint")})
    named = named.withColumn("_pb", F.ceil(F.col("_pn") / F.col("_pa")).cast("bigint"))
    named = named.withColumns({"_ph": F.floor(F.col("_pv") / F.col("_pb")).cast("bigint"), "_pl": F.pmod("_pv", F.col("_pb")).cast("bigint")})
    for j, offset in reversed(list(enumerate(OFFSETS))):
        side, other, base = ("_ph", "_pl", "_pa") if j % 2 == 0 else ("_pl", "_ph", "_pb")
        named = named.withColumn(side, F.pmod(F.col(side) - _scrambled(F.col(other), F.col("_pk") + offset), F.col(base)))
    named = named.withColumn(out, F.col("_ph") * F.col("_pb") + F.col("_pl"))
    a, b = F.col("_pa"), F.col("_pb")

    def undo(s, n):
        x = F.col("_pk") + F.element_at(F.array(*[F.lit(o) for o in reversed(OFFSETS)]), n).cast("bigint")
        high, low = s["high"], s["low"]
        return F.when(F.pmod(n, F.lit(2)) == 1, F.struct(high.alias("high"), F.pmod(low - _scrambled(high, x), b).alias("low"))).otherwise(
            F.struct(F.pmod(high - _scrambled(low, x), a).alias("high"), low.alias("low"))
        )

    def once(v):
        start = F.struct(F.floor(v / b).cast("bigint").alias("high"), F.pmod(v, b).cast("bigint").alias("low"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, undo, lambda s: s["high"] * b + s["low"])

    # numbers beyond the size were sent on, so they are followed back
    walk = F.sequence(F.lit(1), F.lit(WALKS))
    walked = F.aggregate(walk, F.col(out), lambda v, _: F.when(v < F.col("_pn"), v).otherwise(once(v)))
    return named.withColumn(out, F.when(F.col(out) < F.col("_pn"), F.col(out)).otherwise(walked)).drop("_pv", "_pn", "_pk", "_pa", "_pb", "_ph", "_pl")


def numbers(groups: DataFrame, low, high, out="_i") -> DataFrame:
    """Every number from `low` up to but not `high` of every group, listed in chunks all over the cluster."""
    known = groups.withColumns({"_a": low, "_b": high}).filter("_a < _b")
    parts = known.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_b") - F.col("_a") - 1) / CHUNK))))
    parts = parts.repartition(F.xxhash64(*[c for c in groups.columns], "_chunk"))
    first = F.col("_a") + F.col("_chunk") * CHUNK
    last = F.least(first + CHUNK, F.col("_b")) - 1
    return parts.withColumn(out, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))).drop("_a", "_b", "_chunk")


def drawn(
    candidates: Callable[[int, int], DataFrame], want: int, rounds: int, first: int, key, blocked: DataFrame | None = None,
    narrow: Callable[[DataFrame, int], bool] | None = None,
) -> DataFrame:
    """The first `want` free candidates in the order of their rounds, then of `_h`.

    `candidates(a, b)` gives those of rounds a .. b-1: the key columns, `_round`, `_h` and
    others; one that comes several times keeps its first round and its least other values.
    Rounds are opened from `first` on, four times as many each time, up to `rounds`; rows of
    `blocked` (by key) are left out. What is found is written to the checkpoint folder; the
    driver sees the number of free candidates per round. `narrow(found, rounds left)` may
    drop templates that can find nothing more; it tells whether any are left.
    """
    found, low, high = None, 0, max(1, min(first, rounds))
    while True:
        fresh = candidates(low, high)
        if blocked is not None:
            fresh = fresh.join(blocked.select(*key), list(key), "left_anti")
        rest = [c for c in fresh.columns if c not in (*key, "_round", "_h")]
        every = fresh if found is None else found.unionByName(fresh)
        found = cut(every.groupBy(*key).agg(F.min(F.struct("_round", "_h", *rest)).alias("_s")).select(*key, "_s.*"))
        if found.count() >= want or high >= rounds:
            return leading(found, want).filter("_leads").drop("_leads")
        if narrow is not None and not narrow(found, rounds - high):
            return found
        low, high = high, min(rounds, high * 4)


def leading(found: DataFrame, want: int) -> DataFrame:
    """Candidates with `_leads`: whether they are among the first `want` by round and `_h`.

    Only the round in which the number is reached is numbered; the driver sees the number of
    candidates per round.
    """
    from cindergrid.operators.sampling import numbered

    left = want
    for number, n in sorted((r["_round"], r["count"]) for r in found.groupBy("_round").count().collect()):
        if n > left:
            part = found.filter(F.col("_round") == number).withColumn("_g", F.lit(0))
            ranked = numbered(part, ["_g"]).withColumn("_leads", F.col("_rank") <= left).select(*found.columns, "_leads")
            others = found.filter(F.col("_round") != number).withColumn("_leads", F.col("_round") < number)
            return others.unionByName(ranked)
        left -= n
    return found.withColumn("_leads", F.lit(True))


def permutation_sql(tag: str, source: str, columns: str) -> str:
    """CTEs `{tag}` for DuckDB: `source` (with `columns`, i, n, k) and v, the place of number i."""
    f = lambda x, k: f"(xor(({x} + {k}) % {PRIME} * {FACTORS[0]} % {PRIME}, (({x} + {k}) % {PRIME} * {FACTORS[0]} % {PRIME}) >> 15) * {FACTORS[1]} % {PRIME})"

    def rounds(name: str, source: str, start: str, where: str = "") -> str:
        steps = [f"{name}0 AS (SELECT *, {start} // b AS hi, {start} % b AS lo FROM {source}{where})"]
        for j, offset in enumerate(OFFSETS):
            side, other, base = ("hi", "lo", "a") if j % 2 == 0 else ("lo", "hi", "b")
            steps.append(f"{name}{j + 1} AS (SELECT * REPLACE (({side} + {f(other, f'(k + {offset})')}) % {base} AS {side}) FROM {name}{j})")
        return ",\n  ".join(steps)

    base = f"""{tag}_b AS (SELECT *, CAST(CEIL(SQRT(CAST(n AS DOUBLE))) AS BIGINT) AS a,
    CAST(CEIL(n / CEIL(SQRT(CAST(n AS DOUBLE)))) AS BIGINT) AS b FROM {source})"""
    parts, last = [base], f"{tag}_b"
    # numbers beyond the size are sent on; six times are plenty for the sizes in the tests
    for walk in range(6):
        start = "i" if walk == 0 else "v"
        where = "" if walk == 0 else " WHERE v >= n"
        parts.append(rounds(f"{tag}_{walk}_", last, start, where))
        columns_ = f"{columns}, i, n, k, a, b, hi * b + lo AS v"
        parts.append(f"{tag}_w{walk} AS (SELECT {columns_} FROM {tag}_{walk}_4)")
        last = f"{tag}_w{walk}"
    parts.append(f"{tag} AS (" + " UNION ALL ".join(f"SELECT {columns}, i, n, v FROM {tag}_w{w} WHERE v < n" for w in range(6)) + ")")
    return ",\n  ".join(parts)
