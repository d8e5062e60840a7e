"""Mixing to target weights with soft domain membership, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import common

BUCKETS = 1 << 14  # of hashed words
LABELLED_KEYS = 20_000  # most labelled keys that the classifier is counted on
EVIDENCE = 64.0  # words of a text that count as independent
TOLERANCE = 1e-3  # relative distance from every target
ROUNDS = 200  # gradient steps at most
WATCH = 10  # they end sooner when so many of them no longer save a hundredth
BLOCK = 3  # steps between two writes of the rates

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.85, "low": 0.05, "toxic": 0.10}


def label_domain() -> Column:
    """Domain of a row of `labels`; null if both labels are."""
    return (
        F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low")
        .when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), "clean")
    )


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, text and two hashes of the text: equal texts have equal posteriors."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("bigint").alias("k"), t.alias("t"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), t).alias("h2"))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def posteriors(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, key: str = "doc_id", text: str = "text", most: int = LABELLED_KEYS) -> DataFrame:
    """k, h1, h2, tokens and an array p of domain probabilities for every row.

    A multinomial classifier over hashed words, counted over the texts of at most `most`
    labelled keys, those with the least hashes.
    `labelled` has the columns k and domain; a key with several domains counts for each.
    Long texts count as EVIDENCE words, which keeps memberships soft. Texts without words
    have the shares of the labelled words. Domains without labels get smoothed counts.
    """
    rows = _keyed(docs, key, text)
    own = labelled.where(F.col("domain").isin(*domains)).select(F.col("k").cast("bigint").alias("k"), "domain").distinct()
    # at most `most` pairs of a number and a word are sent to every executor
    own = own.orderBy(F.xxhash64("k"), "k", "domain").limit(most)
    words = rows.join(F.broadcast(own), "k").select("domain", F.explode(_words("t")).alias("w")).select("domain", _bucket(F.col("w")).alias("bucket"))
    counts = common.stage(words.groupBy("bucket", "domain").agg(F.count("*").alias("n")), "counts")
    # one number for each domain
    totals = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    whole = sum(totals.values())
    prior = [(totals.get(d, 0) + 1) / (whole + len(domains)) for d in domains]
    wide = counts.groupBy("bucket").agg(*[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)])
    likely = wide.select("bucket", *[F.log((F.col(f"n{i}") + 0.5) / (totals.get(d, 0) + 0.5 * BUCKETS)).alias(f"l{i}") for i, d in enumerate(domains)])
    unseen = [float(-_log(2 * totals.get(d, 0) + BUCKETS)) for d in domains]
    # at most BUCKETS rows are sent to every executor
    each = rows.select("h1", "h2", F.explode(_words("t")).alias("w")).select("h1", "h2", _bucket(F.col("w")).alias("bucket"))
    scored = each.join(F.broadcast(likely), "bucket", "left").groupBy("h1", "h2").agg(
        F.count("*").alias("n"), *[F.sum(F.coalesce(f"l{i}", F.lit(unseen[i]))).alias(f"s{i}") for i in range(len(domains))]
    )
    # sums over copies of a text are divided by all their words
    texts = common.stage(scored.select("h1", "h2", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(len(domains))]), "likelihoods")
    sized = rows.select("k", "h1", "h2", F.size(_words("t")).cast("bigint").alias("tokens"))
    joined = sized.join(texts, ["h1", "h2"], "left")
    logits = [F.lit(_log(p)) + F.coalesce(F.col(f"m{i}") * F.least(F.lit(EVIDENCE), F.col("tokens").cast("double")), F.lit(0.0)) for i, p in enumerate(prior)]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    shares = joined.select("k", "h1", "h2", "tokens", F.array(*[F.exp(x - top) for x in logits]).alias("e"))
    return shares.select("k", "h1", "h2", "tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def _log(x: float) -> float:
    import math

    return math.log(x)


def rates(members: DataFrame, targets: dict[str, float], domains: tuple[str, ...] = DOMAINS, floor: float = 0.0) -> DataFrame:
    """members with a column rate, zero or more: expected domain token totals then match the targets.

    Accelerated projected-gradient least squares, sum over domains of (total - target)^2 /
    target, from rate 1 for every document: each step is one aggregation over all documents and moves
    rates along the posteriors, then back to `floor` where they fall below it. Targets are
    shares of the present total; with a floor, of the least total at which no domain has to
    shrink below it. Targets out of reach are met as closely as the floor and the soft
    memberships allow. Shares need not add up to one. Domains without any expected tokens,
    or with a target of zero or less, are left out of the fit.
    """
    table = common.stage(members.withColumn("rate", F.lit(1.0)), "rates")
    n = len(domains)
    p = [F.col("p")[i] for i in range(n)]
    first = table.agg(
        F.sum("tokens").alias("all"), *[F.sum(F.col("tokens") * p[i]).alias(f"t{i}") for i in range(n)],
        *[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(n)],
    ).first()
    used = [i for i in range(n) if targets.get(domains[i], 0) > 0 and (first[f"t{i}"] or 0) > 0]
    if not first["all"] or not used:
        return table
    total = float(first["all"])
    share = sum(targets[domains[i]] for i in used)
    goal = {i: targets[domains[i]] / share for i in used}
    now = {i: first[f"t{i}"] / total for i in used}
    if floor > 0:
        grow = floor * max(now[i] / goal[i] for i in used)
        goal = {i: g * grow for i, g in goal.items()}
    # step length: the largest eigenvalue of the scaled Gram matrix, by power iteration
    gram = {(i, j): first[f"g{i}_{j}"] / total / (goal[i] * goal[j]) ** 0.5 for i in used for j in used}
    vector = {i: 1.0 for i in used}
    for _ in range(50):
        vector = {i: sum(gram[i, j] * vector[j] for j in used) for i in used}
        norm = sum(v * v for v in vector.values()) ** 0.5 or 1.0
        vector = {i: v / norm for i, v in vector.items()}
    step = 1.0 / max(norm, 1e-9)
    rate, last, before = F.col("rate"), F.col("rate"), now

    def dot(values: list[Column], factors: list[float]) -> Column:
        # factors in one array are data to the generated code, which then is compiled once for all steps
        products = F.zip_with(F.array(*values), F.array(*map(F.lit, factors)), lambda x, y: x * y)
        return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)

    least, best, pace = float("inf"), float("inf"), 1.0
    for number in range(1, ROUNDS + 1):
        least = min(least, sum((now[i] - goal[i]) ** 2 / goal[i] for i in used))
        if max(abs(now[i] - goal[i]) / goal[i] for i in used) <= TOLERANCE:
            break
        if number % WATCH == 1:
            if least > 0.99 * best:
                break
            best = least
        # each step starts a little ahead, along the last one; totals are linear in the rates
        quicker = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead, pace = (pace - 1) / quicker, quicker
        slope = {i: (now[i] + ahead * (now[i] - before[i]) - goal[i]) / goal[i] for i in used}
        moved = rate + dot([rate - last, *[p[i] for i in used]], [float(ahead), *[-step * slope[i] for i in used]])
        last, rate = rate, F.greatest(F.lit(float(floor)), moved)
        if number % BLOCK == 0:
            table = common.stage(table.withColumns({"rate": rate, "last": last}), "rates")
            rate, last = F.col("rate"), F.col("last")
        sums = table.agg(*[F.sum(F.col("tokens") * p[i] * rate).alias(f"t{i}") for i in used]).first()
        before, now = now, {i: sums[f"t{i}"] / total for i in used}
    return table.withColumn("rate", rate).drop("last")


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, key: str = "doc_id", text: str = "text", floor: float = 0.0) -> DataFrame:
    """k, h1, h2, tokens, p, rate of every row; see posteriors and rates.

    `labels` has the columns quality and toxic. Null keys have no label but are mixed like
    other rows; a null text is an empty one, with no tokens. Repeated rows have equal
    rates. No rows in, no rows out; without labels every rate is 1. Other columns are ignored.
    """
    labelled = labels.select(F.col("doc_id").alias("k"), label_domain().alias("domain")).where("domain is not null and k is not null")
    members = posteriors(docs, labelled, DOMAINS, key, text)
    return rates(members, targets or TARGETS, DOMAINS, floor)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each row repeated as its rate says, all columns in place.

    Targets are reached by repeating, not by dropping. A rate's fraction decides by a hash
    of key and text whether the row comes once more, so a run can be repeated exactly.
    """
    found = fit(docs, labels, targets, key, text, floor=1.0)
    # the rate depends on the text alone
    chosen = common.stage(found.groupBy("h1", "h2").agg(F.max("rate").alias("__rate")), "chosen")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.withColumns({"__h1": F.xxhash64(t), "__h2": F.xxhash64(F.lit(7), t)})
    joined = keyed.join(chosen.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "__rate"), ["__h1", "__h2"], "left")
    rate = F.coalesce("__rate", F.lit(1.0))
    part = F.pmod(F.xxhash64(F.col(key).cast("bigint"), "__h1"), F.lit(1_000_003)) / 1_000_003
    times = (F.floor(rate) + (part < rate - F.floor(rate)).cast("int")).cast("int")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
