"""Joins of evidence, candidates and identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import jaccard, normalize_name, tokens
from tidemark.operators import tiles
from tidemark.sources.scratch import saved


#: The MOST_COMMON most frequent tokens of more than HOT rows are broadcast with their counts; where rows meet, a token of more than HOT rows is dealt over parts.
HOT, MOST_COMMON = 1000, 10_000


def _prefix(rows: DataFrame, blocks: Sequence[str], need: Column) -> DataFrame:
    """`rarest` of the tokens of rows (blocks, id, others, t), t being a set."""
    return rarest(rows.withColumn("n", F.size("t")).withColumn("token", F.explode("t")).drop("t"), blocks, need)


def rarest(named: DataFrame, blocks: Sequence[str], need: Column) -> DataFrame:
    """blocks, id, others, n, token, f, place: the rarest of each row's n tokens (a row of `named` each), all but `need` - 1.

    Two rows that have `need` tokens in common or more, by the need of each, have one of these in common.
    place is the token's in the row's tokens from the rarest, f how many rows have it. The most common
    tokens, which a row of every text has, get their counts from a broadcast of MOST_COMMON at most; any
    other has HOT rows or less, or less than 1 / MOST_COMMON of all. `named` is read three times.
    """
    freq = saved(named.groupBy("token").agg(F.count(F.lit(1)).alias("f")))
    common = saved(freq.where(F.col("f") > HOT).orderBy(F.desc("f"), "token").limit(MOST_COMMON))
    counted = named.join(F.broadcast(common), "token").unionByName(named.join(F.broadcast(common.select("token")), "token", "left_anti").join(freq, "token"))
    place = F.row_number().over(Window.partitionBy(*blocks, "id").orderBy("f", "token"))
    return counted.withColumn("place", place).where(F.col("place") <= F.col("n") - need + 1)


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], fits: Column, need: Column) -> DataFrame:
    """Pairs of prefix rows (left_id, ln, lp, f / right_id, rn, rp) with equal keys, joined where `fits`; a token of many rows is dealt over parts.

    Up to a shared token no more tokens are shared than the smaller place, after it no more than the shorter rest; pairs
    that cannot have `need` in common by that are not joined.
    """
    parts = F.least(F.ceil(F.col("f") / HOT), F.lit(64)).cast("int")
    a = left.withColumn("_part", F.pmod(F.xxhash64("left_id"), parts.cast("long")).cast("int")).drop("f")
    b = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("f")
    most = F.least("lp", "rp") + F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp"))
    return a.join(b, [*keys, "_part"]).where(fits & (most >= need))


def likely(met: DataFrame, blocks: Sequence[str], need: Column) -> DataFrame:
    """blocks, left_id, right_id, ln, rn: pairs that can have `need` tokens in common, by the places of those they share.

    Of the tokens after the last shared one of both prefixes, no more can be shared than the shorter rest has.
    """
    pair = met.groupBy(*blocks, "left_id", "right_id", "ln", "rn").agg(F.count(F.lit(1)).alias("c"), F.max("lp").alias("lp"), F.max("rp").alias("rp"))
    return pair.where(F.col("c") + F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp")) >= need).select(*blocks, "left_id", "right_id", "ln", "rn")


def sides(prefix: DataFrame, left_where, right_where, blocks: Sequence[str], more: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    one = lambda side, at: prefix.where(at).select(*blocks, "token", "f", F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side[0]}n"), F.col("place").alias(f"{side[0]}p"), *(F.col(c).alias(f"{side}_{c}") for c in more))
    return one("left", left_where), one("right", right_where)


def _jaccard_filters(least: float) -> tuple[Column, Column]:
    """Whether two sizes can have the similarity, and how many tokens they must share for it; a little less, for rounding."""
    small, large = F.least("ln", "rn"), F.greatest("ln", "rn")
    return small >= F.ceil(least * large - 1e-9), F.ceil((F.col("ln") + F.col("rn")) * least / (1 + least) - 1e-9)


def _hashes(text: str) -> Column:
    """The token set of a text as 64-bit hashes; numbers are made distinct in less time than texts."""
    return F.array_distinct(F.transform(tokens(text), lambda w: F.xxhash64(w)))


def _pair_schema(rows: DataFrame, blocks: Sequence[str]) -> str:
    kind = dict(rows.dtypes)
    return ", ".join([*(f"`{b}` {kind[b]}" for b in blocks), f"left_id {kind['id']}, right_id {kind['id']}, similarity double"])


def best_similarity(left: DataFrame, right: DataFrame, blocks: Sequence[str], least: float = 0.15) -> DataFrame:
    """Each left row (id, text) with its best right row of the same blocks by token Jaccard, `least` or more.

    Left and right rows of a block meet in tiles, which return the best of each left row; see `tiles`.
    Ties go to the larger right id. match: agreed or unmatched; right rows matched by none stay as right_only.
    """
    a, b = (saved(side.select(*blocks, "id", _hashes("text").alias("t"))) for side in (left, right))
    both = a.withColumn("cell", F.lit(0)).unionByName(b.withColumn("cell", F.lit(1)))
    found = saved(tiles.tiled(both, blocks, [1], lambda tile: tiles.best_of(tile, blocks, least), _pair_schema(both, blocks)))
    best = found.groupBy(*blocks, "left_id").agg(F.max(F.struct("similarity", "right_id")).alias("m")).select(*blocks, "left_id", "m.right_id", "m.similarity")
    matched = a.select(*blocks, F.col("id").alias("left_id")).join(best, [*blocks, "left_id"], "left").withColumn("match", F.when(F.col("similarity").isNotNull(), "agreed").otherwise("unmatched"))
    alone = b.select(*blocks, F.col("id").alias("right_id")).join(best.select(*blocks, "right_id").distinct(), [*blocks, "right_id"], "left_anti").select(*blocks, F.lit(None).cast(left.schema["id"].dataType).alias("left_id"), "right_id", F.lit(None).cast("double").alias("similarity"), F.lit("right_only").alias("match"))
    return matched.unionByName(alone)


def event_candidates(df: DataFrame, blocks: Sequence[str], days: int = 14, least: float = 0.65) -> DataFrame:
    """blocks, left_id, right_id, ln, rn: pairs that can be within `days` and have the similarity, of rows (id, day, t) with token sets."""
    prefix = _prefix(df.where(F.size("t") > 0), blocks, F.ceil(F.lit(least) * F.col("n")))
    left, right = sides(prefix, "true", "true", blocks, ["day"])
    bucket = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days)
    left = left.withColumn("bucket", F.explode(F.array(*(bucket("left_day") + k for k in (-1, 0, 1)))))
    right = right.withColumn("bucket", bucket("right_day"))
    fits, need = _jaccard_filters(least)
    near = (F.col("left_id") < F.col("right_id")) & (F.abs(F.datediff("left_day", "right_day")) <= days)
    return likely(meet(left, right, [*blocks, "token", "bucket"], near & fits, need), blocks, need)


def token_sets(df: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """blocks, id, day, t: the rows of `df` with the token set of their text, saved, as it is read several times."""
    return saved(df.select(*blocks, "id", "day", F.array_distinct(tokens("text")).alias("t")))


def same_events(df: DataFrame, blocks: Sequence[str], days: int = 14, least: float = 0.65) -> DataFrame:
    """left_id, right_id, similarity of pairs within `days` and of token Jaccard `least` or more.

    Rows of a block meet in tiles of the same or the next date buckets and of sizes that can have the similarity; no pair leaves a
    task but those that have it. `df` is read twice: the most frequent tokens are coded, so that the copies of a row are small. See `tiles`.
    """
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    sets = df.select(*blocks, "id", number.alias("number"), F.floor(number / days).cast("int").alias("cell"), _hashes("text").alias("t")).dropna(subset=[*blocks, "id", "cell"])
    rows = saved(tiles.coded(sets, [*blocks, "id", "number", "cell"]))
    return tiles.same_sets(rows, blocks, least, days, _pair_schema(sets, blocks))


def resolve_aliases(df: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """`df` with company_id and confidence: 1 where the normalised name is an alias, else null and 0."""
    known = aliases.select(normalize_name(F.col("alias")).alias("_key"), F.col("company_id")).groupBy("_key").agg(F.min("company_id").alias("company_id"))
    joined = df.withColumn("_key", normalize_name(F.col(name))).join(known, "_key", "left").drop("_key")
    return joined.withColumn("confidence", F.when(F.col("company_id").isNotNull(), 1.0).otherwise(0.0))


def resolve_suppliers(df: DataFrame, aliases: DataFrame, name: str = "supplier") -> DataFrame:
    """Accepts a supplier only if its aliases name exactly one company; otherwise it goes to manual review (C11)."""
    known = aliases.select(normalize_name(F.col("alias")).alias("_key"), "company_id").groupBy("_key").agg(F.countDistinct("company_id").alias("_n"), F.min("company_id").alias("_id"))
    joined = df.withColumn("_key", normalize_name(F.col(name))).join(known, "_key", "left")
    one = F.coalesce(F.col("_n") == 1, F.lit(False))
    return joined.withColumn("company_id", F.when(one, F.col("_id"))).withColumn("resolution", F.when(one, "accepted").otherwise("manual_review")).drop("_key", "_n", "_id")


def resolve_identity(df: DataFrame, companies: DataFrame) -> DataFrame:
    """company_id by explicit id, else exact identifier, else normalised name; several names are an error state."""
    by_id = companies.select(F.col("company_id").alias("_a"), F.col("company_id").alias("explicit_id"))
    by_code = companies.groupBy(F.col("identifier")).agg(F.min("company_id").alias("_b")).where(F.col("identifier").isNotNull())
    by_name = companies.groupBy(normalize_name(F.col("name")).alias("_key")).agg(F.min("company_id").alias("_c"), F.countDistinct("company_id").alias("_n"))
    out = df.withColumn("_key", normalize_name(F.col("name"))).join(by_id, "explicit_id", "left").join(by_code, "identifier", "left").join(by_name, "_key", "left")
    sure = F.coalesce("_a", "_b")
    return out.withColumn("company_id", F.coalesce(sure, F.when(F.col("_n") == 1, F.col("_c")))).withColumn("identity", F.when(F.col("_a").isNotNull(), "explicit").when(F.col("_b").isNotNull(), "identifier").when(F.col("_n") == 1, "name").when(F.col("_n") > 1, "ambiguous").otherwise("unknown")).drop("_key", "_a", "_b", "_c", "_n")


def contamination(df: DataFrame, priors: Sequence[DataFrame], fields: Sequence[str]) -> DataFrame:
    """field, value of `df` that any prior table has in the same field, but for case and outer space."""
    def long(d: DataFrame) -> DataFrame:
        have = [c for c in fields if c in d.columns]
        pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.lower(F.trim(F.col(c).cast("string"))).alias("value")) for c in have))
        return d.select(F.explode(pairs).alias("p")).select("p.*").where(F.coalesce(F.col("value") != "", F.lit(False)))

    seen = None
    for p in priors:
        seen = long(p) if seen is None else seen.unionByName(long(p))
    return long(df).distinct().join(seen.distinct(), ["field", "value"], "left_semi")


def leakage(corpus: DataFrame, frozen: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys in the corpus and in any frozen partition; none is right (C14)."""
    out = None
    for f in frozen:
        out = f.select(key) if out is None else out.unionByName(f.select(key))
    return corpus.select(key).intersect(out)


def replay_decisions(candidates: DataFrame, decisions: DataFrame, key: str, valid: Sequence[str] = ("accept", "reject", "ambiguous")) -> DataFrame:
    """Candidates with their stored decision; a missing or invalid one is ambiguous."""
    stored = decisions.groupBy(key).agg(F.min("decision").alias("_d"), F.countDistinct("decision").alias("_n"))
    good = (F.col("_n") == 1) & F.col("_d").isin(*valid)
    return candidates.join(stored, key, "left").withColumn("decision", F.when(good, F.col("_d")).otherwise("ambiguous")).withColumn("replayed", F.coalesce(good, F.lit(False))).drop("_d", "_n")


def retained_labels(extracted: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """label, labelled, retained and the share kept of each class."""
    have = extracted.select(key).distinct().withColumn("_k", F.lit(1))
    sums = labelled.join(have, key, "left").groupBy("label").agg(F.count(F.lit(1)).alias("labelled"), F.count("_k").alias("retained"))
    return sums.withColumn("retention", F.col("retained") / F.col("labelled"))


def parent_violations(affected: DataFrame, parents: DataFrame) -> DataFrame:
    """Affected entities missing in the frozen map, or with another parent than declared (C17)."""
    known = parents.select(F.col("entity"), F.col("parent").alias("_p"))
    joined = affected.join(known, "entity", "left")
    return joined.withColumn("violation", F.when(F.col("_p").isNull(), "unknown_entity").when(~F.col("parent").eqNullSafe(F.col("_p")), "other_parent")).where("violation is not null").drop("_p")


def compare(df: DataFrame, key: str, values: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """A row per attribute and a column per value of `key` (two to four)."""
    if not 2 <= len(values) <= 4:
        raise ValueError("two to four values are compared")
    long = df.where(F.col(key).isin(*values)).select(key, F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("value")) for a in attributes))).alias("p"))
    return long.select(key, "p.*").groupBy("attribute").pivot(key, list(values)).agg(F.first("value"))


def similarity(left: Column, right: Column) -> Column:
    return jaccard(left, right)
