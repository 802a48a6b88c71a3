"""Address verification against a table of lookup candidates.

addresses: row, index, line_1, line_2, town, county, postcode.
candidates: postcode, position, uprn, organisation, number, name, street, town, county, address, found_postcode.
lookups: postcode, http_status (null: the service did not answer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .matching import address_score, best_pairs, best_with_margin, canonical_address, letter_counts, ratio_bounds, top_candidates

# What a match needs, candidates kept, areas that are not served, and statuses that block an action.
SCORE, MARGIN, KEPT = 0.98, 0.05, 10
NOT_SERVED = ["BT", "IM", "JE", "GY"]
#: Different addresses, and candidates, of a postcode that one task compares at a time.
ADDRESS_BLOCK, CANDIDATE_BLOCK = 1024, 2048
BLOCKING = ["missing_postcode", "invalid_postcode", "unsupported", "no_result", "review_required"]


def _text(*parts: Column) -> Column:
    return canonical_address(F.concat_ws(" ", *parts))


def readings(candidates: DataFrame) -> DataFrame:
    """postcode, position, c and _t, the different canonical readings of every candidate with their letters, each candidate once by uprn (or address)."""
    c = candidates.withColumn("_who", F.coalesce("uprn", "address")).groupBy("postcode", "_who").agg(F.min_by(F.struct(*[x for x in candidates.columns if x != "postcode"]), "position").alias("c"))
    texts = F.array_distinct(F.array(_text(F.col("c.organisation"), F.col("c.town")), _text(F.col("c.organisation"), F.col("c.number"), F.col("c.name"), F.col("c.street"), F.col("c.town")), _text(F.col("c.address"))))
    each = c.select("postcode", F.col("c.position").alias("position"), "c", F.array_compact(texts).alias("_t"))
    return each.withColumn("_t", F.transform("_t", lambda t: F.struct(t.alias("text"), letter_counts(t).alias("counts"))))


def survivors(addresses: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Pairs of an address and a candidate of its postcode that may be among the address's k best: its columns, position, c, the readings _t, _source and _town.

    Every pair has a least and a greatest score: whole words in common are known, and
    similarity is bounded by letters and ends. A pair whose greatest score is below
    the k-th best of the least ones goes, so no text is compared for it.
    """
    a = addresses.withColumn("_source", _text(F.col("line_1"), F.col("line_2"), F.col("town"))).withColumn("_town", _text(F.col("town"))).withColumn("_counts", letter_counts(F.col("_source")))
    source, town = F.col("_source"), F.col("_town")

    def bounds(t: Column) -> Column:
        fits = (town == "") | t["text"].contains(town)
        low, high = ratio_bounds(source, t["text"], F.col("_counts"), t["counts"])
        return F.struct(address_score(source, t["text"], low, fits).alias("low"), address_score(source, t["text"], high, fits).alias("high"))

    both = a.join(readings(candidates), "postcode").withColumn("_b", F.transform("_t", bounds)).withColumn("_t", F.transform("_t", lambda t: t["text"]))
    # Few bytes, but much work for each: as many tasks as the session's shuffles have, not as few as the bytes would fill.
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "row", "index")
    w = W.partitionBy("row", "index").orderBy(F.col("_low").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    got = both.withColumn("_low", F.array_max("_b.low")).withColumn("_high", F.array_max("_b.high")).drop("_counts", "_b")
    return got.withColumn("_floor", F.nth_value("_low", k).over(w)).filter("_floor is null or _high >= _floor").drop("_low", "_high", "_floor")


def _blocks(df: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """df with a block number: a postcode's rows are dealt over as many blocks as its number of rows needs."""
    many = df.groupBy("postcode").agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks"))
    return df.join(many, "postcode").withColumn(name, F.pmod(F.xxhash64(*by), F.col("_blocks")).cast("int")).drop("_blocks")


def scored(addresses: DataFrame, candidates: DataFrame, k: int = 2) -> DataFrame:
    """The k best candidates of every address, ties to the first position, with the best score of a candidate's readings.

    An address is asked once, however many rows have it. Addresses and readings of a
    postcode meet in blocks of bounded size, so a postcode of any size is many tasks; the
    best of all blocks are ranked at the end.
    """
    keys = ["postcode", "_source", "_town"]
    a = addresses.withColumn("_source", _text(F.col("line_1"), F.col("line_2"), F.col("town"))).withColumn("_town", _text(F.col("town")))
    asked = _blocks(a.select(*keys).distinct(), ["_source"], ADDRESS_BLOCK, "_a")
    read = _blocks(readings(candidates).select("postcode", "position", "c", F.transform("_t", lambda t: t["text"]).alias("_t")), ["position"], CANDIDATE_BLOCK, "_c")
    # Every block of addresses meets every block of candidates of its postcode.
    blocks = asked.select("postcode", "_a").distinct().join(read.select("postcode", "_c").distinct(), "postcode")
    left = asked.join(blocks, ["postcode", "_a"]).select(F.col("postcode").alias("postcode"), "_source", "_town", F.col("_a").alias("_i"), F.col("_c").alias("_j"))
    right = read.select("postcode", "position", "_t", "_c").join(blocks, ["postcode", "_c"])
    found = left.groupBy("postcode", "_i", "_j").cogroup(right.groupBy("postcode", "_a", "_c")).applyInPandas(lambda x, y: best_pairs(x, y, k), "postcode string, _source string, _town string, position long, score double")
    best = top_candidates(found, keys, "score", [F.col("position")], k).drop("rank")
    best = best.join(read.groupBy("postcode", "position").agg(F.min("c").alias("c")), ["postcode", "position"])
    return a.select("row", "index", *keys).distinct().join(best, keys).select("row", "index", "position", "score", "c")


def mapped(c: Column) -> Column:
    """The address that a candidate stands for; null where it has no first line, town or postcode."""
    line = F.coalesce(F.nullif(F.concat_ws(" ", c["number"], c["street"]), F.lit("")), c["name"], c["organisation"])
    first = F.coalesce(c["organisation"], c["name"], line)
    second = F.when(first != line, line)
    made = F.struct(first.alias("line_1"), second.alias("line_2"), c["town"].alias("town"), c["county"].alias("county"), c["found_postcode"].alias("postcode"))
    return F.when(first.isNotNull() & c["town"].isNotNull() & c["found_postcode"].isNotNull(), made)


def verified(addresses: DataFrame, candidates: DataFrame, lookups: DataFrame) -> DataFrame:
    """Addresses with status, score, margin and the proposed address.

    Statuses, the first that holds: missing_postcode, invalid_postcode, unsupported,
    unavailable, no_result, review_required, auto_normalised (the proposal differs), verified.
    """
    best = best_with_margin(scored(addresses, candidates), ["row", "index"], "score", [F.col("position")], SCORE, MARGIN)
    best = best.select("row", "index", "score", "margin", "accepted", mapped(F.col("c")).alias("proposed"))
    clean = T.uk_postcode(F.col("postcode"))
    got = addresses.join(lookups.select("postcode", "http_status", F.lit(True).alias("_asked")).distinct(), "postcode", "left").join(best, ["row", "index"], "left")
    area = F.lit(False)
    for p in NOT_SERVED:
        area = area | F.upper("postcode").startswith(p)
    same = F.lit(True)
    for f in ("line_1", "line_2", "town", "county", "postcode"):
        same = same & F.col(f).eqNullSafe(F.col(f"proposed.{f}"))
    status = (
        F.when(F.coalesce(F.trim("postcode"), F.lit("")) == "", "missing_postcode").when(clean["code"].isNotNull(), "invalid_postcode").when(area, "unsupported")
        .when(F.col("_asked").isNull() | F.col("http_status").isNull() | (F.col("http_status") >= 500), "unavailable").when(F.col("http_status").isin(400, 404) | F.col("score").isNull(), "no_result")
        .when(~F.col("accepted") | F.col("proposed").isNull(), "review_required").when(~same, "auto_normalised").otherwise("verified")
    )
    return got.withColumn("status", status).drop("_asked", "http_status")


def blocking(status: Column) -> Column:
    return F.coalesce(status.isin(BLOCKING), F.lit(False))


def reason(status: Column) -> Column:
    return F.when(blocking(status), F.concat(F.lit("Address verification requires review: "), status))


def summary(verifications: DataFrame) -> DataFrame:
    """Counts by status, of blocking ones, and of rows that any blocks."""
    names = [*BLOCKING, "unavailable", "auto_normalised", "verified"]
    block = blocking(F.col("status"))
    return verifications.agg(F.count("*").alias("addresses"), *[F.count_if(F.col("status") == s).alias(s) for s in names], F.count_if(block).alias("blocking"), F.count_distinct(F.when(block, F.col("row"))).alias("blocked_rows"))


def for_model(verifications: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best candidates of every address that needs a review, without their postcode; a candidate without a uprn can't be chosen."""
    open_ = verifications.filter("status = 'review_required'").select("row", "index", "line_1", "line_2", "town", "county", "postcode")
    some = scored(open_, candidates.filter("uprn is not null"), KEPT)
    return top_candidates(some, ["row", "index"], "score", [F.col("position")], KEPT).select("row", "index", "rank", "score", F.col("c.uprn").alias("uprn"), F.col("c.address").alias("address"))


def chosen(verifications: DataFrame, offered: DataFrame, choices: DataFrame) -> DataFrame:
    """verifications with the uprn that a model chose, where the address needs a review and the uprn was among those offered."""
    ok = choices.join(offered.select("row", "index", "uprn"), ["row", "index", "uprn"], "left_semi").select("row", "index", F.col("uprn").alias("chosen_uprn")).dropDuplicates(["row", "index"])
    return verifications.join(ok, ["row", "index"], "left").withColumn("chosen_uprn", F.when(F.col("status") == "review_required", F.col("chosen_uprn")))
