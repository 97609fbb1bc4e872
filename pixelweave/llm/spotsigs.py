"""SpotSigs fingerprints: chains of content words that follow common words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, small_side

# Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "the of and to in a is that for on are as with was be by at this from or an it not but",
    "der die das und ist nicht ein eine zu von mit den dem auf für im sich des auch es an werden aus",
    "le la les de des du un une et est que qui pour dans sur pas au par avec ce il",
    "el los las y en por con para una se no lo del al más como su es",
)
#: Content words in a chain.
CHAIN = 2


def _anchor_runs(anchors: tuple[str, ...]) -> str:
    """Pattern of one or more anchors after a space, each with the space that follows.

    The repeat is possessive, as Java takes others by recursion, without bound in a
    text that repeats a common word.
    """
    by_first: dict[str, list[str]] = {}
    for w in sorted({w for line in anchors for w in line.split()}):
        by_first.setdefault(w[0], []).append(w[1:])
    either = "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in by_first.items())
    return f"(?<= )(?:(?:{either}) )++"


def add_signatures(df: DataFrame, text: str, out: str, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Adds the sorted distinct 32-bit signatures of a text column.

    A signature is the next `chain` content words after an anchor, or fewer at the
    end; anchors within a chain are passed over, and the start of the text counts
    as an anchor, so that only a text without words has none. The runs of content
    words between anchors are a column of their own, so that the text is searched once.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    runs = F.array_remove(F.split(F.ltrim(F.regexp_replace(F.regexp_replace(plain, "^ +", " "), _anchor_runs(anchors), "# ")), "# "), "")
    df = df.withColumn("_runs", runs)
    following = lambda i: [F.coalesce(F.get("_runs", i + k), F.lit("")) for k in range(1, chain)]
    chains = F.transform("_runs", lambda run, i: F.substring_index(F.trim(F.concat(run, *following(i))), " ", chain))
    hashed = F.transform(F.array_distinct(F.array_remove(chains, "")), lambda c: F.crc32(c.cast("binary")))
    return df.withColumn(out, F.array_sort(F.array_distinct(hashed))).drop("_runs")


def fingerprint(signatures_: Column) -> Column:
    """Signatures in hexadecimal, joined by commas."""
    return F.array_join(F.transform(signatures_, lambda s: F.lower(F.hex(s))), ",")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two signature sets from 0 to 1; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both))


#: Bits of a key that its group leaves out, and of a value's next level.
GROUP_BITS, LEVEL_BITS = 6, 8
#: Values that are ordered in one step, whatever their distances.
ORDERED_AT_ONCE = 65_536


def next_values(values: DataFrame) -> DataFrame:
    """(k, v, nxt): each distinct pair of longs and the next larger v of the same k, null for the largest.

    Groups of values that differ in the last eight bits are at most 256 rows; the
    least values of the groups are ordered the same way, level by level, until they
    are ORDERED_AT_ONCE at most, as counted, or in two groups.
    """
    values = checkpointed(values.select("k", "v").distinct())
    spread = (F.shiftright(F.max("v"), LEVEL_BITS) - F.shiftright(F.min("v"), LEVEL_BITS)).alias("s")
    spread, n = values.groupBy("k").agg(spread, F.count("*").alias("n")).agg(F.max("s"), F.sum("n")).first()
    last = spread is None or spread < 2 or n <= ORDERED_AT_ONCE  # two groups: also where values lie on both sides of zero
    group = F.lit(0).cast("long") if last else F.shiftright("v", LEVEL_BITS)
    led = values.withColumn("p", group).withColumn("nxt", F.lead("v").over(Window.partitionBy("k", "p").orderBy("v")))
    if last:
        return led.select("k", "v", "nxt")
    firsts = values.groupBy("k", F.shiftright("v", LEVEL_BITS).alias("p")).agg(F.min("v").alias("first"))
    up = next_values(firsts.select("k", F.col("p").alias("v")))
    up = up.join(firsts.select("k", F.col("p").alias("nxt"), "first"), ["k", "nxt"]).select("k", F.col("v").alias("p"), "first")
    return led.join(up, ["k", "p"], "left").select("k", "v", F.coalesce("nxt", "first").alias("nxt"))


def next_in_ring(values: DataFrame) -> DataFrame:
    """(o, next_o): each distinct long and the next larger one, the least after the largest."""
    led = next_values(values.select(F.lit(0).cast("long").alias("k"), F.col("o").alias("v")))
    start = values.agg(F.min("o")).first()[0]
    return led.select(F.col("v").alias("o"), F.coalesce("nxt", F.lit(start)).alias("next_o"))


def next_groups(groups: DataFrame) -> DataFrame:
    """(o, s, next_o, next_s): each distinct pair of longs and the next one in their order, the first after the last."""
    groups = checkpointed(groups.select("o", "s").distinct())
    inner = next_values(groups.select(F.col("o").alias("k"), F.col("s").alias("v")))
    least = groups.groupBy("o").agg(F.min("s").alias("first"))
    outer = next_in_ring(groups).withColumnRenamed("next_o", "other").join(least.select(F.col("o").alias("other"), "first"), "other")
    both = inner.select(F.col("k").alias("o"), F.col("v").alias("s"), "nxt").join(outer, "o")
    return both.select("o", "s", F.when(F.col("nxt").isNull(), F.col("other")).otherwise(F.col("o")).alias("next_o"), F.coalesce("nxt", "first").alias("next_s"))


#: Rows that a group of keys may hold before it is cut into keys and ranges of the texts' hash.
CROWDED = 4 << GROUP_BITS


def _grouped(docs: DataFrame, key: str, text: str, order: Column) -> tuple[DataFrame, list[str]]:
    """key, text and their group, and the names of its columns: go, or go, gs, gz and how many rows (times) a row stands for.

    Groups are 64 keys wide. If some have more than CROWDED rows, as many null or
    repeated keys make them, those are cut into a group for each key and range of the text's hash, in number as many
    as bring the group's rows down to about a group's width. Equal rows that are more
    than CROWDED are counted into one: its group (gz 0) has one of them, the last, and
    groups of gz over 0 stand for up to CROWDED of the others each.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    wide, none = F.shiftright(order, GROUP_BITS), F.lit(0).cast("long")
    crowded = rows.groupBy(wide.alias("g")).agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED)
    crowded = checkpointed(crowded.select("g", F.ceil(F.log2(F.col("n") / (1 << GROUP_BITS))).cast("int").alias("bits")))
    if crowded.isEmpty():
        return rows.select("key", "text", F.shiftleft(wide, GROUP_BITS).alias("go")), ["go"]
    crowded = small_side(crowded)
    rows = rows.withColumns({"o": order, "h": F.xxhash64("text"), "g": wide})
    equal = rows.join(crowded, "g", "left_semi").groupBy(F.col("o").alias("eo"), F.col("h").alias("eh")).agg(F.count("*").alias("m"))
    equal = checkpointed(equal.filter(F.col("m") > CROWDED).select("eo", "eh"))
    alone = F.col("bits").isNull()
    go, gs = F.when(alone, F.shiftleft("g", GROUP_BITS)).otherwise(F.col("o")), F.when(alone, none).otherwise(F.expr("shiftright(h, 64 - bits)"))
    cut = rows.join(crowded, "g", "left").withColumns({"go": go, "gs": gs})
    by = ["go", "gs", "gz"]
    one = [none.alias("gz"), F.lit(1).alias("times")]
    if equal.isEmpty():
        return cut.select("key", "text", "go", "gs", *one), by
    equal, same = small_side(equal), (F.col("o") == F.col("eo")) & (F.col("h") == F.col("eh"))
    few = cut.join(equal, same, "left_anti").select("key", "text", "go", "gs", *one)
    many = cut.join(equal, same, "left_semi").groupBy("key", "text", "go", "gs").agg((F.count("*") - 1).alias("more"))
    parts = F.sequence(none, F.ceil(F.col("more") / CROWDED))
    many = many.select("key", "text", "go", "gs", "more", F.explode(parts).alias("gz"))
    times = F.when(F.col("gz") == 0, 1).otherwise(F.least(F.lit(CROWDED), F.col("more") - (F.col("gz") - 1) * CROWDED))
    return few.unionByName(many.select("key", "text", "go", "gs", "gz", times.cast("int").alias("times"))), by


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next document by ascending key; the last is followed by
    the first. Returns key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (Jaccard likeness of the
    signature sets).

    Documents are dealt out once, by groups of 64 keys; the document after a
    group's last is the first of the next group. No step holds more than a group,
    keys that are on many rows are cut into groups by their texts' hash, and very many
    equal rows are worked as one and counted. Groups depend on the rows alone, so a task
    that is run again deals them out alike.

    A null text counts as empty; a null key comes after all others; rows of the same
    key follow each other by a hash of their text, equal ones in any order; one document is its own next; an
    empty table gives an empty result.
    """
    top = docs.agg(F.max(F.col(key).cast("long"))).first()[0]
    order = F.coalesce(F.col("key").cast("long"), F.lit(min((top if top is not None else 0) + 1, (1 << 63) - 1)))
    grouped, by = _grouped(docs, key, text, order)
    dealt = grouped.repartition(*by)
    place = F.struct(order.alias("o"), F.xxhash64("text").alias("h"))
    if len(by) == 1:
        firsts = dealt.groupBy(F.col("go").alias("next_o")).agg(F.min_by("text", place).alias("guest"))
        guests = next_in_ring(grouped.select(F.col("go").alias("o"))).join(firsts, "next_o").select(F.col("o").alias("own_o"), "guest")
    else:
        firsts = dealt.groupBy(F.col("go").alias("next_o"), F.col("gs").alias("next_s")).agg(F.min_by("text", F.when(F.col("gz") == 0, place)).alias("guest"))
        following = next_groups(grouped.select(F.col("go").alias("o"), F.col("gs").alias("s")))
        guests = following.join(firsts, ["next_o", "next_s"]).select(F.col("o").alias("own_o"), F.col("s").alias("own_s"), "guest")
    guests = add_signatures(guests, "guest", "guest_sigs")

    rows = add_signatures(dealt, "text", "sigs")
    after = F.lead(F.struct("text", "sigs")).over(Window.partitionBy(*by).orderBy(order, F.xxhash64("text")))
    rows = rows.withColumn("after", after if len(by) == 1 else F.when(F.col("gz") == 0, after).otherwise(F.struct("text", "sigs")))
    own = F.col("go") == F.col("own_o") if len(by) == 1 else (F.col("go") == F.col("own_o")) & (F.col("gs") == F.col("own_s"))
    rows = rows.join(guests, own & F.col("after").isNull(), "left")
    times = F.lit(1) if len(by) == 1 else F.col("times")
    rows = rows.select("key", "text", "sigs", F.coalesce("after.text", "guest").alias("next_text"), F.coalesce("after.sigs", "guest_sigs").alias("next_sigs"), times.alias("times"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("key", "times", "sigs", "next_sigs", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = add_signatures(rows, "edited", "edited_sigs")
    found = rows.select(
        F.col("key").alias(key),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        *([] if len(by) == 1 else ["times"]),
    )
    return found if len(by) == 1 else found.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


def near_pairs(sets: DataFrame, key: str = "doc_id", sigs: str = "sigs", threshold: float = 0.8) -> DataFrame:
    """All pairs of different signature sets with Jaccard likeness of at least threshold.

    Returns a, b (sets' least keys, a < b) and likeness; equal sets are one set and
    must be grouped by the caller. Sets are partitioned by length: partition k holds
    lengths from threshold**-k up, so only equal or neighbouring partitions can
    match. In each, a set is found by its rarest signatures: of a set of n, the
    first n - ceil(threshold * n) + 1 in order of rarity must hold one of any match's.
    Lengths prune pairs before the sets are compared. Empty sets match nothing.
    """
    one = sets.filter(F.size(sigs) > 0).groupBy(F.col(sigs).alias("s")).agg(F.min(key).alias("id"))
    one = one.withColumn("n", F.size("s")).withColumn("part", F.floor(F.log("n") / math.log(1 / threshold) + 1e-9))
    rarity = one.select(F.explode("s").alias("sig")).groupBy("sig").count()
    terms = one.select("id", "n", "part", F.explode("s").alias("sig")).join(rarity, "sig")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("count", "sig"))
    prefix = terms.withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).select("id", "n", "part", "sig")
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "part", "sig")
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"), "sig")
    pairs = left.join(right, ["part", "sig"]).filter("a < b").filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9).select("a", "b").distinct()
    out = pairs.join(one.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(one.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return out.select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= threshold)


def near_links(docs: DataFrame, key: str = "doc_id", sigs: str = "sigs", threshold: float = 0.8) -> DataFrame:
    """One row per input row: key, set_id (the least key with the same signatures) and n_links (other sets that are near it).

    Copies are one set, so they make no pairs; what near_pairs gives is between sets.
    A document without signatures, as one of no text or null ones, has the set of all such and no links.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(sigs), F.array().cast("array<long>")).alias("s"))
    sets = rows.groupBy("s").agg(F.min("key").alias("set_id"))
    pairs = near_pairs(sets, "set_id", "s", threshold)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_links"))
    named = rows.withColumn("k", F.xxhash64("s")).join(sets.select(F.xxhash64("s").alias("k"), F.col("s").alias("same"), "set_id"), "k").filter(F.col("s") == F.col("same"))
    return named.join(ends, "set_id", "left").select(F.col("key").alias(key), "set_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
