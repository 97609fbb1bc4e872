"""URL filter lists over time: dated entries, and which were active when a capture was made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .templates import host_of

#: No end: later than any capture.
FOREVER = (1 << 63) - 1


def validity(entries: DataFrame) -> DataFrame:
    """Validity intervals [valid_from, valid_to) of dated entries.

    entries: kind (host, domain, prefix), pattern, category, at (long seconds),
    action (add, remove). An entry is active from its addition to the next event of
    the same kind, pattern and category. Hosts are lower-cased, a prefix's path is not. Repeated rows count once; of an addition
    and a removal at the same second the removal counts. Rows with a null in kind,
    pattern, at or action, or of another kind or action, are left out; a null category is
    the empty one.
    """
    cut = F.locate("/", F.concat("pattern", F.lit("/")))
    spelled = F.concat(F.lower(F.substring("pattern", F.lit(1), cut - 1)), F.substring("pattern", cut, F.length("pattern")))
    clean = entries.select("kind", F.when(F.col("kind") == "prefix", spelled).otherwise(F.lower("pattern")).alias("pattern"), F.coalesce("category", F.lit("")).alias("category"), F.col("at").cast("long").alias("at"), "action")
    clean = clean.filter("kind in ('host', 'domain', 'prefix') and pattern is not null and at is not null and action in ('add', 'remove')")
    events = clean.groupBy("kind", "pattern", "category", "at").agg(F.max("action").alias("action"))
    until = F.lead("at").over(Window.partitionBy("kind", "pattern", "category").orderBy("at"))
    return events.withColumn("valid_to", F.coalesce(until, F.lit(FOREVER))).filter("action = 'add'").select("kind", "pattern", "category", F.col("at").alias("valid_from"), "valid_to")


def url_keys(url: Column) -> Column:
    """What entries can match a URL by, as structs of key and folder.

    Its host; its domain's suffixes of one label or more; host and path down to each
    segment, without the slash after it, and whether there is one (folder).
    """
    host = host_of(url)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    key = lambda name, folder: F.struct(name.alias("key"), folder.alias("folder"))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: key(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")), F.lit(True)))
    parts = F.split(path, "/")  # the first is empty, the last too if the path ends with a slash
    named = lambda k: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(parts, 1, k), "/"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: key(named(k), k < F.size(parts)))
    prefixes = F.filter(prefixes, lambda x: ~x["key"].endswith("/"))
    return F.when(host == "", F.expr("cast(array() as array<struct<key: string, folder: boolean>>)")).otherwise(F.concat(F.array(key(F.concat(F.lit("host:"), host), F.lit(True))), domains, prefixes))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """The captures with what was active on the list when they were fetched.

    Adds n_active (active entries that match), categories (theirs, sorted and
    comma-joined), active_since (the first valid_from of them, null if none) and
    blocked. Columns of these names are replaced; all others and all rows stay.

    A host entry matches that host; a domain entry it and all hosts below it, a single
    label among them (com); a prefix entry, host and path, what begins with it if it
    ends with a slash, else that very path and all below it. Hosts are compared in lower case, paths as they are.

    Each capture is looked up by the few keys its URL has, in an as-of join: equal
    key, and the fetch time within the entry's validity. Only matches are grouped
    by URL and time. A host with very many captures is one key of the join only; both
    sides are dealt out for it on a hash of the key, so that Spark can split it, and
    a small list is broadcast by Spark where its size allows.

    A null or relative URL and a null fetch time match nothing. An empty list
    blocks nothing, an empty capture table gives an empty result.
    """
    made = ("n_active", "categories", "active_since", "blocked")
    kept = [c for c in captures.columns if c not in made]
    once = captures.select(F.col(url).alias("_url"), F.col(at).alias("_at")).filter("_url is not null and _at is not null").distinct()
    keys = once.select("_url", "_at", F.explode(url_keys(F.col("_url"))).alias("_x")).select("_url", "_at", F.col("_x.key").alias("_key"), F.col("_x.folder").alias("_folder"))
    pattern = F.concat("kind", F.lit(":"), "pattern")
    active = validity(entries).select(F.regexp_replace(pattern, "/$", "").alias("_pattern"), F.col("pattern").endswith("/").alias("_below"), "category", "valid_from", "valid_to").withColumn("_k", F.xxhash64("_pattern"))
    time = F.col("_at").cast("long")
    hits = keys.withColumn("_k", F.xxhash64("_key")).join(active, "_k").filter((F.col("_key") == F.col("_pattern")) & (F.col("_folder") | ~F.col("_below")) & (time >= F.col("valid_from")) & (time < F.col("valid_to")))
    found = hits.groupBy("_url", "_at").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.min("valid_from").alias("active_since"))
    out = captures.select(*kept, F.col(url).alias("_u"), F.col(at).alias("_t")).join(found, (F.col("_u") == F.col("_url")) & (F.col("_t") == F.col("_at")), "left")
    return out.select(*kept, F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("categories", F.lit("")).alias("categories"), "active_since", F.col("n_active").isNotNull().alias("blocked"))
