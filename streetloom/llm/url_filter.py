"""URL filters by a temporal list join, in DataFrame operations alone.

Dated list entries (list, action block or allow, kind domain or url, pattern, event add or remove, day) become validity
intervals: from an add to the next remove of the same entry. A capture is looked at under its host and every parent
domain (kind domain) and under its host and path (kind url); an entry counts if it was active on the day of the fetch.
A capture is blocked if a block entry was active and no allow entry was.

The as-of join meets a key's visits and intervals by month first, so a long history costs a visit only the intervals of
its month. Visits are reduced to distinct keys and days before they meet the lists, so a host with a third of all
captures is a few hundred rows there; it is spread over its days when results go back to the captures. Keys that no list
names (most parent domains) are left out before they are shuffled, where the lists' patterns are few enough to broadcast;
the visits of a listed key (a top domain may be one of every host) are dealt over SALTS parts, to which the key's few
results are copied. Captures without a host or a day take no part in a join.

Defined results: null or hostless urls have an empty host, match nothing and are not blocked; so do captures with a null
day. Events with a null field are left out. Of several events of an entry on one day a remove wins; an add while active
and a remove while inactive change nothing. Repeated captures get equal rows. Empty lists block nothing. Columns of captures
named host, n_entries, lists or blocked are replaced (after the url or the day has been read from them); all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = ["list", "action", "kind", "pattern"]
_FAR = "9999-12-31"
SALTS = 16
#: Patterns that are broadcast at most; more are met by a shuffle.
FEW_PATTERNS = 1_000_000


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.coalesce(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1), F.lit(""))


def intervals(events: DataFrame) -> DataFrame:
    """ENTRY, begin, finish (not included) of each time an entry was active."""
    known = events.dropna(subset=[*ENTRY, "event", "day"]).withColumn("pattern", F.lower("pattern"))
    days = known.groupBy(*ENTRY, "day").agg(F.min((F.col("event") == "add").cast("int")).alias("on"))
    order = Window.partitionBy(*ENTRY).orderBy("day")
    turns = days.withColumn("before", F.lag("on", 1, 0).over(order)).where("on <> before")
    return turns.withColumn("finish", F.coalesce(F.lead("day").over(order), F.lit(_FAR).cast("date"))).where("on = 1").select(*ENTRY, F.col("day").alias("begin"), "finish")


def _month(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def active(keys: DataFrame, events: DataFrame) -> DataFrame:
    """kind, pattern, day with the lists of entries active that day, as-of; keys are distinct (kind, pattern, day)."""
    wanted = keys.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    spans = intervals(events).crossJoin(F.broadcast(wanted)).where("begin <= last AND finish > first")
    months = F.sequence(_month(F.greatest("begin", "first")), _month(F.least(F.date_sub("finish", 1), F.col("last"))))
    spans = spans.withColumn("month", F.explode(months)).drop("first", "last")
    met = keys.withColumn("month", _month(F.col("day"))).join(spans, ["kind", "pattern", "month"]).where("day >= begin AND day < finish")
    return met.groupBy("kind", "pattern", "day").agg(F.collect_set("list").alias("lists"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("action") == "block").alias("block"), F.bool_or(F.col("action") == "allow").alias("allow"))


def listed(keys: DataFrame, events: DataFrame) -> DataFrame:
    """The rows of keys (kind, pattern, ...) that any event names."""
    names = events.select("kind", F.lower("pattern").alias("pattern")).where("kind IS NOT NULL AND pattern IS NOT NULL").distinct()
    few = names.limit(FEW_PATTERNS + 1).count() <= FEW_PATTERNS
    return keys.join(F.broadcast(names) if few else names, ["kind", "pattern"], "left_semi")


def _own(captures: DataFrame) -> str:
    """A beginning of names that no column of captures has."""
    own = "_"
    while any(c.lower().startswith(own) for c in captures.columns):
        own += "_"
    return own


def filter_urls(captures: DataFrame, events: DataFrame, *, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """captures with host, n_entries, lists (names, sorted, comma-joined) and blocked."""
    own = _own(captures)
    host, path, day = (F.col(own + c) for c in ("host", "path", "day"))
    added = {"host", "n_entries", "lists", "blocked"}
    kept = [c for c in captures.columns if c.lower() not in added or c in (url_col, day_col)]
    url = F.col(f"`{url_col}`")
    seen = captures.select(*[F.col(f"`{c}`") for c in kept], host_of(url).alias(own + "host"), path_of(url).alias(own + "path"), F.col(f"`{day_col}`").cast("date").alias(own + "day"))
    whole = (host != "") & day.isNotNull()
    visits = seen.where(whole).select(host.alias("host"), path.alias("path"), day.alias("day")).distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    page = F.array(F.struct(F.lit("url").alias("kind"), F.lower(F.concat("host", "path")).alias("pattern")))
    keyed = listed(visits.select("host", "path", "day", F.explode(F.concat(parents, page)).alias("k")).select("host", "path", "day", "k.kind", "k.pattern"), events)
    hits = active(keyed.select("kind", "pattern", "day").distinct(), events)
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)))
    met = salted.join(hits.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["kind", "pattern", "day", "salt"])
    found = met.groupBy(F.col("host").alias(own + "host"), F.col("path").alias(own + "path"), F.col("day").alias(own + "day")).agg(F.sum("n").alias(own + "n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lists")))), ",").alias(own + "lists"), (F.bool_or("block") & ~F.bool_or("allow")).alias(own + "blocked"))
    joined = seen.where(whole).join(found, [own + "host", own + "path", own + "day"], "left")
    none = {"n": F.lit(None).cast("long"), "lists": F.lit(None).cast("string"), "blocked": F.lit(None).cast("boolean")}
    apart = seen.where(~F.coalesce(whole, F.lit(False))).withColumns({own + k: v for k, v in none.items()})
    out = joined.unionByName(apart)
    return out.select(*[F.col(f"`{c}`") for c in kept if c.lower() not in added], host.alias("host"), F.coalesce(own + "n", F.lit(0)).alias("n_entries"), F.coalesce(own + "lists", F.lit("")).alias("lists"), F.coalesce(own + "blocked", F.lit(False)).alias("blocked"))


def list_events(pages: DataFrame) -> DataFrame:
    """Dated events of four lists made from pages: two turns for each listed host or address, one month for a domain."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern"), "page_id").where("pattern <> ''").groupBy("pattern").agg(F.min("page_id").alias("k"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    k = F.col("k")
    start, stay = k * 7 % 300, k % 60 + 10
    turns = F.array(*[F.struct(F.lit(e).alias("event"), day(n).alias("day")) for e, n in (("add", start), ("remove", start + stay), ("add", start + stay + 30))])
    entry = lambda name, action, rows, kind="domain": rows.select(F.lit(name).alias("list"), F.lit(action).alias("action"), F.lit(kind).alias("kind"), "pattern", F.explode(turns).alias("t")).select("list", "action", "kind", "pattern", "t.event", "t.day")
    top = pages.sparkSession.range(1).select(F.lit("parents").alias("list"), F.lit("block").alias("action"), F.lit("domain").alias("kind"), F.lit("example.org").alias("pattern"), F.explode(F.array(*[F.struct(F.lit(e).alias("event"), F.lit(d).cast("date").alias("day")) for e, d in (("add", "2024-05-01"), ("remove", "2024-06-01"))])).alias("t")).select("list", "action", "kind", "pattern", "t.event", "t.day")
    urls = pages.where(host_of(F.col("url")) != "").groupBy(F.lower(F.concat(host_of(F.col("url")), path_of(F.col("url")))).alias("pattern")).agg(F.min("page_id").alias("k"))
    return entry("blocked", "block", hosts.where("k % 3 = 0")).union(entry("allowed", "allow", hosts.where("k % 7 = 0"))).union(entry("pages", "block", urls.where("k % 5 = 0"), "url")).union(top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return filter_urls(captures, list_events(pages)).select("page_id", "url", "fetched", "host", "n_entries", "lists", "blocked")
