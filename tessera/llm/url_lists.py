"""Temporal list join: dated entries of URL lists become intervals, and captures meet those active at fetch time.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bucket in days: captures and intervals meet within a host and bucket.
BUCKET_DAYS = 90


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without user, port and final dot; null without one."""
    host = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]*\]|[^/?#:\s]*)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def domains(host: Column, most: Column) -> Column:
    """host and its parent domains of two to ``most`` labels."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    first = F.greatest(n - most + 1, F.lit(2))
    parents = F.transform(F.sequence(first, n - 1), lambda i: F.array_join(F.slice(parts, i, n), "."))
    return F.concat(F.array(host), F.when(first < n, parents).otherwise(F.array().cast("array<string>")))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, since, until) from entries (list, domain, day, action); until is exclusive, null while open.

    An entry holds until the next of its list and domain; of entries of one day, 'remove' wins. Entries with a null
    list, domain or day, or another action than add or remove, have no meaning and are left out.
    """
    good = entries.where("list is not null and domain is not null and day is not null and action in ('add', 'remove')")
    good = good.groupBy("list", F.lower("domain").alias("domain"), F.col("day").cast("date").alias("since")).agg(F.max("action").alias("action"))
    after = Window.partitionBy("list", "domain").orderBy("since")
    return good.withColumn("until", F.lead("since").over(after)).where("action = 'add'").drop("action")


def temporal_list_join(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched", bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """captures with ``host``, ``lists`` (sorted names of lists whose entries match) and ``n_active`` (matching entries).

    An entry matches if its domain is the URL's host or a parent domain of it and it is active on the day of the fetch
    (since <= day < until). Captures without a host or day match nothing.

    Both sides meet by equality on domain and time bucket, so neither a host with very many captures nor a list entry
    that changes often makes more than the rows of one bucket; Spark splits buckets that are still skewed. Of a host's
    parents those are looked up that have no more labels than some entry's domain. Matches are counted by host and day,
    with partial aggregation, and joined back by both. Captures of one host and day are looked up once. Extra columns of captures stay; ``host``, ``lists`` and ``n_active`` replace columns of those names.
    """
    bucket = lambda day: F.floor(F.unix_date(day) / bucket_days)
    day = F.col(day_col).cast("date")
    keyed = captures.withColumn("__host", host_of(F.col(url_col).cast("string"))).withColumn("__day", day)
    asked = keyed.select("__host", "__day").where("__host is not null and __day is not null").distinct()
    lo, hi = (F.lit(x).cast("date") for x in asked.agg(F.min("__day"), F.max("__day")).first())  # intervals are cut into the buckets of these days alone
    spans = intervals(entries).where((F.col("since") <= hi) & (F.col("until").isNull() | (F.col("until") > lo)))
    most = entries.agg(F.max(F.size(F.split("domain", r"\."))).alias("n")).first()["n"] or 1
    asked = asked.select("__host", "__day", bucket(F.col("__day")).alias("__bucket"), F.explode(domains(F.col("__host"), F.lit(most))).alias("__domain"))
    first, last = F.greatest("since", lo), F.least(F.coalesce(F.date_sub("until", 1), hi), hi)
    spans = spans.select("list", "domain", "since", "until", F.explode(F.sequence(bucket(first), bucket(last))).alias("bucket"))
    on = (F.col("__domain") == F.col("domain")) & (F.col("__bucket") == F.col("bucket")) & (F.col("__day") >= F.col("since"))
    on &= F.col("until").isNull() | (F.col("__day") < F.col("until"))
    found = asked.join(spans, on).groupBy("__host", "__day").agg(F.array_sort(F.collect_set("list")).alias("__lists"), F.count(F.lit(1)).alias("__n"))
    out = keyed.drop("host", "lists", "n_active").join(found, ["__host", "__day"], "left")
    out = out.withColumns({"host": F.col("__host"), "lists": F.coalesce("__lists", F.array().cast("array<string>")), "n_active": F.coalesce("__n", F.lit(0).cast("long"))})
    return out.drop("__host", "__day", "__lists", "__n")


#: First day of the fetches and of the list entries that the query derives for the pages, which have no dates.
START = "2023-01-01"


def op5_temporal_lists(spark, sf_dir: str) -> DataFrame:
    """All pages, fetched on days derived from page_id, against entries derived from their hosts by MD5.

    Of every host: 'malware' adds and later removes it, 'spam' adds its parent domain, removes it and adds it again.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    pages = pages.withColumn("fetched", F.date_add(F.lit(START).cast("date"), (F.col("page_id") % 730).cast("int")))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    number = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), "domain")), 1, 4), 16, 10).cast("int")
    own = hosts.select(F.col("host").alias("domain"))
    parent = hosts.select(F.substring_index("host", ".", -2).alias("domain")).distinct()
    dated = lambda df, name, action, days: df.select(F.lit(name).alias("list"), "domain", F.date_add(F.lit(START).cast("date"), days).alias("day"), F.lit(action).alias("action"))
    a, b, c = number("a") % 600, number("b") % 200, number("c") % 200
    entries = dated(own, "malware", "add", a).union(dated(own, "malware", "remove", a + b))
    entries = entries.union(dated(parent, "spam", "add", b)).union(dated(parent, "spam", "remove", b + c)).union(dated(parent, "spam", "add", b + c + a))
    out = temporal_list_join(pages, entries)
    return out.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "n_active", F.array_join("lists", ",").alias("lists"), (F.col("n_active") == 0).alias("allowed"))


ORACLE = r"""
with p as (select page_id, nullif(rtrim(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]*\]|[^/?#:\s]*)', 1), '.'), '') as host,
  date '2023-01-01' + (page_id % 730)::int as fetched from pages),
own as (select distinct host as domain from p where host is not null),
parent as (select distinct array_to_string(string_split(domain, '.')[greatest(len(string_split(domain, '.')) - 1, 1):], '.') as domain from own),
o as (select domain, ('0x' || substr(md5('a' || domain), 1, 4))::int % 600 as a, ('0x' || substr(md5('b' || domain), 1, 4))::int % 200 as b from own),
q as (select domain, ('0x' || substr(md5('a' || domain), 1, 4))::int % 600 as a, ('0x' || substr(md5('b' || domain), 1, 4))::int % 200 as b,
  ('0x' || substr(md5('c' || domain), 1, 4))::int % 200 as c from parent),
spans as (
  select 'malware' as list, domain, date '2023-01-01' + a as since, date '2023-01-01' + (a + b) as until from o
  union all select 'spam', domain, date '2023-01-01' + b, date '2023-01-01' + (b + c) from q
  union all select 'spam', domain, date '2023-01-01' + (b + c + a), date '9999-12-31' from q where a > 0
  union all select 'spam', domain, date '2023-01-01' + b, date '9999-12-31' from q where a = 0 and false),
hit as (select page_id, list from p join spans s on (p.host = s.domain or ends_with(p.host, '.' || s.domain)) and p.fetched >= s.since and p.fetched < s.until),
n as (select page_id, count(*) as n, string_agg(distinct list, ',' order by list) as lists from hit group by page_id)
select page_id, host, fetched::date::varchar as fetched, coalesce(n, 0)::bigint as n_active, coalesce(lists, '') as lists, coalesce(n, 0) = 0 as allowed
from p left join n using (page_id)
"""
