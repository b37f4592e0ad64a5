"""Quality rules: base statistics, and lines that too many documents of a host share. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialize, maybe_broadcast

#: A line goes if more documents of its host hold it than LINE_DOCS and LINE_PERCENT / 100 of the host's documents.
LINE_DOCS, LINE_PERCENT = 20, 2
#: A document is depleted if less than KEEP_PERCENT / 100 of its words remain.
KEEP_PERCENT = 30
#: Base rules: fewest words, and the largest share of repeated words in hundredths.
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Most documents with a line that goes whose hashes of lines are broadcast.
SMALL_HITS = 20_000
_SPACES = " \t\n\x0b\f\r"
_GAP = r"[\x20\x09-\x0D]+"
#: White space within a line.
_INNER = r"[\x20\x09\x0B-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def repeated_words(w: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more in the array of words w, each counted once.

    Windows are hashed where they lie. Only where two are equal are they sorted with their positions, so that equal ones
    are neighbours: n log n steps for n words.
    """
    last = F.greatest(F.size(w) - 2, F.lit(0))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(placed, spots)

    def spots(s: Column) -> Column:
        twin = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
        step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"))
        return F.aggregate(at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"])

    hashes = F.transform(F.slice(w, 1, last), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)).cast("long")


def _squeezed(text: Column) -> Column:
    """text with single spaces between the words of each line."""
    return F.regexp_replace(text, _INNER, " ")


def _lines(squeezed: Column) -> Column:
    """Lines of a squeezed text, lower-cased and without spaces at their ends."""
    return F.transform(F.split(ascii_lower(squeezed), "\n"), lambda x: F.trim(x))


def _key(id_col: str, text_col: str, host_col: str) -> list[Column]:
    """128 bits that name a row's id, host and text: rows with all of these equal have one verdict."""
    host = F.col(host_col).cast("string")
    parts = [F.col(id_col).isNull(), F.col(id_col), host.isNull(), host, F.coalesce(F.col(text_col).cast("string"), F.lit(""))]
    return [F.xxhash64(*parts).alias("__k1"), F.xxhash64(F.lit(1), *parts).alias("__k2")]


def _measured(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One narrow row for each of df's, written: its number and key, base statistics, host, and its lines' hashes with
    word counts. One regular expression runs over each text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("t"), *_key(id_col, text_col, host_col))
    docs = docs.select("*", _squeezed(F.col("t")).alias("s"))
    docs = docs.select(
        "*", F.array_remove(F.split(F.translate("s", "\n", " "), " "), "").alias("w"), _lines(F.col("s")).alias("low"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "").alias("lines"),
    )
    counted = lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))
    long = lambda c, name: c.cast("long").alias(name)
    docs = docs.select(
        "id", F.monotonically_increasing_id().alias("number"), "__k1", "__k2", "host", long(F.size("w"), "n_words"), long(F.length(F.translate("t", _SPACES, "")), "word_chars"),
        long(F.length("t") - F.length(F.translate("t", "#*$%&|<>", "")), "n_symbols"), long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"), F.transform(F.filter("low", lambda x: x != ""), counted).alias("lines"),
    )
    return materialize(docs, "measured")


def _common_lines(docs: DataFrame, most: int, percent: int) -> DataFrame:
    """(host, line) of the lines above both limits. A document counts once for a line, however often it holds it.

    A document's lines are made distinct within its row, and then counted with map-side partial aggregation, so a line
    that a third of all documents hold is a few counts a task, and there is one shuffle.
    """
    held = docs.select("host", F.explode(F.array_distinct("lines.line")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    hosts = docs.groupBy(F.col("host").alias("__host")).agg(F.count(F.lit(1)).alias("all"))
    often = held.where(F.col("n") > most).join(hosts, F.col("host").eqNullSafe(F.col("__host")))
    return often.where(F.col("n") * 100 > F.col("all") * percent).select("host", "line")


def _judged(docs: DataFrame, most: int, percent: int, keep_percent: int) -> DataFrame:
    """docs with base_failed, kept, n_removed and gone_lines."""
    common = materialize(_common_lines(docs, most, percent), "common-lines")
    common = maybe_broadcast(common.select(F.col("host").alias("__host"), F.col("line").alias("__line")), common.count())
    held = docs.select("number", "host", F.explode("lines").alias("x")).select("number", "host", "x.line", "x.n")
    hit = held.join(common, F.col("host").eqNullSafe(F.col("__host")) & (F.col("line") == F.col("__line")))
    hit = materialize(hit.groupBy("number").agg(F.sum("n").cast("long").alias("gone"), F.collect_set("line").alias("gone_lines")), "hit-documents")
    out = docs.join(maybe_broadcast(hit, hit.count(), SMALL_HITS), "number", "left").withColumn("n_removed", F.coalesce("gone", F.lit(0).cast("long"))).drop("gone")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("n_removed")) >= keep_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: int = LINE_DOCS, percent: int = LINE_PERCENT, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """Statistics and verdict of each row of df, and the hashes of its lines that go.

    Words are runs of anything but space and U+0009 to U+000D. word_chars: code points in words; n_symbols: characters
    among #*$%&|<>; n_dup_lines: lines with a word that equal an earlier one; n_repeat_words: words in 3-word windows
    found twice or more. base_failed: fewer than 50 words, or more than half of them repeated. A line (lower-cased,
    spaces squeezed) goes if more than ``most`` documents of its host, and more than ``percent`` in a hundred of them,
    hold it; copies of a document count like others. kept is false for base_failed rows and for depleted ones, of whose
    words less than ``keep_percent`` in a hundred remain. n_removed is the number of words in lines that go; gone_lines
    has those lines' hashes.

    Null and empty texts have no words and fail. Null hosts form one host. Every row is a document: rows with null ids
    and repeated rows each count and give a row. An empty df gives an empty result. Other columns of df are ignored,
    whatever their names.
    """
    out = _judged(_measured(df, id_col, text_col, host_col), most, percent, keep_percent)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed", "gone_lines")


def apply_quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: int) -> DataFrame:
    """The kept rows of df with their texts rid of the lines that go (and n_chars, if there, counted anew).

    Rows that go and those with lines that go are found by a key of 128 bits; their list is broadcast if it is within
    the bound. The others pass as they are.
    """
    docs = _measured(df, id_col, text_col, host_col)
    found = _judged(docs, limits.get("most", LINE_DOCS), limits.get("percent", LINE_PERCENT), limits.get("keep_percent", KEEP_PERCENT))
    found = found.where("not kept or n_removed > 0").select("__k1", "__k2", "kept", F.col("gone_lines").alias("__gone"))
    found = materialize(found.dropDuplicates(["__k1", "__k2"]), "verdicts")
    discard(df.sparkSession, docs.stored_at)
    out = df.select("*", *_key(id_col, text_col, host_col)).join(maybe_broadcast(found.withColumnRenamed("kept", "__kept"), found.count()), ["__k1", "__k2"], "left")
    out, text = out.where("coalesce(__kept, true)"), F.col(text_col)
    both = F.arrays_zip(F.split(text, "\n").alias("a"), _lines(_squeezed(text)).alias("b"))
    rest = F.filter(both, lambda x: ~F.array_contains("__gone", F.xxhash64(x["b"])))
    out = out.withColumn(text_col, F.when(F.size("__gone") > 0, F.array_join(F.transform(rest, lambda x: x["a"]), "\n")).otherwise(text))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(df.schema["n_chars"].dataType))
    return out.select(df.columns)


def op4_line_frequency(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).drop("n_removed", "gone_lines")


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as t from documents),
w as (select r, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
g as (select r, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2),
win as (select r, i, w[i:i + 2] as g from g),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1),
cover as (select r, count(distinct i + k) as n from rep, range(0, 3) x(k) group by r),
lines as (select r, host, t, unnest(string_split(t, chr(10))) as line from d),
lw as (select r, host, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
  translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
dup as (select r, count(*) - count(distinct line) as n from lw where n > 0 group by r),
freq as (select host, k, count(distinct r) as n from lw where n > 0 group by host, k),
hosts as (select host, count(*) as n from d group by host),
common as (select host, k from freq join hosts using (host) where freq.n > 20 and 100 * freq.n > 2 * hosts.n),
gone as (select r, sum(n) as n from lw join common using (host, k) group by r),
x as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda s: length(s))), 0)::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0) as removed
  from w left join cover using (r) left join dup using (r) left join gone using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * (n_words - removed) >= 30 * n_words as kept
from x
"""
