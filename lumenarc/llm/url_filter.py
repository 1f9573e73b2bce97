"""URL filters by a sort-merge range join.

A rule (host, path) becomes the interval of all strings that start with its
canonical key: the labels of its host in reverse order, each with an end mark,
then, if the rule has a path, a path mark and the path. The key of a rule
without path is so a prefix of the keys of its host and all subdomains. A url
has one key for each of its host's ancestors that a rule could name, always
with its path.

Intervals of prefixes are nested or apart, so a sorted sweep keeps a stack of
open rules: an interval's start pushes its rule, its end pops it. The stack is
held in slots: the running sum of starts and ends is the depth, a start writes
the slot of its depth, and what an end leaves on top is the last that was
written to the slot of the depth it returns to. Urls and interval ends are then
sorted together, and a url takes the top of the stack after the last end before
it. Ranges of keys are swept apart from each other; each starts with what the
ranges before it left, one row per range (and slot).

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import lower_ascii, table
from lumenarc.runtime import Workspace

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return lower_ascii(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: End mark of a label and mark before a path, below all printable characters.
LABEL_END, PATH, ESCAPE = "\x01", "\x02", "\x03"


def labels_of(host: Column) -> Column:
    """The host's labels in reverse order; marks that stand in the host itself are escaped."""
    for mark, name in ((ESCAPE, "c"), (LABEL_END, "a"), (PATH, "b")):
        host = F.replace(host, F.lit(mark), F.lit(ESCAPE + name))
    return F.reverse(F.split(host, r"\.", -1))


def host_key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, LABEL_END), F.lit(LABEL_END))


def rule_keys(rules: DataFrame) -> DataFrame:
    """key (binary), own (size, rule, verdict) and labels of rules(host, path, verdict).

    Of rules with the same host and path the greater verdict (``block``) wins;
    a null host or path counts as empty.
    """
    host, path = lower_ascii(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    one = rules.select(host.alias("host"), path.alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = labels_of(F.col("host"))
    key = F.concat(host_key(labels), F.when(F.col("path") != "", F.concat(F.lit(PATH), F.col("path"))).otherwise(""))
    own = F.struct((F.length("host") + F.length("path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict")
    return one.select(key.cast("binary").alias("key"), own.alias("own"), F.size(labels).alias("labels"))


def before(by: list[str]):
    """All earlier ranges of the same ``by``."""
    return Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)


def stack_tops(rules: DataFrame, work: Workspace) -> DataFrame:
    """key, top: each start and end of the rules' intervals and the rule on top of the stack after it (null if it is empty)."""
    start = rules.select("key", F.lit(1).alias("step"), "own")
    # 0xFF is in no UTF-8 text, so this end comes after every key with the prefix.
    end = rules.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(rules.schema["own"].dataType).alias("own"))
    ends = work.save(start.unionByName(end).repartitionByRange("key").withColumn("range", F.spark_partition_id()), "ends")
    # The depth: a running sum within each range, after the sums of the ranges before (one row per range).
    totals = ends.groupBy("range").agg(F.sum("step").alias("n")).withColumn("upto", F.coalesce(F.sum("n").over(before([])), F.lit(0))).select("range", "upto")
    within = F.sum("step").over(Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    deep = work.save(ends.withColumn("n", within).join(F.broadcast(totals), "range").select("key", "range", "own", (F.col("n") + F.col("upto")).alias("slot")), "depths")
    written = deep.groupBy("range", "slot").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("key"))).alias("own"))
    left = written.withColumn("left", F.last("own", True).over(before(["slot"]))).select("range", "slot", "left")
    top = F.last("own", True).over(Window.partitionBy("range", "slot").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = deep.withColumn("top", top).join(left, ["range", "slot"])
    return found.select("key", F.when(F.col("slot") > 0, F.coalesce("top", "left")).alias("top"))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per url row: id, host, path, rule (null without one), verdict.

    A rule fits its host and all subdomains if the url's path starts with the
    rule's (an empty one fits all); of all that fit, the longest host and path
    together win, then the larger rule text. A null url, or one without
    ``://``, has an empty host and path. Repeated rows and ids stay apart;
    without rules all get ``default``; an empty table gives an empty one.
    """
    spark = urls.sparkSession
    work = Workspace(spark, "url-filter")
    rules = work.save(rule_keys(rules), "rules")
    depth = rules.agg(F.max("labels")).first()[0] or 0
    tops = work.save(stack_tops(rules, work), "tops")
    pages = urls.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("row"))
    pages = work.save(pages, "pages")
    labels = labels_of(F.col("host"))
    ancestors = F.transform(F.sequence(F.lit(1), F.least(F.lit(max(depth, 1)), F.size(labels))), lambda n: host_key(F.slice(labels, F.lit(1), n)))
    kind = rules.schema["own"].dataType
    points = pages.select("row", "path", F.explode(ancestors).alias("ancestor")).select("row", F.concat("ancestor", F.lit(PATH), "path").cast("binary").alias("key"), F.lit(None).cast(kind).alias("top"), F.lit(False).alias("event"))
    events = tops.select(F.lit(-1).cast("long").alias("row"), "key", "top", F.lit(True).alias("event"))
    # Ties are cut by row, so a key that a third of the urls share still spreads over ranges; a rule's start (row -1) comes before the urls of its key.
    swept = points.unionByName(events).repartitionByRange("key", "row").withColumn("range", F.spark_partition_id())
    swept = work.save(swept, "swept")
    last = swept.filter("event").groupBy("range").agg(F.max_by(F.struct("top"), "key").alias("open"))
    # One row per range: as many as shuffle partitions, whatever the input.
    carried = swept.select("range").distinct().join(last, "range", "left").select("range", F.last("open", True).over(before([])).alias("carry"))
    since = Window.partitionBy("range").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.last(F.when(F.col("event"), F.struct("top")), True).over(since)
    hit = swept.withColumn("state", state).filter(~F.col("event")).join(F.broadcast(carried), "range").select("row", F.coalesce("state", "carry")["top"].alias("hit"))
    best = hit.filter("hit is not null").groupBy("row").agg(F.max("hit").alias("hit"))
    return pages.join(best, "row", "left").select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, path, verdict rows of literals, which need no Python worker."""
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1).select(F.inline(rows))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url"), rule_table(spark, RULES))


ORACLE = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
fit AS (SELECT u.page_id, r.host || r.path AS rule, r.verdict,
               row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC) AS n
        FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM u LEFT JOIN fit ON u.page_id = fit.page_id AND fit.n = 1
"""
