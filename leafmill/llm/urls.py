"""URL verdicts by listed prefixes and listed pages.

A rule names a host and a path: it fits its host and all subdomains where the
URL's path starts with the rule's. A listed page is one canonical URL. Every URL
is turned into the keys under which a rule or page could list it. The keys pass
a blocked Bloom filter, one 64-bit block per key, and only possible hits reach
the exact hash join with the lists, which removes what the filter let through
by chance. Results never depend on the filter's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.llm.shared import fold_case, salt, saved, whole

#: Blocks of the filter, one 64-bit word each: 65,536 blocks are 0.5 MB whatever the lists hold, good for
#: about 300,000 keys at one in fifty. With more keys the filter passes more and the join decides.
BLOCKS = 65_536
PROBES = 5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return fold_case(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, and path without ending slashes or ``.html``."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/+)\z", ""))


def _mask() -> Column:
    """The bits that a key sets in its block: one per six bits of its hash ``h``."""
    def bit(n: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("h", 6 * n).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), map(bit, range(PROBES)))


def _placed(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows with the ``block`` and ``mask`` of their ``key``."""
    return (rows.withColumns({"block": F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)).cast("int"), "h": F.xxhash64("key", F.lit("bits"))})
            .withColumn("mask", _mask()).drop("h"))


def bloom(keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The filter of column ``key`` as rows (block, word): ``blocks`` rows at most."""
    return _placed(keys.select("key"), blocks).groupBy("block").agg(F.bit_or("mask").alias("word"))


def possible(rows: DataFrame, filter_rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Rows whose ``key`` the filter may hold. The filter has a bounded size, so it is sent to all tasks."""
    tested = _placed(rows, blocks).join(F.broadcast(filter_rows), "block")
    return tested.filter(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select(*rows.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", blocks: int = BLOCKS) -> DataFrame:
    """Per row of ``pages``: key, host, path, ``rule`` and ``verdict`` (allow or block).

    ``rules`` has host, path and action, ``listed`` has url (blocked pages, met by
    canonical form). The longest fitting rule decides; where none fits, a listed
    page is blocked and any other allowed. Equal rules of both actions block. A
    NULL URL or one without ``://`` has an empty host and path, no rule, and is
    allowed. Repeated rows are judged alike. Other columns are not read. Empty
    lists allow everything; an empty table gives no rows. The filter has ``blocks`` blocks whatever the lists: beyond
    some 300,000 keys it lets nearly everything pass to the exact join, which alone decides then.
    """
    rows = saved(pages.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"),
                              host_of(whole(url)).alias("host"), path_of(whole(url)).alias("path")), "urls")
    named = rules.select(fold_case(whole("host")).alias("host"), whole("path").alias("path"), "action").filter("host <> ''")
    pages_listed = listed.select(host_of(whole("url")).alias("host"), path_of(whole("url")).alias("path")).filter("host <> ''")
    entries = (named.select(F.concat(F.lit("R"), "host", "path").alias("key"), F.concat("host", "path").alias("rule"), "action")
               .union(pages_listed.select(F.concat(F.lit("U"), canonical(F.col("host"), F.col("path"))).alias("key"), F.lit(None).cast("string"), F.lit("block")))
               .groupBy("key").agg(F.max("rule").alias("rule"), F.max("action").alias("action")))
    entries = saved(entries, "url-lists")
    # A rule's path may end anywhere, so a URL is cut at each length that some rule has. Lengths are few, however many rules.
    lengths = named.agg(F.sort_array(F.collect_set(F.char_length("path"))).alias("lengths"))
    # Hosts and paths repeat: their keys are looked up once per distinct pair and part.
    sites = rows.withColumn("salt", salt("row")).groupBy("host", "path", "salt").agg(F.count(F.lit(1)).alias("n"))
    sites = sites.groupBy("host", "path").agg(F.collect_list("salt").alias("salts")).filter("host <> ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = lambda upto: F.transform(F.filter(upto, lambda n: n <= F.char_length("path")), lambda n: F.substring("path", F.lit(1), n))
    upto = F.array(*[F.lit(n) for n in lengths.first()["lengths"]]).cast("array<int>")
    cut = sites.select("*", F.explode(suffixes).alias("at")).select("*", F.explode(prefixes(upto)).alias("start"))
    keys = (cut.select("host", "path", F.concat(F.lit("R"), "at", "start").alias("key"))
            .union(sites.select("host", "path", F.concat(F.lit("U"), canonical(F.col("host"), F.col("path"))))))
    hits = possible(keys, bloom(entries, blocks), blocks)
    found = hits.join(entries.hint("shuffle_hash"), "key")
    best = (found.groupBy("host", "path")
            .agg(F.max(F.struct(F.coalesce(F.char_length("rule"), F.lit(-1)), "rule", "action")).alias("best"))
            .join(sites, ["host", "path"]).select("host", "path", "best.rule", "best.action", F.explode("salts").alias("salt")))
    return (rows.withColumn("salt", salt("row")).join(best, ["host", "path", "salt"], "left")
            .select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict")))
