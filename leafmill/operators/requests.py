"""Jobs over captured network requests and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.common import contains_ignoring_case, first_match, stamp
from leafmill.plans.ordered import Ordered
from leafmill.plans.ranges import blocks


def failure_type() -> Column:
    return first_match([
        (F.col("status") == "failed", F.lit("network_failure")),
        (F.coalesce("response_status", F.lit(200)) >= 400, F.lit("http_error")),
    ])


def failed_requests(requests: DataFrame) -> DataFrame:
    """Network failures, and answers of 400 or more."""
    network = F.col("failure") == "network_failure"
    return (requests.withColumn("failure", failure_type()).filter(F.col("failure").isNotNull())
            .withColumn("error", F.when(network, F.coalesce("failure_text", F.lit("Unknown"))))
            .withColumn("http_status", F.when(~network, F.col("response_status"))))


def requests_filtered(requests: DataFrame, resource_type: str | None = None,
                      status: str | None = None) -> DataFrame:
    kept = requests
    if resource_type is not None:
        kept = kept.filter(F.col("resource_type") == resource_type)
    if status is not None:
        kept = kept.filter(F.col("status") == status)
    return kept


def search_requests(requests: DataFrame, text: str) -> DataFrame:
    return requests.filter(contains_ignoring_case("url", text))


def status_class() -> Column:
    code = F.coalesce("response_status", F.lit(0))
    return first_match([(code == 0, F.lit("pending")), (code < 300, F.lit("2xx")), (code < 400, F.lit("3xx")),
                        (code < 500, F.lit("4xx"))], F.lit("5xx"))


def request_stats(requests: DataFrame) -> DataFrame:
    """Counts by resource type and by status class from one grouped pass."""
    counts = (requests.withColumn("class", status_class())
              .groupBy("resource_type", "class").agg(F.count(F.lit(1)).alias("n")))
    pairs = F.array(F.struct(F.lit("resource_type").alias("dimension"), F.col("resource_type").alias("value")),
                    F.struct(F.lit("status_class").alias("dimension"), F.col("class").alias("value")))
    return (counts.select(F.explode(pairs).alias("d"), "n").groupBy("d.dimension", "d.value")
            .agg(F.sum("n").alias("requests")))


def last_responses(responses: DataFrame) -> DataFrame:
    """The latest response per URL, as a maximum: it combines before the shuffle."""
    rest = [c for c in responses.columns if c not in ("url", "ts", "seq")]
    return (responses.groupBy("url").agg(F.max(F.struct("ts", "seq", *rest)).alias("r"))
            .select("url", *[F.col(f"r.{c}").alias(f"resp_{c}") for c in rest],
                    F.lit(True).alias("answered")))


def requests_last_response(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every request with the last response to its URL; none gives status 0."""
    joined = requests.join(last_responses(responses), "url", "left")
    return joined.withColumn("har_status", F.coalesce("resp_status", F.lit(0)))


def api_calls(requests: DataFrame, responses: DataFrame, api_base: str = "/api") -> DataFrame:
    calls = requests.filter(F.col("url").contains(api_base)).join(last_responses(responses), "url", "left")
    return calls.select(
        "seq", "method", "url",
        F.coalesce(F.col("resp_status").cast("string"), F.col("response_status").cast("string"),
                   F.lit("pending")).alias("status"),
        F.when(F.col("answered"), F.coalesce("resp_ok", F.lit(False)))
        .otherwise(F.col("status") == "completed").alias("ok"), "ts")


def match_requests_fifo(requests: DataFrame, completions: DataFrame, key: str = "url",
                        block: str = "hour") -> DataFrame:
    """Each completion closes the oldest open request of its URL; with none open
    it is ignored. Requests left open stay pending. ``key`` may name a request id
    instead. ``block`` is the time span one task takes of a busy key, or ``range`` for blocks of equal depth.

    Per key, in time order, let ``lead`` be completions minus requests so far. A
    completion is ignored exactly where ``lead`` reaches a new maximum above
    zero; the others pair with requests by ordinal. Running values are taken in
    blocks of time, so a busy key is spread over tasks, and the two sides of a pair
    meet in one aggregate by (key, ordinal).
    """
    events = (requests.select(key, "ts", "seq", F.lit(0).alias("done"),
                              F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("code"))
              .unionByName(completions.select(key, "ts", "seq", F.lit(1).alias("done"), "kind",
                                              F.col("status").alias("code"))))
    events, at = blocks(events, [key], ["ts", "seq"], block)
    order = Ordered([key], ["ts", "seq"], at)
    lead = F.col("closed_in") - F.col("opened_in")
    staged = order.carry(
        events,
        {"closed_in": F.sum("done").over(order.upto),
         "opened_in": F.sum(1 - F.col("done")).over(order.upto),
         "lead_in": lead,
         "peak_in": F.max("lead_in").over(order.upto),
         "peak_was_in": F.lag("peak_in").over(order.local)},
        {"closed_sum": F.sum("done"), "opened_sum": F.sum(1 - F.col("done")), "lead_top": F.max("lead_in")},
        {"closed_was": F.coalesce(F.sum("closed_sum").over(order.earlier), F.lit(0)),
         "opened_was": F.coalesce(F.sum("opened_sum").over(order.earlier), F.lit(0)),
         "peak_block": F.col("closed_was") - F.col("opened_was") + F.col("lead_top"),
         "peak_was": F.coalesce(F.max("peak_block").over(order.earlier), F.lit(0))})
    base = F.col("closed_was") - F.col("opened_was")
    # Completions ignored up to this row, and up to the row before it.
    ignored = F.greatest(F.lit(0), F.col("peak_was"), base + F.col("peak_in"))
    ignored_before = F.greatest(F.lit(0), F.col("peak_was"), base + F.col("peak_was_in"))
    staged = staged.select(
        key, "ts", "seq", "done", "kind", "code", (F.col("closed_was") + F.col("closed_in")).alias("closed"),
        (F.col("opened_was") + F.col("opened_in")).alias("opened"), ignored.alias("ignored"),
        (ignored > ignored_before).alias("drop_it"))
    # A request and its completion share key and ordinal, and nothing else has them.
    is_done = F.col("done") == 1
    ordinal = F.when(is_done, F.col("closed") - F.col("ignored")).otherwise(F.col("opened"))
    pairs = (staged.filter(~is_done | ~F.col("drop_it")).groupBy(key, ordinal.alias("ordinal"))
             .agg(F.max(F.when(~is_done, F.col("seq"))).alias("seq"), F.max(F.when(~is_done, F.col("ts"))).alias("ts"),
                  F.max(F.when(is_done, F.col("seq"))).alias("completion_seq"), F.max("kind").alias("kind"), F.max("code").alias("code"))
             .filter(F.col("seq").isNotNull()))
    status = F.when(F.col("kind").isNull(), "pending").when(F.col("kind") == "failed", "failed").otherwise("completed")
    return pairs.select(
        "seq", key, "ts", "completion_seq", status.alias("status"), F.col("code").alias("response_status"))


def har_entries(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One HAR 1.2 entry per request, as JSON; ``write_lines`` stores them.
    Request headers are a map column, response headers optional."""
    joined = requests.join(last_responses(responses), "url", "left")

    def pairs(name: str) -> Column:
        if name not in joined.columns:
            return F.array().cast("array<struct<name:string,value:string>>")
        return F.transform(F.map_entries(F.coalesce(name, F.create_map().cast("map<string,string>"))),
                           lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))

    body = F.when(F.length("post_data") > 0, F.struct(F.col("post_data").alias("text")))
    zero = F.lit(0)
    entry = F.struct(
        stamp("ts").alias("startedDateTime"),
        F.struct("method", "url", pairs("headers").alias("headers"), body.alias("postData")).alias("request"),
        F.struct(F.coalesce("resp_status", zero).alias("status"),
                 F.coalesce("resp_status_text", F.lit("")).alias("statusText"),
                 pairs("resp_headers").alias("headers")).alias("response"),
        F.create_map().cast("map<string,string>").alias("cache"),
        F.struct(zero.alias("send"), zero.alias("wait"), zero.alias("receive")).alias("timings"))
    return joined.select("seq", F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))
