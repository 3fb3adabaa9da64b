"""Two views of plain business tables as activity events.

* ``user_archive``: the ``events`` table as raw archive events with a JSON payload
  (entity = user, sub-day times).
* ``part_events``: ``lineitem`` joined to ``orders`` (entity = part, actor =
  customer, many entities), already in canonical columns; ``part_cohort`` adds
  the attributes of ``part``.

The data spans differ from six months, so each view has its own windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.config import CohortConfig
from cohortlens.operators.cohort import cohort, heavy_entities
from cohortlens.sources.events import canonical_events
from cohortlens.storage import deal, dealt_tasks

# Windows and thresholds scaled to the 30 days of ``events``.
USER_CONFIG = CohortConfig(
    early_days=7,
    horizon_days=28,
    sustain_from=15,
    week_bins=((0, 1), (2, 3), (4, 5), (6, 7)),
    min_events=12,
    starred_min=20,
    community_min=40,
    success_stars=15,
    success_contributors=44,
)

# Windows and thresholds scaled to the years of ``lineitem``.
PART_CONFIG = CohortConfig(
    created="first_event",
    early_days=300,
    horizon_days=1800,
    sustain_from=901,
    week_bins=((0, 70), (71, 140), (141, 210), (211, 300)),
    min_events=3,
    starred_min=6,
    community_min=20,
    success_stars=7,
    success_contributors=24,
)

USER_TYPES = {
    "signup": "CreateEvent",
    "click": "PushEvent",
    "view": "WatchEvent",
    "purchase": "PullRequestEvent",
    "error": "IssuesEvent",
}
# Kinds that a user's event turns into for some values of its field ``k``: (kind, divisor, remainder) -> kind.
USER_TURNED = {
    ("click", 7, 3): "ReleaseEvent",
    ("view", 6, 1): "ForkEvent",
    ("purchase", 5, 0): "PullRequestReviewEvent",
    ("purchase", 5, 1): "PullRequestReviewCommentEvent",
    ("error", 3, 0): "IssueCommentEvent",
}
PART_TYPES = {
    1: "PushEvent",
    2: "WatchEvent",
    3: "IssuesEvent",
    4: "PullRequestEvent",
    5: "IssueCommentEvent",
    6: "ForkEvent",
    7: "ReleaseEvent",
}
REVIEW = "PullRequestReviewEvent"
PART_ACTIONS = {"A": "opened", "R": "closed", "N": "other"}


# Column types of the tables, so that reading starts no schema job.
TABLE_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
        "l_shipdate TIMESTAMP_NTZ"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, mapping: dict) -> str:
    branches = " ".join(f"WHEN {key!r} THEN {value!r}" for key, value in mapping.items())
    return f"CASE {column} {branches} END"


def user_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw archive events; the payload carries the fields as JSON, the size of some is missing."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "ts", "user_id", "event_type", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k"
    )
    payload = """named_struct(
        'ref_type', CASE WHEN event_type = 'signup' THEN 'repository' END,
        'size', CASE WHEN k % 9 > 0 THEN k END,
        'action', CASE WHEN k % 2 = 0 THEN 'opened' ELSE 'closed' END,
        'repository', named_struct(
            'language', CASE WHEN k % 7 > 0 THEN concat('lang-', k % 5) END,
            'description', CASE WHEN k % 3 > 0 THEN concat('[say] "', k % 6, '"') END,
            'license', CASE WHEN k % 4 > 0 THEN named_struct('key', concat('lic-', k % 4)) END,
            'fork', CASE WHEN k % 10 = 0 THEN TRUE WHEN k % 10 != 1 THEN FALSE END))"""
    turned = " ".join(f"WHEN event_type = {e!r} AND k % {d} = {r} THEN {kind!r}" for (e, d, r), kind in USER_TURNED.items())
    name = "concat('user-', user_id, CASE WHEN k < 50 THEN '' ELSE '-renamed' END)"
    return rows.selectExpr(
        f"named_struct('id', user_id, 'name', {name}) AS repo",
        "named_struct('id', k, 'login', concat('actor-', k)) AS actor",
        f"CASE {turned} ELSE {_case('event_type', USER_TYPES)} END AS type",
        "CAST(ts AS TIMESTAMP) AS created_at",
        f"to_json({payload}) AS payload",
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(user_archive(spark, sf_dir))


def half_year_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user events with their month drawn out to half a year, which the published dates and windows cut."""
    start = "unix_micros(TIMESTAMP '2024-01-01 00:00:00')"
    drawn = f"timestamp_micros({start} + 6 * (unix_micros(event_time) - {start}))"
    return user_events(spark, sf_dir).withColumn("event_time", F.expr(drawn))


def part_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` joined to ``orders`` as canonical events."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # from the footers of the files
    rows = lines.count() + orders.count()
    joined = deal(lines, rows, "l_orderkey").join(deal(orders, rows, "o_orderkey"), F.expr("l_orderkey = o_orderkey"))
    return joined.selectExpr(
        "l_partkey AS entity_id",
        "concat('part-', l_partkey) AS entity_name",
        f"CASE WHEN l_linenumber = 4 AND l_quantity % 5 = 0 THEN '{REVIEW}' ELSE {_case('l_linenumber', PART_TYPES)} END AS event_type",
        "o_custkey AS actor_id",
        "concat('customer-', o_custkey) AS actor_login",
        "CAST(l_shipdate AS TIMESTAMP) AS event_time",
        f"{_case('l_returnflag', PART_ACTIONS)} AS action",
        "CAST(l_quantity AS BIGINT) AS size",
    )


def part_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part from its first event on, with the attributes of ``part``.

    The events are reduced to one row per part before the attributes are joined.
    """
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.count()
    # every event is a line, and the lines alone are counted without the join
    ids = lines.select(F.col("l_partkey").alias("entity_id")).filter("entity_id IS NOT NULL")
    heavy = heavy_entities(ids, PART_CONFIG, rows) if dealt_tasks(spark, rows) else []
    first = cohort(part_events(spark, sf_dir).filter("entity_id IS NOT NULL"), PART_CONFIG, ["actor_id"], rows, heavy)
    joined = first.join(table(spark, sf_dir, "part"), F.expr("entity_id = p_partkey"))
    return joined.selectExpr(
        "entity_id",
        "concat('part-', entity_id) AS entity_name",
        "p_brand AS language",
        "CASE WHEN p_type != 'ECONOMY' THEN p_name END AS description",
        "actor_id",
        "concat('customer-', actor_id) AS actor_login",
        "created_at",
    )
