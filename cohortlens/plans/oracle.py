"""The same queries as plain SQL over the given tables, for checking.

Written from the definitions, one statement per question, without the rewrites
of the Spark plans (staging, cells, buckets).
"""

from __future__ import annotations

from cohortlens.operators.profile import (
    BOX_COLUMNS,
    HISTOGRAM_COLUMNS,
    MATRIX_COLUMNS,
    TARGET,
    WEEK_COLUMNS,
)
from cohortlens.sources.dataset import (
    EARLY_COLUMNS,
    LABEL_COLUMNS,
    METADATA_COLUMNS,
    OUTCOME_COLUMNS,
)

RARE_BELOW = 78

USERS = """
raw AS (
  SELECT user_id, ts, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events
), ev AS (
  SELECT user_id AS id,
         'user-' || user_id || CASE WHEN k < 50 THEN '' ELSE '-renamed' END AS name,
         CASE event_type WHEN 'signup' THEN 'CreateEvent'
              WHEN 'click' THEN CASE WHEN k % 7 = 3 THEN 'ReleaseEvent' ELSE 'PushEvent' END
              WHEN 'view' THEN CASE WHEN k % 6 = 1 THEN 'ForkEvent' ELSE 'WatchEvent' END
              WHEN 'purchase' THEN CASE k % 5 WHEN 0 THEN 'PullRequestReviewEvent'
                   WHEN 1 THEN 'PullRequestReviewCommentEvent' ELSE 'PullRequestEvent' END
              WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN 'IssueCommentEvent' ELSE 'IssuesEvent' END END AS typ,
         k AS actor, 'actor-' || k AS login, ts AS t,
         CASE WHEN k % 2 = 0 THEN 'opened' ELSE 'closed' END AS act, CASE WHEN k % 9 > 0 THEN k END AS sz,
         CASE WHEN k % 7 > 0 THEN 'lang-' || (k % 5) END AS lang,
         CASE WHEN k % 3 > 0 THEN '[say] "' || (k % 6) || '"' END AS descr,
         CASE WHEN k % 4 > 0 THEN 'lic-' || (k % 4) END AS lic,
         CASE WHEN k % 10 = 0 THEN TRUE WHEN k % 10 <> 1 THEN FALSE END AS fork
  FROM raw
)"""

# the month of the events drawn out to half a year
HALF_YEAR = USERS.replace(
    "SELECT user_id, ts,", "SELECT user_id, make_timestamp(6 * epoch_us(ts) - 5 * epoch_us(TIMESTAMP '2024-01-01')) AS ts,"
)

PARTS = """
ev AS (
  SELECT l_partkey AS id, 'part-' || l_partkey AS name,
         CASE l_linenumber WHEN 1 THEN 'PushEvent' WHEN 2 THEN 'WatchEvent' WHEN 3 THEN 'IssuesEvent'
              WHEN 4 THEN CASE WHEN l_quantity % 5 = 0 THEN 'PullRequestReviewEvent' ELSE 'PullRequestEvent' END WHEN 5 THEN 'IssueCommentEvent' WHEN 6 THEN 'ForkEvent'
              WHEN 7 THEN 'ReleaseEvent' END AS typ,
         o_custkey AS actor, l_shipdate AS t,
         CASE l_returnflag WHEN 'A' THEN 'opened' WHEN 'R' THEN 'closed' WHEN 'N' THEN 'other' END AS act,
         CAST(l_quantity AS BIGINT) AS sz
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

# one cohort row per entity, with the attributes of its first event
PART_COHORT = """
born AS (SELECT id, min(t) AS t0 FROM ev GROUP BY id),
coh AS (
  SELECT b.id, any_value(e.name) AS name, any_value(p_brand) AS lang,
         any_value(CASE WHEN p_type <> 'ECONOMY' THEN p_name END) AS descr, b.t0,
         min(e.actor) AS actor, 'customer-' || min(e.actor) AS login
  FROM born b JOIN ev e ON e.id = b.id AND e.t = b.t0 JOIN part ON p_partkey = b.id
  GROUP BY b.id, b.t0
)"""

USER_COHORT_FIRST = """
coh AS (
  SELECT id, name, lang, descr, t AS t0, actor, login FROM ev WHERE typ = 'CreateEvent'
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY t, name, lang, descr, actor, login) = 1
)"""

USER_COHORT_ALL = """
coh AS (
  SELECT id, name, lang, descr, min(t) AS t0, actor, login FROM ev WHERE typ = 'CreateEvent'
  GROUP BY id, name, lang, descr, actor, login
)"""


def cnt(test: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {test}) AS {name}"


def actors(test: str, name: str) -> str:
    return f"count(DISTINCT CASE WHEN {test} THEN actor END) AS {name}"


def dataset(events: str, cohort: str, w: dict, when: str = "TRUE") -> str:
    """CTEs up to ``ds``, the 40-column dataset."""
    early = f"d <= {w['early']}"
    late = f"d >= {w['late']}"
    bins = w["bins"]
    early_metrics = ",\n    ".join(
        [
            cnt(f"typ = 'PushEvent' AND {early}", "push_events_30d"),
            f"CAST(sum(CASE WHEN typ = 'PushEvent' AND {early} THEN coalesce(sz, 0) ELSE 0 END) AS BIGINT) AS total_commits_30d",
            cnt(f"typ = 'IssuesEvent' AND {early}", "issue_events_30d"),
            cnt(f"typ = 'IssuesEvent' AND act = 'opened' AND {early}", "issues_opened_30d"),
            cnt(f"typ = 'IssuesEvent' AND act = 'closed' AND {early}", "issues_closed_30d"),
            cnt(f"typ = 'IssueCommentEvent' AND {early}", "issue_comments_30d"),
            cnt(f"typ = 'PullRequestEvent' AND {early}", "pr_events_30d"),
            cnt(f"typ = 'PullRequestEvent' AND act = 'opened' AND {early}", "prs_opened_30d"),
            cnt(f"typ = 'PullRequestEvent' AND act = 'closed' AND {early}", "prs_closed_30d"),
            cnt(f"typ = 'PullRequestReviewEvent' AND {early}", "pr_reviews_30d"),
            cnt(f"typ = 'WatchEvent' AND {early}", "stars_30d"),
            cnt(f"typ = 'ForkEvent' AND {early}", "forks_30d"),
            actors(early, "unique_contributors_30d"),
            actors(f"typ = 'PushEvent' AND {early}", "unique_committers_30d"),
            *[
                cnt(f"d BETWEEN {lo} AND {hi}", f"events_week_{i + 1}")
                for i, (lo, hi) in enumerate(bins)
            ],
            cnt(early, "total_events_30d"),
        ]
    )
    outcome_metrics = ",\n    ".join(
        [
            cnt("typ = 'WatchEvent'", "total_stars_6m"),
            cnt("typ = 'ForkEvent'", "total_forks_6m"),
            "count(DISTINCT actor) AS total_contributors_6m",
            actors("typ = 'PushEvent'", "total_committers_6m"),
            cnt(f"typ = 'PushEvent' AND {late}", "pushes_months_4_to_6"),
            cnt(f"typ = 'IssuesEvent' AND {late}", "issues_months_4_to_6"),
            cnt(f"typ = 'PullRequestEvent' AND {late}", "prs_months_4_to_6"),
            actors(late, "contributors_months_4_to_6"),
            cnt("typ = 'ReleaseEvent'", "total_releases_6m"),
            "count(*) AS total_events_6m",
        ]
    )
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in EARLY_COLUMNS + OUTCOME_COLUMNS)
    return f"""{events}, {cohort}, att AS (
  SELECT e.id, e.typ, e.act, e.actor, e.sz, date_sub('day', c.t0, e.t) AS d
  FROM ev e JOIN coh c ON e.id = c.id WHERE date_sub('day', c.t0, e.t) BETWEEN 0 AND {w['horizon']} AND {when}
), em AS (
  SELECT id, {early_metrics} FROM att GROUP BY id
), om AS (
  SELECT id, {outcome_metrics} FROM att GROUP BY id
), full_rows AS (
  SELECT c.id AS repo_id, c.name AS repo_name, c.lang AS primary_language, c.descr AS description,
         c.t0 AS repo_created_at, c.actor AS creator_id, c.login AS creator_login, {zero}
  FROM coh c LEFT JOIN em USING (id) LEFT JOIN om USING (id)
), ds AS (
  SELECT *, CASE WHEN total_stars_6m >= {w['starred']} THEN 1 ELSE 0 END AS is_starred_project,
         CASE WHEN total_contributors_6m >= {w['community']} THEN 1 ELSE 0 END AS has_community,
         CASE WHEN pushes_months_4_to_6 > 0 THEN 1 ELSE 0 END AS is_actively_maintained,
         CASE WHEN total_stars_6m >= {w['stars']} OR (total_contributors_6m >= {w['people']}
                   AND pushes_months_4_to_6 > 0) THEN 1 ELSE 0 END AS is_successful_project
  FROM full_rows WHERE total_events_30d >= {w['floor']}
)"""


PART_WINDOWS = dict(
    early=300, late=901, horizon=1800, floor=3, bins=((0, 70), (71, 140), (141, 210), (211, 300)),
    starred=6, community=20, stars=7, people=24,
)
USER_WINDOWS = dict(
    early=7, late=15, horizon=28, floor=12, bins=((0, 1), (2, 3), (4, 5), (6, 7)),
    starred=20, community=40, stars=15, people=44,
)
ARCHIVE_WINDOWS = dict(
    early=30, late=91, horizon=180, floor=3, bins=((0, 7), (8, 14), (15, 21), (22, 30)),
    starred=100, community=5, stars=50, people=3,
)
DS = "WITH " + dataset(PARTS, PART_COHORT, PART_WINDOWS)
SCORED = DS + f""", sc AS (
  SELECT repo_id, {TARGET} AS y, round(1 / (1 + exp(-(0.55::DOUBLE * stars_30d + 0.12::DOUBLE * total_events_30d
         + 0.05::DOUBLE * unique_contributors_30d - 2.1::DOUBLE))), 4) AS score
  FROM ds
)"""
CELLS = SCORED + """, cm AS (
  SELECT count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp,
         count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp
  FROM sc
)"""
GROUPED = DS + f""", gl AS (
  SELECT *, CASE WHEN description IS NOT NULL THEN 1 ELSE 0 END AS has_description,
         CASE WHEN count(*) OVER (PARTITION BY coalesce(primary_language, 'Unknown')) < {RARE_BELOW} THEN 'Other'
              ELSE coalesce(primary_language, 'Unknown') END AS language_grouped
  FROM ds
)"""
CLASS = f"CASE {TARGET} WHEN 0 THEN 'Not Successful' WHEN 1 THEN 'Successful' END"

HALF_YEAR_EVENTS = "CAST(e.t AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-09-30'"
QUARTER_COHORT = USER_COHORT_FIRST.replace(
    "typ = 'CreateEvent'", "typ = 'CreateEvent' AND CAST(t AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-03-31'"
)
USER_PAIR_COHORT = """
coh AS (SELECT id, name, min(t) AS t0 FROM ev WHERE typ = 'CreateEvent' GROUP BY id, name)"""


def user_report(lo: int, hi: int, columns: str, floor: int | None = None) -> str:
    having = f"HAVING count(*) >= {floor}" if floor else ""
    return f"""WITH {USERS}, {USER_PAIR_COHORT}, att AS (
  SELECT e.*, c.t0, date_sub('day', c.t0, e.t) AS d FROM ev e JOIN coh c ON e.id = c.id
  WHERE date_sub('day', c.t0, e.t) BETWEEN {lo} AND {hi}
)
SELECT id AS repo_id, name AS repo_name, t0 AS repo_created_at, {columns}
FROM att GROUP BY id, name, t0 {having}"""


EARLY_REPORT = ", ".join(
    [
        cnt("typ = 'PushEvent'", "push_events_30d"),
        "CAST(sum(CASE WHEN typ = 'PushEvent' THEN sz ELSE 0 END) AS BIGINT) AS total_commits_30d",
        cnt("typ = 'IssuesEvent'", "issue_events_30d"),
        cnt("typ = 'IssuesEvent' AND act = 'opened'", "issues_opened_30d"),
        cnt("typ = 'IssuesEvent' AND act = 'closed'", "issues_closed_30d"),
        cnt("typ = 'IssueCommentEvent'", "issue_comments_30d"),
        cnt("typ = 'PullRequestEvent'", "pr_events_30d"),
        cnt("typ = 'PullRequestEvent' AND act = 'opened'", "prs_opened_30d"),
        cnt("typ = 'PullRequestEvent' AND act = 'closed'", "prs_closed_30d"),
        cnt("typ = 'PullRequestReviewEvent'", "pr_reviews_30d"),
        cnt("typ = 'PullRequestReviewCommentEvent'", "pr_review_comments_30d"),
        cnt("typ = 'WatchEvent'", "stars_30d"),
        cnt("typ = 'ForkEvent'", "forks_30d"),
        "count(DISTINCT actor) AS unique_contributors_30d",
        actors("typ = 'PushEvent'", "unique_committers_30d"),
        actors("typ IN ('IssuesEvent', 'IssueCommentEvent')", "unique_issue_participants_30d"),
        "count(*) AS total_events_30d",
    ]
)


def early_report(bins) -> str:
    names = ("events_first_week", "events_second_week", "events_third_week", "events_fourth_week")
    return ", ".join([EARLY_REPORT, *[cnt(f"d BETWEEN {lo} AND {hi}", n) for (lo, hi), n in zip(bins, names)]])



SUSTAINED_REPORT = ", ".join(
    [
        cnt("typ = 'WatchEvent'", "stars_months_4_to_6"),
        cnt("typ = 'ForkEvent'", "forks_months_4_to_6"),
        cnt("typ = 'PushEvent'", "push_events_months_4_to_6"),
        "CAST(sum(CASE WHEN typ = 'PushEvent' THEN sz ELSE 0 END) AS BIGINT) AS commits_months_4_to_6",
        cnt("typ = 'IssuesEvent'", "issue_events_months_4_to_6"),
        cnt("typ = 'PullRequestEvent'", "pr_events_months_4_to_6"),
        cnt("typ = 'PullRequestEvent' AND act = 'opened'", "external_prs_months_4_to_6"),
        "count(DISTINCT actor) AS unique_contributors_months_4_to_6",
        actors("typ = 'PushEvent'", "unique_committers_months_4_to_6"),
        "count(*) AS total_events_months_4_to_6",
        cnt("typ = 'ReleaseEvent'", "releases_months_4_to_6"),
    ]
)
def cumulative(horizon: int) -> str:
    return f"""WITH {USERS}, {USER_PAIR_COHORT}
SELECT c.id AS repo_id, c.name AS repo_name, c.t0 AS repo_created_at,
       count(*) FILTER (WHERE e.typ = 'WatchEvent') AS total_stars_6_months,
       count(*) FILTER (WHERE e.typ = 'ForkEvent') AS total_forks_6_months,
       count(DISTINCT CASE WHEN e.typ = 'PushEvent' THEN e.actor END) AS total_unique_committers_6_months,
       count(DISTINCT e.actor) AS total_unique_contributors_6_months
FROM coh c LEFT JOIN ev e ON e.id = c.id AND date_sub('day', c.t0, e.t) BETWEEN 0 AND {horizon}
GROUP BY c.id, c.name, c.t0"""


def union(template: str, names) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in names)


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def pearson(a: str, b: str) -> str:
    value = f"corr({a}, {b})"
    return f"CASE WHEN isnan({value}) THEN NULL ELSE round({value}, 6) END"


def dataset_columns(sql: str) -> str:
    columns = METADATA_COLUMNS + EARLY_COLUMNS + OUTCOME_COLUMNS + LABEL_COLUMNS
    return f"{sql} SELECT {', '.join(columns)} FROM ds"


def part_metrics(names) -> str:
    source = "em" if names is EARLY_COLUMNS else "om"
    return f"{DS} SELECT id AS repo_id, {', '.join(names)} FROM {source}"


def schema_rows() -> str:
    kinds = {
        "repo_name": "string",
        "primary_language": "string",
        "description": "string",
        "repo_created_at": "timestamp",
        "creator_login": "string",
    }
    columns = METADATA_COLUMNS + EARLY_COLUMNS + OUTCOME_COLUMNS + LABEL_COLUMNS
    rows = [
        f"SELECT {i + 1} AS position, '{c}' AS column_name, "
        f"'{kinds.get(c, 'int' if c in LABEL_COLUMNS else 'bigint')}' AS data_type, "
        f"count({c}) AS non_null, count(*) AS n_rows, {len(columns)} AS n_columns FROM ds"
        for i, c in enumerate(columns)
    ]
    return f"{DS} {' UNION ALL '.join(rows)}"


def quotient(a: str, b: str, other: str = "0") -> str:
    return f"round(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE {other} END, 6)"


ENGINEERED = {
    "commits_per_push": quotient("total_commits_30d", "push_events_30d"),
    "events_per_contributor": quotient("total_events_30d", "unique_contributors_30d"),
    "issue_close_rate": quotient("issues_closed_30d", "issues_opened_30d"),
    "pr_close_rate": quotient("prs_closed_30d", "prs_opened_30d"),
    "has_external_interest": "CAST(stars_30d + forks_30d > 0 AS INT)",
    "has_issues": "CAST(issues_opened_30d > 0 AS INT)",
    "has_prs": "CAST(prs_opened_30d > 0 AS INT)",
    "has_multiple_contributors": "CAST(unique_contributors_30d > 1 AS INT)",
    "week1_to_week2_ratio": quotient("events_week_2", "events_week_1"),
    "week3_to_week4_ratio": quotient("events_week_4", "events_week_3"),
    "activity_sustainability": quotient(
        "(events_week_3 + events_week_4)", "(events_week_1 + events_week_2)"
    ),
    "committer_ratio": quotient("unique_committers_30d", "unique_contributors_30d"),
    "comments_per_issue": quotient("issue_comments_30d", "issue_events_30d"),
    "star_fork_ratio": quotient("stars_30d", "forks_30d", "stars_30d"),
}
FLAGS = ("has_external_interest", "has_issues", "has_prs", "has_multiple_contributors")


def exact(name: str) -> str:
    """An early or engineered column without rounding."""
    if name in EARLY_COLUMNS:
        return f"CAST({name} AS DOUBLE)"
    return ENGINEERED[name].removeprefix("round(").removesuffix(", 6)")


def scaled() -> str:
    names = EARLY_COLUMNS + tuple(c for c in ENGINEERED if c not in FLAGS)
    values = ", ".join(f"{exact(c)} AS {c}" for c in names)
    columns = ", ".join(
        f"round(({c} - avg({c}) FILTER (WHERE is_test = 0) OVER ()) "
        f"/ coalesce(nullif(stddev_pop({c}) FILTER (WHERE is_test = 0) OVER (), 0), 1), 6) AS {c}"
        for c in names
    )
    return f"""{DS}, sp AS ({SPLIT}), fx AS (SELECT repo_id, is_test, {values} FROM ds JOIN sp USING (repo_id))
        SELECT repo_id, {columns} FROM fx"""


SHUFFLED = DS + f""", rk AS (
  SELECT repo_id, {TARGET}, row_number() OVER (PARTITION BY {TARGET} ORDER BY md5('42|' || repo_id), repo_id) AS rn
  FROM ds
)"""
SPLIT = SHUFFLED + f""", quota AS (
  SELECT {TARGET}, n, all_n, floor(n * tr / all_n) AS base, n * tr / all_n - floor(n * tr / all_n) AS frac, tr
  FROM (SELECT *, all_n - ceil(all_n * 0.2::DOUBLE) AS tr
        FROM (SELECT {TARGET}, count(*) AS n, sum(count(*)) OVER () AS all_n FROM ds GROUP BY {TARGET}))
), seats AS (
  SELECT {TARGET}, n - base - CASE WHEN row_number() OVER (ORDER BY frac DESC, {TARGET})
         <= tr - sum(base) OVER () THEN 1 ELSE 0 END AS test_n FROM quota
)
SELECT repo_id, {TARGET}, CASE WHEN rn <= test_n THEN 1 ELSE 0 END AS is_test FROM rk JOIN seats USING ({TARGET})"""

LONG_BOX = union(
    f"SELECT {CLASS} AS class, '{{c}}' AS feature, CAST({{c}} AS DOUBLE) AS v FROM ds", BOX_COLUMNS
)
BOX = f"""{DS}, lg AS ({LONG_BOX}), q AS (
  SELECT class, feature, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75
  FROM lg GROUP BY class, feature
), f AS (
  SELECT lg.*, q25, q50, q75, v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside
  FROM lg JOIN q USING (class, feature)
)
SELECT class, feature, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75,
       min(v) FILTER (WHERE inside) AS whisker_low, max(v) FILTER (WHERE inside) AS whisker_high,
       count(*) FILTER (WHERE NOT inside) AS outliers, count(*) AS n
FROM f GROUP BY class, feature, q25, q50, q75"""


def bins_of(source: str, keys: str) -> str:
    """Histogram over 50 explicit bin edges of a relation (keys.., v)."""
    return f"""rg AS (
  SELECT {keys}, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
         CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM {source} GROUP BY {keys}
), ed AS (
  SELECT {keys}, CAST(b AS INT) AS bin, lo + b * ((hi - lo) / 50) AS bin_from, lo + (b + 1) * ((hi - lo) / 50) AS bin_to
  FROM rg, range(50) AS g(b)
)
SELECT {keys}, bin, round(bin_from, 6) AS bin_from, round(bin_to, 6) AS bin_to, count(*) AS n
FROM {source} JOIN ed USING ({keys})
WHERE v >= bin_from AND (v < bin_to OR bin = 49) GROUP BY ALL"""


LONG_HISTOGRAM = union(
    "SELECT '{c}' AS feature, CASE WHEN {c} = 0 THEN 0.1::DOUBLE ELSE CAST({c} AS DOUBLE) END AS v FROM ds",
    HISTOGRAM_COLUMNS,
)

CURVE = SCORED + """, cv AS (
  SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM sc GROUP BY score
), cu AS (
  SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
         sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM cv
)"""


def safe(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


REPORT = CELLS + f""", pr AS (
  SELECT 'Not Successful' AS label, {safe('tn', 'tn + fn')} AS p, {safe('tn', 'tn + fp')} AS r,
         {safe('2 * tn', '2 * tn + fn + fp')} AS f, tn + fp AS s FROM cm
  UNION ALL
  SELECT 'Successful', {safe('tp', 'tp + fp')}, {safe('tp', 'tp + fn')}, {safe('2 * tp', '2 * tp + fp + fn')}, tp + fn FROM cm
)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, s AS support FROM pr
UNION ALL SELECT 'accuracy', NULL, NULL, {r6(safe('tp + tn', 'tp + tn + fp + fn'), 'f')}, tn + fp + fn + tp FROM cm
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM pr
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6),
                 round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM pr"""

CANONICAL = f"""WITH {USERS} SELECT id AS repo_id, name AS repo_name, typ AS event_type, actor AS actor_id,
        login AS actor_login, t AS event_time, CASE WHEN typ = 'CreateEvent' THEN 'repository' END AS ref_type,
        act AS action, sz AS size, CAST(NULL AS VARCHAR) AS nested FROM ev"""
TEST_ROWS = f"SELECT count(*) FROM ({SPLIT}) WHERE is_test = 1"

ORACLE: dict[str, str] = {
    "canonical": CANONICAL,
    "canonical_kinds": f"{CANONICAL} WHERE typ IN ('PushEvent', 'WatchEvent', 'IssuesEvent', 'CreateEvent')",
    "day_shards": f"{CANONICAL} WHERE CAST(t AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'",
    "csv_round_trip": f"""{DS} SELECT * REPLACE (CASE repo_id % 5 WHEN 0 THEN NULL
        WHEN 1 THEN description || chr(10) || '"quoted", twice: ""' || repo_id || chr(10) || chr(10) || ' '
        ELSE description END AS description) FROM ds""",
    "csv_refused": f"""{DS} SELECT 'stars_30d' AS column_name, 'n' || (repo_id % 3) AS value, count(*) AS n FROM ds
        WHERE repo_id % 4 = 0 GROUP BY ALL
        UNION ALL SELECT 'forks_30d', '1.5', count(*) FROM ds WHERE repo_id % 7 = 0 HAVING count(*) > 0""",
    "new_entities": f"""WITH {USERS} SELECT DISTINCT id AS repo_id, name AS repo_name, lang AS primary_language,
        descr AS description, lic AS license, fork AS is_fork, t AS repo_created_at, actor AS creator_id,
        login AS creator_login FROM ev WHERE typ = 'CreateEvent' AND fork IS DISTINCT FROM TRUE""",
    "cohort_attrs": f"""WITH {USERS}, {USER_COHORT_ALL} SELECT id AS repo_id, name AS repo_name, lang AS language,
        descr AS description, actor AS actor_id, login AS actor_login, t0 AS created_at FROM coh""",
    "cohort_first_event": f"""WITH {PARTS}, {PART_COHORT} SELECT id AS repo_id, name AS repo_name, lang AS language,
        descr AS description, actor AS actor_id, login AS actor_login, t0 AS created_at FROM coh""",
    "first_seen": f"""WITH {USERS}, {USER_PAIR_COHORT}
        SELECT id AS repo_id, name AS repo_name, t0 AS created_at FROM coh""",
    "early_metrics": user_report(0, 7, early_report(USER_WINDOWS["bins"]), 12),
    "sustained_metrics": user_report(14, 28, SUSTAINED_REPORT),
    "cumulative_totals": cumulative(28),
    "cumulative_totals_shuffled": cumulative(28),
    "cumulative_totals_salted": cumulative(28),
    "early_metrics_q5": part_metrics(EARLY_COLUMNS),
    "outcome_metrics": part_metrics(OUTCOME_COLUMNS),
    "combined_dataset_parts": dataset_columns(DS),
    "combined_dataset_users": dataset_columns("WITH " + dataset(USERS, USER_COHORT_FIRST, USER_WINDOWS)),
    "combined_fanout": dataset_columns("WITH " + dataset(USERS, USER_COHORT_ALL, USER_WINDOWS)),
    "archive_new_entities": f"""WITH {USERS} SELECT DISTINCT id AS repo_id, name AS repo_name,
        lang AS primary_language, descr AS description, lic AS license, fork AS is_fork, t AS repo_created_at,
        actor AS creator_id, login AS creator_login FROM ev WHERE typ = 'CreateEvent' AND NOT coalesce(fork, FALSE)
        AND CAST(t AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-03-31'""",
    "archive_early_metrics": user_report(0, 30, early_report(ARCHIVE_WINDOWS["bins"]), 5),
    "archive_cumulative_totals": cumulative(180),
    "archive_combined_dataset": dataset_columns("WITH " + dataset(USERS, USER_COHORT_FIRST, ARCHIVE_WINDOWS)),
    "archive_combined_faithful": dataset_columns("WITH " + dataset(USERS, USER_COHORT_ALL, ARCHIVE_WINDOWS)),
    "archive_half_year_dataset": dataset_columns("WITH " + dataset(HALF_YEAR, QUARTER_COHORT, ARCHIVE_WINDOWS, HALF_YEAR_EVENTS)),
    "archive_sustained_metrics": f"""WITH {HALF_YEAR}, coh AS (
          SELECT id, name, min(t) AS t0 FROM ev WHERE typ = 'CreateEvent'
          AND CAST(t AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-03-31' GROUP BY id, name
        ), att AS (
          SELECT e.*, c.t0 FROM ev e JOIN coh c ON e.id = c.id
          WHERE date_sub('day', c.t0, e.t) BETWEEN 90 AND 180
          AND CAST(e.t AS DATE) BETWEEN DATE '2024-04-01' AND DATE '2024-09-30'
        ) SELECT id AS repo_id, name AS repo_name, t0 AS repo_created_at, {SUSTAINED_REPORT}
        FROM att GROUP BY id, name, t0""",
    "first_rows": dataset_columns(DS) + " ORDER BY total_stars_6m DESC NULLS LAST, repo_id LIMIT 100",
    "dataset_schema": schema_rows(),
    "value_counts": f"""{DS} SELECT {TARGET} AS value, count(*) AS n,
        round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM ds GROUP BY {TARGET}""",
    "class_ratio": f"""{DS}, c AS (SELECT count(*) FILTER (WHERE {TARGET} = 0) AS negatives,
        count(*) FILTER (WHERE {TARGET} = 1) AS positives FROM ds)
        SELECT *, round(negatives / positives::DOUBLE, 6) AS ratio FROM c""",
    "top_languages": f"""{DS} SELECT primary_language, count(*) AS n FROM ds WHERE primary_language IS NOT NULL
        GROUP BY primary_language ORDER BY n DESC, primary_language LIMIT 15""",
    "success_by_language": f"""{DS}, tk AS (SELECT primary_language FROM ds WHERE primary_language IS NOT NULL
        GROUP BY primary_language ORDER BY count(*) DESC, primary_language LIMIT 10)
        SELECT primary_language, count(*) AS total_repos, CAST(sum({TARGET}) AS BIGINT) AS successful,
        round(100.0::DOUBLE * sum({TARGET}) / count(*), 2) AS success_rate
        FROM ds WHERE primary_language IN (SELECT primary_language FROM tk) GROUP BY primary_language""",
    "success_by_activity": f"""{DS}, lv AS (SELECT *, CASE WHEN total_events_30d <= 0 THEN NULL
        WHEN total_events_30d <= 3 THEN 'Very Low (1-10)' WHEN total_events_30d <= 5 THEN 'Low (11-50)'
        WHEN total_events_30d <= 8 THEN 'Medium (51-100)' WHEN total_events_30d <= 12 THEN 'High (101-500)'
        ELSE 'Very High (500+)' END AS activity_level FROM ds)
        SELECT activity_level, count(*) AS total_repos, CAST(sum({TARGET}) AS BIGINT) AS successful,
        round(100.0::DOUBLE * sum({TARGET}) / count(*), 2) AS success_rate
        FROM lv WHERE activity_level IS NOT NULL GROUP BY activity_level""",
    "weekly_trend": f"{DS} "
    + union(
        f"SELECT {CLASS} AS class, '{{c}}' AS week, round(avg({{c}}), 6) AS mean_events FROM ds GROUP BY 1",
        WEEK_COLUMNS,
    ),
    "class_comparison": f"{DS} "
    + union(
        f"""SELECT '{{c}}' AS feature, round(avg({{c}}) FILTER (WHERE {TARGET} = 1), 6) AS successful_mean,
        round(avg({{c}}) FILTER (WHERE {TARGET} = 0), 6) AS unsuccessful_mean,
        round(avg({{c}}) FILTER (WHERE {TARGET} = 1) - avg({{c}}) FILTER (WHERE {TARGET} = 0), 6) AS difference FROM ds""",
        EARLY_COLUMNS,
    ),
    "successful_rows": f"{DS} SELECT repo_id, {', '.join(WEEK_COLUMNS)} FROM ds WHERE {TARGET} = 1",
    "group_insights": f"""{GROUPED} SELECT language_grouped, count(*) AS total_projects,
        round(avg({TARGET}), 3) AS success_rate, round(avg(stars_30d), 3) AS avg_stars_30d,
        round(avg(unique_contributors_30d), 3) AS avg_contributors_30d,
        round(avg(total_commits_30d), 3) AS avg_commits_30d
        FROM gl GROUP BY language_grouped HAVING count(*) >= {RARE_BELOW}
        ORDER BY success_rate DESC, language_grouped LIMIT 10""",
    "missing_report": f"""{DS}, m AS ("""
    + union(
        "SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, count(*) AS n FROM ds",
        METADATA_COLUMNS + EARLY_COLUMNS + OUTCOME_COLUMNS + LABEL_COLUMNS,
    )
    + ") SELECT column_name, missing, round(100.0::DOUBLE * missing / n, 2) AS missing_pct FROM m WHERE missing > 0",
    "coverage": f"{DS} "
    + union(
        """SELECT count(*) AS n_rows, '{c}' AS column_name, count({c}) AS known,
        round(100.0::DOUBLE * count({c}) / count(*), 2) AS known_pct FROM ds""",
        ("primary_language", "description"),
    ),
    "describe_numeric": f"{DS} "
    + union(
        """SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
        round(quantile_cont({c}, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM ds""",
        EARLY_COLUMNS + OUTCOME_COLUMNS,
    ),
    "corr_target": f"{DS} "
    + union(
        f"SELECT '{{c}}' AS feature, {pearson('{c}', TARGET)} AS correlation FROM ds", (*EARLY_COLUMNS, TARGET)
    ),
    "corr_matrix": f"{DS} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {pearson(a, b)} AS correlation FROM ds"
        for i, a in enumerate(MATRIX_COLUMNS)
        for b in MATRIX_COLUMNS[: i + 1]
    ),
    "histogram": f"{DS}, lg AS ({LONG_HISTOGRAM}), {bins_of('lg', 'feature')}",
    "box_stats": BOX,
    "category_counts": f"""{GROUPED} SELECT count(DISTINCT language_grouped) AS categories,
        count(DISTINCT primary_language) FILTER (WHERE language_grouped = 'Other') AS rare_categories FROM gl""",
    "grouped_language": f"{GROUPED} SELECT repo_id, has_description, language_grouped FROM gl",
    "one_hot": f"""{GROUPED} SELECT 'lang_' || language_grouped AS feature, count(*) AS ones,
        (SELECT count(*) FROM gl) AS n_rows FROM gl GROUP BY language_grouped""",
    "engineered": f"{DS} SELECT repo_id, " + ", ".join(f"{e} AS {c}" for c, e in ENGINEERED.items()) + " FROM ds",
    "scaled": scaled(),
    "split": SPLIT,
    "folds": f"{SHUFFLED} SELECT repo_id, {TARGET}, CAST((rn - 1) % 5 AS INT) AS fold FROM rk",
    "sample": f"{DS} SELECT repo_id FROM ds ORDER BY md5('42|' || repo_id), repo_id LIMIT 100",
    "class_weights": f"""{DS} SELECT {TARGET} AS class, count(*) AS n,
        round(sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE), 6) AS weight FROM ds GROUP BY {TARGET}""",
    # above a ratio of 1.5 the smaller class is filled up to the larger one
    "smote": f"""{DS}, c AS (SELECT {TARGET} AS y, count(*) AS n, max(count(*)) OVER () AS top FROM ds GROUP BY {TARGET})
        SELECT y, CASE WHEN top > 1.5 * n THEN top ELSE n END AS n, CASE WHEN top > 1.5 * n THEN top - n ELSE 0 END AS made
        FROM c""",
    "comparison_recomputed": f"SELECT 6::BIGINT AS models, ({TEST_ROWS}) AS test_rows, 0::BIGINT AS different",
    "score_new_checked": f"{DS} SELECT count(*) AS n, 0::BIGINT AS outside, 0::BIGINT AS mislabelled, 0::BIGINT AS changed FROM ds",
    "run_checked": f"{DS} SELECT 6 AS models, count(*) AS n, 0::BIGINT AS different FROM ds",
    "shapley_additive": f"SELECT ({TEST_ROWS}) AS n, 0::BIGINT AS off",
    "shapley_rows": f"SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS place, ({TEST_ROWS}) AS n, ({TEST_ROWS}) AS n_keys",
    "confusion": f"{CELLS} SELECT * FROM cm",
    "binary_metrics": f"""{CELLS} SELECT {r6(safe('tp + tn', 'tp + tn + fp + fn'), 'accuracy')},
        {r6(safe('tp', 'tp + fp'), 'precision')}, {r6(safe('tp', 'tp + fn'), 'recall')},
        {r6(safe('2 * tp', '2 * tp + fp + fn'), 'f1')} FROM cm""",
    "classification_report": REPORT,
    "roc_auc": f"""{CURVE} SELECT round(sum(pos * (n - fp + neg / 2::DOUBLE)) / (max(p)::DOUBLE * max(n)), 6) AS roc_auc
        FROM cu""",
    "roc_curve": f"""{CURVE} SELECT score AS threshold, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr
        FROM cu UNION ALL SELECT CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE""",
    "pr_curve": f"""{CURVE} SELECT score AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision,
        round(tp / p::DOUBLE, 6) AS recall FROM cu UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE""",
    "average_precision": f"""{CURVE} SELECT round(sum(pos / p::DOUBLE * tp / (tp + fp)::DOUBLE), 6) AS average_precision,
        round(max(p) / (max(p) + max(n))::DOUBLE, 6) AS prevalence FROM cu""",
    "score_histogram": f"{SCORED}, lg AS (SELECT y, score AS v FROM sc), {bins_of('lg', 'y')}",
    "threshold_table": f"{SCORED} "
    + " UNION ALL ".join(
        f"""SELECT {t}::DOUBLE AS threshold, count(*) FILTER (WHERE score >= {t}) AS flagged,
        {r6(safe(f'100 * count(*) FILTER (WHERE score >= {t})', 'count(*)'), 'pct_of_set')},
        {r6(safe(f'count(*) FILTER (WHERE score >= {t} AND y = 1)', f'count(*) FILTER (WHERE score >= {t})'), 'precision')},
        {r6(safe(f'count(*) FILTER (WHERE score >= {t} AND y = 1)', 'count(*) FILTER (WHERE y = 1)'), 'recall')} FROM sc"""
        for t in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
    ),
}
