"""Host events: routing, validation and feedback from comments and reactions.

All functions are projections and filters, so they take streams and tables alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsieve.functions.text import pr_key
from revsieve.operators.feedback import from_replies
from revsieve.sources.readers import parse_payload

REVIEWED_ACTIONS = ("opened", "synchronize", "reopened")  # Fixed values.
UNKNOWN = "unknown"


def _owner(p: Column) -> Column:
    owner = p["repository"]["owner"]
    return F.coalesce(F.nullif(owner["login"], F.lit("")), F.nullif(owner["name"], F.lit("")))


def route(events: DataFrame) -> DataFrame:
    """Events (event_type, payload) with status, reason and the pull request they name."""
    p = F.col("_p")
    action, number = p["action"], p["pull_request"]["number"]
    name = F.nullif(p["repository"]["name"], F.lit(""))
    complete = F.col("repo_owner").isNotNull() & F.col("repo_name").isNotNull() & (
        F.coalesce(F.col("pr_number"), F.lit(0)) != 0
    )
    is_pr = F.col("event_type") == "pull_request"
    wanted = F.coalesce(action.isin(*REVIEWED_ACTIONS), F.lit(False))
    # only a payload that did not parse cleanly is parsed again, since a value of the wrong type is not broken JSON
    broken = F.when(p.isNull() | p["_broken"].isNotNull(), F.try_parse_json("payload").isNull()).otherwise(False)
    status = (
        F.when(F.col("event_type").isNull(), "error")
        .when(broken, "error")
        .when(F.col("event_type") == "ping", "pong")
        .when(~is_pr, "ignored")
        .when(~wanted, "skipped")
        .when(~complete, "error")
        .otherwise("ok")
    )
    reason = (
        F.when(F.col("event_type").isNull(), "Missing event type")
        .when(broken, "Invalid JSON")
        .when(is_pr & ~wanted, F.concat(
            F.lit("Action '"), F.coalesce(action, F.lit("None")), F.lit("' not processed")))
        .when(is_pr & ~complete, "Missing required PR information")
    )
    named = events.withColumn("_p", parse_payload(F.col("payload"), "_broken")).withColumns({
        "action": action,
        "repo_owner": _owner(p),
        "repo_name": name,
        "pr_number": number,
    })
    return named.withColumns({
        "status": status,
        "reason": reason,
        "pr_id": F.when(complete, pr_key(F.col("repo_owner"), F.col("repo_name"), F.col("pr_number"))),
    }).drop("_p")


def accepted(events: DataFrame) -> DataFrame:
    """Pull requests to review now."""
    return route(events).filter(F.col("status") == "ok")


def comment_feedback(events: DataFrame) -> DataFrame:
    """Replies on pull requests as feedback; what the event does not say is unknown."""
    p = F.col("_p")
    replies = (
        events.filter(F.col("event_type") == "issue_comment")
        .withColumn("_p", parse_payload(F.col("payload")))
        .filter(F.coalesce(p["issue"]["html_url"], F.lit("")).contains("pull_request"))
        .withColumns({
            "repo_owner": _owner(p),
            "repo_name": p["repository"]["name"],
            "pr_number": p["issue"]["number"],
            "reply_text": F.coalesce(p["comment"]["body"], F.lit("")),
            "reviewer": F.coalesce(p["comment"]["user"]["login"], F.lit(UNKNOWN)),
            "analysis_result_id": F.lit(UNKNOWN),
            "category": F.lit(UNKNOWN),
            "file_path": F.lit(UNKNOWN),
            "line_number": F.lit(0),
        })
        .withColumn("pr_id", pr_key(F.col("repo_owner"), F.col("repo_name"), F.col("pr_number")))
        .drop("_p")
    )
    return from_replies(replies)
