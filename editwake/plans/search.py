"""Whole searches, from a question to a trend."""

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwake.functions.derive import period_key
from editwake.functions.predicates import all_grams, phrase, trend_predicate
from editwake.operators import hits as hit_ops
from editwake.operators import trends as trend_ops
from editwake.operators.templates import match_templates, template_intervals
from editwake.sources.query_files import REQUEST_DEFAULTS
from editwake.sources.revision_table import in_time


def search(
    revisions: DataFrame,
    predicate: Column,
    collapse_hits: str = "no",
    fields: Sequence[str] = (),
    max_revs: int | None = None,
) -> DataFrame:
    """Hits of a predicate: listed, counted, or collapsed by day or month.

    Without ``max_revs`` all hits count. Any other ``collapse_hits`` than
    ``day`` and ``month`` means a list, or a bare count without fields.
    """
    hits = revisions.where(predicate)
    if max_revs is not None:
        hits = hit_ops.limit_hits(hits, max_revs)
    if collapse_hits not in ("day", "month"):
        return hit_ops.ungrouped(hits, fields)
    if fields:
        return trend_ops.trend_with_fields(hits, collapse_hits, fields)
    return trend_ops.trend(hits, collapse_hits)


def answer(revisions: DataFrame, request: str, field: str = "added") -> DataFrame:
    """The response to a JSON request for a text, as one row of JSON.

    A quoted ``q`` is a phrase, else all its grams must occur; expressions with
    operators, fields or brackets are refused, as there is no parser. The hits
    are those within the request's cap: counted, listed with ``fields``, or
    either of it per period. The request is echoed with its defaults filled in.
    """
    asked = {**REQUEST_DEFAULTS, **json.loads(request)}
    fields = asked.get("fields") or []
    fields = [fields] if isinstance(fields, str) else fields
    asked["fields"], text, by = fields, asked["q"], asked["collapse_hits"]
    if len(text) > 1 and text[0] == text[-1] == '"':
        test = phrase(field, text[1:-1].replace('\\"', '"'))
    elif re.search(r'[:()\[\]{}"~^*?]|(^|\s)(AND|OR|NOT|[-+])', text):
        raise ValueError(f"not a plain text: {text}")
    else:
        test = all_grams(field, text)
    found = revisions.where(test)
    hits = hit_ops.limit_hits(found, int(asked["max_revs"]))
    beyond = hit_ops.skipped(found, int(asked["max_revs"]))
    named = list(dict.fromkeys(["rev_id", *fields]))
    values = hit_ops.select_fields(hits, named)
    entry = F.struct(*(fields or ["rev_id"]))
    if by in ("day", "month"):
        dated = hits.withColumn("period", period_key(F.col("timestamp"), by))
        rows = hit_ops.select_fields(dated, ["period", *named])
        # At most as many values as the request allows hits.
        listed = [F.array_sort(F.collect_list(entry)).alias("values")] if fields else []
        periods = rows.groupBy("period").agg(F.count("*").alias("hits"), *listed)
        columns = F.struct("period", "hits", *(["values"] if fields else []))
        shown = periods.agg(
            F.coalesce(F.sum("hits"), F.lit(0)).alias("hits_all"), F.array_sort(F.collect_list(columns)).alias("hits")
        )
    elif fields:
        shown = values.agg(F.count("*").alias("hits_all"), F.array_sort(F.collect_list(entry)).alias("hits"))
    else:
        shown = values.agg(F.count("*").alias("hits_all"), F.count("*").alias("hits"))
    response = F.struct(
        "hits_all",
        F.lit(text).alias("parsed_query"),
        F.col("skipped").alias("debug_unchecked"),
        "hits",
        F.from_json(
            F.lit(json.dumps(asked)),
            "q string, collapse_hits string, max_revs int, version string, format string, fields array<string>",
        ).alias("query"),
    )
    # Both sides are one row.
    return shown.crossJoin(beyond).select(F.to_json(response).alias("response"))


def phrase_trend(
    revisions: DataFrame,
    query: str | Column,
    start: str | None = None,
    end: str | None = None,
    namespace: int | None = None,
    daily: bool = False,
    with_ids: bool = False,
    field: str = "added",
    max_revs: int | None = None,
) -> DataFrame:
    """The trend of a phrase, or of any predicate, over time.

    Of a stored table only the id ranges that hold revisions of the time are read.
    """
    return search(
        in_time(revisions, start, end),
        trend_predicate(query, start, end, namespace, field),
        "day" if daily else "month",
        ("rev_id",) if with_ids else (),
        max_revs,
    )


def template_trend(
    revisions: DataFrame,
    history: DataFrame,
    now: Column,
    namespace: int | None = None,
    daily: bool = False,
    distinct: bool = False,
    allow_empty: bool = False,
    max_revs: int | None = None,
) -> DataFrame:
    """The trend of substituted templates, all titles in one job.

    Counts add up over the versions of a template, or with ``distinct`` each
    revision counts once per period. ``max_revs`` caps the hits of each
    version; by default all count.
    """
    wanted = revisions if namespace is None else revisions.where(revisions.namespace == namespace)
    matches = match_templates(wanted, template_intervals(history, now), allow_empty)
    if max_revs is not None:
        matches = hit_ops.cap_hits(matches, max_revs, ["title", "valid_from", "valid_to"])
    by = "day" if daily else "month"
    if distinct:
        return trend_ops.combine_trends_distinct(matches, by)
    return trend_ops.trend(matches, by)
