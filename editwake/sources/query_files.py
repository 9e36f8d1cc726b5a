"""Queries as data: query files and JSON requests."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from editwake.functions.predicates import names_real_time
from editwake.functions.text import safe_query_name
from editwake.plans.layout import small_side

MAX_NAME = 100


def read_query_file(spark: SparkSession, path) -> DataFrame:
    """CSV files of queries with optional output names, numbered by file name and line."""
    # Queries may hold line ends, and a file read whole keeps its order.
    rows = spark.read.schema("query string, output string").csv(path, escape='"', multiLine=True)
    placed = rows.select(
        "query", "output", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")
    )
    # Query files are written by hand; one task numbers them.
    ordinal = F.row_number().over(Window.orderBy("file", "line")).alias("ordinal")
    return name_queries(placed.select("query", "output", ordinal))


def query_clauses(
    queries: DataFrame,
    start: str | None = None,
    end: str | None = None,
    namespace: int | None = None,
    field: str = "added",
) -> DataFrame:
    """Named queries as clauses: each a phrase, within a shared time range and namespace.

    ``query_id`` is the ordinal. The clauses go to ``match_saved_queries``.
    """
    for bound in (start, end):
        if bound and not names_real_time(bound):
            raise ValueError(f"neither a time nor the start of one: {bound}")
    none = F.lit(None).cast("string")

    def clause(number: int, on: str, kind: str, value=none, lo=none, hi=none) -> Column:
        cells = (F.lit(number), F.lit("must"), F.lit(on), F.lit(kind), value, lo, hi)
        names = ("clause_no", "occur", "field", "kind", "value", "lo", "hi")
        return F.struct(*[c.alias(n) for c, n in zip(cells, names)])

    wanted = [clause(0, field, "phrase", F.col("query"))]
    if start or end:
        wanted.append(clause(1, "timestamp", "range", none, F.lit(start).cast("string"), F.lit(end).cast("string")))
    if namespace is not None:
        wanted.append(clause(2, "namespace", "term", F.lit(str(namespace))))
    return queries.select(F.col("ordinal").cast("bigint").alias("query_id"), F.inline(F.array(*wanted)))


def named_trends(trends: DataFrame, queries: DataFrame) -> DataFrame:
    """Trends by ``query_id`` under the output names of their queries."""
    names = queries.select(F.col("ordinal").cast("bigint").alias("query_id"), "output")
    return trends.join(small_side(names), "query_id").drop("query_id")


def name_queries(queries: DataFrame) -> DataFrame:
    """Fill in missing output names: padded ordinal, query, cut at 100.

    Ordinals are padded to the digits of the total number of queries.
    """
    total = queries.agg(F.max("ordinal").alias("total")).scalar()
    digits = F.length(total.cast("string"))
    name = F.concat(
        F.lpad(F.col("ordinal").cast("string"), digits, F.lit("0")),
        F.lit("_"),
        safe_query_name(F.col("query")),
        F.lit(".csv"),
    )
    return queries.select(
        "ordinal", "query", F.coalesce("output", F.substring(name, 1, MAX_NAME)).alias("output")
    )


# What a request means that leaves a key out.
REQUEST_DEFAULTS = {"collapse_hits": "no", "max_revs": 1000, "version": "0.1", "format": "json"}


def _text(request: Column, key: str) -> Column:
    return F.coalesce(
        F.get_json_object(request, f"$.{key}"), F.lit(str(REQUEST_DEFAULTS[key]))
    )


def parse_requests(requests: DataFrame, request: str = "value") -> DataFrame:
    """JSON requests as columns; ``valid`` is false where ``q`` is missing.

    ``fields`` may be an array or a single name; an empty name means none.
    """
    line = F.col(request)
    fields = F.get_json_object(line, "$.fields")
    as_array = F.from_json(fields, "array<string>")
    query = F.get_json_object(line, "$.q")
    return requests.withColumns(
        {
            "q": query,
            "collapse_hits": _text(line, "collapse_hits"),
            "max_revs": F.coalesce(
                _text(line, "max_revs").try_cast("int"), F.lit(REQUEST_DEFAULTS["max_revs"])
            ),
            "version": _text(line, "version"),
            "format": _text(line, "format"),
            "fields": F.when(F.coalesce(fields, F.lit("")) == "", F.array().cast("array<string>"))
            .when(fields.startswith("[") & as_array.isNotNull(), as_array)
            .otherwise(F.array(fields)),
            "valid": query.isNotNull(),
        }
    )
