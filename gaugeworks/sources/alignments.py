"""Alignment and settings files as rows: one document is one row, so nothing is shuffled to read its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A decimal number: somewhere a digit, at most one point, perhaps an exponent
_NUMBER = r"^[+-]?(?=[.]?\d)\d*[.]?\d*(?:[eE][+-]?\d+)?$"
_VERTEX = "array<struct<index:double,x:double,y:double>>"


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole files; Spark skips empty files, so they give no rows."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _numbers(parts: Column, at: int, count: int) -> Column:
    """``count`` numbers of the parts from ``at``; null where one is missing or none."""
    given = [F.get(parts, F.lit(at + i)) for i in range(count)]
    numbers = [F.when(F.rlike(g, F.lit(_NUMBER)), g.try_cast("double")) for g in given]
    whole = F.lit(True)
    for n in numbers:
        whole = whole & n.isNotNull()
    return F.when(whole, F.array(*numbers))


def parse_alignments(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path``, translate_x, translate_y, scale_x, scale_y, rotate, vertices (array of index, x, y), side, unrecognised (lines), problem.

    Lines are ``translate x y``, ``scale x y``, ``rotate degrees`` (of several
    the last counts) and vertices ``index x y``; blank lines and comments (#)
    are skipped, others are listed by number. problem is null, or the first of:
    ``malformed`` (a line lacks its numbers, or an index is no positive whole
    number), ``translate``, ``scale``, ``rotate``, ``vertices`` (missing),
    ``duplicate``, ``missing`` (indices that aren't 1 to n), ``not-square``. A
    null text has the problem translate, as an empty one.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda line, i: F.struct((i + 1).alias("at"), F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ").alias("parts")))
    said = documents.select(F.col(path).alias("path"), F.filter(lines, lambda x: ~F.get(x["parts"], F.lit(0)).startswith("#") & (F.get(x["parts"], F.lit(0)) != "")).alias("_l"))
    head = lambda x: F.lower(F.get(x["parts"], F.lit(0)))
    is_vertex = lambda x: F.rlike(head(x), F.lit(_NUMBER))
    known = {"translate": 2, "scale": 2, "rotate": 1}
    of = lambda word, count: F.transform(F.filter("_l", lambda x: head(x) == word), lambda x: _numbers(x["parts"], 1, count))
    rows = said.select(
        "path",
        *(of(w, n).alias(f"_{w}") for w, n in known.items()),
        F.transform(F.filter("_l", is_vertex), lambda x: _numbers(x["parts"], 0, 3)).alias("_vertices"),
        F.transform(F.filter("_l", lambda x: ~is_vertex(x) & ~head(x).isin(*known)), lambda x: x["at"]).alias("unrecognised"),
    )
    bad = F.lit(False)
    for c in (*(f"_{w}" for w in known), "_vertices"):
        bad = bad | F.exists(c, lambda v: v.isNull())
    index = lambda v: F.get(v, F.lit(0))
    bad = bad | F.coalesce(F.exists("_vertices", lambda v: (index(v) < 1) | (index(v) != F.floor(index(v)))), F.lit(False))
    n, indices = F.size("_vertices"), F.transform("_vertices", index)
    side = F.round(F.sqrt(n)).cast("int")
    problem = F.when(bad, "malformed")
    for w in known:
        problem = problem.when(F.size(f"_{w}") == 0, w)
    problem = problem.when(n == 0, "vertices").when(F.size(F.array_distinct(indices)) != n, "duplicate").when(F.array_max(indices) != n, "missing").when(side * side != n, "not-square")
    last = lambda w, i: F.get(F.try_element_at(f"_{w}", F.lit(-1)), F.lit(i))
    points = F.array_sort(F.transform(F.filter("_vertices", lambda v: v.isNotNull()), lambda v: F.struct(index(v).alias("index"), F.get(v, F.lit(1)).alias("x"), F.get(v, F.lit(2)).alias("y"))))
    return rows.select(
        F.col("path").alias(path), last("translate", 0).alias("translate_x"), last("translate", 1).alias("translate_y"), last("scale", 0).alias("scale_x"), last("scale", 1).alias("scale_y"),
        last("rotate", 0).alias("rotate"), points.cast(_VERTEX).alias("vertices"), side.alias("side"), "unrecognised", problem.alias("problem"),
    )


def vertex_shifts(alignments: DataFrame, path: str = "path") -> DataFrame:
    """``path``, index, dx, dy: how far each vertex of a sound alignment is from its place in the even grid from (-1, 1) to (1, -1)."""
    rows = alignments.where("problem IS NULL").select(path, "side", F.inline("vertices"))
    k, span = F.col("index") - 1, F.nullif(F.col("side") - 1, F.lit(0))
    column, row = k % F.col("side"), F.floor(k / F.col("side"))
    at = lambda place, sign: F.coalesce(sign * (2 * place / span - 1), F.lit(0.0))
    return rows.select(path, F.col("index").cast("int").alias("index"), (F.col("x") - at(column, 1)).alias("dx"), (F.col("y") - at(row, -1)).alias("dy"))


def parse_settings(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path``, setting, env_name (in capitals), value and default of JSON files that map settings to objects with a ``value``.

    value is null unless it is a finite number; default is the number after
    ``Default Value:`` in the description, null without one. A setting without
    a value, and a document that is null, empty or no such map, give no rows.
    """
    entry = "map<string, struct<value:string,description:string,envName:string>>"
    rows = documents.select(path, F.explode(F.from_json(F.col(text), entry)).alias("setting", "_e")).where("_e.value IS NOT NULL")
    default = F.regexp_extract("_e.description", r"(?i)default value:(?:\s|<br>)*([+-]?(?:\d+(?:[.]\d+)?|[.]\d+))", 1)
    value = F.when(F.rlike("_e.value", F.lit(_NUMBER)), F.col("_e.value").try_cast("double"))
    return rows.select(path, "setting", F.upper("_e.envName").alias("env_name"), value.alias("value"), F.nullif(default, F.lit("")).try_cast("double").alias("default"))


def settings_geometry(settings: DataFrame, names: dict[str, str], path: str = "path") -> DataFrame:
    """``path`` and two columns a name: the value and the default (``<name>_default``) of the setting with that environment name.

    names: column to environment name. Of several settings of one name the
    last one by its own name counts.
    """
    pick = lambda env, what: F.max_by(F.col(what), F.when(F.col("env_name") == env, F.col("setting")))
    return settings.groupBy(path).agg(*(c for n, env in names.items() for c in (pick(env, "value").alias(n), pick(env, "default").alias(f"{n}_default"))))
