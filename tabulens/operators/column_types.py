"""Semantic column types, target, task and routing, as rules over the profile table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L


def normal_name(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(" "), F.lit("_")))


def name_has(c: Column, words: Sequence[str], compat: bool = False) -> Column:
    """Whole-token keyword test; `compat` accepts the keyword anywhere inside the name."""
    name = normal_name(c)
    if compat:
        return name.rlike("(" + "|".join(w.replace(".", r"\.") for w in words) + ")")
    whole = "|".join(w.strip("_") for w in words)
    return F.concat(F.lit("_"), F.replace(name, F.lit("-"), F.lit("_")), F.lit("_")).rlike(f"_({whole})_")


def _filled() -> Column:
    return F.col("n_rows") - F.col("null_count")


def unique_ratio() -> Column:
    return F.col("n_unique") / F.nullif(_filled(), F.lit(0))


def is_datetime(compat: bool = False) -> Column:
    return (name_has(F.col("column_name"), L.DATE_KEYWORDS, compat) | (F.col("kind") == "timestamp")
            | ((_filled() >= 3) & (F.coalesce("date_share", F.lit(0.0)) >= 0.90)))


def is_identifier(compat: bool = False) -> Column:
    return (name_has(F.col("column_name"), L.ID_KEYWORDS, compat)
            | ((_filled() > 20) & (unique_ratio() >= 0.95) & F.col("kind").isin("string", "int")))


def is_cluster_identifier() -> Column:
    """Identifier rule of the clustering stage."""
    name = F.lower(F.trim("column_name"))
    ratio = F.col("n_unique") / F.greatest("n_rows", F.lit(1))
    return (name.isin(L.CLUSTER_ID_NAMES)
            | (name.rlike("(" + "|".join(L.CLUSTER_ID_TERMS) + ")") & (ratio >= 0.70))
            | ((ratio >= 0.98) & (F.col("kind") != "float")))


def is_route_identifier() -> Column:
    """Identifier rule of the routing stage."""
    name = F.lower(F.trim("column_name"))
    terms = "|".join(L.ROUTE_ID_TERMS)
    ratio = F.col("n_unique") / F.greatest("n_rows", F.lit(1))
    return (name.rlike(f"^({terms})$|_({terms})$|^({terms})_")
            | ((F.col("n_rows") >= 20) & (ratio > 0.95) & (name.rlike("id|number") | (name == "no"))))


def infer_types(profile: DataFrame, compat: bool = False) -> DataFrame:
    """Add `col_type`: empty, datetime, id, bool, int, float, categorical or text."""
    kind, ratio = F.col("kind"), unique_ratio()
    t = (F.when(_filled() == 0, "empty")
         .when(is_datetime(compat), "datetime")
         .when(is_identifier(compat), "id")
         .when(kind.isin("int", "float", "bool"),
               F.when(F.col("n_unique") <= 2, "bool").otherwise(kind))
         .when(F.col("numeric_share") >= 0.95,
               F.when(F.col("integer_share") == 1.0, "int").otherwise("float"))
         .when(F.col("n_unique") <= 2, "bool")
         .when((F.col("avg_length") > 30) & (ratio > 0.5), "text")
         .when((F.col("n_unique") <= 50) | (ratio < 0.3), "categorical")
         .when(F.col("avg_length") > 15, "text").otherwise("categorical"))
    return profile.withColumn("col_type", t)


def is_free_text(prototype: bool = False) -> Column:
    if prototype:
        return (F.col("kind") == "string") & (unique_ratio() < 0.95) & (F.col("avg_length") > 3)
    return (F.col("kind") == "string") & (F.col("avg_length") >= 35) & (unique_ratio() >= 0.30)


def score_targets(typed: DataFrame, keyword: float = 10, fresh: float = 3, holes: float = 8) -> DataFrame:
    """Score of every column as a target (identifiers, dates and empty columns left out)."""
    d = typed.where(~F.col("col_type").isin("id", "datetime", "empty"))
    null_share = F.col("null_count") / F.col("n_rows")
    score = (F.when(name_has(F.col("column_name"), L.TARGET_KEYWORDS, True), keyword).otherwise(0)
             + F.when(F.col("col_type") == "categorical", 5).when(F.col("col_type") == "bool", 4)
             .when(F.col("col_type").isin("int", "float"), 2).otherwise(0)
             + F.when(null_share < 0.05, fresh).when(null_share > 0.40, -holes).otherwise(0)
             + F.when(F.col("n_unique").between(2, 30), 2).when(F.col("n_unique") > 100, -2).otherwise(0))
    return d.withColumn("score", score.cast("long"))


def pick_target(typed: DataFrame) -> DataFrame:
    """One row: best target and its task; no row when nothing qualifies."""
    task = (F.when(F.col("col_type").isin("categorical", "bool") | (F.col("n_unique") <= 30), "classification")
            .when(F.col("col_type").isin("int", "float") & (F.col("n_unique") > 10), "regression")
            .otherwise("classification"))
    return (score_targets(typed).orderBy(F.desc("score"), "ordinal").limit(1)
            .select(F.col("column_name").alias("target"), "col_type", "score", "n_unique", task.alias("task")))


def target_by_name(profile: DataFrame) -> DataFrame:
    """Target by priority lists: exact names first, then keywords that are no identifiers."""
    exact = F.array(*[F.lit(x.replace(" ", "_")) for x in L.TARGET_EXACT])
    words = F.array(*[F.lit(x) for x in L.TARGET_PRIORITY])
    name = F.replace(F.lower(F.trim("column_name")), F.lit(" "), F.lit("_"))
    first_word = F.array_min(F.transform(words, lambda w, i: F.when(F.contains(name, w), i)))
    usable = ~is_route_identifier() & (F.col("n_unique") < F.col("n_rows") * 0.98)
    hit = (F.when(F.array_position(exact, name) > 0,
                  F.struct(F.lit(0).alias("stage"), F.array_position(exact, name).cast("int").alias("place")))
           .when(usable & first_word.isNotNull(),
                 F.struct(F.lit(1).alias("stage"), first_word.cast("int").alias("place"))))
    return (profile.withColumn("hit", hit).where(F.col("hit").isNotNull())
            .orderBy("hit.stage", "hit.place", "ordinal").limit(1)
            .select(F.col("column_name").alias("target"),
                    F.when(F.col("hit.stage") == 0, "exact").otherwise("keyword").alias("matched_by")))


def task_type(df: DataFrame, target: str) -> DataFrame:
    """One row: regression when the target is numeric with many values, else classification."""
    c = F.col(target)
    one = df.agg(F.count(c).alias("n"), F.count(c.cast("string").try_cast("double")).alias("n_num"),
                 F.count_distinct(c).alias("n_unique"))
    many = F.col("n_unique") > F.greatest(F.lit(20), F.floor(F.col("n") * 0.15))
    return one.select(F.lit(target).alias("target"), "n", "n_unique",
                      F.when((F.col("n") > 0) & (F.col("n_num") >= 0.95 * F.col("n")) & many, "regression")
                      .otherwise("classification").alias("task"))


def column_roles(profile: DataFrame, target: str | None, declared: dict[str, str] | None = None,
                 excluded: Sequence[str] = ()) -> DataFrame:
    """Role per column: target, identifier, empty, numeric, text, datetime, categorical.

    Declared types from a run configuration win over inference.
    """
    name = F.col("column_name")
    given = F.element_at(F.create_map(*[x for k, v in (declared or {"": ""}).items()
                                        for x in (F.lit(k), F.lit(v.lower()))]), name)
    from_config = (F.when(given.isin("numeric", "float", "int", "integer"), "numeric")
                   .when(given.isin("datetime", "date", "time"), "datetime")
                   .when(given.isin("text", "free_text", "nlp"), "text")
                   .when(given.isin("categorical", "cat", "object", "string"), "categorical"))
    ident = name.isin(list(excluded)) if excluded else is_route_identifier()
    role = F.when(name == F.lit(target), "target") if target else F
    role = (role.when(ident, "identifier").when(_filled() == 0, "empty").when(from_config.isNotNull(), from_config)
            .when(F.col("kind").isin("int", "float"), "numeric")
            .when((F.col("kind") == "timestamp") | F.lower(name).rlike("date|time"), "datetime")
            .when(is_free_text(), "text").otherwise("categorical"))
    return profile.withColumn("role", role)


def routing(roles: DataFrame, task: str) -> DataFrame:
    """One-row routing record from the roles (a table with one row per column)."""
    names = lambda r: F.array_join(F.sort_array(F.collect_list(F.when(F.col("role") == r, F.col("column_name")))), ",")
    longest = F.max(F.when(F.col("role") == "text", F.col("avg_length")))
    n_num = F.count_if(F.col("role") == "numeric")
    heavy = F.lit(task == "classification") & (longest >= 50) & (n_num <= 5)
    return roles.agg(
        F.lit(task).alias("task_type"), F.max(F.when(F.col("role") == "target", F.col("column_name"))).alias("target"),
        names("numeric").alias("numeric_columns"), names("categorical").alias("categorical_columns"),
        names("datetime").alias("datetime_columns"), names("text").alias("text_columns"),
        names("identifier").alias("identifier_columns"),
        F.when(heavy, "text_heavy").otherwise("tabular").alias("modality"))


def modality(typed: DataFrame) -> DataFrame:
    """One row: dataset modality and dominant language."""
    texts = F.count_if(F.col("col_type") == "text")
    ar = F.count_if("has_arabic")
    arabic = ar > 0.25 * F.count_if(~F.col("col_type").isin("id", "empty"))
    return typed.agg(
        F.when((texts > 0) & arabic, "bilingual").when(texts > 0, "text_heavy").otherwise("tabular").alias("modality"),
        F.when(arabic, "arabic").otherwise("english").alias("dominant_language"),
        ar.alias("arabic_columns"), texts.alias("text_columns"))


def recommendations(typed: DataFrame) -> DataFrame:
    """Recommended fill and encoding per column."""
    n = F.col("n_unique")
    return typed.select(
        "column_name", "col_type",
        F.when(F.col("col_type").isin("int", "float"),
               F.when(F.abs("skew_g1") > 1, "median").otherwise("mean")).alias("fill_strategy"),
        F.when(F.col("col_type").isin("categorical", "bool"),
               F.when(n <= 2, "binary").when(n <= 10, "onehot").when(n <= 50, "label")
               .otherwise("frequency")).alias("encoding_strategy"))


def is_incident_like(columns: Sequence[str]) -> bool:
    """Whether the column names suggest ticket or incident records."""
    joined = " ".join(columns).lower()
    return any(w in joined for w in L.INCIDENT_KEYWORDS)
