"""Dimensional modelling: what columns and tables are for, the star they make, and what to mend in it.

Frames: ``columns`` has id, parent, name, data_type, primary_key, and n_distinct and null_pct where profiles are known; ``tables``
has id, type, and row_count where it is known. ``links`` are (from_table, from_column, to_table, to_column, provenance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import singular

# Words of names and types, and layer prefixes.
NUMERIC = ("int", "num", "dec", "float", "double", "real", "money", "serial")
MEASURES = (
    "amount", "total", "qty", "quantity", "count", "price", "revenue", "cost", "value", "sum", "num_", "number_of", "score", "rate", "balance", "fee", "tax",
    "discount", "weight", "duration", "sales", "profit", "margin", "lifetime", "spend", "units", "volume", "hours", "minutes", "seconds", "points", "clicks", "views", "impressions",
)
UNITS = ("_usd", "_eur", "_inr", "_pct", "_percent")
DATES = ("date", "_at", "_ts", "timestamp", "_time", "_day", "_month", "_year", "period", "created", "updated", "modified")
FLAGS = ("is_", "has_", "was_", "can_", "should_", "flag")
FACTS = ("fact", "fct_", "order", "transaction", "event", "payment", "sale", "booking", "shipment", "invoice", "click", "session", "log", "activity", "visit", "purchase", "trip", "ride", "claim", "line_item", "item")
DIMENSIONS = ("dim", "customer", "product", "user", "account", "employee", "store", "location", "region", "country", "date", "calendar", "category", "supplier", "vendor", "channel", "campaign", "department", "plan", "status", "type", "currency")
PREFIXES = ("dim_", "fact_", "fct_", "stg_", "raw_", "src_", "int_", "mart_", "tbl_", "t_", "d_", "f_")
DATE_TABLES = ("dim_date", "dim_calendar", "date_dim", "dates", "calendar", "dim_time", "dim_datetime")
HISTORY = ("valid_from", "valid_to", "effective_from", "effective_to", "start_date", "end_date", "is_current", "current_flag")
EFFECTIVE = ("row_effective_date", "row_expiration_date")
UPDATED = ("updated_at", "modified_at", "last_modified", "last_updated", "updated_date")
SEMI_ADDITIVE = ("balance", "inventory", "stock", "level", "headcount", "snapshot")
TABLE_TYPES = ("TABLE", "VIEW", "DBT_MODEL", "DBT_SOURCE", "DBT_SEED", "DBT_SNAPSHOT")

KEY_NAME = "^(.*?)_(id|key|sk|fk)$"
KEY_LIKE, CODE_LIKE = "(_id|_key|_sk|_fk|_code|_number|_no)$|^(sk|key)$", "(_code|_number|_no)$"
DATE_NAME = "^(" + "|".join(DATES) + ")|(" + "|".join(DATES) + ")$|^(" + "|".join(d.strip("_") for d in DATES) + ")$"
MEASURE_NAME, UNIT_NAME, FLAG_NAME = "|".join(MEASURES), "(" + "|".join(UNITS) + ")$", "^(" + "|".join(FLAGS) + ")"
NUMERIC_TYPE, BOOLEAN_TYPE, BOOLEAN_START, DATE_TYPE = "|".join(NUMERIC), "bool|bit", "^(bool|bit)", "date|time"
FACT_NAME = "|".join(FACTS)
DIMENSION_NAME = "^(" + "|".join(DIMENSIONS) + ")|_(" + "|".join(DIMENSIONS) + ")$"
ROLES = ("pk", "fk", "date", "measure", "flag", "attribute")


def last_name(id_: Column) -> Column:
    """The last segment of a table's id, in lower case."""
    return F.lower(F.substring_index(F.regexp_replace(id_, "^[^:]*:", ""), ".", -1))


def base_name(id_: Column) -> Column:
    """The last segment without a layer prefix (one at most)."""
    return F.regexp_replace(last_name(id_), "^(" + "|".join(PREFIXES) + ")", "")


def _with(columns: DataFrame, **types: str) -> DataFrame:
    """``columns``, with null ones of those names that it lacks."""
    return columns.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in columns.columns})


def column_roles(columns: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """id, parent, name, data_type, null_pct, role of each column: pk, fk, date, measure, flag or attribute, by the first rule that holds."""
    rows = _with(columns, n_distinct="long", null_pct="double", primary_key="boolean")
    counts = tables.select(F.col("id").alias("parent"), "row_count") if tables is not None and "row_count" in tables.columns else None
    rows = rows.join(counts, "parent", "left") if counts is not None else rows.withColumn("row_count", F.lit(None).cast("long"))
    name, kind, base = F.lower("name"), F.lower(F.coalesce("data_type", F.lit(""))), base_name(F.col("parent"))
    one = singular(base)
    own = [F.concat(x, F.lit(y)) for x, y in ((base, "_id"), (one, "_id"), (base, "_key"), (one, "_key"), (one, "_sk"), (base, "_sk"))]
    unique = F.coalesce((F.col("n_distinct") >= F.col("row_count")) & (F.col("row_count") > 1), F.lit(False))
    numeric = kind.rlike(NUMERIC_TYPE) & ~kind.rlike(BOOLEAN_TYPE)
    role = (
        F.when(F.coalesce("primary_key", F.lit(False)) | name.isin("id", "pk") | name.isin(*own), "pk")
        .when(name.rlike(KEY_LIKE), F.when(unique, "pk").when(name.rlike(CODE_LIKE), "attribute").otherwise("fk"))
        .when(kind.rlike(BOOLEAN_START) | name.rlike(FLAG_NAME), "flag")
        .when(kind.rlike(DATE_TYPE) | name.rlike(DATE_NAME), "date")
        .when(numeric, F.when(name.rlike(MEASURE_NAME) | name.rlike(UNIT_NAME), "measure").when(F.col("n_distinct") <= 50, "attribute").otherwise("measure"))
        .when((kind == "") & name.rlike(MEASURE_NAME), "measure")
        .otherwise("attribute")
    )
    return rows.select("id", "parent", "name", "data_type", "n_distinct", "null_pct", "row_count", role.alias("role"))


def key_links(tables: DataFrame, columns: DataFrame, edges: DataFrame, include_inferred: bool = True) -> DataFrame:
    """from_table, from_column, to_table, to_column, provenance: declared foreign keys, and those that names suggest.

    A column ``x_id`` suggests a table whose base name, or its singular, is x or its singular; of several, one that has that
    column, or ``id``, or ``x_id``, comes first, then the least id. Equi-joins on base names only.
    """
    own = columns.select(F.col("id"), F.col("parent"), F.col("name"))
    declared = edges.where("type = 'DEPENDS_ON' and via = 'foreign_key'").join(own.select(F.col("id").alias("src"), F.col("parent").alias("from_table"), F.col("name").alias("from_column")), "src")
    declared = declared.join(own.select(F.col("id").alias("dst"), F.col("parent").alias("to_table"), F.col("name").alias("to_column")), "dst")
    declared = declared.groupBy("from_table", "from_column", "to_table").agg(F.min("to_column").alias("to_column")).withColumn("provenance", F.lit("extracted"))
    if not include_inferred:
        return declared
    held = tables.where(F.col("type").isin(*TABLE_TYPES)).select(F.col("id").alias("to_table"), base_name(F.col("id")).alias("b"))
    held = held.select("to_table", F.explode(F.array_distinct(F.array("b", singular(F.col("b"))))).alias("ref_name"))
    asking = columns.select(F.col("parent").alias("from_table"), F.lower("name").alias("from_column"), F.regexp_extract(F.lower("name"), KEY_NAME, 1).alias("ref")).where(F.lower("name").rlike(KEY_NAME))
    asking = asking.withColumn("b", base_name(F.col("from_table"))).where((F.col("ref") != F.col("b")) & (F.col("ref") != singular(F.col("b")))).drop("b")
    wanted = asking.select("*", F.explode(F.array_distinct(F.array("ref", singular(F.col("ref"))))).alias("ref_name"))
    found = wanted.join(held, "ref_name").where("from_table <> to_table").groupBy("from_table", "from_column", "ref", "to_table").agg(F.lit(0))
    names = columns.groupBy(F.col("parent").alias("to_table")).agg(F.collect_set(F.lower("name")).alias("names"))
    found = found.join(names, "to_table", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    has = lambda x: F.array_contains("names", x)
    better = has(F.col("from_column")) | has(F.lit("id")) | has(F.concat("ref", F.lit("_id")))
    order = Window.partitionBy("from_table", "from_column").orderBy(F.when(better, 0).otherwise(1), "to_table")
    best = found.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    inferred = best.select("from_table", "from_column", "to_table", F.when(has(F.col("from_column")), F.col("from_column")).otherwise(F.lit("id")).alias("to_column"), F.lit("inferred").alias("provenance"))
    return declared.unionByName(inferred.join(declared, ["from_table", "from_column", "to_table"], "left_anti"))


def without_alias_nodes(tables: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables, but for those without columns that are only another spelling of one (an alias edge)."""
    ends = edges.where("via = 'alias'").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    bare = tables.select("id").join(columns.select(F.col("parent").alias("id")), "id", "left_anti").join(ends, "id", "left_semi")
    return tables.join(bare, "id", "left_anti")


def table_roles(tables: DataFrame, roles: DataFrame, links: DataFrame) -> DataFrame:
    """id, role, confidence, and the counts they rest on: fact, dimension, bridge, lookup, derived or unknown."""
    counts = roles.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_columns"), *[F.count_if(F.col("role") == r).alias(r) for r in ROLES])
    out_, in_ = (links.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias(n)) for c, n in (("from_table", "fk_out"), ("to_table", "fk_in")))
    rows = tables.where(F.col("type").isin(*TABLE_TYPES)).select("id", "type").join(counts, "id", "left").join(out_, "id", "left").join(in_, "id", "left").fillna(0)
    name = last_name(F.col("id"))
    c = F.col
    fact = 2.0 * c("fk_out") + 1.5 * c("measure") + F.when(c("date") > 0, 1).otherwise(0) + F.when(c("fk_out") == 0, c("fk")).otherwise(0) + F.when(name.rlike(FACT_NAME), 2).otherwise(0)
    dim = 2.0 * c("fk_in") + 0.75 * c("attribute") + F.when(c("pk") > 0, 1).otherwise(0) + F.when(name.rlike(DIMENSION_NAME), 2).otherwise(0)
    rows = rows.withColumns({"f": fact, "d": dim})
    bridge = ((c("fk_out") >= 2) | (c("fk") >= 2)) & (c("measure") + c("attribute") + c("date") == 0)
    derived = (c("type") == "VIEW") & (c("fk_out") + c("fk_in") == 0)
    most, least = F.greatest("f", "d"), F.least("f", "d")
    sure = F.least(F.lit(1.0), F.round((most - least) / F.greatest(most, F.lit(1.0)) * 0.6 + 0.4, 2))
    turned = (c("measure") >= 2) & (c("fk_in") == 0) & (c("f") >= 0.8 * c("d"))
    role = (
        F.when(c("n_columns") == 0, "unknown").when(derived, "derived").when(bridge, "bridge").when(most == 0, "unknown").when(c("f") > c("d"), "fact")
        .when(c("d") > c("f"), F.when(turned, "fact").otherwise("dimension")).when((c("attribute") > 0) & (c("measure") == 0), "lookup").otherwise("unknown")
    )
    confidence = F.when(c("n_columns") == 0, 0.0).when(derived, 0.7).when(bridge, 0.8).when(most == 0, 0.0).when(c("f") == c("d"), 0.3).otherwise(sure)
    return rows.select("id", role.alias("role"), confidence.cast("double").alias("confidence"), "n_columns", *ROLES, "fk_out", "fk_in")


def _listed(column: str | Column, order: str | None = None) -> Column:
    return F.array_sort(F.collect_list(F.struct(order, column)))[column] if order else F.sort_array(F.collect_list(column))


def is_date_table(id_: Column) -> Column:
    return last_name(id_).isin(*DATE_TABLES)


def facts(roles: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """id, role, grain, measures, dates, dimensions, unresolved_keys, degenerate, business_process of each fact and bridge; lists sorted by name.

    The grain is the first date (or the key of a date dimension) and the columns of the key links.
    """
    own = classes.where(F.col("role").isin("fact", "bridge")).select("id", "role")
    of = lambda r: F.sort_array(F.collect_list(F.when(F.col("c.role") == r, F.col("c.name"))))
    lists = roles.alias("c").groupBy(F.col("c.parent").alias("id")).agg(of("measure").alias("measures"), of("date").alias("dates"), of("attribute").alias("degenerate"), of("fk").alias("keys"))
    via = links.groupBy(F.col("from_table").alias("id")).agg(F.sort_array(F.collect_set("from_column")).alias("via"), F.sort_array(F.collect_set("to_table")).alias("dimensions"), F.min(F.when(is_date_table(F.col("to_table")), F.col("from_column"))).alias("date_key"))
    none = F.array().cast("array<string>")
    rows = own.join(lists, "id", "left").join(via, "id", "left").withColumns({x: F.coalesce(x, none) for x in ("measures", "dates", "degenerate", "keys", "via", "dimensions")})
    first = F.when(F.col("date_key").isNotNull(), F.array("date_key")).otherwise(none)
    grain = F.array_distinct(F.concat(first, F.slice("dates", 1, 1), "via"))
    process = F.replace(F.replace(last_name(F.col("id")), F.lit("fact_"), F.lit("")), F.lit("fct_"), F.lit(""))
    return rows.select("id", "role", grain.alias("grain"), "measures", "dates", "dimensions", F.array_except("keys", "via").alias("unresolved_keys"), "degenerate", process.alias("business_process"), "date_key")


def dimensions(roles: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """id, key, attributes, used_by, snowflake_to, measures, and how it changes: scd_type, history_columns, surrogate_key, recommendation."""
    own = classes.where(F.col("role").isin("dimension", "lookup")).select("id")
    of = lambda *r: F.sort_array(F.collect_list(F.when(F.col("role").isin(*r), F.col("name"))))
    named = lambda names: F.sort_array(F.collect_list(F.when(F.col("name").isin(*names), F.col("name"))))
    lists = roles.groupBy(F.col("parent").alias("id")).agg(
        F.min(F.when(F.col("role") == "pk", F.col("name"))).alias("key"), F.min_by(F.lower(F.coalesce("data_type", F.lit(""))), F.when(F.col("role") == "pk", F.col("name"))).alias("key_type"),
        of("attribute", "flag", "date").alias("attributes"), of("measure").alias("measures"), named(HISTORY).alias("history_columns"), (F.count_if(F.col("name").isin(*HISTORY, *EFFECTIVE)) > 0).alias("history"), (F.count_if(F.col("name").isin(*UPDATED)) > 0).alias("updated"),
    )
    fact_ids = classes.where(F.col("role").isin("fact", "bridge")).select(F.col("id").alias("from_table"))
    used = links.join(fact_ids, "from_table", "left_semi").groupBy(F.col("to_table").alias("id")).agg(F.sort_array(F.collect_set("from_table")).alias("used_by"))
    onward = links.groupBy(F.col("from_table").alias("id")).agg(F.sort_array(F.collect_set("to_table")).alias("snowflake_to"))
    none = F.array().cast("array<string>")
    rows = own.join(lists, "id", "left").join(used, "id", "left").join(onward, "id", "left").withColumns({x: F.coalesce(x, none) for x in ("attributes", "measures", "history_columns", "used_by", "snowflake_to")})
    calendar = is_date_table(F.col("id"))
    history, updated = F.coalesce("history", F.lit(False)), F.coalesce("updated", F.lit(False))
    surrogate = F.col("key").isNotNull() & ((F.col("key_type") == "") | F.col("key_type").rlike(NUMERIC_TYPE)) & ~F.col("key").rlike("(_code|_number)$")
    kind = F.when(calendar, "static").when(history, "2").when(updated, "1").otherwise("undecided")
    advice = (
        F.when(calendar, "a calendar: it doesn't change").when(history, "keeps history (type 2)")
        .when(updated, "overwritten (type 1) as it stands; columns of validity would make it type 2").otherwise("changes leave no trace; type 1 is assumed")
    )
    return rows.select("id", "key", "attributes", "used_by", "snowflake_to", "measures", kind.alias("scd_type"), "history_columns", F.when(surrogate, F.col("key")).alias("surrogate_key"), advice.alias("recommendation"))


def conformed(links: DataFrame, facts_: DataFrame) -> DataFrame:
    """id, facts: targets of at least two different facts' keys."""
    rows = links.join(facts_.select(F.col("id").alias("from_table")), "from_table", "left_semi")
    return rows.groupBy(F.col("to_table").alias("id")).agg(F.count_distinct("from_table").alias("facts")).where("facts >= 2")


def bus_matrix(links: DataFrame, facts_: DataFrame) -> DataFrame:
    """A row a fact, a column a table that its keys point at, X where they do. The columns are the tables of one model, so the pivot is narrow."""
    rows = links.join(facts_.select(F.col("id").alias("from_table")), "from_table", "left_semi").select(F.col("from_table").alias("fact"), "to_table").distinct()
    return rows.groupBy("fact").pivot("to_table").agg(F.first(F.lit("X")))


def additivity(facts_: DataFrame) -> DataFrame:
    """id, measure, kind: stocks can't be summed over time."""
    rows = facts_.select("id", F.explode("measures").alias("measure"))
    return rows.select("id", "measure", F.when(F.col("measure").rlike("|".join(SEMI_ADDITIVE)), "semi-additive").otherwise("additive").alias("kind"))


def issues(roles: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """id, rule, detail: what to mend in the model, a row a finding."""
    f, d = facts(roles, classes, links), dimensions(roles, classes, links)
    row = lambda df, rule, detail=F.lit(""): df.select(F.col("id"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    fact_ids = classes.where("role = 'fact'").select(F.col("id").alias("to_table"))
    from_facts = links.join(f.select(F.col("id").alias("from_table")), "from_table", "left_semi").withColumn("id", F.col("from_table"))
    gone = roles.where("role = 'fk' and null_pct > 20").join(f.select(F.col("id").alias("parent")), "parent", "left_semi").withColumn("id", F.col("parent"))
    tracked = roles.where(F.col("name").isin("updated_at", "modified_at", "valid_from", "effective_from", "is_current", "current_flag")).select(F.col("parent").alias("id")).distinct()
    calendars = d.where(is_date_table(F.col("id")) & ~F.col("id").endswith("dim_datetime"))
    counted = f.select(F.lit(1).alias("f"), F.lit(0).alias("c")).union(calendars.select(F.lit(0), F.lit(1))).agg(F.sum("f").alias("facts"), F.sum("c").alias("calendars"))
    parts = [
        row(d.where("key is null"), "dimension without key"),
        row(from_facts.join(fact_ids, "to_table", "left_semi"), "fact points at fact", F.concat_ws(" ", "from_column", "to_table")),
        row(f.where("size(dates) = 0 and date_key is null"), "fact without date"),
        row(f.where("size(dimensions) = 0 and size(unresolved_keys) = 0"), "fact without dimension"),
        row(f.select("id", F.explode("unresolved_keys").alias("k")), "key without table", F.col("k")),
        row(f.where("role = 'fact' and size(measures) = 0"), "fact without measure"),
        row(from_facts.where("provenance = 'inferred'"), "link inferred from names", F.concat_ws(" ", "from_column", "to_table")),
        row(gone, "key often null", F.col("name")),
        row(d.where("size(used_by) = 0"), "dimension not used"),
        row(d.where("size(snowflake_to) > 0"), "dimension snowflaked", F.array_join("snowflake_to", ",")),
        row(d.where("size(measures) > 0"), "dimension with measures", F.array_join(F.slice("measures", 1, 4), ",")),
        row(d.where("key is not null and surrogate_key is null"), "natural key", F.col("key")),
        row(d.where("size(attributes) > 0").where(~is_date_table(F.col("id"))).join(tracked, "id", "left_anti"), "no change tracking"),
        row(counted.where("facts > 0 and calendars = 0").select(F.lit("").alias("id")), "no date dimension"),
        row(classes.where("role = 'unknown'"), "table not classified"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def proposal(table_id: str, roles: DataFrame, row_count: int | None, max_distinct: int = 200) -> DataFrame:
    """target, kind, members: the star that one wide table could become.

    Attributes, flags and keys group by the word before their first underscore to a dimension; text that is nearly unique stays on the
    fact as a degenerate dimension; dates become a date dimension; measures the fact.
    """
    own = roles.where(F.col("parent") == table_id)
    near = (F.col("role") == "attribute") & (F.col("n_distinct") > max_distinct) & (F.col("n_distinct") > F.lit(row_count).cast("double") * 0.5)
    entity = F.coalesce(F.nullif(F.regexp_extract("name", "^([a-z]+?)_(?:id|key|sk|fk)$", 1), F.lit("")), F.nullif(F.regexp_extract("name", "^([a-z]+?)_[a-z0-9_]+$", 1), F.lit("")), F.col("name"))
    base = base_name(F.lit(table_id))
    fact = F.when(base.rlike("^(fact|fct)"), base).otherwise(F.concat(F.lit("fact_"), base))
    target = F.when(F.coalesce(near, F.lit(False)) | (F.col("role") == "measure"), fact).when(F.col("role") == "date", "dim_date").when(F.col("role") != "pk", F.concat(F.lit("dim_"), entity))
    kind = F.when(F.coalesce(near, F.lit(False)), "degenerate").when(F.col("role") == "measure", "measures").when(F.col("role") == "date", "dates").otherwise("dimension")
    return own.select(target.alias("target"), kind.alias("kind"), "name").where("target is not null").groupBy("target", "kind").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("members"))
