"""Relationships between objects: inferred joins, dimensions, shadows, partitions, role closure."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.model import qname
from lodeseek.session import materialise

# Endings and beginnings of copies, beginnings of layers, in the order they are tried.
SHADOW_SUFFIXES = (
    "_bkp", "_backup", "_bak", "_old", "_tmp", "_temp", "_new", "_copy", "_archive", "_arch", "_hist", "_stg", "_staging", "_v1", "_v2", "_v3", "_prev", "_orig",
)
SHADOW_PREFIXES = ("stg_", "staging_", "tmp_", "temp_", "bkp_", "backup_", "old_", "copy_", "scratch_", "wip_")
LAYER_PREFIXES = ("dim_", "fact_", "fct_", "f_", "d_", "v_", "vw_", "view_", "bridge_", "br_", "tbl_", "t_", "agg_", "mv_")
#: How a partition's name ends: a number, or a year with a month and a day, in digits or with letters before them.
PARTITION = "_(p[0-9]+|[0-9]{4}(_?[0-9]{2}(_?[0-9]{2})?)?|y[0-9]{4}(m[0-9]{2}(d[0-9]{2})?)?)$"
#: How a backup's name ends: its word, and maybe a stamp of six to eight digits.
BACKUP = "_(backup|bkp|bak)(_?([0-9]_?){5,7}[0-9])?$"
DIMENSION_IN_DEGREE = 2


def variants(word: Column) -> Column:
    """A word with its plausible singulars and plurals."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    plural = F.when(word.endswith("y") & (n > 2), F.concat(cut(1), F.lit("ies"))).otherwise(F.concat(word, F.lit("es")))
    options = F.array(
        word,
        F.when(word.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))),
        F.when(word.endswith("es") & (n > 3), cut(2)),
        F.when(word.endswith("s") & (n > 2), cut(1)),
        F.when(~(word.endswith("s") & (n > 2)), F.concat(word, F.lit("s"))),
        F.when(~(word.endswith("s") & (n > 2)), plural),
    )
    return F.array_distinct(F.filter(options, lambda x: x.isNotNull()))


def key_stem(name: Column) -> Column:
    """The object that a key column's name points at, or null."""
    n = F.length(name)
    out = F.when(F.lit(False), name)
    for s in ("_id", "_key", "_fk"):
        out = out.when(name.endswith(s) & (n > len(s)), F.substring(name, F.lit(1), n - len(s)))
    for p in ("id_", "fk_"):
        out = out.when(name.startswith(p) & (n > len(p)), F.substring(name, F.lit(len(p) + 1), n - len(p)))
    return out


def infer_foreign_keys(objects: DataFrame) -> DataFrame:
    """Undeclared joins (G1): ordinal, column, ref_table, ref_columns.

    A key column's stem is looked up among the name variants of the same schema. It counts only if exactly
    one object answers, which is another one and has one primary key column.
    """
    named = objects.withColumn("q", qname()).withColumn("low", F.lower("name")).where("low <> ''")
    tail = F.when(F.contains(F.col("low"), F.lit("_")), variants(F.substring_index("low", "_", -1))).otherwise(F.array().cast("array<string>"))
    keys = named.select(
        F.col("schema").alias("k_schema"), F.explode(F.array_union(variants(F.col("low")), tail)).alias("variant"), F.col("q").alias("target"), "ordinal", "name",
        F.filter("columns", lambda c: c["pk"]).alias("pks"),
    )
    declared = F.transform(F.flatten(F.transform("foreign_keys", lambda k: k["columns"])), F.lower)
    cols = named.select("ordinal", "schema", declared.alias("declared"), F.posexplode("columns").alias("pos", "c"))
    cols = cols.withColumn("low", F.lower("c.name")).withColumn("stem", key_stem(F.col("low")))
    cols = cols.where(F.col("stem").isNotNull() & ~F.array_contains("declared", F.col("low")))
    # Of columns whose names differ in case only, the first counts.
    cols = cols.withColumn("turn", F.row_number().over(Window.partitionBy("ordinal", "low").orderBy("pos"))).where("turn = 1")
    looked = cols.select("ordinal", "schema", "pos", F.col("c.name").alias("column"), F.explode(variants(F.col("stem"))).alias("variant"))
    hits = looked.alias("l").join(keys.alias("k"), F.col("schema").eqNullSafe(F.col("k_schema")) & (F.col("l.variant") == F.col("k.variant")))
    found = hits.groupBy("l.ordinal", "pos", "column").agg(
        F.countDistinct("target").alias("n"), F.min(F.struct("k.ordinal", "k.name", "pks")).alias("t")
    )
    found = found.where((F.col("n") == 1) & (F.size("t.pks") == 1) & (F.col("t.ordinal") != F.col("ordinal")))
    return found.select("ordinal", "pos", "column", F.col("t.name").alias("ref_table"), F.transform("t.pks", lambda c: c["name"]).alias("ref_columns"))


def with_inferred(objects: DataFrame) -> DataFrame:
    """objects with the inferred joins appended to foreign_keys, in the order of the columns."""
    key = F.struct("pos", F.struct(F.array("column").alias("columns"), "ref_table", "ref_columns", F.lit(True).alias("inferred")).alias("k"))
    added = infer_foreign_keys(objects).groupBy("ordinal").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["k"]).alias("added"))
    kind = objects.schema["foreign_keys"].dataType
    both = F.concat(F.coalesce("foreign_keys", F.array().cast(kind)), F.coalesce(F.col("added").cast(kind), F.array().cast(kind)))
    return objects.join(added, "ordinal", "left").withColumn("foreign_keys", both).drop("added").select(*objects.columns)


def edges(objects: DataFrame) -> DataFrame:
    """ordinal, k (place of the key) and ref (bare name in lower case) of each foreign key."""
    rows = objects.select("ordinal", F.posexplode("foreign_keys").alias("k", "fk"))
    return rows.select("ordinal", "k", F.lower("fk.ref_table").alias("ref")).where("ref <> ''")


def dimensions(objects: DataFrame, least: int = DIMENSION_IN_DEGREE) -> DataFrame:
    """ordinal and in_degree of objects that at least so many others reference.

    A reference goes to the first object of that bare name, in any schema, other than the referrer.
    """
    refs = edges(objects).select(F.col("ordinal").alias("source"), "ref").distinct()
    first = objects.select(F.lower("name").alias("ref"), F.col("ordinal").alias("target"))
    hits = refs.join(first, "ref").where("source <> target").groupBy("source", "ref").agg(F.min("target").alias("ordinal"))
    return hits.groupBy("ordinal").agg(F.count(F.lit(1)).alias("in_degree")).where(F.col("in_degree") >= least)


def _literal(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _by_base(objects: DataFrame) -> DataFrame:
    """Copies with a base in the same schema (G3): ordinal, base. The suffix rule goes before the prefix rule, each in list order."""
    rows = objects.select("ordinal", "schema", F.lower("name").alias("low"), qname().alias("q"))
    # Of objects with the same lower-case name the last stands for it.
    by_name = rows.groupBy(F.col("schema").alias("b_schema"), F.col("low").alias("b_low")).agg(F.max_by("q", "ordinal").alias("base"))
    tried = rows.select("ordinal", "schema", "low", "q", F.posexplode(_literal(SHADOW_SUFFIXES)).alias("turn", "suffix"))
    tried = tried.where(F.col("low").endswith(F.col("suffix")) & (F.length("low") > F.length("suffix")))
    tried = tried.withColumn("stem", F.expr("substring(low, 1, length(low) - length(suffix))"))
    suffix = tried.join(by_name, F.col("schema").eqNullSafe(F.col("b_schema")) & (F.col("stem") == F.col("b_low"))).where("base <> q")
    suffix = suffix.groupBy("ordinal").agg(F.min(F.struct("turn", "base")).alias("m")).select("ordinal", F.lit(0).alias("rule"), "m.base")

    is_copy = F.lit(False)
    for p in SHADOW_PREFIXES:
        is_copy = is_copy | F.col("low").startswith(p)
    layer = F.when(F.lit(False), F.col("low"))
    for p in LAYER_PREFIXES:
        layer = layer.when(F.col("low").startswith(p) & (F.length("low") > len(p)), F.expr(f"substring(low, {len(p) + 1})"))
    tail = F.when(F.contains(F.col("low"), F.lit("_")), F.expr("substring(low, instr(low, '_') + 1)"))
    tail = F.when(F.length(tail) >= 4, tail)
    stems = rows.where(~is_copy).select("ordinal", "schema", "q", F.explode(F.filter(F.array("low", layer, tail), lambda s: s.isNotNull())).alias("stem"))
    stems = stems.groupBy(F.col("schema").alias("b_schema"), F.col("stem").alias("b_stem")).agg(F.min_by("q", "ordinal").alias("base"))
    tried = rows.select("ordinal", "schema", "low", "q", F.posexplode(_literal(SHADOW_PREFIXES)).alias("turn", "prefix"))
    tried = tried.where(F.col("low").startswith(F.col("prefix")) & (F.length("low") > F.length("prefix")))
    tried = tried.withColumn("stem", F.expr("substring(low, length(prefix) + 1)"))
    prefix = tried.join(stems, F.col("schema").eqNullSafe(F.col("b_schema")) & (F.col("stem") == F.col("b_stem"))).where("base <> q")
    prefix = prefix.groupBy("ordinal").agg(F.min(F.struct("turn", "base")).alias("m")).select("ordinal", F.lit(1).alias("rule"), "m.base")
    return suffix.unionByName(prefix)


def _partitions(objects: DataFrame, copies: DataFrame) -> DataFrame:
    """Partitions whose parent is in the same schema and no copy itself."""
    rows = objects.select("ordinal", "schema", F.lower("name").alias("low"), qname().alias("q"))
    own = rows.withColumn("parent", F.when(F.col("low").rlike(PARTITION), F.regexp_replace("low", PARTITION, ""))).where(F.col("parent").isNotNull())
    parents = rows.join(copies.select("ordinal"), "ordinal", "left_anti")
    parents = parents.groupBy(F.col("schema").alias("b_schema"), F.col("low").alias("b_low")).agg(F.max_by("q", "ordinal").alias("base"))
    hits = own.join(parents, F.col("schema").eqNullSafe(F.col("b_schema")) & (F.col("parent") == F.col("b_low"))).where("base <> q")
    return hits.select("ordinal", F.lit(2).alias("rule"), "base")


def _backups(objects: DataFrame) -> DataFrame:
    """Backups without a base (G5): the base is the bare stem, in its own case."""
    stem = F.regexp_replace("name", "(?i)" + BACKUP, "")
    return objects.where(F.col("name").rlike("(?i)" + BACKUP) & (stem != "")).select("ordinal", F.lit(3).alias("rule"), stem.alias("base"))


def shadows(objects: DataFrame) -> DataFrame:
    """ordinal and base of each object that is a copy, a partition or a backup; the first rule that finds a base counts."""
    copies = _by_base(objects)
    every = copies.unionByName(_partitions(objects, copies)).unionByName(_backups(objects))
    return every.groupBy("ordinal").agg(F.min(F.struct("rule", "base")).alias("m")).select("ordinal", "m.base", "m.rule")


def expand_roles(direct: DataFrame, graph: DataFrame) -> DataFrame:
    """object and role of all roles that inherit a grant (G7). direct: object, role; graph: role, inheritor.

    One level is joined a round until a round finds nothing new; cycles end as known pairs are dropped.
    Rounds are written as tables, so that plans don't grow; only the emptiness of one comes to the driver.
    """
    links = graph.select(F.col("role").alias("from"), F.col("inheritor").alias("to")).distinct()
    known = front = materialise(direct.select("object", "role").distinct(), "roles")
    while True:
        step = front.join(links, F.col("role") == F.col("from")).select("object", F.col("to").alias("role")).distinct()
        front = materialise(step.join(known, ["object", "role"], "left_anti"), "roles-new")
        if front.isEmpty():
            return known
        known = materialise(known.unionByName(front), "roles")
