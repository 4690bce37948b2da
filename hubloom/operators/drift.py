"""Schemas that drift between files: one typed table, a rescue column, a list of changes.

Records come as JSON objects whose keys differ from file to file.

1. `enforce` fills the target schema from the keys whose spelling is configured
   (`Field.aliases`). Whatever it doesn't use, unknown keys and values that can't be cast
   alike, stays in ``rescued`` as JSON.
2. `learn` finds the target fields of rescued keys by their values: a key is a field's
   where, node by node, its values follow those that the feed has under that field in
   other files. A spelling so approved in several feeds is approved for all.
3. `promote` moves the rescued values of approved keys into the typed columns; it and
   `learn` take turns until nothing new is approved. `replay` moves values by key alone.
4. `schema_changes` reads the promoted table and compares each file with the one before.

A key's value is in exactly one place, its typed column or ``rescued``. Only a field's
parts, which add up to it, share a column, and only if all are there and numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubloom.session import drop_written, written


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    aliases: tuple[str, ...]  # lower case, without blanks, underscores and hyphens; the first there is counts
    parts: tuple[str, ...] = ()  # columns that add up to the field, likewise


# The demand sheets' columns as the regional models name them.
DEMAND_FIELDS = (
    Field("node", "bigint", ("node", "nodeid", "id", "modelnode")),
    Field("boardings_daily", "double", ("boardingsdaily", "boardings", "on", "totalboardings", "initialboardings", "dailyboard2050")),
    Field("alightings_daily", "double", ("alightingsdaily", "alightings", "off", "totalalight", "finalalight", "dailyalight2050")),
    Field("totaltransfers", "double", ("totaltransfers", "transfers"), ("transferboardings", "transferalight")),
)
#: A key is a field's where at least this share of its values lies within this distance of the field's usual value for the node.
SHARE, DISTANCE = 0.6, 0.15
#: A spelling is approved for every feed once it is by its values in so many of them, and in no other sense.
FEEDS = 2
KINDS = ("whole", "point", "string", "boolean", "nested")
_ENTRIES = "map<string,variant>"


def plain(key: Column) -> Column:
    return F.translate(F.lower(key), " \t\n\x0b\f\r_-", "")


def _by_name(plain_key: Column, fields: tuple[Field, ...]) -> Column:
    known = {a: f.name for f in fields for a in f.aliases + f.parts}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), plain_key)


def _digits(text: Column) -> Column:
    """A number's text without thousands separators; null if it is none. A comma counts only before three digits."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t).when(
        t.rlike(r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d*)?$"), F.replace(t, F.lit(","), F.lit(""))
    )


def _whole(digits: Column) -> Column:
    """Exact to the last digit. Modulo by one: a zero decimal part changes nothing."""
    return F.when(digits.try_cast("decimal(38,9)") % 1 == 0, digits.try_cast("decimal(38,9)").try_cast("bigint"))


def number(text: Column) -> Column:
    """A number written with or without thousands separators; null if it is none, or ambiguous as 12,5 is."""
    return _digits(text).try_cast("double")


def whole(text: Column) -> Column:
    """A whole number; null if it is none."""
    return _whole(_digits(text))


CASTS = {"string": lambda s: s, "double": number, "bigint": whole}


def _text(v: Column) -> Column:
    return F.call_function("try_variant_get", v, F.lit("$"), F.lit("string"))


def _kind(shape: Column, text: Column) -> Column:
    return (
        F.when((shape == "VOID") | text.isin("NaN", "Infinity", "-Infinity"), F.lit(None))
        .when(shape == "STRING", "string")
        .when(shape == "BIGINT", "whole")
        .when(shape.startswith("DECIMAL"), F.when(shape.rlike(r"^DECIMAL\((?:19|[23]\d),0\)"), "whole").otherwise("point"))
        .when(shape.isin("DOUBLE", "FLOAT"), "point")
        .when(shape == "BOOLEAN", "boolean")
        .otherwise("nested")
    )


def _of(name: str):
    return lambda e: F.coalesce(e["field"] == name, F.lit(False))


def _json(left: Column) -> Column:
    return F.when(F.size(left) > 0, F.to_json(left))


def enforce(records: DataFrame, fields: tuple[Field, ...] = DEMAND_FIELDS) -> DataFrame:
    """record_id, file_id, line_no, one typed column for each field, rescued, origin.

    Of a field's spellings in one record the first of `Field.aliases` that can be cast
    counts; parts are added where no spelling can, all of them are there, and all can be
    cast. Everything else stays in ``rescued``, a JSON object, null where nothing is left;
    a body that is no JSON object is rescued whole under ``_body``. origin: every key with
    the kind of its literal (null of JSON null and NaN) and its field, if it has one.
    """
    parts = [a for f in fields for a in f.parts]
    df = records.select("record_id", "file_id", "line_no", "body", F.from_json("body", _ENTRIES).alias("_m"))
    # in steps, as an expression inside an array's is worked out each time it is named
    df = df.withColumn("_e", F.transform(F.map_entries("_m"), lambda e: F.struct(
        e["key"].alias("key"), plain(e["key"]).alias("plain"), F.call_function("schema_of_variant", e["value"]).alias("shape"), _text(e["value"]).alias("text")
    )))
    df = df.withColumn("_e", F.transform("_e", lambda e: F.struct(e["key"].alias("key"), e["plain"].alias("plain"), _by_name(e["plain"], fields).alias("field"), _kind(e["shape"], e["text"]).alias("kind"), e["text"].alias("text"))))
    mine = F.filter("_e", lambda e: e["field"].isNotNull() & e["kind"].isNotNull())
    df = df.withColumn("_f", F.transform(mine, lambda e: F.struct(e["key"].alias("key"), e["plain"].alias("plain"), e["field"].alias("field"), _digits(e["text"]).alias("digits"), e["text"].alias("text"))))
    casts = {"string": lambda e: e["text"], "double": lambda e: e["digits"].try_cast("double"), "bigint": lambda e: _whole(e["digits"])}
    picks = {}
    for f in fields:
        cast = casts[f.type]
        place = F.array(*map(F.lit, f.aliases))
        spelled = F.transform(
            F.filter("_f", lambda e: _of(f.name)(e) & ~e["plain"].isin(parts)), lambda e: F.struct(F.array_position(place, e["plain"]).alias("at"), e["key"].alias("key"), cast(e).alias("v"))
        )
        picks[f"_{f.name}"] = F.array_min(F.filter(spelled, lambda e: e["v"].isNotNull()))
        if f.parts:
            picks[f"_{f.name}_parts"] = F.transform(F.filter("_f", lambda e: e["plain"].isin(*f.parts)), lambda e: F.struct(e["key"].alias("key"), e["plain"].alias("plain"), cast(e).alias("v")))
    df = df.withColumns(picks)
    picks = {}
    for f in fields:
        best = F.col(f"_{f.name}")
        picks[f"_{f.name}"] = F.when(best.isNotNull(), F.struct(best["v"].alias("v"), F.array(best["key"]).alias("keys")))
        if f.parts:
            of = F.col(f"_{f.name}_parts")
            all_there = (F.size(of) == len(f.parts)) & (F.size(F.array_distinct(of["plain"])) == len(f.parts)) & F.forall(of, lambda e: e["v"].isNotNull())
            total = F.aggregate(of["v"], F.lit(0).cast(f.type), lambda a, v: (a + v).cast(f.type))
            picks[f"_{f.name}"] = F.coalesce(picks[f"_{f.name}"], F.when(all_there, F.struct(total.alias("v"), of["key"].alias("keys"))))
    df = df.withColumns(picks)
    used = F.flatten(F.array_compact(F.array(*(F.col(p)["keys"] for p in picks))))
    rescued = F.when(F.col("_m").isNull() & F.col("body").isNotNull(), F.to_json(F.struct(F.col("body").alias("_body")))).otherwise(
        _json(F.map_filter("_m", lambda k, v: ~F.array_contains(used, k)))
    )
    origin = F.transform("_e", lambda e: F.struct(e["key"].alias("key"), e["field"].alias("field"), e["kind"].alias("kind")))
    return df.select("record_id", "file_id", "line_no", *(F.col(f"_{f.name}")["v"].alias(f.name) for f in fields), rescued.alias("rescued"), origin.alias("origin"))


def promote(table: DataFrame, approved: DataFrame | None, fields: tuple[Field, ...] = DEMAND_FIELDS) -> DataFrame:
    """`enforce`'s table with the rescued values of approved keys in their fields' columns. approved: file_id, key, field.

    A value that can't be cast, or whose column is filled already, stays rescued. A field
    has one approved key in a file at most.
    """
    if approved is None:
        return table
    plan = approved.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "key"))).alias("_plan"))
    df = table.join(plan, "file_id", "left").withColumn("_m", F.when(F.col("_plan").isNotNull(), F.from_json("rescued", _ENTRIES)))
    to = {}
    for f in fields:
        key = F.try_element_at("_plan", F.lit(f.name))
        value = CASTS[f.type](_text(F.try_element_at("_m", key)))
        to[f"_to_{f.name}"] = F.when(F.col(f.name).isNull() & value.isNotNull(), F.struct(key.alias("key"), value.alias("v")))
    df = df.withColumns(to).withColumn("_gone", F.array_compact(F.array(*(F.col(c)["key"] for c in to))))
    kept = F.when(F.size("_gone") > 0, _json(F.map_filter("_m", lambda k, v: ~F.array_contains("_gone", k)))).otherwise(F.col("rescued"))
    out = [F.coalesce(F.col(f.name), F.col(f"_to_{f.name}")["v"]).alias(f.name) for f in fields]
    named = F.map_from_entries(F.transform(F.map_entries("_plan"), lambda e: F.struct(e["value"], e["key"])))
    origin = F.transform("origin", lambda o: F.struct(o["key"].alias("key"), F.coalesce(o["field"], F.try_element_at(named, o["key"])).alias("field"), o["kind"].alias("kind")))
    return df.select("record_id", "file_id", "line_no", *out, kept.alias("rescued"), F.when(F.col("_plan").isNull(), F.col("origin")).otherwise(origin).alias("origin"))


def _known(files: DataFrame) -> DataFrame:
    whole_row = F.col("file_id").isNotNull() & F.col("feed_id").isNotNull() & F.col("released").isNotNull()
    return files.where(whole_row).select("file_id", "feed_id", "released").distinct()


def learn(
    table: DataFrame, files: DataFrame, fields: tuple[Field, ...] = DEMAND_FIELDS, share: float = SHARE, distance: float = DISTANCE, feeds: int = FEEDS
) -> tuple[DataFrame, DataFrame]:
    """Rescued keys that have a field after all: file_id, key, field of those found by their values, and of those by their spelling.

    table: of `enforce` or `promote`. The first field numbers the places, the others are
    quantities there. A file's field has one key at most, the one that follows it best,
    and a key one field. Only files that lack a field are looked into: by values for what
    their feed has in other files, by spelling for what it has in none.
    """
    spark, node, rest = table.sparkSession, fields[0].name, [f.name for f in fields[1:]]
    t = table.join(_known(files).select("file_id", "feed_id"), "file_id")
    has = t.groupBy("feed_id", "file_id").agg(*(F.max(F.exists("origin", _of(f.name))).alias(f.name) for f in fields))
    anywhere = W.partitionBy("feed_id")
    own = lambda keep: F.array_compact(F.array(*(F.when(~F.col(f.name) & keep(f.name), f.name) for f in fields)))
    lack = has.select("feed_id", "file_id", own(lambda n: F.max(n).over(anywhere)).alias("lacks"), own(lambda n: ~F.max(n).over(anywhere)).alias("strange")).where("size(lacks) + size(strange) > 0")
    unknown = t.join(lack, ["feed_id", "file_id"]).select(
        "feed_id", "file_id", "record_id", "lacks", "strange", F.col(node).alias("node"), F.from_json("rescued", _ENTRIES).alias("_m"),
        F.explode(F.transform(F.filter("origin", lambda o: o["field"].isNull()), lambda o: o["key"])).alias("key"),
    )
    text = _text(F.try_element_at("_m", F.col("key")))
    unknown, unknown_at = written(unknown.select("feed_id", "file_id", "record_id", "lacks", "strange", "node", "key", number(text).alias("v"), whole(text).alias("place")))
    # the places of the feeds that are asked about, and what they usually have there
    seen = t.join(unknown.where("size(lacks) > 0").select("feed_id").distinct(), "feed_id", "left_semi").where(F.col(node).isNotNull())
    usual = seen.groupBy("feed_id", F.col(node).alias("place")).agg(*(F.percentile_approx(n, 0.5).alias(n) for n in rest), F.lit(1).alias("hit"))
    tried = unknown.where(F.array_contains("lacks", node) & F.col("place").isNotNull())
    hits = tried.join(usual.select("feed_id", "place", "hit"), ["feed_id", "place"], "left").groupBy("feed_id", "file_id", "key").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    nodes = hits.where(F.col("share") >= share).groupBy("feed_id", "file_id").agg(F.min(F.struct((-F.col("share")).alias("s"), "key"))["key"].alias("node_key"))
    is_node = F.coalesce(F.col("key") == F.col("node_key"), F.lit(False))
    keyed = unknown.join(nodes, ["feed_id", "file_id"], "left").withColumn("is_node", is_node)
    found = keyed.where("is_node and place is not null").groupBy("file_id", "record_id").agg(F.min("place").alias("found"))
    at = keyed.join(found, ["file_id", "record_id"], "left").withColumn("place", F.coalesce("node", "found")).join(usual, ["feed_id", "place"], "left")
    fits = []
    for n in rest:
        off = F.when(F.array_contains("lacks", n) & ~F.col("is_node"), F.abs(F.col("v") - F.col(n)))
        fits.append(F.struct(F.avg((off <= distance * F.abs(F.col(n))).cast("int")).alias("share"), (-F.avg(off)).alias("near"), F.lit(n).alias("field")))
    columns = at.groupBy("feed_id", "file_id", "key", "strange", "is_node").agg(F.array_max(F.filter(F.array(*fits), lambda f: f["share"] >= share)).alias("fit"))
    field = F.when(F.col("is_node"), F.lit(node)).otherwise(F.col("fit.field"))
    columns = columns.select("feed_id", "file_id", "key", "strange", field.alias("field"), F.row_number().over(W.partitionBy("file_id", field).orderBy(F.desc("fit.share"), F.desc("fit.near"), "key")).alias("n"))
    columns, _ = written(columns.withColumn("field", F.when(F.col("n") == 1, F.col("field"))).drop("n"))
    drop_written(spark, unknown_at)
    by_values = columns.where("field is not null")
    # spellings that are one field's wherever values could tell
    agreed = by_values.groupBy(plain(F.col("key")).alias("plain")).agg(F.min("field").alias("field"), F.max("field").alias("other"), F.countDistinct("feed_id").alias("n"))
    agreed = agreed.where((F.col("field") == F.col("other")) & (F.col("n") >= feeds)).select("plain", "field")
    loose = columns.where("field is null and size(strange) > 0").withColumn("plain", plain(F.col("key"))).drop("field")
    loose = loose.join(agreed, "plain").where(F.array_contains("strange", F.col("field"))).groupBy("file_id", "field").agg(F.min("key").alias("key"))
    return by_values.select("file_id", "key", "field"), loose.select("file_id", "key", "field")


def ingest(records: DataFrame, files: DataFrame, fields: tuple[Field, ...] = DEMAND_FIELDS) -> tuple[DataFrame, DataFrame]:
    """All records as one typed table with ``rescued`` and ``origin``, and the approved keys: file_id, key, field.

    Where a spelling makes a field known to a feed that had it in no file, the feed's
    other keys are asked once more, until no spelling is new. Records of files that
    `files` doesn't know are typed by spelling only.
    """
    table, _ = written(enforce(records, fields))
    approved = None
    while True:
        by_values, by_spelling = learn(promote(table, approved, fields), files, fields)
        approved = by_values if approved is None else approved.unionByName(by_values)
        by_spelling, _ = written(by_spelling)
        if by_spelling.isEmpty():
            return promote(table, approved, fields), approved
        approved = approved.unionByName(by_spelling)


def schema_changes(table: DataFrame, files: DataFrame, fields: tuple[Field, ...] = DEMAND_FIELDS) -> DataFrame:
    """file_id, field, change_kind: each file against the one released before it in its feed.

    table: of `ingest`. A key without a field is a field of its own, named by its
    lower-case name. Kinds: added, removed, renamed (other keys), retyped (another kind
    for most non-null literals), split and merged (a field's parts in place of it, or the
    reverse; such a change is neither a rename nor a change of type). A feed's first file
    has no changes. A file without records has no columns. Files are in order of release
    time, then id; those without a feed or release time are left out.
    """
    parts = [a for f in fields for a in f.parts]
    keys = table.select("file_id", F.explode("origin").alias("o")).groupBy("file_id", "o.key", F.coalesce("o.field", F.lower("o.key")).alias("field")).agg(
        *(F.count(F.when(F.col("o.kind") == k, 1)).alias(k) for k in KINDS)
    )
    most = F.array_max(F.array(*(F.struct(F.sum(k).alias("n"), F.lit(k).alias("k")) for k in KINDS)))
    per_field = keys.groupBy("file_id", "field").agg(F.struct(F.sort_array(F.collect_set("key")).alias("keys"), F.max(plain(F.col("key")).isin(parts)).alias("parts"), most.alias("most")).alias("now"))
    per_field, _ = written(per_field)
    order = W.partitionBy("feed_id").orderBy("released", "file_id")
    steps = _known(files).select("file_id", F.lag("file_id").over(order).alias("before")).where(F.col("before").isNotNull())
    now = steps.join(per_field, "file_id").select("file_id", "field", "now")
    then = steps.join(per_field.select(F.col("file_id").alias("before"), "field", F.col("now").alias("then")), "before").select("file_id", "field", "then")
    new, old = F.col("now"), F.col("then")
    turned = new["parts"] != old["parts"]
    retyped = (new["most"]["n"] > 0) & (old["most"]["n"] > 0) & (new["most"]["k"] != old["most"]["k"])
    cases = F.array_compact(F.array(
        F.when(old.isNull(), "added"), F.when(new.isNull(), "removed"), F.when(turned & new["parts"], "split"), F.when(turned & old["parts"], "merged"),
        F.when(~turned & (new["keys"] != old["keys"]), "renamed"), F.when(~turned & retyped, "retyped"),
    ))
    return now.join(then, ["file_id", "field"], "full").select("file_id", "field", F.explode(cases).alias("change_kind"))


def replay(table: DataFrame, approved: dict[str, tuple[str, str]]) -> DataFrame:
    """Moves approved keys out of ``rescued``, whatever their file. approved: key -> (column, type: string, double or bigint).

    A value that can't be cast stays rescued, as does one whose column is filled already.
    """
    df = table.withColumn("_m", F.from_json("rescued", _ENTRIES))
    for i, (key, (name, kind)) in enumerate(approved.items()):
        value = CASTS[kind](_text(F.try_element_at("_m", F.lit(key))))
        filled = F.col(name) if name in df.columns else F.lit(None)
        was = F.when(filled.isNull() & value.isNotNull(), F.lit(key))
        df = df.withColumn(f"_to_{name}", F.coalesce(filled, value)).withColumn(f"_was_{i}", was)
        df = df.withColumn(name, F.col(f"_to_{name}")).drop(f"_to_{name}")
    df = df.withColumn("_gone", F.array_compact(F.array(*(F.col(f"_was_{i}") for i in range(len(approved))))))
    kept = F.when(F.size("_gone") > 0, _json(F.map_filter("_m", lambda k, v: ~F.array_contains("_gone", k)))).otherwise(F.col("rescued"))
    return df.withColumn("rescued", kept).drop("_m", "_gone", *(f"_was_{i}" for i in range(len(approved))))


def drift(records: DataFrame, files: DataFrame, fields: tuple[Field, ...] = DEMAND_FIELDS) -> tuple[DataFrame, DataFrame]:
    """The typed table and the changes."""
    table, _ = ingest(records, files, fields)
    return table, schema_changes(table, files, fields)
