"""The queries of this package and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubloom.functions.packed import packed_items, whole_number
from hubloom.llm.components import components
from hubloom.llm.lookalike import canonicalize, look_classes, look_pairs
from hubloom.llm.mixing import mix
from hubloom.llm.packing import fill_report, pack, packing_faults
from hubloom.llm.ranking import rank_items
from hubloom.operators.numbering import number_in_order
from hubloom.session import drop_written, table, written

#: Node numbers are vertices from here on, hubs below: a set's smallest vertex is its smallest hub.
NODES_FROM = 2**61
NOTE_NUMBER = r"(?<![\p{L}\p{N}_.])(\d+)(?:\.0*)?(?![\p{L}\p{N}_]|\.\d)"


def hub_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: each hub with its nodes, and the nodes of a note with the note's first.

    A node number is a vertex by its value; those of more than 18 digits, which have no
    room there, by their place among each other.
    """
    hubs = table(spark, sf_dir, "grouped_hubs").where("group_id is not null")
    nodes = F.filter(F.transform(packed_items(F.col("node"), "always"), whole_number), lambda n: n.isNotNull())
    own = hubs.select(F.col("group_id").alias("hub"), F.explode(nodes).alias("n"))
    numbers = F.transform(
        F.regexp_extract_all("nodes_in_group", F.lit(NOTE_NUMBER), F.lit(1)), lambda n: F.regexp_replace(n, "^0+(?=.)", "")
    )
    notes = table(spark, sf_dir, "is_same_group").select(F.array_distinct(numbers).alias("n")).where("size(n) > 1")
    tied = notes.select(F.get("n", F.lit(0)).alias("first"), F.explode("n").alias("n"))
    return numbered_nodes(own, tied)


def numbered_nodes(own: DataFrame, tied: DataFrame) -> DataFrame:
    """a, b of own (hub, n) and tied (first, n), whose n and first are node numbers as digits."""
    long, at = written(own.select("n").unionByName(tied.select("n")).where("length(n) > 18").distinct())
    short = lambda c: F.lit(NODES_FROM) + F.col(c).try_cast("bigint")
    if long.isEmpty():
        drop_written(own.sparkSession, at)
        return own.select(F.col("hub").alias("a"), short("n").alias("b")).unionByName(tied.select(short("first").alias("a"), short("n").alias("b")))
    place = number_in_order(long, "n", name="place").select(F.col("n").alias("long"), (F.lit(NODES_FROM + 2**60) + F.col("place")).alias("v"))
    vertex = lambda c: F.when(F.length(c) <= 18, short(c)).otherwise(F.col("v"))
    numbered = lambda df, c: df.join(place, F.when(F.length(c) > 18, F.col(c)) == F.col("long"), "left").withColumn(c, vertex(c)).drop("long", "v")
    return numbered(own, "n").select(F.col("hub").alias("a"), F.col("n").alias("b")).unionByName(numbered(numbered(tied, "n"), "first").select(F.col("first").alias("a"), F.col("n").alias("b")))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """merged_id for every hub: the smallest group_id of its set, its own if it is alone."""
    found = components(hub_edges(spark, sf_dir)).where(F.col("id") < NODES_FROM)
    hubs = table(spark, sf_dir, "grouped_hubs").where("group_id is not null").select("group_id").distinct()
    return hubs.join(found.select(F.col("id").alias("group_id"), "root"), "group_id", "left").select(
        "group_id", F.coalesce("root", "group_id").alias("merged_id")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hub that belongs together with at least one other."""
    hubs = components(hub_edges(spark, sf_dir)).where(F.col("id") < NODES_FROM)
    under = hubs.where("id <> root").select(F.col("id").alias("group_id"), F.col("root").alias("merged_id"))
    seeds = under.select(F.col("merged_id").alias("group_id")).distinct()
    return under.unionByName(seeds.withColumn("merged_id", F.col("group_id")))


def p3_criteria_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All criteria in one order, with strengths."""
    votes, criteria = table(spark, sf_dir, "ahp_expert_comparisons"), table(spark, sf_dir, "ahp_criteria")
    return rank_items(votes, criteria, "criterion", "criterion_a", "criterion_b", "value", "expert")


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece of one."""
    return pack(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    return fill_report(pack(table(spark, sf_dir, "documents")))


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers over a capacity and documents not packed whole: none of either."""
    docs = table(spark, sf_dir, "documents")
    return packing_faults(pack(docs), docs)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source really got."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]


def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in one form."""
    return canonicalize(table(spark, sf_dir, "documents")).select("doc_id", "canonical", "look_hash")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose texts look the same but aren't the same characters."""
    return look_pairs(canonicalize(table(spark, sf_dir, "documents")))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The looks that several texts have, a row each: what p8_found pairs, without the pairs."""
    return look_classes(canonicalize(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {f.__name__: f for f in (p3_criteria_ranking, p5_found, p5_groups, p6_packing, p6_fill, p6_faults, p7_mixture, p7_shares, p8_found, p8_classes, p8_canonical)}


#: The transitive closure, by recursion.
P5_SQL = r"""WITH RECURSIVE hn AS (SELECT DISTINCT group_id AS a, (unnest(regexp_extract_all(node, '(?:^|[^0-9A-Za-z_.])(\d+)', 1)))::BIGINT + 2305843009213693952 AS b FROM grouped_hubs WHERE group_id IS NOT NULL),
  nn AS (SELECT row_id, (unnest(regexp_extract_all(nodes_in_group, '(?:^|[^0-9A-Za-z_.])(\d+)', 1)))::BIGINT + 2305843009213693952 AS v FROM is_same_group),
  nt AS (SELECT DISTINCT x.first AS a, nn.v AS b FROM nn JOIN (SELECT row_id, min(v) AS first FROM nn GROUP BY 1) x USING (row_id) WHERE nn.v <> x.first),
  e AS (SELECT a, b FROM hn UNION SELECT b, a FROM hn UNION SELECT a, b FROM nt UNION SELECT b, a FROM nt),
  reach(id, v) AS (SELECT DISTINCT a, a FROM hn UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.v),
  g AS (SELECT id, min(v) AS merged_id, count(*) FILTER (v < 2305843009213693952) AS n FROM reach GROUP BY id)
  SELECT id AS group_id, merged_id FROM g WHERE n > 1"""


def oracle_sql() -> dict[str, str]:
    alone = P5_SQL.replace("WHERE n > 1", "UNION SELECT group_id, group_id FROM grouped_hubs WHERE group_id IS NOT NULL AND group_id NOT IN (SELECT id FROM reach)")
    none = "SELECT count(*) AS documents, 0::BIGINT AS over_tokens, 0::BIGINT AS over_docs, 0::BIGINT AS over_attention, 0::BIGINT AS not_whole FROM documents"
    return {"p5_found": P5_SQL, "p5_groups": alone, "p6_faults": none}
