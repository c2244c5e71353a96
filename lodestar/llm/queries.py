"""The pN_ queries of this subpackage and, where SQL can say the same, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import canon, lines, neardup, packing, terms, tokens, truncation
from lodestar.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of log rows that repeat one another with small changes."""
    pairs = neardup.near_pairs(table(spark, sf_dir, "youtube_items"))
    return pairs.select(F.col("id_a").alias("log_id_a"), F.col("id_b").alias("log_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's class of equal shingle sets, its links, and its group of linked classes."""
    return neardup.near_groups(table(spark, sf_dir, "youtube_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description lines that a channel repeats, to be removed."""
    return lines.removable(table(spark, sf_dir, "youtube_items"), "log_id", "channel_title", "description")


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every description without its channel's repeated lines."""
    items = table(spark, sf_dir, "youtube_items").select("log_id", "channel_title", "description")
    return lines.without_frequent(items, "log_id", "channel_title", "description").select("log_id", "description")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, occurrences, records and mark of every term."""
    items = table(spark, sf_dir, "youtube_items")
    return terms.mark_terms(terms.term_counts(items), items.count()).select("term", "term_id", "occurrences", "records", "mark")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that are too rare or too common."""
    return p3_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("term", "mark")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gazetteer key that each playlist and item title names."""
    lists, items, gazetteer = (table(spark, sf_dir, t) for t in ("playlist_resolved", "youtube_items", "gazetteer"))
    values = lists.select(F.lit("playlist").alias("record_kind"), F.col("playlist_id").alias("record_id"), F.col("title").alias("value"))
    values = values.unionByName(items.select(F.lit("item").alias("record_kind"), F.col("log_id").alias("record_id"), F.col("title").alias("value")))
    names = gazetteer.select(F.col("place_name").alias("name"), F.col("place_key").alias("key"))
    names = names.unionByName(gazetteer.select(F.col("place_key").alias("name"), F.col("place_key").alias("key")))
    aliases = table(spark, sf_dir, "place_aliases").join(gazetteer.select("place_key"), "place_key", "left_semi")
    names = names.unionByName(aliases.select(F.col("alias").alias("name"), F.col("place_key").alias("key")))
    states = gazetteer.where("kind = 'state'").select(F.col("place_name").alias("state_name"), F.col("place_key").alias("region"))
    regions = gazetteer.where("kind = 'city'").select("place_key", "state_name").join(states, "state_name").select(F.col("place_key").alias("key"), "region")
    return canon.map_values(values, names, regions).withColumnRenamed("key", "place_key")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document's text."""
    return tokens.encode(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    sizes = tokens.count(table(spark, sf_dir, "documents"))
    return packing.pack(sizes, "doc_id", "n_tokens", 2048)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are, what they hold, and the share of room unused."""
    held = p8_containers(spark, sf_dir).where("size > 0").groupBy("container_id").agg(F.sum("size").alias("held"))
    out = held.agg(F.count("*").alias("containers"), F.sum("held").alias("tokens"), F.max("held").alias("fullest"))
    return out.withColumn("unused", F.round(1 - F.col("tokens") / (F.col("containers") * 2048), 6))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text breaks off."""
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut texts of each source."""
    return truncation.by_source(table(spark, sf_dir, "documents"))


_LINES = r"""l AS (SELECT log_id, channel_title, unnest(string_split(description, chr(10))) AS line,
    generate_subscripts(string_split(description, chr(10)), 1) AS line_no
  FROM youtube_items WHERE description IS NOT NULL AND channel_title IS NOT NULL),
k AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS key FROM l),
n AS (SELECT channel_title, count(*) AS total FROM youtube_items WHERE description IS NOT NULL GROUP BY 1),
f AS (SELECT k.channel_title, key FROM k JOIN n ON k.channel_title = n.channel_title WHERE length(key) >= 12
  GROUP BY k.channel_title, key, total HAVING count(DISTINCT log_id) >= 5 AND count(DISTINCT log_id) >= 0.08 * total),
hit AS (SELECT k.log_id, k.line_no FROM k JOIN f ON k.channel_title = f.channel_title AND k.key = f.key)"""

_TERMS = """w AS (SELECT log_id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[a-z0-9]+')) AS term
  FROM youtube_items),
t AS (SELECT term, count(*) AS occurrences, count(DISTINCT log_id) AS records FROM w WHERE length(term) >= 2 GROUP BY 1),
m AS (SELECT *, CASE WHEN occurrences < 5 OR records < 3 THEN 'rare'
  WHEN records > 0.15 * (SELECT count(*) FROM youtube_items) THEN 'common' END AS mark FROM t)"""

QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_cleaned": p2_cleaned, "p3_found": p3_found, "p3_terms": p3_terms,
    "p6_found": p6_found, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_sources": p9_sources,
}
SQL = {
    "p1_found": """WITH w AS (SELECT log_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[a-z0-9]+') AS w
  FROM youtube_items),
s AS (SELECT DISTINCT log_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM w WHERE len(w) >= 20),
n AS (SELECT log_id, count(*) AS n FROM s GROUP BY 1),
j AS (SELECT a.log_id AS log_id_a, b.log_id AS log_id_b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.log_id < b.log_id GROUP BY 1, 2)
SELECT log_id_a, log_id_b FROM j JOIN n na ON na.log_id = log_id_a JOIN n nb ON nb.log_id = log_id_b
WHERE shared / (na.n + nb.n - shared) >= 0.6""",
    "p1_groups": """WITH RECURSIVE w AS (SELECT log_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[a-z0-9]+') AS w FROM youtube_items),
s AS (SELECT DISTINCT log_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
k AS (SELECT log_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS key FROM s GROUP BY 1),
c AS (SELECT key, min(log_id) AS class_id, any_value(n) AS n FROM k GROUP BY 1),
cs AS (SELECT class_id, n, g FROM s JOIN c ON s.log_id = class_id),
j AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) AS total FROM cs a JOIN cs b ON a.g = b.g AND a.class_id < b.class_id GROUP BY 1, 2),
e AS (SELECT a, b FROM j WHERE shared / (total - shared) >= 0.6), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, root) AS (SELECT class_id, class_id FROM c UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
t AS (SELECT node, min(root) AS group_id FROM r GROUP BY 1), l AS (SELECT a, count(*) AS links FROM u GROUP BY 1)
SELECT k.log_id, c.class_id, coalesce(links, 0) AS links, group_id FROM k JOIN c ON c.key = k.key JOIN t ON t.node = c.class_id LEFT JOIN l ON l.a = c.class_id""",
    "p2_found": f"WITH {_LINES} SELECT log_id, line_no::INTEGER AS line_no FROM hit",
    "p2_cleaned": f"""WITH {_LINES},
kept AS (SELECT i.log_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS d FROM youtube_items i
  JOIN (SELECT log_id, unnest(string_split(description, chr(10))) AS line,
    generate_subscripts(string_split(description, chr(10)), 1) AS line_no FROM youtube_items) l ON l.log_id = i.log_id
  WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.log_id = l.log_id AND hit.line_no = l.line_no) GROUP BY 1)
SELECT i.log_id, CASE WHEN i.description IS NULL THEN NULL ELSE coalesce(kept.d, '') END AS description
FROM youtube_items i LEFT JOIN kept ON kept.log_id = i.log_id""",
    "p3_found": f"WITH {_TERMS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p3_terms": f"WITH {_TERMS} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, occurrences, records, mark FROM m",
}
