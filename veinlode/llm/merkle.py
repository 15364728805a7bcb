"""Merkle manifest of a dataset by nested-struct rollup.

Every row becomes a leaf; per tree (a value of ``key``) the leaves stand in the order of their ids, and consecutive
runs of ``RUN`` nodes are hashed until one node, the subroot, remains; subroots make the root in the same way.

Ranks come from a range partitioning and one count per partition. A rank is split into a block number and ``DIGITS``
digits; inside a block, which holds at most ``RUN ** DIGITS`` nodes whatever the size of a tree, one grouping after
the other takes the lowest digit away and nests the child structs below their parent, without a further shuffle. The
block nodes are the leaves of the next round, so a tree of 10^11 leaves takes seven rounds. On the way back a transform
per level and an explode hand every leaf the siblings of its path; the part of the path above a block meets the block
as one more row of the same grouping. No row, task or driver value holds more than a block; the driver sees one count
per partition and the number of rounds.

Defined cases: a null field is ``-``, and a null n_chars stays null when tampered with; a null id stands first and is
never tampered with; rows that repeat an id (a tie) stand in the order of their leaves, and rows equal in every field
share their leaf while each has a place and a proof of its own; a tree of one leaf has that leaf as subroot, one tree
alone gives its subroot as root; a proof without siblings is the hash of the empty string; texts of any length are
hashed whole; columns other than the five are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinlode.llm.common import forget, stash, table

RUN = 2
DIGITS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of ``fields``, each with its length in bytes, so that no two rows read the same."""
    own = [f.cast("string") for f in fields]
    return digest(*[F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in own])


def ranked(nodes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``nodes`` with ``rank`` (from 0 inside its tree) and ``n``, the nodes of the tree."""
    spark = nodes.sparkSession
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    parts = nodes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    parts = stash(parts.withColumn("at", F.monotonically_increasing_id()), "merkle-ranked")
    part = F.shiftright("at", 33)
    counts = {r.part: r.n for r in parts.groupBy(part.cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per partition
    starts = [0]
    for p in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(p, 0))
    placed = parts.withColumn("at", F.get(F.array(*map(F.lit, starts)).cast("array<bigint>"), part.cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1))
    trees = placed.groupBy(F.col(key).alias("tree_")).agg(F.min("at").alias("first_"), F.count(F.lit(1)).alias("n"))
    both = placed.join(trees, F.col(key).eqNullSafe(F.col("tree_")))
    return both.withColumn("rank", F.col("at") - F.col("first_")).drop("at", "first_", "tree_")


def nest(nodes: DataFrame, key: str, run: int = RUN, digits: int = DIGITS) -> DataFrame:
    """(key, rank, n, node) to one row per block: (key, block, n, node), where node holds its children and n is the
    number of such nodes of the tree. A node is a struct that begins with its hash ``h``."""
    size = lambda i: run**i
    columns = [F.floor(F.col("rank") / size(i)).cast("long") % run for i in range(digits)]
    df = nodes.select(key, F.floor(F.col("rank") / size(digits)).cast("long").alias("block"), *[c.cast("int").alias(f"d{i}") for i, c in enumerate(columns)], "n", "node")
    df = df.repartition(key, "block")
    for i in range(digits):
        left = [key, "block", *[f"d{j}" for j in range(i + 1, digits)]]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{i}").alias("d"), F.col("node"))), lambda a, b: a["d"] - b["d"])
        df = df.groupBy(*left).agg(kids.alias("kids"), F.max("n").alias("n"))
        own, joined = F.transform("kids", lambda x: x["node"]), F.col("n") > 1
        joint = F.sha2(F.array_join(F.transform(own, lambda x: x["h"]), "").cast("binary"), 256)
        node = F.struct(F.when(joined, joint).otherwise(own[0]["h"]).alias("h"), joined.alias("joined"), own.alias("kids"))
        df = df.select(*left, F.ceil(F.col("n") / run).cast("long").alias("n"), node.alias("node"))
    return df


def unnest(blocks: DataFrame, keep: list[str], digits: int = DIGITS) -> DataFrame:
    """(keep, node, steps) to one row per node that was nested: (keep, node, steps), steps from it up to the root."""

    def down(x: Column) -> Column:
        def one(kid: Column, i: Column) -> Column:
            kids = F.transform(x["node"]["kids"], lambda k: k["h"])
            before = F.array_join(F.slice(kids, 1, i), "")
            after = F.array_join(F.slice(kids, i + 2, F.size(kids)), "")
            step = F.when(x["node"]["joined"], F.array(F.struct(before.alias("before"), after.alias("after")))).otherwise(F.array().cast(_STEPS))
            return F.struct(kid.alias("node"), F.concat(step, x["steps"]).alias("steps"))

        return F.transform(x["node"]["kids"], one)

    paths = F.array(F.struct("node", "steps"))
    for _ in range(digits):
        paths = F.flatten(F.transform(paths, down))
    return blocks.select(*keep, F.explode(paths).alias("path")).select(*keep, "path.node", "path.steps")


def rolled(nodes: DataFrame, key: str, run: int, digits: int) -> list[DataFrame]:
    """Rounds of blocks from the leaves up, until every tree is one block."""
    rounds = []
    while True:
        rounds.append(stash(nest(nodes, key, run, digits), "merkle-blocks"))
        if (rounds[-1].agg(F.max("n")).first()[0] or 1) <= 1:
            return rounds
        top = F.struct(F.col("node.h").alias("h"), F.col("block").alias("item"))
        nodes = rounds[-1].select(key, F.col("block").alias("rank"), "n", top.alias("node"))


def traced(rounds: list[DataFrame], key: str, above: DataFrame, keep: list[str], digits: int) -> DataFrame:
    """The leaves of ``rounds`` with their steps up to the root; ``above`` has (key, steps, keep) of the trees."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        empty = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
        own = blocks.select(key, "block", "node", *empty(above, ["steps", *keep]))
        over = above.select(key, "block", *empty(blocks, ["node"]), "steps", *keep)
        met = own.unionByName(over).groupBy(key, "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("node", "steps", *keep)])
        out = unnest(met, [key, *keep], digits)
        above = out.withColumn("block", F.col("node.item")) if blocks is not rounds[0] else out
    return above


def folded(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` leads to."""
    return F.aggregate(steps, leaf, lambda own, s: digest(s["before"], own, s["after"]))


def manifest(leaves: DataFrame, key: str, order: list[str], run: int = RUN, digits: int = DIGITS) -> DataFrame:
    """(key, leaf, order, item) to item, leaf, steps (siblings before and after on every level), subroot and root."""
    leaves = leaves.select(key, *order, "item", *[c for c in ("leaf",) if c not in order])
    lower = ranked(leaves, key, order).select(key, "rank", "n", F.struct(F.col("leaf").alias("h"), F.col("item")).alias("node"))
    rounds = rolled(lower, key, run, digits)
    forget(leaves.sparkSession, lower)
    subroots = rounds[-1].select(F.lit(0).alias("all"), F.col(key).alias("item"), F.col("node.h").alias("h"))
    upper = ranked(subroots, "all", ["item"]).select("all", "rank", "n", F.struct("h", "item").alias("node"))
    upper = rolled(upper, "all", run, digits)
    top = upper[-1].select("all", F.array().cast(_STEPS).alias("steps"), F.col("node.h").alias("root"))
    trees = traced(upper, "all", top, ["root"], digits).select(F.col("node.item").alias(key), "steps", "root", F.col("node.h").alias("subroot"))
    return traced(rounds, key, stash(trees, "merkle-trees"), ["root", "subroot"], digits).select("node.item", F.col("node.h").alias("leaf"), "steps", "subroot", "root")


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaf of every document, and its leaf after tampering (null where it isn't tampered with)."""
    fields = [F.col(c) for c in FIELDS]
    changed = [f if c != "n_chars" else (f.cast("decimal(38,0)") + 1) for c, f in zip(FIELDS, fields)]
    tampered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(), leaf_hash(changed))
    item = F.struct("doc_id", tampered.alias("tampered"))
    # rows that are equal in every field are told apart for the ranges, so that they needn't meet in one of them
    return docs.select("lang", "doc_id", leaf_hash(fields).alias("leaf"), item.alias("item"), F.monotonically_increasing_id().alias("row"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = stash(document_leaves(table(spark, sf_dir, "documents").select(*FIELDS)), "merkle-leaves")
    out = manifest(leaves, "lang", ["doc_id", "leaf", "row"])
    forget(spark, leaves)
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    back = folded(F.coalesce(F.col("item.tampered"), F.col("leaf")), F.col("steps"))
    out = out.select("item.doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS i))
), d AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN NULL ELSE
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) END AS crc
  FROM documents, crc
), f AS (
  SELECT doc_id, lang, crc % 7 = 0 AND n_chars IS NOT NULL AS touched,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n1, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n2,
    coalesce(strlen(text) || ':' || text, '-') AS z
  FROM d
), h AS (
  SELECT doc_id, lang, sha256(a || n1 || z) AS leaf, CASE WHEN touched THEN sha256(a || n2 || z) ELSE sha256(a || n1 || z) END AS changed FROM f
), p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id ASC NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM h
), up AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT lang, level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lang, level, pos // 2
), s AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang ASC NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, n, h FROM s
  UNION ALL
  SELECT level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2
), steps AS (
  SELECT p.doc_id, p.lang, p.pos, u.level, (p.pos >> u.level) & 1 AS side, coalesce(b.h, '') AS h
  FROM p JOIN (SELECT DISTINCT lang, level FROM up WHERE n > 1) u ON p.lang IS NOT DISTINCT FROM u.lang
  LEFT JOIN up b ON b.lang IS NOT DISTINCT FROM p.lang AND b.level = u.level AND b.pos = xor(p.pos >> u.level, 1)
  UNION ALL
  SELECT p.doc_id, p.lang, p.pos, 1000 + u.level, (s.pos >> u.level) & 1, coalesce(b.h, '')
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT DISTINCT level FROM top WHERE n > 1) u ON true
  LEFT JOIN top b ON b.level = u.level AND b.pos = xor(s.pos >> u.level, 1)
), proofs AS (
  SELECT lang, pos, list(h ORDER BY level) AS hs, list(side ORDER BY level) AS sides FROM steps GROUP BY lang, pos
), fold AS (
  SELECT p.lang, p.pos, p.doc_id, p.leaf, q.hs, q.sides, 1 AS k, p.changed AS own FROM p LEFT JOIN proofs q ON p.lang IS NOT DISTINCT FROM q.lang AND p.pos = q.pos
  UNION ALL
  SELECT lang, pos, doc_id, leaf, hs, sides, k + 1, sha256(CASE WHEN sides[k] = 1 THEN hs[k] || own ELSE own || hs[k] END) FROM fold WHERE k <= len(hs)
)
SELECT f.doc_id, f.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(array_to_string(f.hs, ''), '')) AS proof_sha256, f.own AS folded_root, f.own = r.h AS verified
FROM fold f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang, (SELECT h FROM top WHERE n = 1) r
WHERE f.k > coalesce(len(f.hs), 0)
"""
