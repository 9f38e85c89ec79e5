"""Merkle manifest of a table: nested-struct rollup of rank digits within blocks, proofs by transform and explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somnia.operators.ordered import ranked

from .common import CRC_TABLE, crc_sql, written

#: Children of a node.
FAN = 3
#: Levels that one row nests: FAN ** LEVELS nodes at most.
LEVELS = 6


def field(name: str) -> Column:
    """One value as text that can be told from its neighbours: ``-`` for NULL, else byte count, ``:``, value."""
    text = F.col(name).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of texts written one after the other."""
    return F.sha2(F.concat(*parts), 256)


def _roll(nodes: DataFrame, key: str, tier: int) -> DataFrame:
    """Blocks of ``nodes`` (key, n, pos, hash, kid): key, n, block, hash and the nodes nested in ``kids``, written.

    The digits of the position to base FAN are columns; each grouping drops the lowest one left and nests the nodes that
    differ in it. All groupings follow one shuffle on (key, block). ``n`` is the number of leaves of the tree: a level that
    it does not have hands its only node on.
    """
    digits = [f"d{j}" for j in range(LEVELS)]
    pos = F.col("pos")
    frame = nodes.select(key, "n", F.floor(pos / FAN ** LEVELS).cast("long").alias("block"), "hash", "kid",
                         *[(F.floor(pos / FAN ** j) % FAN).cast("int").alias(d) for j, d in enumerate(digits)])
    frame, kid = frame.repartition(key, "block"), "kid"
    for j, d in enumerate(digits):
        frame = frame.groupBy(key, "n", "block", *digits[j + 1:]).agg(F.sort_array(F.collect_list(F.struct(d, "hash", kid))).alias("kids"))
        whole = F.sha2(F.array_join("kids.hash", ""), 256)
        frame, kid = frame.withColumn("hash", F.when(F.col("n") > FAN ** (tier * LEVELS + j), whole).otherwise(F.col("kids")[0]["hash"])), "kids"
    return written(frame.select(key, "n", "block", "hash", "kids"))


def _nodes(kids: Column, level: int, tier: int, above: Column) -> Column:
    """All nodes of a block as (kid, steps): what stands left and right of the path at each level up to the root."""

    def one(node, i):
        step = F.struct(F.array_join(F.slice(kids["hash"], 1, i), "").alias("left"),
                        F.array_join(F.slice(kids["hash"], i + 2, FAN), "").alias("right"))
        exists = F.col("n") > FAN ** (tier * LEVELS + level)
        steps = F.when(exists, F.concat(F.array(step), above)).otherwise(above)
        if level:
            return _nodes(node["kids"], level - 1, tier, steps)
        return F.struct(node["hash"].alias("hash"), node["kid"].alias("kid"), steps.alias("steps"))

    nested = F.transform(kids, one)
    return F.flatten(nested) if level else nested


def _paths(blocks: DataFrame, tops: DataFrame, key: str, tier: int) -> DataFrame:
    """Nodes of ``blocks`` with the steps up to the root, and what ``tops`` (key, block, top) knows of each block.

    Blocks meet their tops by union and grouping, so there is no join.
    """
    both = blocks.drop("hash").unionByName(tops, allowMissingColumns=True)
    met = both.groupBy(key, "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "top")])
    out = met.select(key, "block", "top", F.explode(_nodes(F.col("kids"), LEVELS - 1, tier, F.col("top.steps"))).alias("node"))
    return out.select(key, "top.subroot", "top.root", "node.*")


def _tree(leaves: DataFrame, key: str, most: int) -> list[DataFrame]:
    """Blocks of every tier over ``leaves`` (key, n, pos, hash, kid), until each key has one."""
    tiers, held = [], 1
    while not tiers or held < most:
        if tiers:
            leaves = tiers[-1].select(key, "n", F.col("block").alias("pos"), "hash", F.col("block").alias("kid"))
        tiers.append(_roll(leaves, key, len(tiers)))
        held *= FAN ** LEVELS
    return tiers


def _down(tiers: list[DataFrame], key: str, tops: DataFrame) -> DataFrame:
    """Leaves with their paths, from the tops (key, top) of the trees downwards."""
    tops = tops.withColumn("block", F.lit(0).cast("long"))
    for tier in range(len(tiers) - 1, 0, -1):
        found = _paths(tiers[tier], tops, key, tier)
        tops = found.select(key, F.col("kid").alias("block"), F.struct("steps", "subroot", "root").alias("top"))
    return _paths(tiers[0], tops, key, 0)


def manifest(docs: DataFrame, leaf: Column, now: Column | None = None, id_col: str = "doc_id", group: str = "source") -> DataFrame:
    """One row per row of ``docs``: id_col, leaf, subroot, root, steps, folded_root, verified.

    The leaves of a group ascend by id, equal ids by their digest; every FAN consecutive nodes become one, a lone one at
    the end too, until one is left, the group's subroot. Subroots in the order of their groups (NULL first, then by bytes)
    give the root in the same way. ``steps`` is the proof: for each level from the leaf to the root the digests left and
    right of the path, as text. ``folded_root`` follows from ``now``, the digest of the row as it is found today (``leaf``
    where that is NULL or not given), and the original steps; ``verified`` says whether it is the root.

    A group may hold most of the rows: positions come from a range shuffle, and no row nests more than FAN ** LEVELS nodes.
    Repeated rows are leaves of their own; a NULL id comes first in its group, a NULL group is a group; an empty table has
    no rows. Columns not named here are ignored, whatever they are called.
    """
    held = docs.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), leaf.alias("hash"), (now if now is not None else F.lit(None).cast("string")).alias("now"))
    held = ranked(written(held), ["grp"], [F.col("id").asc_nulls_first(), F.col("hash"), F.col("now").asc_nulls_first()], "pos", "n")
    leaves = written(held.select("grp", "n", "pos", "hash", F.struct("id", "now").alias("kid")))
    trees = _tree(leaves, "grp", leaves.agg(F.max("n")).first()[0] or 1)
    groups = ranked(trees[-1].select("grp", "hash"), [], [F.col("grp").asc_nulls_first()], "pos", "n")
    groups = written(groups.select(F.lit(0).alias("all"), "n", "pos", "hash", F.struct("grp").alias("kid")))
    top = _tree(groups, "all", groups.agg(F.max("n")).first()[0] or 1)
    none = F.array().cast("array<struct<left:string,right:string>>")
    roots = _down(top, "all", top[-1].select("all", F.struct(none.alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")).alias("top")))
    tops = roots.select("kid.grp", F.struct("steps", F.col("hash").alias("subroot"), "root").alias("top"))
    folded = F.aggregate("steps", F.coalesce("kid.now", "hash"), lambda h, s: digest(s["left"], h, s["right"]))
    found = _down(trees, "grp", tops).withColumn("folded_root", folded)
    return found.select(F.col("kid.id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", "steps", "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def siblings(steps: Column) -> Column:
    """All digests of a proof one after the other, level by level."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def document_leaf(text: Column | None = None) -> Column:
    """Digest of a row of documents, with another text in place of its own if given."""
    own = field("text")
    if text is not None:
        own = F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return digest(field("doc_id"), field("source"), field("lang"), field("n_chars"), own)


#: The contract's columns in DuckDB: levels by recursion, proofs by window frames, the folded root by a second recursion.
SQL = """
WITH RECURSIVE """ + CRC_TABLE + """,
cased AS (SELECT d.*, """ + crc_sql("CAST(doc_id AS VARCHAR)") + """ AS crc FROM documents d, crc_table),
fields AS (
  SELECT doc_id, source, crc,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END AS cut
  FROM cased),
hashed AS (
  SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || CASE WHEN crc % 2 = 0 THEN cut ELSE body END) AS now FROM fields),
leaves AS (
  SELECT *, row_number() OVER () AS row_id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM hashed),
nodes AS (
  SELECT source, n, 0 AS lvl, pos, leaf AS hash FROM leaves
  UNION ALL
  SELECT source, any_value(n), lvl + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes
  WHERE n > CAST(pow(3, lvl) AS BIGINT) GROUP BY source, lvl, pos // 3),
subroots AS (
  SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n <= CAST(pow(3, lvl) AS BIGINT)),
tops AS (
  SELECT n, 0 AS lvl, pos, subroot AS hash FROM subroots
  UNION ALL
  SELECT any_value(n), lvl + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM tops
  WHERE n > CAST(pow(3, lvl) AS BIGINT) GROUP BY lvl, pos // 3),
node_steps AS (
  SELECT source, lvl, pos,
    coalesce(string_agg(hash, '') OVER (PARTITION BY source, lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(hash, '') OVER (PARTITION BY source, lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > CAST(pow(3, lvl) AS BIGINT)),
top_steps AS (
  SELECT lvl, pos,
    coalesce(string_agg(hash, '') OVER (PARTITION BY lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(hash, '') OVER (PARTITION BY lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tops WHERE n > CAST(pow(3, lvl) AS BIGINT)),
steps AS (
  SELECT row_id, s.lvl AS ord, l, r FROM leaves d JOIN node_steps s
    ON s.source IS NOT DISTINCT FROM d.source AND s.pos = d.pos // CAST(pow(3, s.lvl) AS BIGINT)
  UNION ALL
  SELECT row_id, 1000 + s.lvl, l, r FROM leaves d JOIN subroots g ON g.source IS NOT DISTINCT FROM d.source
    JOIN top_steps s ON s.pos = g.pos // CAST(pow(3, s.lvl) AS BIGINT)),
path AS (SELECT row_id, l, r, row_number() OVER (PARTITION BY row_id ORDER BY ord) AS k FROM steps),
fold AS (
  SELECT row_id, 0 AS k, now AS h FROM leaves
  UNION ALL
  SELECT f.row_id, f.k + 1, sha256(p.l || f.h || p.r) FROM fold f JOIN path p ON p.row_id = f.row_id AND p.k = f.k + 1),
folded AS (SELECT row_id, arg_max(h, k) AS folded_root FROM fold GROUP BY row_id),
proofs AS (SELECT row_id, string_agg(l || r, '' ORDER BY k) AS proof FROM path GROUP BY row_id),
root AS (SELECT hash AS root FROM tops WHERE n <= CAST(pow(3, lvl) AS BIGINT))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves d JOIN folded USING (row_id) LEFT JOIN proofs USING (row_id) JOIN subroots g ON g.source IS NOT DISTINCT FROM d.source, root
"""
