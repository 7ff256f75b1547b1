"""Operator 12: Merkle manifest of a dataset, by nested-interval labels.

Rows are leaves of one tree per group; the trees' roots, in the order of the
groups, are the leaves of a last tree.  In a tree every node carries the
interval [lo, hi) of leaf ranks that it covers: a leaf [r, r + 1), a node of
level L the union of up to ``fan`` consecutive nodes of level L - 1.  The level
and ``lo div fan**level`` name the node's bucket, so a node's parent is the one
node of the next level, of the same tree and bucket, that contains its interval:
an equi join with at most ``fan`` rows on a key, whatever the tree's size.  The
parent's children outside the own interval, left and right of it, are the
siblings.  Paths are handed down level by level from the top, and only families
of leaves (an ``fan``-th of the rows) carry them; DataFrame functions alone.

Leaves get their ranks without gathering a group: equal rows are counted, the
rows are dealt by range over (tree, order), counted per part, and numbered in
their part after the counts of the parts before.  A row that repeats gets
consecutive ranks.  What the driver sees is the size of the largest tree.

Defined cases.  Null groups form the first tree; null order keys come first; rows
equal in the order keys are ordered by their leaf digest, so the result is
defined up to rows that are equal.  A tree of one leaf has that leaf as root.
Null fields have an encoding of their own, apart from the empty text.  A row
without siblings on any level has the digest of the empty text as its proof.
Empty table: no rows.  Only the named columns are read, so extra columns cannot
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crease.llm.common import stored

FAN = 8
PIECE = 10_000  # repeated rows expanded by one task at a time
NODE = ["tree", "n", "lo", "hi", "digest"]


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 bytes, a colon, the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts joined."""
    return F.sha2(F.concat(*parts), 256)


def joined(texts: Column) -> Column:
    return F.concat_ws("", texts)


def ranked(rows: DataFrame, order: list[str], payload: list[str]) -> DataFrame:
    """(tree, n, lo, hi, payload): rows of (tree, order, payload, _n) with the interval of ranks of each; n rows in the tree."""
    names = dict.fromkeys(["tree", *order, *payload, "_n"])
    dealt = rows.select(*names).repartitionByRange("tree", *order)
    dealt = stored(dealt.withColumn("_part", F.spark_partition_id()), "merkle-dealt")
    parts = dealt.groupBy("tree", "_part").agg(F.sum("_n").alias("_rows"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree",
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy("tree")).alias("n"),
    )
    here = Window.partitionBy("tree", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    lo = F.col("_offset") + F.coalesce(F.sum("_n").over(here), F.lit(0))
    numbered = dealt.join(parts, ["tree", "_part"]).withColumn("lo", lo)
    return numbered.select("tree", "n", "lo", (F.col("lo") + F.col("_n")).alias("hi"), *payload)


def each_row(intervals: DataFrame, payload: list[str]) -> DataFrame:
    """One row of [lo, lo + 1) for every rank of the intervals; long ones are cut before they are expanded."""
    single = intervals.where("hi - lo = 1")
    cut = intervals.where("hi - lo > 1").withColumn("_at", F.explode(F.expr(f"sequence(lo, hi - 1, {PIECE}L)")))
    rank = F.explode(F.expr(f"sequence(_at, least(_at + {PIECE}L, hi) - 1)"))
    many = cut.repartition("tree", "_at").select("tree", "n", rank.alias("lo"), *payload)
    return single.unionByName(many.withColumn("hi", F.col("lo") + 1))


def parents(nodes: DataFrame, level: int, fan: int, more: list[str] | None = None) -> DataFrame:
    """Nodes of ``level`` over those of the level below, with ``kids``: (lo, hi, digest and ``more``) left to right."""
    kid = F.struct("lo", "hi", "digest", *(more or []))
    family = nodes.groupBy("tree", "n", F.expr(f"lo div {fan**level}").alias("bucket")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
    # a leaf alone in its tree is the root as it is
    own = F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(digest(joined(F.col("kids")["digest"])))
    return family.select("tree", "n", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), own.alias("digest"), "kids")


def levels(leaves: DataFrame, fan: int, more: list[str] | None = None) -> list[DataFrame]:
    """Written nodes of level 1, 2, ... up to the roots of the largest tree."""
    found = [stored(parents(leaves, 1, fan, more), "merkle-nodes")]
    largest, width = found[0].agg(F.max("n")).first()[0] or 0, fan
    while width < largest:
        width *= fan
        below = found[-1].select(*NODE).where(F.col("hi") - F.col("lo") < F.col("n"))
        found.append(stored(parents(below, len(found) + 1, fan), "merkle-nodes"))
    return found


def is_root() -> Column:
    return F.col("hi") - F.col("lo") == F.col("n")


def roots(nodes: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    found = [x.where(is_root()).select("tree", F.col("digest").alias("root")) for x in nodes]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def step(kids: Column, lo: Column, hi: Column) -> Column:
    """The siblings' digests: the parent's interval less the own one, on its left and on its right."""
    left = F.transform(F.filter(kids, lambda k: k["hi"] <= lo), lambda k: k["digest"])
    right = F.transform(F.filter(kids, lambda k: k["lo"] >= hi), lambda k: k["digest"])
    return F.struct(joined(left).alias("before"), joined(right).alias("after"))


def with_paths(nodes: list[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """Families of level 1 with ``path`` (steps from the family's node upwards) and the columns of ``above``.

    ``above``: (tree, path, ...) of each tree: the steps beyond its root."""
    extra = [c for c in above.columns if c not in ("tree", "path")]

    def tops(level: DataFrame) -> DataFrame:
        return level.where(is_root()).join(above, "tree")

    held = tops(nodes[-1])
    for depth in range(len(nodes) - 1, 0, -1):  # parents of level depth + 1, children of level depth
        kids = nodes[depth - 1].where(~is_root()).withColumn("bucket", F.expr(f"lo div {fan ** (depth + 1)}"))
        over = held.select(
            F.col("tree").alias("p_tree"),
            F.expr(f"lo div {fan ** (depth + 1)}").alias("p_bucket"),
            F.col("lo").alias("p_lo"),
            F.col("hi").alias("p_hi"),
            F.col("kids").alias("p_kids"),
            F.col("path").alias("p_path"),
            *extra,
        )
        inside = (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
        met = kids.join(over, (F.col("tree") == F.col("p_tree")) & (F.col("bucket") == F.col("p_bucket")) & inside)
        path = F.concat(F.array(step(F.col("p_kids"), F.col("lo"), F.col("hi"))), F.col("p_path"))
        below = met.withColumn("path", path).select(*nodes[depth - 1].columns, "path", *extra)
        held = below.unionByName(tops(nodes[depth - 1]).select(*below.columns))
    return held


def members(families: DataFrame) -> DataFrame:
    """A row for each leaf of the families, with its whole path upwards and the families' other columns."""
    rest = [c for c in families.columns if c not in (*NODE, "kids", "path")]
    leaf = families.withColumn("leaf", F.explode("kids"))
    own = F.array(step(F.col("kids"), F.col("leaf.lo"), F.col("leaf.hi")))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(own, F.col("path")))
    return leaf.select("tree", "leaf.*", path.alias("path"), *rest)


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(joined(F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda at, s: digest(s["before"], at, s["after"]))


def manifest(df: DataFrame, row_id: str, fields: list[str], group: str, tampered: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``fields`` in the order in which a leaf's digest takes them; ``row_id`` orders
    the leaves of a group.  ``tampered`` replaces fields (by columns over ``df``)
    in the leaf that is folded up and compared with the root."""
    changed = [(tampered or {}).get(f, F.col(f"`{f}`")) for f in fields]
    rows = df.select(
        F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("tree"),  # null first
        F.col(f"`{row_id}`").alias("id"),
        digest(*[field(F.col(f"`{f}`")) for f in fields]).alias("digest"),
        digest(*[field(c) for c in changed]).alias("seen"),
    )
    rows = rows.withColumn("seen", F.nullif("seen", "digest"))  # most are as they were
    counted = rows.groupBy("tree", "id", "digest", "seen").agg(F.count(F.lit(1)).alias("_n"))
    payload = ["id", "digest", "seen"]
    nodes = levels(each_row(ranked(counted, ["id", "digest"], payload), payload), fan, ["id", "seen"])

    trees = roots(nodes).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"), F.lit(1).alias("_n"))
    last = levels(ranked(trees, ["name"], ["name", "digest"]), fan, ["name"])
    end = roots(last).select("tree", F.array().cast("array<struct<before: string, after: string>>").alias("path"), "root")
    above = members(with_paths(last, end, fan)).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path", "root")

    found = members(with_paths(nodes, stored(above, "merkle-trees"), fan))
    folded = fold(F.coalesce("seen", "digest"), F.col("path"))
    out = found.select(
        F.col("id").alias(row_id), F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bit = "lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    byte = f"lambda c, b: list_reduce(range(8), {bit}, xor(c, b))"
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT), {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(_field_sql(f) for f in fields) + ")"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_text(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, with A-Z lower-cased where 3 divides the id's CRC-32."""
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(F.col(text))


def _tree_sql(name: str, source: str) -> str:
    """Recursive table of all nodes over ``source`` (tree, idx, digest, n): (tree, level, idx, digest, n in this level)."""
    return f"""{name}(tree, level, idx, digest, n) AS (
  SELECT tree, 0::BIGINT, idx, digest, n FROM {source}
  UNION ALL
  SELECT tree, level + 1, idx // {FAN}, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + {FAN - 1}) // {FAN}
  FROM {name} WHERE n > 1 GROUP BY tree, level, idx // {FAN})"""


def _steps_sql(leaves: str, nodes: str, key: str) -> str:
    own = f"l.idx // CAST(pow({FAN}, u.level) AS BIGINT)"
    return f"""SELECT l.{key}, u.level, coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx < {own}), '') AS before,
    coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx > {own}), '') AS after
  FROM {leaves} l JOIN {nodes} u ON u.tree = l.tree AND u.n > 1 AND u.idx // {FAN} = l.idx // CAST(pow({FAN}, u.level + 1) AS BIGINT)
  GROUP BY l.{key}, u.level"""


ORACLE_SQL = f"""WITH RECURSIVE
rows AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS tree, {_leaf_sql("text")} AS digest,
    CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf_sql("text")} END AS seen
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, digest) AS id, count(*) OVER (PARTITION BY tree) AS n,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx
  FROM rows),
{_tree_sql("nodes", "leaves")},
subroots AS (SELECT tree AS name, level, digest FROM nodes WHERE n = 1),
tops AS (SELECT '' AS tree, name, level, digest, row_number() OVER (ORDER BY name) - 1 AS idx, count(*) OVER () AS n FROM subroots),
{_tree_sql("summits", "tops")},
steps AS (
  {_steps_sql("leaves", "nodes", "id")}
  UNION ALL
  SELECT l.id, s.level + t.level, s.before, s.after FROM leaves l JOIN tops t ON t.name = l.tree
  JOIN ({_steps_sql("tops", "summits", "name")}) s ON s.name = l.tree),
proofs AS (SELECT id, string_agg(before || after, '' ORDER BY level) AS siblings, count(*) AS depth FROM steps GROUP BY id),
folds(id, level, digest) AS (
  SELECT id, 0::BIGINT, seen FROM leaves
  UNION ALL
  SELECT f.id, f.level + 1, sha256(s.before || f.digest || s.after) FROM folds f JOIN steps s ON s.id = f.id AND s.level = f.level)
SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, r.digest AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
  f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves l JOIN tops t ON t.name = l.tree JOIN summits r ON r.n = 1
LEFT JOIN proofs p ON p.id = l.id JOIN folds f ON f.id = l.id AND f.level = coalesce(p.depth, 0)"""
