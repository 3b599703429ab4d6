"""A Merkle manifest of a table: levels built as parent-linked node rows, climbed by a recursive query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, keep, small
from lodestar.operators.ordered import numbered

#: Built levels that one node row links: a step of the climb ascends so many.
LEVELS = 6


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the concatenated inputs."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*map(framed, values))


def _height(n: Column, fan: int) -> Column:
    """Levels above n leaves: the least h with fan ** h >= n."""
    powers = [fan**i for i in range(63) if fan**i < 2**63]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < n))


def _runs(nodes: Column, fan: int) -> Column:
    """The level above a list of nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan).cast("int")), lambda r: F.sha2(F.array_join(F.slice(nodes, r * fan + 1, F.lit(fan)), ""), 256))


def build(items: DataFrame, fan: int = 3, levels: int = LEVELS, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(tree, pos, node, n) -> (nodes, roots): the trees over items in order of pos, from 0 without gaps; n is the items of the tree.

    nodes: tree, step, pos, parent (place of the ancestor `levels` up, or of the tree's root if nearer) and path: for
    every level in between, the digests (bytes) of the run's siblings before and after. roots: tree, height, steps (node rows
    from an item to the root), node. Nodes of one step group fan ** levels items, so a group is bounded and the passes
    are few; the last run of a level may be shorter, down to one node, which is hashed like any other.
    """
    scratch = scratch or Scratch()
    block, spark = fan**levels, items.sparkSession
    now, step, nodes, roots = items.withColumn("height", _height(F.col("n"), fan)), 0, [], []
    while True:
        done = now.where(F.col("height") <= step * levels)
        roots.append(done.select("tree", "height", F.lit(step).alias("steps"), "node"))
        rest = now.where(F.col("height") > step * levels)
        if step and rest.isEmpty():
            break
        group = rest.groupBy("tree", "height", F.floor(F.col("pos") / block).cast("long").alias("up")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("l0"))  # at most `block` nodes
        rise = F.least(F.lit(levels), F.col("height") - step * levels)
        for i in range(levels):
            group = group.withColumn(f"l{i + 1}", F.when(rise > i, _runs(F.col(f"l{i}"), fan)).otherwise(F.array().cast("array<string>")))
        top = group.select("*", *[F.get(f"l{i}", F.lit(0)).alias(f"h{i}") for i in range(1, levels + 1)]).withColumn("node", F.get(F.array(*[f"h{i}" for i in range(1, levels + 1)]), rise - 1))

        def link(j: Column, level: int) -> Column:
            """Siblings of the item's ancestor at a level: j is the item's place in its group."""
            own, from_ = F.floor(j / fan**level).cast("int"), F.floor(j / fan ** (level + 1)).cast("int") * fan
            before = F.unhex(F.array_join(F.slice(f"l{level}", from_ + 1, own - from_), ""))
            after = F.unhex(F.array_join(F.slice(f"l{level}", own + 2, from_ + fan - 1 - own), ""))
            return F.when(rise > level, F.struct(before.alias("before"), after.alias("after")))

        linked = lambda j: F.struct((F.col("up") * block + j).alias("pos"), F.col("up").alias("parent"), F.array_compact(F.array(*[link(j, i) for i in range(levels)])).alias("path"))
        each = F.inline(F.transform(F.sequence(F.lit(0), F.size("l0") - 1), linked))
        made = scratch(group.select("tree", F.lit(step).alias("step"), each))
        nodes.append(made)
        now = scratch(top.select("tree", F.col("up").alias("pos"), "node", "height"))
        step += 1
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    return union(nodes) if nodes else spark.createDataFrame([], "tree long, step int, pos long, parent long, path array<struct<before:binary,after:binary>>"), union(roots)


CLIMB = """
WITH RECURSIVE climb (tree, leaf_pos, block, last, step, pos, folded, proof) AS (
  SELECT l.tree, l.leaf_pos, l.block, l.last, if(n.path IS NULL, 0, 1), coalesce(n.parent, l.pos), {fold_leaf}, {siblings}
  FROM {{leaves}} l LEFT JOIN {{first}} n ON l.tree = n.tree AND l.leaf_pos = n.pos
  UNION ALL
  SELECT {hint} c.tree, c.leaf_pos, c.block, c.last, c.step + 1, n.parent, {fold}, concat(c.proof, {siblings})
  FROM climb c JOIN {{upper}} n ON c.tree = n.tree AND c.block = n.block AND c.step = n.step AND c.pos = n.pos
)
SELECT tree, leaf_pos, folded AS folded_root, sha2(lower(hex(proof)), 256) AS proof_sha256 FROM climb WHERE step = last"""
_FOLD = "aggregate(coalesce(n.path, array()), {own}, (own, s) -> sha2(concat(lower(hex(s.before)), own, lower(hex(s.after))), 256))"
_SIBLINGS = "aggregate(coalesce(n.path, array()), X'', (all, s) -> concat(all, s.before, s.after))"
#: Node rows above the leaves that are broadcast at most: some 60 MB.
UPPER_ROWS = 100_000


def climb(leaves: DataFrame, first: DataFrame, upper: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, leaf_pos, pos, block, last, start) -> (tree, leaf_pos, folded_root, proof_sha256): a recursive query that ascends from each leaf.

    first: the leaves' own node rows (tree, pos); upper: those above (tree, block, step, pos), kept. Every step joins the
    climbing rows with their parent-linked node rows, folds `start` with the siblings and appends them to the proof.
    Node rows that many leaves pass are there once for every block of leaves, so that no key of the join has more than
    a block of them; there are a few of them to several hundred leaves. Up to UPPER_ROWS are broadcast, so that the
    climbing rows are not shuffled; beyond that they are. Spark's row limit of recursions, a million by default, is lifted meanwhile.
    """
    spark, limit = leaves.sparkSession, "spark.sql.cteRecursionRowLimit"
    hint = "/*+ BROADCAST(n) */" if upper.count() <= UPPER_ROWS else ""
    text = CLIMB.format(hint=hint, fold_leaf=_FOLD.format(own="l.start"), fold=_FOLD.format(own="c.folded"), siblings=_SIBLINGS)
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return scratch(spark.sql(text, leaves=leaves, first=first, upper=upper))
    finally:
        spark.conf.set(limit, before)


def manifest(docs: DataFrame, leaf: Column, tampered: Column, group_col: str = "source", id_col: str = "doc_id", fan: int = 3, levels: int = LEVELS) -> DataFrame:
    """Rows -> (id, leaf, subroot, root, proof_sha256, folded_root, verified): a tree per group, and one over their roots.

    In a group, leaves ascend by id (null first; equal ids by their leaves), and every `fan` consecutive nodes become
    their digest until one remains; groups ascend by name, null first, bytewise. proof_sha256 hashes the siblings from
    the leaf to the root. `tampered` is the leaf digest of the row as found, null where it is as it was; folded_root is
    computed from it and the siblings as stored, and verified says whether that is the root. Repeated rows are leaves
    of their own, alike up to their place. No rows: none. Further columns are ignored. Runs jobs while it is built.

    No group is ever numbered or hashed in one task: leaves are numbered in ranges of their order, and hashed in
    groups of fan ** levels.
    """
    spark, scratch, block = docs.sparkSession, Scratch(), fan**levels
    rows = scratch(docs.select(F.col(group_col).alias("name"), F.col(id_col).alias("id"), leaf.alias("node"), tampered.alias("start")))
    placed = scratch(numbered(rows, ["name"], ["id", "node"], "pos", "n"))
    trees = scratch(numbered(placed.where("pos = 0").select("name", "n"), [], ["name"], "tree", "trees"))
    names = small(trees.select(F.col("name").alias("_name"), "tree", "trees"))
    of_block = F.floor(F.col("pos") / block).cast("long")
    leaves = scratch(placed.join(names, F.col("name").eqNullSafe(F.col("_name"))).select("tree", "pos", of_block.alias("block"), "n", "trees", "id", "node", "start"))
    nodes, roots = build(leaves.select("tree", "pos", "node", "n"), fan, levels, scratch)
    roots = scratch(roots.join(small(trees.select("tree", "trees")), "tree"))
    above, top = build(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "node", F.col("trees").alias("n")), fan, levels, scratch)
    root, top_steps = top.select("node", "steps").first() or (None, 0)
    ends = small(scratch(roots.select("tree", F.col("node").alias("subroot"), "steps", (F.col("steps") + top_steps).alias("last"))))

    # Node rows above the first step are there once for every block of leaves that passes them.
    blocks = scratch(leaves.where(F.col("pos") % block == 0).select("tree", "block").join(ends, "tree"))
    power = lambda n: F.pow(F.lit(float(block)), n)
    inner = blocks.where("steps > 1").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps") - 1)))
    inner = inner.select("tree", "block", "step", F.floor(F.col("block") / power(F.col("step") - 1)).cast("long").alias("pos")).join(nodes.where("step > 0"), ["tree", "step", "pos"])
    columns = ["tree", "block", "step", "pos", "parent", "path"]
    turned = F.when(F.col("step") == F.col("steps") - 1, F.col("tree")).otherwise(F.col("parent"))  # a subroot's place is that of its tree
    turn = lambda rows: rows.join(ends.select("tree", "steps"), "tree").withColumn("parent", turned)
    upper = turn(inner).select(*columns)
    if top_steps:
        outer = blocks.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(top_steps - 1)))).withColumn("pos", F.floor(F.col("tree") / power(F.col("_step"))).cast("long"))
        outer = outer.join(above.select(F.col("step").alias("_step"), "pos", "parent", "path"), ["_step", "pos"])
        upper = upper.unionByName(outer.withColumn("step", F.col("steps") + F.col("_step")).select(*columns))
    first = turn(nodes.where("step = 0")).select("tree", "pos", "parent", "path")
    start = leaves.select("tree", "pos", "block", F.coalesce("start", "node").alias("start")).join(ends, "tree")
    start = start.select("tree", F.col("pos").alias("leaf_pos"), F.when(F.col("steps") == 0, F.col("tree")).otherwise(F.col("pos")).alias("pos"), "block", "last", "start")
    climbed = climb(start, first, scratch(upper), scratch)
    joined = leaves.select("tree", F.col("pos").alias("leaf_pos"), "id", F.col("node").alias("leaf")).join(climbed, ["tree", "leaf_pos"]).join(ends.select("tree", "subroot"), "tree")
    done, _ = keep(joined.select(F.col("id").alias(id_col), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified")))
    scratch.clear()
    return done


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against a copy in which the texts of half of them, those with an even CRC-32 of the id, have lost their line feeds."""
    c = F.col
    hit = (F.crc32(c("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(c("text"), F.lit("\n"))
    fields = lambda text: leaf_of(c("doc_id"), c("source"), c("lang"), c("n_chars"), text)
    return manifest(docs, fields(c("text")), F.when(hit, fields(F.replace(c("text"), F.lit("\n"), F.lit("")))))
