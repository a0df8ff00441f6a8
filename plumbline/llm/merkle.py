"""Merkle manifest of a dataset, with parent-preimage paths.

A row's leaf is the digest of its columns, each with its length before it. The leaves of a group (a source) in order of
their ids are the bottom of a tree in which every three consecutive nodes have one parent: the digest of their digests
as hex text, one after the other. That text, the parent's *preimage*, is what the manifest stores. A leaf joins the
preimages of its ancestors; cutting its own 64 characters out of one leaves the siblings (the proof), and putting
another digest in their place gives the parent that this digest would have had (folding). The groups' roots, in order of
the groups, are the leaves of one more tree.

How it is computed:

1. Rows become narrow (group, id, leaf, perhaps a second leaf); texts never travel.
2. They are sorted by ranges over the whole table, so that a hot group spreads over many partitions, and numbered within
   their group from the counts of each partition and group: no window over a group.
3. ``CHUNK`` (81) consecutive nodes of a group meet in one row, which computes four levels of parents at once. Its top
   node goes on to the next round, where the table is 81 times shorter: three rounds do for 40 million rows of a group,
   five for three billion.
4. Going down again, each chunk takes the path above it from the chunk that it is a member of (81 rows a key at most),
   and the leaves theirs from their own chunk.

Every round is cut to the shared folder. Ordering: groups by their UTF-8 bytes, a null group first; within a group by
id, a null id first, rows that share an id by their leaf. Nulls in a column are marked ``-``, which no value gives, so
that a null and an empty text differ. Repeated rows have equal leaves and a place each. An empty table has no rows and
no root. Other columns of the input do not count. A text of any length is hashed where it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_bucket, cut, parts, table

#: Children of a node, and characters of a digest.
ARITY, HEX = 3, 64
#: Levels of parents that one row computes, and its nodes at the bottom.
LEVELS = 4
CHUNK = ARITY**LEVELS
#: The columns that make a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<preimage:string,slot:int>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value: no two lists of values give one text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def decoded(text: Column) -> Column:
    """The value that ``encoded`` has made this of."""
    return F.when(text != "-", F.substring(text, F.instr(text, ":") + 1, F.length(text)))


def leaf_of(columns: dict[str, Column]) -> Column:
    """The leaf of these values, in their order."""
    return F.sha2(F.concat(*(encoded(c) for c in columns.values())), 256)


def own(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> dict[str, Column]:
    return {c: docs[f"`{c}`"] for c in columns}


def siblings(path: Column) -> Column:
    """The digests beside the path, level by level from the bottom, left to right, as one text."""
    return F.array_join(F.transform(path, lambda p: F.concat(_left(p), _right(p))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that this leaf has in this place: spliced into each preimage on the way."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(_left(p), node, _right(p)), 256))


def _left(p: Column) -> Column:
    return F.substring(p["preimage"], F.lit(1), p["slot"] * HEX)


def _right(p: Column) -> Column:
    return F.substring(p["preimage"], p["slot"] * HEX + (HEX + 1), F.length(p["preimage"]))


def numbered(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The rows with ``idx``, their number from 0 within ``tree`` by ``order`` (which begins with what orders the trees),
    and ``n``, the number of rows of the tree.
    """
    placed = rows.repartitionByRange(parts(rows), *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    runs = placed.groupBy("part", "tree").agg(F.min("place").alias("first"), F.count("*").alias("many"))
    of = Window.partitionBy("tree")  # a row for each partition that the tree reaches into
    before = F.coalesce(F.sum("many").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("part", "tree", "first", before.alias("before"), F.sum("many").over(of).alias("n")))
    return placed.join(runs, ["part", "tree"]).withColumn("idx", F.col("place") - F.col("first") + F.col("before")).drop("part", "place", "first", "before")


def _chunks(nodes: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Nodes (tree, n, idx, hash and ``keep``) as chunks: tree, n, chunk, members, levels (of preimages), top.

    ``n`` counts the nodes of the tree at this level: a tree of CHUNK nodes or fewer ends in its chunk, with as many
    levels as it takes.
    """
    member = F.struct(F.expr(f"CAST(idx % {CHUNK} AS INT)").alias("i"), "hash", *keep)
    out = nodes.groupBy("tree", "n", F.expr(f"idx DIV {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    level, none = F.col("members.hash"), F.array().cast("array<string>")
    for k in range(LEVELS):
        out = out.withColumn(f"p{k}", F.when(F.col("n") > ARITY**k, _preimages(level)).otherwise(none))
        level = F.transform(f"p{k}", lambda p: F.sha2(p, 256))
    last = F.coalesce(*(F.get(f"p{k}", F.lit(0)) for k in reversed(range(LEVELS))))
    top = F.coalesce(F.sha2(last, 256), F.get("members", F.lit(0))["hash"])
    return out.select("tree", "n", "chunk", "members", F.array(*(f"p{k}" for k in range(LEVELS))).alias("levels"), top.alias("top"))


def _preimages(level: Column) -> Column:
    """Of a level's digests, every run of three as one text."""
    first = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
    return F.transform(first, lambda j: F.array_join(F.slice(level, j * ARITY + 1, ARITY), ""))


def _inside(levels: Column, i: Column) -> Column:
    """The ancestors of a chunk's i-th member within the chunk, from the bottom: preimages, and the places in them."""
    step = lambda k: F.struct(F.get(levels[k], F.floor(i / ARITY ** (k + 1)).cast("int")).alias("preimage"), F.pmod(F.floor(i / ARITY**k), F.lit(ARITY)).cast("int").alias("slot"))
    return F.filter(F.array(*(step(k) for k in range(LEVELS))), lambda p: p["preimage"].isNotNull())


@dataclass
class Forest:
    """Trees by rounds: ``rounds[0]`` holds the chunks of leaves, each later one those of the tops before."""

    rounds: list[DataFrame]

    @classmethod
    def grown(cls, leaves: DataFrame, keep: tuple[str, ...]) -> Forest:
        """Over leaves (tree, n, idx, hash and the columns ``keep``)."""
        rounds = [cut(_chunks(leaves, keep))]
        while not (more := rounds[-1].filter(F.col("n") > CHUNK)).isEmpty():
            tops = more.select("tree", F.ceil(F.col("n") / CHUNK).alias("n"), F.col("chunk").alias("idx"), F.col("top").alias("hash"))
            rounds.append(cut(_chunks(tops, ())))
        return cls(rounds)

    def roots(self) -> DataFrame:
        """tree, root."""
        ended = [r.filter(F.col("n") <= CHUNK).select("tree", F.col("top").alias("root")) for r in self.rounds]
        out = ended[0]
        for e in ended[1:]:
            out = out.unionByName(e)
        return out

    def preimages(self) -> DataFrame:
        """What is stored for each parent: tree, level (1: parents of leaves), idx, preimage."""
        out = None
        for k, chunks in enumerate(self.rounds):
            flat = chunks.select("tree", "chunk", F.posexplode("levels").alias("up", "nodes")).select("tree", "chunk", "up", F.posexplode("nodes").alias("j", "preimage"))
            wide = F.element_at(F.array(*(F.lit(ARITY ** (LEVELS - 1 - u)) for u in range(LEVELS))), F.col("up") + 1)
            flat = flat.select("tree", (F.col("up") + 1 + k * LEVELS).alias("level"), (F.col("chunk") * wide + F.col("j")).alias("idx"), "preimage")
            out = flat if out is None else out.unionByName(flat)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """The leaves (tree, hash and what was kept) with their paths to the root and beyond it: ``above`` has for each
        tree the path of its root (tree, above) and columns to go with it.
        """
        carried = [c for c in above.columns if c not in ("tree", "above")]
        below = None
        for chunks in reversed(self.rounds):
            here = chunks.filter(F.col("n") <= CHUNK).join(above, "tree")
            if below is not None:
                up = below.select("tree", F.col("chunk").alias("up"), F.col("levels").alias("up_levels"), F.col("above").alias("up_above"), *carried)
                rest = chunks.filter(F.col("n") > CHUNK).withColumn("up", F.expr(f"chunk DIV {CHUNK}")).join(up, ["tree", "up"])
                path = F.concat(_inside(F.col("up_levels"), F.expr(f"CAST(chunk % {CHUNK} AS INT)")), F.col("up_above"))
                here = here.unionByName(rest.withColumn("above", path).drop("up", "up_levels", "up_above"))
            below = here
        one = lambda m: F.struct(m.alias("m"), F.concat(_inside(F.col("levels"), m["i"]), F.col("above")).alias("path"))
        flat = below.select("tree", *carried, F.explode(F.transform("members", one)).alias("x"))
        return flat.select("tree", *carried, "x.m.*", "x.path").drop("i")


@dataclass
class Manifest:
    """``leaves``: a row for each row of the table, with id, group, leaf, subroot, root, path and the columns ``more``.
    ``groups`` and ``top``: the trees of the groups, and the tree over them.
    """

    leaves: DataFrame
    groups: Forest
    top: Forest


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = COLUMNS, more: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table. ``more``: further columns of the result, computed where the rows are read (say, a leaf of
    other values).
    """
    more = {} if more is None else more
    group = docs[f"`{group_col}`"].cast("string")
    narrow = cut(docs.select(encoded(group).alias("tree"), group.alias("group"), docs[f"`{id_col}`"].alias("id"), leaf_of(own(docs, columns)).alias("hash"), *(c.alias(f"__{k}") for k, c in more.items())))
    groups = Forest.grown(numbered(narrow, ("group", "id", "hash")), ("id", *(f"__{k}" for k in more)))
    subroots = cut(groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("of"), decoded(F.col("tree")).alias("name"), F.col("root").alias("hash")))
    top = Forest.grown(numbered(subroots, ("name",)), ("of",))
    root = top.roots().select("tree", F.array().cast(_PATH).alias("above"), "root")
    above = cut(top.paths(root).select(F.col("of").alias("tree"), F.col("path").alias("above"), F.col("hash").alias("subroot"), "root"))
    found = groups.paths(above)
    return Manifest(found.select(F.col("id").alias(id_col), decoded(F.col("tree")).alias(group_col), F.col("hash").alias("leaf"), "subroot", "root", "path", *(F.col(f"__{k}").alias(k) for k in more)), groups, top)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and what becomes of those whose text loses its line feeds."""
    docs = table(spark, sf_dir, "documents")
    tampered = leaf_of(own(docs) | {"text": F.replace(docs["text"], F.lit("\n"), F.lit(""))})
    leaves = manifest(docs, more={"tampered": F.when(crc_bucket("doc_id", 2) == 0, tampered)}).leaves
    again = leaves.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return again.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_encoded(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_encoded(text if c == "text" else c) for c in COLUMNS) + ")"


def _sql_tree(name: str, leaves: str, of: str) -> str:
    """All nodes of the trees ``of``, and the preimages of their parents."""
    return f"""{name}(tree, level, idx, n, h) AS (SELECT {of}, 0, idx, n, h FROM {leaves}
  UNION ALL SELECT tree, level + 1, idx // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // {ARITY}, n),
{name}_up AS (SELECT tree, level, idx // {ARITY} AS up, string_agg(h, '' ORDER BY idx) AS p FROM {name} WHERE n > 1 GROUP BY tree, level, idx // {ARITY})"""


def _sql_climb(name: str, start: str, tree: str) -> str:
    """Every row's way up: its digest put into each preimage, and the proof."""
    left, right = f"substr(p, 1, {HEX} * (idx % {ARITY})::INT)", f"substr(p, {HEX} * (idx % {ARITY})::INT + {HEX + 1})"
    return f"""{name}(rid, tree, level, idx, h, proof) AS (SELECT rid, tree, 0, idx, h, proof FROM {start}
  UNION ALL SELECT rid, c.tree, c.level + 1, idx // {ARITY}, sha256({left} || h || {right}), proof || {left} || {right}
  FROM {name} c JOIN {tree}_up u ON u.tree = c.tree AND u.level = c.level AND u.up = c.idx // {ARITY}),
{name}_end AS (SELECT rid, arg_max(tree, level) AS tree, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM {name} GROUP BY rid)"""


#: crc32 over the decimal digits: each byte, then eight shifts (marked -1).
_SQL_CRC = "list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT] || list_value(-1, -1, -1, -1, -1, -1, -1, -1)::BIGINT[])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295)"
OP12_SQL = f"""WITH RECURSIVE rows_ AS (SELECT *, {_sql_leaf('text')} AS leaf, {_sql_encoded('source')} AS tree, xor({_SQL_CRC}, 4294967295) % 2 = 0 AS hit FROM documents),
leaves AS (SELECT row_number() OVER () AS rid, doc_id, source, tree, leaf AS h, leaf, CASE WHEN hit THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE leaf END AS shown,
  row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM rows_ WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf)),
{_sql_tree('node', 'leaves', 'tree')},
subroots AS (SELECT s.source, t.tree, t.h, row_number() OVER (ORDER BY s.source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM node t JOIN (SELECT DISTINCT source, tree FROM leaves) s ON s.tree = t.tree WHERE t.n = 1),
{_sql_tree('top', 'subroots', "''")},
start1 AS (SELECT rid, tree, idx, shown AS h, '' AS proof FROM leaves),
{_sql_climb('climb', 'start1', 'node')},
start2 AS (SELECT c.rid, '' AS tree, s.idx, c.h, c.proof FROM climb_end c JOIN subroots s ON s.tree = c.tree),
{_sql_climb('summit', 'start2', 'top')}
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN summit_end e ON e.rid = l.rid, (SELECT h FROM top WHERE n = 1) r"""
