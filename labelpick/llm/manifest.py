"""A Merkle manifest of a dataset: one root for all rows, and for every row the proof that leads to it.

Rows are leaves, in order inside their group; every ``fanout`` neighbours become one node until one is left, the group's
subroot, and the subroots, in the order of the groups, become the root in the same way.

Leaves are cut into partitions of fanout^HEIGHT neighbours. Each builds its own subtree and knows only that. Partitions
then meet in a butterfly: in round r, aligned groups of ``fanout`` partitions that differ in digit r of their number swap
the roots of the blocks they have reached, and each hashes the same ancestor for itself. After log(partitions) rounds
every partition holds its whole upper proof, and no pass goes down the tree again. Where the last block of a round has
fewer partitions than the others, its partitions answer for the missing ones in turn.

A proof is text: one level after the other from the leaf up, separated by commas; a level lists the digests of its run in
order, with ``*`` in place of the own node. So folding is replacing and hashing, which Spark does without Python.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelpick.llm.common import materialize
from labelpick.operators.ranks import positions, positions_within

FANOUT = 2
LEAST_LEAVES = 1 << 11  # of a partition; it gets the next power of the fanout
OWN = "*"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(column: Column) -> Column:
    """A value with its UTF-8 length before it, so that neighbouring fields can't be confused; null is ``-``."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def digest(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def subtree(nodes: list[bytes], fanout: int, height: int, alone: bool) -> list[list[bytes]]:
    """Levels of the tree over ``nodes``: up to ``height``, or if there is no other partition, until one node is left."""
    levels = [nodes]
    while (len(levels[-1]) > 1) if alone else (len(levels) <= height):
        below = levels[-1]
        levels.append([digest(below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def proofs(levels: list[list[bytes]], fanout: int) -> list[bytes]:
    """The proof of each leaf inside its subtree."""
    paths = [b""]
    for below in reversed(levels[:-1]):
        out = []
        for i in range(len(below)):
            first = i - i % fanout
            run = below[first:first + fanout]
            run[i - first] = OWN.encode()
            above = paths[i // fanout]
            out.append(b"".join(run) + (b"," + above if above else b""))
        paths = out
    return paths


def _height(fanout: int) -> int:
    return next(h for h in itertools.count(1) if fanout ** h >= LEAST_LEAVES)


def _butterfly(parts: DataFrame, fanout: int) -> DataFrame:
    """(g, part, top, path): the root of each group's tree, and the way to it from each partition's own root.

    ``parts`` holds g, part, n_parts, top (the partition's root). A round sends ``fanout`` digests to each partition, as
    one aggregation over groups of at most ``fanout`` rows.
    """
    state = parts.select("g", "part", "n_parts", "top", F.lit("").alias("path"))
    most = parts.agg(F.max("n_parts")).first()[0] or 1
    block = 1
    while block < most:
        number, wide = F.col("part"), block * fanout
        n_blocks = F.ceil(F.col("n_parts") / block)
        mine = F.floor(number / block)
        # partitions of this block; those of the last block also speak for the places that it lacks
        here = F.least(F.lit(block), F.col("n_parts") - mine * block)
        place = F.pmod(number, F.lit(block))
        places = F.sequence(place, F.lit(block - 1), here)
        said = state.where(n_blocks > 1).select(
            "g", F.floor(number / wide).alias("run"), F.explode(places).alias("place"),
            F.struct(F.pmod(mine, F.lit(fanout)).alias("digit"), F.col("top").alias("top")).alias("one"))
        # one partition of each block speaks for a place, so there are at most ``fanout``
        heard = said.groupBy("g", "run", "place").agg(F.sort_array(F.collect_list("one"))["top"].alias("tops"))
        met = state.alias("s").join(heard.alias("h"), (F.col("s.g") == F.col("h.g"))
                                    & (F.floor(F.col("s.part") / wide) == F.col("h.run"))
                                    & (F.pmod(F.col("s.part"), F.lit(block)) == F.col("h.place")), "left")
        digit = F.pmod(F.floor(F.col("s.part") / block), F.lit(fanout))
        level = F.array_join(F.transform("tops", lambda t, i: F.when(i == digit, F.lit(OWN)).otherwise(t)), "")
        path = F.when(F.col("path") == "", level).otherwise(F.concat("path", F.lit(","), level))
        state = materialize(met.select(
            F.col("s.g").alias("g"), F.col("s.part").alias("part"), "n_parts",
            F.when(F.col("tops").isNull(), F.col("top")).otherwise(F.sha2(F.array_join("tops", ""), 256)).alias("top"),
            F.when(F.col("tops").isNull(), F.col("path")).otherwise(path).alias("path")), "state")
        block = wide
    return state.select("g", "part", "top", "path")


def _grow(nodes: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree of each group over ``nodes`` (g, node, position, total, ...).

    Returns the nodes with their partition, (g, part, top, path) of the partitions, and (g, top) of the groups.
    """
    height = _height(fanout)
    size = fanout ** height
    dealt = nodes.select("*", F.floor(F.col("position") / size).alias("part"), F.ceil(F.col("total") / size).alias("n_parts"))
    columns = ["g", "part", "n_parts", "position", "node"]

    def root(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        levels = subtree([x.encode() for x in table.column("node").to_pylist()], fanout, height,
                         table.column("n_parts")[0].as_py() == 1)
        return pa.table({"g": table.column("g")[:1], "part": table.column("part")[:1],
                         "n_parts": table.column("n_parts")[:1], "top": pa.array([levels[-1][0].decode()])})

    parts = materialize(dealt.select(*columns).groupBy("g", "part").applyInArrow(
        root, "g string, part long, n_parts long, top string"), "subtrees")
    reached = _butterfly(parts, fanout)
    return dealt, reached, reached.where("part = 0").select("g", "top")


def _proved(dealt: DataFrame, reached: DataFrame, extra: list[str], fanout: int) -> DataFrame:
    """The nodes with their whole path and what ``reached`` says of their partition."""
    height, kept = _height(fanout), [c for c in dealt.columns if c not in ("position", "total", "part", "n_parts")]
    columns = [*kept, "path", *extra]
    schema = ", ".join([*[f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in kept], "path string",
                        *[f"{c} {reached.schema[c].dataType.simpleString()}" for c in extra]])

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("position")
        levels = subtree([x.encode() for x in left.column("node").to_pylist()], fanout, height,
                         left.column("n_parts")[0].as_py() == 1)
        above = right.column("path")[0].as_py()
        paths = [",".join(p for p in (own.decode(), above) if p) for own in proofs(levels, fanout)]
        out = left.select(kept).append_column("path", pa.array(paths, pa.string()))
        for name in extra:
            out = out.append_column(name, pa.chunked_array([pa.array([right.column(name)[0].as_py()] * left.num_rows,
                                                                     right.schema.field(name).type)]))
        return out.select(columns)

    by = ("g", "part")
    return dealt.groupBy(*by).cogroup(reached.groupBy(*by)).applyInArrow(prove, schema)


def group_key(column: Column) -> Column:
    """A group as text that is never null and sorts like the group, null first."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value))


def manifest(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``rows`` (g, order, node, others) with path, subroot and root; see the module for what they are.

    ``g`` is text without nulls, ``order`` sorts inside a group (nulls first, ties by node), ``node`` is a hex digest.
    An empty table has an empty manifest.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    leaves = materialize(positions_within(rows, "g", F.col("order").asc_nulls_first(), "node"), "leaves")
    dealt, reached, groups = _grow(leaves, fanout)
    # the groups' subroots are the leaves of one more tree
    tops = groups.select(F.col("g").alias("of"), F.col("top").alias("node"))
    placed = materialize(positions(tops, "of"), "subroots")
    n_groups = placed.count()
    upper, over, roots = _grow(placed.select(F.lit("").alias("g"), "of", "node", "position",
                                             F.lit(n_groups).cast("long").alias("total")), fanout)
    whole = roots.select(F.col("g").alias("of_all"), F.col("top").alias("root"))
    over = over.join(whole, F.col("g") == F.col("of_all")).select("g", "part", "path", "root")
    of_group = materialize(_proved(upper, over, ["root"], fanout).select(
        "of", F.col("node").alias("subroot"), F.col("path").alias("rest"), "root"), "group_proofs")
    both = reached.join(of_group, F.col("g") == F.col("of")).select(
        "g", "part", F.concat_ws(",", *[F.when(F.col(c) != "", F.col(c)) for c in ("path", "rest")]).alias("path"),
        "subroot", "root")
    return _proved(dealt, both, ["subroot", "root"], fanout)


def fold(node: Column, path: Column) -> Column:
    """The root that ``node`` leads to along ``path``."""
    levels = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, ","))
    return F.aggregate(levels, node, lambda at, level: F.sha2(F.replace(level, F.lit(OWN), at), 256))


def siblings(path: Column) -> Column:
    """The digests of a proof, one after the other."""
    return F.translate(path, f"{OWN},", "")


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
          fanout: int = FANOUT) -> DataFrame:
    """(row_id, group, leaf, path, subroot, root): the manifest of ``docs`` over ``fields``, in this order.

    Null fields are told from empty ones, null groups come first, null ids come first inside their group, repeated rows
    have a leaf each. Other columns are ignored. Texts are hashed where they are read and never shuffled.
    """
    rows = docs.select(docs[id_col].cast("long").alias("order"), group_key(docs[group_col]).alias("g"),
                       leaf(*[docs[c] for c in fields]).alias("node"))
    return manifest(rows, fanout).select(
        F.col("order").alias("row_id"), F.when(F.col("g") != "", F.substring("g", 2, (1 << 31) - 1)).alias("group"),
        F.col("node").alias("leaf"), "path", "subroot", "root")


def audit(docs: DataFrame, tampered: Column, changed: dict[str, Column], fields: tuple[str, ...] = FIELDS,
          id_col: str = "doc_id", group_col: str = "lang", fanout: int = FANOUT) -> DataFrame:
    """Fold every row's proof from its leaf after tampering; see ``tamper_report`` for the columns.

    Where ``tampered`` holds, the fields named in ``changed`` are replaced. The manifest is that of the rows before.
    """
    was = leaf(*[F.col(c) for c in fields])
    now = leaf(*[changed.get(c, F.col(c)) for c in fields])
    rows = docs.select(F.col(id_col).cast("long").alias("order"), group_key(F.col(group_col)).alias("g"),
                        was.alias("node"), F.when(tampered, now).alias("now"))
    proved = manifest(rows, fanout)
    checked = proved.withColumn("folded_root", fold(F.coalesce("now", "node"), F.col("path")))
    return checked.select(F.col("order").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root",
                          F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                          (F.col("folded_root") == F.col("root")).alias("verified"))


def tamper_report(docs: DataFrame, every: int = 7, fanout: int = FANOUT) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Documents whose crc32(doc_id as text) is divisible by ``every`` are tampered with: n_chars grows by one, a null stays,
    and so does its leaf. A null doc_id is never tampered with. Empty tables give no rows.
    """
    chosen = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0, F.lit(False))
    return audit(docs, chosen, {"n_chars": F.col("n_chars") + 1}, fanout=fanout)
