"""Merkle manifests of data sets: trees of SHA-256 digests over rows in order, and an audit path for every row.

Rows are range-partitioned by tree and order, and each partition knows the index of its first leaf. A partition keeps a mountain range: a
stack of complete nodes, where the last member of a run of ``fanout`` siblings makes the run carry into its parent, as in
counting. What is left on the stack are the partition's peaks; runs that lie over a partition's edge are unfinished there. Rounds
of merging then take the peaks of MERGED neighbouring partitions as their sequence, until one node is left per tree. The last
run of a level may be short, down to one node; it is hashed as it is, without padding. The trees' roots, in the order of
their trees, are the leaves of one more tree.

Nothing but digests is shuffled: leaves are hashed where the rows are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrytext.llm.common import dropped, stored

#: Leaves that a partition should hold, and partitions that one merging group takes.
LEAVES = 50_000
MERGED = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Node = tuple[int, int, str]


def digest(hashes: Iterable[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def mountain_range(nodes: Iterable[Node], total: int, fanout: int, made: Callable[[int, int, list[str], str], None]) -> list[Node]:
    """Peaks (level, index, hash) that remain of ``nodes``, which follow each other without gaps in a tree of ``total`` leaves.
    ``made`` gets the level and index of every new node, the hashes of its run and its own."""
    stack: list[Node] = []
    widths = [total]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // fanout))
    for node in nodes:
        stack.append(node)
        while True:
            level, index, _ = stack[-1]
            first = index - index % fanout
            size = min(fanout, widths[level] - first)
            if widths[level] == 1 or index != first + size - 1 or len(stack) < size or stack[-size][:2] != (level, first):
                break
            run = [h for _, _, h in stack[-size:]]
            del stack[-size:]
            stack.append((level + 1, first // fanout, digest(run)))
            made(level + 1, first // fanout, run, stack[-1][2])
    return stack


class Climb:
    """A mountain range that remembers its runs, so that nodes can be followed upwards."""

    def __init__(self, nodes: Iterable[Node], total: int, fanout: int) -> None:
        self.fanout = fanout
        self.runs: dict[tuple[int, int], list[str]] = {}
        self.made: list[Node] = []
        self.peaks = mountain_range(nodes, total, fanout, self._keep)

    def _keep(self, level: int, index: int, run: list[str], own: str) -> None:
        self.runs[level, index] = run
        self.made.append((level, index, own))

    def path(self, level: int, index: int) -> tuple[str, int, int]:
        """The way from a node up to its peak, and the peak's level and index. Each step is a run with * in the node's own place;
        steps are separated by strokes."""
        steps = []
        while (run := self.runs.get((level + 1, index // self.fanout))) is not None:
            at = index % self.fanout
            steps.append("".join(run[:at]) + "*" + "".join(run[at + 1 :]))
            level, index = level + 1, index // self.fanout
        return "/".join(steps), level, index


def table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_PEAKS = pa.schema([("tree", pa.string()), ("bucket", pa.int32()), ("total", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("hash", pa.string())])
_STEPS = pa.schema(
    [
        *[("tree", pa.string()), ("bucket", pa.int32()), ("total", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("path", pa.string())],
        *[("up_bucket", pa.int32()), ("up_level", pa.int32()), ("up_index", pa.int64()), ("up_hash", pa.string()), ("first", pa.bool_())],
    ]
)
_NODES = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("hash", pa.string()), ("is_peak", pa.bool_())])
_DDL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_DDL[f.type]}" for f in schema)


def _numbered(group: pa.Table, order: list[str]) -> tuple[pa.Table, int, int]:
    """A partition's leaves of one tree in order, the first one's index and the tree's number of leaves."""
    return group.sort_by([(c, "ascending") for c in order]), group.column("start")[0].as_py(), group.column("total")[0].as_py()


def _leaves(group: pa.Table, start: int) -> list[Node]:
    return [(0, start + i, h) for i, h in enumerate(group.column("leaf").to_pylist())]


@dataclass
class Forest:
    """Trees over stored leaves. ``leaves`` has the caller's columns, bucket, start and total; ``rounds`` has one table per round of
    merging, from each peak to the peak above it; ``roots`` one row per tree."""

    leaves: DataFrame
    order: list[str]
    fanout: int
    rounds: list[DataFrame]
    roots: DataFrame

    def nodes(self) -> DataFrame:
        """tree, level, index, hash and is_peak of every node above the leaves that partitions complete by themselves; the rounds'
        nodes follow from their peaks."""
        order, fanout = self.order, self.fanout

        def run(group: pa.Table) -> pa.Table:
            ordered, start, total = _numbered(group, order)
            climb = Climb(_leaves(ordered, start), total, fanout)
            tree, peaks = ordered.column("tree")[0].as_py(), {(level, index) for level, index, _ in climb.peaks}
            return table(_NODES, [(tree, level, index, own, (level, index) in peaks) for level, index, own in climb.made])

        return self.leaves.groupBy("tree", "bucket").applyInArrow(run, ddl(_NODES))

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """The caller's columns, ``root`` of the row's tree, ``top`` and ``path``: all runs from the leaf up. ``above`` (tree, path, root) leads
        on from every tree's root to the root over all trees, which is then ``top``; else that is the tree's own root."""
        top = self.roots.select("tree", F.col("root").alias("own"))
        if above is None:
            top = top.select("tree", "own", F.lit("").alias("rest"), F.col("own").alias("top"))
        else:
            top = top.join(above.select("tree", F.col("path").alias("rest"), F.col("root").alias("top")), "tree")
        last = self.rounds[-1]
        upper = last.join(top, "tree").select("tree", "bucket", "level", "index", _joined("path", "rest").alias("path"), "own", "top")
        for steps in self.rounds[-2::-1]:
            over = upper.select("tree", F.col("level").alias("up_level"), F.col("index").alias("up_index"), F.col("path").alias("rest"), "own", "top")
            found = steps.join(over, ["tree", "up_level", "up_index"])
            upper = found.select("tree", "bucket", "level", "index", _joined("path", "rest").alias("path"), "own", "top")
        order, fanout = self.order, self.fanout
        kept = [f for f in self.leaves.schema.fields if f.name not in ("bucket", "start", "total")]
        names = [f.name for f in kept]

        def run(group: pa.Table, peaks: pa.Table) -> pa.Table:
            ordered, start, total = _numbered(group, order)
            climb = Climb(_leaves(ordered, start), total, fanout)
            rest = {(x["level"], x["index"]): x["path"] for x in peaks.to_pylist()}
            paths = []
            for i in range(start, start + ordered.num_rows):
                path, level, index = climb.path(0, i)
                paths.append("/".join(filter(None, (path, rest[level, index]))))
            out = ordered.select(names)
            for name, column in (("root", "own"), ("top", "top")):
                out = out.append_column(name, pa.array([peaks.column(column)[0].as_py()] * len(paths), pa.string()))
            return out.append_column("path", pa.array(paths, pa.string()))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", root string, top string, path string"
        return self.leaves.groupBy("tree", "bucket").cogroup(upper.groupBy("tree", "bucket")).applyInArrow(run, schema)


def _joined(a: str, b: str) -> Column:
    return F.concat_ws("/", F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))


def grow(rows: DataFrame, order: list[str], fanout: int = 2) -> Forest:
    """The trees over ``rows``: columns tree (string, not null), leaf (hex digest) and any others; within a tree leaves ascend by ``order``
    (not null), which must tell all rows apart but equal ones."""
    spark = rows.sparkSession
    parts = max(math.ceil(rows.count() / LEAVES), 1)
    if parts > 1 or not rows.isEmpty():
        parts = max(parts, min(int(spark.conf.get("spark.sql.shuffle.partitions")), parts * 16))
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())  # equal rows in great number may be cut anywhere
    ranged = salted.repartitionByRange(parts, "tree", *order, "__salt").drop("__salt")
    placed = stored(ranged.withColumn("bucket", F.spark_partition_id()), "leaves")
    before = Window.partitionBy("tree").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("tree", "bucket").agg(F.count("*").alias("n"))
    places = counts.select(
        "tree", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("tree")).alias("total")
    )
    leaves = placed.join(stored(places, "places"), ["tree", "bucket"])

    def first(group: pa.Table) -> pa.Table:
        ordered, start, total = _numbered(group, order)
        tree, bucket = ordered.column("tree")[0].as_py(), ordered.column("bucket")[0].as_py()
        peaks = mountain_range(_leaves(ordered, start), total, fanout, lambda *_: None)
        return table(_PEAKS, [(tree, bucket, total, *p) for p in peaks])

    def merge(group: pa.Table) -> pa.Table:
        nodes = sorted(group.to_pylist(), key=lambda x: x["index"] * fanout ** x["level"])
        climb = Climb(((x["level"], x["index"], x["hash"]) for x in nodes), nodes[0]["total"], fanout)
        hashes, seen, out = {(level, index): h for level, index, h in climb.peaks}, set(), []
        for x in nodes:
            path, level, index = climb.path(x["level"], x["index"])
            out.append((x["tree"], x["bucket"], x["total"], x["level"], x["index"], path, x["bucket"] // MERGED, level, index, hashes[level, index], (level, index) not in seen))
            seen.add((level, index))
        return table(_STEPS, out)

    frontier = leaves.groupBy("tree", "bucket").applyInArrow(first, ddl(_PEAKS))
    rounds, width = [], parts
    while not rounds or width > 1:
        grouped = frontier.groupBy("tree", F.expr(f"bucket div {MERGED}"))
        rounds.append(stored(grouped.applyInArrow(merge, ddl(_STEPS)), "peaks"))
        tops = rounds[-1].where("first")
        frontier = tops.select("tree", F.col("up_bucket").alias("bucket"), "total", F.col("up_level").alias("level"), F.col("up_index").alias("index"), F.col("up_hash").alias("hash"))
        width = (rounds[-1].agg(F.max("up_bucket")).first()[0] or 0) + 1
    return Forest(leaves, order, fanout, rounds, frontier.select("tree", F.col("hash").alias("root")))


def leaf(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields: each - if null, else its number of UTF-8 bytes, a colon and the value as text."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]).cast("binary"), 256)


def manifest(docs: DataFrame, fanout: int = 2, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, other_leaf, subroot, root and path of every row of documents: one tree per lang, its leaves ascending by doc_id, and
    a tree over the langs' roots (null first, then by UTF-8 bytes).

    ``other_leaf`` is the digest of the row with n_chars greater by 1 where ``altered`` holds, else null. A null field has a digest of its
    own kind, a null id comes first; rows of one id are ordered by their leaves, repeated rows are leaves each, and may lie in several
    partitions; long texts are hashed whole where they are read; a table without rows gives an empty result; other columns are left behind.
    """
    columns = {f: docs[f] for f in FIELDS}
    more = columns | {"n_chars": F.try_add(columns["n_chars"], F.lit(1))}
    own = leaf(list(columns.values()))
    lang = F.coalesce(F.concat(F.lit("="), columns["lang"]), F.lit(""))
    rows = docs.select(
        lang.alias("tree"),
        columns["doc_id"].isNotNull().cast("int").alias("known"),
        F.coalesce(columns["doc_id"].cast("long"), F.lit(0)).alias("doc_id"),
        own.alias("leaf"),
        (F.when(altered, leaf(list(more.values()))) if altered is not None else F.lit(None).cast("string")).alias("other_leaf"),
    )
    hashed = stored(rows, "hashed")  # read twice below, to be counted and to be cut into ranges
    trees = grow(hashed, ["known", "doc_id", "leaf"], fanout)
    subroots = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    over = grow(subroots, ["name"], fanout).paths()
    above = over.select(F.col("name").alias("tree"), "path", F.col("top").alias("root"))
    dropped(hashed)
    found = trees.paths(above)
    return found.select(F.when(F.col("known") == 1, F.col("doc_id")).alias("doc_id"), "leaf", "other_leaf", F.col("root").alias("subroot"), F.col("top").alias("root"), "path")


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf up and from left to right."""
    return F.sha2(F.translate(path, "*/", "").cast("binary"), 256)


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.aggregate(steps, own, lambda h, s: F.sha2(F.replace(s, F.lit("*"), h).cast("binary"), 256))


def oracle() -> str:
    """DuckDB SQL for the query's rows."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    text = lambda n: " || ".join(part(n if f == "n_chars" else f) for f in FIELDS)

    def tree(name: str, leaves: str) -> str:
        return f"""{name}(tree, l, i, n, h) AS (SELECT tree, 0, i, n, leaf FROM {leaves}
  UNION ALL SELECT tree, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, l, i // 2, n)"""

    def walk(name: str, start: str, nodes: str) -> str:
        return f"""{name}(r, tree, l, i, n, proof, f) AS (SELECT * FROM ({start})
  UNION ALL SELECT w.r, w.tree, w.l + 1, w.i // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''),
   sha256(CASE WHEN w.i % 2 = 0 THEN w.f || coalesce(s.h, '') ELSE s.h || w.f END)
  FROM {name} w LEFT JOIN {nodes} s ON s.tree = w.tree AND s.l = w.l AND s.i = xor(w.i, 1) WHERE w.n > 1)"""

    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({text('n_chars')}) AS leaf,
  CASE WHEN crc32_of % 7 = 0 THEN sha256({text('(n_chars + 1)')}) END AS other FROM (SELECT *, {crc32_sql("coalesce(doc_id::VARCHAR, '')")} AS crc32_of FROM documents)),
 leaves AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
 {tree('nodes', 'leaves')},
 subroots AS (SELECT '' AS tree, tree AS name, h AS leaf, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
 {tree('tops', 'subroots')},
 {walk('low', "SELECT r, tree, 0, i, n, '', coalesce(other, leaf) FROM leaves", 'nodes')},
 {walk('high', "SELECT w.r, '', 0, s.i, s.n, w.proof, w.f FROM low w JOIN subroots s ON s.name = w.tree WHERE w.n = 1", 'tops')}
SELECT doc_id, leaves.leaf, subroots.leaf AS subroot, tops.h AS root, sha256(high.proof) AS proof_sha256, high.f AS folded_root, high.f = tops.h AS verified
FROM leaves JOIN high ON high.r = leaves.r AND high.n = 1 JOIN subroots ON subroots.name = leaves.tree JOIN tops ON tops.n = 1"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB SQL, bit by bit."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: unicode(ch)::BIGINT)),
   lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)), lambda c, k: {step})))"""
