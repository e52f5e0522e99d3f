"""Joining by buckets: similar nodes that share one become one class, whatever the bucket's size.

A *node* is a distinct content; rows with that content are its members.  In every
bucket each node is compared with the bucket's leader, its smallest node.  What is
unlike the leader is then compared with all other nodes of the bucket, in blocks of
``PART`` nodes; pairs known to be of one class by then are left out.  So every pair
that shares a bucket is compared or of one class, and no task meets more than two
blocks.  Pairs of which neither node is a *probe* there are not asked for.

A node keeps its smallest like leader and links that leader with its others; classes
are connected components of these links, found by contracting each node into its
smallest neighbour until no link is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared_store import Scratch

PART = 256
#: Ids of so many rows at most are sent to every executor; more of them are joined by shuffling.
BROADCAST_ROWS = 1_000_000
NO_ID = (1 << 63) - 1
#: Bits of a node's role in a task.
PROBE, LIKE = 1, 2
#: For the content of a task's rows (a list a column) and the pairs asked for (a mask of left rows by right rows): the pairs worth a closer look, and whether a pair is near.
Judge = Callable[[dict[str, list], np.ndarray, np.ndarray, np.ndarray], tuple[Iterable[tuple[int, int]], Callable[[int, int], bool]]]


def named(content: str, key: str) -> list[Column]:
    """doc, the id (NO_ID for null), and alt, which tells rows without an id apart by their content."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.when(F.col(key).isNull(), F.xxhash64(F.col(content))).otherwise(F.lit(0)).alias("alt")]


def within(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if it has ``most`` rows at the most, else as it is; for written tables, whose count is cheap."""
    return F.broadcast(df) if df.count() <= most else df


# ---------------------------------------------------------------- comparing


def whole_tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by task, cut anew so that no task is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column("task").to_numpy()
        last = int(np.argmax(task == task[-1]))
        if held and held[-1].column("task")[-1].as_py() != task[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def by_task(seats: DataFrame, content: DataFrame, work: Callable[..., list], schema: str) -> DataFrame:
    """Rows of ``schema`` that work(task, node, label, role, side, content of each row) gives for each task."""
    held, seat = [c for c in content.columns if c != "node"], ["node", "label", "role", "side"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tasks(batches):
            task, *columns = (table.column(c).to_numpy() for c in ("task", *seat))
            given = {c: table.column(c).to_pylist() for c in held}
            cut = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True]).tolist()
            rows = [x for lo, hi in zip(cut[:-1], cut[1:]) for x in work(int(task[lo]), *(c[lo:hi] for c in columns), {c: v[lo:hi] for c, v in given.items()})]
            out = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    rows = seats.join(content, "node").select("task", *seat, *held)
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, schema)


def asked_pairs(node: np.ndarray, label: np.ndarray, role: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left rows, right rows, and a mask of the pairs asked for: not of one label, not of two like nodes, not without a probe."""
    first = {x: i for i, x in reversed(list(enumerate(zip(node.tolist(), side.tolist(), strict=True))))}
    once = np.array(sorted(first.values()))  # a node's content may have been written twice
    left, right = once[(side[once] & 1) > 0], once[(side[once] & 2) > 0]
    asked = (label[left][:, None] != label[right]) & (((role[left][:, None] | role[right]) & PROBE) > 0) & ((role[left][:, None] & role[right] & LIKE) == 0)
    asked &= (side[left][:, None] != 3) | (side[right] != 3) | (node[left][:, None] < node[right])
    return left, right, asked


def compared(seats: DataFrame, content: DataFrame, judge: Judge) -> DataFrame:
    """Links (a, b), a < b, between left and right nodes of each task, as many as join its labels and no more.

    seats has (task, node, label, role, side): side 1 for left, 2 for right, 3 for both.
    """

    def work(_: int, node: np.ndarray, label: np.ndarray, role: np.ndarray, side: np.ndarray, given: dict[str, list]) -> list[tuple]:
        left, right, asked = asked_pairs(node, label, role, side)
        return task_links(node, label, *judge(given, left, right, asked)) if asked.any() else []

    return by_task(seats, content, work, "a long, b long")


def task_links(node: np.ndarray, label: np.ndarray, pairs: Iterable[tuple[int, int]], near: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    root, out = {x: x for x in label.tolist()}, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for p, q in pairs:
        x, y = find(int(label[p])), find(int(label[q]))
        if x != y and near(p, q):
            root[max(x, y)] = min(x, y)
            out.append((min(int(node[p]), int(node[q])), max(int(node[p]), int(node[q]))))
    return out


# ---------------------------------------------------------------- buckets


def linked(scratch: Scratch, members: DataFrame, by: list[str], content: DataFrame, judge: Judge) -> DataFrame:
    """Links (a, b) whose components are the classes of near nodes.

    members has the columns ``by`` (a bucket), n (its nodes), node, probe, and the
    bucket's leader a with its lead_probe.
    """
    # every node against its leaders; the members of a large bucket are dealt in blocks of their own
    pair = members.where("node <> a and (probe or lead_probe)").groupBy("a", "node").agg(F.max("n").alias("n")).withColumn("k", F.ceil(F.col("n") / PART))
    pair = pair.select("a", "node", F.xxhash64("a", "k", F.pmod(F.xxhash64("node"), F.col("k"))).alias("task"))
    leader = pair.select("task", F.col("a").alias("node"), F.lit(1).alias("side")).distinct()
    seats = pair.select("task", "node", F.lit(2).alias("side")).unionAll(leader)
    seats = seats.withColumns({"label": F.col("node"), "role": F.lit(PROBE)})
    good = scratch.keep(compared(seats, content, judge), "stars")
    star = scratch.keep(good.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"), F.collect_set("a").alias("likes")), "labels")
    links = star.select(F.col("label").alias("a"), F.col("node").alias("b")).unionAll(star.select(F.col("label").alias("a"), F.explode("likes").alias("b")).where("a <> b").distinct())
    marked = members.where("node <> a").join(star, "node", "left")
    like = F.coalesce(F.array_contains("likes", F.col("a")), F.lit(False))
    role = F.when(F.col("probe"), PROBE).otherwise(0) + F.when(like, LIKE).otherwise(0)
    marked = scratch.keep(marked.select(*by, "node", role.alias("role"), F.coalesce("label", "node").alias("label")), "marked")
    more = scratch.keep(compared(seated(scratch, marked, by), content, judge), "more")
    scratch.drop("marked", "mixed")
    return more.unionAll(links)


#: Which roles must meet: unlike probes all others, unlike others the like probes.
_MEET = [(PROBE, PROBE), (PROBE, 0), (PROBE, LIKE), (PROBE, PROBE | LIKE), (0, PROBE | LIKE)]


def seated(scratch: Scratch, marked: DataFrame, by: list[str]) -> DataFrame:
    """Seats (task, node, label, role, side) for the buckets in which nodes unlike the leader have others to meet.

    marked has (``by``, node, role, label) without the leaders, which have met all
    they have to.  Buckets of the same nodes are taken once.  A bucket of ``PART``
    nodes at most is one task; the nodes of each role are dealt in blocks otherwise.
    """
    same = [F.bit_xor(F.xxhash64("node", "role")).alias("h1"), F.bit_xor(F.xxhash64("node", "role", F.lit(1))).alias("h2")]
    size = [F.count_if(F.col("role") == r).alias(f"n{r}") for r in range(4)]
    mixed = marked.groupBy(*by).agg(*size, F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), *same)
    mixed = mixed.where(f"lo < hi and (n{PROBE} > 0 or (n0 > 0 and n{PROBE | LIKE} > 0))")
    mixed = mixed.groupBy("n0", "n1", "n2", "n3", "h1", "h2").agg(F.min(F.struct(*by)).alias("b"))
    blocks = [F.ceil(F.col(f"n{r}") / PART).cast("int").alias(f"k{r}") for r in range(4)]
    mixed = scratch.keep(mixed.select("b.*", (F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3") <= PART).alias("small"), *blocks), "mixed")
    placed = marked.join(mixed, by)
    mine = F.coalesce(*(F.when(F.col("role") == r, F.col(f"k{r}")) for r in range(4)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), mine).cast("int"))
    none = F.array().cast("array<struct<pair:int,i:int,j:int,side:int>>")

    def seat(pair: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.lit(pair).alias("pair"), i.alias("i"), j.alias("j"), side.alias("side"))

    def each(role: int, make: Callable[[Column], Column]) -> Column:
        """A seat for every block of the role."""
        count = F.col(f"k{role}")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), make)).otherwise(none)

    def meeting(pair: int, x: int, y: int) -> Iterator[tuple[int, Column]]:
        part = F.col("part")
        if x == y:  # a block meets itself and every other one, as the left of the two where its number is the smaller
            yield x, each(x, lambda j: seat(pair, F.least(part, j), F.greatest(part, j), F.when(j == part, 3).when(j > part, 1).otherwise(2)))
        else:
            yield x, each(y, lambda j: seat(pair, part, j, F.lit(1)))
            yield y, each(x, lambda i: seat(pair, i, part, F.lit(2)))

    ways: dict[int, list[Column]] = {r: [] for r in range(4)}
    for pair, (x, y) in enumerate(_MEET):
        for role, seats in meeting(pair, x, y):
            ways[role].append(seats)
    seats = F.when(F.col("small"), F.array(seat(0, F.lit(0), F.lit(0), F.lit(3))))
    for r in range(4):
        seats = seats.when(F.col("role") == r, F.concat(*ways[r]))
    placed = placed.withColumn("s", F.explode(seats))
    return placed.select(F.xxhash64(*by, "s.pair", "s.i", "s.j").alias("task"), "node", "label", "role", "s.side")


# ---------------------------------------------------------------- classes


def components(scratch: Scratch, links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node of each connected component of links (a, b); only nodes with links.

    Every turn contracts each node into its smallest neighbour, if that is
    smaller, and keeps the links that are left between different nodes.
    """
    edge = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edge, label, turn = scratch.keep(edge, f"{name}-links-0"), None, 0
    while turn == 0 or not edge.isEmpty():
        both = edge.unionAll(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        into = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), f"{name}-into-{turn}")
        ends = edge.join(into.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(into.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        turn += 1
        edge = scratch.keep(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), f"{name}-links-{turn}")
        scratch.drop(f"{name}-links-{turn - 1}")
        further = into.select(F.col("node").alias("label"), F.col("label").alias("_to"))
        label = into if label is None else label.join(further, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    return scratch.keep(label, name)


def nodes_of(scratch: Scratch, rows: DataFrame, payload: list[str]) -> DataFrame:
    """(d1, d2, payload..., at, node) of every distinct content (d1, d2) of the written rows; at is its smallest (doc, alt)."""
    first = F.min(F.struct("doc", "alt")).alias("at")
    found = rows.where("d1 is not null").groupBy("d1", "d2").agg(*(F.first(c).alias(c) for c in payload), first)
    # numbered before it is written, so a node keeps its number
    return scratch.keep(found.withColumn("node", F.monotonically_increasing_id()), "nodes")


def classed(scratch: Scratch, rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, alt, own, lead, node) of the written rows (doc, alt, own, d1, d2): lead is the smallest (doc, alt) of its class, null for rows without content."""
    # contents that share an id are of one class, and rows of that id without content too
    pair = F.when(F.col("d1").isNotNull(), F.struct("d1", "d2"))
    several = rows.groupBy("doc", "alt").agg(F.count("*").alias("n"), F.count(pair).alias("full"), F.min(pair).alias("lo"), F.max(pair).alias("hi"))
    several = scratch.keep(several.where("lo <> hi or full between 1 and n - 1").select("doc", "alt"), "several")
    shared = not several.isEmpty()
    if shared:
        theirs = rows.where("d1 is not null").join(several, ["doc", "alt"]).join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc", "alt", "node")
        links = links.unionAll(theirs.join(theirs.groupBy("doc", "alt").agg(F.min("node").alias("a")), ["doc", "alt"]).select("a", F.col("node").alias("b")))
    label = components(scratch, links)
    slim = nodes.select("d1", "d2", "at", "node")
    lead = label.join(slim, "node").groupBy("label").agg(F.min("at").alias("lead"))
    lead = label.join(lead, "label").select("node", "lead")
    classes = scratch.keep(slim.join(lead, "node", "left").select("d1", "d2", F.coalesce("lead", "at").alias("lead"), "node"), "classes")
    out = rows.select("doc", "alt", "own", "d1", "d2").join(classes, ["d1", "d2"], "left").select("doc", "alt", "own", "lead", "node")
    if shared:
        least = out.join(several, ["doc", "alt"], "left_semi").groupBy("doc", "alt").agg(F.min("lead").alias("_lead"))
        out = out.join(least, ["doc", "alt"], "left").select("doc", "alt", "own", F.coalesce("lead", "_lead").alias("lead"), "node")
    return out


def known(column: str) -> Column:
    """The id, null for rows without one."""
    return F.when(F.col(column) != NO_ID, F.col(column))
