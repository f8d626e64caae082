"""Near-duplicate vectors by NN-descent.

Every distinct vector keeps a list of its nearest others. The lists start from random groups. In a round, each vector brings the
members of its list, and those in whose lists it stands, together; they are compared with one another, and whoever finds a
nearer neighbour takes it into its list. Pairs that met before are not compared again, and a vector whose members have all met
sits the round out. Rounds end when few entries change.

A list whose last entry is still above the threshold is saturated: there may be more. Where a saturated neighbourhood
lies so close around one vector (within half the threshold's angle) that all its members are linked with each other for
certain, it is folded into a ball: one entry then stands for all of them, and rounds go on with the balls' leaders. So
a group of near copies as large as a third of the table costs a comparison with its leader for each member, not a pair for
each two. Lists that stay saturated are enlarged, doubled until the last entry is below the threshold.

Links are the list entries at or above the threshold. Two balls, or a ball and a vector, are linked throughout or not at all
where the angles say so; otherwise their members are compared in blocks that return counts, not pairs. Recall is audited: the
links of AUDITED vectors, found by comparing them with all others, are held against those of the lists. While less than GOAL of
them is found, all lists are doubled and get new random entries. The figure is part of the result. A link that is reported has
been evaluated in double precision or is certain by its angles.

Vectors near a hub meet in salted chunks of about HUB, dealt anew each round, so no task gets all of them. Equal vectors are one class
from the start, counted before the shuffle.

Defined results: vectors that are null, empty, zero, or hold a null, NaN or infinite component link with nothing; their component is their
own id. Rows without an id take no part, have no component and are kept. Repeated rows are vectors of their own, linked with
each other; rows of one id with different vectors are looked at apart, each with the least id that its vector reaches. Shorter vectors
are compared as if they ended in zeros. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .vectors import matrix, usable

THRESHOLD = 0.9
#: Entries of a list at first, and members of a random group, about.
LIST, GROUP = 16, 64
#: Members that one task compares with one another at most; a hub's are dealt to chunks of about that size.
HUB = 256
#: Rounds end when this share of all entries is new, at most.
FEW_NEW = 0.1
AUDITED, GOAL = 1_024, 0.98
#: Members of a ball that a block holds, about.
BLOCK = 2_048
#: Angles that are compared with a bound must keep this distance from it, in radians.
MARGIN = 1e-7
#: Found pairs that a task gathers before it drops all but the best.
GATHERED = 400_000


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays."""
    most = np.abs(rows).max(axis=1, initial=0.0, keepdims=True)
    odd = (most > 1e100) | (most < 1e-100)
    rows = np.where(odd & (most > 0), rows / np.where(most > 0, most, 1.0), rows)
    length = np.sqrt(np.einsum("nd,nd->n", rows, rows))[:, None]
    return rows / np.where(length > 0, length, 1.0)


def _best(a: np.ndarray, b: np.ndarray, c: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the pairs (a, b) with cosine c, each a's best k, every b once."""
    order = np.lexsort((b, -c, a))
    a, b, c, k = a[order], b[order], c[order], k[order]
    again = np.zeros(len(a), bool)
    again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    a, b, c, k = a[~again], b[~again], c[~again], k[~again]
    first = np.searchsorted(a, a, "left")
    good = np.arange(len(a)) - first < k
    return a[good], b[good], c[good], k[good]


def _local_join(width: int):
    """Compares the members of each centre with one another; what is new and good enough for a list comes out."""

    def block(member, fresh, x, k, bound):
        at = np.unique(member, return_index=True)[1]
        if len(at) < len(member):  # a member may come from both directions
            fresh = np.bincount(np.searchsorted(member[at], member), fresh) > 0
            member, x, k, bound = member[at], x[at], k[at], bound[at]
        if len(member) < 2 or not fresh.any():
            return None
        s = x @ x.T
        wanted = (s > bound[:, None]) & (fresh[:, None] | fresh[None, :])
        np.fill_diagonal(wanted, False)
        i, j = np.nonzero(wanted)
        return (member[i], member[j], np.einsum("nd,nd->n", x[i], x[j]), k[i]) if len(i) else None

    def out(found):
        a, b, c, k = _best(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return (a, b, c, k), pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(k)], ["node", "nbr", "cos", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found, size = None, [], 0
        for batch in _then_none(batches):
            if batch is not None:
                own = [
                    np.stack([batch["centre"].to_numpy(), batch["chunk"].to_numpy().astype(np.int64)], axis=1), batch["member"].to_numpy(),
                    batch["fresh"].to_numpy() > 0, unit(matrix(batch["v"], width, np.float64)), batch["k"].to_numpy(), batch["bound"].to_numpy(),
                ]
                rest = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
            if rest is None:
                break
            key = rest[0]
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            ends = [*cuts, *([len(key)] if batch is None else [])]
            start = 0
            for end in ends:
                for i in range(start, end, 2 * HUB):
                    got = block(*(x[i : min(end, i + 2 * HUB)] for x in rest[1:]))
                    if got:
                        found.append(got)
                        size += len(got[0])
                start = end
                if size > GATHERED:
                    kept, ready = out(found)
                    found, size = [kept], 0
                    if 2 * len(ready) > GATHERED:
                        yield ready
                        found = []
            rest = [x[start:] for x in rest]
        if found:
            yield out(found)[1]

    return run


def _then_none(batches):
    yield from batches
    yield None


_LISTS = ["node", "nbr", "cos", "fresh", "k"]


class _Graph:
    """Lists `(node, nbr, cos, fresh, k)` of the active nodes `(node, v, w, least, k, reach)`, and the balls folded so far."""

    def __init__(self, nodes: DataFrame, threshold: float, seed: int):
        self.nodes, self.threshold, self.seed = nodes, threshold, seed
        self.spark = nodes.sparkSession
        self.count, self.width = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
        self.active, self.most = self.count, LIST
        self.lists = self.spark.createDataFrame([], "node long, nbr long, cos double, fresh int, k int")
        self.balls = None  # (node, leader, angle)
        self.turn = np.arccos(threshold)

    def random_groups(self, restarted: DataFrame | None) -> DataFrame:
        """Every active node in one group of about GROUP, dealt by chance; of use to the restarted ones, or to all."""
        self.seed += 1
        group = F.pmod(F.xxhash64(F.lit(self.seed), "node"), F.lit(-(-self.active // GROUP)))
        fresh = F.lit(1)
        nodes = self.nodes.select("node")
        if restarted is not None:
            nodes, fresh = nodes.join(restarted.withColumn("again", F.lit(1)), "node", "left"), F.coalesce("again", F.lit(0))
        # groups are centres of their own, apart from the nodes by their sign
        return nodes.select((-group - 1).alias("centre"), F.col("node").alias("member"), fresh.alias("fresh"))

    def round(self, more: DataFrame | None = None) -> int:
        """One round over lists and further entries `(centre, member, fresh)`; the number of new entries."""
        self.seed += 1
        entry = lambda c, m: F.struct(F.col(c).alias("centre"), F.col(m).alias("member"), "fresh")
        met = self.lists.select(F.explode(F.array(entry("node", "nbr"), entry("nbr", "node"))).alias("e")).select("e.*")
        met = met.unionByName(more) if more is not None else met
        # centres that have a member to introduce, and into how many chunks their members are dealt
        centres = met.groupBy("centre").agg(F.ceil(F.count("*") / HUB).cast("int").alias("chunks"), F.max("fresh").alias("any")).filter("any = 1")
        centres = stored(centres.select("centre", "chunks"), "centres")
        chunk = F.pmod(F.xxhash64(F.lit(self.seed), "member"), F.col("chunks")).cast("int")
        met = met.join(centres, "centre").select("centre", chunk.alias("chunk"), "member", "fresh")
        last = self.lists.groupBy("node").agg(F.count("*").alias("n"), F.min("cos").alias("least_cos"))
        bound = F.when(F.col("n") >= F.col("k"), F.col("least_cos")).otherwise(F.lit(-2.0))
        now = stored(self.nodes.join(last, "node", "left").select(F.col("node").alias("member"), "v", "k", bound.alias("bound")), "bounds")
        dealt = met.join(now, "member").select("centre", "chunk", "member", "fresh", "v", "k", "bound")
        dealt = dealt.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk")
        found = dealt.mapInArrow(_local_join(self.width), "node long, nbr long, cos double, k int")
        both = found.withColumn("fresh", F.lit(1)).unionByName(self.lists.withColumn("fresh", F.lit(0)))
        rank = F.dense_rank().over(Window.partitionBy("node").orderBy(F.desc("cos"), "nbr"))
        top = both.withColumn("rank", rank).filter(F.col("rank") <= self.most).filter("rank <= k")
        merged = top.groupBy("node", "nbr").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh"), F.max("k").alias("k"))
        self.lists = stored(merged.select(*_LISTS), "lists")
        return self.lists.agg(F.sum("fresh")).first()[0] or 0

    def descend(self, more: DataFrame | None = None, restarted: DataFrame | None = None) -> None:
        """Rounds until few entries are new, of all or of the restarted nodes'."""
        groups = self.random_groups(restarted)
        new = self.round(groups if more is None else groups.unionByName(more))
        few = FEW_NEW * self.most * (self.active if restarted is None else restarted.count())
        while new > few:
            new = self.round()

    def saturated(self) -> DataFrame:
        """Active nodes whose list is full of entries that could all be links: there may be more of them."""
        full = self.lists.groupBy("node").agg(F.count("*").alias("n"), F.min("cos").alias("last"))
        joined = full.join(self.nodes.select("node", "k", "reach"), "node")
        return stored(joined.filter((F.col("n") >= F.col("k")) & (F.col("last") >= F.col("reach")) & (F.col("k") < self.active - 1)).select("node"), "saturated")

    def fold(self, full: DataFrame) -> tuple[int, DataFrame | None, DataFrame | None]:
        """Folds what is certainly linked around one vector into balls.

        Returns how many nodes went, entries that lead to the leaders, and the nodes that lost entries.
        """
        half = float(np.cos(self.turn / 2 - MARGIN))
        near = self.lists.filter(F.col("cos") >= half).join(full, "node", "left_semi").select(F.col("node").alias("a"), F.col("nbr").alias("b"))
        if self.balls is not None:  # leaders stay as they are
            led = stored(self.balls.select(F.col("leader").alias("l")).distinct(), "leaders")
            near = near.join(led, near["a"] == led["l"], "left_anti").join(led, near["b"] == led["l"], "left_anti")
        labels = stored(components(near).filter("node <> label"), "labels")
        v = lambda name, of: self.nodes.select(F.col("node").alias(name), F.col("v").alias(of))
        pairs = labels.join(v("node", "x"), "node").join(v("label", "y"), "label")
        width = self.width

        def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cos = np.einsum("nd,nd->n", unit(matrix(b["x"], width, np.float64)), unit(matrix(b["y"], width, np.float64)))
                good = cos >= half
                angle = np.arccos(np.clip(cos[good], -1, 1))
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([b["node"].filter(keep), b["label"].filter(keep), pa.array(angle)], ["node", "leader", "angle"])

        folded = stored(pairs.select("node", "label", "x", "y").mapInArrow(angles, "node long, leader long, angle double"), "folded")
        n = folded.count()
        if not n:
            return 0, None, None
        self.balls = folded if self.balls is None else self.balls.unionByName(folded)
        self.active -= n
        gone = folded.select("node")
        radius = stored(self.balls.groupBy("leader").agg(F.max("angle").alias("r")), "radius")
        widest = radius.agg(F.max("r")).first()[0]
        reach = F.cos(F.least(F.lit(float(np.pi)), F.lit(self.turn + MARGIN + widest) + F.coalesce("r", F.lit(0.0))))
        left = self.nodes.drop("reach").join(gone, "node", "left_anti").join(radius.withColumnRenamed("leader", "node"), "node", "left")
        self.nodes = stored(left.select("node", "v", "w", "least", "k", reach.alias("reach")), "nodes")
        alive = self.lists.join(gone, "node", "left_anti")
        lead = folded.select(F.col("node").alias("nbr"), "leader")
        to_leaders = stored(alive.join(lead, "nbr").select(F.col("leader").alias("centre"), F.col("node").alias("member")).distinct(), "to-leaders")
        more = to_leaders.filter("centre <> member").unionByName(to_leaders.select("centre", F.col("centre").alias("member")).distinct())
        lost = stored(to_leaders.select(F.explode(F.array("centre", "member")).alias("node")).unionByName(folded.select(F.col("leader").alias("node"))).distinct(), "lost")
        self.lists = self._fresh_for(lost, alive.join(gone.select(F.col("node").alias("nbr")), "nbr", "left_anti"))
        return n, more.withColumn("fresh", F.lit(1)), lost

    def _fresh_for(self, nodes: DataFrame, lists: DataFrame) -> DataFrame:
        """The lists, with entries of the given nodes fresh again: what these turned down may come in now."""
        again = nodes.withColumn("again", F.lit(1))
        return stored(lists.drop("fresh").join(again, "node", "left").withColumn("fresh", F.coalesce("again", F.lit(0))).select(*_LISTS), "lists")

    def enlarge(self, nodes: DataFrame) -> None:
        """Twice the list for the given nodes."""
        wide = nodes.withColumn("wide", F.lit(2))
        grown = self.nodes.join(wide, "node", "left").withColumn("k", (F.col("k") * F.coalesce("wide", F.lit(1))).cast("int"))
        self.nodes = stored(grown.select("node", "v", "w", "least", "k", "reach"), "nodes")
        self.lists = self._fresh_for(nodes, self.lists.drop("k").join(self.nodes.select("node", "k"), "node"))
        self.most = self.nodes.agg(F.max("k")).first()[0]

    def grow(self, restarted: DataFrame | None = None) -> None:
        """Rounds, folding and enlarging until no list is saturated."""
        more = None
        while True:
            self.descend(more, restarted)
            full = self.saturated()
            n = full.count()
            if not n:
                return
            folded, more, restarted = self.fold(full)
            if folded * 2 < n:
                rest = stored(full.join(self.nodes.select("node"), "node", "left_semi"), "saturated") if folded else full
                self.enlarge(rest)
                restarted = rest if restarted is None else stored(restarted.unionByName(rest).distinct(), "restarted")


def _block_counts(width: int, threshold: float):
    def run(t: pa.Table) -> pa.Table:
        """For each member of a block of two balls, the weight of the other side's members that it is linked with."""
        side = t["side"].to_numpy()
        x, w, node = unit(matrix(t["v"], width, np.float64)), t["w"].to_numpy(), t["node"].to_numpy()
        one, two = side == 0, side == 1
        linked = x[one] @ x[two].T >= threshold
        links = np.concatenate([linked @ w[two], w[one] @ linked])
        ids = np.concatenate([node[one], node[two]])
        good = links > 0
        u, v = (np.full(int(good.sum()), t[c][0].as_py() if len(t) else 0, np.int64) for c in ("a", "b"))
        return pa.table({"node": ids[good], "links": links[good].astype(np.int64), "a": u, "b": v})

    return run


def _links(graph: _Graph, classes: DataFrame) -> DataFrame:
    """Per class `(node, n_links, component_id)`."""
    spark, t, turn = classes.sparkSession, graph.threshold, graph.turn
    balls = graph.balls if graph.balls is not None else spark.createDataFrame([], "node long, leader long, angle double")
    members = classes.select("node", "w", "least").join(balls, "node", "left")
    members = stored(members.select("node", "w", "least", F.coalesce("leader", "node").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "members")
    sizes = stored(members.groupBy("ball").agg(F.max("angle").alias("r"), F.sum("w").alias("weight"), F.count("*").alias("size")), "balls")
    pairs = graph.lists.select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b"), "cos").groupBy("a", "b").agg(F.max("cos").alias("cos"))
    pairs = pairs.filter(F.col("cos") >= float(np.cos(min(np.pi, turn * 2 + MARGIN))))  # no ball is wider than half the turn
    of = lambda x: sizes.select(F.col("ball").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("r", "weight", "size")])
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    angle, radii = F.acos(F.least("cos", F.lit(1.0))), F.col("r_a") + F.col("r_b")
    alone = (F.col("size_a") == 1) & (F.col("size_b") == 1)
    whole = F.when(alone, F.col("cos") >= t).otherwise(angle + radii <= turn - MARGIN)
    some = ~alone & ~whole & (angle <= turn + radii + MARGIN)
    both = stored(both.withColumns({"whole": whole, "some": some}).filter("whole OR some"), "ball-links")
    to = lambda x, y: F.struct(F.col(x).alias("ball"), F.col(f"weight_{y}").alias("n"))
    full = both.filter("whole").select(F.explode(F.array(to("a", "b"), to("b", "a"))).alias("e")).select("e.*")
    full = stored(full.groupBy("ball").agg(F.sum("n").alias("full_links")), "full-links")

    # balls of which only some members are linked: members in blocks
    open_pairs = both.filter("some").select("a", "b", *[F.ceil(F.col(f"size_{x}") / BLOCK).cast("int").alias(f"n{x}") for x in "ab"])
    with_v = members.select("node", "w", "ball").join(classes.select("node", "v"), "node")

    def dealt(own: str, other: str, side: int) -> DataFrame:
        x = with_v.join(open_pairs, with_v["ball"] == open_pairs[own])
        mine = F.pmod(F.xxhash64("node"), F.col(f"n{own}")).cast("int")
        x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1))).withColumn("m", mine)
        i, j = ("m", "o") if side == 0 else ("o", "m")
        return x.select("a", "b", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "node", "w", "v")

    blocks = dealt("a", "b", 0).unionByName(dealt("b", "a", 1)).groupBy("a", "b", "i", "j")
    counted = stored(blocks.applyInArrow(_block_counts(graph.width, t), "node long, links long, a long, b long"), "block-links")
    single = stored(counted.groupBy("node").agg(F.sum("links").alias("some_links")), "some-links")

    edges = both.filter("whole").select("a", "b").unionByName(counted.select("a", "b").distinct())
    labels = stored(components(edges).withColumnRenamed("node", "ball"), "labels")
    labelled = stored(members.join(labels, "ball", "left").withColumn("label", F.coalesce("label", "ball")), "labelled")
    least = stored(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "least-ids")
    out = labelled.join(least, "label").join(sizes.select("ball", "weight"), "ball").join(full, "ball", "left").join(single, "node", "left")
    n_links = F.col("weight") - 1 + F.coalesce("full_links", F.lit(0)) + F.coalesce("some_links", F.lit(0))
    return stored(out.select("node", n_links.cast("long").alias("n_links"), "component_id"), "links")


def _audit(classes: DataFrame, links: DataFrame, width: int, threshold: float) -> float:
    """The share of the links of AUDITED classes, chosen by hash, that was found; 1 if they have none."""
    chosen = classes.orderBy(F.xxhash64(F.lit(0), "least", "node")).limit(AUDITED).select("node", "v").toArrow()
    ids, x = chosen["node"].to_numpy(), unit(matrix(chosen["v"], width, np.float64))

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            total += (x @ unit(matrix(b["v"], width, np.float64)).T >= threshold) @ b["w"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "truth"])

    truth = classes.select("v", "w").mapInArrow(weights, "node long, truth long").groupBy("node").agg((F.sum("truth") - 1).alias("truth"))
    found, there = truth.join(links, "node").agg(F.sum(F.least("n_links", "truth")), F.sum("truth")).first()
    return found / there if there else 1.0


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", column: str = "embedding", seed: int = 11) -> DataFrame:
    """Per row: vec_id, n_links, component_id (least id reachable by links), kept, and audited_recall."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).alias("v"))
    fit = usable("v") & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    classes = rows.filter(fit).groupBy("v").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"))
    start = {"node": F.monotonically_increasing_id(), "k": F.lit(LIST), "reach": F.lit(threshold)}
    classes = stored(classes.withColumns(start).select("node", "v", "w", "least", "k", "reach"), "classes")
    graph = _Graph(classes, threshold, seed)
    recall = 1.0
    if graph.count:
        graph.grow()
        while True:
            links = _links(graph, classes)
            recall = _audit(classes, links, graph.width, threshold)
            if recall >= GOAL or graph.most >= graph.count - 1:
                break
            graph.enlarge(stored(graph.nodes.select("node"), "all"))
            graph.grow()
        of_vector = stored(classes.select("node", "v").join(links, "node").drop("node"), "vector-links")
    else:
        of_vector = classes.select("v", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    of_vector = of_vector.withColumnRenamed("v", "__v")
    own = rows.withColumn("__fit", F.coalesce(fit, F.lit(False)))
    # rows without a usable vector meet nobody, and must not meet in one task
    joined = own.filter("__fit").join(of_vector, F.col("v") == F.col("__v")).select("vec_id", "n_links", "component_id")
    others = own.filter("NOT __fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return joined.unionByName(others).withColumns({"kept": kept, "audited_recall": F.lit(float(recall))})
