"""Exact top-k search by distributed histogram selection.

Scores are whole numbers (inner products of quantized vectors), so a query's k-th best score can be found by counting: every
round scores all candidates against all queries block by block, counts each query's scores in `BINS` equal
bins of its open range, adds the counts up, and narrows the range to the bin that holds the k-th best. After a few rounds
the range is one number. The last pass keeps what is better, and of what is equal each block's smallest ids, as many as are missing.

Queries and candidates are cut into blocks; a task takes one block of each and holds one stripe of the score matrix at a
time. What moves is a histogram for each query and candidate block, never the scores.

Defined results: a vector that is null, or holds a null, NaN or infinite component, and a row without an id, takes no part. Vectors of
different lengths are compared as if the shorter one ended in zeros. Rows with equal ids are all candidates, but never for a
query of that id, which is asked once. Fewer than k candidates give fewer results. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE, K, BINS = 256, 5, 64
QUERY_BLOCK, CANDIDATE_BLOCK = 1_024, 8_192
STRIPE = 1_024


def quantized(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """`(id, q)`: usable vectors as floor(scale * x)."""
    usable = F.col(id_column).isNotNull() & F.col(column).isNotNull() & F.forall(
        column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    )
    q = F.transform(column, lambda x: F.floor(x.cast("double") * float(scale)).cast("double"))
    return vectors.filter(usable).select(F.col(id_column).cast("long").alias("id"), q.alias("q"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    sizes = np.diff(at)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], sizes)] = flat[at[0] : at[-1]]
    return out


def _sides(t: pa.Table):
    """Queries and candidates of a group: a table, sorted by id, and a matrix each."""
    q, c = (t.filter(pc.equal(t["side"], s)).sort_by("id") for s in (0, 1))
    if not len(q) or not len(c):
        return None
    width = max(int(pc.max(pc.list_value_length(x["q"])).as_py() or 0) for x in (q, c))
    a, b = _matrix(q["q"], width), _matrix(c["q"], width)
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1)
    if most >= 2**63:
        raise ValueError("scores beyond 64 bits")
    if most >= 2**53:
        a, b = a.astype(np.int64), b.astype(np.int64)
    return q, c, a, b


def _stripes(q, c, a, b):
    """Scores of all queries with a stripe of candidates; a candidate of the query's own id is marked."""
    q_id, c_id = q["id"].to_numpy(), c["id"].to_numpy()
    for i in range(0, len(c_id), STRIPE):
        yield c_id[i : i + STRIPE], (a @ b[i : i + STRIPE].T).astype(np.int64), q_id[:, None] == c_id[None, i : i + STRIPE]


def _histogram(t: pa.Table) -> pa.Table:
    """Counts of each query's scores by bin of its open range; counts above the range go to the last column."""
    got = _sides(t)
    names = [f"h{i}" for i in range(BINS + 1)]
    if got is None:
        return pa.table({"id": pa.array([], pa.int64()), **{n: pa.array([], pa.int64()) for n in names}})
    q, c, a, b = got
    lo, width, span = (q[x].to_numpy() for x in ("lo", "width", "span"))
    total = np.zeros((len(q), BINS + 1), np.int64)
    base = np.arange(len(q))[:, None] * (BINS + 2)
    for _, scores, own in _stripes(q, c, a, b):
        bins = np.clip((scores - lo[:, None]) // width[:, None], -1, BINS)
        bins[scores >= (lo + span)[:, None]] = BINS
        bins[own] = -1
        total += np.bincount((bins + 1 + base).ravel(), minlength=len(q) * (BINS + 2)).reshape(len(q), -1)[:, 1:]
    return pa.table({"id": q["id"], **{n: total[:, i] for i, n in enumerate(names)}})


def _best(t: pa.Table) -> pa.Table:
    """Candidates above each query's k-th score, and of those at it the smallest ids, as many as are missing."""
    got = _sides(t)
    ids, others, values = ([np.zeros(0, np.int64)] for _ in range(3))
    if got is not None:
        q, c, a, b = got
        cut, ties = q["lo"].to_numpy(), q["ties"].to_numpy()
        q_id, left = q["id"].to_numpy(), ties.copy()
        for c_id, scores, own in _stripes(q, c, a, b):
            above = (scores > cut[:, None]) & ~own
            equal = (scores == cut[:, None]) & ~own
            equal &= np.cumsum(equal, axis=1) <= left[:, None]
            left = left - equal.sum(axis=1)
            r, k = np.nonzero(above | equal)
            ids.append(q_id[r])
            others.append(c_id[k])
            values.append(scores[r, k])
    return pa.table({"query_id": np.concatenate(ids), "vec_id": np.concatenate(others), "score": np.concatenate(values)})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """Per query id: its k best candidates by inner product, ties to the smaller id.

    Both sides are `(id, q)` as `quantized` returns them.
    """
    spark = candidates.sparkSession
    asked = stored(queries.groupBy("id").agg(F.min("q").alias("q")), "queries")
    pool = stored(candidates, "candidates")
    sizes = pool.agg(F.count("*"), F.max(F.expr("aggregate(q, 0D, (m, x) -> greatest(m, abs(x)))")), F.max(F.size("q"))).first()
    n_queries = asked.count()
    if not sizes[0] or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_blocks, c_blocks = (-(-n // most) for n, most in ((n_queries, QUERY_BLOCK), (sizes[0], CANDIDATE_BLOCK)))
    # every candidate block meets every query block; a stripe of scores is all that a task holds
    c_side = pool.select(
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("i"), F.pmod(F.xxhash64("id", "q"), F.lit(c_blocks)).cast("int").alias("j"),
        F.lit(1).alias("side"), "id", "q",
        *[F.lit(0).cast("long").alias(x) for x in ("lo", "width", "span", "ties")],
    )
    norms = "aggregate(q, 0D, (m, x) -> m + abs(x))"
    reach = F.ceil(F.expr(norms) * F.lit(float(sizes[1] or 0.0)) + 1).cast("long")
    width = F.greatest(F.ceil((reach * 2 + 1) / F.lit(float(BINS))), F.lit(1)).cast("long")
    state = asked.select("id", "q", (-reach).alias("lo"), width.alias("width"), (width * BINS).alias("span"), F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("ties"), F.lit(False).alias("short"))

    def dealt(now: DataFrame) -> DataFrame:
        q_side = now.select(
            F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("j"),
            F.lit(0).alias("side"), "id", "q", "lo", "width", "span", "ties",
        )
        return q_side.unionByName(c_side).groupBy("i", "j")

    widest = state.agg(F.max("width")).first()[0]
    counts = ", ".join(f"h{i} long" for i in range(BINS + 1))
    while True:
        found = dealt(state).applyInArrow(_histogram, f"id long, {counts}").groupBy("id").agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(BINS + 1)])
        down = F.array(*[F.col(f"h{i}") for i in range(BINS - 1, -1, -1)])
        # walk from the best bin down until the counts reach what is needed; the lowest bin if there are fewer
        walk = F.aggregate(
            down, F.struct(F.lit(0).alias("n"), F.col("need").alias("left"), F.lit(False).alias("done")),
            lambda s, h: F.when(s["done"], s).otherwise(
                F.struct(
                    F.when(h >= s["left"], s["n"]).otherwise(s["n"] + 1).cast("int").alias("n"),
                    F.when(h >= s["left"], s["left"]).otherwise(s["left"] - h).alias("left"), (h >= s["left"]).alias("done"),
                )
            ),
        )
        near = state.join(found, "id").withColumn("w", walk)
        short = F.col("short") | ~F.col("w.done")
        low = F.when(short, F.col("lo")).otherwise(F.col("lo") + (BINS - 1 - F.col("w.n")) * F.col("width"))
        finer = F.greatest(F.ceil(F.col("width") / F.lit(float(BINS))), F.lit(1)).cast("long")
        state = stored(
            near.select(
                "id", "q", low.cast("long").alias("lo"), F.when(short, F.lit(1)).otherwise(finer).cast("long").alias("width"),
                F.when(short, F.lit(1)).otherwise(F.col("width")).cast("long").alias("span"),
                F.when(short, F.lit(0)).otherwise(F.col("w.left")).cast("long").alias("need"),
                F.when(short, F.lit(k)).otherwise(F.col("w.left")).cast("long").alias("ties"),
                short.alias("short"),
            ),
            "state",
        )
        if widest <= 1:
            break
        widest = max(1, -(-widest // BINS))
    best = dealt(state).applyInArrow(_best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
