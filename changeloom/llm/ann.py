"""Approximate nearest neighbours on robust-pruned directed graphs, one a shard.

Equal vectors become one node.  Nodes are dealt to shards by a hash, and each
shard links its own: nodes are inserted in growing batches; a greedy beam
search through the graph so far proposes neighbours; pruning keeps a proposal
only if no kept neighbour is nearer to it by the relaxed factor ALPHA; kept
edges are also drawn backwards, and pruned again where a node has too many.
A query walks every shard's graph by beam search; the shards' best are merged
and rows of equal vectors put back, so no row is out of reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.shared import Scratch, list_array, parts, tune

#: Fewest and most nodes of a shard, edges of a node, width of the beam, relaxation of pruning, queries of a block.
SHARD, LARGE, DEGREE, BEAM, ALPHA, QUERIES = 4096, 65536, 32, 64, 1.2, 8192
_BATCH = 128


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The nearest nodes found (ids and distances, nearest first, -1 where none) and all expanded nodes, for many queries in step."""
    n, rows = len(q), np.arange(len(q))
    ids = np.full((n, width), -1, np.int64)
    dist = np.full((n, width), np.inf, np.float32)
    open_ = np.zeros((n, width), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], dist[:, 0], open_[:, 0], seen[:, start] = start, 1 - q @ x[start], True, True
    expanded = []
    while True:
        best = np.where(open_, dist, np.inf).argmin(1)
        live = open_[rows, best]
        if not live.any():
            return ids, dist, expanded
        node = np.where(live, ids[rows, best], -1)
        expanded.append(node)
        open_[rows, best] = False
        near = np.where(live[:, None], graph[node], -1)
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(fresh)
        seen[r, near[r, c]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = 1 - np.einsum("ij,ij->i", x[near[r, c]], q[r])
        ids, dist, open_ = (np.concatenate(p, 1) for p in ((ids, np.where(fresh, near, -1)), (dist, d), (open_, fresh)))
        order = np.argsort(dist, 1, kind="stable")[:, :width]
        ids, dist, open_ = (np.take_along_axis(p, order, 1) for p in (ids, dist, open_))


def prune(x: np.ndarray, points: np.ndarray, proposals: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point, diverse neighbours out of its proposals (-1: none), nearest first."""
    ok = (proposals >= 0) & (proposals != points[:, None])
    safe = np.where(ok, proposals, 0)
    v = x[safe]
    d = np.where(ok, 1 - np.einsum("pcd,pd->pc", v, x[points]), np.inf)
    between = 1 - np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((len(points), degree), -1, np.int64)
    rows, filled = np.arange(len(points)), np.zeros(len(points), np.int64)
    for _ in range(degree):
        best = d.argmin(1)
        live = np.isfinite(d[rows, best])
        if not live.any():
            break
        out[rows[live], filled[live]] = safe[rows[live], best[live]]
        filled += live
        # distances here are half the squared ones, so the factor is squared
        near = alpha * alpha * between[rows, best] <= d
        d[near & live[:, None]] = np.inf
        d[rows, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, width: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(graph, start) over unit vectors; the start is the node nearest to their mean."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    start = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(1).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done, size = 1, 1
    while done < n:
        batch = order[done : done + size]
        ids, _, expanded = beam_search(x, graph, start, x[batch], width)
        proposals = np.concatenate([ids, np.stack(expanded, 1)], 1)
        proposals.sort(1)
        proposals[:, 1:][proposals[:, 1:] == proposals[:, :-1]] = -1
        graph[batch] = prune(x, batch, proposals, degree, alpha)
        # backward edges, by target
        source, target = np.repeat(batch, degree), graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        incoming = np.full((len(hit), count.max(initial=1)), -1, np.int64)
        incoming[np.repeat(np.arange(len(hit)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        merged = np.concatenate([graph[hit], incoming], 1)
        merged = np.take_along_axis(merged, np.argsort(merged < 0, 1, kind="stable"), 1)
        full = (merged >= 0).sum(1) > degree
        graph[hit[~full]] = merged[~full][:, :degree]
        for at in range(0, int(full.sum()), 256):
            some = np.flatnonzero(full)[at : at + 256]
            graph[hit[some]] = prune(x, hit[some], merged[some], degree, alpha)
        done += len(batch)
        size = min(_BATCH, size * 2)
    return graph, start


def shards_for(nodes: int, parallel: int) -> int:
    """As many shards as tasks can run, of SHARD to LARGE nodes each: a walk's length hardly grows with its shard, but every query walks every shard."""
    return max(1, -(-nodes // min(LARGE, max(SHARD, -(-nodes // parallel)))))


def index(df: DataFrame, k: int, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index table: (dim, shard, start, node, ids, vector, near), a row for each different vector.

    ids: the k + 1 smallest ids of the vector's rows, all that a search for k
    can return.  They are ranked within salts first, so one vector with very
    many rows spreads.  Vectors that are null, empty, zero, or hold a null or
    non-finite component take no part, nor do null ids.
    """
    rows = usable(df, id_col, vector_col)
    salt = F.pmod(F.xxhash64("id"), F.lit(32))
    for keys in (["v1", "v2", salt], ["v1", "v2"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        rows = rows.withColumn("r", rank).where(F.col("r") <= k + 1).drop("r")
    nodes = rows.groupBy("v1", "v2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector"))
    nodes = scratch.keep(nodes.withColumn("dim", F.size("vector")), "nodes")
    shards = shards_for(nodes.count(), parts(df.sparkSession))
    nodes = nodes.withColumn("shard", F.pmod("v1", F.lit(shards)).cast("int")).select("dim", "shard", "v1", "ids", "vector")

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("v1").combine_chunks()
        x = _matrix(table["vector"])
        graph, start = build((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
        n = len(x)
        near = list_array(graph.ravel().astype(np.int32), [graph.shape[1]] * n, pa.int32())
        return pa.table({"dim": table["dim"], "shard": table["shard"], "start": pa.array(np.full(n, start, np.int32)), "node": pa.array(np.arange(n, dtype=np.int32)), "ids": table["ids"], "vector": table["vector"], "near": near})

    nodes = nodes.repartition(max(shards, parts(df.sparkSession)), "dim", "shard")  # else small shards would share a task
    linked = nodes.groupBy("dim", "shard").applyInArrow(link, "dim int, shard int, start int, node int, ids array<bigint>, vector array<double>, near array<int>")
    return scratch.keep(linked, "index")


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles, v1, v2: two hashes of it with different seeds, 128 bits together) of the rows that take part."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where("id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    return rows.withColumns({"v1": F.xxhash64("vector"), "v2": F.xxhash64(F.lit(1), "vector")})


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def search(table: DataFrame, queries: DataFrame, k: int, n_queries: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by cosine.

    queries: (id, vector).  Queries come in blocks of about QUERIES, every block
    meets every shard once, and a task holds one shard and one block.  A row
    with the query's own id is no candidate.  Ties go to the smaller id.  Of
    repeated query ids all vectors are searched, and a candidate counts by its
    best score.
    """
    blocks = max(1, -(-n_queries // QUERIES))
    places = table.groupBy(F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard")).agg(F.count("*").alias("nodes"))
    asked = queries.select("id", "vector", F.size("vector").alias("q_dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("q_block"))
    asked = asked.join(places, "q_dim").select("q_dim", "q_shard", "q_block", "id", "vector")
    copies = table.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<int>")))

    def walk(nodes: pa.Table, block: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if nodes.num_rows and block.num_rows:
            nodes = nodes.sort_by("node").combine_chunks()
            x, q = _matrix(nodes["vector"]), _matrix(block["vector"])
            x_norm, q_norm = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
            unit, graph = (x / x_norm[:, None]).astype(np.float32), _matrix(nodes["near"]).astype(np.int64)
            members, names = nodes["ids"].to_pylist(), block["id"].to_pylist()
            for at in range(0, len(q), _BATCH):
                some = q[at : at + _BATCH]
                ids, _, _ = beam_search(unit, graph, nodes["start"][0].as_py(), (some / q_norm[at : at + _BATCH, None]).astype(np.float32), max(BEAM, 2 * k))
                for row, found in enumerate(ids):
                    found = found[found >= 0]
                    score = (x[found] * some[row]).sum(1) / (x_norm[found] * q_norm[at + row])
                    own = names[at + row]
                    for f in np.lexsort((found, -score))[: k + 1]:
                        for vec in members[found[f]]:
                            if vec != own:
                                out["query_id"].append(own)
                                out["vec_id"].append(vec)
                                out["score"].append(float(score[f]))
        return pa.table(out, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    found = copies.groupBy("dim", "shard", "block").cogroup(asked.groupBy("q_dim", "q_shard", "q_block")).applyInArrow(walk, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, is_query: Column, k: int, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Search the rows of df that satisfy is_query against every other row of it; an empty frame gives an empty one."""
    tune(df.sparkSession)
    table = index(df, k, scratch, id_col, vector_col)
    queries = scratch.keep(usable(df.where(is_query), id_col, vector_col).select("id", "vector"), "queries")
    return search(table, queries, k, queries.count())
