"""Near-duplicate vectors by cross-polytope hashing."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorespark.llm.common import components, join_counted, map_batches, map_runs, saved, tiles

#: Tables, hashes joined to a cell of a table, further cells probed in each table.
TABLES, HASHES, PROBES = 8, 3, 3
SLOT = 512
COSINE = 0.98


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def cells(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """[vector, cell number]: in each table the cell of a vector and the next likely ones.

    A hash is the axis, with its sign, that a vector lies nearest to after three rounds of random signs and Hadamard
    transform. A probe replaces one hash by its second nearest axis where that is the closest call.
    """
    n, d = vectors.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = vectors
    rng, every, out = np.random.default_rng(width), np.arange(n), []
    for t in range(tables):
        first, second, gap = [], [], []
        for _ in range(hashes):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice((-1.0, 1.0), width)) / np.sqrt(width)
            size = np.abs(x)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = size[every, top[:, 0]] < size[every, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            axis = [2 * top[:, k] + (x[every, top[:, k]] < 0) for k in (0, 1)]
            first.append(axis[0])
            second.append(axis[1])
            gap.append(size[every, top[:, 0]] - size[every, top[:, 1]])
        base = np.full(n, t, np.int64)
        for axis in first:
            base = base * (2 * width) + axis
        out.append(base)
        order = np.argsort(np.array(gap), axis=0, kind="stable")
        scale = [(2 * width) ** (hashes - 1 - k) for k in range(hashes)]
        change = np.array([(second[k] - first[k]) * scale[k] for k in range(hashes)])
        for p in range(min(probes, hashes)):
            out.append(base + change[order[p], every])
    return np.stack(out, axis=1)


def _nodes(kind: str):
    """Rows to (vec_id, label, node, vec): equal vectors of a label are one node; null where nothing can be compared."""

    def work(batch: pa.RecordBatch) -> dict:
        node, vec = [], []
        for label, v in zip(batch["label"].to_pylist(), batch["embedding"].to_pylist(), strict=True):
            x = None
            if label is not None and v and None not in v:
                x = np.array(v, "<f8") + 0.0  # no negative zero
                x = x if np.isfinite(x).all() and x.any() else None
            raw = None if x is None else x.astype(kind).tobytes()
            node.append(None if raw is None else hashlib.blake2b(f"{label}:".encode() + raw, digest_size=16).digest())
            vec.append(raw)
        return {"vec_id": batch["vec_id"], "label": pa.array(map(str, batch["label"].to_pylist()), pa.string()), "node": pa.array(node, pa.binary()), "vec": pa.array(vec, pa.binary())}

    return lambda: work


def _cells(kind: str):
    def work(batch: pa.RecordBatch) -> dict:
        labels, raws = batch["label"].to_pylist(), batch["vec"].to_pylist()
        got: list = [None] * len(raws)
        for size in set(map(len, raws)):
            own = [i for i, r in enumerate(raws) if len(r) == size]
            x = np.frombuffer(b"".join([raws[i] for i in own]), kind).reshape(len(own), -1).astype(float)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            for i, row in zip(own, cells(x / np.linalg.norm(x, axis=1, keepdims=True)), strict=True):
                salt = int.from_bytes(hashlib.blake2b(f"{labels[i]}:{size}".encode(), digest_size=8).digest(), "little")
                mixed = (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                got[i] = np.unique(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(salt)).astype(np.int64))
        return {"nid": batch["nid"], "cells": pa.array(got, pa.list_(pa.int64()))}

    return lambda: work


def _tile(kind: str, least: float):
    def work(run: pd.DataFrame) -> pd.DataFrame | None:
        cell, a, b = (int(run[c].iloc[0]) for c in ("cell", "_a", "_b"))
        raws = run["vec"].tolist()
        x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(float)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        if a != b:
            slot = run["_s"].to_numpy()
            near &= slot[:, None] != slot[None, :]
        nid, weight, own = run["nid"].to_numpy(), run["w"].to_numpy(), run["cells"].tolist()
        i, j = np.nonzero(np.triu(near))
        if not len(i):
            return None
        most = max(map(len, own))
        table = np.full((len(own), most), np.iinfo(np.int64).max)
        for k, c in enumerate(own):
            table[k, : len(c)] = c
        counted = np.zeros(len(i), bool)
        for at in range(0, len(i), 20_000):
            p, q = table[i[at : at + 20_000]], table[j[at : at + 20_000]]
            shared = (p[:, :, None] == q[:, None, :]).any(axis=2)
            counted[at : at + 20_000] = np.where(shared, p, np.iinfo(np.int64).max).min(axis=1) == cell
        links = np.zeros(len(raws), np.int64)
        np.add.at(links, i[counted], weight[j[counted]])
        np.add.at(links, j[counted], weight[i[counted]])
        use = np.flatnonzero(links)
        out = [pd.DataFrame({"kind": 0, "a": nid[use], "b": links[use]})]
        unseen = near.any(axis=1)
        while unseen.any():
            root = int(unseen.argmax())
            group = np.zeros(len(raws), bool)
            edge = group.copy()
            group[root] = edge[root] = True
            while edge.any():
                edge = near[edge].any(axis=0) & ~group
                group |= edge
            unseen &= ~group
            rest = np.flatnonzero(group & (np.arange(len(raws)) != root))
            out.append(pd.DataFrame({"kind": 1, "a": nid[root], "b": nid[rest]}))
        return pd.concat(out)

    return work


def near_vectors(vectors: DataFrame, least: float = COSINE, slot: int = SLOT) -> DataFrame:
    """Links between vectors of one label whose cosine is at least `least`, and their components.

    Input: vec_id, embedding (array of float or double), label. Output for each row: vec_id, n_links, component_id,
    kept. Rows without label, and vectors that are null, empty, zero or hold null or non-finite parts, link with
    nothing: 0 links, their own component. Vectors of different sizes don't link. Repeated rows are vectors of their
    own and link with each other. A null vec_id is in no case kept. An empty table gives an empty result.

    Equal vectors become one node with a weight. Each node is put into the cells of TABLES tables; nodes that share a
    cell are compared exactly, in tiles, so that a hot cell is spread over tasks. A pair that meets in several cells is
    counted in the smallest of them. Pairs don't leave the tile: it gives link counts and a spanning forest.
    """
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    rows = map_batches(vectors.select("vec_id", "label", "embedding"), _nodes(kind), "vec_id long, label string, node binary, vec binary")
    light = saved(rows.select("vec_id", "node"), "vectors")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))
    nodes = saved(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    celled = saved(map_batches(nodes.select("nid", "label", "vec"), _cells(kind), "nid long, cells array<long>"), "cells")
    entries = celled.select("nid", F.explode("cells").alias("cell"))
    split = tiles(entries, ["cell"], "nid", slot, keep_slot=True)
    members = split.join(nodes.select("nid", "vec", "w"), "nid").join(celled, "nid")
    found = saved(map_runs(members, ["cell", "_a", "_b"], _tile(kind, least), "kind long, a long, b long"), "links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("nid")).agg(F.sum("b").alias("links"))
    labels = components(found.where("kind = 1"))
    named = nodes.select("nid", "node", "rep", "w").join(links, "nid", "left").join(labels.withColumnRenamed("node", "nid"), "nid", "left")
    named = saved(named.withColumn("label", F.coalesce("label", "nid")), "named")
    smallest = saved(named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m")), "smallest")
    done = join_counted(named, smallest, ["label"], "m")
    done = saved(done.select("node", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", "w"), "done")
    none = F.lit(None).cast("long")
    out = join_counted(light.where("node IS NOT NULL"), done, ["node"], "w").unionByName(light.where("node IS NULL").select("node", "vec_id", none.alias("n_links"), none.alias("component_id")))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: All pairs of a label, and all that is reachable by links.
SQL = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, cast(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}::DOUBLE
), c AS (
  SELECT r AS a, r AS b FROM v UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a
), m AS (
  SELECT c.a AS r, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.b GROUP BY c.a
), n AS (
  SELECT a AS r, count(*) AS n FROM p GROUP BY a
)
SELECT vec_id, cast(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN m USING (r) LEFT JOIN n USING (r)
"""
