"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import materialize


LINKS = 100_000  # joined up at a time; a task of a later round takes as many


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) for every node of up to LINKS links (a, b) at a time; root is the
    smallest node that these links lead to."""
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, LINKS):
            part = batch.slice(at, LINKS)
            if rows + part.num_rows > LINKS:
                yield _roots(held)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield _roots(held)


def _roots(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    ends = [np.concatenate([b.column(x).to_numpy() for b in batches]) for x in "ab"]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = at[: len(ends[0])], at[len(ends[0]):]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the
    smallest node that can be reached.

    A round joins the links of each task up, hangs every node on the smallest of its
    roots there and leaves links between the roots of one node, until there are none or
    so few that one task's round is the last. More are sorted for the next round:
    neighbours meet in a task, so the tables shrink fast. The steps are joined up at
    the end.
    """
    edges, steps, few = links.select("a", "b"), [], False
    while True:
        met = edges.mapInArrow(joined, "node long, root long")
        if few:
            steps.append(materialize(met, "hooks"))
            break
        step = materialize(met.groupBy("node").agg(F.min("root").alias("root")), "hooks")
        steps.append(step)
        top = step.select("node", F.col("root").alias("top"))
        edges = materialize(met.join(top, "node").filter("root != top")
                            .select(F.least("root", "top").alias("a"), F.greatest("root", "top").alias("b")).distinct(), "links")
        left = edges.count()
        if not left:
            break
        few = left <= LINKS
        edges = edges.coalesce(1) if few else materialize(edges.sort("a", "b"), "links").coalesce(-(-left // LINKS))
    out = steps[0].select("node", F.col("root").alias("component"))
    for step in steps[1:]:
        up = step.select(F.col("node").alias("via"), "root")
        out = out.join(up, out.component == up.via, "left").select("node", F.coalesce("root", "component").alias("component"))
    return out
