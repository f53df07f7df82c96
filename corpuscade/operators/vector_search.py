"""Exact nearest vectors of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import located, work_path
from .ranking import top_k_per_group


def _matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``lists`` that are finite vectors of length ``dim`` other than zero, scaled to length 1, and their numbers."""
    good, rows = [], []
    for k, v in enumerate(lists.to_pylist()):
        if v is not None and len(v) == dim and None not in v:
            x = np.asarray(v, np.float64)
            size = np.sqrt(x @ x)
            if np.isfinite(size) and size > 0:
                good.append(k)
                rows.append(x / size)
    return np.array(good, np.int64), np.array(rows).reshape(-1, dim)


def exact_top_k(queries: DataFrame, base: DataFrame, k: int, id_col: str, vec_col: str, dim: int, tenant_col: str | None = None, block: int = 2048, others_only: bool = True, held: int = 1 << 16) -> DataFrame:
    """``query_id, id, cosine, place``: of each query the k rows of ``base`` with the largest cosine.

    The queries are written to the shared folder.  A task holds its share of the base (in parts
    of ``held`` rows), reads the queries in blocks of ``block``, multiplies and keeps k a query:
    one scan and one plan, however many queries there are, and at most k rows a part and query
    are shuffled.  With ``tenant_col`` a query only meets rows of its own tenant.  Rows without a
    usable vector are neither queries nor results; ties go to the smaller id; ``others_only``
    leaves out the query's own id; repeated rows of an id count once.  An empty side gives an
    empty result.
    """
    columns = [id_col, vec_col, *([tenant_col] if tenant_col else [])]
    kind = base.schema[id_col].dataType.simpleString()
    path = work_path(base.sparkSession, "asked")
    queries.select(*columns).distinct().write.option("compression", "snappy").parquet(path)

    def against(ids: list, x: np.ndarray, tenants: list) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        system, where = located(path)
        order = sorted(range(len(ids)), key=lambda i: ids[i])  # so that ties are in the order of the ids
        ids, x, tenants = [ids[i] for i in order], x[order], [tenants[i] for i in order]
        places: dict = {}
        for n, name in enumerate(ids):
            places.setdefault(name, []).append(n)
        most = k + len(ids) - len(places)
        for some in ds.dataset(where, format="parquet", filesystem=system).to_batches(batch_size=block):
            at, q = _matrix(some.column(1), dim)
            if not len(at):
                continue
            names = [some.column(0)[int(n)].as_py() for n in at]
            asked = [some.column(2)[int(n)].as_py() for n in at] if tenant_col else []
            line, near, found = [], [], []
            for low in range(0, len(ids), block):
                cos = np.round(q @ x[low : low + block].T, 12)
                if others_only:
                    for n, name in enumerate(names):
                        for p in places.get(name, ()):
                            if low <= p < low + block:
                                cos[n, p - low] = -np.inf
                if tenant_col:
                    codes = {t: c for c, t in enumerate(dict.fromkeys([*asked, *tenants]))}
                    mine, theirs = np.array([codes[t] for t in asked]), np.array([codes[t] for t in tenants[low : low + block]])
                    cos[mine[:, None] != theirs[None, :]] = -np.inf
                least = np.partition(cos, cos.shape[1] - most, axis=1)[:, cos.shape[1] - most] if cos.shape[1] > most else np.full(len(names), -np.inf)
                row, col = np.nonzero((cos >= least[:, None]) & (cos > -np.inf))
                line.append(row)
                near.append(cos[row, col])
                found.append(col + low)
            line, near, found = (np.concatenate(v) for v in (line, near, found))
            order = np.lexsort((found, -near, line))
            line, near, found = line[order], near[order], found[order]
            first = np.arange(len(line)) - np.searchsorted(line, line) < most
            yield pa.RecordBatch.from_arrays([pa.array([names[n] for n in line[first]], _arrow(kind)), pa.array([ids[n] for n in found[first]], _arrow(kind)), pa.array(near[first])], ["query_id", "id", "cosine"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, tenants = [], [], []
        for batch in batches:
            at, x = _matrix(batch.column(1), dim)
            ids += batch.column(0).take(pa.array(at)).to_pylist()
            tenants += batch.column(2).take(pa.array(at)).to_pylist() if tenant_col else [None] * len(at)
            parts.append(x)
            if len(ids) >= held:
                yield from against(ids, np.concatenate(parts), tenants)
                ids, parts, tenants = [], [], []
        if ids:
            yield from against(ids, np.concatenate(parts), tenants)

    met = base.select(*columns).mapInArrow(rows, f"query_id {kind}, id {kind}, cosine double")
    found = top_k_per_group(met.groupBy("query_id", "id").agg(F.max("cosine").alias("cosine")), ["query_id"], [F.desc("cosine"), F.asc("id")], k)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc("id"))))


def _arrow(kind: str) -> pa.DataType:
    return pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
