"""Operator 13: whitening of embeddings, components by QDWH spectral divide-and-conquer.

Vectors are put on a grid of whole numbers: an entry c becomes floor(64 * c) + 1000000. The fit list is each distinct
vector once. Its size n and the sums S by dimension are exact; the covariance sums products of (n * x - S) / n.

The covariance (dimensions by dimensions, whatever the number of rows) is split on the driver: the polar factor of the
covariance less a shift, found by the QR- and Cholesky-based iteration with dynamic weights, has the eigenvalues 1 and
-1, so half of it plus the identity projects onto the subspace of the eigenvalues above the shift. An orthonormal
basis of it and of its complement makes two smaller problems, and so on down to single components. Subspaces below the
components that are wanted are not split further. The components and scales are then broadcast (16 by dimensions).

Plan: distinct vectors by a hash aggregation (copies are combined before the shuffle), one pass for n and S, one for
the covariance and one for that of the whitened vectors (one small matrix a task, summed by Spark), one map for the
result.

Defined results: a row whose vector is null, or has a null, non-finite or out-of-range entry (its grid number is not a
long), is left out, as is one whose number of entries is not the most frequent (of equally frequent, the larger; an
empty vector never counts). Repeated rows and equal vectors each keep their rows and have equal results. Components
without variance have no whitened value and no rows, so fewer vectors than components give fewer components, a single
distinct vector and an empty table give no rows. deviation is null where it exceeds a long. A null id is an id like
any other; other columns do not take part.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm import common

common.ship(__name__)

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Grid numbers beyond it are out of range: their differences would leave a long.
MOST = 2.0**62


def qdwh(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by the dynamically weighted Halley iteration."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low, eps = 1e-16, np.finfo(float).eps
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        h = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        wa, wb = h, (h - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            lower = np.linalg.cholesky(np.eye(n) + wc * x.T @ x)
            solved = np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
            new = wb / wc * x + (wa - wb / wc) * solved
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved, x = np.linalg.norm(new - x), new
        if abs(1 - low) < 10 * eps and moved < eps ** (1 / 3):
            break
    return x


def split(a: np.ndarray):
    """Bases of the invariant subspaces of a symmetric matrix above and below a shift, or None if it is a multiple of the identity."""
    n, d = len(a), np.diag(a)
    middle = d.mean()
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * np.finfo(float).eps * max(abs(middle), spread):
        return None
    # the mean of the diagonal lies between the eigenvalues; another shift where it meets one of them
    for part in (0.0, 0.13, -0.13, 0.29, -0.29, 0.47, -0.47, 0.61, -0.61):
        shifted = a - (middle + part * spread) * np.eye(n)
        sign = qdwh(shifted)
        above = (sign + np.eye(n)) / 2
        k = int(round(np.trace(above)))
        if not 0 < k < n or np.linalg.norm(sign @ sign - np.eye(n)) > 1e-9 * n:
            continue
        chosen = above[:, np.argsort(-np.linalg.norm(above, axis=0))]
        basis, _ = np.linalg.qr(chosen @ np.random.default_rng(n).standard_normal((n, k)), mode="complete")
        for _ in range(3):  # subspace iteration; one step is enough but for bad starts
            basis, _ = np.linalg.qr(above @ basis[:, :k], mode="complete")
            if np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]) <= 1e-14 * n * np.linalg.norm(a):
                break
        return basis[:, :k], basis[:, k:]
    return None


def components(covariance: np.ndarray, most: int = COMPONENTS):
    """Eigenvalues, falling, and unit eigenvectors (columns) of the ``most`` largest, those without variance left out."""
    values, vectors = [], []
    stack = [np.eye(len(covariance))]
    while stack and len(values) < most:
        basis = stack.pop()
        small = basis.T @ covariance @ basis
        small = (small + small.T) / 2
        parts = split(small) if len(small) > 1 else None
        if parts is None:
            for i in range(len(small)):  # a single component, or several of one eigenvalue
                v = basis[:, i] / np.linalg.norm(basis[:, i])
                values.append(float(v @ covariance @ v))
                vectors.append(v)
        else:
            stack += [basis @ parts[1], basis @ parts[0]]  # the upper part first
    order = np.argsort(-np.array(values), kind="stable")[:most]
    noise = len(covariance) * np.finfo(float).eps * max([0.0, *values])
    order = [i for i in order if values[i] > noise]
    return np.array([values[i] for i in order]), np.array([vectors[i] for i in order]).reshape(len(order), len(covariance)).T


def grid(rows: DataFrame, vector_col: str) -> DataFrame:
    """``rows`` with x, the vector on the grid; rows without a whole vector of the most frequent length are left out."""
    entry = lambda c: F.floor(c.cast("double") * SCALE) + OFFSET
    fine = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * SCALE < MOST))
    rows = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("x", F.transform(vector_col, entry)).withColumn("__size", F.size("x"))
    common_size = rows.groupBy("__size").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), F.desc("__size")).first()
    return rows.where(F.col("__size") == (common_size["__size"] if common_size else 0)).drop("__size")


def matrices(batches, make, size):
    """Sums over a task's batches of ``make(numbers)``, a matrix; one row for each of its rows."""
    import pyarrow as pa

    total = None
    for batch in batches:
        x = batch.column(0)
        numbers = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), size)
        total = make(numbers) if total is None else total + make(numbers)
    if total is not None:
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})


def summed(fit: DataFrame, make, size: int) -> np.ndarray:
    """The sum of ``make`` over all rows: a matrix of fixed size a task, added up by row and column in Spark."""
    parts = fit.select("x").mapInArrow(lambda batches: matrices(batches, make, size), "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n = 1 + max(c["i"] for c in cells)
    out = np.zeros((n, n))
    for c in cells:
        out[c["i"], c["j"]] = c["v"]
    return out


class Whitening:
    """What a fit gives: n, sums, covariance, values and vectors of the components, shares of the trace, identity_error."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.covariance, self.values, self.vectors = n, sums, covariance, values, vectors
        self.explained = values / np.trace(covariance) if len(values) else values
        self.identity_error = 0.0

    def centred(self):
        """A function from grid numbers to (n * x - S) / n in double, free of the driver's objects."""
        n, sums = self.n, np.array(self.sums, object)
        # the mean's whole part is taken off before the division, so that no digit is lost to the offset
        whole = np.array([s // n for s in sums], np.int64)
        rest = np.array([float(s - n * w) / n for s, w in zip(sums, whole.tolist(), strict=True)])
        return lambda x: (x - whole).astype(np.float64) - rest


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``vectors`` (a column x of grid numbers): each distinct vector counts once. None without variance."""
    distinct = common.written(vectors.select("x").distinct(), "fit")
    sums = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = sorted(sums.collect(), key=lambda r: r["i"])  # one row a dimension
    if not sums:
        return None
    found = Whitening(sums[0]["n"], [int(r["s"]) for r in sums], np.zeros((1, 1)), np.zeros(0), np.zeros((0, 0)))
    centred, size = found.centred(), len(sums)

    def products(x):
        y = centred(x)
        return y.T @ y

    covariance = summed(distinct, products, size) / found.n
    values, basis = components((covariance + covariance.T) / 2, most)
    found = Whitening(found.n, found.sums, covariance, values, basis)
    if not len(values):
        return None
    scaled = basis / np.sqrt(values)

    def whitened_products(x):
        y = centred(x) @ scaled
        return y.T @ y

    found.identity_error = float(np.abs(summed(distinct, whitened_products, size) / found.n - np.eye(len(values))).max())
    return found


def transform(found: Whitening) -> Column:
    """struct(deviation, whitened) of the column x."""
    import pyarrow as pa

    spark = SparkSession.active()
    centred, n, sums = found.centred(), found.n, found.sums
    scaled = spark.sparkContext.broadcast(found.vectors / np.sqrt(found.values))

    @F.arrow_udf("struct<deviation: long, whitened: array<double>>")
    def apply(x: pa.Array) -> pa.Array:
        numbers = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(sums))
        rough = ((centred(numbers) * n) ** 2).sum(1)
        largest = max(float(rough.max(initial=0)), n * float(np.abs(numbers).max(initial=0)))
        if largest < 2.0**62:  # whole numbers of 64 bits
            deviation = ((numbers * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
        else:  # exact numbers of any size; null where a long can't hold the sum
            exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in numbers.tolist()]
            deviation = [v if v < 2**63 else None for v in exact]
        whitened = centred(numbers) @ scaled.value
        return pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), pa.array(list(whitened), pa.list_(pa.float64()))], ["deviation", "whitened"])

    return apply(F.col("x"))


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row for each row of ``rows`` that has a whole vector, and component; columns as in the contract of the query."""
    points = common.written(grid(rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("__vector")), "__vector").select("vec_id", "x"), "grid")
    found = fit(points, most)
    kind = points.schema["vec_id"].dataType
    if found is None:
        schema = T.StructType([T.StructField(f.name, kind if f.name == "vec_id" else f.dataType) for f in T._parse_datatype_string(RESULT)])
        return rows.sparkSession.createDataFrame([], schema)
    out = points.select("vec_id", transform(found).alias("r"))
    explained = F.array(*[F.lit(float(x)) for x in found.explained])
    out = out.select("vec_id", F.col("r.deviation").alias("deviation"), F.posexplode("r.whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(found.identity_error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened values of every row of ``embeddings``; what is left out and results of ties are those of the module."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
