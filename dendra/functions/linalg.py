"""Principal directions as column expressions: the first eigenvector of a symmetric 3 x 3 matrix in closed form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOMENTS = ["n", "sx", "sy", "sz", "sxx", "syy", "szz", "sxy", "sxz", "syz"]


def moments(x: Column, y: Column, z: Column) -> list[Column]:
    """Aggregates that ``first_component`` needs. Give coordinates relative to a point nearby, so that squares stay exact."""
    own = {"sx": x, "sy": y, "sz": z, "sxx": x * x, "syy": y * y, "szz": z * z, "sxy": x * y, "sxz": x * z, "syz": y * z}
    return [F.count(x).alias("n"), *[F.sum(v).alias(k) for k, v in own.items()]]


def first_component(df: DataFrame, names: tuple[str, str, str] = ("vx", "vy", "vz")) -> DataFrame:
    """``df`` (with MOMENTS) with the unit direction of largest variance; the moments go.

    The largest eigenvalue comes from the trigonometric formula, its vector from the longest cross product of two rows
    of A - lambda I. The component of largest size is positive (the first on ties). Without a single direction
    (fewer than two points, equal points, an isotropic neighbourhood) all three are NULL.
    """
    c = F.col
    n = c("n")
    cov = lambda ab, a, b: (c(ab) - c(a) * c(b) / n) / (n - 1)
    a = {"sxx": ("sx", "sx"), "syy": ("sy", "sy"), "szz": ("sz", "sz"), "sxy": ("sx", "sy"), "sxz": ("sx", "sz"), "syz": ("sy", "sz")}
    out = df.withColumns({f"__{k}": F.when(n > 1, cov(k, *v)) for k, v in a.items()}).drop(*MOMENTS)
    xx, yy, zz, xy, xz, yz = (c(f"__{k}") for k in ("sxx", "syy", "szz", "sxy", "sxz", "syz"))
    out = out.withColumn("__q", (xx + yy + zz) / 3)
    q = c("__q")
    out = out.withColumn("__p", F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6))
    p = c("__p")
    bxx, byy, bzz, bxy, bxz, byz = ((xx - q) / p, (yy - q) / p, (zz - q) / p, xy / p, xz / p, yz / p)
    det = bxx * (byy * bzz - byz * byz) - bxy * (bxy * bzz - byz * bxz) + bxz * (bxy * byz - byy * bxz)
    out = out.withColumn("__r", F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))))
    out = out.withColumn("__l", q + 2 * p * F.cos(F.acos("__r") / 3))
    lam = c("__l")
    dx, dy, dz = xx - lam, yy - lam, zz - lam
    crosses = {
        "1": (xy * yz - xz * dy, xz * xy - dx * yz, dx * dy - xy * xy),  # rows 1 and 2
        "2": (xy * dz - xz * yz, xz * xz - dx * dz, dx * yz - xy * xz),  # rows 1 and 3
        "3": (dy * dz - yz * yz, yz * xz - xy * dz, xy * yz - dy * xz),  # rows 2 and 3
    }
    out = out.withColumns({f"__c{k}{i}": v for k, cross in crosses.items() for i, v in enumerate(cross)})
    out = out.withColumns({f"__n{k}": c(f"__c{k}0") * c(f"__c{k}0") + c(f"__c{k}1") * c(f"__c{k}1") + c(f"__c{k}2") * c(f"__c{k}2") for k in crosses})
    top = F.greatest("__n1", "__n2", "__n3")
    best = lambda i: F.when(c("__n1") == top, c(f"__c1{i}")).when(c("__n2") == top, c(f"__c2{i}")).otherwise(c(f"__c3{i}"))
    # relative to the matrix' own size: what is left after rounding is no direction
    tiny = 1e-24 * q * q * q * q
    out = out.withColumns({"__len": F.when(top > tiny, F.sqrt(top)), **{f"__v{i}": best(i) for i in range(3)}})
    vx, vy, vz = (c(f"__v{i}") for i in range(3))
    size = F.greatest(F.abs(vx), F.abs(vy), F.abs(vz))
    lead = F.when(F.abs(vx) == size, vx).when(F.abs(vy) == size, vy).otherwise(vz)
    out = out.withColumn("__s", F.when(lead < 0, -1.0).otherwise(1.0) / c("__len"))
    out = out.withColumns({name: c(f"__v{i}") * c("__s") for i, name in enumerate(names)})
    return out.drop(*[x for x in out.columns if x.startswith("__")])


def directions(x: np.ndarray) -> np.ndarray:
    """``first_component`` of many small sets of points at once: x is sets by points by 3, relative to a point nearby; a line of NaN where there is none."""
    n = x.shape[1]
    if n < 2:
        return np.full((len(x), 3), np.nan)
    sums = x.sum(axis=1)
    a = (np.einsum("spi,spj->sij", x, x) - sums[:, :, None] * sums[:, None, :] / n) / (n - 1)
    q = np.trace(a, axis1=1, axis2=2) / 3
    b = a - q[:, None, None] * np.eye(3)
    p = np.sqrt((b * b).sum(axis=(1, 2)) / 6)
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.linalg.det(b / p[:, None, None]) / 2
        top = q + 2 * p * np.cos(np.arccos(np.clip(half, -1, 1)) / 3)
        rows = a - top[:, None, None] * np.eye(3)
        crosses = np.stack([np.cross(rows[:, i], rows[:, j]) for i, j in ((0, 1), (0, 2), (1, 2))], axis=1)
        sizes = (crosses * crosses).sum(axis=2)
        best = sizes.argmax(axis=1)
        v, size = crosses[np.arange(len(x)), best], sizes[np.arange(len(x)), best]
        lead = v[np.arange(len(x)), np.abs(v).argmax(axis=1)]
        out = v * (np.where(lead < 0, -1.0, 1.0) / np.sqrt(size))[:, None]
    out[~((p > 0) & (size > 1e-24 * q**4))] = np.nan
    return out


def pca_first_component(df: DataFrame, group: list[str], axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """First principal component of each group of 3-D points: group columns and vx, vy, vz.

    Two aggregations: the means first, so that moments are taken about them.
    """
    means = df.groupBy(*group).agg(*[F.avg(c).alias(f"m_{c}") for c in axes])
    near = df.join(means, group)
    return first_component(near.groupBy(*group).agg(*moments(*[F.col(c) - F.col(f"m_{c}") for c in axes])))


def pca_first_component_any(df: DataFrame, group: list[str], features: list[str]) -> DataFrame:
    """The same for any number of columns: group columns and ``component`` (array). A group's moments are d x d numbers."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    sums = df.groupBy(*group).agg(*[F.covar_samp(features[i], features[j]).alias(f"c_{i}_{j}") for i, j in pairs])

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf[[f"c_{i}_{j}" for i, j in pairs]].to_numpy(float):
                m = np.zeros((len(features),) * 2)
                for (i, j), v in zip(pairs, row):
                    m[i, j] = m[j, i] = v
                if not np.isfinite(m).all() or not m.any():
                    out.append(None)
                    continue
                v = np.linalg.eigh(m)[1][:, -1]
                out.append((v if v[np.abs(v).argmax()] > 0 else -v).tolist())
            yield pdf[group].assign(component=pd.Series(out, index=pdf.index, dtype=object))

    kinds = dict(df.dtypes)
    return sums.mapInPandas(run, ", ".join([f"{g} {kinds[g]}" for g in group] + ["component array<double>"]))
