"""Label and affinity volumes as voxel frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from dendra.schemas import VOXELS, ensure_schema


def _slab(labels: np.ndarray, affinities: np.ndarray, z0: int) -> pd.DataFrame:
    z, y, x = (v.ravel() for v in np.indices(labels.shape))
    aff = {f"aff_{a}": affinities[i].ravel().astype(float) for i, a in enumerate("xyz")}
    return pd.DataFrame({"z": (z + z0).astype("i4"), "y": y.astype("i4"), "x": x.astype("i4"), "label": labels.ravel().astype("i8"), **aff})


def _checked(labels_shape: tuple, affinities_shape: tuple) -> None:
    if len(labels_shape) != 3 or affinities_shape != (3, *labels_shape):
        raise ValueError(f"labels (z, y, x) and affinities (3, z, y, x) don't fit: {labels_shape}, {affinities_shape}")


def voxels_from_arrays(spark: SparkSession, labels: np.ndarray, affinities: np.ndarray) -> DataFrame:
    """From a 3-D label array and a 4-D affinity array whose channels are x, y, z."""
    _checked(labels.shape, affinities.shape)
    return ensure_schema(spark.createDataFrame(_slab(labels, affinities, 0)), VOXELS)


def read_hdf5(spark: SparkSession, labels_path: str, affinities_path: str, dataset: str = "main", depth: int = 16) -> DataFrame:
    """From two HDF5 files on a file system that all executors mount; ``depth`` planes per task. Needs h5py."""
    import h5py

    with h5py.File(labels_path) as a, h5py.File(affinities_path) as b:
        _checked(a[dataset].shape, b[dataset].shape)
        planes = a[dataset].shape[0]

    def run(batches):
        import h5py

        for pdf in batches:
            for z in pdf["id"]:
                with h5py.File(labels_path) as a, h5py.File(affinities_path) as b:
                    yield _slab(a[dataset][z : z + depth], b[dataset][:, z : z + depth], int(z))

    return spark.range(0, planes, depth, -(-planes // depth)).mapInPandas(run, VOXELS)


def labels_to_array(voxels: DataFrame) -> np.ndarray:
    """The label volume on the driver: for volumes that fit it. Voxels that are missing are 0."""
    pdf = voxels.select("z", "y", "x", "label").toPandas()
    out = np.zeros(tuple(pdf[c].max() + 1 for c in "zyx"), np.uint32)
    out[pdf["z"], pdf["y"], pdf["x"]] = pdf["label"]
    return out
