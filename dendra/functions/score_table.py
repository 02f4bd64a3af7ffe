"""The score of a matched point pair by distance (nanometres) and by |dot| of the directions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lower ends of the distance bins in nanometres (closed on the left); the first bin starts at 0.
DISTANCES = [0.0, 750.0, 1500.0, 2000.0, 2500.0, 3000.0, 3500.0, 4000.0, 5000.0, 6000.0, 7000.0, 8000.0, 9000.0, 10000.0, 12000.0, 14000.0, 16000.0, 20000.0, 25000.0, 30000.0, 40000.0]

# A row per distance bin, a column per tenth of |dot|.
DEFAULT = """
9.500096818,9.215083357,9.211150653,8.7784602,9.164807909,9.226703049,9.981771246,9.987695406,10.80477034,11.38922975
8.447755355,9.046068319,8.667958982,8.620980802,8.776274813,8.991696789,9.617999412,9.493972245,9.903896429,10.55586004
7.814143229,8.275576335,8.186606829,8.237314279,8.155985165,8.449820935,9.003032526,8.779511491,9.077598206,9.727351671
7.516167196,7.681555246,7.825236429,7.79365903,7.886876327,8.031765025,7.904194473,7.891676679,8.462178601,9.356472385
6.978314733,6.94307802,7.079217658,7.049650785,7.213062838,6.938749021,7.636968226,7.400216229,8.243724006,8.805585249
6.337198777,6.510450375,6.357374227,6.730667645,6.641335772,6.684942997,6.845211004,6.965403404,7.584209784,8.309956403
5.734997422,5.776563856,5.874881169,6.078469213,6.024177456,5.936484828,6.165189213,6.300636628,6.959851818,7.873737324
5.115815483,5.021649496,5.156574953,5.104265236,5.140931058,5.108690757,5.313504178,5.32953037,5.908950758,6.513172334
4.233994961,4.157947722,4.207281576,4.154590177,4.126860665,4.073368024,4.139708907,4.300275653,4.578050608,5.16486935
3.340269069,3.305132487,3.295987474,3.26045244,3.292369387,3.178867136,3.359775859,3.354096549,3.576372369,3.975850334
2.495160396,2.52098425,2.52305844,2.469504149,2.482755854,2.495893622,2.532479647,2.478894493,2.57140863,3.033875753
1.802393086,1.781094655,1.70675762,1.775359089,1.752898559,1.751466981,1.790826809,1.714786956,1.765916151,2.111905427
1.232040898,1.249021758,1.150560463,1.153606462,1.105376439,1.090955764,1.112113408,1.073979959,1.213295343,1.362314481
0.401029978,0.405860319,0.364813354,0.445292762,0.340571514,0.3381995,0.280082921,0.257239082,0.309758723,0.460951328
-0.232687427,-0.28491254,-0.336660961,-0.341205197,-0.403612584,-0.44962312,-0.41046464,-0.49492806,-0.486278922,-0.343856434
-0.720642343,-0.737187894,-0.791598721,-0.913295681,-0.86587451,-0.92991461,-0.938060799,-0.94957494,-0.949001462,-0.892505829
-1.207753675,-1.224291438,-1.232821022,-1.3177789,-1.33458514,-1.381696401,-1.399438894,-1.355855899,-1.366778332,-1.314132536
-1.645904535,-1.672684781,-1.698075889,-1.756182812,-1.79136287,-1.878540375,-1.874187273,-1.919542562,-1.939410932,-1.937971322
-2.517777195,-2.545349187,-2.539723488,-2.5457632,-2.606812735,-2.685946309,-2.663268872,-2.701847019,-2.781737863,-2.912276452
-3.960090407,-4.031387597,-4.072118021,-4.147351353,-4.330029905,-4.420053362,-4.507915144,-4.794051466,-4.833212928,-5.085672535
-9.921038172,-10.08763,-10.05543472,-10.10268204,-10.08682408,-9.912201864,-10.07995763,-9.951978816,-10.05360783,-10.12875887
"""


def parse(text: str) -> list[list[float]]:
    return [[float(v) for v in line.split(",")] for line in text.split()]


def _checked(table: Sequence[Sequence[float]]) -> list[list[float]]:
    rows = [[float(v) for v in r] for r in table]
    if len(rows) != len(DISTANCES) or any(len(r) != 10 for r in rows):
        raise ValueError(f"a score table has {len(DISTANCES)} rows of 10 scores")
    return rows


class ScoreTable:
    """Bins and scores; ``frame`` is the table in long form, ``score`` a column expression."""

    def __init__(self, table: Sequence[Sequence[float]] | None = None):
        self.rows = _checked(parse(DEFAULT) if table is None else table)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ScoreTable:
        """From a CSV file without a header."""
        lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
        return cls(parse("\n".join(lines)))

    @property
    def self_score(self) -> float:
        return self.rows[0][9]

    def frame(self, spark: SparkSession) -> DataFrame:
        ends = [*DISTANCES[1:], float("inf")]
        rows = [(i, j, DISTANCES[i], ends[i], s) for i, r in enumerate(self.rows) for j, s in enumerate(r)]
        return spark.createDataFrame(rows, "dist_bin int, adp_bin int, dist_lo double, dist_hi double, score double")

    def score(self, distance: Column, adp: Column) -> Column:
        """The score in the bins of ``distance`` and ``adp``: an array lookup inside generated code, no join."""
        flat = F.array(*[F.lit(v) for r in self.rows for v in r])
        return F.element_at(flat, (dist_bin(distance) * 10 + adp_bin(adp) + 1).cast("int"))

    def scores(self, distance: np.ndarray, adp: np.ndarray) -> np.ndarray:
        """The same for arrays."""
        i = np.clip(np.searchsorted(DISTANCES, distance, side="right") - 1, 0, None)
        return np.array(self.rows)[i, np.clip((adp * 10 - 1e-4).astype(int), 0, 9)]

    def __getitem__(self, key: tuple[float, float]) -> float:
        d, a = key
        i = max((n for n, lo in enumerate(DISTANCES) if d >= lo), default=0)
        return self.rows[i][min(max(int(a * 10 - 1e-4), 0), 9)]


def dist_bin(distance: Column) -> Column:
    """0 to 20; a chain of comparisons from the far end, so most pairs are settled by code, not by a join."""
    out = None
    for i in range(len(DISTANCES) - 1, 0, -1):
        out = F.when(distance >= DISTANCES[i], i) if out is None else out.when(distance >= DISTANCES[i], i)
    return out.otherwise(0)


def adp_bin(adp: Column) -> Column:
    """0 to 9: ten times |dot| less a ten-thousandth, cut towards zero; 0.1 is in bin 0 and 1.0 in bin 9."""
    return F.greatest(F.lit(0), F.least(F.lit(9), (adp * 10 - 1e-4).cast("int")))
