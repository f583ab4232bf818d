"""The engine's inputs built from a folder of Parquet tables.

pop(h, t, state, p): the share of each state at each point of a shared grid, by history.
weights(frame, band, grp, ord, w, captured, total): normalised projections on groups of ions.
rows_frames(h, t, frame): the frame that each history visits at each row (cyclic).
energies(frame, state, e), nac(frame, i, j, v): energies and antisymmetric couplings.
traj(frame, atom, x, y, z): fractional positions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ["click", "error", "purchase", "signup", "view"]
POINTS = 30
HISTORIES = 4
PERIOD = 20
GROUPS = [("ga", 1, 21), ("gb", 22, 42), ("gc", 43, 64)]


class Views:
    """Lazily built inputs; each is one declarative plan over the Parquet scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _shares(self, key) -> DataFrame:
        events = self.table("events").select(
            key.alias("h"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("t"), F.col("event_type").alias("state")
        )
        counted = events.groupBy("h", "t", "state").agg(F.count(F.lit(1)).alias("n"))
        totals = counted.groupBy("h", "t").agg(F.sum("n").alias("all"))
        grid = totals.crossJoin(self.spark.createDataFrame([(s, k) for k, s in enumerate(STATES)], "state string, band int"))
        return grid.join(counted, ["h", "t", "state"], "left").select(
            F.col("h").cast("int").alias("h"),
            F.col("t").cast("int").alias("t"),
            "state",
            "band",
            (F.coalesce("n", F.lit(0)).cast("double") / F.col("all")).alias("p"),
        )

    @cached_property
    def pop(self) -> DataFrame:
        return self._shares(F.col("user_id") % HISTORIES)

    @cached_property
    def runs(self) -> DataFrame:
        """pop of three configurations: run A, B, C by user; h within the run."""
        return self._shares((F.col("user_id") % 12)).withColumn(
            "run", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("h") % 3 + 1)
        ).withColumn("h", F.floor(F.col("h") / 3).cast("int"))

    @cached_property
    def ions(self) -> DataFrame:
        return self.table("embeddings").select(
            F.expr("cast(floor(vec_id / 5) as int) + 1").alias("frame"),
            F.expr("cast(vec_id % 5 as int)").alias("band"),
            F.posexplode("embedding").alias("pos", "x"),
        ).select("frame", "band", (F.col("pos") + 1).alias("ion"), F.abs(F.col("x").cast("double")).alias("tot"))

    @cached_property
    def ion_groups(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(i, g, k) for k, (g, a, b) in enumerate(GROUPS) for i in range(a, b + 1)], "ion int, grp string, ord int"
        )

    @cached_property
    def weights(self) -> DataFrame:
        from .operators.character import fragment_weights

        return fragment_weights(self.ions, self.ion_groups)

    @cached_property
    def rows_frames(self) -> DataFrame:
        return self.pop.select("h", "t").distinct().withColumn("start", 1 + 7 * F.col("h")).selectExpr(
            "h", "t", f"cast(if((t + start) % {PERIOD} = 0, {PERIOD}, (t + start) % {PERIOD}) as int) as frame"
        )

    @cached_property
    def energies(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "cast(floor(vec_id / 5) as int) + 1 as frame", "cast(vec_id % 5 as int) as state",
            "0.5D * (vec_id % 5) + cast(embedding[0] as double) as e",
        )

    @cached_property
    def nac(self) -> DataFrame:
        v = self.table("embeddings").selectExpr(
            "cast(floor(vec_id / 5) as int) + 1 as frame", "cast(vec_id % 5 as int) as s",
            "cast(embedding[0] as double) as a", "cast(embedding[1] as double) as b",
        )
        left = v.selectExpr("frame", "s as i", "a as ai", "b as bi")
        right = v.selectExpr("frame", "s as j", "a as aj", "b as bj")
        return left.join(right, "frame").selectExpr("frame", "i", "j", "ai * bj - bi * aj as v")

    @cached_property
    def traj(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "cast(vec_id as int) + 1 as frame", "posexplode(slice(embedding, 1, 63)) as (pos, x)"
        ).selectExpr("frame", "cast(floor(pos / 3) as int) as atom", "pos % 3 as axis", "cast(x as double) as x").groupBy("frame", "atom").pivot(
            "axis", [0, 1, 2]
        ).agg(F.first("x")).selectExpr("frame", "atom", "`0` as x", "`1` as y", "`2` as z")

    @cached_property
    def events_table(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def windows(self) -> DataFrame:
        return self.spark.createDataFrame([("early", 0, 2, 9), ("late", 1, 15, 29), ("all", 2, 0, 29)], "name string, ord int, lo int, hi int")


#: The same inputs as common table expressions of an independent SQL engine.
DUCK = {
    "events_table": " events_table AS (SELECT * FROM events)",
    "pop": """
 pop_n AS (SELECT user_id % 4 AS h, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, event_type AS state, count(*) AS n
           FROM events GROUP BY 1, 2, 3),
 pop_a AS (SELECT h, t, sum(n) AS total FROM pop_n GROUP BY 1, 2),
 pop AS (SELECT CAST(a.h AS INT) AS h, CAST(a.t AS INT) AS t, s.state, s.band, CAST(coalesce(n.n, 0) AS DOUBLE) / CAST(a.total AS DOUBLE) AS p
         FROM pop_a a CROSS JOIN (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)) s(state, band)
         LEFT JOIN pop_n n ON n.h = a.h AND n.t = a.t AND n.state = s.state)""",
    "runs": """
 runs_n AS (SELECT user_id % 12 AS u, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, event_type AS state, count(*) AS n
           FROM events GROUP BY 1, 2, 3),
 runs_a AS (SELECT u, t, sum(n) AS total FROM runs_n GROUP BY 1, 2),
 runs AS (SELECT CAST(floor(a.u / 3) AS INT) AS h, CAST(a.t AS INT) AS t, s.state, s.band,
                 CAST(coalesce(n.n, 0) AS DOUBLE) / CAST(a.total AS DOUBLE) AS p, substr('ABC', CAST(a.u % 3 AS INT) + 1, 1) AS run
         FROM runs_a a CROSS JOIN (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)) s(state, band)
         LEFT JOIN runs_n n ON n.u = a.u AND n.t = a.t AND n.state = s.state)""",
    "ions": """
 ions AS (SELECT CAST(vec_id // 5 AS INT) + 1 AS frame, CAST(vec_id % 5 AS INT) AS band, CAST(i AS INT) AS ion,
                 abs(CAST(embedding[i] AS DOUBLE)) AS tot FROM embeddings, generate_series(1, 64) g(i))""",
    "ion_groups": """
 ion_groups AS (SELECT CAST(i AS INT) AS ion, CASE WHEN i <= 21 THEN 'ga' WHEN i <= 42 THEN 'gb' ELSE 'gc' END AS grp,
                CASE WHEN i <= 21 THEN 0 WHEN i <= 42 THEN 1 ELSE 2 END AS ord FROM generate_series(1, 64) g(i))""",
    "weights": """
 weights_s AS (SELECT frame, band, CASE WHEN ion <= 21 THEN 'ga' WHEN ion <= 42 THEN 'gb' ELSE 'gc' END AS grp,
               CASE WHEN ion <= 21 THEN 0 WHEN ion <= 42 THEN 1 ELSE 2 END AS ord, sum(tot) AS raw FROM ions GROUP BY ALL),
 weights AS (SELECT frame, band, grp, ord, raw / sum(raw) OVER (PARTITION BY frame, band) AS w,
             sum(raw) OVER (PARTITION BY frame, band) AS captured, sum(raw) OVER (PARTITION BY frame, band) AS total FROM weights_s)""",
    "rows_frames": """
 rows_frames AS (SELECT h, t, CAST(CASE WHEN (t + 1 + 7 * h) % 20 = 0 THEN 20 ELSE (t + 1 + 7 * h) % 20 END AS INT) AS frame
                 FROM (SELECT DISTINCT h, t FROM pop))""",
    "energies": """
 energies AS (SELECT CAST(vec_id // 5 AS INT) + 1 AS frame, CAST(vec_id % 5 AS INT) AS state,
              CAST(0.5 AS DOUBLE) * (vec_id % 5) + CAST(embedding[1] AS DOUBLE) AS e FROM embeddings)""",
    "nac": """
 nac_v AS (SELECT CAST(vec_id // 5 AS INT) + 1 AS frame, CAST(vec_id % 5 AS INT) AS s, CAST(embedding[1] AS DOUBLE) AS a,
           CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
 nac AS (SELECT l.frame, l.s AS i, r.s AS j, l.a * r.b - l.b * r.a AS v FROM nac_v l JOIN nac_v r ON l.frame = r.frame)""",
    "traj": """
 traj AS (SELECT CAST(vec_id AS INT) + 1 AS frame, CAST(k AS INT) AS atom, CAST(embedding[3 * k + 1] AS DOUBLE) AS x,
          CAST(embedding[3 * k + 2] AS DOUBLE) AS y, CAST(embedding[3 * k + 3] AS DOUBLE) AS z FROM embeddings, generate_series(0, 20) g(k))""",
    "windows": " windows AS (SELECT * FROM (VALUES ('early', 0, 2, 9), ('late', 1, 15, 29), ('all', 2, 0, 29)) w(name, ord, lo, hi))",
}
NEEDS = {"rows_frames": ["pop"], "weights": ["ions"]}


def duck_ctes(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if DUCK[name] not in out:
            out.append(DUCK[name])

    for name in names:
        add(name)
    return out
