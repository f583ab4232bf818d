"""Checks of a campaign before anything is averaged, as relations over what its files declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard atomic weights. A symbol that is not here is an error and never a guess.
MASSES = {
    "H": 1.008, "D": 2.014, "Li": 6.94, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.990, "Mg": 24.305, "Al": 26.982,
    "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "K": 39.098, "Ca": 40.078, "Ti": 47.867, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845,
    "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38, "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904, "Rb": 85.468,
    "Sr": 87.62, "Y": 88.906, "Zr": 91.224, "Ag": 107.868, "Cd": 112.414, "In": 114.818, "Sn": 118.710, "Sb": 121.760, "Te": 127.60, "I": 126.904,
    "Cs": 132.905, "Ba": 137.327, "La": 138.905, "Hf": 178.49, "Ta": 180.948, "W": 183.84, "Au": 196.967, "Hg": 200.592, "Tl": 204.38, "Pb": 207.2,
    "Bi": 208.980,
}


def masses(atoms: DataFrame, symbol: str = "symbol", *, refuse: bool = True) -> DataFrame:
    """atoms with the mass of each symbol; unknown symbols are an error, or null without refuse."""
    table = F.broadcast(atoms.sparkSession.createDataFrame(list(MASSES.items()), f"`{symbol}` string, mass double"))
    if refuse:
        unknown = sorted(str(r[0]) for r in atoms.select(symbol).distinct().join(table, symbol, "left_anti").limit(20).collect())
        if unknown:
            raise ValueError(f"no mass for {unknown}")
    return atoms.join(table, symbol, "left")


def scale_factor(scale: Column, cell: Column) -> Column:
    """What a lattice of nine numbers is multiplied by: a positive scale itself, a negative one the
    cube root of the volume it names over the cell's; null for a zero scale or a flat cell."""
    a = [cell[k] for k in range(9)]
    volume = F.abs(a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6]))
    return F.when((scale == 0) | (volume < 1e-12), F.lit(None)).when(scale > 0, scale).otherwise(F.pow(-scale / volume, F.lit(1.0 / 3.0)))


def expanded(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """One row for each ion of "n" and "a-b"; a spec that runs back or is neither gives none."""
    ends = F.split(F.regexp_extract(spec, r"^\s*(\d+\s*(?:-\s*\d+)?)\s*$", 1), "-")
    low = F.trim(ends[0]).try_cast("int")
    high = F.coalesce(F.trim(F.get(ends, F.lit(1))).try_cast("int"), low)
    return specs.withColumn("ion", F.explode(F.when(low <= high, F.sequence(low, high))))


def basis_sizes(pairs: DataFrame, by: str) -> DataFrame:
    """by, bmin, bmax, basis_size from the key, value, kind of each namelist; null unless both are whole numbers."""

    def whole(key: str) -> Column:
        return F.max(F.when((F.col("key") == key) & (F.col("kind") == "int"), F.col("value").cast("int")))

    out = pairs.groupBy(by).agg(whole("BMIN").alias("bmin"), whole("BMAX").alias("bmax"))
    return out.withColumn("basis_size", F.col("bmax") - F.col("bmin") + 1)


def band_windows(sizes: DataFrame) -> DataFrame:
    """Distinct band windows and how many files declare each; nulls are files without one."""
    return sizes.groupBy("bmin", "bmax").agg(F.count(F.lit(1)).alias("n_files"))


def band_conflicts(sizes: DataFrame, low: int, high: int) -> DataFrame:
    """The files whose window is not the chosen one."""
    return sizes.filter(F.col("bmin").isNotNull() & F.col("bmax").isNotNull() & ((F.col("bmin") != low) | (F.col("bmax") != high)))


def start_frames(files: DataFrame, name: str = "name", meta: str = "meta") -> DataFrame:
    """files with the start frame: the header's, or the number that ends the name; both must agree."""
    suffix = F.regexp_extract(name, r"SHPROP\.(\d+)$", 1).try_cast("int")
    return files.withColumns({
        "start": F.coalesce(F.col(meta), suffix),
        "source": F.when(F.col(meta).isNotNull(), "metadata").when(suffix.isNotNull(), "name"),
        "agree": F.col(meta).isNull() | suffix.isNull() | (F.col(meta) == suffix),
    })


def group_check(groups: DataFrame, n_ions: int) -> DataFrame:
    """ion, n_groups, verdict for every ion of the structure and every ion that a group names:
    ok, missing, shared or beyond."""
    named = groups.select("ion", "grp").distinct().groupBy("ion").agg(F.count(F.lit(1)).alias("n_groups"))
    every = groups.sparkSession.range(1, n_ions + 1).select(F.col("id").cast("int").alias("ion"))
    verdict = F.when(F.col("ion") > n_ions, "beyond").when(F.col("n_groups") == 0, "missing").when(F.col("n_groups") == 1, "ok").otherwise("shared")
    return every.join(named, "ion", "full").select("ion", F.coalesce("n_groups", F.lit(0)).cast("long").alias("n_groups")).withColumn("verdict", verdict)


def cycle_proposals(frames: DataFrame, declared: DataFrame, by: str) -> DataFrame:
    """by, covered, proposal, cycle: the frames 1 to N that are there without a gap, against the
    declared number of steps, which is N + 1; where they disagree nothing is chosen."""
    found = frames.groupBy(by).agg(F.count_distinct("frame").alias("n"), F.max("frame").alias("covered"), F.min("frame").alias("first"))
    steps = declared.groupBy(by).agg(F.min("nsw").alias("least"), F.max("nsw").alias("most"))
    proposal = (
        F.when((F.col("first") != 1) | (F.col("n") != F.col("covered")), "not_covered").when(F.col("least").isNull(), "unknown")
        .when((F.col("least") == F.col("most")) & (F.col("least") == F.col("covered") + 1), "agreed").otherwise("ambiguous")
    )
    out = found.join(steps, by, "left").withColumn("proposal", proposal)
    return out.select(by, F.col("covered").cast("int").alias("covered"), "proposal", F.when(F.col("proposal") == "agreed", F.col("covered")).cast("int").alias("cycle"))
