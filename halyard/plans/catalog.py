"""Every query by its inventory number, over the adapter views."""

from __future__ import annotations

from ..adapters import Views
from ..operators import audit, character, ensemble, episodes, events, longfit, network, populations, preparation, resampling, spectra, transfer
from . import oracles, registry
from .template import bind, with_literals

#: Inputs that are themselves plans over the adapter views, as SQL for both engines.
DERIVED = {
    "state_groups": "SELECT DISTINCT state, CASE WHEN state IN ('click', 'error') THEN 'acceptor' WHEN state = 'purchase' THEN 'middle' ELSE 'donor' END AS grp FROM {pop}",
    "series": populations.GROUP_SERIES,
    "mean_series": populations.ENSEMBLE,
    "metrics": populations.WINDOW_METRICS,
    "projected": character.PROJECTED_MEAN,
    "fixed": character.FIXED,
    "steps": oracles.STEPS,
    "moves": events.MOVES,
    "events": events.CLASSIFIED,
    "deltas": "SELECT h, t, grp, pg - lag(pg) OVER (PARTITION BY h, grp ORDER BY t) AS dp FROM {split}",
    "walk": "SELECT h, t, frame, lag(frame) OVER (PARTITION BY h ORDER BY t) AS frame0 FROM {rows_frames}",
    "histories": ensemble.HISTORY,
    "passes": ensemble.PER_PASS,
    "pairs": "SELECT h, t, sum(CASE WHEN state IN ('view', 'signup') THEN p ELSE 0 END) AS d, sum(CASE WHEN state IN ('click', 'purchase') THEN p ELSE 0 END) AS a FROM {pop} GROUP BY h, t",
    "levels": "SELECT 0.5D AS high, 0.4D AS low UNION ALL SELECT 0.45D, 0.35D UNION ALL SELECT 0.42D, 0.4D",
    "some_groups": "SELECT state, grp FROM {state_groups} WHERE grp <> 'donor'",
    "open_windows": "SELECT name, ord, CASE WHEN name = 'early' THEN NULL ELSE lo END AS lo, CASE WHEN name = 'late' THEN NULL ELSE hi END AS hi FROM {windows}",
    "two_windows": "SELECT * FROM {windows} WHERE name <> 'all'",
    "named_rows": populations.FIRST_WINDOW.replace("{windows}", "{two_windows}"),
    "counts": "SELECT DISTINCT band AS k FROM {pop}",
    "starts": "SELECT DISTINCT h, 1 + 7 * h AS start FROM {pop}",
    "required": "SELECT DISTINCT frame + 90 AS frame FROM {rows_frames}",
    "shifts": "SELECT DISTINCT CAST(atom AS INT) - 8 AS shift FROM {traj} WHERE atom <= 16",
    "frame_windows": "SELECT name, CASE name WHEN 'early' THEN 3 ELSE 7 END AS lo, CASE name WHEN 'early' THEN 8 ELSE 16 END AS hi FROM {two_windows}",
    "first_run": "SELECT DISTINCT t FROM {runs} WHERE run = 'A' AND t < 25",
    "second_run": "SELECT DISTINCT t FROM {runs} WHERE run = 'B' AND t >= 3",
    "velocities": spectra.VELOCITIES,
    "moving": spectra.COM_REMOVED,
    "shifted": spectra.SHIFTED,
    "vacf": spectra.VACF,
    "spread": episodes.SPREAD,
    "quantities": ensemble.QUANTITIES,
    "nets": "SELECT run AS grp, state AS quantity, max_by(p, t) - min_by(p, t) AS value FROM {runs} GROUP BY run, h, state",
    "spectrum": "SELECT CAST((frame - 1) * 5 + band AS INT) AS label, CAST(ion AS DOUBLE) AS f, tot AS y FROM {ions}",
    "uneven": "SELECT label, f + CASE WHEN label % 7 = 5 THEN 0.25D ELSE 0.0D END AS f, y FROM {spectrum} WHERE NOT (label % 7 = 3 AND f = 64)",
    "indexed": "SELECT CAST((frame - 1) * 5 + band AS INT) AS label, ion - 1 AS idx, tot AS y FROM {ions}",
    "kernel": "SELECT ion - 9 AS offset, exp(-0.5 * (ion - 9) * (ion - 9) / 4.0) AS weight FROM {ion_groups} WHERE ion <= 17",
    "edges": network.EDGES,
    "regimes": populations.REGIMES,
    "unlabelled": network.UNLABELLED,
    "lines": network.LINES,
    "atoms": network.MASS,
}


#: Rows of a block over the adapter tables: their grids have 30 points, and should be cut.
BLOCK_ROWS = 7
#: Frames of a block of their trajectories, which have hundreds.
BLOCK_FRAMES = 200

#: What Spark builds another way than the SQL of DERIVED says.
BUILT = {
    "arrays": lambda p: character.split_arrays(character.packed(p.views.pop), p.views.rows_frames, p.views.weights, BLOCK_ROWS),
    "split": lambda p: character.split_blocks(character.packed(p.views.pop), p.views.rows_frames, p.views.weights, BLOCK_ROWS),
    "steps": lambda p: p.bound(events.HISTORY_STEPS),
    "deltas": lambda p: p.bound(events.DELTAS),
    "walk": lambda p: character.walk(p.views.rows_frames, BLOCK_ROWS),
    "velocities": lambda p: spectra.velocities(p.views.traj, width=BLOCK_FRAMES),
    "metrics": lambda p: populations.window_metrics(p.get("series"), p.views.windows, BLOCK_ROWS),
}


def _inputs(sql: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class _Plans:
    """Derived inputs of one folder, built once."""

    def __init__(self, views: Views):
        self.views, self.built = views, {}

    def get(self, name: str):
        if name not in self.built:
            if name in BUILT:
                self.built[name] = BUILT[name](self)
            elif name in DERIVED:
                self.built[name] = self.bound(DERIVED[name])
            else:
                self.built[name] = getattr(self.views, name)
        return self.built[name]

    def bound(self, sql: str):
        return bind(sql, self.views.spark, **{k: self.get(k) for k in _inputs(sql)})


def _duck(sql: str) -> tuple[str, list[str]]:
    """The text with derived inputs as further common table expressions, and the base views."""
    ctes: dict[str, str] = {}
    bases: list[str] = []

    def need(text: str) -> None:
        for name in _inputs(text):
            own = oracles.INPUTS.get(name) or DERIVED.get(name)
            if own:
                if name not in ctes:
                    need(own)
                    ctes[name] = own
            elif name not in bases:
                bases.append(name)

    need(sql)
    body = sql
    if ctes:
        body = "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ctes.items()) + "\nSELECT * FROM (" + sql + ") z"
    return with_literals(body), bases


def plan(name: str, sql: str, doubles: str = "", duck: str | None = None) -> None:
    """Register one SQL plan; duck: the independent engine's text where it has to differ."""
    text, bases = _duck(duck or sql)

    registry.register(name, lambda views: _Plans(views).bound(sql), " ".join(bases), _for_duck(text), doubles)


def built(name: str, run, duck: str, doubles: str = "") -> None:
    """Register an operator of the DataFrame API over the plans of a folder, with the independent engine's text."""
    text, bases = _duck(duck)
    registry.register(name, lambda views: run(_Plans(views)), " ".join(bases), _for_duck(text), doubles)


def _whole_counts(text: str) -> str:
    """count_if gives a wider integer there."""
    out, at = "", 0
    while (k := text.find("count_if(", at)) >= 0:
        depth, end = 1, k + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = _whole_counts(text[k + len("count_if(") : end - 1])
        out += text[at:k] + f"CAST(count_if({inner}) AS BIGINT)"
        at = end
    return out + text[at:]


def _for_duck(text: str) -> str:
    """Literals of the double type and a few names are spelt differently."""
    import re

    text = _whole_counts(text)
    text = re.sub(r"EVEN\((\w+)\)", r"round_even(\1, 0)", text)
    text = re.sub(r"(\d+(?:\.\d+)?(?:e-?\d+)?)D\b", r"CAST(\1 AS DOUBLE)", text)
    text = re.sub(r"(?<![\w.'(])(\d+\.\d+)(?![\w'])", r"CAST(\1 AS DOUBLE)", text)
    return text.replace("FROM {weights} w LEFT SEMI JOIN", "FROM {weights} w SEMI JOIN")


#: The adapter spectra have 64 points at 1 to 64.
SPECTRUM_BANDS, SPECTRUM_RANGE = [(0, 8), (8, 16), (16, 32), (32.5, 33.2), (33, 80)], (0, 64)

P, C, A, E, X, T, N, S = populations, character, audit, events, episodes, transfer, ensemble, spectra

plan("O046_projection_table", C.TABLE_ROWS, "w captured total dominant_w")
plan("O054_envelope", N.ENVELOPE.replace("{series}", "{mean_series}"), "centre low high")
plan("O055_thinned_curve", N.THINNED.replace("{series}", "{mean_series}"), "mean")
plan("O056_time_units", P.TIME_UNITS, "from_fs from_ps from_ns")
plan("O057_nac_units", A.TO_MEV, "mev")
plan("O058_energy_scales", A.SCALES, "ev mev cm1")
plan("O062_window_resolve", P.RESOLVED.replace("{windows}", "{open_windows}"))
plan("O064_rate_sweep", P.SWEEP, "rate")
plan("O065_band_pairs", E.BAND_PAIRS)
plan("O066_ungrouped_states", P.UNGROUPED.replace("{state_groups}", "{some_groups}"))
plan("O067_cyclic_frames", C.CYCLIC)
plan("O067_linear_frames", C.LINEAR)
built("O068_grid_uniformity", lambda p: P.uniformity(p.views.pop, BLOCK_ROWS), P.UNIFORMITY, "mean_step least_step most_step spread")
plan("O071_step_verdict", N.STEP_VERDICT)
plan("O072_descriptor_counts", E.DESCRIPTORS)
plan("O073_classified_events", E.CLASSIFIED, "occ chr dp change gap nac", oracles.CLASSIFIED)
plan("O075_direction", E.DIRECTION)
plan("O076_quality_flags", C.FLAGGED, "captured")
plan("O079_projected_populations", C.PROJECTED, "pg")
plan("O080_required_frames", C.REQUIRED)
plan("O081_missing_frames", C.MISSING)
plan("O082_fragment_weights", "SELECT frame, band, grp, w, captured, total FROM {weights}", "w captured total")
plan("O083_file_groups", P.FILE_GROUPS, "value")
plan("O084_event_flags", E.FLAGS, "change gap nac factor")
plan("O085_history_steps", "SELECT * FROM {steps}", "occ chr dp")
plan("O086_first_window", P.FIRST_WINDOW.replace("{windows}", "{two_windows}"))
plan("O087_episode_rows", N.EPISODE_ROWS)
plan("O088_shared_times", N.SHARED_TIMES)
plan("O089_alignment_scan", X.ALIGNMENT, "score")
plan("O090_vacf_lag_join", S.VACF, "vacf", oracles.VACF)
built("O091_fixed_vs_projected", lambda p: C.fixed_vs_projected(p.get("projected"), p.get("fixed"), BLOCK_ROWS), C.FIXED_VS_PROJECTED, "most rms mean_d integral projected_there fixed_there")
plan("O092_runs_side_by_side", N.RUN_TABLE, "net_a net_b net_c")
plan("O093_episodes_side_by_side", N.EPISODE_TABLE, "net")
plan("O094_early_vs_late", E.EARLY_LATE)
plan("O096_ensemble_mean_sem", P.ENSEMBLE, "mean sem")
plan("O100_coverage", P.COVERAGE)
plan("O101_group_series", P.GROUP_SERIES, "mean sem")
plan("O102_survival", P.SURVIVAL, "survival sem")
built("O103_trapezoid", lambda p: P.trapezoid(p.get("series"), BLOCK_ROWS), P.TRAPEZOID, "integral")
plan("O105_window_metrics", "SELECT * FROM {metrics}", "initial final peak least net integral mean", oracles.WINDOW_METRICS)
plan("O108_regimes", P.REGIMES, "early_mean late_mean early_peak late_peak peak_ratio early_net late_net")
plan("O109_master_average", P.MASTER, "value spread")
plan("O110_conservation", P.CONSERVATION, "least most mean deviation")
plan("O111_conservation_tally", P.TALLY, "least most least_total most_total")
plan("O112_pair_audit", A.PAIRS, "mean_gap rms_gap mean_nac rms_nac p95_nac max_nac max_over_scale above_80 above_90 total integral", oracles.PAIRS)
plan("O113_nac_ceiling", A.CEILING, "most")
plan("O114_repeated_magnitude", A.REPEATED, "magnitude", oracles.REPEATED)
plan("O115_quality", C.QUALITY, "least median fraction_below")
plan("O115_quality_total", C.QUALITY_TOTAL, "least p01 p05 median p95 most")
plan("O115_worst_frames", C.WORST_FRAMES, "least")
plan("O116_dominance", C.DOMINANCE, "median_w mixed_fraction")
plan("O116_occupancy", C.OCCUPANCY, "share")
plan("O117_swap_summary", C.SWAP_SUMMARY)
plan("O118_fixed_vs_dynamic", C.FIXED_VS_DYNAMIC, "dynamic_net fixed_net dynamic_range fixed_range dynamic_mean fixed_mean dynamic_slope fixed_slope")
plan("O119_isolation", X.ISOLATION, "min_gap median_gap separation median_separation ratio")
plan("O120_raw_weight", X.RAW_WEIGHT, "excursion captured_least captured_most captured_range")
plan("O121_participation", X.PARTICIPATION, "separation pair_gap")
plan("O122_run_summary", N.STATS, "mean median std least most fraction_gain fraction_loss q05 q25 q75 q95", oracles.RUN_SUMMARY)
plan("O124_episode_summary", N.EPISODE_SUMMARY, "mean median std")
plan("O125_reviewer_table", N.REVIEWER, "median")
plan("O126_dominant_term", N.DOMINANT_TERM)
plan("O127_ensemble_curve", N.CURVE, "median q25 q75 least most")
plan("O128_per_pass", N.PER_PASS, "occ chr net")
plan("O129_history_net", N.HISTORY, "net_full net_late range_late occ chr")
plan("O130_aggregate_histories", E.TOTALS)
plan("O131_history_counts", E.COUNTS)
plan("O133_sensitivity", E.SENSITIVITY, "factor spread")
built("O135_differences", lambda p: N.differences(p.views.runs, "A", BLOCK_ROWS), N.DIFFERENCES, "initial final largest integral")
plan("O136_band_integral", S.BAND_INTEGRAL, "integral centroid")
built("O139_spectra_compare", lambda p: S.compare(p.get("spectrum"), SPECTRUM_BANDS, SPECTRUM_RANGE), oracles.COMPARED, "delta_fraction ratio_of_integral delta_centroid ratio_range_integral")
built("O140_shared_grid", lambda p: S.shared_grid(p.get("uneven")), oracles.SHARED_GRID, "grid_difference")
built("O138_spectrum_report", lambda p: S.described(p.get("spectrum"), SPECTRUM_RANGE), oracles.DESCRIBED, "f_least f_most resolution range_integral centroid")
built("O138_spectrum_bands", lambda p: S.band_rows(p.get("uneven"), SPECTRUM_BANDS, SPECTRUM_RANGE), oracles.BANDS, "integral fraction")
plan("O141_vacf_diagnostics", S.DIAGNOSTICS, "correlation_time")
built("O142_continuous_change", lambda p: T.continuous_change(p.get("pairs"), BLOCK_ROWS), T.CONTINUOUS, "donor_net acceptor_net max_step concomitant")
plan("O143_consumption", C.CONSUMPTION)
plan("O144_wrapped_histories", C.WRAPPED)
plan("O145_alignment_record", C.ALIGNMENT)
plan("O146_midpoint_split", "SELECT h, t, grp, pg, occ, chr FROM {split}", "pg occ chr", oracles.SPLIT)
plan("O146_split_residual", "SELECT h, residual < 1e-12 AS exact FROM (" + C.RESIDUAL + ") r", duck="SELECT h, residual < 1e-12 AS exact FROM (" + oracles.RESIDUAL + ") r")
plan("O147_dominant", C.DOMINANT, "dominant_w captured")
plan("O148_transitions", C.TRANSITIONS)
plan("O149_swap_events", C.SWAPS, "before_w after_w")
plan("O150_cycle_wrap_status", C.WRAP_STATUS)
plan("O151_episodes", X.EPISODES, "min_gap max_nac", oracles.EPISODES)
built("O152_cumulative", lambda p: C.driven(p.get("split"), BLOCK_ROWS), oracles.CUMULATIVE, "driven")
built("O153_threshold_events", lambda p: T.threshold_events(p.get("pairs"), p.get("levels"), BLOCK_ROWS), oracles.THRESHOLDS, "high low")
built("O154_strict_increase", lambda p: P.strict_increase(p.views.pop, BLOCK_ROWS), P.INCREASING)
plan("O154_same_grid", P.SAME_GRID)
plan("O156_local_table", X.LOCAL_TABLE, "gap nac a_ga a_gb b_ga b_gb")
plan("O157_manifold", X.MANIFOLD, "e0 e1 e2 gap01 gap02 gap12 nac01")
plan("O158_gaussian_smooth", S.SMOOTH, "y")
plan("O159_top_pairs", A.TOP_PAIRS, "mean_nac")
plan("O160_worst_samples", C.WORST, "captured")
plan("O161_peaks", S.PEAKS, "f y")
plan("O163_union_frames", C.ALL_FRAMES)
plan("O164_except_frames", C.EXCEPT)
plan("O026_couplings", A.COUPLINGS, "e nac_ev")
plan("O112_nac_checks", A.CHECKS, "diagonal asymmetry largest")
plan("O112_energy_stats", A.ENERGY_STATS, "mean std least most")
plan("O112_dephasing", A.DEPHASING, "least median most")
plan("O207_projected_mean", C.PROJECTED_MEAN, "mean sem occ chr", oracles.PROJECTED_MEAN)
plan("O208_frame_events", E.FRAME_EVENTS, "change gap nac")
plan("O210_episode_verdict", X.VERDICT, "donor_net acceptor_net")
plan("O221_velocities", S.VELOCITIES, "vx vy vz")
plan("O222_com_removal", S.COM_REMOVED, "m vx vy vz")
plan("O224_segmented_vacf", S.SEGMENTED, "vacf")
plan("O225_tapers", S.TAPERED, "vacf hann hamming")
plan("O226_cosine_density", S.COSINE, "f_cm1 intensity")

W = network

plan("O167_edge_names", W.NAMES)
plan("O168_rate_matrix", W.MATRIX, "v")

for _name, _options, _duck_text in (
    ("O189_reverse_reach", {"start": 3, "backward": True}, W.BACKWARD),
    ("O190_forward_reach", {"start": 0, "blocked": 3}, W.FORWARD),
):
    _text, _bases = _duck(f"SELECT state FROM ({_duck_text}) x")
    registry.register(_name, lambda views, own=_options: W.reachable(_Plans(views).get("edges"), **own), " ".join(_bases), _for_duck(_text))
plan("O193_local_ratio", W.LOCAL_RATIO, "ratio")
plan("O173_independent_residuals", W.RESIDUAL_COUNT)
plan("O184_contrast_rss", W.CONTRAST_RSS, "rss plain")
plan("O183_criteria", W.CRITERIA, "aic bic aicc")
plan("O187_early_narrative", W.NARRATIVE, "early_net late_net early_peak early_share")
plan("O215_column_inference", W.COLUMN_BLOCKS)
plan("O214_survey", W.SURVEY)
plan("X05_fragment_rule", W.FRAGMENT_RULE)
plan("X07_neighbourhood", W.NEIGHBOURHOOD, "w")
plan("X08_jumps", W.JUMPS, "de")
plan("X09_shift_score", W.SHIFT_SCORE, "median_shift most_shift same_sign")
plan("X10_centroid_spread", W.CENTROID, "centroid spread")
plan("X13_common_mode", W.COMMON_MODE, "median_shift same_sign")
plan("X15_gap_summary", W.GAP_SUMMARY, "gap_mev")


plan(
    "O188_fit_status", W.FIT_STATUS,
    duck="SELECT h, CASE WHEN l[1] <= 0 THEN 'not_positive' WHEN len(l) < 5 THEN 'too_few_points' WHEN list_avg(l[len(l) - len(l) // 5 + 1:]) >= list_avg(l[1:len(l) // 5]) THEN 'refused_rise' ELSE 'fit' END AS status "
    "FROM (SELECT h, list(p ORDER BY t) AS l FROM {pop} WHERE state = :target_state GROUP BY h) a",
)


# preparation: what parts declare in their names, sizes and types stands for headers and file names ----

#: Spark and the independent engine spell the number of a brand differently.
_BRAND = "cast(substr(p_brand, 7) as int)"


def _parts(views: Views, *columns: str):
    return views.table("part").selectExpr(*columns)


def _sizes(views: Views):
    from ..sources.tables import namelist_pairs

    line = f"concat('&RUN BMIN = ', p_size, ', BMAX=', if(p_type = 'PROMO', cast(p_retailprice as string), cast(p_size + {_BRAND} as string)), ' / ! made of a part') as line"
    return preparation.basis_sizes(namelist_pairs(_parts(views, "p_partkey", line)), "p_partkey")


_SIZES = f"(SELECT p_partkey, p_size AS bmin, CASE WHEN p_type <> 'PROMO' THEN p_size + {_BRAND} END AS bmax FROM part)"
registry.register("O018_basis_size", _sizes, "", f"SELECT p_partkey, bmin, bmax, bmax - bmin + 1 AS basis_size FROM {_SIZES} s")
registry.register("O165_band_windows", lambda v: preparation.band_windows(_sizes(v)), "", f"SELECT bmin, bmax, count(*) AS n_files FROM {_SIZES} s GROUP BY ALL")
registry.register(
    "O095_band_conflicts", lambda v: preparation.band_conflicts(_sizes(v), 10, 20), "",
    f"SELECT p_partkey, bmin, bmax, bmax - bmin + 1 AS basis_size FROM {_SIZES} s WHERE bmax IS NOT NULL AND NOT (bmin = 10 AND bmax = 20)",
)
registry.register(
    "O204_start_frame",
    lambda v: preparation.start_frames(_parts(v, "p_partkey", "concat('run/SHPROP.', substr(p_brand, 7)) as name", "if(p_type = 'PROMO', null, p_size) as meta")).drop("name", "meta"), "",
    f"SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN {_BRAND} ELSE p_size END AS start, CASE WHEN p_type = 'PROMO' THEN 'name' ELSE 'metadata' END AS source, p_type = 'PROMO' OR p_size = {_BRAND} AS agree FROM part",
)
registry.register(
    "O031_atom_expansion",
    lambda v: preparation.expanded(_parts(v, "p_partkey", f"if(p_type = 'ECONOMY', concat(p_size, '-', p_size + {_BRAND} - 5), cast(p_size as string)) as spec")).select("p_partkey", "ion"), "",
    f"SELECT p_partkey, unnest(CASE WHEN p_type = 'ECONOMY' THEN generate_series(CAST(p_size AS INT), CAST(p_size AS INT) + {_BRAND} - 5) ELSE [CAST(p_size AS INT)] END) AS ion FROM part",
)
registry.register(
    "O218_atom_groups",
    lambda v: preparation.group_check(_parts(v, "cast(p_size as int) as ion", "p_type as grp", "p_name").filter("p_name = 'cold widget'"), 45), "",
    """SELECT ion, count(grp) AS n_groups, CASE WHEN ion > 45 THEN 'beyond' WHEN count(grp) = 0 THEN 'missing' WHEN count(grp) = 1 THEN 'ok' ELSE 'shared' END AS verdict
FROM (SELECT CAST(i AS INT) AS ion, NULL AS grp FROM generate_series(1, 45) g(i) UNION SELECT CAST(p_size AS INT), p_type FROM part WHERE p_name = 'cold widget') x GROUP BY ion""",
)
registry.register(
    "O216_cycle_proposal",
    lambda v: preparation.cycle_proposals(
        _parts(v, "p_brand", "cast(p_size % 16 + 1 as int) as frame"), _parts(v, "p_brand", "p_type", f"{_BRAND} % 3 + 16 as nsw").filter("p_type = 'PROMO'"), "p_brand"
    ), "",
    f"""SELECT f.p_brand, f.covered, CASE WHEN NOT whole THEN 'not_covered' WHEN d.nsw IS NULL THEN 'unknown' WHEN d.nsw = f.covered + 1 THEN 'agreed' ELSE 'ambiguous' END AS proposal,
       CASE WHEN whole AND d.nsw = f.covered + 1 THEN f.covered END AS cycle
FROM (SELECT p_brand, CAST(max(p_size % 16 + 1) AS INT) AS covered, list_sort(list_distinct(list(p_size % 16 + 1))) = range(1, max(p_size % 16 + 1) + 1) AS whole FROM part GROUP BY p_brand) f
LEFT JOIN (SELECT DISTINCT p_brand, {_BRAND} % 3 + 16 AS nsw FROM part WHERE p_type = 'PROMO') d ON d.p_brand = f.p_brand""",
)
registry.register(
    "O220_masses", lambda v: preparation.masses(_parts(v, "p_partkey", "upper(substr(p_name, 1, 1)) as symbol"), refuse=False).select("p_partkey", "symbol", "mass"), "",
    """SELECT p_partkey, upper(substr(p_name, 1, 1)) AS symbol, CAST(CASE upper(substr(p_name, 1, 1)) WHEN 'H' THEN 1.008 WHEN 'D' THEN 2.014 WHEN 'B' THEN 10.81 WHEN 'C' THEN 12.011 WHEN 'N' THEN 14.007
 WHEN 'O' THEN 15.999 WHEN 'F' THEN 18.998 WHEN 'P' THEN 30.974 WHEN 'S' THEN 32.06 WHEN 'K' THEN 39.098 WHEN 'Y' THEN 88.906 WHEN 'I' THEN 126.904 WHEN 'W' THEN 183.84 END AS DOUBLE) AS mass FROM part""",
    "mass",
)


def _scales(views: Views):
    from pyspark.sql import functions as F

    cells = views.table("embeddings").selectExpr("vec_id", "transform(slice(embedding, 1, 9), x -> cast(x as double)) as cell", "cast(embedding[9] as double) as scale")
    return cells.select("vec_id", "scale", preparation.scale_factor(F.col("scale"), F.col("cell")).alias("factor"))


registry.register(
    "O024_lattice_scale", _scales, "",
    """SELECT vec_id, scale, CASE WHEN scale = 0 OR volume < 1e-12 THEN NULL WHEN scale > 0 THEN scale ELSE pow(abs(scale) / volume, CAST(1 AS DOUBLE) / 3) END AS factor
FROM (SELECT vec_id, CAST(embedding[10] AS DOUBLE) AS scale, abs(c[1] * c[5] * c[9] + c[2] * c[6] * c[7] + c[3] * c[4] * c[8] - c[3] * c[5] * c[7] - c[2] * c[4] * c[9] - c[1] * c[6] * c[8]) AS volume
      FROM (SELECT vec_id, embedding, CAST(embedding[1:9] AS DOUBLE[]) AS c FROM embeddings) x) y""",
    "scale factor",
)


# operators of the DataFrame API, with independent SQL where it can say the same ---------------


def _clean(views: Views):
    from pyspark.sql import functions as F

    from ..sources.tables import clean_line

    return _Plans(views).get("lines").select("event_id", clean_line(F.col("line")).alias("clean"))


registry.register(
    "O002_line_cleaner", _clean, "",
    "SELECT event_id, concat(CAST(event_id AS VARCHAR), '.5E-0', CAST(user_id % 7 AS VARCHAR), '  1E+2') AS clean FROM events",
)


def _kinds(views: Views):
    from pyspark.sql import functions as F

    from ..sources.tables import header_value

    return _Plans(views).get("lines").select("event_id", header_value(F.col("raw")).alias("kind"))


registry.register(
    "O005_header_values", _kinds, "",
    "SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'bool' WHEN 1 THEN 'int' WHEN 2 THEN 'float' ELSE 'string' END AS kind FROM events",
)


def _flat(views: Views):
    return P.flat_metrics(_Plans(views).get("metrics"), ["acceptor", "donor"], ["peak", "net"])


_text, _bases = _duck(
    "SELECT name, max(CASE WHEN grp = 'acceptor' THEN peak END) AS acceptor_peak, max(CASE WHEN grp = 'acceptor' THEN net END) AS acceptor_net, "
    "max(CASE WHEN grp = 'donor' THEN peak END) AS donor_peak, max(CASE WHEN grp = 'donor' THEN net END) AS donor_net FROM {metrics} GROUP BY name"
)
registry.register("O107_flat_metrics", _flat, " ".join(_bases), _for_duck(_text), "acceptor_peak acceptor_net donor_peak donor_net")


def _vacf_fft(views: Views):
    return S.vacf_fft(_Plans(views).get("moving"), width=BLOCK_FRAMES)


built(
    "O227_trajectory_spectrum",
    lambda p: S.trajectory_spectrum(p.views.traj, p.get("atoms"), S.MAX_LAG, width=BLOCK_FRAMES)[1],
    f"SELECT CAST(k AS INT) AS k, k * {audit.INV_FS_TO_CM1}D / 10 AS f, list_sum([2 * l[i] * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 9)) * cos(2 * pi() * k * (i - 1) / 10) FOR i IN range(1, 11)]) AS y "
    "FROM (SELECT list(vacf ORDER BY lag) AS l FROM (" + oracles.VACF + ") v) w, generate_series(1, 5) g(k)",
    "f y",
)


_text, _bases = _duck(S.VACF)
registry.register("O223_vacf_fft", _vacf_fft, " ".join(_bases), _for_duck(_text), "vacf")


# fits and first passage: no SQL; tests hold them to closed forms ----------------------------------

_GROUPS = ["acceptor", "donor", "middle"]


def _config_series(views: Views):
    return bind(
        "SELECT r.run AS config, r.t, g.grp, avg(r.value) AS value FROM (SELECT run, h, t, grp, sum(p) AS value FROM {runs} r JOIN {state_groups} USING (state) GROUP BY run, h, t, grp) r "
        "JOIN (SELECT DISTINCT grp FROM {state_groups}) g ON g.grp = r.grp GROUP BY r.run, r.t, g.grp",
        views.spark, runs=views.runs, state_groups=_Plans(views).get("state_groups"),
    )


def _fits(views: Views):
    from ..functions.kinetics import fit_configurations

    return fit_configurations(_config_series(views), _GROUPS, {"sequential": "donor->middle,middle->acceptor", "direct": "donor->acceptor,acceptor->donor"})


registry.register("O170_master_fit", _fits)


def _ranked(views: Views):
    return bind(
        "SELECT config, scheme, rank() OVER (PARTITION BY config ORDER BY aicc NULLS LAST, scheme) AS place, aicc - min(aicc) OVER (PARTITION BY config) AS delta "
        "FROM (SELECT DISTINCT config, scheme, aicc FROM {fits}) f", views.spark, fits=_fits(views),
    )


def _block_fit(views: Views):
    edges = [(1, 0), (0, 1)]
    fit = longfit.fit_series(bind("SELECT t, grp, mean AS value FROM {series}", views.spark, series=_Plans(views).get("series")), _GROUPS, edges, width=BLOCK_ROWS)
    return views.spark.createDataFrame(longfit.rate_rows(fit), "edge string, rate double, std double, status string, r_squared double")


registry.register("O170_block_fit", _block_fit)


registry.register("O155_scheme_ranking", _ranked)


def _per_history(views: Views):
    return bind("SELECT h, t, grp, value FROM {f}", views.spark, f=_Plans(views).get("file_groups"))


DERIVED["file_groups"] = P.FILE_GROUPS


_DIRECT = "donor->acceptor,acceptor->donor"


def _draws() -> str:
    """The draws of the 200 resamples of the adapters' histories, as rows."""
    import numpy as np

    from ..adapters import HISTORIES
    from ..functions.kinetics import picks

    rows = [(b, h, int((drawn == h).sum())) for b, drawn in enumerate(picks(HISTORIES, 200)) for h in np.unique(drawn).tolist()]
    return ", ".join(map(str, rows))


registry.register("O175_rate_bootstrap", lambda v: resampling.interval(resampling.bootstrap_rates(_per_history(v), _GROUPS, _DIRECT)))
registry.register("O180_exponential_bootstrap", lambda v: resampling.bootstrap_lifetimes(_per_history(v), _GROUPS))
registry.register("O196_branch_bootstrap", lambda v: resampling.bootstrap_branch(_per_history(v), _GROUPS, "middle->acceptor,middle->donor", "middle", ["donor"], ["acceptor"]))
built(
    "O175_resampled_means",
    lambda p: resampling.resampled_means(resampling.resampled_series(_per_history(p.views), _GROUPS, width=BLOCK_ROWS), _GROUPS),
    "SELECT CAST(w.b AS INT) AS resample, CAST(f.t AS DOUBLE) AS t, f.grp, sum(f.value * w.n) / 4 AS value FROM {file_groups} f JOIN (VALUES " + _draws() + ") w(b, h, n) ON w.h = f.h GROUP BY w.b, f.t, f.grp",
    "value",
)


def _competition(views: Views):
    """Extraction against recombination for a range of escape rates, from the fitted direct scheme."""
    import numpy as np
    import pandas as pd

    from ..functions import kinetics as K
    from ..session import ship_code

    ship_code(views.spark)
    sweep = np.geomspace(0.01, 100, 9)

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        edges = [tuple(_GROUPS.index(g) for g in e.split("->")) for e in pdf["edge"]]
        k = K.rate_matrix(pdf["rate"].to_numpy(), edges, len(_GROUPS))
        p0 = np.array([0.0, 1.0, 0.0])
        rows = [K.yields(k, 1, {0}, r, p0) for r in sweep]
        cross = K.crossover(k, 1, {0}, p0, sweep)
        return pd.DataFrame({"config": key[0], "escape": sweep, "extracted": [a for a, _ in rows], "recombined": [b for _, b in rows], "crossover": cross})

    direct = _fits(views).filter("scheme = 'direct'")
    return direct.groupBy("config").applyInPandas(one, "config string, escape double, extracted double, recombined double, crossover double")


registry.register("O199_extraction_competition", _competition)


def _decays(views: Views):
    import pandas as pd

    from ..functions import kinetics as K
    from ..session import ship_code

    ship_code(views.spark)

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        time, y = pdf["t"].to_numpy(float), pdf["mean"].to_numpy(float)
        e, d = K.fit_exponential(time, y), K.fit_decay(time, y)
        return pd.DataFrame({"grp": [key[0]], "tau": [e["tau"]], "r_squared": [e["r_squared"]], "status": [e["status"]], "rate": [d["rate"]]})

    return _Plans(views).get("series").groupBy("grp").applyInPandas(one, "grp string, tau double, r_squared double, status string, rate double")


registry.register("O179_exponential_fits", _decays)


plan("O104_group_summary", "SELECT grp, initial, final, net, peak, peak_time, least, integral FROM {metrics} WHERE name = 'all'", "initial final net peak least integral")
plan(
    "O226_power_density",
    f"SELECT k, k * {audit.INV_FS_TO_CM1}D / 10.0 AS f_cm1, pow(sum(vacf * cos(2 * pi() * k * lag / 10.0)), 2) + pow(sum(vacf * sin(2 * pi() * k * lag / 10.0)), 2) AS power "
    "FROM {vacf} CROSS JOIN (SELECT DISTINCT lag AS k FROM {vacf} WHERE lag BETWEEN 1 AND 5) f GROUP BY k",
    "f_cm1 power",
)
plan(
    "O209_history_event_windows",
    "SELECT e.h, w.name, e.descriptor, count(*) AS n FROM {events} e JOIN {windows} w ON e.t BETWEEN w.lo AND w.hi GROUP BY e.h, w.name, e.descriptor",
)
plan("O074_swap_moves", "SELECT frame, band, before AS from_group, after AS to_group FROM (" + C.SWAPS + ") s WHERE resolution = 'adjacent'")
plan("O123_statistics", N.STATS.replace("{quantities}", "{nets}"), "mean median std least most fraction_gain fraction_loss q05 q25 q75 q95")
plan("O132_descriptors_by_window", "SELECT w.name, e.descriptor, count(*) AS n FROM {events} e JOIN {windows} w ON e.t BETWEEN w.lo AND w.hi WHERE e.classification = 'character_swap_with_projected_fragment_change' GROUP BY w.name, e.descriptor")
plan("O162_shared_groups", "SELECT state FROM {runs} WHERE run = 'A' INTERSECT SELECT state FROM {runs} WHERE run = 'B'")


def _peak_widths(views: Views):
    from ..functions.peaks import peak_table

    return peak_table(_Plans(views).get("spectrum"), 0, 64, max_peaks=8)


registry.register("O161_peak_widths", _peak_widths)


def _by_configuration(views: Views, one, schema: str):
    """one(config, time, observed) over each configuration's series."""
    from ..functions import kinetics as K
    from ..session import ship_code

    ship_code(views.spark)

    def run(key, pdf):
        import pandas as pd

        return pd.DataFrame(one(key[0], *K._wide(pdf, _GROUPS)))

    return _config_series(views).groupBy("config").applyInPandas(run, schema)


_EDGES = [(1, 0), (0, 1), (1, 2), (2, 0)]


def _propagated(views: Views):
    def one(config, time, observed):
        from ..functions import kinetics as K

        model = K.fit_rates(time, observed, _GROUPS, _EDGES, n_starts=2).model
        return [{"config": config, "t": float(t), "grp": g, "p": float(p)} for t, row in zip(time, model) for g, p in zip(_GROUPS, row)]

    return _by_configuration(views, one, "config string, t double, grp string, p double")


registry.register("O169_propagation", _propagated)


def _branches(views: Views):
    def one(config, time, observed):
        from ..functions import kinetics as K

        fit = K.fit_rates(time, observed, _GROUPS, _EDGES, n_starts=2)
        b = K.branch(fit, 1, {2}, {0})
        report = K.absorption(fit.matrix, {2}, {0})[1]
        return [{"config": config, "value": b["value"], "grade": b["grade"], "unresolved": report["unresolved"]}]

    return _by_configuration(views, one, "config string, value double, grade string, unresolved double")


registry.register("O195_branch_probability", _branches)


def _sinks(views: Views):
    def one(config, time, observed):
        import numpy as np

        from ..functions import kinetics as K

        fit = K.fit_rates(time, observed, _GROUPS, _EDGES, n_starts=2)
        rows = K.sink_sweep(fit, 1, np.geomspace(0.01, 10, 7), time, observed[0])
        return [{"config": config, **r} for r in rows]

    return _by_configuration(views, one, "config string, escape double, extracted double, acceptor double, donor double, middle double")


registry.register("O176_sink_sweep", _sinks)


def _piecewise(views: Views):
    def one(config, time, observed):
        from ..functions import kinetics as K

        out = K.compare_piecewise(time, observed, _GROUPS, [(1, 0), (0, 1)], cut=15.0)
        early = K.fit_regime("early", time, observed, _GROUPS, [(1, 0), (0, 1)], 0, 15)
        return [{"config": config, "preferred": out["preferred"], "global_rss": out["global"]["rss"], "piecewise_rss": out["piecewise"]["rss"], "early_reason": early["reason"]}]

    return _by_configuration(views, one, "config string, preferred string, global_rss double, piecewise_rss double, early_reason string")


registry.register("O186_piecewise", _piecewise)


def _split_blocks(views: Views):
    return C.split_blocks(C.packed(views.pop), views.rows_frames, views.weights, block_rows=8).select("h", "t", "grp", "pg", "occ", "chr")


_text, _bases = _duck(oracles.SPLIT)
registry.register("O097_streamed_split", _split_blocks, " ".join(_bases), _for_duck(_text), "pg occ chr")


def _checked_ensemble(views: Views):
    """Histories in two batches; the second also brings the first history of all again, under another name, and each
    history stretched in time and with a share too much: all of these are refused."""
    from uuid import uuid4

    from pyspark.sql import functions as F

    from ..session import shared_folder
    from ..streaming.checked import EnsembleStore

    spark, rows = views.spark, views.pop.selectExpr("CAST(h AS LONG) AS h", "t", "CAST(t AS DOUBLE) AS time", "state", "p")
    store = EnsembleStore(spark, f"{shared_folder(spark)}/ensemble-{uuid4().hex}")
    store.fold(rows.filter("h % 2 = 0"), 0)
    again = rows.filter("h = 0").withColumn("h", F.lit(1_000_000).cast("long"))
    stretched = rows.selectExpr("h + 2000000 AS h", "t", "time * 2 AS time", "state", "p")
    heavy = rows.selectExpr("h + 3000000 AS h", "t", "time", "state", "p * 1.5 AS p")
    store.fold(rows.filter("h % 2 = 1").unionByName(again).unionByName(stretched).unionByName(heavy), 1)
    return store.result()


registry.register("O097_checked_ensemble", _checked_ensemble, "pop", P.ENSEMBLE, "mean sem")
