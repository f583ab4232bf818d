"""Command line: `python -m halyard COMMAND --data FOLDER --out FOLDER`.

Each command runs a template of registered queries over a folder of Parquet tables and writes
one CSV folder for each, a Markdown report and a record of the environment.

`character-populations`, `character-crossings` and `character-ensemble` run over a campaign's own files with `--histories FILES
--state-map FILE --atom-groups FILE --manifest FILE` (crossings: `--energies FILE --couplings FILE`), `spectra` with `--spectra FILES`.
"""

from __future__ import annotations

import argparse
import json
import os
from functools import reduce

from pyspark.sql import SparkSession

from . import campaign
from .config import AtomGroups, StateMap
from .operators import spectra
from .plans import catalog  # noqa: F401  registers the queries
from .plans.registry import REGISTRY
from .plans.template import DEFAULTS, bind
from .provenance import environment
from .report import markdown, prepare_output
from .sources.sinks import write_csv
from .sources.tables import spectrum

COMMANDS = {
    "audit": ["O112_pair_audit", "O112_nac_checks", "O112_energy_stats", "O113_nac_ceiling", "O159_top_pairs"],
    "populations": ["O101_group_series", "O102_survival", "O110_conservation", "O179_exponential_fits"],
    "average": ["O109_master_average", "O096_ensemble_mean_sem", "O111_conservation_tally"],
    "kinetics": ["O170_master_fit", "O175_rate_bootstrap"],
    "compare-schemes": ["O155_scheme_ranking"],
    "compare-runs": ["O088_shared_times", "O135_differences", "O092_runs_side_by_side"],
    "transient-populations": ["O105_window_metrics", "O108_regimes"],
    "branching": ["O170_master_fit", "O193_local_ratio"],
    "extraction-competition": ["O199_extraction_competition"],
    "reviewer-summary": ["O125_reviewer_table"],
    "spectra": ["O138_spectrum_report", "O138_spectrum_bands", "O139_spectra_compare", "O140_shared_grid", "O161_peaks"],
    "trajectory": ["O223_vacf_fft", "O141_vacf_diagnostics", "O225_tapers", "O226_cosine_density"],
    "character-populations": ["O207_projected_mean", "O115_quality", "O116_dominance", "O149_swap_events", "O091_fixed_vs_projected", "O143_consumption", "O145_alignment_record"],
    "character-crossings": ["O208_frame_events", "O073_classified_events", "O130_aggregate_histories", "O133_sensitivity"],
    "character-ensemble": ["O129_history_net", "O122_run_summary", "O128_per_pass", "O124_episode_summary", "O127_ensemble_curve"],
    "regime-analysis": ["O108_regimes", "O187_early_narrative"],
}


def _windows(spark: SparkSession, given: list[str] | None):
    """name:lo:hi as rows, or nothing."""
    if not given:
        return None
    rows = [(n, int(lo), int(hi)) for n, lo, hi in (w.split(":") for w in given)]
    return spark.createDataFrame(rows, "name string, lo int, hi int")


def _parameters(given: list[str] | None) -> dict:
    """NAME=VALUE, as the type of the default that it replaces."""
    out = {}
    for name, _, value in (x.partition("=") for x in given or []):
        if name not in DEFAULTS:
            raise ValueError(f"no parameter {name!r}; there are {', '.join(sorted(DEFAULTS))}")
        out[name] = type(DEFAULTS[name])(value)
    return out


def _from_files(spark: SparkSession, args, parser) -> dict:
    """The results of a command over a campaign's own files."""
    if args.spectra:
        labels = [os.path.basename(p).removesuffix(".txt").removeprefix("spectral_density_") for p in args.spectra]
        table = reduce(lambda a, b: a.unionAll(b), (spectrum(spark, p, n) for p, n in zip(args.spectra, labels)))
        params = {"reference_label": args.reference or labels[0]}
        if params["reference_label"] not in labels:
            raise ValueError(f"{params['reference_label']!r} is not among {labels}")
        own = {k: v for k, v in _parameters(args.set).items() if k in ("rel_height", "max_peaks")}
        return {
            "report": spectra.described(table), "bands": spectra.band_rows(table), "shared_grid": spectra.shared_grid(table, **params),
            "differences": spectra.compare(table, **params), "peaks": bind(spectra.PEAKS, params=own, spectrum=table),
        }
    files = (spark, args.histories, StateMap.from_json(args.state_map), AtomGroups.from_json(args.atom_groups), args.manifest)
    walk = {"mode": args.mode, "period": args.period}
    if args.command == "character-populations":
        return campaign.character_populations(*files, **walk)
    if args.command == "character-crossings":
        if not (args.energies and args.couplings):
            parser.error("--energies and --couplings are needed")
        return campaign.character_crossings(*files, args.energies, args.couplings, windows=_windows(spark, args.window), **walk, **_parameters(args.set))
    if args.command == "character-ensemble":
        return campaign.character_ensemble(*files, frame_windows=_windows(spark, args.frame_window), **walk, **_parameters(args.set))
    parser.error(f"{args.command} reads --data only")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="halyard", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--data")
    parser.add_argument("--histories", nargs="+")
    parser.add_argument("--state-map")
    parser.add_argument("--atom-groups")
    parser.add_argument("--manifest")
    parser.add_argument("--mode", choices=["cyclic", "linear"], default="cyclic")
    parser.add_argument("--period", type=int)
    parser.add_argument("--energies", help="text table of state energies, a row for each frame")
    parser.add_argument("--couplings", help="text table of flattened coupling matrices, a row for each frame")
    parser.add_argument("--window", action="append", metavar="NAME:LO:HI", help="rows of the grid whose events are counted together")
    parser.add_argument("--frame-window", action="append", metavar="NAME:LO:HI", help="frames whose passes are summed")
    parser.add_argument("--set", action="append", metavar="NAME=VALUE", help="a threshold or another parameter of the plans")
    parser.add_argument("--spectra", nargs="+", help="files of frequency and intensity, for the command spectra")
    parser.add_argument("--reference", help="label of the spectrum that the others are compared with")
    parser.add_argument("--out", required=True)
    parser.add_argument("--overwrite", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"halyard {args.command}").getOrCreate()
    out = prepare_output(args.out, args.overwrite)
    if args.histories or (args.command == "spectra" and args.spectra):
        results = _from_files(spark, args, parser)
    elif args.data:
        results = {name: REGISTRY[name](spark, args.data) for name in COMMANDS[args.command]}
    else:
        parser.error("--data or --histories is needed")
    tables = {}
    for name, df in results.items():
        write_csv(df, os.path.join(out, name), args.overwrite)
        # the report reads what was written, so that nothing is computed twice
        tables[name] = spark.read.csv(os.path.join(out, name), header=True, schema=df.schema)
    with open(os.path.join(out, "report.md"), "w", encoding="utf-8") as f:
        f.write(markdown(args.command, tables))
    with open(os.path.join(out, "environment.json"), "w", encoding="utf-8") as f:
        json.dump(environment(spark), f, indent=1)


if __name__ == "__main__":
    main()
