"""Command line: ``python -m ionweave cluster|pretrain|inspect``."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import sys

from ionweave.config import ClusterConfig, PretrainConfig

# Fixed flag names and the settings they stand for.
CLUSTER_FLAGS = {
    "mgf": "mgf_path", "out": "output_dir", "mz-max": "mz_max", "bin-width": "bin_width", "top-k": "top_k_peaks",
    "embed-dim": "embed_dim", "n-heads": "n_heads", "n-layers": "n_layers", "method": "method",
    "precursor-tol": "precursor_tol_da", "precursor-tol-ppm": "precursor_tol_ppm", "edge-threshold": "edge_threshold",
    "n-eigvec": "n_eigenvectors", "dbscan-eps": "dbscan_eps", "dbscan-min": "dbscan_min_samples",
    "max-spectra": "max_spectra", "encoder-weights": "encoder_weights",
}
CLUSTER_SWITCHES = {
    "no-dynamic-split": ("dynamic_split_enabled", False), "no-dynamic-merge": ("dynamic_merge_enabled", False),
    "quiet": ("verbose", False), "resume": ("resume", True), "no-transformer": ("use_transformer", False),
    "no-encoder": ("use_encoder", False),
}
PRETRAIN_FLAGS = {
    "mgf": "mgf_path", "psm": "psm_path", "format": "psm_format", "out": "output_path", "epochs": "epochs",
    "pk-classes": "pk_classes_per_batch", "pk-samples": "pk_samples_per_class", "lr": "lr",
    "temp": "temperature", "lambda-uniform": "lambda_uniform", "lambda-uniform-warmup": "lambda_uniform_warmup_epochs",
    "weight-decay": "weight_decay", "fdr": "fdr_threshold", "min-spectra": "min_spectra_per_peptide",
    "val-split": "val_split", "patience": "early_stopping_patience",
}
PRETRAIN_SWITCHES = {"no-augment": ("augment", False)}


def _convert(base, name: str, text: str):
    """Text as the type of the setting's default; optional settings are numbers."""
    default = getattr(base, name)
    if isinstance(default, bool):
        return text.lower() in ("1", "true", "yes", "on")
    if default is None:
        return None if text.lower() == "none" else (int(text) if text.lstrip("-").isdigit() else float(text))
    return type(default)(text)


def settings(base, flags: dict, switches: dict, args: argparse.Namespace):
    """``base`` with the given flags, switches and ``--set name=value`` pairs."""
    known = {f.name for f in dataclasses.fields(base)}
    changes = {}
    for flag, name in flags.items():
        text = getattr(args, flag.replace("-", "_"))
        if text is not None:
            changes[name] = _convert(base, name, text)
    for flag, (name, value) in switches.items():
        if getattr(args, flag.replace("-", "_")):
            changes[name] = value
    for pair in args.set or []:
        name, _, text = pair.partition("=")
        if name not in known:
            raise SystemExit(f"unknown setting {name}")
        changes[name] = _convert(base, name, text)
    return base.replace(**changes)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ionweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for command, flags, switches in (("cluster", CLUSTER_FLAGS, CLUSTER_SWITCHES),
                                     ("pretrain", PRETRAIN_FLAGS, PRETRAIN_SWITCHES)):
        sub = commands.add_parser(command)
        for flag in flags:
            sub.add_argument(f"--{flag}")
        for flag in switches:
            sub.add_argument(f"--{flag}", action="store_true")
        sub.add_argument("--set", action="append", metavar="NAME=VALUE", help="any other setting")
    commands.add_parser("inspect").add_argument("path")
    return top


def cluster_settings(args: argparse.Namespace) -> ClusterConfig:
    cfg = settings(ClusterConfig.command_line(), CLUSTER_FLAGS, CLUSTER_SWITCHES, args)
    # given weights are weights of a transformer
    return cfg.replace(use_transformer=True) if cfg.encoder_weights else cfg


def main(argv=None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s", stream=sys.stdout)
    from ionweave.session import builder
    spark = builder().getOrCreate()
    if args.command == "cluster":
        from ionweave.plans.cluster import run
        run(spark, cluster_settings(args))
    elif args.command == "pretrain":
        from ionweave.plans.pretrain import load, write_batches
        cfg = settings(PretrainConfig.command_line(), PRETRAIN_FLAGS, PRETRAIN_SWITCHES, args)
        if not cfg.mgf_path or not cfg.psm_path:
            raise SystemExit("--mgf and --psm are needed")
        write_batches(load(spark, cfg), cfg)
    else:
        from ionweave.sources.store import describe_checkpoint
        describe_checkpoint(spark, args.path).show(truncate=False)


if __name__ == "__main__":
    main()
