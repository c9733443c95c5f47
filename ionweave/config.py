"""Run settings.  All field names and defaults below are fixed values: they are
the public settings a user of the analysis already knows."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Optional

PROTON_MASS = 1.007276


@dataclass(frozen=True)
class ClusterConfig:
    # input and output
    mgf_path: object = ""
    output_dir: str = "ionweave_out"
    resume: bool = False
    max_spectra: Optional[int] = None
    verbose: bool = True
    # preprocessing
    mz_min: float = 50.0
    mz_max: float = 1500.0
    bin_width: float = 0.02
    top_k_peaks: int = 150
    quality_filter_enabled: bool = False
    quality_min_peaks: int = 5
    quality_min_mz_range: float = 250.0
    remove_precursor_peaks: bool = False
    precursor_removal_tol_da: float = 1.5
    # encoder
    embed_dim: int = 128
    n_heads: int = 4
    n_layers: int = 2
    ff_dim: int = 256
    use_transformer: bool = False
    encoder_weights: str = ""
    use_encoder: bool = True
    # similarity graph
    precursor_tol_da: float = 1.5
    precursor_tol_ppm: float = 10.0
    edge_threshold: float = 0.70
    ann_n_neighbours: int = 100
    use_hd_prefilter: bool = False
    hd_target_bucket_size: int = 2_000
    hd_seed: int = 42
    hd_n_repeats: int = 6
    hd_bucketed_min_repeat_votes: Optional[int] = 2
    # clustering
    method: str = ""  # spectral, components, seeded or bucketed; empty: seeded with use_hdbscan, else spectral
    n_eigenvectors: int = 30
    dbscan_eps: float = 0.15
    dbscan_min_samples: int = 2
    split_var_threshold: float = 0.04
    dbscan_eps_embedding: Optional[float] = None
    split_var_threshold_embedding: float = 0.30
    merge_dist_threshold: float = 0.05
    dynamic_split_enabled: bool = True
    dynamic_merge_enabled: bool = False
    use_hdbscan: bool = False
    hdbscan_min_cluster_size: int = 2
    hdbscan_min_samples: int = 1
    hdbscan_cluster_selection_method: str = "leaf"
    strict_reference: bool = True  # seeded path splits with the spectral-space limits
    gap_post_split: bool = False
    # reranking
    sigma_q: float = 0.10
    high_q_threshold: float = 0.80
    medium_q_threshold: float = 0.50
    mass_group_gap_da: float = 0.5
    ptm_fragment_mz_tol: float = 0.02
    ptm_min_unshifted_matches: int = 2
    ptm_min_shifted_matches: int = 1
    # misc
    seed: int = 42

    def replace(self, **changes) -> "ClusterConfig":
        return dataclasses.replace(self, **changes)

    @property
    def n_bins(self) -> int:
        import math

        return int(math.ceil((self.mz_max - self.mz_min) / self.bin_width))

    @property
    def stage_two_method(self) -> str:
        method = self.method or ("seeded" if self.use_hdbscan else "spectral")
        if method not in ("spectral", "components", "seeded", "bucketed"):
            raise ValueError(f"unknown clustering method {method!r}")
        return method

    @property
    def raw_split_eps(self) -> float:
        """Euclidean radius equal to the edge threshold's cosine on unit vectors."""
        if self.dbscan_eps_embedding is not None:
            return self.dbscan_eps_embedding
        return max(0.0, 2.0 * (1.0 - self.edge_threshold)) ** 0.5

    @classmethod
    def command_line(cls, **changes) -> "ClusterConfig":
        """Defaults of the command-line front end (transformer and merge on)."""
        return cls(use_transformer=True, dynamic_merge_enabled=True).replace(**changes)

    @classmethod
    def seeded(cls, **changes) -> "ClusterConfig":
        """The graph-seeded density preset."""
        return cls(
            use_hdbscan=True,
            dbscan_min_samples=2,
            edge_threshold=0.85,
            ann_n_neighbours=20,
        ).replace(**changes)


@dataclass(frozen=True)
class PretrainConfig:
    mgf_path: str = ""
    psm_path: str = ""
    psm_format: str = "proteome_discoverer"
    output_path: str = "pretrained_encoder"
    mz_min: float = 50.0
    mz_max: float = 1500.0
    top_k_peaks: int = 150
    embed_dim: int = 128
    n_heads: int = 4
    n_layers: int = 2
    ff_dim: int = 256
    epochs: int = 30
    pk_classes_per_batch: int = 64
    pk_samples_per_class: int = 8
    lr: float = 5e-5
    weight_decay: float = 1e-2
    warmup_epochs: int = 5
    temperature: float = 0.10
    lambda_uniform: float = 0.15
    lambda_uniform_warmup_epochs: int = 5
    min_spectra_per_peptide: int = 3
    max_peptides: Optional[int] = None
    fdr_threshold: float = 0.01
    seed: int = 42
    val_split: float = 0.15
    early_stopping_patience: int = 8
    augment: bool = True
    aug_peak_drop_prob: float = 0.15
    aug_intensity_noise: float = 0.08
    aug_mz_jitter: float = 0.01
    quality_filter_enabled: bool = True
    quality_min_peaks: int = 5
    quality_min_mz_range: float = 250.0
    remove_precursor_peaks: bool = True
    precursor_removal_tol_da: float = 1.5

    def replace(self, **changes) -> "PretrainConfig":
        return dataclasses.replace(self, **changes)

    @classmethod
    def command_line(cls, **changes) -> "PretrainConfig":
        return cls(lr=1e-4).replace(**changes)

    @classmethod
    def sample_run(cls, **changes) -> "PretrainConfig":
        return cls(lr=1e-4, warmup_epochs=3).replace(**changes)


def preprocessing_mismatches(cluster: ClusterConfig, pretrain) -> list[str]:
    """Names of preprocessing settings that differ between training and clustering.

    ``pretrain`` is a :class:`PretrainConfig` or a dictionary of settings.  A non-empty list means the encoder would see
    other peaks than it was trained on.
    """
    if isinstance(pretrain, dict):
        known = {f.name for f in dataclasses.fields(PretrainConfig)}
        pretrain = PretrainConfig(**{k: v for k, v in pretrain.items() if k in known})
    shared = ("mz_min", "mz_max", "top_k_peaks", "remove_precursor_peaks",
              "precursor_removal_tol_da", "embed_dim", "n_heads", "n_layers", "ff_dim")
    return [name for name in shared if getattr(cluster, name) != getattr(pretrain, name)]
