"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionweave.checks.fixtures import members, table, view
from ionweave.config import ClusterConfig
from ionweave.functions import mass as M
from ionweave.functions import text as T
from ionweave.operators import classes as C
from ionweave.operators import clusters as K
from ionweave.operators import contrastive as L
from ionweave.operators import graph as G
from ionweave.operators import mass_groups as W
from ionweave.operators import peak_tables as PT
from ionweave.operators import refine as R
from ionweave.operators import rerank as B
from ionweave.operators import similarity as S
from ionweave.operators.density import density_clusters
from ionweave.operators.density_tree import bucketed_hdbscan, hdbscan_blocks, vote_components
from ionweave.operators.encode import encode_projection, encode_tokens, random_parameters, signed_projection
from ionweave.operators.spectral import TASK_LINKS, eigenpair_blocks, pair_errors, scaled_components, spectral_embedding
from ionweave.operators.tiles import nearest
from ionweave.plans.cluster import _complete, component_labels, seeded_labels, stage_two
from ionweave.sources import psm as PSM
from ionweave.sources import sinks
from ionweave.sources.mgf import parse_blocks, split_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

DIM = 64  # vector length of the embeddings table
CODE_BITS = 4
REPEATS = 6
EDGE = 0.35
EPS = 1.14
PROJECTED = 32
EDGE_CFG = ClusterConfig(edge_threshold=EDGE, ann_n_neighbours=20)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- mass groups -------------------------------------------------------------------


def _masses(spark, d):
    return members(spark, d).select("idx", "label", M.neutral_mass("precursor_mz", "precursor_charge").alias("mass"))


@query
def mass_split_ppm(spark, d):
    return W.number_rows(W.anchored_groups(_masses(spark, d), 10.0)).select("idx", "label", "grp")


@query
def mass_split_gap(spark, d):
    return W.number_rows(W.gap_groups(_masses(spark, d), 0.5)).select("idx", "label", "grp")


@query
def event_gap_groups(spark, d):
    rows = table(spark, d, "events").filter(F.col("value").isNotNull()).select(
        F.col("event_id").alias("idx"), F.col("user_id").alias("label"), F.col("value").cast("double").alias("mass"))
    return W.number_rows(W.gap_groups(rows, 1.5)).select("idx", "label", "grp")


@query
def gap_post_split(spark, d):
    rows = view(spark, d, "fx_spectra").select("idx", "label", "precursor_mz")
    return W.gap_post_split(rows, 1.5)


@query
def mass_group_rollup(spark, d):
    """Size, mass range, files, modal charge and mean time per mass group."""
    rows = members(spark, d).withColumn("mass", M.neutral_mass("precursor_mz", "precursor_charge"))
    grouped = W.number_rows(W.anchored_groups(rows, 10.0))
    keys = ["label", "grp"]
    totals = grouped.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.min("mass"), 6).alias("min_mass"), F.round(F.max("mass"), 6).alias("max_mass"),
        F.countDistinct("source_file").alias("n_source_files"), F.round(F.avg("rt"), 3).alias("mean_rt"))
    charge = K.modal_charges(grouped.drop("precursor_charge").withColumnRenamed("alt_charge", "precursor_charge"), keys)
    return totals.join(charge.withColumnRenamed("consensus_precursor_charge", "modal_charge"), keys)


# --- peaks -------------------------------------------------------------------------


@query
def quality_filter(spark, d):
    return PT.quality_filter(view(spark, d, "fx_peaks")).withColumn("mz_range", F.round("mz_range", 6))


@query
def precursor_peak_removal(spark, d):
    kept = PT.remove_precursor_peaks(view(spark, d, "fx_peaks"), view(spark, d, "fx_spectra"))
    return kept.select("idx", F.round("mz", 6).alias("mz"), "intensity")


@query
def topk_peaks(spark, d):
    return PT.strongest_peaks(view(spark, d, "fx_sup_peaks"), 150).select(
        "idx", "rank", F.round("mz", 6).alias("mz"), "intensity")


@query
def peak_tokens(spark, d):
    return PT.peak_tokens(view(spark, d, "fx_sup_peaks"), 150).select(
        "idx", "pos", F.round("norm_mz", 6).alias("norm_mz"), F.round("norm_int", 6).alias("norm_int"))


@query
def bin_spectra(spark, d):
    return PT.bin_spectra(view(spark, d, "fx_sup_peaks"), 150).withColumn("v", F.round("v", 6))


@query
def consensus_spectrum(spark, d):
    m = members(spark, d).select(F.col("label").alias("cluster_id"), "idx", F.lit(1.0).alias("weight"))
    return PT.consensus_peaks(m, view(spark, d, "fx_peaks")).select(
        "cluster_id", "bin", F.round("mz", 5).alias("mz"), F.round("intensity", 4).alias("intensity"))


@query
def precursor_consensus(spark, d):
    rows = members(spark, d).withColumn("weight", F.lit(1.0) + F.col("idx") % 3)
    rows = rows.drop("precursor_charge").withColumnRenamed("alt_charge", "precursor_charge")
    return K.precursor_consensus(rows, ["label"])


def _pairs(spark, d):
    """Neighbouring mass groups with the lightest member of each."""
    _, groups = B.cluster_groups(_masses(spark, d), ClusterConfig())
    return groups


@query
def ptm_adjacent_pairs(spark, d):
    pairs = B.adjacent_pairs(_pairs(spark, d))
    return pairs.select("label", "cluster_a", "cluster_b", F.round("delta", 6).alias("delta"), "ptm_name")


@query
def modification_lookup(spark, d):
    """Mass steps between consecutive groups with the modification they match, if any."""
    groups = _pairs(spark, d).filter("n_groups > 1")
    after = groups.select("label", (F.col("pos") - 1).alias("pos"), F.col("start").alias("next_start"))
    steps = groups.join(after, ["label", "pos"]).select("label", "grp", (F.col("next_start") - F.col("start")).alias("delta"))
    return B.modification_lookup(steps).select("label", "grp", F.round("delta", 6).alias("delta"), "ptm_name")


@query
def fragment_confirm(spark, d):
    """Every spectrum against the next one of its label, with their mass difference."""
    rows = members(spark, d).withColumn("mass", M.neutral_mass("precursor_mz", "precursor_charge"))
    from ionweave.session import ordered_index
    placed = ordered_index(rows.select("label", "idx", "mass"), "label", "idx", name="pos")
    b = placed.select("label", (F.col("pos") - 1).alias("pos"), F.col("idx").alias("idx_b"), F.col("mass").alias("mass_b"))
    pairs = placed.join(b, ["label", "pos"]).select(
        F.col("idx").alias("pair_id"), F.col("idx").alias("idx_a"), "idx_b", F.abs(F.col("mass_b") - F.col("mass")).alias("delta"))
    out = PT.fragment_confirmation(pairs, view(spark, d, "fx_peaks"))
    return out.select("idx_a", "idx_b", "unshifted", "shifted", "confirmed")


# --- vectors -----------------------------------------------------------------------


def _vectors(spark, d):
    return view(spark, d, "fx_vectors")


@query
def embedding_centroid(spark, d):
    c = K.centroids(_vectors(spark, d), ["label"])
    return c.select("label", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query
def within_variance(spark, d):
    return K.centroids(_vectors(spark, d), ["label"]).select("label", "n", F.round("variance", 6).alias("variance"))


@query
def cluster_quality(spark, d):
    return K.cluster_quality(_vectors(spark, d).withColumn("label", F.floor(F.col("idx") / 2)), ["label"])


@query
def member_weights(spark, d):
    v = _vectors(spark, d)
    scored = K.member_similarity(v, K.centroids(v, ["label"]), ["label"])
    from ionweave.functions.scoring import member_weight
    return scored.select("idx", "label", F.round("similarity", 6).alias("similarity"),
                         F.round(member_weight("similarity"), 6).alias("weight"))


@query
def representative(spark, d):
    v = _vectors(spark, d)
    return K.representatives(K.member_similarity(v, K.centroids(v, ["label"]), ["label"]), ["label"])


@query
def knn_cosine(spark, d):
    return nearest(_vectors(spark, d).select("idx", "embedding"), 10)


@query
def knn_cosine_tiled(spark, d):
    """The same in many tile pairs."""
    return nearest(_vectors(spark, d).select("idx", "embedding"), 10, tile_rows=64)


@query
def directed_edges_ppm(spark, d):
    pairs = S.candidate_pairs(_vectors(spark, d), 20, floor=EDGE)
    return S.directed_edges(pairs, EDGE_CFG)


@query
def similarity_edges(spark, d):
    v = _vectors(spark, d)
    return S.similarity_graph(v, EDGE_CFG, v.count())


@query
def similarity_edges_da(spark, d):
    v = _vectors(spark, d)
    return S.similarity_graph(v, EDGE_CFG.replace(precursor_tol_ppm=0.0), v.count()).withColumn("w", F.round("w", 6))


def _edges(spark, d):
    v = _vectors(spark, d)
    return S.similarity_graph(v, EDGE_CFG, v.count())


@query
def node_degree(spark, d):
    return G.degrees(_edges(spark, d)).withColumn("degree", F.round("degree", 10))


@query
def connected_components(spark, d):
    return _components(spark, d)


def _components(spark, d, finish_links=G.FINISH_LINKS):
    """Components of all vectors; one without a link is its own."""
    e = _edges(spark, d)
    found = G.connected_components(e.select(F.col("i").alias("src"), F.col("j").alias("dst")), finish_links)
    ids = _vectors(spark, d).select(F.col("idx").alias("node"))
    return ids.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@query
def connected_components_rounds(spark, d):
    """The same by alternating rounds only."""
    return _components(spark, d, 0)


@query
def component_labels_by_size(spark, d):
    found = component_labels(_edges(spark, d), 3)
    ids = _vectors(spark, d).select("idx")
    full = ids.join(found, "idx", "left").select("idx", F.coalesce("label", F.lit(-1).cast("bigint")).alias("label"))
    return R.dense_labels(full)


@query
def eps_components(spark, d):
    return density_clusters(_vectors(spark, d).select("idx", "embedding"), EPS, 2)


@query
def eps_components_tiled(spark, d):
    """The same in many tile pairs."""
    return density_clusters(_vectors(spark, d).select("idx", "embedding"), EPS, 2, tile_rows=64)


@query
def density_core_border(spark, d):
    return density_clusters(_vectors(spark, d).select("idx", "embedding"), 1.18, 4)


@query
def dynamic_split(spark, d):
    return R.dynamic_split(_vectors(spark, d).select("idx", "label", "embedding"), ClusterConfig(), 1.2, 0.04)


@query
def dynamic_merge(spark, d):
    v = _vectors(spark, d).select("idx", F.floor(F.col("idx") / 3).alias("label"), "embedding")
    return R.dynamic_merge(v, ClusterConfig(merge_dist_threshold=0.62))


@query
def class_separation(spark, d):
    s = L.separation(_vectors(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query
def lsh_codes(spark, d):
    coded = S.hash_codes(_vectors(spark, d).select("idx", "embedding"), CODE_BITS, REPEATS, planes="hashed")
    return S.bucketed_rows(coded.select("idx", "codes")).select("idx", "rep", "code")


@query
def lsh_candidates(spark, d):
    coded = S.hash_codes(_vectors(spark, d), CODE_BITS, REPEATS, planes="hashed")
    return S.candidate_pairs(coded, 5, coded=True).select("i", "j", "cos")


@query
def lsh_candidates_tiled(spark, d):
    """The same in many tile pairs."""
    coded = S.hash_codes(_vectors(spark, d), CODE_BITS, REPEATS, planes="hashed")
    return S.candidate_pairs(coded, 5, coded=True, tile_rows=16).select("i", "j", "cos")


@query
def lsh_similarity_edges(spark, d):
    coded = S.hash_codes(_vectors(spark, d), CODE_BITS, REPEATS, planes="hashed")
    pairs = S.candidate_pairs(coded, 20, coded=True, floor=EDGE)
    return G.symmetric(S.directed_edges(pairs, EDGE_CFG))


@query
def vote_merge(spark, d):
    coded = S.hash_codes(_vectors(spark, d).select("idx", "embedding"), CODE_BITS, REPEATS, planes="hashed")
    parts = S.bucketed_rows(coded.select("idx", "codes")).select("idx", "rep", F.col("code").alias("part"))
    return vote_components(parts, 5)


# --- encoders ----------------------------------------------------------------------


def projected_vectors(spark, d):
    """Unit vectors of all spectra from their own peaks; zero where there are none."""
    bins = PT.bin_spectra(view(spark, d, "fx_peaks"), 150)
    found = signed_projection(bins, PROJECTED)
    zero = F.lit([0.0] * PROJECTED)
    return view(spark, d, "fx_spectra").select("idx").join(found, "idx", "left").select(
        "idx", F.coalesce("embedding", zero).alias("embedding"))


@query
def encode_signed_projection(spark, d):
    return projected_vectors(spark, d).select("idx", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.round("value", 6))


def _spectrum_rows(spark, d):
    """Spectra with peak arrays.  An order has a handful of lines, so a row stays small."""
    peaks = view(spark, d, "fx_peaks").groupBy("idx").agg(
        F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
    return view(spark, d, "fx_spectra").join(peaks, "idx").select(
        "idx", "scan_id", "label", "precursor_mz", "precursor_charge", "rt", "source_file",
        F.transform("p", lambda x: x["mz"].cast("float")).alias("mz"),
        F.transform("p", lambda x: x["intensity"].cast("float")).alias("intensity"))


@query
def encode_random_projection(spark, d):
    out = encode_projection(_spectrum_rows(spark, d), ClusterConfig(embed_dim=PROJECTED), "hashed")
    return out.select("idx", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query
def transformer_encode(spark, d):
    cfg = ClusterConfig(embed_dim=32, ff_dim=64)
    rows = PT.peak_tokens(view(spark, d, "fx_peaks"), 150).groupBy("idx").agg(
        F.sort_array(F.collect_list(F.struct("pos", "norm_mz", "norm_int"))).alias("t"))
    tokens = rows.select("idx", F.transform("t", lambda t: F.struct(t["norm_mz"].alias("norm_mz"), t["norm_int"].alias("norm_int"))).alias("tokens"))
    out = encode_tokens(tokens, cfg, random_parameters(cfg))
    return out.select("idx", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 4))


@query
def augment_peaks(spark, d):
    order = Window.partitionBy("idx").orderBy("mz", "intensity")
    single = lambda c: F.col(c).cast("float").cast("double").alias(c)
    placed = view(spark, d, "fx_peaks").withColumn("i", F.row_number().over(order) - 1).select(
        "idx", "i", single("mz"), single("intensity"))
    out = L.augmented_peaks(placed).join(view(spark, d, "fx_spectra").select("idx"), "idx")
    return out.select("idx", "pos", F.round("mz", 4).alias("mz"), F.round("intensity", 4).alias("intensity"))


@query
def bin_lsh_codes(spark, d):
    bins = PT.bin_spectra(view(spark, d, "fx_peaks"), 150)
    return S.bucketed_rows(S.bin_hash_codes(bins, CODE_BITS, 2)).select("idx", "rep", "code")


# --- hierarchical and spectral clustering ------------------------------------------


@query
def spectral_clusters(spark, d):
    z = spectral_embedding(_edges(spark, d), 30, task_links=TASK_LINKS)
    return _complete(_vectors(spark, d).select("idx"), density_clusters(z, 0.15, 2, ["component"]).select("idx", "label"))


def _eigen_checks(spark, d, dense_nodes):
    """What the edges determine about all eigenpairs of a component.

    ``residual`` is the largest ``|N v - (1 - value) v|``, ``apart`` the largest distance of a Rayleigh quotient, ``lengths`` the
    sum of squared lengths, ``probe`` the squared length of ``sum (p + 1) v_p``, which is ``sum (p + 1)^2`` for vectors at right
    angles.  All values together have the trace and squared trace of the component's matrix.
    """
    scaled, parts = scaled_components(_edges(spark, d))
    blocks = eigenpair_blocks(scaled, parts, dense_nodes)
    mixed = F.aggregate(F.transform("vecs", lambda x, p: (F.col("first") + p + 1) * x), F.lit(0.0), lambda s, x: s + x)
    nodes = blocks.groupBy("component", "idx").agg(
        F.sum(mixed).alias("mixed"), F.sum(F.aggregate("vecs", F.lit(0.0), lambda s, x: s + x * x)).alias("lengths"))
    nodes = nodes.groupBy("component").agg(
        F.count("*").alias("n"), F.sum(F.col("mixed") * F.col("mixed")).alias("probe"), F.sum("lengths").alias("lengths"))
    vals = blocks.groupBy("component", "first").agg(F.first("vals").alias("vals"))
    total = lambda f: F.round(F.sum(F.aggregate("vals", F.lit(0.0), f)), 5)
    totals = vals.groupBy("component").agg(
        total(lambda s, x: s + x).alias("trace"), total(lambda s, x: s + x * x).alias("square_trace"))
    worst = pair_errors(scaled, blocks).groupBy("component").agg(
        F.max("r").alias("r"), F.max("q").alias("q"), F.count("*").alias("pairs"))
    return nodes.join(totals, "component").join(worst, "component").select(
        "component", "n", "pairs", "trace", "square_trace", F.round("lengths", 5).alias("lengths"), F.round("probe", 4).alias("probe"),
        (F.round("q", 5) + 0.0).alias("apart"), (F.round("r", 4) + 0.0).alias("residual"))


@query
def spectral_eigenpairs(spark, d):
    return _eigen_checks(spark, d, 2_000)


@query
def spectral_eigenpairs_iterated(spark, d):
    """The same by distributed iteration for every component of more than four nodes."""
    return _eigen_checks(spark, d, 4)


@query
def hdbscan_refine(spark, d):
    v = _vectors(spark, d)
    return hdbscan_blocks(v.select("label", F.col("idx").alias("vertex"), "embedding"), ["label"])


@query
def hdbscan_refine_distributed(spark, d):
    """The same by tile-pair trees and joins only."""
    v = _vectors(spark, d)
    return hdbscan_blocks(v.select("label", F.col("idx").alias("vertex"), "embedding"), ["label"], block_rows=20, tile_rows=64)


def _condensed(name: str, min_size: int, method: str, both: bool = True) -> None:
    """The routes for one minimum size and selection: one task per block, and tile-pair trees contracted by joins."""

    def blocks(spark, d, **limits):
        v = _vectors(spark, d).select("label", F.col("idx").alias("vertex"), "embedding")
        return hdbscan_blocks(v, ["label"], min_size, method=method, **limits)

    QUERIES[name] = blocks
    if both:
        QUERIES[f"{name}_distributed"] = lambda spark, d: blocks(spark, d, block_rows=20, tile_rows=64)


_condensed("hdbscan_leaf_five", 5, "leaf")
_condensed("hdbscan_mass", 2, "eom", both=False)
_condensed("hdbscan_mass_five", 5, "eom")


@query
def hdbscan_seeded(spark, d):
    return _complete(_vectors(spark, d).select("idx"), seeded_labels(_edges(spark, d), _vectors(spark, d), EDGE_CFG))


@query
def hdbscan_bucketed(spark, d):
    coded = S.hash_codes(_vectors(spark, d).select("idx", "embedding"), CODE_BITS, REPEATS, planes="hashed")
    return bucketed_hdbscan(coded, REPEATS)


@query
def cluster_stage_two(spark, d):
    """All vectors through the dispatcher with components as clusters, without refinement."""
    return stage_two(_vectors(spark, d), EDGE_CFG.replace(method="components", dynamic_split_enabled=False))


@query
def cluster_stage_two_bucketed(spark, d):
    """All vectors through the dispatcher with bucketed clusters; only their number and sizes are comparable."""
    cfg = EDGE_CFG.replace(method="bucketed", hd_target_bucket_size=100)
    return stage_two(_vectors(spark, d), cfg)


# --- reranking and result rows -----------------------------------------------------


def reranked(spark, d):
    spectra = view(spark, d, "fx_spectra")
    return B.rerank(spectra.select("idx", "label"), spectra, projected_vectors(spark, d), view(spark, d, "fx_peaks"))


CLUSTER_OUTPUT = ["cluster_id", "parent_cluster_id", "n_members", "quality_score", "confidence", "within_var",
                  "mean_similarity", "n_source_files", "consensus_precursor_mz", "consensus_precursor_charge",
                  "consensus_rt", "ptm_flag", "ptm_delta_label", "ptm_delta_mass", "heterogeneous_flag"]


@query
def bar_clusters(spark, d):
    return reranked(spark, d).clusters.select(*CLUSTER_OUTPUT)


@query
def run_summary(spark, d):
    s = B.run_summary(reranked(spark, d).clusters, view(spark, d, "fx_spectra"))
    return s.withColumn("avg_size", F.round("avg_size", 6))


@query
def clusters_tsv_rows(spark, d):
    return sinks.cluster_rows(reranked(spark, d), view(spark, d, "fx_spectra")).select(*sinks.CLUSTER_COLUMNS)


@query
def noise_rows(spark, d):
    s = view(spark, d, "fx_spectra")
    return sinks.noise_rows(s.select("idx", "label"), s.drop("label")).select(*sinks.NOISE_COLUMNS)


@query
def mgf_blocks(spark, d):
    return sinks.consensus_blocks(reranked(spark, d)).select("cluster_id", "block")


@query
def mgf_round_trip(spark, d):
    """Consensus blocks read back by the MGF parser."""
    blocks = sinks.consensus_blocks(reranked(spark, d)).select(F.col("block").alias("value"))
    got = parse_blocks(split_records(blocks))
    return got.select(F.col("scans").cast("bigint").alias("cluster_id"), "precursor_mz", "precursor_charge", "rt",
                      F.size("mz").alias("n_peaks"), F.round(F.array_max(F.col("intensity").cast("array<double>")), 1).alias("base_peak"))


@query
def mgf_file_scan(spark, d):
    """All spectra written as MGF text and read back from the files."""
    import uuid
    from ionweave.session import checkpoint_dir
    from ionweave.sources.mgf import read_mgf
    folder = f"{checkpoint_dir(spark)}/mgf-{uuid.uuid4().hex}"
    sinks.spectrum_blocks(_spectrum_rows(spark, d)).select("block").write.text(folder)
    got = read_mgf(spark, f"{folder}/part-*")
    m, i = F.col("mz").cast("array<double>"), F.col("intensity").cast("array<double>")
    return got.select("scan_id", F.round("precursor_mz", 6).alias("precursor_mz"), "precursor_charge", "rt",
                      F.size("mz").alias("n_peaks"), F.round(F.array_min(m), 4).alias("first_mz"),
                      F.round(F.array_max(m), 4).alias("last_mz"), F.round(F.array_max(i), 2).alias("top_intensity"))


@query
def scan_key_dedup(spark, d):
    """Training keys of all spectra; the last spectrum of a key stays."""
    from ionweave.sources.mgf import training_spectra
    key = (F.col("idx") % 4000).cast("string")
    rows = view(spark, d, "fx_spectra").select(
        "idx", "scan_id", F.when(F.col("idx") % 3 == 0, F.concat(key, F.lit("|x"))).alias("scans"),
        F.when(F.col("idx") % 3 == 1, F.concat(F.lit("run NewScan:"), key)).otherwise(F.lit("no number")).alias("title"))
    return training_spectra(rows).select("scan_id", "idx")


@query
def first_spectra(spark, d):
    """The first spectra in reading order after the quality filter."""
    from ionweave.sources.mgf import first_spectra as first
    good = PT.quality_filter(view(spark, d, "fx_peaks")).select("idx")
    rows = view(spark, d, "fx_spectra").join(good, "idx", "left_semi").select("idx", "scan_id")
    return first(rows, 1000)


@query
def label_changes(spark, d):
    v = _vectors(spark, d)
    return R.label_changes(v.select("idx", "label"), density_clusters(v.select("idx", "embedding"), EPS, 2))


# --- peptide matches and classes ---------------------------------------------------


@query
def psm_best_hit(spark, d):
    rows = PSM.below_fdr(view(spark, d, "fx_psm"), "q_value", 0.01)
    return PSM.best_hits(rows, F.col("score"), [F.col("price"), -F.col("line"), -F.col("part")])


@query
def psm_generic(spark, d):
    return PSM.from_generic(view(spark, d, "fx_psm"), 0.01)


@query
def psm_discoverer(spark, d):
    rows = view(spark, d, "fx_psm").select(
        F.col("scan_id").alias("First Scan"), F.col("peptide").alias("Annotated Sequence"),
        F.col("q_value").cast("string").alias("q-Value"), F.lit("High").alias("Confidence"),
        (F.col("score") * 1000000 + F.col("price")).alias("XCorr"))
    return PSM.from_proteome_discoverer(rows, 0.01)


@query
def psm_comet(spark, d):
    rows = view(spark, d, "fx_psm").select(
        F.col("scan_id").alias("scan"), F.concat(F.lit(" "), F.lower("peptide")).alias("plain_peptide"),
        F.when(F.col("line") == 7, F.lit("n/a")).otherwise(F.col("q_value").cast("string")).alias("e-value"))
    return PSM.from_comet(rows, 0.02)


def _keyed_spectra(spark, d):
    return view(spark, d, "fx_spectra").select(F.col("idx").cast("string").alias("scan_id"), "idx", "precursor_charge")


def _good_spectra(spark, d):
    """Spectra that pass the quality filter; matches to the others have no spectrum."""
    good = PT.quality_filter(view(spark, d, "fx_peaks")).select("idx")
    return _keyed_spectra(spark, d).join(good, "idx", "left_semi")


def _best(spark, d):
    rows = PSM.below_fdr(view(spark, d, "fx_psm"), "q_value", 0.05)
    return PSM.best_hits(rows, F.col("score"), [F.col("price"), -F.col("line"), -F.col("part")])


@query
def psm_join(spark, d):
    return C.match_psms(_best(spark, d), _keyed_spectra(spark, d)).select("scan_id", "peptide", "precursor_charge")


@query
def psm_unmatched(spark, d):
    return C.unmatched_psms(_best(spark, d), _good_spectra(spark, d))


@query
def psm_match_counts(spark, d):
    return C.match_counts(_best(spark, d), _good_spectra(spark, d))


def _classes(spark, d):
    return C.build_classes(C.match_psms(_best(spark, d), _keyed_spectra(spark, d)), 3)


@query
def class_build(spark, d):
    return _classes(spark, d)


@query
def class_limit(spark, d):
    return C.build_classes(C.match_psms(_best(spark, d), _keyed_spectra(spark, d)), 3, max_classes=100)


@query
def class_weights(spark, d):
    w = C.class_weights(_classes(spark, d))
    return w.withColumn("weight", F.round("weight", 6))


@query
def val_split(spark, d):
    return C.split_peptides(_classes(spark, d).select("label"), 0.15, 42)


@query
def split_membership(spark, d):
    best = _best(spark, d)
    train, val = C.split_psms(best, C.split_peptides(_classes(spark, d).select("label"), 0.15, 42))
    return train.withColumn("side", F.lit("train")).unionByName(val.withColumn("side", F.lit("val")))


@query
def pk_batch(spark, d):
    samples = _classes(spark, d).select("label_idx", F.col("scan_id").cast("bigint").alias("sample"))
    return C.pk_batches(samples, 8, 4, seed=42, epoch=3)


@query
def supcon_loss(spark, d):
    v = _vectors(spark, d)
    batches = C.pk_batches(v.select(F.col("label").alias("label_idx"), F.col("idx").alias("sample")), 4, 4, seed=42)
    rows = batches.join(v.select(F.col("idx").alias("sample"), "embedding"), "sample")
    out = L.batch_losses(rows)
    return out.select("batch", "n", *[F.round(c, 6).alias(c) for c in ("supcon", "uniform", "loss")])


@query
def scan_from_title(spark, d):
    docs = table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    title = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('controllerScans: "'), i, F.lit('" '), F.col("text")))
             .when(F.col("doc_id") % 4 == 1, F.concat(F.col("text"), F.lit(" newscan:"), i))
             .when(F.col("doc_id") % 4 == 2, F.concat(F.lit(" "), i, F.lit(" "))).otherwise(F.col("text")))
    return docs.select("doc_id", T.scan_from_title(title).alias("scan"))


