"""SQL counterparts of the registered queries, in DuckDB's dialect."""

from __future__ import annotations

from ionweave.checks.fixtures import VIEWS
from ionweave.checks.queries import CODE_BITS, DIM, EDGE, EPS, PROJECTED, REPEATS

PROTON = "cast(1.007276 AS double)"


def D(x) -> str:
    return f"cast({x} AS double)"


def _with(*parts: str, select: str) -> str:
    """A statement from named views and common table expressions."""
    ctes = [f"{p} AS ({VIEWS[p]})" if p in VIEWS else p for p in parts]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


MASS = f"(precursor_mz - {PROTON}) * greatest(precursor_charge, 1)"
MASSES = f"masses AS (SELECT idx, label, {MASS} AS mass FROM fx_spectra WHERE label >= 0)"


def _walk(rows: str, step: str) -> list[str]:
    """Sequential walk over the distinct masses of each label; ``step`` decides a new group."""
    return [
        f"""dmass AS (SELECT label, mass, row_number() OVER (PARTITION BY label ORDER BY mass) AS rn
                      FROM (SELECT DISTINCT label, mass FROM {rows}))""",
        f"""walk AS (SELECT label, rn, mass, mass AS start, 0 AS grp FROM dmass WHERE rn = 1
                     UNION ALL
                     SELECT d.label, d.rn, d.mass,
                            CASE WHEN {step} THEN d.mass ELSE w.start END,
                            CASE WHEN {step} THEN w.grp + 1 ELSE w.grp END
                     FROM walk w JOIN dmass d ON d.label = w.label AND d.rn = w.rn + 1)""",
        f"""grouped AS (SELECT r.idx, r.label, r.mass, w.grp, w.start
                        FROM {rows} r JOIN walk w ON w.label = r.label AND w.mass = r.mass)"""]


PPM_STEP = f"d.mass - w.start > w.start * {D(10)} * {D('1e-6')}"
PPM = ["fx_spectra", MASSES, *_walk("masses", PPM_STEP)]


def _gap(rows: str, gap: float) -> str:
    return f"""grouped AS (
        SELECT idx, label, mass, sum(step) OVER (PARTITION BY label ORDER BY mass, idx ROWS UNBOUNDED PRECEDING) AS grp
        FROM (SELECT *, CASE WHEN mass - lag(mass) OVER (PARTITION BY label ORDER BY mass, idx) > {D(gap)}
                        THEN 1 ELSE 0 END AS step FROM {rows}))"""


SUP_TOP = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY intensity DESC, mz) AS rank
                     FROM {peaks}) WHERE rank <= 150),
scaled AS (SELECT idx, rank, mz, intensity, CASE WHEN m > 0 THEN sqrt(intensity / m) ELSE intensity END AS v
           FROM (SELECT *, max(intensity) OVER (PARTITION BY idx) AS m FROM top))"""
BIN = f"cast(trunc((mz - {D(50)}) / {D(0.02)}) AS int)"
BINS = f"""bins AS (SELECT idx, bin, max(v) AS v FROM (SELECT idx, {BIN} AS bin, v FROM scaled)
                    WHERE bin >= 0 AND bin < 72500 GROUP BY idx, bin)"""


def _consensus(members: str) -> str:
    """Consensus peaks of ``members (cluster_id, idx, weight)``."""
    return f"""
    ctop AS (SELECT idx, max(intensity) AS m FROM fx_peaks GROUP BY idx),
    cbins AS (SELECT c.cluster_id, {BIN} AS bin, c.weight * sqrt(p.intensity / t.m) AS a, p.mz
              FROM {members} c JOIN fx_peaks p ON p.idx = c.idx JOIN ctop t ON t.idx = c.idx WHERE t.m > 0),
    csum AS (SELECT cluster_id, bin, sum(a) AS acc, sum(a * mz) AS acc_mz FROM cbins
             WHERE bin >= 0 AND bin < 72500 GROUP BY cluster_id, bin HAVING sum(a) > 0),
    cons AS (SELECT cluster_id, bin, acc_mz / acc AS mz,
                    acc / max(acc) OVER (PARTITION BY cluster_id) * {D(999)} AS intensity FROM csum),
    consensus AS (SELECT * FROM cons WHERE intensity >= 1)"""


def _modal(rows: str, keys: str) -> str:
    """Most frequent known charge, first seen on a tie."""
    return f"""modal AS (SELECT {keys}, charge FROM (
        SELECT {keys}, charge, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first) AS r
        FROM (SELECT {keys}, charge, count(*) AS n, min(idx) AS first FROM {rows} WHERE charge > 0
              GROUP BY {keys}, charge)) WHERE r = 1)"""


PTM = """CASE WHEN abs(delta - 79.9663::double) <= 0.02::double THEN 'Phosphorylation'
     WHEN abs(delta - 42.0106::double) <= 0.02::double THEN 'Acetylation'
     WHEN abs(delta - 15.9949::double) <= 0.02::double THEN 'Oxidation'
     WHEN abs(delta - 14.0157::double) <= 0.02::double THEN 'Methylation'
     WHEN abs(delta - 0.9840::double) <= 0.02::double THEN 'Deamidation'
     WHEN abs(delta - 57.0215::double) <= 0.02::double THEN 'Carbamidomethyl'
     WHEN abs(delta - 114.0429::double) <= 0.02::double THEN 'Ubiquitination(GG)' END"""

GROUPS = """groups AS (SELECT *, row_number() OVER (ORDER BY label, grp) - 1 AS pos,
        CASE WHEN n_groups = 1 THEN label
             ELSE (SELECT max(label) FROM masses) + row_number() OVER (PARTITION BY n_groups > 1 ORDER BY label, grp)
        END AS cluster_id,
        CASE WHEN n_groups = 1 THEN -1 ELSE label END AS parent
    FROM (SELECT label, grp, min(start) AS start, count(*) AS n_members,
                 count(*) OVER (PARTITION BY label) AS n_groups FROM grouped GROUP BY label, grp))"""
STEPS = f"""steps AS (SELECT *, {PTM} AS ptm_name FROM (
    SELECT a.label, a.grp, a.pos, a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, abs(b.start - a.start) AS delta
    FROM groups a JOIN groups b ON a.label = b.label AND b.grp = a.grp + 1))"""


def _confirm(pairs: str) -> str:
    """Shared and shifted fragments of ``pairs (pair_id, idx_a, idx_b, delta)``."""
    near = "abs(b.mz - ({m})) <= 0.02::double"

    def hit(*ms):
        cond = " OR ".join(near.format(m=m) for m in ms)
        return f"EXISTS (SELECT 1 FROM fx_peaks b WHERE b.idx = q.idx_b AND ({cond}))"
    return f"""confirm AS (SELECT q.pair_id,
        coalesce(sum(CASE WHEN p.mz IS NOT NULL AND {hit('p.mz')} THEN 1 ELSE 0 END), 0) AS unshifted,
        coalesce(sum(CASE WHEN p.mz IS NOT NULL AND {hit('p.mz + q.delta', 'p.mz - q.delta')} THEN 1 ELSE 0 END), 0) AS shifted
      FROM {pairs} q LEFT JOIN fx_peaks p ON p.idx = q.idx_a GROUP BY q.pair_id)"""


# --- projected vectors -------------------------------------------------------------

PROJECT = f"""proj AS (
    SELECT idx, d, sum(CASE WHEN ((cast(bin AS bigint) * 48271 + (d * 69621 + 12345)) * (cast(bin AS bigint) + d + 1)
                                  % 2147483647) // 64 % 2 = 0 THEN v ELSE -v END) AS s
    FROM bins, (SELECT unnest(range({PROJECTED})) AS d) GROUP BY idx, d),
plen AS (SELECT idx, sqrt(sum(s * s)) AS len FROM proj GROUP BY idx),
emb AS (SELECT f.idx, f.d, CASE WHEN coalesce(l.len, 0) = 0 THEN 0 ELSE p.s / l.len END AS x
        FROM (SELECT idx, d FROM fx_spectra, (SELECT unnest(range({PROJECTED})) AS d)) f
        LEFT JOIN proj p ON p.idx = f.idx AND p.d = f.d LEFT JOIN plen l ON l.idx = f.idx)"""
PROJECTED_PARTS = ["fx_spectra", "fx_peaks", SUP_TOP.format(peaks="fx_peaks"), BINS, PROJECT]

BAR = [*PROJECTED_PARTS, MASSES, *_walk("masses", PPM_STEP), GROUPS, STEPS, f"""
mem AS (SELECT g.cluster_id, s.idx, s.precursor_mz, s.precursor_charge AS charge, s.rt, s.source_file
        FROM grouped r JOIN groups g ON g.label = r.label AND g.grp = r.grp JOIN fx_spectra s ON s.idx = r.idx),
mean AS (SELECT m.cluster_id, e.d, sum(e.x) / count(*) AS x FROM mem m JOIN emb e ON e.idx = m.idx GROUP BY m.cluster_id, e.d),
len AS (SELECT cluster_id, sqrt(sum(x * x)) AS len FROM mean GROUP BY cluster_id),
sims AS (SELECT m.cluster_id, m.idx, sum(CASE WHEN l.len = 0 THEN 0 ELSE e.x * c.x / l.len END) AS sim
         FROM mem m JOIN emb e ON e.idx = m.idx JOIN mean c ON c.cluster_id = m.cluster_id AND c.d = e.d
         JOIN len l ON l.cluster_id = m.cluster_id GROUP BY m.cluster_id, m.idx),
wmem AS (SELECT m.*, s.sim, greatest(s.sim, 0.01::double) AS weight
         FROM mem m JOIN sims s ON s.cluster_id = m.cluster_id AND s.idx = m.idx),
reps AS (SELECT cluster_id, idx FROM (SELECT cluster_id, idx,
           row_number() OVER (PARTITION BY cluster_id ORDER BY round(sim, 9) DESC, idx) AS r FROM sims) WHERE r = 1),
ppairs AS (SELECT s.pos AS pair_id, s.label, s.cluster_a, s.cluster_b, s.delta, s.ptm_name, a.idx AS idx_a, b.idx AS idx_b
           FROM steps s JOIN reps a ON a.cluster_id = s.cluster_a JOIN reps b ON b.cluster_id = s.cluster_b
           WHERE s.ptm_name IS NOT NULL)""", _confirm("ppairs"), """
hits AS (SELECT p.* FROM ppairs p JOIN confirm c ON c.pair_id = p.pair_id WHERE c.unshifted >= 2 AND c.shifted >= 1),
flags AS (SELECT cluster_id, ptm_name, delta FROM (
            SELECT cluster_id, ptm_name, delta, row_number() OVER (PARTITION BY cluster_id ORDER BY pair_id DESC) AS r
            FROM (SELECT cluster_a AS cluster_id, pair_id, ptm_name, delta FROM hits
                  UNION ALL SELECT cluster_b, pair_id, ptm_name, delta FROM hits)) WHERE r = 1)""",
       _modal("mem", "cluster_id"), """
agg AS (SELECT cluster_id, count(*) AS n_members, cast(round(cast(sum(weight * precursor_mz) / sum(weight) AS decimal(18, 9)), 6) AS double) AS pmz,
               round(avg(rt), 3) AS rt, count(DISTINCT source_file) AS n_files FROM wmem GROUP BY cluster_id),
clusters AS (
  SELECT g.cluster_id, g.parent AS parent_cluster_id, a.n_members,
         round(l.len * exp(-(1 - l.len) / 0.10::double), 4) AS quality_score,
         CASE WHEN l.len * exp(-(1 - l.len) / 0.10::double) >= 0.80::double THEN 'HIGH'
              WHEN l.len * exp(-(1 - l.len) / 0.10::double) >= 0.50::double THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
         round(1 - l.len, 4) + 0 AS within_var, round(l.len, 4) AS mean_similarity, a.n_files AS n_source_files,
         a.pmz AS consensus_precursor_mz, coalesce(m.charge, 0) AS consensus_precursor_charge, a.rt AS consensus_rt,
         f.cluster_id IS NOT NULL AS ptm_flag, coalesce(f.ptm_name, '') AS ptm_delta_label,
         coalesce(round(f.delta, 4), 0) AS ptm_delta_mass,
         g.parent >= 0 AND g.label NOT IN (SELECT label FROM hits) AS heterogeneous_flag
  FROM groups g JOIN agg a ON a.cluster_id = g.cluster_id JOIN len l ON l.cluster_id = g.cluster_id
  LEFT JOIN modal m ON m.cluster_id = g.cluster_id LEFT JOIN flags f ON f.cluster_id = g.cluster_id)"""]

TITLE = """concat('cluster_', cluster_id, '_n', n_members, '_src', n_source_files, '_Q=', printf('%.4f', quality_score), '_',
    confidence, CASE WHEN ptm_flag AND ptm_delta_label <> '' AND n_members >= 2 THEN concat('_PTM=', ptm_delta_label) ELSE '' END,
    CASE WHEN heterogeneous_flag THEN '_HET=1' ELSE '' END)"""
BLOCKS = [*BAR, _consensus("(SELECT cluster_id, idx, weight FROM wmem)")]

# --- vectors -----------------------------------------------------------------------

XY = "list_inner_product(cast({a}.embedding AS double[]), cast({b}.embedding AS double[]))"
PAIRS = f"""pairs AS (SELECT x.idx AS i, y.idx AS j, round(greatest({XY.format(a='x', b='y')}, 0), 9) AS cos,
       x.precursor_mz AS pi, y.precursor_mz AS pj, x.precursor_charge AS zi, y.precursor_charge AS zj
   FROM fx_vectors x JOIN fx_vectors y ON x.idx <> y.idx)"""


def _near(k: int, rows: str = "pairs") -> str:
    return f"near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cos DESC, j) AS r FROM {rows}) WHERE r <= {k})"


COMPATIBLE = "(zi = zj OR least(zi, zj) <= 0)"
PPM_OK = f"""{COMPATIBLE} AND abs(pi - pj) * greatest(1, zi)
    <= (pi - {PROTON}) * greatest(1, zi) * {D(10)} * {D('1e-6')}"""
DIRECTED = f"directed AS (SELECT i, j, cos AS w FROM near WHERE {PPM_OK} AND cos >= {D(EDGE)})"
DIRECTED_DA = f"""directed AS (SELECT i, j, w FROM (SELECT i, j,
      CASE WHEN {COMPATIBLE} THEN cos * greatest(0, 1 - abs(pi - pj) / 1.5::double) ELSE 0 END AS w
    FROM near WHERE abs(pi - pj) <= 1.5::double) WHERE w >= {D(EDGE)})"""
SYMMETRIC = """edges AS (SELECT i, j, sum(w) / 2 AS w FROM (SELECT i, j, w FROM directed UNION ALL SELECT j, i, w FROM directed)
    GROUP BY i, j)"""
EDGES = ["fx_vectors", PAIRS, _near(20), DIRECTED, SYMMETRIC]
CLOSURE = """reach(node, seen) AS (SELECT DISTINCT i, i FROM edges UNION SELECT r.node, e.j FROM reach r JOIN edges e ON e.i = r.seen),
parts AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""
COORD = """coord AS (SELECT idx, label, precursor_charge, unnest(range(len(embedding))) AS pos,
    cast(unnest(embedding) AS double) AS x FROM fx_vectors)"""
CENTROID = """cmean AS (SELECT label, pos, avg(x) AS x FROM coord GROUP BY label, pos),
clen AS (SELECT label, sqrt(sum(x * x)) AS len FROM cmean GROUP BY label),
cent AS (SELECT c.label, c.pos, CASE WHEN l.len = 0 THEN 0 ELSE c.x / l.len END AS x FROM cmean c JOIN clen l USING (label)),
sims AS (SELECT o.idx, o.label, sum(o.x * c.x) AS sim FROM coord o JOIN cent c ON c.label = o.label AND c.pos = o.pos
         GROUP BY o.idx, o.label)"""


def _dist(a: str, b: str) -> str:
    return f"list_distance(cast({a}.embedding AS double[]), cast({b}.embedding AS double[]))"


def _density(eps: float, min_samples: int, same_label: bool = False) -> list[str]:
    on = "x.label = y.label AND " if same_label else ""
    return ["fx_vectors", f"""within AS (SELECT x.idx AS i, y.idx AS j FROM fx_vectors x JOIN fx_vectors y
              ON {on}{_dist('x', 'y')} <= {D(eps)})""",
            f"cores AS (SELECT i FROM within GROUP BY i HAVING count(*) >= {min_samples})",
            """edges AS (SELECT i, j FROM within WHERE i IN (SELECT i FROM cores) OR j IN (SELECT i FROM cores))""", CLOSURE]


DENSITY_SELECT = "SELECT v.idx, coalesce(p.component, -1) AS label FROM fx_vectors v LEFT JOIN parts p ON p.node = v.idx"

CODES = f"""dims AS (SELECT rep, bit, pos, CASE WHEN ((pos + 1) * 48271 + (bit + 1) * 69621 + (rep + 1) * 40692)
        * (pos + bit * 7 + rep * 13 + 1) % 2147483647 // 64 % 2 = 0 THEN 1 ELSE -1 END AS sign
    FROM (SELECT unnest(range({REPEATS})) AS rep), (SELECT unnest(range({CODE_BITS})) AS bit),
         (SELECT unnest(range({DIM})) AS pos)),
codes AS (SELECT idx, rep, cast(sum(CASE WHEN s > 0 THEN 1 << bit ELSE 0 END) AS bigint) AS code
    FROM (SELECT c.idx, d.rep, d.bit, sum(c.x * d.sign) AS s FROM coord c JOIN dims d ON d.pos = c.pos
          GROUP BY c.idx, d.rep, d.bit) GROUP BY idx, rep)"""


def _bucket_near(k: int) -> list[str]:
    return ["fx_vectors", COORD, CODES, PAIRS, f"""bucketed AS (
        SELECT p.*, a.rep, a.code, row_number() OVER (PARTITION BY a.rep, p.i ORDER BY p.cos DESC, p.j) AS r
        FROM pairs p JOIN codes a ON a.idx = p.i JOIN codes b ON b.idx = p.j AND b.rep = a.rep AND b.code = a.code),
      near AS (SELECT i, j, max(cos) AS cos, any_value(pi) AS pi, any_value(pj) AS pj, any_value(zi) AS zi,
               any_value(zj) AS zj FROM bucketed WHERE r <= {k} GROUP BY i, j)"""]




def _leaves(rows: str) -> list[str]:
    """Leaf clusters of minimum size 2 per block of ``rows (block, vertex, embedding)``.

    An edge belongs to the spanning tree when lower edges do not connect its ends.
    """
    return [f"""ranked AS (SELECT x.block, x.vertex AS a, y.vertex AS b, row_number() OVER (PARTITION BY x.block
              ORDER BY round({_dist('x', 'y')}, 9), x.vertex, y.vertex) AS rk
            FROM {rows} x JOIN {rows} y ON x.block = y.block AND x.vertex < y.vertex)""",
            "adjacent AS (SELECT block, rk, a AS u, b AS v FROM ranked UNION ALL SELECT block, rk, b, a FROM ranked)",
            """lower(block, rk, node) AS (SELECT block, rk, a FROM ranked UNION SELECT r.block, r.rk, j.v
            FROM lower r JOIN adjacent j ON j.block = r.block AND j.u = r.node AND j.rk < r.rk)""",
            """tree AS (SELECT t.block, t.a, t.b, t.rk FROM ranked t
            LEFT JOIN lower r ON r.block = t.block AND r.rk = t.rk AND r.node = t.b WHERE r.node IS NULL)""",
            """ends AS (SELECT block, a AS vertex, rk FROM tree UNION ALL SELECT block, b, rk FROM tree),
        lowest AS (SELECT vertex, min(rk) AS low FROM ends GROUP BY vertex),
        judged AS (SELECT t.*, la.low < t.rk AND lb.low < t.rk AS joins FROM tree t
                   JOIN lowest la ON la.vertex = t.a JOIN lowest lb ON lb.vertex = t.b),
        grown AS (SELECT a AS i, b AS j FROM judged WHERE NOT joins UNION ALL SELECT b, a FROM judged WHERE NOT joins),
        spread(node, seen) AS (SELECT DISTINCT i, i FROM grown UNION SELECT r.node, e.j FROM spread r JOIN grown e ON e.i = r.seen),
        pieces AS (SELECT node, min(seen) AS piece FROM spread GROUP BY node),
        closing AS (SELECT p.piece, min(j.rk) AS closed FROM pieces p JOIN judged j ON j.joins AND (j.a = p.node OR j.b = p.node)
                    GROUP BY p.piece),
        inside AS (SELECT p.node AS vertex, p.piece FROM pieces p JOIN lowest l ON l.vertex = p.node
                   JOIN closing c ON c.piece = p.piece WHERE l.low < c.closed),
        leaves AS (SELECT vertex, min(vertex) OVER (PARTITION BY piece) AS label FROM inside)"""]


def _condensed(rows: str, least: int, method: str) -> list[str]:
    """``found (vertex, label)``: clusters of any minimum size, from the ranks at which rows of a block meet in its tree.

    A cluster is named by the rank it opens at; ``t`` is the rank at which a row's group has ``least`` rows.
    """
    return [*_leaves(rows)[:4], f"""tadj AS (SELECT block, a AS u, b AS v, rk FROM tree UNION ALL SELECT block, b, a, rk FROM tree),
        lam AS (SELECT t.block, t.rk, 1.0::double / greatest(round({_dist('x', 'y')}, 9), 1e-12::double) AS lam
                FROM tree t JOIN {rows} x ON x.vertex = t.a JOIN {rows} y ON y.vertex = t.b),
        walk(block, i, j, prev, top) AS (SELECT block, vertex, vertex, -1::bigint, 0::bigint FROM {rows}
            UNION ALL SELECT w.block, w.i, t.v, w.j, greatest(w.top, t.rk) FROM walk w JOIN tadj t ON t.block = w.block AND t.u = w.j AND t.v <> w.prev),
        meet AS MATERIALIZED (SELECT block, i, j, top FROM walk),
        entry AS MATERIALIZED (SELECT block, i AS v, list_sort(list(top))[{least}] AS t FROM meet GROUP BY block, i HAVING count(*) >= {least}),
        kinds AS (SELECT e.*, ea.t < e.rk AND eb.t < e.rk AS joins, ea.t = e.rk AND eb.t = e.rk AS opens
                  FROM tree e JOIN entry ea ON ea.v = e.a JOIN entry eb ON eb.v = e.b),
        opened AS (SELECT o.block, o.rk, o.a, o.opens AS leaf,
                     (SELECT min(j.rk) FROM kinds j JOIN meet m ON m.i = j.a WHERE j.block = o.block AND j.joins AND j.rk > o.rk AND m.j = o.a AND m.top <= j.rk) AS close
                   FROM kinds o WHERE o.joins OR o.opens),
        clusters AS MATERIALIZED (SELECT o.block, o.rk, any_value(o.leaf) AS leaf, any_value(o.close) AS close,
                     sum(l.lam) - any_value(c.lam) * count(*) AS own, row_number() OVER (PARTITION BY o.block ORDER BY o.rk) AS n
                   FROM opened o JOIN meet m ON m.i = o.a AND (o.close IS NULL OR m.top < o.close) JOIN entry e ON e.v = m.j
                   JOIN lam l ON l.block = o.block AND l.rk = greatest(o.rk, e.t) LEFT JOIN lam c ON c.block = o.block AND c.rk = o.close
                   GROUP BY o.block, o.rk),
        own_of AS (SELECT e.block, e.v, max(o.rk) AS rk FROM entry e JOIN meet m ON m.i = e.v JOIN opened o ON o.a = m.j AND o.rk <= e.t AND m.top <= e.t
                   GROUP BY e.block, e.v)""",
            """kids AS MATERIALIZED (SELECT p.block, p.n, p.rk, p.close, p.own, coalesce((SELECT list(k.rk) FROM clusters k WHERE k.block = p.block AND k.close = p.rk), []) AS below FROM clusters p),
        summed(block, n, worth) AS (SELECT DISTINCT block, 0::bigint, MAP([-1::bigint], [0.0::double]) FROM clusters
            UNION ALL SELECT s.block, k.n, map_concat(s.worth, MAP([k.rk], [CASE WHEN k.close IS NULL THEN 0.0::double
                ELSE greatest(k.own, coalesce(list_sum(list_transform(k.below, lambda x: s.worth[x])), 0.0::double)) END]))
            FROM summed s JOIN kids k ON k.block = s.block AND k.n = s.n + 1),
        final AS (SELECT block, arg_max(worth, n) AS worth FROM summed GROUP BY block),
        kept AS (SELECT k.block, k.rk FROM (SELECT k.*, coalesce(list_sum(list_transform(k.below, lambda x: f.worth[x])), 0.0::double) AS sum FROM kids k JOIN final f USING (block)) k
                 WHERE k.close IS NOT NULL AND k.own >= k.sum - 1e-9::double * greatest(abs(k.own), abs(k.sum))),
        above(block, rk, up) AS (SELECT block, rk, rk FROM clusters UNION ALL SELECT a.block, a.rk, c.close FROM above a JOIN clusters c ON c.block = a.block AND c.rk = a.up WHERE c.close IS NOT NULL),
        picked AS (SELECT a.block, a.rk, max(a.up) AS up FROM above a JOIN kept k ON k.block = a.block AND k.rk = a.up GROUP BY a.block, a.rk)"""
            if method == "eom" else "picked AS (SELECT block, rk, rk AS up FROM clusters WHERE leaf AND close IS NOT NULL)",
            "found AS (SELECT o.v AS vertex, min(o.v) OVER (PARTITION BY o.block, p.up) AS label FROM own_of o JOIN picked p ON p.block = o.block AND p.rk = o.rk)"]


# --- classes -----------------------------------------------------------------------

BEST = """best AS (SELECT scan_id, peptide FROM (SELECT *, row_number() OVER (PARTITION BY scan_id
    ORDER BY score DESC, price DESC, line, part) AS r FROM fx_psm WHERE q_value <= {fdr}::double) WHERE r = 1)"""
KEYED = """keyed AS (SELECT cast(idx AS varchar) AS scan_id, idx, precursor_charge FROM fx_spectra)"""
GOOD = """good AS (SELECT cast(idx AS varchar) AS scan_id FROM fx_peaks GROUP BY idx HAVING count(*) >= 5 AND max(mz) - min(mz) >= 250)"""
MATCHED = ["fx_psm", "fx_spectra", BEST.format(fdr="0.05"), KEYED, """matched AS (
    SELECT b.scan_id, concat(b.peptide, '|z', k.precursor_charge) AS label FROM best b JOIN keyed k USING (scan_id))""",
           "sizes AS (SELECT label, count(*) AS class_size FROM matched GROUP BY label HAVING count(*) >= 3)"]
CLASSES = [*MATCHED, "numbered AS (SELECT *, row_number() OVER (ORDER BY label) - 1 AS label_idx FROM sizes)",
           "classes AS (SELECT m.scan_id, m.label, n.label_idx, n.class_size FROM matched m JOIN numbered n USING (label))"]
SPLIT = """peptides AS (SELECT DISTINCT regexp_replace(label, '\\|z[^|]*$', '') AS peptide FROM classes),
split AS (SELECT peptide, row_number() OVER (ORDER BY md5(concat('42:', peptide)), peptide)
      <= greatest(1, cast(floor(0.15::double * (SELECT count(*) FROM peptides)) AS bigint)) AS is_val FROM peptides)"""


def _mix(*parts: str) -> str:
    h = "cast(17 AS bigint)"
    for p in parts:
        h = f"(({h}) * 48271 + cast({p} AS bigint) * 69621 + 11) % 2147483647"
        h = f"(({h}) * ((({h}) % 65537) + 3)) % 2147483647"
    return f"({h})"


def _pk(samples: str, classes_per_batch: int, k: int, seed: int, epoch: int) -> list[str]:
    return [f"""placed AS (SELECT label_idx, sample, row_number() OVER (ORDER BY label_idx, {_mix(str(seed), str(epoch), 'sample')}, sample) - 1
                 AS place FROM {samples})""",
            "spans AS (SELECT label_idx, min(place) AS head, count(*) AS size FROM placed GROUP BY label_idx)",
            f"""totals AS (SELECT *, greatest(1, n // (p * {k})) AS n_batches, greatest(1, n_classes // p) AS per_round FROM (
                 SELECT count(*) AS n_classes, sum(size)::bigint AS n, least({classes_per_batch}, count(*)) AS p FROM spans))""",
            f"""rounds AS (SELECT label_idx, head, size, r, row_number() OVER (PARTITION BY r
                   ORDER BY {_mix(str(seed + 1), str(epoch), 'r', 'label_idx')}, label_idx) - 1 AS pos
                 FROM spans, (SELECT unnest(range((n_batches - 1) // per_round + 1)) AS r FROM totals))""",
            """slots AS (SELECT label_idx, head, size, r, r * per_round + pos // p AS batch, pos % p AS slot FROM rounds, totals
                 WHERE pos < per_round * p AND r * per_round + pos // p < n_batches)""",
            f"""draws AS (SELECT batch, slot, draw, head + (r * {k} + draw) % size AS place
                 FROM slots, (SELECT unnest(range({k})) AS draw))""",
            "batches AS (SELECT batch, slot, draw, label_idx, sample FROM draws JOIN placed USING (place))"]


# --- hashed signs ------------------------------------------------------------------

FLOAT_PEAKS = """(SELECT idx, cast(cast(mz AS float) AS double) AS mz, cast(cast(intensity AS float) AS double) AS intensity FROM fx_peaks)"""
BIN_CODES = """signs AS (SELECT idx, r, b, sum(CASE WHEN ((cast(bin AS bigint) + 1) * 48271 + ((b + 1) * 69621 + (r + 43) * 40692))
        * (cast(bin AS bigint) + b * 7 + (r + 42) * 13 + 1) % 2147483647 // 64 % 2 = 0 THEN v ELSE -v END) AS s
    FROM bins, (SELECT unnest(range(2)) AS r), (SELECT unnest(range(4)) AS b) GROUP BY idx, r, b)"""

COMPONENTS_SELECT = """SELECT v.idx AS node, coalesce(p.component, v.idx) AS component
    FROM fx_vectors v LEFT JOIN parts p ON p.node = v.idx"""

ORACLE: dict[str, str] = {
    "mass_split_ppm": _with(*PPM, select="SELECT idx, label, cast(grp AS bigint) AS grp FROM grouped"),
    "mass_split_gap": _with("fx_spectra", MASSES, _gap("masses", 0.5),
                            select="SELECT idx, label, cast(grp AS bigint) AS grp FROM grouped"),
    "event_gap_groups": _with(
        "rows AS (SELECT event_id AS idx, user_id AS label, cast(value AS double) AS mass FROM events WHERE value IS NOT NULL)",
        _gap("rows", 1.5), select="SELECT idx, label, cast(grp AS bigint) AS grp FROM grouped"),
    "gap_post_split": _with(
        "fx_spectra", "rows AS (SELECT idx, label, precursor_mz AS mass FROM fx_spectra WHERE label >= 0)", _gap("rows", 1.5),
        """ids AS (SELECT label, grp, CASE WHEN grp = 0 THEN label ELSE (SELECT max(label) FROM fx_spectra)
                     + row_number() OVER (PARTITION BY grp > 0 ORDER BY label, grp) END AS new_label
             FROM (SELECT DISTINCT label, grp FROM grouped))""",
        select="""SELECT g.idx, cast(i.new_label AS bigint) AS label FROM grouped g JOIN ids i ON i.label = g.label AND i.grp = g.grp
                  UNION ALL SELECT idx, label FROM fx_spectra WHERE label < 0"""),
    "mass_group_rollup": _with(
        *PPM, "rows AS (SELECT g.label, g.grp, g.mass, s.* EXCLUDE (label), s.alt_charge AS charge FROM grouped g JOIN fx_spectra s ON s.idx = g.idx)",
        _modal("rows", "label, grp"),
        select="""SELECT r.label, cast(r.grp AS bigint) AS grp, count(*) AS n, round(min(r.mass), 6) AS min_mass, round(max(r.mass), 6) AS max_mass,
                    count(DISTINCT r.source_file) AS n_source_files, round(avg(r.rt), 3) AS mean_rt,
                    coalesce(any_value(m.charge), 0) AS modal_charge
                  FROM rows r LEFT JOIN modal m ON m.label = r.label AND m.grp = r.grp GROUP BY r.label, r.grp"""),
    "quality_filter": _with("fx_peaks", select="""SELECT idx, count(*) AS n_peaks, round(max(mz) - min(mz), 6) AS mz_range
        FROM fx_peaks GROUP BY idx HAVING count(*) >= 5 AND max(mz) - min(mz) >= 250"""),
    "precursor_peak_removal": _with("fx_peaks", "fx_spectra", select=f"""
        SELECT p.idx, round(p.mz, 6) AS mz, p.intensity FROM fx_peaks p JOIN fx_spectra s ON s.idx = p.idx
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(1, 10)) AS z) WHERE z <= s.precursor_charge
          AND abs(p.mz - ((s.precursor_mz * s.precursor_charge - {PROTON} * s.precursor_charge) / z + {PROTON})) <= {D(1.5)})"""),
    "topk_peaks": _with("fx_sup_peaks", SUP_TOP.format(peaks="fx_sup_peaks"),
                        select="SELECT idx, cast(rank AS int) AS rank, round(mz, 6) AS mz, intensity FROM top"),
    "peak_tokens": _with("fx_sup_peaks", SUP_TOP.format(peaks="fx_sup_peaks"), select=f"""
        SELECT idx, cast(row_number() OVER (PARTITION BY idx ORDER BY mz, rank) - 1 AS int) AS pos,
          round(least(greatest((mz - {D(50)}) / {D(1450)}, 0), 1), 6) AS norm_mz, round(v, 6) AS norm_int FROM scaled"""),
    "bin_spectra": _with("fx_sup_peaks", SUP_TOP.format(peaks="fx_sup_peaks"), BINS,
                         select="SELECT idx, bin, round(v, 6) AS v FROM bins"),
    "consensus_spectrum": _with(
        "fx_spectra", "fx_peaks", _consensus(f"(SELECT label AS cluster_id, idx, {D(1)} AS weight FROM fx_spectra WHERE label >= 0)"),
        select="SELECT cluster_id, bin, round(mz, 5) AS mz, round(intensity, 4) AS intensity FROM consensus"),
    "precursor_consensus": _with(
        "fx_spectra", f"rows AS (SELECT *, alt_charge AS charge, {D(1)} + idx % 3 AS weight FROM fx_spectra WHERE label >= 0)",
        _modal("rows", "label"), select="""SELECT r.label, count(*) AS n_members,
          cast(round(cast(sum(weight * precursor_mz) / sum(weight) AS decimal(18, 9)), 6) AS double) AS consensus_precursor_mz, round(avg(rt), 3) AS consensus_rt,
          count(DISTINCT source_file) AS n_source_files, coalesce(any_value(m.charge), 0) AS consensus_precursor_charge
        FROM rows r LEFT JOIN modal m ON m.label = r.label GROUP BY r.label"""),
    "ptm_adjacent_pairs": _with(*PPM, GROUPS, STEPS, select="""
        SELECT label, cast(cluster_a AS bigint) AS cluster_a, cast(cluster_b AS bigint) AS cluster_b, round(delta, 6) AS delta, ptm_name
        FROM steps WHERE ptm_name IS NOT NULL"""),
    "modification_lookup": _with(*PPM, GROUPS, STEPS,
                                 select="SELECT label, cast(grp AS bigint) AS grp, round(delta, 6) AS delta, ptm_name FROM steps"),
    "fragment_confirm": _with(
        "fx_spectra", "fx_peaks", MASSES, """pairs AS (SELECT idx AS pair_id, idx AS idx_a, idx_b, abs(mass_b - mass) AS delta FROM (
            SELECT idx, mass, lead(idx) OVER w AS idx_b, lead(mass) OVER w AS mass_b FROM masses
            WINDOW w AS (PARTITION BY label ORDER BY idx)) WHERE idx_b IS NOT NULL)""", _confirm("pairs"),
        select="""SELECT p.idx_a, p.idx_b, cast(c.unshifted AS bigint) AS unshifted, cast(c.shifted AS bigint) AS shifted,
            c.unshifted >= 2 AND c.shifted >= 1 AS confirmed FROM pairs p JOIN confirm c ON c.pair_id = p.pair_id"""),
    "embedding_centroid": _with("fx_vectors", COORD, CENTROID,
                                select="SELECT label, cast(pos AS int) AS pos, round(x, 6) AS value FROM cent"),
    "within_variance": _with("fx_vectors", COORD, CENTROID, select="""
        SELECT label, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE 1 - avg(sim) END, 6) AS variance
        FROM sims GROUP BY label"""),
    "cluster_quality": _with("fx_vectors", COORD.replace("SELECT idx, label,", "SELECT idx, idx // 2 AS label,"), CENTROID, select="""
        SELECT label, n, round(s, 4) AS mean_similarity, round(1 - s, 4) AS within_var,
          round(s * exp(-(1 - s) / 0.10::double), 4) AS quality_score,
          CASE WHEN s * exp(-(1 - s) / 0.10::double) >= 0.80::double THEN 'HIGH'
               WHEN s * exp(-(1 - s) / 0.10::double) >= 0.50::double THEN 'MEDIUM' ELSE 'LOW' END AS confidence
        FROM (SELECT label, count(*) AS n, avg(sim) AS s FROM sims GROUP BY label)"""),
    "member_weights": _with("fx_vectors", COORD, CENTROID, select="""
        SELECT idx, label, round(sim, 6) AS similarity, round(greatest(sim, 0.01::double), 6) AS weight FROM sims"""),
    "representative": _with("fx_vectors", COORD, CENTROID, select="""
        SELECT label, idx AS rep_idx FROM (SELECT label, idx, row_number() OVER (PARTITION BY label
          ORDER BY round(sim, 9) DESC, idx) AS r FROM sims) WHERE r = 1"""),
    "knn_cosine": _with("fx_vectors", PAIRS, _near(10), select="SELECT i, j, cos FROM near"),
    "knn_cosine_tiled": _with("fx_vectors", PAIRS, _near(10), select="SELECT i, j, cos FROM near"),
    "directed_edges_ppm": _with("fx_vectors", PAIRS, _near(20), DIRECTED, select="SELECT i, j, w FROM directed"),
    "similarity_edges": _with(*EDGES, select="SELECT i, j, w FROM edges"),
    "similarity_edges_da": _with("fx_vectors", PAIRS, _near(20), DIRECTED_DA, SYMMETRIC,
                                 select="SELECT i, j, round(w, 6) AS w FROM edges"),
    "node_degree": _with(*EDGES, select="SELECT i, round(sum(w), 10) AS degree FROM edges GROUP BY i"),
    "connected_components": _with(*EDGES, CLOSURE, select=COMPONENTS_SELECT),
    "connected_components_rounds": _with(*EDGES, CLOSURE, select=COMPONENTS_SELECT),
    "component_labels_by_size": _with(
        *EDGES, CLOSURE, """kept AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS number
            FROM parts GROUP BY component HAVING count(*) >= 3)""",
        select="""SELECT v.idx, cast(coalesce(k.number, -1) AS bigint) AS label FROM fx_vectors v
            LEFT JOIN parts p ON p.node = v.idx LEFT JOIN kept k ON k.component = p.component"""),
    "eps_components": _with(*_density(EPS, 2), select=DENSITY_SELECT),
    "eps_components_tiled": _with(*_density(EPS, 2), select=DENSITY_SELECT),
    "density_core_border": _with(*_density(1.18, 4), select=DENSITY_SELECT),
    "dynamic_split": _with(
        *_density(1.2, 2, True), COORD, CENTROID,
        """loose AS (SELECT label FROM sims GROUP BY label HAVING count(*) >= 4 AND 1 - avg(sim) > 0.04::double)""",
        select="""SELECT v.idx, CASE WHEN v.label IN (SELECT label FROM loose) THEN coalesce(p.component, -1) ELSE v.label END AS label
            FROM fx_vectors v LEFT JOIN parts p ON p.node = v.idx"""),
    "dynamic_merge": _with(
        "fx_vectors", COORD.replace("SELECT idx, label,", "SELECT idx, idx // 3 AS label,"), CENTROID,
        """edges AS (SELECT a.label AS i, b.label AS j FROM cent a JOIN cent b ON a.pos = b.pos AND a.label <> b.label
            GROUP BY a.label, b.label HAVING 1 - sum(a.x * b.x) < 0.62::double)""", CLOSURE,
        select="""SELECT v.idx, coalesce(p.component, v.idx // 3) AS label FROM fx_vectors v
            LEFT JOIN parts p ON p.node = v.idx // 3"""),
    "hdbscan_refine": _with(
        "fx_vectors", "hrows AS (SELECT label AS block, idx AS vertex, embedding FROM fx_vectors)", *_leaves("hrows"),
        select="SELECT h.vertex, coalesce(l.label, -1) AS label FROM hrows h LEFT JOIN leaves l ON l.vertex = h.vertex"),
    "cluster_stage_two": _with(
        *EDGES, CLOSURE, """kept AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS number
            FROM parts GROUP BY component HAVING count(*) >= 2)""",
        select="""SELECT v.idx, cast(coalesce(k.number, -1) AS bigint) AS label FROM fx_vectors v
            LEFT JOIN parts p ON p.node = v.idx LEFT JOIN kept k ON k.component = p.component"""),
    "hdbscan_seeded": _with(
        *EDGES, CLOSURE, "sized AS (SELECT node, component, count(*) OVER (PARTITION BY component) AS n FROM parts)",
        """hrows AS (SELECT s.component AS block, v.idx AS vertex, v.embedding FROM sized s JOIN fx_vectors v ON v.idx = s.node
             WHERE s.n > 6)""", *_leaves("hrows"),
        """found AS (SELECT node AS idx, component AS label FROM sized WHERE n BETWEEN 2 AND 6
            UNION ALL SELECT vertex, label FROM leaves)""",
        select="SELECT v.idx, coalesce(f.label, -1) AS label FROM fx_vectors v LEFT JOIN found f ON f.idx = v.idx"),
    "hdbscan_bucketed": _with(
        "fx_vectors", COORD, CODES, f"""hrows AS (SELECT c.rep * 1000 + c.code AS block, v.idx * {REPEATS} + c.rep AS vertex, v.embedding
             FROM codes c JOIN fx_vectors v ON v.idx = c.idx)""", *_leaves("hrows"),
        f"voting AS (SELECT vertex // {REPEATS} AS idx, vertex % {REPEATS} AS rep, label FROM leaves)",
        """edges AS (SELECT a.idx AS i, b.idx AS j FROM voting a JOIN voting b ON a.label = b.label AND a.idx <> b.idx
             GROUP BY a.idx, b.idx HAVING count(*) >= 2)""", CLOSURE,
        select="SELECT v.idx, coalesce(p.component, -1) AS label FROM fx_vectors v LEFT JOIN parts p ON p.node = v.idx"),
    # with more components than eigenvectors the spectral clusters are the components
    "spectral_clusters": _with(*EDGES, CLOSURE, select="""SELECT v.idx, coalesce(p.component, -1) AS label
        FROM fx_vectors v LEFT JOIN parts p ON p.node = v.idx"""),
    "class_separation": _with(
        "fx_vectors", f"""sim AS (SELECT x.label AS a, y.label AS b, {XY.format(a='x', b='y')} AS s
            FROM fx_vectors x JOIN fx_vectors y ON x.idx < y.idx)""",
        """parts AS (SELECT (SELECT avg(m) FROM (SELECT avg(s) AS m FROM sim WHERE a = b GROUP BY a)) AS intra,
                     (SELECT avg(s) FROM sim WHERE a <> b) AS inter)""",
        select="SELECT round(intra, 6) AS intra, round(inter, 6) AS inter, round(intra - inter, 6) AS separation FROM parts"),
    "lsh_codes": _with("fx_vectors", COORD, CODES, select="SELECT idx, cast(rep AS int) AS rep, code FROM codes"),
    "lsh_candidates": _with(*_bucket_near(5), select="SELECT i, j, cos FROM near"),
    "lsh_candidates_tiled": _with(*_bucket_near(5), select="SELECT i, j, cos FROM near"),
    "lsh_similarity_edges": _with(*_bucket_near(20), DIRECTED, SYMMETRIC, select="SELECT i, j, w FROM edges"),
    "vote_merge": _with(
        "fx_vectors", COORD, CODES,
        """edges AS (SELECT a.idx AS i, b.idx AS j FROM codes a JOIN codes b ON a.rep = b.rep AND a.code = b.code
            AND a.idx <> b.idx GROUP BY a.idx, b.idx HAVING count(*) >= 5)""", CLOSURE,
        select="SELECT node, component FROM parts"),
    "encode_signed_projection": _with(*PROJECTED_PARTS, select="SELECT idx, cast(d AS int) AS pos, round(x, 6) AS value FROM emb"),
    "bar_clusters": _with(*BAR, select="SELECT * REPLACE (cast(cluster_id AS bigint) AS cluster_id) FROM clusters"),
    "run_summary": _with(*BAR, select="""SELECT (SELECT count(*) FROM fx_spectra) AS n_total,
        (SELECT count(*) FROM fx_spectra WHERE label < 0) AS n_noise, count(*) AS n_clusters,
        cast(count_if(confidence = 'HIGH') AS bigint) AS n_high, cast(count_if(confidence = 'MEDIUM') AS bigint) AS n_medium, cast(count_if(confidence = 'LOW') AS bigint) AS n_low,
        cast(count_if(ptm_flag AND n_members >= 2) AS bigint) AS n_ptm, cast(count_if(heterogeneous_flag) AS bigint) AS n_heterogeneous,
        cast(count_if(parent_cluster_id >= 0) AS bigint) AS n_split, cast(count_if(n_source_files > 1) AS bigint) AS n_cross_file,
        round(avg(n_members), 6) AS avg_size, max(n_members) AS max_size FROM clusters"""),
    "clusters_tsv_rows": _with(*BAR, select="""SELECT cast(c.cluster_id AS bigint) AS cluster_id, c.parent_cluster_id, s.scan_id, s.source_file,
        printf('%.4f', cast(cast(s.precursor_mz AS decimal(18, 8)) AS decimal(18, 4))) AS precursor_mz, s.precursor_charge,
        cast(c.quality_score AS varchar) AS quality_score, c.confidence, CASE WHEN c.ptm_flag THEN 'True' ELSE 'False' END AS ptm_flag,
        c.ptm_delta_label, printf('%.4f', c.ptm_delta_mass) AS ptm_delta_mass,
        CASE WHEN c.heterogeneous_flag THEN 'True' ELSE 'False' END AS heterogeneous_flag, c.n_source_files,
        printf('%.4f', c.within_var) AS within_var, printf('%.4f', c.mean_similarity) AS mean_similarity
        FROM clusters c JOIN mem m ON m.cluster_id = c.cluster_id JOIN fx_spectra s ON s.idx = m.idx"""),
    "noise_rows": _with("fx_spectra", select="""SELECT scan_id, source_file,
        printf('%.4f', cast(cast(precursor_mz AS decimal(18, 8)) AS decimal(18, 4))) AS precursor_mz, precursor_charge
        FROM fx_spectra WHERE label = -1"""),
    "mgf_blocks": _with(*BLOCKS, f"""lines AS (SELECT cluster_id, string_agg(printf('%.4f %.1f', mz, intensity), chr(10) ORDER BY bin) AS peaks
            FROM consensus GROUP BY cluster_id)""", select=f"""
        SELECT cast(c.cluster_id AS bigint) AS cluster_id, concat('BEGIN IONS', chr(10), 'TITLE=', {TITLE.replace('cluster_id', 'c.cluster_id')}, chr(10),
          'SCANS=', c.cluster_id, chr(10), CASE WHEN consensus_rt > 0 THEN concat('RTINSECONDS=', printf('%.3f', consensus_rt), chr(10)) ELSE '' END,
          'PEPMASS=', printf('%.6f', consensus_precursor_mz), chr(10),
          CASE WHEN consensus_precursor_charge > 0 THEN concat('CHARGE=', consensus_precursor_charge, '+', chr(10)) ELSE '' END,
          l.peaks, chr(10), 'END IONS') AS block
        FROM clusters c JOIN lines l ON l.cluster_id = c.cluster_id WHERE confidence IN ('HIGH', 'MEDIUM')"""),
    "mgf_round_trip": _with(*BLOCKS, select="""SELECT cast(c.cluster_id AS bigint) AS cluster_id, any_value(c.consensus_precursor_mz) AS precursor_mz,
          any_value(c.consensus_precursor_charge) AS precursor_charge, any_value(c.consensus_rt) AS rt,
          cast(count(*) AS int) AS n_peaks, round(max(k.intensity), 1) AS base_peak
        FROM clusters c JOIN consensus k ON k.cluster_id = c.cluster_id WHERE c.confidence IN ('HIGH', 'MEDIUM') GROUP BY c.cluster_id"""),
    "mgf_file_scan": _with("fx_spectra", "fx_peaks", select="""
        SELECT s.scan_id, round(any_value(s.precursor_mz), 6) AS precursor_mz, any_value(s.precursor_charge) AS precursor_charge,
          any_value(s.rt) AS rt, cast(count(*) AS int) AS n_peaks, round(min(cast(cast(p.mz AS float) AS double)), 4) AS first_mz,
          round(max(cast(cast(p.mz AS float) AS double)), 4) AS last_mz,
          round(max(cast(cast(p.intensity AS float) AS double)), 2) AS top_intensity
        FROM fx_spectra s JOIN fx_peaks p ON p.idx = s.idx GROUP BY s.scan_id"""),
    "scan_key_dedup": _with("fx_spectra", select="""
        SELECT scan_id, max(idx) AS idx FROM (SELECT idx, cast(idx % 4000 AS varchar) AS scan_id FROM fx_spectra WHERE idx % 3 < 2)
        GROUP BY scan_id"""),
    "first_spectra": _with("fx_spectra", "fx_peaks", select="""
        SELECT idx, scan_id FROM fx_spectra WHERE idx IN (SELECT idx FROM fx_peaks GROUP BY idx
          HAVING count(*) >= 5 AND max(mz) - min(mz) >= 250) ORDER BY idx LIMIT 1000"""),
    "label_changes": _with(*_density(EPS, 2), f"after AS ({DENSITY_SELECT})", select="""
        SELECT (SELECT count(DISTINCT label) FROM fx_vectors WHERE label >= 0) AS clusters_before,
          (SELECT count(*) FROM fx_vectors WHERE label < 0) AS noise_before,
          (SELECT count(DISTINCT label) FROM after WHERE label >= 0) AS clusters_after,
          (SELECT count(*) FROM after WHERE label < 0) AS noise_after"""),
    "psm_best_hit": _with("fx_psm", BEST.format(fdr="0.01"), select="SELECT scan_id, peptide FROM best"),
    "psm_generic": _with("fx_psm", select="SELECT DISTINCT scan_id, peptide FROM fx_psm WHERE q_value <= 0.01::double"),
    "psm_discoverer": _with("fx_psm", select="""SELECT scan_id, peptide FROM (SELECT scan_id, peptide, row_number() OVER (
        PARTITION BY scan_id ORDER BY score * 1000000 + price DESC, peptide DESC) AS r FROM fx_psm WHERE q_value <= 0.01::double) WHERE r = 1"""),
    "psm_comet": _with("fx_psm", select="SELECT DISTINCT scan_id, peptide FROM fx_psm WHERE q_value <= 0.02::double AND line <> 7"),
    "psm_join": _with("fx_psm", "fx_spectra", BEST.format(fdr="0.05"), KEYED, select="""
        SELECT scan_id, peptide, precursor_charge FROM best JOIN keyed USING (scan_id)"""),
    "psm_unmatched": _with("fx_psm", "fx_peaks", BEST.format(fdr="0.05"), GOOD,
                           select="SELECT scan_id, peptide FROM best WHERE scan_id NOT IN (SELECT scan_id FROM good)"),
    "psm_match_counts": _with("fx_psm", "fx_peaks", BEST.format(fdr="0.05"), GOOD, select="""
        SELECT *, unmatched > matched AS mostly_unmatched FROM (
          SELECT count(k.scan_id) AS matched, count(*) - count(k.scan_id) AS unmatched FROM best b LEFT JOIN good k USING (scan_id))"""),
    "class_build": _with(*CLASSES, select="SELECT scan_id, label, label_idx, class_size FROM classes"),
    "class_limit": _with(
        *MATCHED, """picked AS (SELECT label, class_size, row_number() OVER (ORDER BY label) - 1 AS label_idx FROM (
            SELECT *, row_number() OVER (ORDER BY md5(concat('42:', label)), label) AS r FROM sizes) WHERE r <= 100)""",
        select="SELECT m.scan_id, m.label, p.label_idx, p.class_size FROM matched m JOIN picked p USING (label)"),
    "class_weights": _with(*CLASSES, select="SELECT scan_id, label, round(1 / class_size, 6) AS weight FROM classes"),
    "val_split": _with(*CLASSES, SPLIT, select="SELECT peptide, is_val FROM split"),
    "split_membership": _with(*CLASSES, SPLIT, select="""SELECT b.peptide, b.scan_id, CASE WHEN s.is_val THEN 'val' ELSE 'train' END AS side
        FROM best b JOIN split s USING (peptide)"""),
    "pk_batch": _with(*CLASSES, *_pk("(SELECT label_idx, cast(scan_id AS bigint) AS sample FROM classes)", 8, 4, 42, 3),
                      select="""SELECT cast(batch AS bigint) AS batch, cast(slot AS int) AS slot, cast(draw AS int) AS draw,
                        label_idx, sample FROM batches"""),
    "supcon_loss": _with(
        "fx_vectors", *_pk("(SELECT label AS label_idx, idx AS sample FROM fx_vectors)", 4, 4, 42, 0),
        """items AS (SELECT b.batch, b.slot * 4 + b.draw AS item, b.label_idx AS label, v.embedding
             FROM batches b JOIN fx_vectors v ON v.idx = b.sample)""",
        f"""sim AS (SELECT x.batch, x.item AS i, y.item AS j, x.label = y.label AS same, {XY.format(a='x', b='y')} AS c
             FROM items x JOIN items y ON x.batch = y.batch AND x.item <> y.item)""",
        """denom AS (SELECT batch, i, ln(sum(exp(c / 0.10::double))) AS lse FROM sim GROUP BY batch, i)""",
        """anchors AS (SELECT s.batch, s.i, avg(s.c / 0.10::double - d.lse) AS m FROM sim s JOIN denom d ON d.batch = s.batch AND d.i = s.i
             WHERE s.same GROUP BY s.batch, s.i)""",
        """terms AS (SELECT batch, -avg(m) AS supcon FROM anchors GROUP BY batch)""",
        """spread AS (SELECT batch, ln(avg(exp(-2 * (2 - 2 * c))) + 1e-8::double) AS uniform FROM sim WHERE NOT same GROUP BY batch)""",
        select="""SELECT cast(t.batch AS bigint) AS batch, cast(16 AS bigint) AS n, round(t.supcon, 6) AS supcon, round(u.uniform, 6) AS uniform,
            round(t.supcon + 0.15::double * u.uniform, 6) AS loss FROM terms t JOIN spread u USING (batch)"""),
    "scan_from_title": """
        SELECT doc_id, coalesce(nullif(regexp_extract(title, 'scans:\\s*["'']?(\\d+)', 1, 'i'), ''),
            nullif(regexp_extract(title, 'NewScan:(\\d+)', 1, 'i'), ''),
            CASE WHEN regexp_full_match(trim(title), '\\d+') THEN trim(title) END) AS scan
        FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('controllerScans: "', doc_id, '" ', text)
            WHEN 1 THEN concat(text, ' newscan:', doc_id) WHEN 2 THEN concat(' ', doc_id, ' ') ELSE text END AS title FROM documents)""",
}
ORACLE["hdbscan_refine_distributed"] = ORACLE["hdbscan_refine"]
for _name, _least, _method in (("hdbscan_leaf_five", 5, "leaf"), ("hdbscan_mass", 2, "eom"), ("hdbscan_mass_five", 5, "eom")):
    ORACLE[_name] = _with(
        "fx_vectors", "hrows AS (SELECT label AS block, idx AS vertex, embedding FROM fx_vectors)", *_condensed("hrows", _least, _method),
        select="SELECT h.vertex, coalesce(l.label, -1) AS label FROM hrows h LEFT JOIN found l ON l.vertex = h.vertex")
for _name in ("hdbscan_leaf_five", "hdbscan_mass_five"):
    ORACLE[f"{_name}_distributed"] = ORACLE[_name]
ORACLE["bin_lsh_codes"] = _with(
    "fx_peaks", SUP_TOP.format(peaks="fx_peaks"), BINS, BIN_CODES,
    select="SELECT idx, cast(r AS int) AS rep, sum(CASE WHEN s > 0 THEN 1 << b ELSE 0 END)::bigint AS code FROM signs GROUP BY idx, r")
ORACLE["encode_random_projection"] = _with(
    "fx_spectra", "fx_peaks", SUP_TOP.format(peaks=FLOAT_PEAKS), BINS, PROJECT,
    select="SELECT idx, cast(d AS int) AS pos, round(x, 6) AS value FROM emb WHERE idx IN (SELECT idx FROM fx_peaks)")
ORACLE["spectral_eigenpairs"] = ORACLE["spectral_eigenpairs_iterated"] = _with(
    *EDGES, CLOSURE, "deg AS (SELECT i, sum(w) AS d FROM edges GROUP BY i)",
    """sizes AS (SELECT component, count(*) AS n FROM parts GROUP BY component)""",
    """squares AS (SELECT p.component, sum(e.w * e.w / (a.d * b.d)) AS s FROM edges e JOIN deg a ON a.i = e.i JOIN deg b ON b.i = e.j
         JOIN parts p ON p.node = e.i GROUP BY p.component)""",
    # all eigenvalues together have the trace n; vectors of length one at right angles give the sum of squares 1 + 4 + 9 + ...
    select=f"""SELECT component, n, n AS pairs, {D('n')} AS trace, round({D('n')} + s, 5) AS square_trace, {D('n')} AS lengths,
        {D('n * (n + 1) * (2 * n + 1) / 6')} AS probe, {D(0)} AS apart, {D(0)} AS residual
        FROM sizes JOIN squares USING (component)""")


def _draw(salt: int) -> str:
    return f"(({_mix('idx', 'i', '42', str(salt))} + 0.5::double) / 2147483647.0::double)"


def _normal(salt: int) -> str:
    return f"(sqrt(-2.0::double * ln({_draw(salt)})) * cos(2.0::double * pi() * {_draw(salt + 1)}))"


ORACLE["augment_peaks"] = _with(
    "fx_peaks", """placed AS (SELECT idx, cast(cast(mz AS float) AS double) AS mz, cast(cast(intensity AS float) AS double) AS intensity,
        row_number() OVER (PARTITION BY idx ORDER BY mz, intensity) - 1 AS i FROM fx_peaks)""",
    f"drawn AS (SELECT *, {_draw(1)} > 0.15::double AS stays FROM placed)",
    "judged AS (SELECT *, bool_or(stays) OVER (PARTITION BY idx) AS kept_any FROM drawn)",
    "kept AS (SELECT *, max(intensity) OVER (PARTITION BY idx) AS top FROM judged WHERE stays OR NOT kept_any)",
    select=f"""SELECT idx, cast(row_number() OVER (PARTITION BY idx ORDER BY i) - 1 AS int) AS pos,
        round(least(greatest(mz + {_normal(4)} * 0.01::double * 1450.0::double, 50.0::double), 1500.0::double), 4) AS mz,
        round(greatest(intensity + {_normal(2)} * 0.08::double * top, 0.0::double), 4) AS intensity FROM kept""")
