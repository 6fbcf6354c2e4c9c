"""The queries as DuckDB SQL, written from the semantics and not from the DataFrame code."""

from __future__ import annotations

CAT = "CASE WHEN isnan({w}) THEN NULL WHEN {w} >= 35 AND {w} <= 63 THEN 0 WHEN {w} >= 64 AND {w} <= 82 THEN 1 WHEN {w} >= 83 AND {w} <= 95 THEN 2 WHEN {w} >= 96 AND {w} <= 112 THEN 3 WHEN {w} >= 113 AND {w} <= 136 THEN 4 WHEN {w} > 136 THEN 5 END"
MID = "CASE {c} WHEN 0 THEN 49.0 WHEN 1 THEN 73.0 WHEN 2 THEN 89.0 WHEN 3 THEN 104.0 WHEN 4 THEN 124.5 ELSE 145.0 END::DOUBLE"

SNAP = f"""snap AS (SELECT event_id::VARCHAR || '-' || user_id::VARCHAR || '.nc' AS rel_path, CASE WHEN user_id % 17 <> 0 THEN value END AS w FROM events),
classed AS (SELECT rel_path, w, {CAT.format(w="w")} AS c FROM snap),
idx AS (SELECT rel_path, c AS ss_cat, w AS wind FROM classed WHERE w IS NOT NULL AND c IS NOT NULL)"""

TRACKS = f"""tracks AS (SELECT o_custkey AS sid, o_orderkey AS idx, o_orderpriority AS basin, o_orderdate AS tm, (o_orderkey * 37) % 121 - 60 AS lat, o_totalprice / 2500 AS w FROM orders),
catd AS (SELECT *, {CAT.format(w="w")} AS cat FROM tracks),
modes AS (SELECT sid, basin FROM (SELECT sid, basin, row_number() OVER (PARTITION BY sid ORDER BY count(*) DESC, basin) AS r FROM catd GROUP BY sid, basin) WHERE r = 1),
peaks AS (SELECT sid, w, tm, lat FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY w DESC, idx) AS r FROM catd) WHERE r = 1),
sizes AS (SELECT sid, count(*) AS n, max(coalesce(cat, -1)) AS ss FROM catd GROUP BY sid),
bins AS (SELECT sid, modes.basin, peaks.w, ss, month(tm) AS m, lat::DOUBLE AS lat, n,
  CASE WHEN month(tm) IN (12, 1, 2) THEN 'DJF' WHEN month(tm) <= 5 THEN 'MAM' WHEN month(tm) <= 8 THEN 'JJA' ELSE 'SON' END AS season,
  CASE WHEN abs(lat) < 10 THEN 'lat0_10' WHEN abs(lat) < 20 THEN 'lat10_20' WHEN abs(lat) < 30 THEN 'lat20_30' ELSE 'lat30p' END AS lat_bin,
  CASE WHEN n < 5 THEN 'n1_4' WHEN n < 13 THEN 'n5_12' WHEN n < 31 THEN 'n13_30' ELSE 'n31p' END AS dur
  FROM sizes JOIN modes USING (sid) JOIN peaks USING (sid)),
storm AS (SELECT *, basin || '|ss' || ss || '|' || season || '|' || lat_bin || '|' || dur AS stratum FROM bins),
ranked AS (SELECT sid, stratum, count(*) OVER (PARTITION BY stratum) AS k, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || sid), sid) AS r FROM storm),
cuts AS (SELECT *, round_even(k * 0.8::DOUBLE, 0) AS a, round_even(k * 0.1::DOUBLE, 0) AS v FROM ranked),
split AS (SELECT sid, stratum, CASE WHEN k = 1 OR (k = 2 AND r = 1) THEN 'train' WHEN k = 2 THEN 'val' WHEN r <= a THEN 'train' WHEN r <= a + least(v, k - a) THEN 'val' ELSE 'test' END AS split FROM cuts),
files AS (SELECT o_orderkey AS idx, o_orderkey::VARCHAR || CASE WHEN o_orderkey % 5 = 0 THEN '-b.nc' ELSE '-a.nc' END AS rel_path FROM orders WHERE o_orderkey % 7 <> 0),
mapped AS (SELECT catd.*, rel_path FROM catd LEFT JOIN files USING (idx)),
placed AS (SELECT mapped.*, split FROM mapped JOIN split USING (sid) WHERE rel_path IS NOT NULL)"""

RAW = """raw AS (SELECT (label % 6)::INT AS class, CASE WHEN vec_id % 2 = 0 THEN 'real' ELSE 'gen' END AS set, vec_id AS id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS e FROM embeddings),
px AS (SELECT class, set, id, i::INT AS i, CASE WHEN set = 'real' THEN least(greatest((e * 2 + 1) * 65 + 180, 180), 310) ELSE (e * 3 + 1) * 65 + 180 END AS v FROM raw),
cl AS (SELECT class, set, id, i, least(greatest(v, 180), 310) AS v FROM px)"""

E = "e AS (SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1)::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"

GEO = """geo AS (SELECT i::INT AS i, least(floor(sqrt((i // 8 - 3.5) ** 2 + (i % 8 - 3.5) ** 2) / (sqrt(24.5::DOUBLE) + 1e-12) * 4), 3)::INT AS rbin,
  least(floor((atan2(i // 8 - 3.5, i % 8 - 3.5) + pi()) / (2 * pi()) * 16), 15)::INT AS tbin FROM range(64) t(i)),
sector AS (SELECT class, set, id, rbin, tbin, sum(v) AS s, count(*) AS c FROM cl JOIN geo USING (i) GROUP BY ALL),
ring AS (SELECT class, set, id, rbin, sum(s) / (sum(c) + 1e-12) AS radial_mean, CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(s / (c + 1e-12)) END AS azimuthal_std FROM sector GROUP BY ALL)"""

EYE = "eye AS (SELECT class, set, id, avg(radial_mean) FILTER (rbin < 1) - min(radial_mean) FILTER (rbin < 3) AS ec FROM ring GROUP BY ALL)"

# power spectrum: the sum over pixels for each frequency, by joining pixels with frequencies
PSD = """freq AS (SELECT k::INT AS k, k // 8 AS ky, k % 8 AS kx, least(floor(sqrt(((k // 8 + 4) % 8 - 3.5) ** 2 + ((k % 8 + 4) % 8 - 3.5) ** 2) / (sqrt(24.5::DOUBLE) + 1e-12) * 4), 3)::INT AS kbin FROM range(64) t(k)),
centred AS (SELECT class, set, id, i, v - avg(v) OVER (PARTITION BY id) AS v FROM cl),
dft AS (SELECT class, set, id, k, kbin, sum(v * cos(2 * pi() * ((i // 8) * ky + (i % 8) * kx) / 8)) AS re, sum(v * sin(2 * pi() * ((i // 8) * ky + (i % 8) * kx) / 8)) AS im FROM centred, freq GROUP BY ALL),
spec AS (SELECT class, set, id, kbin, log10(sum(re * re + im * im) / (count(*) + 1e-12) + 1e-12) AS lp FROM dft GROUP BY ALL)"""

FEAT = """feat AS (SELECT class, set, id, rbin AS dim, radial_mean AS x FROM ring UNION ALL SELECT class, set, id, kbin + 4, lp FROM spec),
z AS (SELECT class, set, id, dim, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-12) AS z FROM feat WINDOW w AS (PARTITION BY class, set, dim))"""

DIST = """d AS (SELECT a.class, a.set AS sa, b.set AS sb, a.id AS ia, b.id AS ib, sum((a.z - b.z) ** 2) AS d2 FROM z a JOIN z b USING (class, dim) GROUP BY ALL)"""

SCHED = """sched AS (SELECT t, beta, 1 - beta AS alpha, product(1 - beta) OVER (ORDER BY t) AS abar FROM (SELECT t::INT AS t, 1e-4::DOUBLE + t * ((2e-2::DOUBLE - 1e-4::DOUBLE) / 999) AS beta FROM range(1000) r(t))),
full_sched AS (SELECT *, lag(abar, 1, 1.0) OVER (ORDER BY t) AS prev FROM sched),
sch AS (SELECT *, beta * (1 - prev) / (1 - abar) AS pv FROM full_sched)"""

NOISE = f"""{E},
cnt AS (SELECT count(*) AS n FROM embeddings),
nx AS (SELECT a.id, a.i, a.v AS x0, 2 * b.v AS eps, ((a.id * 37) % 1000)::INT AS t FROM e a, cnt JOIN e b ON b.id = (a.id + 1) % cnt.n AND b.i = a.i),
n AS (SELECT nx.*, beta, alpha, abar, pv, sqrt(abar) AS ra, sqrt(1 - abar) AS rb FROM nx JOIN sch USING (t))"""

HIST = """counts AS (SELECT class, set, least(floor((v - 180) / (130.0::DOUBLE / 128)), 127)::INT AS bin, count(*) AS c FROM cl GROUP BY ALL),
every AS (SELECT class, set, bin::INT AS bin FROM (SELECT DISTINCT class, set FROM cl), range(128) r(bin)),
hist AS (SELECT class, set, bin, coalesce(c, 0) / (sum(coalesce(c, 0)) OVER (PARTITION BY class, set) + 1e-12) AS p FROM every LEFT JOIN counts USING (class, set, bin)),
pq AS (SELECT a.class, a.bin, a.p / (sum(a.p) OVER (PARTITION BY a.class) + 1e-12) AS p, b.p / (sum(b.p) OVER (PARTITION BY a.class) + 1e-12) AS q
  FROM hist a JOIN hist b ON a.class = b.class AND a.bin = b.bin AND a.set = 'real' AND b.set = 'gen')"""

DAYS = "days AS (SELECT user_id % 5 AS run, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS step, avg(value) AS value FROM events GROUP BY ALL), seq AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS r FROM days)"


def hex_of(digits: str) -> str:
    return f"('0x' || {digits})::BIGINT"


U = f"{hex_of('substr(h, 1, 8)')} / 4294967296.0::DOUBLE"
PROBS = "cnt AS (SELECT ss_cat, count(*) AS n FROM idx GROUP BY ss_cat), pw AS (SELECT ss_cat, n, pow(n / sum(n) OVER (), {a}::DOUBLE) AS w FROM cnt), prob AS (SELECT ss_cat, n, w / sum(w) OVER () AS prob FROM pw)"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


SWISH = "({x}) / (exp(-({x})) + 1)"


def _condition() -> str:
    """Each branch as (id, place, value) rows that are joined with rows of weights, twice."""
    weights = lambda n, seed: ", ".join(f"({i}, {j}, {((3 * i + 5 * j + seed) % 7 - 3) / 4}::DOUBLE)" for i in range(4) for j in range(n))
    act = SWISH.format(x="h")
    out = f"""WITH c AS (SELECT vec_id AS id, vec_id * 37 % 1000 AS t, CASE WHEN vec_id % 10 = 0 OR label % 8 - 1 = 6 THEN 6 ELSE greatest(least(label % 8 - 1, 5), 0) END AS label,
CASE WHEN vec_id % 10 = 0 THEN -2 ELSE (least(greatest(vec_id % 200 + 1, 35), 170) - 35)::DOUBLE / 135 * 2 - 1 END AS s FROM embeddings),
x2 AS (SELECT id, j, CASE WHEN j < 2 THEN sin(t * exp(-ln(10000) * j)) ELSE cos(t * exp(-ln(10000) * (j - 2))) END AS v FROM c, range(4) r(j)),
x4 AS (SELECT id, j, ((3 * label + 5 * j + 1) % 7 - 3) / 4::DOUBLE AS v FROM c, range(4) r(j)),
x6 AS (SELECT id, j, CASE j WHEN 0 THEN s WHEN 1 THEN sin(pi() * s) WHEN 2 THEN cos(pi() * s) WHEN 3 THEN sin(2 * pi() * s) ELSE cos(2 * pi() * s) END AS v FROM c, range(5) r(j))"""
    for k, n in ((2, 4), (4, 4), (6, 5)):
        out += f""",
y{k} AS (SELECT id, i AS j, {act} AS v FROM (SELECT id, i, sum(v * w) + 0.1::DOUBLE AS h FROM x{k} JOIN (VALUES {weights(n, k)}) m(i, j, w) USING (j) GROUP BY id, i)),
z{k} AS (SELECT id, i, {act} AS v FROM (SELECT id, i, sum(v * w) - 0.2::DOUBLE AS h FROM y{k} JOIN (VALUES {weights(4, k + 1)}) m(i, j, w) USING (j) GROUP BY id, i))"""
    return out + f" SELECT id, i::INT AS i, {r('sum(v)')} AS v FROM (FROM z2 UNION ALL FROM z4 UNION ALL FROM z6) GROUP BY id, i"


# Three guided steps of the linear schedule over 0.0001, 0.01005, 0.02; noise k of place j from md5(id|k|j).
DDPM = f"""WITH sch AS (SELECT 0 AS t, 0.0001::DOUBLE AS beta, 0.9999::DOUBLE AS abar, 0.0::DOUBLE AS post UNION ALL SELECT 1, 0.01005, 0.9999 * 0.98995, 0.01005 * 0.0001 / (1 - 0.9999 * 0.98995)
UNION ALL SELECT 2, 0.02, 0.9999 * 0.98995 * 0.98, 0.02 * (1 - 0.9999 * 0.98995) / (1 - 0.9999 * 0.98995 * 0.98)),
a AS (SELECT vec_id AS id, CASE WHEN label < 6 THEN label ELSE 6 END AS label, CASE WHEN label < 6 THEN {MID.format(c='label')} ELSE 0 END AS wind FROM embeddings),
n AS (SELECT id, label, wind, j::INT AS i, 0.02 * 0.75 * label + 0.0015 * wind - 0.03 AS c, [('0x' || substr(md5(id || '|' || k || '|' || j), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1 for k in [0, 1, 2]] AS z FROM a, range(4) q(j)),
x2 AS (SELECT *, z[1] AS x FROM n),
s2 AS (SELECT *, (sqrt(abar) * x - sqrt(1 - abar) * (0.5 * x + c)) AS x0 FROM x2, sch WHERE t = 2),
x1 AS (SELECT id, label, i, c, z, (x - beta / (sqrt(1 - abar) + 1e-8) * ((x - sqrt(abar) * x0) / (sqrt(1 - abar) + 1e-8))) / sqrt(1 - beta) + sqrt(post) * z[2] AS x FROM s2),
s1 AS (SELECT *, (sqrt(abar) * x - sqrt(1 - abar) * (0.5 * x + c)) AS x0 FROM x1, sch WHERE t = 1),
x0 AS (SELECT id, label, i, c, (x - beta / (sqrt(1 - abar) + 1e-8) * ((x - sqrt(abar) * x0) / (sqrt(1 - abar) + 1e-8))) / sqrt(1 - beta) + sqrt(post) * z[3] AS x FROM s1)
SELECT id, label::INT AS label, i, {r('greatest(least(sqrt(abar) * x - sqrt(1 - abar) * (0.5 * x + c), 1), -1)')} AS v FROM x0, sch WHERE t = 0"""


ORACLES: dict[str, str] = {
    "class_index_counts": f"WITH {SNAP} SELECT ss_cat, count(*) AS n FROM idx GROUP BY ss_cat",
    "index_meta": f"WITH {SNAP} SELECT count(*) AS num_files_total, count(*) FILTER (w IS NOT NULL AND c IS NOT NULL) AS num_files_indexed, count(*) FILTER (w IS NULL) AS num_files_skipped_no_wind, count(*) FILTER (w IS NOT NULL AND c IS NULL) AS num_files_skipped_below_ts FROM classed",
    "index_idx_prefix": "SELECT event_id::VARCHAR || '-' || user_id::VARCHAR || '.nc' AS rel_path, event_id AS idx, true AS unparsable FROM events",
    "wind_fallback": f"WITH {SNAP} SELECT rel_path, ss_cat, {r('CASE WHEN known THEN wind ELSE ' + MID.format(c='ss_cat') + ' END')} AS wind_kt, NOT known AS is_fallback FROM (SELECT *, substr(md5(rel_path), 1, 1) < '8' AS known FROM idx)",
    "packed_layout": f"WITH {SNAP}, g AS (SELECT rel_path, row_number() OVER (ORDER BY rel_path) - 1 AS gi FROM idx) SELECT (gi // 512)::INT AS shard_id, min(gi) AS start, max(gi) + 1 AS stop, min(rel_path) AS first_path, max(rel_path) AS last_path FROM g GROUP BY 1",
    "shard_lookup": f"WITH {SNAP}, g AS (SELECT rel_path, row_number() OVER (ORDER BY rel_path) - 1 AS gi FROM idx), n AS (SELECT count(*) AS n FROM g) SELECT gi AS global_index, rel_path, (gi // 512)::INT AS shard_id, gi // 512 * 512 AS start, least((gi // 512 + 1) * 512, n) AS stop FROM g, n",
    "pack_validation": "SELECT unnest(['contiguous', 'nonempty_shards', 'covers_all', 'unique_paths', 'labels_present', 'expected_count']) AS \"check\", 0::BIGINT AS failures",
    "point_lookup": f"WITH {SNAP} SELECT rel_path, ss_cat, {r('wind')} AS wmo_wind_kt FROM idx",
    "packed_missing": "SELECT count(*) AS n_missing, min(doc_id) AS first_missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "label_mismatches": "SELECT doc_id, (n_chars > 1000)::INT AS packed_label, quality AS index_label FROM documents JOIN labels USING (doc_id) WHERE (n_chars > 1000)::INT <> quality",
    "array_max_abs_diff": f"WITH {E}, pick AS (SELECT vec_id AS id FROM embeddings ORDER BY md5('42|' || vec_id), vec_id LIMIT 256) SELECT id AS vec_id, {r('max(abs(v - round(v, 2)))')} AS max_diff FROM e JOIN pick USING (id) GROUP BY id",
    "storm_table": f"WITH {TRACKS} SELECT sid AS SID, basin AS BASIN_MODE, {r('w')} AS MAX_WMO_WIND, ss AS MAX_SS_CAT, m::INT AS MONTH_AT_PEAK, season AS SEASON_BIN, lat AS LAT_AT_PEAK, lat_bin AS LAT_BIN, n AS N_SNAPSHOTS, dur AS DUR_BIN, stratum AS STRATUM FROM storm",
    "strata_counts": f"WITH {TRACKS} SELECT stratum, count(*) AS n FROM storm GROUP BY stratum",
    "stratified_group_split": f"WITH {TRACKS} SELECT sid AS SID, stratum AS STRATUM, split FROM split",
    "idx_mapping": f"WITH {TRACKS} SELECT count(rel_path) AS n_mapped, count(*) - count(rel_path) AS n_dropped FROM mapped",
    "split_files": f"WITH {TRACKS} SELECT rel_path, split FROM placed",
    "split_summary": f"WITH {TRACKS} SELECT split, count(*) AS n_rows, count(DISTINCT sid) AS n_storms FROM placed GROUP BY split",
    "split_basin_counts": f"WITH {TRACKS} SELECT split, basin AS BASIN, count(*) AS n FROM placed GROUP BY ALL",
    "split_class_counts": f"WITH {TRACKS} SELECT split, cat AS SS_CAT, count(*) AS n FROM placed WHERE cat IS NOT NULL GROUP BY ALL",
    "split_semi": f"WITH {TRACKS} SELECT count(*) AS n, min(rel_path) AS first_path, max(rel_path) AS last_path FROM placed WHERE split = 'val'",
    "class_sampling_probs": f"WITH {SNAP}, {PROBS.format(a=0.4)} SELECT ss_cat, n, {r('prob')} AS prob FROM prob",
    "set_probs": f"WITH {SNAP}, c AS (SELECT ss_cat, count(*) AS n FROM idx WHERE ss_cat <> 2 GROUP BY ss_cat) SELECT ss_cat, n, {r('n / sum(n) OVER ()')} AS prob FROM c",
    "alpha_ramp": f"SELECT e::INT AS epoch, {r('1 - 0.6::DOUBLE * (1 - cos(pi() * least(e / 39, 1))) / 2')} AS alpha, 'cosine' AS mode FROM range(60) t(e) UNION ALL SELECT e::INT, {r('1 - 0.6::DOUBLE * greatest(least((e - 5) / 19, 1), 0)')}, 'linear' FROM range(60) t(e)",
    "balanced_fixed_subset": f"WITH {SNAP} SELECT rel_path, ss_cat FROM idx QUALIFY row_number() OVER (PARTITION BY ss_cat ORDER BY md5('42|' || rel_path), rel_path) <= 5",
    "real_sample": "SELECT (label % 6)::INT AS class, vec_id AS id FROM embeddings WHERE vec_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY label % 6 ORDER BY md5('123|' || vec_id), vec_id) <= 25",
    "weighted_draws": f"""WITH {SNAP}, {PROBS.format(a=0.4)}, rng AS (SELECT ss_cat, n, sum(prob) OVER (ORDER BY ss_cat) - prob AS low, CASE WHEN ss_cat = max(ss_cat) OVER () THEN 2 ELSE sum(prob) OVER (ORDER BY ss_cat) END AS high FROM prob),
dr AS (SELECT draw, {U} AS u, {hex_of('substr(h, 9, 8)')} / 4294967296.0::DOUBLE AS v FROM (SELECT draw, md5('42|' || draw) AS h FROM range(2000) t(draw))),
pl AS (SELECT ss_cat, rel_path, row_number() OVER (PARTITION BY ss_cat ORDER BY rel_path) - 1 AS place FROM idx)
SELECT draw, rng.ss_cat, rel_path FROM dr JOIN rng ON u >= low AND u < high JOIN pl ON pl.ss_cat = rng.ss_cat AND pl.place = floor(v * n)""",
    "stream_weighted_sampler": f"""WITH {SNAP}, {PROBS.format(a=0.4)}, rng AS (SELECT ss_cat, n, sum(prob) OVER (ORDER BY ss_cat) - prob AS low, CASE WHEN ss_cat = max(ss_cat) OVER () THEN 2 ELSE sum(prob) OVER (ORDER BY ss_cat) END AS high FROM prob),
dr AS (SELECT draw, {U} AS u, {hex_of('substr(h, 9, 8)')} / 4294967296.0::DOUBLE AS v FROM (SELECT draw, md5('42|' || draw) AS h FROM range(400) t(draw))),
pl AS (SELECT ss_cat, rel_path, row_number() OVER (PARTITION BY ss_cat ORDER BY rel_path) - 1 AS place FROM idx)
SELECT draw, rng.ss_cat, rel_path FROM dr JOIN rng ON u >= low AND u < high JOIN pl ON pl.ss_cat = rng.ss_cat AND pl.place = floor(v * n)""",
    "pack_verification": f"SELECT 0::BIGINT AS n_missing, 0::BIGINT AS n_mislabelled, count(DISTINCT id) AS n_compared, 0::BIGINT AS n_reshaped, {r('max(abs(v::FLOAT::DOUBLE - round(v, 2)::FLOAT::DOUBLE))')} AS max_abs_diff, 0::INT AS n_wrong_type, true AS ok FROM (SELECT vec_id AS id, unnest(embedding)::FLOAT::DOUBLE AS v FROM embeddings)",
    "pack_manifest": f"WITH {SNAP}, g AS (SELECT row_number() OVER (ORDER BY rel_path) - 1 AS gi FROM idx), n AS (SELECT count(*) AS n FROM g) SELECT DISTINCT n AS num_samples, 512::INT AS samples_per_shard, 'samples/shard_id=' || (gi // 512) AS path, gi // 512 * 512 AS start, least((gi // 512 + 1) * 512, n) AS stop FROM g, n",
    "ddpm_sample_loop": DDPM,
    "augment_gate": f"WITH {SNAP}, p AS (SELECT * FROM (VALUES (0, 0.15, 1), (1, 0.2, 1), (2, 0.35, 1), (3, 0.6, 2), (4, 0.75, 2), (5, 0.85, 3)) t(ss_cat, p, bars)), g AS (SELECT *, md5('42|' || rel_path) AS h FROM idx JOIN p USING (ss_cat)) SELECT ss_cat, count(*) AS n, count(*) FILTER ({U} < p) AS n_augmented, 2 AS max_shift, max(bars) AS max_bars FROM g GROUP BY ss_cat",
    "augment_policy": "SELECT * FROM (VALUES (0, 0.15::DOUBLE, 2, 1), (1, 0.3, 2, 1), (2, 0.65, 2, 2), (3, 0.85, 2, 3)) t(ss_cat, p_aug, max_shift, max_bars)",
    "cond_dropout": f"WITH {SNAP}, g AS (SELECT *, {U} < 0.1 AS gone FROM (SELECT *, md5('42|' || rel_path) AS h FROM idx)) SELECT rel_path, CASE WHEN gone THEN 6 ELSE ss_cat END AS label, {r('CASE WHEN gone THEN 0 ELSE wind END')} AS wind_kt FROM g",
    "bt_normalize": f"WITH {RAW} SELECT id, i, {r('(v - 180) / 130 * 2 - 1')} AS v FROM cl",
    "bt_denormalize": f"WITH {E} SELECT id, i, {r('(v + 1) / 2 * 130 + 180')} AS v FROM e",
    "bt_eval_clean": f"WITH {RAW} SELECT id, i, {r('CASE i WHEN 0 THEN 180 WHEN 1 THEN 310 WHEN 2 THEN 180 ELSE v END')} AS v FROM cl",
    "pixel_moments": f"WITH {RAW}, m AS (SELECT class, set, v, avg(v) OVER (PARTITION BY class, set) AS mu FROM px) SELECT class, set, {r('any_value(mu)')} AS mean, {r('sqrt(avg((v - mu) ** 2))')} AS std, {r('avg((v - mu) ** 3) / avg((v - mu) ** 2) ** 1.5')} AS skew, {r('avg((v - mu) ** 4) / avg((v - mu) ** 2) ** 2 - 3')} AS kurt FROM m GROUP BY class, set",
    "pixel_quantiles": f"WITH {RAW}, q AS (SELECT class, set, quantile_cont(v, [0.01, 0.05, 0.5, 0.95, 0.99]) AS x FROM px GROUP BY ALL) SELECT class, set, unnest([0.01, 0.05, 0.5, 0.95, 0.99])::DOUBLE AS q, {r('unnest(x)')} AS value FROM q",
    "price_quantiles": f"WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.0, 0.01, 0.5, 0.99, 1.0]) AS x FROM lineitem GROUP BY ALL) SELECT l_returnflag, unnest([0.0, 0.01, 0.5, 0.99, 1.0])::DOUBLE AS q, {r('unnest(x)', 4)} AS value FROM q",
    "gen_exceedance": f"WITH {RAW}, g AS (SELECT class, avg((v < 180)::INT) AS lo, avg((v > 310)::INT) AS hi, min(v) AS a, max(v) AS b FROM px WHERE set = 'gen' GROUP BY class) SELECT class, {r('lo')} AS below, {r('hi')} AS above, {r('a')} AS raw_min, {r('b')} AS raw_max, {r('lo + hi')} AS total FROM g",
    "cold_fraction": f"WITH {RAW}, s AS (SELECT class, set, id, avg((v < 200)::INT) AS s FROM cl GROUP BY ALL) SELECT class, set, {r('avg(s)')} AS cold_mean, {r('stddev_pop(s)')} AS cold_std FROM s GROUP BY ALL",
    "bt_histogram": f"WITH {RAW}, {HIST} SELECT class, set, bin, {r('p')} AS p, {r('180 + (bin + 0.5) * 130 / 128')} AS centre FROM hist",
    "hist_js": f"WITH {RAW}, {HIST}, m AS (SELECT *, (p + q) / 2 AS m FROM pq) SELECT class, {r('(sum(p * ln((p + 1e-12) / (m + 1e-12))) + sum(q * ln((q + 1e-12) / (m + 1e-12)))) / 2')} AS js FROM m GROUP BY class",
    "hist_w1": f"WITH {RAW}, {HIST}, g AS (SELECT class, abs(sum(p) OVER w - sum(q) OVER w) AS g FROM pq WINDOW w AS (PARTITION BY class ORDER BY bin)) SELECT class, {r('sum(g) * 130 / 128')} AS w1 FROM g GROUP BY class",
    "radial_profile": f"WITH {RAW}, {GEO} SELECT class, set, id, rbin, {r('radial_mean')} AS radial_mean FROM ring",
    "azimuthal_std": f"WITH {RAW}, {GEO} SELECT class, set, id, rbin, {r('azimuthal_std')} AS azimuthal_std FROM ring",
    "profile_stats": f"WITH {RAW}, {GEO} SELECT class, set, rbin, {r('avg(radial_mean)')} AS mu, {r('stddev_pop(radial_mean)')} AS sd FROM ring GROUP BY ALL",
    "eye_contrast": f"WITH {RAW}, {GEO}, {EYE} SELECT class, set, {r('avg(ec)')} AS mean, {r('stddev_pop(ec)')} AS std FROM eye GROUP BY ALL",
    "psd_radial": f"WITH {RAW}, {PSD} SELECT class, set, id, kbin, {r('lp', 5)} AS log_power FROM spec",
    "psd_arrow": f"WITH {RAW}, {PSD} SELECT class, set, id, kbin, {r('lp', 5)} AS log_power FROM spec",
    "psd_l2": f"WITH {RAW}, {PSD}, c AS (SELECT class, set, kbin, avg(lp) AS m FROM spec GROUP BY ALL) SELECT a.class, {r('avg((a.m - b.m) ** 2)')} AS psd_l2 FROM c a JOIN c b ON a.class = b.class AND a.kbin = b.kbin AND a.set = 'real' AND b.set = 'gen' GROUP BY a.class",
    "diversity_features": f"WITH {RAW}, {GEO}, {PSD}, {FEAT} SELECT class, set, id, dim, {r('z', 5)} AS z FROM z",
    "pair_distance": f"WITH {RAW}, {GEO}, {PSD}, {FEAT}, {DIST} SELECT class, sa AS set, {r('avg(sqrt(d2))', 5)} AS mean_distance FROM d WHERE sa = sb AND ia <> ib GROUP BY ALL",
    "mmd2": f"""WITH {RAW}, {GEO}, {PSD}, {FEAT}, {DIST}, g AS (SELECT class, 1 / (2 * (median(d2) + 1e-12)) AS g FROM d WHERE d2 > 0 GROUP BY class),
k AS (SELECT class, sa, sb, ia = ib AND sa = sb AS diag, exp(-g * d2) AS k FROM d JOIN g USING (class)), n AS (SELECT class, count(DISTINCT id) FILTER (set = 'real') AS n, count(DISTINCT id) FILTER (set = 'gen') AS m FROM z GROUP BY class),
s AS (SELECT class, sum(k) FILTER (sa = 'real' AND sb = 'real' AND NOT diag) AS rr, sum(k) FILTER (sa = 'gen' AND sb = 'gen' AND NOT diag) AS gg, sum(k) FILTER (sa = 'real' AND sb = 'gen') AS rg FROM k GROUP BY class)
SELECT class, {r('rr / (n * (n - 1) + 1e-12) + gg / (m * (m - 1) + 1e-12) - 2 * rg / (n * m)', 5)} AS mmd2 FROM s JOIN n USING (class)""",
    "macro_metrics": f"""WITH {RAW}, {GEO}, {EYE}, pm AS (SELECT class, avg(v) FILTER (set = 'real') AS x, avg(v) FILTER (set = 'gen') AS y FROM px GROUP BY class), em AS (SELECT class, avg(ec) FILTER (set = 'real') AS x, avg(ec) FILTER (set = 'gen') AS y FROM eye GROUP BY class),
b AS (SELECT 'pixel_mean' AS metric, * FROM pm UNION ALL SELECT 'eye_contrast', * FROM em) SELECT {r('corr(class, x)')} AS corr_class_real, {r('corr(class, y)')} AS corr_class_gen, {r('corr(x, y)')} AS corr_real_gen, {r('avg(abs(x - y))')} AS mae, metric FROM b GROUP BY metric""",
    "metrics_report": f"WITH {RAW}, {GEO}, {EYE}, pm AS (SELECT class, avg(v) FILTER (set = 'real') AS x, avg(v) FILTER (set = 'gen') AS y FROM px GROUP BY class), em AS (SELECT class, avg(ec) FILTER (set = 'real') AS a, avg(ec) FILTER (set = 'gen') AS b FROM eye GROUP BY class) SELECT class::VARCHAR AS class, {r('x', 4)} AS pixel_mean_real, {r('y', 4)} AS pixel_mean_gen, {r('a', 4)} AS eye_real, {r('b', 4)} AS eye_gen FROM pm JOIN em USING (class)",
    "viz_shared_limits": f"WITH {RAW} SELECT {r('min(v)')} AS low, {r('max(v)')} AS high FROM px",
    "viz_compare_grid": "WITH g AS (SELECT (label % 6)::INT AS class, CASE WHEN vec_id % 2 = 0 THEN 'real' ELSE 'gen' END AS set, vec_id AS id FROM embeddings), n AS (SELECT class, least(5, count(*) FILTER (set = 'real'), count(*) FILTER (set = 'gen')) AS n FROM g GROUP BY class), p AS (SELECT class, set, id, (row_number() OVER (PARTITION BY class, set ORDER BY id) - 1)::INT AS place FROM g) SELECT class, set, id, place FROM p JOIN n USING (class) WHERE place < n",
    "rot90": f"""WITH {E}, k AS (SELECT vec_id AS id, {hex_of("substr(md5('42|' || vec_id), 1, 2)")} % 4 AS k FROM embeddings), yx AS (SELECT id, v, i // 8 AS y, i % 8 AS x, k FROM e JOIN k USING (id))
SELECT id, CASE k WHEN 0 THEN y * 8 + x WHEN 1 THEN (7 - x) * 8 + y WHEN 2 THEN (7 - y) * 8 + 7 - x ELSE x * 8 + 7 - y END::INT AS i, {r('v')} AS v FROM yx""",
    "shift_reflect": f"""WITH {E}, k AS (SELECT vec_id AS id, {hex_of("substr(md5('42|' || vec_id), 1, 2)")} % 5 - 2 AS dy, {hex_of("substr(md5('42|' || vec_id), 3, 2)")} % 5 - 2 AS dx FROM embeddings),
spots AS (SELECT id, j::INT AS j, j // 8 + dy AS y, j % 8 + dx AS x FROM k, range(64) t(j)), m AS (SELECT id, j, CASE WHEN y < 0 THEN -y WHEN y > 7 THEN 14 - y ELSE y END * 8 + CASE WHEN x < 0 THEN -x WHEN x > 7 THEN 14 - x ELSE x END AS src FROM spots)
SELECT id, j AS i, {r('v')} AS v FROM m JOIN e USING (id) WHERE e.i = src""",
    "erase_bar": f"WITH {E} SELECT id, i, {r('CASE WHEN (CASE WHEN id % 2 = 0 THEN i % 8 ELSE i // 8 END) BETWEEN id % 5 AND id % 5 + id % 3 THEN 0.5 ELSE v END')} AS v FROM e",
    "beta_linear": f"WITH {SCHED} SELECT t, {r('beta', 9)} AS beta FROM sch",
    "beta_cosine": f"WITH f AS (SELECT t, pow(cos((t / 1000 + 0.008::DOUBLE) / 1.008::DOUBLE * pi() / 2), 2) AS f FROM range(1001) r(t)) SELECT a.t::INT AS t, {r('least(greatest(1 - b.f / a.f, 1e-8), 0.999)', 9)} AS beta FROM f a JOIN f b ON b.t = a.t + 1",
    "posterior_variance": f"WITH {SCHED} SELECT t, {r('abar', 9)} AS abar, {r('prev', 9)} AS abar_prev, {r('pv', 9)} AS post_var FROM sch",
    "q_sample": f"WITH {SCHED}, {NOISE} SELECT id, i, {r('ra * x0 + rb * eps')} AS v FROM n",
    "v_target": f"WITH {SCHED}, {NOISE} SELECT id, i, {r('ra * eps - rb * x0')} AS v FROM n",
    "x0_roundtrip": f"WITH {SCHED}, {NOISE} SELECT id, true AS v_ok, true AS eps_ok, {r('max(abs((ra * x0 + rb * eps - rb * eps) / (ra + 1e-8) - x0))')} AS eps_gap FROM n GROUP BY id",
    "min_snr_weights": f"WITH {SCHED}, s AS (SELECT t, abar / greatest(1 - abar, 1e-8) AS s FROM sch) SELECT t, {r('least(s, 2.5) / (s + 1)')} AS w_v, {r('least(s, 2.5) / greatest(s, 1e-8)')} AS w_eps FROM s",
    "diffusion_loss": f"WITH {SCHED}, {NOISE}, l AS (SELECT id, t, avg((ra * eps - rb * x0 - x0) ** 2) * least(any_value(abar / (1 - abar)), 2.5) / (any_value(abar / (1 - abar)) + 1) AS loss FROM n GROUP BY id, t) SELECT id, label::INT AS label, t, {r('loss')} AS loss FROM l JOIN embeddings ON vec_id = id",
    "batch_mean_loss": f"WITH {SCHED}, {NOISE}, l AS (SELECT id, avg((ra * eps - rb * x0 - x0) ** 2) * least(any_value(abar / (1 - abar)), 2.5) / (any_value(abar / (1 - abar)) + 1) AS loss FROM n GROUP BY id), b AS (SELECT id // 64 AS b, avg(loss) AS m, count(*) AS k FROM l GROUP BY 1) SELECT 'all' AS part, count(*) AS batches, {r('avg(m)')} AS loss, false AS drop_last FROM b UNION ALL SELECT 'all', count(*), {r('avg(m)')}, true FROM b WHERE k = 64",
    "dynamic_threshold": f"WITH {E}, a AS (SELECT id, i, v * 5 AS x, row_number() OVER (PARTITION BY id ORDER BY abs(v)) - 1 AS r FROM e), s AS (SELECT id, greatest(abs(x), 1) AS s FROM a WHERE r = round_even(63 * 0.9::DOUBLE, 0)) SELECT id, i, {r('least(greatest(x, -s), s) / (s + 1e-8)')} AS v FROM a JOIN s USING (id)",
    "cfg_combine": f"WITH {SCHED}, {NOISE} SELECT id, i, {r('eps + 2.5 * (x0 - eps)')} AS v, 2.5::DOUBLE AS scale FROM n UNION ALL SELECT id, i, {r('x0')}, 0.0 FROM n",
    "reverse_step": f"""WITH {SCHED}, {NOISE}, p AS (SELECT *, ra * x0 + rb * eps AS xt, ra * (ra * x0 + rb * eps) - rb * (ra * eps - rb * x0) AS x FROM n),
a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(x)) - 1 AS rk FROM p), s AS (SELECT id, greatest(abs(x), 1) AS s FROM a WHERE rk = round_even(63 * 0.995::DOUBLE, 0)),
th AS (SELECT a.*, least(greatest(x, -s), s) / (s + 1e-8) AS z FROM a JOIN s USING (id)), ep AS (SELECT *, (xt - ra * z) / (rb + 1e-8) AS e2 FROM th)
SELECT id, t, i, {r('CASE WHEN t = 0 THEN least(greatest(z, -1), 1) ELSE (xt - beta / (rb + 1e-8) * e2) / sqrt(alpha) + sqrt(pv) * eps * 0.5 END')} AS v FROM ep""",
    "ema_series": f"WITH RECURSIVE {DAYS}, f AS (SELECT run, r, step, value AS s FROM seq WHERE r = 1 UNION ALL SELECT seq.run, seq.r, seq.step, 0.9::DOUBLE * f.s + 0.1::DOUBLE * seq.value FROM f JOIN seq ON seq.run = f.run AND seq.r = f.r + 1) SELECT run, step, {r('s')} AS ema FROM f",
    "early_stop": f"""WITH RECURSIVE {DAYS}, f AS (SELECT run, r, step AS best_at, value AS best, 0 AS bad, NULL::BIGINT AS stop FROM seq WHERE r = 1
UNION ALL SELECT f.run, seq.r, CASE WHEN f.best - seq.value > 0.5 THEN seq.step ELSE f.best_at END, CASE WHEN f.best - seq.value > 0.5 THEN seq.value ELSE f.best END, CASE WHEN f.best - seq.value > 0.5 THEN 0 ELSE f.bad + 1 END,
CASE WHEN NOT f.best - seq.value > 0.5 AND f.bad + 1 >= 3 THEN seq.step END FROM f JOIN seq ON seq.run = f.run AND seq.r = f.r + 1 WHERE f.stop IS NULL)
SELECT run, best_at AS best_epoch, {r('best')} AS best_metric, stop AS stopped_epoch FROM f QUALIFY row_number() OVER (PARTITION BY run ORDER BY r DESC) = 1""",
    "wind_features": f"WITH {SNAP}, s AS (SELECT rel_path, (least(wind, 170) - 35) / 135 * 2 - 1 AS w FROM idx) SELECT rel_path, unnest(range(5))::INT AS i, {r('unnest([w, sin(pi() * w), cos(pi() * w), sin(2 * pi() * w), cos(2 * pi() * w)])')} AS v FROM s",
    "time_embedding": f"SELECT t::INT AS t, i::INT AS i, {r('CASE WHEN i < 4 THEN sin(t * exp(-ln(10000) * i / 3)) WHEN i < 8 THEN cos(t * exp(-ln(10000) * (i - 4) / 3)) ELSE 0 END')} AS v FROM range(1000) a(t), range(9) b(i)",
    "midpoint_general": f"SELECT l::INT AS label, CASE WHEN l = 6 THEN 0 ELSE {MID.format(c='greatest(least(l, 5), 0)')} END AS six, CASE WHEN l = 8 THEN 0 ELSE 35 + (greatest(least(l, 7), 0) + 0.5::DOUBLE) * 16.875::DOUBLE END AS eight, {MID.format(c='l')} AS scalar, CASE WHEN l = 6 THEN 6 ELSE greatest(least(l, 5), 0) END::INT AS clipped FROM range(-1, 9) t(l)",
    "wind_targets": "SELECT * FROM (VALUES (0, 49.5::DOUBLE), (1, 73.0), (2, 89.0), (3, 101.0), (4, 124.5), (5, 145.0)) t(ss_cat, target)",
    "groupnorm": f"WITH {E}, g AS (SELECT id, i // 8 AS c, i % 8 AS i, v, i // 16 AS g FROM e) SELECT id, c::INT AS c, i::INT AS i, {r('(v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-3)', 5)} AS v FROM g WINDOW w AS (PARTITION BY id, g)",
    "film_swish": f"WITH {E}, h AS (SELECT id, i, v * 1.25::DOUBLE - 0.1::DOUBLE AS h FROM e) SELECT id, i, {r(SWISH.format(x='h'))} AS v FROM h",
    "avg_pool": f"WITH {E} SELECT id, (i // 16 * 4 + i % 8 // 2)::INT AS i, {r('avg(v)')} AS v FROM e GROUP BY 1, 2",
    "upsample": f"""WITH {E}, g AS (SELECT k::INT AS k, least(greatest((k // 16 + 0.5) / 2 - 0.5, 0), 7)::DOUBLE AS y, least(greatest((k % 16 + 0.5) / 2 - 0.5, 0), 7)::DOUBLE AS x FROM range(256) t(k)),
w AS (SELECT id, k, v * greatest(1 - abs(i // 8 - y), 0) * greatest(1 - abs(i % 8 - x), 0) AS p FROM e, g WHERE abs(i // 8 - y) < 1 AND abs(i % 8 - x) < 1) SELECT id, k AS i, {r('sum(p)')} AS v FROM w GROUP BY id, k""",
    "conv3x3": f"WITH {E}, w AS (SELECT * FROM (VALUES (-1, -1, 1), (-1, 0, 2), (-1, 1, 1), (1, -1, -1), (1, 0, -2), (1, 1, -1)) t(dy, dx, w)), c AS (SELECT id, j::INT AS i FROM (SELECT DISTINCT id FROM e), range(64) t(j)) SELECT c.id, c.i, {r('coalesce(sum(e.v * w), 0)')} AS v FROM c, w LEFT JOIN e ON e.id = c.id AND e.i // 8 = c.i // 8 + dy AND e.i % 8 = c.i % 8 + dx GROUP BY c.id, c.i",
    "attention_tiny": f"WITH {E}, d AS (SELECT a.id, a.i // 8 AS t, b.i // 8 AS s, exp(sum(a.v * b.v) / sqrt(8::DOUBLE)) AS w FROM e a JOIN e b ON a.id = b.id AND a.i % 8 = b.i % 8 GROUP BY ALL), n AS (SELECT id, t, s, w / sum(w) OVER (PARTITION BY id, t) AS w FROM d) SELECT n.id, t::INT AS t, (e.i % 8)::INT AS i, {r('sum(w * v)')} AS v FROM n JOIN e ON e.id = n.id AND e.i // 8 = s GROUP BY ALL",
    "embed_mlp": f"WITH h AS (SELECT vec_id AS id, embedding[1]::DOUBLE - embedding[2]::DOUBLE + 0.5::DOUBLE * embedding[3]::DOUBLE + 0.1::DOUBLE AS a, 0.25::DOUBLE * embedding[1]::DOUBLE + 0.5::DOUBLE * embedding[2]::DOUBLE + 2 * embedding[3]::DOUBLE - 0.2::DOUBLE AS b FROM embeddings) SELECT id, 0 AS i, {r(SWISH.format(x='a'))} AS v FROM h UNION ALL SELECT id, 1, {r(SWISH.format(x='b'))} FROM h",
    "condition_embedding": _condition(),
    "training_elements": f"WITH {RAW} SELECT id || '.nc' AS rel_path, class AS ss_cat, CASE WHEN class > 2 THEN class + 0.5::DOUBLE ELSE {MID.format(c='class')} END AS wind_kt, i, {r('(v - 180) / 130 * 2 - 1')} AS v FROM cl",
    "augmented_elements": f"""WITH {E}, d AS (SELECT vec_id AS id, md5('42|' || vec_id) AS h, label % 6 AS c FROM embeddings),
p AS (SELECT id, {U} < CASE c WHEN 0 THEN 0.15 WHEN 1 THEN 0.2 WHEN 2 THEN 0.35 WHEN 3 THEN 0.6 WHEN 4 THEN 0.75 ELSE 0.85 END AS go, {hex_of("substr(h, 9, 2)")} % 4 AS k, {hex_of("substr(h, 11, 2)")} % 5 - 2 AS dy, {hex_of("substr(h, 13, 2)")} % 5 - 2 AS dx FROM d),
turned AS (SELECT id, v, CASE k WHEN 0 THEN i WHEN 1 THEN (7 - i % 8) * 8 + i // 8 WHEN 2 THEN 63 - i ELSE i % 8 * 8 + 7 - i // 8 END AS i FROM e JOIN p USING (id)),
m AS (SELECT id, go, j::INT AS j, j // 8 + dy AS y, j % 8 + dx AS x FROM p, range(64) t(j)),
src AS (SELECT id, go, j, CASE WHEN y < 0 THEN -y WHEN y > 7 THEN 14 - y ELSE y END * 8 + CASE WHEN x < 0 THEN -x WHEN x > 7 THEN 14 - x ELSE x END AS s FROM m)
SELECT id, j AS i, {r('v')} AS v FROM src JOIN turned USING (id) WHERE go AND turned.i = s UNION ALL SELECT id, i, {r('v')} FROM e JOIN p USING (id) WHERE NOT go""",
    "train_batches": "SELECT vec_id // 64 AS batch, count(*) AS n, sum(label)::BIGINT AS labels FROM embeddings GROUP BY 1 HAVING count(*) = 64",
    "viz_sample_grid": f"WITH {RAW}, f AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM (SELECT DISTINCT id FROM px WHERE class = 0 AND set = 'real') QUALIFY p < 7), g AS (SELECT (p // 3 * 8 + i // 8)::INT AS y, (p % 3 * 8 + i % 8)::INT AS x, v FROM f JOIN px USING (id)), c AS (SELECT y::INT AS y, x::INT AS x FROM (SELECT (count(*) + 2) // 3 AS rows FROM f), range(24) b(x), range(24) a(y) WHERE y < rows * 8) SELECT c.y, c.x, {r('coalesce(v, 0)')} AS v FROM c LEFT JOIN g USING (y, x)",
}

def fixed(seed: int, *places: str) -> str:
    """The rule of the small weights of the blocks, over places."""
    return f"(({' + '.join(f'{m} * {p}' for m, p in zip((3, 5, 2, 1), places))} + {seed}) % 7 - 3) / 8::DOUBLE"


TILES = "x AS (SELECT vec_id AS id, i // 4 AS p, i % 4 AS c, v FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)), emb AS (SELECT vec_id AS id, [vec_id % 5 / 5::DOUBLE, (label % 3)::DOUBLE] AS e FROM embeddings)"


def normed(source: str, channels: int, seed: int) -> str:
    """The norm in two groups of (id, p, c, v), scaled and shifted by channel."""
    return f"SELECT id, p, c, (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5) * (1 + {fixed(seed, 'c')}) + {fixed(seed + 1, 'c')} AS v FROM {source} WINDOW w AS (PARTITION BY id, c // {channels // 2})"


def _res(c: int) -> str:
    """A residual block: convolutions as joins of pixels with offsets and weights."""
    conv = lambda source, n, seed: f"""SELECT id, q AS p, o AS c, sum(v * ({fixed(seed, 'dy', 'dx', 'c', 'o')})) + any_value({fixed(seed + 1, 'o')}) AS v
FROM (SELECT s.*, dy, dx, o, (p // 4 - dy + 1) AS y, (p % 4 - dx + 1) AS z, (p // 4 - dy + 1) * 4 + p % 4 - dx + 1 AS q FROM {source} s, range(3) a(dy), range(3) b(dx), range({c}) k(o)) WHERE y BETWEEN 0 AND 3 AND z BETWEEN 0 AND 3 GROUP BY id, q, o"""  # noqa: E731
    film = lambda k: f"(e[1] * ({fixed(8, '0', f'(c + {k * c})')}) + e[2] * ({fixed(8, '1', f'(c + {k * c})')}) + {fixed(9, f'(c + {k * c})')})"
    act = lambda source, k: f"SELECT id, p, c, h / (1 + exp(-h)) AS v FROM (SELECT id, p, c, v * (1 + {film(k)}) + {film(k + 1)} AS h FROM {source} JOIN emb USING (id))"
    skip = "x" if c == 4 else f"(SELECT id, p, o AS c, sum(v * ({fixed(6, 'c', 'o')})) + any_value({fixed(7, 'o')}) AS v FROM x, range({c}) k(o) GROUP BY id, p, o)"
    return f"""WITH {TILES}, c1 AS ({conv('x', 4, 1)}), n1 AS ({normed('c1', c, 3)}), a1 AS ({act('n1', 0)}), c2 AS ({conv('a1', c, 4)}), n2 AS ({normed('c2', c, 4)}), a2 AS ({act('n2', 2)})
SELECT id, (p * {c} + c)::INT AS i, {r('a.v + s.v')} AS v, {c} AS channels FROM a2 a JOIN {skip} s USING (id, p, c)"""


ATTENTION = f"""WITH {TILES}, n AS ({normed('x', 4, 2)}),
qkv AS (SELECT id, p, h, d, sum(v * 4 * ({fixed(1, 'c', 'h', 'd')})) + any_value({fixed(4, 'h', 'd')}) AS q, sum(v * 4 * ({fixed(2, 'c', 'h', 'd')})) + any_value({fixed(5, 'h', 'd')}) AS k, sum(v * 4 * ({fixed(3, 'c', 'h', 'd')})) + any_value({fixed(6, 'h', 'd')}) AS v
  FROM n, range(2) a(h), range(2) b(d) GROUP BY id, p, h, d),
s AS (SELECT a.id, a.p, b.p AS t, a.h, exp(sum(a.q * b.k) / sqrt(2::DOUBLE)) AS w FROM qkv a JOIN qkv b USING (id, h, d) GROUP BY ALL),
w AS (SELECT id, p, t, h, w / sum(w) OVER (PARTITION BY id, p, h) AS w FROM s),
z AS (SELECT w.id, w.p, w.h, d, sum(w * v) AS z FROM w JOIN qkv ON qkv.id = w.id AND qkv.h = w.h AND qkv.p = w.t GROUP BY ALL),
o AS (SELECT id, p, c, sum(z * ({fixed(4, 'h', 'd', 'c')})) + any_value({fixed(6, 'c')}) AS v FROM z, range(4) k(c) GROUP BY id, p, c)
SELECT id, (p * 4 + c)::INT AS i, {r('o.v + x.v')} AS v FROM o JOIN x USING (id, p, c)"""

KINDS = """kinds AS (SELECT class, 'real' AS kind, v FROM px WHERE set = 'real' UNION ALL SELECT class, 'gen_raw', v FROM px WHERE set = 'gen' UNION ALL SELECT class, 'gen_clipped', v FROM cl WHERE set = 'gen'),
moved AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w + 1e-12 AS s FROM kinds WINDOW w AS (PARTITION BY class, kind)),
stat AS (SELECT class, 'pixel_stats.' || kind || '.' AS p, avg(v) AS mean, stddev_pop(v) AS std, avg(((v - m) / s) ** 3) AS skew, avg(((v - m) / s) ** 4) - 3 AS kurtosis, quantile_cont(v, [0.01, 0.05, 0.5, 0.95, 0.99]) AS q, min(v) AS low, max(v) AS high FROM moved GROUP BY class, kind)"""

MMD = """gm AS (SELECT class, 1 / (2 * (median(d2) + 1e-12)) AS g FROM d WHERE d2 > 0 GROUP BY class),
k AS (SELECT class, sa, sb, ia = ib AND sa = sb AS diag, exp(-g * d2) AS k FROM d JOIN gm USING (class)), nm AS (SELECT class, count(DISTINCT id) FILTER (set = 'real') AS n, count(DISTINCT id) FILTER (set = 'gen') AS m FROM z GROUP BY class),
ks AS (SELECT class, sum(k) FILTER (sa = 'real' AND sb = 'real' AND NOT diag) AS rr, sum(k) FILTER (sa = 'gen' AND sb = 'gen' AND NOT diag) AS gg, sum(k) FILTER (sa = 'real' AND sb = 'gen') AS rg FROM k GROUP BY class),
mmd AS (SELECT class, rr / (n * (n - 1) + 1e-12) + gg / (m * (m - 1) + 1e-12) - 2 * rg / (n * m) AS v FROM ks JOIN nm USING (class))"""

REPORT = f"""WITH {RAW}, {GEO}, {EYE}, {PSD}, {FEAT}, {DIST}, {HIST}, {KINDS}, {MMD},
exc AS (SELECT class, avg((v < 180)::INT) AS lo, avg((v > 310)::INT) AS hi, min(v) AS a, max(v) AS b FROM px WHERE set = 'gen' GROUP BY class),
cold AS (SELECT class, set, avg(s) AS a, stddev_pop(s) AS b FROM (SELECT class, set, id, avg((v < 200)::INT) AS s FROM cl GROUP BY ALL) GROUP BY class, set),
eyes AS (SELECT class, set, avg(ec) AS a, stddev_pop(ec) AS b FROM eye GROUP BY class, set),
band AS (SELECT class, set, kbin, avg(lp) AS m FROM spec GROUP BY ALL),
cdf AS (SELECT class, abs(sum(p - q) OVER (PARTITION BY class ORDER BY bin)) AS gap FROM pq),
n AS (SELECT class, unnest(['below_bt_min', 'above_bt_max', 'total', 'raw_min', 'raw_max']) AS key, unnest([lo, hi, lo + hi, a, b]) AS value, 'gen_exceedance_rate.' AS p FROM exc
UNION ALL SELECT class, unnest(['mean', 'std', 'skew', 'kurtosis', 'q01', 'q05', 'q50', 'q95', 'q99', 'min', 'max']), unnest([mean, std, skew, kurtosis, q[1], q[2], q[3], q[4], q[5], low, high]), p FROM stat
UNION ALL SELECT class, 'pixel_hist_js', 0.5 * sum(p * (ln(p + 1e-12) - ln((p + q) / 2 + 1e-12))) + 0.5 * sum(q * (ln(q + 1e-12) - ln((p + q) / 2 + 1e-12))), '' FROM pq GROUP BY class
UNION ALL SELECT class, 'pixel_hist_w1', sum(gap) * 130 / 128, '' FROM cdf GROUP BY class
UNION ALL SELECT class, unnest([set || '_mean', set || '_std']), unnest([a, b]), 'cold_cloud_fraction_200K.' FROM cold
UNION ALL SELECT class, unnest([set || '_mean', set || '_std']), unnest([a, b]), 'eye_contrast_proxy.' FROM eyes
UNION ALL SELECT a.class, 'psd_l2', avg((a.m - b.m) ** 2), '' FROM band a JOIN band b ON a.class = b.class AND a.kbin = b.kbin AND a.set = 'real' AND b.set = 'gen' GROUP BY a.class
UNION ALL SELECT class, 'feature_mmd2', v, '' FROM mmd
UNION ALL SELECT class, sa, avg(sqrt(d2)), 'diversity_feature_space.' FROM d WHERE sa = sb AND ia <> ib GROUP BY class, sa),
mac AS (SELECT 'macro.pixel_mean_bt.' AS p, class, max(value) FILTER (p || key = 'pixel_stats.real.mean') AS r, max(value) FILTER (p || key = 'pixel_stats.gen_raw.mean') AS g FROM n GROUP BY class
UNION ALL SELECT 'macro.eye_contrast_proxy.', class, max(value) FILTER (p || key = 'eye_contrast_proxy.real_mean'), max(value) FILTER (p || key = 'eye_contrast_proxy.gen_mean') FROM n GROUP BY class)
SELECT class, p || key AS key, {r('value', 5)} AS value FROM n
UNION ALL SELECT NULL, p || unnest(['corr_class_real', 'corr_class_gen', 'corr_real_gen', 'mae_gen_vs_real']), unnest([{r('corr(class, r)', 5)}, {r('corr(class, g)', 5)}, {r('corr(r, g)', 5)}, {r('avg(abs(r - g))', 5)}]) FROM mac GROUP BY p"""

CURVES = f"""WITH {RAW}, {GEO}, {PSD}, {HIST}, c AS (SELECT class, set, 'radial_mean_' AS curve, rbin AS bin, radial_mean AS v FROM ring UNION ALL SELECT class, set, 'radial_azstd_', rbin, azimuthal_std FROM ring UNION ALL SELECT class, set, 'psd_', kbin, lp FROM spec),
s AS (SELECT class, curve || set AS curve, bin, avg(v) AS mu, stddev_pop(v) AS sd FROM c GROUP BY class, set, curve, bin)
SELECT class, 'bt_bins' AS curve, b::INT AS bin, {r('180 + b * 130.0::DOUBLE / 128', 5)} AS value FROM (SELECT DISTINCT class FROM raw), range(129) t(b)
UNION ALL SELECT class, 'hist_' || set, bin, {r('p', 5)} FROM hist
UNION ALL SELECT class, curve || '_mu', bin, {r('mu', 5)} FROM s UNION ALL SELECT class, curve || '_sd', bin, {r('sd', 5)} FROM s"""

ORACLES |= {
    "evaluation_report": REPORT,
    "evaluation_curves": CURVES,
    "shuffle_buffer": "SELECT l_orderkey, l_linenumber, true AS in_reach FROM lineitem",
    "stream_alpha_change": f"""WITH {SNAP}, cnt AS (SELECT ss_cat, count(*) AS n FROM idx GROUP BY ss_cat), al AS (SELECT unnest([1.0, 0.7, 0.4])::DOUBLE AS a),
pw AS (SELECT a, ss_cat, n, pow(n / sum(n) OVER (PARTITION BY a), a) AS w FROM cnt, al), prob AS (SELECT a, ss_cat, n, w / sum(w) OVER (PARTITION BY a) AS prob FROM pw),
rng AS (SELECT a, ss_cat, n, sum(prob) OVER (PARTITION BY a ORDER BY ss_cat) - prob AS low, CASE WHEN ss_cat = max(ss_cat) OVER (PARTITION BY a) THEN 2 ELSE sum(prob) OVER (PARTITION BY a ORDER BY ss_cat) END AS high FROM prob),
dr AS (SELECT draw, CASE draw // 100 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 ELSE 0.4 END::DOUBLE AS a, {U} AS u, {hex_of('substr(h, 9, 8)')} / 4294967296.0::DOUBLE AS v FROM (SELECT draw, md5('42|' || draw) AS h FROM range(500) t(draw))),
pl AS (SELECT ss_cat, rel_path, row_number() OVER (PARTITION BY ss_cat ORDER BY rel_path) - 1 AS place FROM idx)
SELECT draw, rng.ss_cat, rel_path, a AS alpha FROM dr JOIN rng USING (a) JOIN pl ON pl.ss_cat = rng.ss_cat AND pl.place = floor(v * n) WHERE u >= low AND u < high""",
    "psd_stats": f"WITH {RAW}, {PSD} SELECT class, set, kbin, {r('avg(lp)', 5)} AS mu, {r('stddev_pop(lp)', 5)} AS sd FROM spec GROUP BY ALL",
    "groupnorm_affine": f"WITH {TILES} SELECT id, (p * 4 + c)::INT AS i, {r('v')} AS v FROM ({normed('x', 4, 3)})",
    "res_block": f"{_res(4).replace('WITH', 'SELECT * FROM (WITH', 1)}) UNION ALL SELECT * FROM ({_res(2)})",
    "attention_block": ATTENTION,
    "upsample_skip": f"WITH up AS ({ORACLES['upsample']}), c AS (SELECT id, i AS p, 0 AS c, v FROM up UNION ALL SELECT id, i, 1 + k, (2 * i + k + id)::DOUBLE FROM up, range(2) t(k)) SELECT id, (p // 16 * 3 + c)::INT AS i, {r('sum((p % 16 + 1) * v)')} AS v FROM c GROUP BY 1, 2",
    "early_stop_resumed": f"""WITH RECURSIVE days AS (SELECT user_id % 5 AS run, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS step, avg(value) AS f, avg(value) FILTER (event_id % 3 = 0) AS b FROM events GROUP BY ALL),
seq AS (SELECT run, step, CASE WHEN step % 7 <> 0 THEN f END AS f, b, row_number() OVER (PARTITION BY run ORDER BY step) AS r FROM days),
t AS (SELECT DISTINCT run, 0 AS r, NULL::BIGINT AS last, NULL::BIGINT AS fe, 'inf'::DOUBLE AS f, 0 AS bad, NULL::BIGINT AS be, 'inf'::DOUBLE AS b, NULL::BIGINT AS stop FROM days
UNION ALL SELECT t.run, seq.r, seq.step, CASE WHEN t.f - seq.f > 0.5 THEN seq.step ELSE t.fe END, CASE WHEN t.f - seq.f > 0.5 THEN seq.f ELSE t.f END, CASE WHEN seq.f IS NULL THEN t.bad WHEN t.f - seq.f > 0.5 THEN 0 ELSE t.bad + 1 END,
CASE WHEN t.b - seq.b > 0.5 THEN seq.step ELSE t.be END, CASE WHEN t.b - seq.b > 0.5 THEN seq.b ELSE t.b END, CASE WHEN seq.f IS NOT NULL AND NOT t.f - seq.f > 0.5 AND t.bad + 1 >= 6 THEN seq.step END
FROM t JOIN seq ON seq.run = t.run AND seq.r = t.r + 1 WHERE t.stop IS NULL)
SELECT run, last AS last_epoch, fe AS best_epoch, {r('f')} AS best_full, bad, be AS best_balanced_epoch, {r('b')} AS best_balanced, stop AS stopped_epoch FROM t QUALIFY row_number() OVER (PARTITION BY run ORDER BY t.r DESC) = 1""",
    "netcdf_index": f"""WITH f AS (SELECT (vec_id % 10) || '/' || vec_id || '-e.nc' AS rel_path, CASE WHEN vec_id % 17 <> 0 THEN (vec_id * 7 % 150)::DOUBLE END AS w FROM embeddings)
SELECT rel_path, {CAT.format(w="w")} AS ss_cat, {r("w")} AS wmo_wind_kt FROM f WHERE {CAT.format(w="w")} IS NOT NULL""",
    "netcdf_images": f"WITH {E} SELECT (id % 10) || '/' || id || '-e.nc' AS rel_path, 8 AS height, i, {r('v')} AS v FROM e",
    "packed_lookup": f"""WITH {E}, p AS (SELECT vec_id AS id, vec_id || '-e.nc' AS rel_path, label % 6 AS ss_cat FROM embeddings), g AS (SELECT *, row_number() OVER (ORDER BY rel_path) - 1 AS global_index FROM p)
SELECT rel_path, global_index, (global_index // 128)::INT AS shard_id, ss_cat::INT AS ss_cat, {r('sum(v)')} AS total FROM g JOIN e USING (id) GROUP BY ALL""",
}

# The schedules, embeddings and targets over the rows of tables.
STEPS = "st AS (SELECT vec_id AS id, (vec_id * 37 % 1000)::INT AS t FROM embeddings)"
ORACLES |= {
    "alpha_ramp": f"""WITH d AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS day, count(*) AS n FROM events GROUP BY 1), e AS (SELECT (day - min(day) OVER ())::INT AS e, n FROM d)
SELECT e AS epoch, n, {r('1 - 0.6::DOUBLE * (1 - cos(pi() * least(e / 39, 1))) / 2')} AS alpha, 'cosine' AS mode FROM e UNION ALL SELECT e, n, {r('1 - 0.6::DOUBLE * greatest(least((e - 5) / 19, 1), 0)')}, 'linear' FROM e""",
    "augment_policy": f"WITH p AS ({ORACLES['augment_policy']}) SELECT p.*, n FROM p JOIN (SELECT (label % 4)::INT AS ss_cat, count(*) AS n FROM embeddings GROUP BY 1) USING (ss_cat)",
    **{name: f"WITH p AS ({ORACLES[name]}), {STEPS} SELECT id, p.* FROM st JOIN p USING (t)" for name in ("beta_linear", "beta_cosine", "posterior_variance", "min_snr_weights")},
    "time_embedding": f"SELECT event_id, t::INT AS t, i, v FROM (SELECT event_id, event_id % 1000 AS t FROM events) JOIN ({ORACLES['time_embedding']}) USING (t)",
    "midpoint_general": f"SELECT vec_id AS id, p.* FROM embeddings JOIN ({ORACLES['midpoint_general']}) p ON p.label = embeddings.label % 10 - 1",
    "wind_targets": f"WITH {SNAP} SELECT rel_path, ss_cat, target FROM idx JOIN ({ORACLES['wind_targets']}) USING (ss_cat)",
    "ddpm_by_steps": f"""WITH RECURSIVE f AS (SELECT t, pow(cos((t / 12 + 0.008::DOUBLE) / 1.008::DOUBLE * pi() / 2), 2) AS f FROM range(13) q(t)),
be AS (SELECT a.t, least(greatest(1 - b.f / a.f, 1e-8), 0.999) AS beta FROM f a JOIN f b ON b.t = a.t + 1), ab AS (SELECT t, beta, product(1 - beta) OVER (ORDER BY t) AS abar FROM be), sc AS (SELECT *, beta * (1 - lag(abar, 1, 1.0) OVER (ORDER BY t)) / (1 - abar) AS post FROM ab),
a AS (SELECT vec_id AS id, CASE WHEN label < 6 THEN label ELSE 6 END AS label, CASE WHEN label < 6 THEN {MID.format(c='label')} ELSE 0 END AS wind FROM embeddings),
n AS MATERIALIZED (SELECT id, label, j::INT AS i, 0.06::DOUBLE + 1.5 * (0.01 * label + 0.001 * wind - 0.06::DOUBLE) AS c, list_transform(range(13), lambda k: ('0x' || substr(md5(id || '|' || k || '|' || j), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1) AS z FROM a, range(2) q(j)),
x AS (SELECT id, label, i, c, z, 11 AS t, z[1] AS x FROM n
UNION ALL SELECT id, label, i, c, z, t - 1, CASE WHEN t = 0 THEN greatest(least(x0, 1), -1) ELSE (x - beta / (sqrt(1 - abar) + 1e-8) * ((x - sqrt(abar) * x0) / (sqrt(1 - abar) + 1e-8))) / sqrt(1 - beta) + sqrt(post) * z[13 - t] END
  FROM (SELECT x.*, beta, abar, post, sqrt(abar) * x - sqrt(1 - abar) * (0.5 * x + c) AS x0 FROM x JOIN sc USING (t)))
SELECT id, label::INT AS label, i, {r('x')} AS v FROM x WHERE t = -1""",
}

# What was written to files and read again.
ORACLES |= {
    "scan_tree": "SELECT (vec_id % 10) || '/' || vec_id || '-e.nc' AS rel_path FROM embeddings",
    "tracks_csv": f"SELECT * REPLACE (SID::VARCHAR AS SID) FROM ({ORACLES['storm_table']})",
    "index_lines": ORACLES["point_lookup"],
    "path_classes": f"WITH {SNAP} SELECT rel_path, max(c)::INT AS ss_cat FROM (SELECT rel_path, ss_cat AS c FROM idx UNION ALL SELECT rel_path, (ss_cat + 1) % 6 FROM idx WHERE substr(md5('42|' || rel_path), 1, 1) < '2') GROUP BY rel_path",
    "split_lists": ORACLES["split_files"],
    "loss_history": f"WITH {DAYS} SELECT step::INT AS epoch, {r('avg(value)')} AS train_loss, {r('max(value)')} AS val_full, {r('min(value) FILTER (step % 2 = 0)')} AS val_balanced FROM days GROUP BY step",
    "condition_prepared": f"SELECT vec_id AS id, (label % 7)::INT AS label, {r('CASE WHEN vec_id % 3 <> 0 THEN vec_id WHEN label % 7 = 6 THEN 0 ELSE ' + MID.format(c='(label % 7)') + ' END')} AS wind_kt FROM embeddings",
    "epoch_rows": "SELECT vec_id AS row, label FROM embeddings WHERE vec_id < 160",
}
