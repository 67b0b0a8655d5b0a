"""DuckDB SQL with the rows of the registered queries, written from the formulas alone."""

from __future__ import annotations

from cadenza.operators import fir, loudness
from cadenza.operators.runs import VBR8, VBR12, Coding

EMB = "emb AS (SELECT vec_id AS stream, label, generate_subscripts(embedding, 1) - 1 AS idx, unnest(embedding)::double AS x FROM embeddings)"
EVT = "evt AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, greatest(-32767, least(32767, trunc((value - 50) * 64)::bigint))::int AS sample FROM events)"
LI = "li AS (SELECT l_suppkey AS stream, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS idx, trunc(l_extendedprice / 4)::int AS sample FROM lineitem)"
ORACLE: dict[str, str] = {}


def emb_scaled(n_bits: int) -> str:
    finer, least, most = ("", -128, 127) if n_bits == 8 else (" * (2047::double / 127)", -2047, 2047)
    return f"""{EMB}, sc AS (SELECT stream, greatest(1, least(255, trunc(max(abs(x)) / 1.0::double * 32767)::int >> 7)) AS s FROM emb GROUP BY stream),
    qs AS (SELECT stream, s, idx, x, greatest({least}, least({most}, trunc(x * (32767::double / (s + 1)){finer})::int)) AS q FROM emb JOIN sc USING (stream))"""


def emb_back(n_bits: int) -> str:
    return f"{emb_scaled(n_bits)}, back AS (SELECT *, q * ((s + 1) * 1.0::double / 32767){'' if n_bits == 8 else ' / (2047::double / 127)'} AS y FROM qs)"


for n_bits in (8, 12):
    ORACLE[f"quantize{n_bits}"] = f"WITH {emb_scaled(n_bits)} SELECT stream, s, idx::int AS idx, q FROM qs"
    ORACLE[f"snr{n_bits}"] = f"""WITH {emb_back(n_bits)}, r AS (SELECT stream, sqrt(avg(x * x)) AS a, sqrt(avg((x - y) * (x - y))) AS b FROM back GROUP BY stream)
    SELECT stream, round(a, 6) AS input_rms, round(b, 6) AS residual_rms, round(CASE WHEN b <= 1e-12 THEN 200.0 WHEN a <= 0 THEN 0.0 ELSE 20 * log10(a / b) END, 6) AS snr_db FROM r"""
ORACLE["dequantize8"] = f"WITH {emb_back(8)} SELECT stream, idx::int AS idx, round(y, 6) AS y FROM back"
ORACLE["squelch_gate"] = f"""WITH RECURSIVE {EMB}, gate(stream, idx, a, g, y) AS (
  SELECT stream, -1::bigint, 1.0::double, 1.0::double, 0.0::double FROM emb WHERE idx = 0
  UNION ALL
  SELECT t.stream, t.idx, t.a, t.g, t.x * t.g FROM (
    SELECT u.stream, u.idx, u.x, u.a, CASE WHEN u.a < 0.12::double / 3 THEN u.g * 0.95::double WHEN u.a > 0.12::double THEN u.g + (1 - u.g) * 0.5::double ELSE u.g END AS g
    FROM (SELECT e.stream, e.idx::bigint AS idx, e.x, (7 * gate.a + abs(e.x)) / 8 AS a, gate.g FROM gate JOIN emb e ON e.stream = gate.stream AND e.idx = gate.idx + 1) u) t)
SELECT stream, idx::int AS idx, round(y, 6) AS y FROM gate WHERE idx >= 0"""

# Frames: frame k begins at sample round(k * rate * ms / 1000), here 110.25 k.
FRAMED = f"{LI}, fr AS (SELECT stream, idx, sample, max(k) AS k FROM (SELECT stream, idx, sample, unnest([floor(idx / 110.25::double)::int - 1, floor(idx / 110.25::double)::int, floor(idx / 110.25::double)::int + 1]) AS k FROM li) WHERE floor(k * 110.25::double + 0.5) <= idx AND k >= 0 GROUP BY stream, idx, sample), ff AS (SELECT stream, k AS frame_idx, min(idx) AS pcm_start, count(*) AS n_pcm, max(sample) AS peak, sum(sample) AS total FROM fr GROUP BY stream, k)"
TICKED = f"{FRAMED}, tk AS (SELECT stream, frame_idx, n_pcm // 4 AS n, coalesce(sum(n_pcm // 4) OVER (PARTITION BY stream ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS tick FROM ff)"
ORACLE["frames"] = f"WITH {FRAMED} SELECT stream, frame_idx, pcm_start::bigint AS pcm_start, n_pcm, peak, total::bigint AS total FROM ff"
ORACLE["frame_plan"] = f"""WITH {LI}, t AS (SELECT stream, count(*) AS total FROM li GROUP BY stream), n AS (SELECT *, ceil(total * 1000.0::double / 11025 / 10)::bigint AS n FROM t), k AS (SELECT stream, total, n, unnest(range(0, n))::int AS frame_idx FROM n)
SELECT stream, total, frame_idx, least(floor(frame_idx * 110.25::double + 0.5)::bigint, total) AS pcm_start, least(CASE WHEN frame_idx + 1 >= n THEN total ELSE floor((frame_idx + 1) * 110.25::double + 0.5)::bigint END, total) - least(floor(frame_idx * 110.25::double + 0.5)::bigint, total) AS n_pcm FROM k"""
ORACLE["ticks"] = f"WITH {TICKED} SELECT stream, frame_idx, n, tick FROM tk"
ORACLE["seek_lookup"] = f"""WITH {TICKED}, pr AS (SELECT stream, unnest(range(0, max(tick + n), 7))::bigint AS "at" FROM tk GROUP BY stream)
SELECT pr.stream, pr."at", max(tk.frame_idx) AS frame_idx FROM pr JOIN tk ON tk.stream = pr.stream AND tk.tick <= pr."at" GROUP BY pr.stream, pr."at" """
ORACLE["frame_lengths"] = f"WITH {TICKED} SELECT stream, frame_idx, tick, n AS length FROM tk"
ORACLE["rate_counts"] = """SELECT n, n // 2 AS by2, n // 4 AS by4, n * 4 AS up4, CASE WHEN n <= 0 THEN 0 ELSE (n * 40 - 1) // 147 + 1 END AS down44, CASE WHEN n <= 0 THEN 0 ELSE (n * 147 - 1) // 40 + 1 END AS up44,
(n + 256) * 40 // 147 + CASE WHEN (n + 256) * 40 % 147 > 0 THEN 1 ELSE 0 END - (n * 40 // 147 + CASE WHEN n * 40 % 147 > 0 THEN 1 ELSE 0 END) AS next256, ceil(n * 1000.0::double / 11025 / 10)::bigint AS frames, 64 + 16 * n AS "offset" FROM (SELECT unnest(range(0, 3000))::bigint AS n)"""
ORACLE["size_bounds"] = """SELECT n, n + 1 AS scaled8, 2 * n + 1 AS scaled12, ((n - 1) * 8 + 19 + 7) // 8 AS vbr8, ((n - 1) * 12 + 28 + 7) // 8 AS vbr12, 2 * n AS raw16, round(n / 48000::double, 9) AS seconds FROM (SELECT unnest(range(1, 600))::bigint AS n)"""


def packed(source: str, table: str, sample: str, size: int, n_bits: int) -> str:
    """Values of packets: pk(stream, packet, i, q, n), with n deltas in a packet."""
    finer, least, most = ("", -128, 127) if n_bits == 8 else (" * (2047::double / 127)", -2047, 2047)
    return f"""{source}, pp AS (SELECT stream, (idx // {size})::int AS packet, idx, {sample} AS sample FROM {table}),
    ps AS (SELECT stream, packet, greatest(1, least(255, trunc(max(abs(sample)) / 32767::double * 32767)::int >> 7)) AS s, min(idx) AS f, count(*) - 1 AS n FROM pp GROUP BY stream, packet),
    pk AS (SELECT stream, packet, (idx - f)::int AS i, s, n::int AS n, greatest({least}, least({most}, trunc(sample::double * ((32767::double / 32767) / (s + 1)){finer})::int)) AS q FROM pp JOIN ps USING (stream, packet))"""


def width(d: str, n_bits: int) -> str:
    return "CASE " + " ".join(f"WHEN abs({d}) < {1 << (b - 1)} THEN {b}" for b in range(3, n_bits)) + f" ELSE {n_bits} END"


def deltas(base: str, n_bits: int) -> str:
    """Deltas dl(stream, packet, i, delta, width, nx, n), and off(stream, packet, wrong): deltas that are the end mark.

    Such a delta is written one higher, or one lower if its value is the top
    one; the next makes good for it.
    """
    half = 1 << (n_bits - 1)
    now = f"((y.c + a.c + {half}) & {2 * half - 1}) - {half}"
    step = f"""CASE WHEN {now} <> {-half} THEN {{'c': 0, 'x': a.x, 'o': list_append(a.o, {now})}}
      WHEN y.x = {half - 1} THEN {{'c': 1, 'x': a.x + 1, 'o': list_append(a.o, {half - 1})}} ELSE {{'c': -1, 'x': a.x + 1, 'o': list_append(a.o, {1 - half})}} END"""
    return f"""{base}, d0 AS (SELECT stream, packet, i - 1 AS i, n, q AS nx, ((q - lag(q) OVER (PARTITION BY stream, packet ORDER BY i) + {half}) & {2 * half - 1}) - {half} AS delta FROM pk),
    d1 AS (SELECT stream, packet, list({{'c': delta::int, 'x': nx::int, 'o': []::int[]}} ORDER BY i) AS l FROM d0 WHERE i >= 0 GROUP BY stream, packet HAVING bool_or(delta = {-half})),
    d2 AS (SELECT stream, packet, list_reduce(l, lambda a, y: {step}, {{'c': 0::int, 'x': 0::int, 'o': []::int[]}}) AS r FROM d1),
    d3 AS (SELECT stream, packet, generate_subscripts(r.o, 1) - 1 AS i, unnest(r.o) AS fixed FROM d2), off AS (SELECT stream, packet, r.x AS wrong FROM d2),
    d4 AS (SELECT stream, packet, i, n, nx, coalesce(fixed, delta) AS delta FROM d0 LEFT JOIN d3 USING (stream, packet, i) WHERE i >= 0),
    dl AS (SELECT stream, packet, i, n, nx, delta, {width("delta", n_bits)} AS width FROM d4)"""


def coded(base: str, c: Coding) -> str:
    """Codes cd(..., code, silent, covered) of deltas, from the nearest breaks of a run."""
    back, ahead = "(PARTITION BY stream, packet ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(PARTITION BY stream, packet ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    near = lambda name, test: f"coalesce(max(CASE WHEN {test} THEN i END) OVER {back}, -1) AS a{name}, coalesce(min(CASE WHEN {test} THEN i END) OVER {ahead}, n) AS b{name}"
    levels = range(c.top, 2, -1)
    cases = " ".join(f"WHEN width <= {k} AND b{k} - a{k} - 1 > {c.least[k - 1]} THEN {k - 1}" for k in reversed(levels))
    return f"""{base}, nr AS (SELECT *, {", ".join(near(str(k), f"width > {k}") for k in levels)}, {near("z", "nx <> 0")} FROM dl),
    sl AS (SELECT stream, packet, i, n, CASE {cases} ELSE {c.top} END AS code, nx = 0 AS quiet, i - az - 1 AS place, bz - az - 1 AS size, bz = n AS tail FROM nr),
    s2 AS (SELECT *, CASE WHEN tail THEN (size + 15) // 16 * 16 ELSE size // 16 * 16 END AS longs FROM sl),
    s3 AS (SELECT *, quiet AND place < longs AS inl, quiet AND place >= longs AND place - longs < (size - longs) // 4 * 4 AS ins FROM s2),
    cd AS (SELECT stream, packet, i, n, code, CASE WHEN inl AND place % 16 = 0 THEN 1 WHEN ins AND (place - longs) % 4 = 0 THEN 0 END AS silent, inl OR ins AS covered FROM s3)"""


def costs(base: str, c: Coding) -> str:
    """Bits bc(stream, packet, silent_codes, delta_runs, deltas_coded, bits) of coded packets."""
    order = "(PARTITION BY stream, packet ORDER BY i)"
    return f"""{coded(base, c)}, ed AS (SELECT *, CASE WHEN NOT covered THEN code END AS own, lag(CASE WHEN NOT covered THEN code END) OVER {order} AS pv, lead(CASE WHEN NOT covered THEN code END) OVER {order} AS nt FROM cd),
    mk AS (SELECT *, own IS NOT NULL AND (pv IS NULL OR pv <> own) AS fi, own IS NOT NULL AND i < n - 1 AND (nt IS NULL OR nt <> own) AS la FROM ed),
    bc AS (SELECT stream, packet, count(silent) AS silent_codes, count(*) FILTER (fi) AS delta_runs, count(own) AS deltas_coded,
      (sum(coalesce(own + 1, 0) + CASE WHEN la THEN own + 1 ELSE 0 END + CASE WHEN fi OR silent IS NOT NULL THEN {c.code_bits} ELSE 0 END) + {c.head_bits})::bigint AS bits FROM mk GROUP BY stream, packet)"""


QUIET = "CASE WHEN idx % 41 < 23 THEN 0 ELSE sample END"
for c in (VBR8, VBR12):
    b = c.bits
    ORACLE[f"delta_width{b}"] = f"WITH {deltas(packed(LI, 'li', 'sample', 256, b), b)} SELECT stream, packet, i, delta, width FROM dl"
    event = deltas(packed(EVT, "evt", QUIET, 64, b), b)
    ORACLE[f"payload_bits{b}"] = f"WITH {costs(event, c)} SELECT stream, packet, silent_codes, delta_runs, deltas_coded, bits, (bits + 7) // 8 AS bytes FROM bc"
    # A packet of one sample has a head and no deltas.  A value is off, by one, where the delta is the end mark.
    ORACLE[f"vbr_roundtrip{b}"] = f"""WITH {costs(event, c)} SELECT stream, count(*) AS packets, sum(n + 1)::bigint AS samples, sum(coalesce((bits + 7) // 8, {c.head_bits // 8}))::bigint AS bytes, sum(coalesce(wrong, 0))::bigint AS wrong, sum(coalesce(wrong, 0))::bigint AS error
    FROM ps LEFT JOIN bc USING (stream, packet) LEFT JOIN off USING (stream, packet) GROUP BY stream"""
ORACLE["delta_histogram"] = f"WITH {deltas(packed(LI, 'li', 'sample', 256, 8), 8)} SELECT delta, count(*) AS n, max(width) AS width FROM dl GROUP BY delta"
ORACLE["symbol_ranges"] = f"WITH {deltas(packed(LI, 'li', 'sample', 256, 8), 8)}, s AS (SELECT CASE WHEN delta > 0 THEN 2 * delta - 1 ELSE -2 * delta END AS symbol, count(*) AS n FROM dl GROUP BY 1) SELECT symbol, n, coalesce(sum(n) OVER (ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS \"before\" FROM s"
EVENT8 = deltas(packed(EVT, "evt", QUIET, 64, 8), 8)
ORACLE["bitrun_codes"] = f"WITH {coded(EVENT8, VBR8)} SELECT stream, packet, i, code FROM cd"
ORACLE["silent_runs"] = f"WITH {coded(EVENT8, VBR8)} SELECT stream, packet, i, silent FROM cd WHERE silent IS NOT NULL"
ORACLE["bitrate"] = f"""WITH {costs(deltas(packed(LI, "li", "sample", 256, 8), 8), VBR8)}, r AS (SELECT stream, sum(coalesce((bits + 7) // 8, 2))::bigint AS bytes, sum(n + 1)::bigint AS samples, count(*) AS packets FROM ps LEFT JOIN bc USING (stream, packet) GROUP BY stream)
SELECT stream, bytes, samples, packets, round((samples + packets) / bytes::double, 6) AS ratio, round(bytes * 8 / (samples / 12000::double) / 1000, 6) AS kbps FROM r"""
ORACLE["bit_fields"] = f"""SELECT v, {", ".join(f"CASE WHEN v & {(1 << k) - 1} >= {1 << (k - 1)} THEN (v & {(1 << k) - 1}) - {1 << k} ELSE v & {(1 << k) - 1} END AS s{k}" for k in (3, 5, 8, 12))}, {width("(v - 2048)", 12)} AS w12, {width("(((v + 128) & 255) - 128)", 8)} AS w8,
CASE WHEN v > 2048 THEN 2 * (v - 2048) - 1 ELSE -2 * (v - 2048) END AS mapped, CASE WHEN v % 2 = 1 THEN (v + 1) // 2 ELSE -(v // 2) END AS unmapped, ((v + 128) & 255) - 128 AS wrapped FROM (SELECT unnest(range(0, 4096))::int AS v)"""

ORACLE["fir4_short"] = f"""WITH {EMB}, c(j, c) AS (VALUES (0, 0.1::double), (1, 0.25::double), (2, 0.3::double), (3, 0.25::double), (4, 0.1::double)),
t AS (SELECT stream, idx, idx - 4 * m AS j, m, x FROM (SELECT stream, idx, x, unnest([idx // 4, idx // 4 - 1]) AS m FROM emb) WHERE m >= 0)
SELECT t.stream, t.m::int AS idx, round(sum(t.x * c.c) / sum(c.c), 6) AS y FROM t JOIN c ON c.j = t.j GROUP BY t.stream, t.m"""
ORACLE["expand4_linear"] = f"""WITH {EMB}, p AS (SELECT stream, idx, x, lag(x, 1, 0.0::double) OVER (PARTITION BY stream ORDER BY idx) AS b FROM emb), w AS (SELECT *, unnest([1, 2, 3, 4]) AS k FROM p)
SELECT stream, (4 * idx + k - 1)::int AS idx, round(b * (1 - k / 4::double) + x * (k / 4::double), 6) AS y FROM w"""


def resampled(kind: str, places: int) -> str:
    """Output m sums h[(m * down + delay) - n * up] * up * x[n], from the coefficients as numbers."""
    r = fir.RESAMPLERS[kind]
    taps = fir.prototype(r.name)
    values = ", ".join(f"({i}, {c * r.up!r}::double)" for i, c in enumerate(map(float, taps)))
    count = f"64 // {r.down}" if r.up == 1 else f"(64 * {r.up} - 1) // {r.down} + 1"
    return f"""WITH {EMB}, h(i, h) AS (VALUES {values}), g AS (SELECT m, n, m * {r.down} + {r.delay} - n * {r.up} AS i FROM (SELECT unnest(range(0, {count})) AS m), (SELECT unnest(range(0, 64)) AS n)), w AS (SELECT g.m, g.n, h.h FROM g JOIN h ON h.i = g.i)
    SELECT stream, w.m::int AS idx, round(sum(w.h * x), {places}) AS y FROM emb JOIN w ON w.n = emb.idx GROUP BY stream, w.m"""


def oracle() -> dict[str, str]:
    """All SQL; the filters' coefficients are worked out when asked for."""
    return ORACLE | {f"fir_{k}": resampled(k, 5) for k in fir.RESAMPLERS} | {"fir_join": resampled("decimate2", 5)} | {"fir_frames": framed_sql()}


def framed_sql() -> str:
    values = ", ".join(f"({i}, {float(c)!r}::double)" for i, c in enumerate(fir.prototype("4x")))
    return f"""WITH {LI}, h(i, h) AS (VALUES {values}), t AS (SELECT stream, max(idx) + 1 AS n FROM li GROUP BY stream), o AS (SELECT stream, unnest(range(0, (n + 3) // 4)) AS m FROM t)
    SELECT o.stream, o.m::bigint AS m, round(sum(h.h * li.sample), 3) AS y FROM o JOIN li ON li.stream = o.stream AND li.idx <= 4 * o.m AND li.idx > 4 * o.m - 128 JOIN h ON h.i = 4 * o.m - li.idx GROUP BY o.stream, o.m"""


PAIR = f"{EVT}, a AS (SELECT stream, idx, sample::double AS x FROM evt), b AS (SELECT stream, idx + 3 AS idx, x * 0.96875::double + idx % 5 AS x FROM a)"
for name, lags in (("best_delay", "range(0, 9)"), ("best_delay_coarse", "range(-13, 14)")):
    ORACLE[name] = f"""WITH {PAIR}, l AS (SELECT stream, idx, x, unnest({lags}) AS d FROM a), m AS (SELECT l.stream, l.d, avg((l.x - b.x) * (l.x - b.x)) AS mse FROM l JOIN b ON b.stream = l.stream AND b.idx = l.idx + l.d GROUP BY l.stream, l.d),
    k AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY mse, d) AS r FROM m) SELECT stream, d::int AS delay, round(mse, 4) AS mse FROM k WHERE r = 1"""
ORACLE["residual"] = f"""WITH {PAIR}, p AS (SELECT a.stream, a.x AS r, b.x - a.x AS e FROM a JOIN b ON b.stream = a.stream AND b.idx = a.idx + 3)
SELECT stream, round(CASE WHEN sqrt(avg(r * r)) > 0 THEN sqrt(avg(e * e)) / sqrt(avg(r * r)) END, 6) AS ratio FROM p GROUP BY stream UNION ALL SELECT NULL, round(sqrt(avg(e * e)) / sqrt(avg(r * r)), 6) FROM p"""
ORACLE["window_ratio_stats"] = f"""WITH {LI}, t AS (SELECT *, count(*) OVER (PARTITION BY stream) AS total FROM li), e AS (SELECT stream, idx, total, sample::double AS r, sample * 0.96875::double + idx % 5 - sample AS e FROM t),
w AS (SELECT stream, total, r, e, idx, unnest([idx // 64 - 1, idx // 64]) AS w FROM e), v AS (SELECT stream, w, sqrt(avg(r * r)) AS a, sqrt(avg(e * e)) AS b FROM w WHERE w >= 0 AND idx >= 64 * w AND idx < 64 * w + 128 AND 64 * w + 128 <= total GROUP BY stream, w), q AS (SELECT stream, b / a AS ratio FROM v WHERE a >= 1e-3)
SELECT stream, count(*) AS windows, round(avg(ratio), 6) AS mean, round(max(ratio), 6) AS peak, round(quantile_cont(ratio, 0.5), 6) AS median, round(quantile_cont(ratio, 0.99), 6) AS p99 FROM q GROUP BY stream"""


def spectrum(low: int, high: int) -> str:
    return f"sp{low} AS (SELECT stream, k, CASE WHEN k > 0 AND k < 32 THEN sqrt(power(sum(x * cos(2 * pi() * k * idx / 64::double)), 2) + power(sum(x * sin(2 * pi() * k * idx / 64::double)), 2)) ELSE 0.0 END AS size FROM (SELECT *, unnest(range({low}, {high + 1})) AS k FROM emb) GROUP BY stream, k)"


def lagged(low: int, high: int) -> str:
    return f"lg AS (SELECT a.stream, d, sum(a.x * b.x) AS c FROM (SELECT *, unnest(range({low}, {high + 1})) AS d FROM emb) a JOIN emb b ON b.stream = a.stream AND b.idx = a.idx + a.d GROUP BY a.stream, d), pl AS (SELECT stream, d AS lag, row_number() OVER (PARTITION BY stream ORDER BY c DESC, d) AS r FROM lg)"


ORACLE["goertzel_bins"] = f"WITH {EMB}, {spectrum(0, 31)} SELECT stream, k::int AS k, round(size, 5) AS size FROM sp0"
ORACLE["band_energy"] = f"WITH {EMB}, {spectrum(4, 12)} SELECT stream, round(sum(size * size), 5) AS energy FROM sp4 GROUP BY stream"
ORACLE["pitch_lag"] = f"WITH {EMB}, {lagged(2, 20)} SELECT stream, lag::int AS lag FROM pl WHERE r = 1"
ORACLE["band_spill"] = f"""WITH {EMB}, {spectrum(24, 31)}, {spectrum(2, 20)}, g AS (SELECT stream, sum(size * size) AS g FROM sp24 GROUP BY stream), e AS (SELECT stream, sum(size * size) AS e FROM sp2 GROUP BY stream)
SELECT stream % 10 AS "by", count(*) AS windows, round(10 * log10(greatest(avg(g / e), 1e-18)), 4) AS spill_db FROM g JOIN e USING (stream) WHERE e > 1e-18 GROUP BY stream % 10"""
ORACLE["harmonic_ratio"] = f"""WITH {EMB}, {lagged(12, 40)}, f AS (SELECT stream, lag, unnest([1, 2, 3, 4, 5]) AS h FROM pl WHERE r = 1 AND 64::double / lag * 5 < 32),
s AS (SELECT f.stream, f.h, sqrt(power(sum(x * cos(2 * pi() * (h * 64::double / lag) * idx / 64::double)), 2) + power(sum(x * sin(2 * pi() * (h * 64::double / lag) * idx / 64::double)), 2)) AS size FROM f JOIN emb ON emb.stream = f.stream GROUP BY f.stream, f.h),
t AS (SELECT stream, max(CASE WHEN h = 1 THEN size END) AS f, sum(CASE WHEN h > 1 THEN size * size END) AS p FROM s GROUP BY stream)
SELECT stream % 10 AS "by", count(*) AS windows, round(20 * log10(greatest(avg(sqrt(p) / f), 1e-12)), 3) AS thd_db FROM t WHERE f >= 1e-9 GROUP BY stream % 10"""
ORACLE["gain_crossing"] = f"""WITH {EVT}, p AS (SELECT stream, idx, sample::double AS g, lag(idx) OVER w AS f0, lag(sample::double) OVER w AS g0 FROM evt WINDOW w AS (PARTITION BY stream ORDER BY idx)), h AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY idx) AS r FROM p WHERE g0 >= 0 AND g < 0)
SELECT stream, round(f0 + (g0 - 0) / (g0 - g) * (idx - f0), 6) AS "at" FROM h WHERE r = 1"""

ORACLE["pcm_convert"] = """WITH a AS (SELECT id * 53000 AS x FROM (SELECT unnest(range(-40000, 40000, 7))::bigint AS id)), b AS (SELECT x, x / 2200000000.0::double AS f, greatest(least(x, 2147483647), -2147483648) >> 16 AS h FROM a)
SELECT x, h AS from32, greatest(-8388608, least(8388607, x)) >> 8 AS from24, h * 256 AS to24, h * 65536 AS to32, round(h / 32767::double, 9) AS float16, trunc(greatest(-1.0::double, least(1.0::double, f)) * 32767)::bigint AS back16,
trunc(greatest(-1.0::double, least(1.0::double, f * 2)) * 8388607)::bigint AS back24, greatest(-128, least(127, h)) + 128 AS u8, (h >> 8) + 128 AS u8scaled, greatest(-128, least(127, h)) AS s16, greatest(-128, least(127, h)) AS s8, trunc(greatest(-1.0::double, least(1.0::double, f)) * 127)::int + 128 AS f8, h + 32768 AS u16 FROM b"""
CHANNELS = "ch AS (SELECT label AS stream, vec_id AS channel, generate_subscripts(embedding, 1) - 1 AS idx, unnest(embedding)::double AS sample FROM embeddings WHERE label IS NOT NULL)"
ORACLE["mono_mixdown"] = f"WITH {CHANNELS} SELECT stream, idx::int AS idx, round(avg(sample), 7) AS sample FROM ch GROUP BY stream, idx"
ORACLE["channel_alignment"] = f"WITH {CHANNELS}, n AS (SELECT stream, channel, count(*) AS n FROM ch GROUP BY stream, channel) SELECT stream, count(DISTINCT n) = 1 AS aligned, max(n) AS n FROM n GROUP BY stream"
ORACLE["concat_tracks"] = f"WITH {EVT} SELECT stream // 10 AS album, stream AS track, row_number() OVER (PARTITION BY stream // 10 ORDER BY stream, idx) - 1 AS idx, sample FROM evt"
LOUD = "lo AS (SELECT s_suppkey AS album, (-30 + s_suppkey % 25 + 0.25)::double AS loudness, (-12 + s_suppkey % 13)::double AS peak FROM supplier)"
ORACLE["gain_db"] = f"WITH {LOUD}, g AS (SELECT album, -16 - loudness AS w, least(-16 - loudness, -1 - peak) AS gain FROM lo) SELECT album, round(gain, 2) AS gain_db, gain < w - 1e-6 AS peak_capped FROM g"
ORACLE["trim_join"] = "SELECT s_suppkey AS album, CASE WHEN s_suppkey % 6 = 0 THEN ((s_suppkey % 7 - 3)::varchar || '.5')::double ELSE 0.0::double END AS trim_db FROM supplier"
PATHS = """pa AS (SELECT p_partkey AS k, CASE WHEN k % 3 = 0 THEN (k % 4)::varchar || '-' || lpad((k % 20)::varchar, 2, '0') || ' Song ' || k::varchar WHEN k % 3 = 1 THEN lpad((k % 20)::varchar, 2, '0') || ' Tune ' || k::varchar ELSE 'Bonus ' || k::varchar END AS stem,
'/music/' || CASE WHEN k % 7 = 0 THEN 'done' ELSE 'Artist' END || '/A' || (k % 10)::varchar AS album, CASE WHEN k % 5 = 0 THEN '.WAV' WHEN k % 11 = 0 THEN '.txt' ELSE '.wav' END AS ext FROM part)"""
ORACLE["track_sort"] = f"""WITH {PATHS}, t AS (SELECT album || '/' || stem || ext AS path, album, CASE WHEN k % 3 = 0 THEN k % 4 WHEN k % 3 = 1 THEN 0 ELSE 9999 END::int AS disc, CASE WHEN k % 3 = 2 THEN 9999 ELSE k % 20 END::int AS number, lower(stem) AS title FROM pa)
SELECT *, row_number() OVER (PARTITION BY album ORDER BY disc, number, title, path)::int AS place FROM t"""
ORACLE["path_filter"] = f"WITH {PATHS} SELECT album || '/' || stem || ext AS path, stem, '/out' || substr(album, 7) || '/' || stem || '.pkt' AS target FROM pa WHERE lower(ext) = '.wav' AND album NOT LIKE '/music/done/%'"
ORACLE["files_left"] = f"WITH {PATHS} SELECT album || '/' || stem || ext AS path FROM pa WHERE album NOT LIKE '/music/done/%'"
ORACLE["album_folders"] = f"WITH {PATHS} SELECT album, count(*) AS tracks FROM pa WHERE lower(ext) = '.wav' GROUP BY album"
ORACLE["report_numbers"] = "SELECT s_suppkey, ((-s_suppkey % 30)::varchar || '.5')::double AS integrated, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 7.8::double END AS span FROM supplier"
ORACLE["level_db"] = f"WITH {EMB}, r AS (SELECT stream, sqrt(avg(x * x)) AS r FROM emb GROUP BY stream) SELECT stream, round(CASE WHEN r > 0 THEN 20 * log10(r) ELSE '-inf'::double END, 6) AS db FROM r"

SOUND = f"{LI}, so AS (SELECT stream::varchar AS file, unnest([0, 1]) AS channel, count(*)::int AS n FROM li GROUP BY stream)"
for name, n_bits in (("wav_roundtrip", 16), ("wav24_roundtrip", 24), ("aiff_roundtrip", 16)):
    ORACLE[name] = f"WITH {SOUND} SELECT file, channel, n, {n_bits} AS bits, true AS same FROM so"
# Frames of 5 ms at 48 kHz have 240 samples, 60 compressed ones.
ORACLE["container_roundtrip"] = f"WITH {SOUND} SELECT file, channel, (n // 240 * 60 + n % 240 // 4)::bigint AS comp_samples, ((n + 239) // 240 - CASE WHEN n % 240 BETWEEN 1 AND 3 THEN 1 ELSE 0 END)::int AS frames, n, 2 AS channels, 48000::bigint AS pcm_sample_rate FROM so"
ORACLE["container_seek"] = f"WITH {SOUND}, k AS (SELECT file, unnest(range(0, (n + 239) // 240 - CASE WHEN n % 240 BETWEEN 1 AND 3 THEN 1 ELSE 0 END)) AS frame_idx FROM so WHERE channel = 0) SELECT file, frame_idx::int AS frame_idx, (60 * frame_idx)::bigint AS tick FROM k"
ORACLE["streaming_equals_batch"] = f"WITH {LI} SELECT stream, ((count(*) + 3) // 4)::bigint AS outputs, true AS same FROM li GROUP BY stream"

ORACLE["sink_roundtrip"] = f"WITH {SOUND} SELECT file, 'disc' || (file::bigint % 3)::varchar AS folder, count(*) AS channels, sum(n)::bigint AS samples FROM so GROUP BY file"
ORACLE["ixml_roundtrip"] = f"WITH {SOUND} SELECT file, unnest(['wav', 'aiff']) AS form, CASE WHEN file::bigint % 2 = 0 THEN '<take>é ' || file || '</take>' END AS ixml FROM so WHERE channel = 0"
ORACLE["raw_codec"] = f"WITH {SOUND} SELECT file, channel, n, true AS same FROM so"
ORACLE["scaled_codec"] = f"WITH {SOUND} SELECT file, channel, n, true AS close FROM so"
ORACLE["range_coding"] = f"WITH {packed(LI, 'li', 'sample', 256, 8)} SELECT stream, count(*) AS packets, sum(n)::bigint AS symbols, true AS same, true AS whole FROM ps WHERE n > 0 GROUP BY stream"



def album_loudness() -> str:
    """Both weighting sections as recurrences over samples, blocks of 320 each 80, gates, and a fourfold sinc for the peak."""
    (b, a), (c, d) = ([[repr(float(v)) + "::double" for v in row] for row in section] for section in loudness.weighting(800))
    return f"""WITH RECURSIVE {LI}, s AS MATERIALIZED (SELECT stream, idx::bigint AS idx, sample / 32768::double AS x FROM li), f(stream, idx, x, x1, u, u1, y, y1) AS (
  SELECT DISTINCT stream, -1::bigint, 0::double, 0::double, 0::double, 0::double, 0::double, 0::double FROM s
  UNION ALL
  SELECT stream, idx, xn, x, un, u, {c[0]} * un + {c[1]} * u + {c[2]} * u1 - {d[1]} * y - {d[2]} * y1, y FROM (
    SELECT s.stream, s.idx, s.x AS xn, f.x, f.u, f.u1, f.y, f.y1, {b[0]} * s.x + {b[1]} * f.x + {b[2]} * f.x1 - {a[1]} * f.u - {a[2]} * f.u1 AS un FROM f JOIN s ON s.stream = f.stream AND s.idx = f.idx + 1)),
k AS (SELECT stream, y, unnest(range(greatest(0, (idx - 319 + 79) // 80), idx // 80 + 1)) AS k FROM f WHERE idx >= 0),
p AS (SELECT stream // 10 AS album, avg(y * y) AS p FROM k GROUP BY stream, k HAVING count(*) = 320),
l AS (SELECT album, p, -0.691 + 10 * log10(p) AS l FROM p WHERE p > 0), g AS (SELECT album, -0.691 + 10 * log10(avg(p)) - 10 AS g FROM l WHERE l > -70 GROUP BY album),
i AS (SELECT album, round(-0.691 + 10 * log10(avg(p)), 4) AS i FROM l JOIN g USING (album) WHERE l > -70 AND l > g GROUP BY album),
h AS (SELECT n % 4 AS p, n // 4 AS j, CASE WHEN n = 48 THEN 1 ELSE sin(pi() * (n - 48) / 4) / (pi() * (n - 48) / 4) END * bessel(w) / bessel(1) AS h FROM (SELECT n, sqrt(greatest(0, 1 - pow(2 * n / 96::double - 1, 2))) AS w FROM (SELECT unnest(range(0, 97)) AS n))),
o AS (SELECT stream, abs(sum(h.h * s.x)) AS v FROM s, h GROUP BY stream, p, s.idx + j), t AS (SELECT stream // 10 AS album, max(v) AS v FROM (SELECT stream, v FROM o UNION ALL SELECT stream, abs(x) FROM s) GROUP BY album),
n AS (SELECT stream // 10 AS album, count(DISTINCT stream)::int AS tracks FROM s GROUP BY album)
SELECT n.album::varchar AS album, tracks, i AS integrated_lufs, round(20 * log10(v), 4) AS true_peak_dbtp FROM n JOIN t USING (album) LEFT JOIN i USING (album)""".replace("bessel(w)", BESSEL.format("w")).replace("bessel(1)", BESSEL.format("1"))


#: The modified Bessel function of order 0 at 8 times a number, by its series.
BESSEL = "list_sum(list_transform(range(0, 31), lambda k: pow(pow(4 * {}, k) / factorial(k::int), 2)))"
ORACLE["album_loudness"] = album_loudness()
#: The 2X filter h(i, h) by its formula: a sinc under a Kaiser window, of unit sum.
TWICE = """raw AS (SELECT i, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t) / (pi() * t) END * list_sum(list_transform(range(0, 31), lambda k: pow(pow(4 * w, k) / factorial(k::int), 2))) AS h
  FROM (SELECT i, (i - 63.5::double) * 20000 / 48000 AS t, sqrt(greatest(0, 1 - pow(2 * i / 127::double - 1, 2))) AS w FROM (SELECT unnest(range(0, 128)) AS i))),
h AS (SELECT i, h / (SELECT sum(h) FROM raw) AS h FROM raw)"""
ORACLE["fir_table"] = f"WITH {TWICE} SELECT '2x' AS filter, (i % 2)::int AS phase, (i // 2)::int AS tap, round(h, 9) AS h FROM h"
ORACLE["sweep_3db"] = f"""WITH {TWICE}, f AS (SELECT unnest([1000, 2000, 4000, 6000, 8000, 8500, 9000, 9250, 9500, 9750, 10000, 11000, 12000])::double AS f),
x AS (SELECT f, n, 0.5::double * sin(2 * pi() * f * n / 48000) AS x FROM f, (SELECT unnest(range(0, 8192)) AS n)),
lows AS (SELECT x.f, (x.n + h.i) // 2 AS m, sum(h.h * x.x) AS y FROM x JOIN h ON (x.n + h.i) % 2 = 0 GROUP BY 1, 2 HAVING (x.n + h.i) // 2 < 4096),
backs AS (SELECT f, 2 * m + i AS k, sum(2 * h.h * y) AS z FROM lows, h GROUP BY 1, 2 HAVING 2 * m + i < 8192),
levels AS (SELECT f, 20 * log10(greatest(1e-12, sqrt(avg(z * z))) / sqrt(avg(x * x))) AS g FROM backs JOIN x USING (f) WHERE x.n = k AND k >= 512 GROUP BY f),
steps AS (SELECT f, g, lag(f) OVER (ORDER BY f) AS f0, lag(g) OVER (ORDER BY f) AS g0 FROM levels)
SELECT round(f0 + (g0 + 3) / (g0 - g) * (f - f0), 1) AS hertz FROM steps WHERE g0 >= -3 AND g < -3 ORDER BY f LIMIT 1"""
VECTORS = f"{emb_scaled(8)}, ps AS (SELECT stream, 0 AS packet, any_value(label) AS label, any_value(s) AS s, count(*) - 1 AS n FROM qs JOIN (SELECT DISTINCT stream, label FROM emb) USING (stream) GROUP BY stream), pk AS (SELECT stream, 0 AS packet, idx::int AS i, s, (count(*) OVER (PARTITION BY stream) - 1)::int AS n, q FROM qs)"
ORACLE["flagship"] = f"""WITH {costs(deltas(VECTORS, 8), VBR8)},
back AS (SELECT stream, i + 1 AS idx, sum(delta) OVER (PARTITION BY stream ORDER BY i) AS up FROM dl),
y AS (SELECT qs.stream, x, ((((max(CASE WHEN qs.idx = 0 THEN q END) OVER (PARTITION BY qs.stream)) + coalesce(up, 0) + 128)::bigint & 255) - 128) * (s + 1) / 32767::double AS y FROM qs LEFT JOIN back ON back.stream = qs.stream AND back.idx = qs.idx),
e AS (SELECT stream, sum(x * x) AS p, sum((x - y) * (x - y)) AS e FROM y GROUP BY stream)
SELECT label, count(*) AS packets, sum(coalesce((bits + 7) // 8, 2))::bigint AS bytes, round(sum(n + 2) / sum(coalesce((bits + 7) // 8, 2))::double, 6) AS ratio, round(10 * log10(sum(p) / sum(e)), 4) AS snr_db
FROM ps JOIN e USING (stream) LEFT JOIN bc USING (stream, packet) GROUP BY label"""
