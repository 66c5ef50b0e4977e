"""The jobs as queries: each runs twice into one new folder, and what stands there after the second run is the result."""

from __future__ import annotations

from helixframe.functions import strand as S
from helixframe.operators import packet_table as P
from helixframe.operators.screening import mask_digits
from helixframe.plans.catalogue import _CHECK_BASES, _S, _TOTAL, query
from helixframe.scratch import scratch
from jobs import archive_strands, packet_search


def _bases(digits: str) -> str:
    for i, c in enumerate(S.HEX):
        digits = f"replace({digits}, '{c}', '{S.pair(i)}')"
    return digits


_MASKS = ", ".join(f"({i}, {m}, '{S.pair(m)}', '{mask_digits(m)}')" for i, m in enumerate(archive_strands.DEFAULTS["masks"]))


@query(f"""{_S}, m AS (SELECT * FROM (VALUES {_MASKS}) t(i, mask, head, digits)), f AS (SELECT doc_id, chunk_idx, i, mask, head || {_bases(f"translate(h, '{S.HEX}', digits)")} AS strand FROM s, m),
e AS (SELECT *, round(CAST({_TOTAL} AS DOUBLE), 6) AS error_prob FROM f), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY error_prob, i) = 1)
SELECT doc_id, chunk_idx, mask, strand || {_CHECK_BASES} AS strand, error_prob, CAST(doc_id % 16 AS INTEGER) AS pool FROM b""")
def job1_archive_strands(spark, sf_dir):
    """The archive after two runs: the second finds nothing new."""
    out = scratch(spark, "archive")
    for _ in range(2):
        archive_strands.archive(spark, f"{sf_dir}/documents.parquet", f"{out}/output", f"{out}/checkpoint")
    return archive_strands.strands(spark, f"{out}/output").drop("load")


_D = packet_search.DEFAULTS
_SIZE, _MOST = _D["chunk_bytes"], _D["block_chunks"]


def _drawn(times: int) -> str:
    x = "(seed + 1)"
    for _ in range(times):
        x = f"({x} * {P.FACTOR} % {P.MODULUS})"
    return x


_SEED = " || ".join(f"substr('ACGT', CAST(xor(seed, {P.SEED_MASK}) // {4**i} % 4 + 1 AS BIGINT), 1)" for i in reversed(range(8)))


@query(f"""WITH h AS (SELECT doc_id AS file_id, hex(encode(text)) AS x FROM documents WHERE length(text) > 0), b0 AS (SELECT file_id, unnest(generate_series(0, (length(x) - 1) // {2 * _SIZE * _MOST})) AS block, x FROM h),
b1 AS (SELECT file_id, block, substr(x, block * {2 * _SIZE * _MOST} + 1, {2 * _SIZE * _MOST}) AS x FROM b0), b AS (SELECT file_id, block, CAST(length(x) // 2 AS INTEGER) AS n_bytes, CAST(ceil(length(x) / {2 * _SIZE}.0) AS INTEGER) AS k, x FROM b1),
q AS (SELECT file_id, block, n_bytes, k, unnest(generate_series(0, CAST(ceil(k * {_D['tries_per_chunk']}) AS BIGINT) - 1)) AS seed FROM b),
w AS (SELECT *, 1 + len(list_filter({P.degree_limits(_MOST)}, lambda t: t <= {_drawn(3)} % {P.SCALE})) AS d, {P.primes_from(_MOST)}[k + 1] AS p FROM q),
u AS (SELECT *, list_filter(list_transform(range(p), lambda j: ({_drawn(5)} % p + j * (1 + {_drawn(4)} % (p - 1))) % p), lambda i: i < k)[1:least(d, k)] AS used FROM w),
l AS (SELECT file_id, block, c, lane, CAST('0x' || substr(rpad(x, k * {2 * _SIZE}, '0'), CAST((c * {_SIZE} + lane * {P.LANE}) * 2 + 1 AS BIGINT), {2 * P.LANE}) AS BIGINT) AS v FROM (SELECT *, unnest(range(k)) AS c FROM b), range({_SIZE // P.LANE}) t(lane)),
o AS (SELECT file_id, block, seed, lane, bit_xor(v) AS v FROM (SELECT file_id, block, seed, unnest(used) AS c FROM u) JOIN l USING (file_id, block, c) GROUP BY ALL), g AS (SELECT file_id, block, seed, string_agg(printf('%08x', v), '' ORDER BY lane) AS hx FROM o GROUP BY ALL),
z AS (SELECT file_id, block, n_bytes, k, seed, CAST(len(used) AS INTEGER) AS degree, {_SEED} || {_bases('hx')} AS strand FROM u JOIN g USING (file_id, block, seed)), s AS (SELECT * REPLACE (strand || {_CHECK_BASES} AS strand) FROM z)
SELECT file_id, block, n_bytes, k, CAST(seed AS INTEGER) AS seed, degree, strand, round(CAST({_TOTAL} AS DOUBLE), 6) AS error_prob, CAST(file_id % {_D['pools']} AS INTEGER) AS pool FROM s
QUALIFY row_number() OVER (PARTITION BY file_id, block ORDER BY error_prob, seed) <= ceil(k * CAST({1 + _D['overhead']} AS DOUBLE))""")
def job2_packet_search(spark, sf_dir):
    """The packets kept after two runs, the second of which writes them anew."""
    out = scratch(spark, "search")
    for _ in range(2):
        packet_search.search(spark, f"{sf_dir}/documents.parquet", out)
    return packet_search.packets(spark, out)
